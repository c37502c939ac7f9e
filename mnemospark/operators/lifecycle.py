"""State jobs: ``(state, requests) -> next state or outcomes``, as joins over snapshots."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..sources.staging import stage, unstage
from .graph import components
from .transitions import apply_in_order, deletion, resolution, supersession, update, shares

#: Trust by source: a proposal below a fact's trust becomes a dissent.
TRUST = {"User": 4, "Controller": 3, "Task": 2, "AgentProposal": 1}


def trust(source: str) -> Column:
    rank = F.lit(0)
    for name, value in TRUST.items():
        rank = F.when(F.col(source) == name, F.lit(value)).otherwise(rank)
    return rank


class _Facts:
    """The facts that one group of requests can see, while the requests are worked off in order."""

    def __init__(self):
        self.facts: dict[str, tuple[str, str, int, int, bool]] = {}  # id: type, hash, trust, version, live
        self.holders: dict[tuple[str, str], list[str]] = {}  # heaps of ids, of which some may have moved on

    def put(self, key: str, kind: str, digest: str, rank: int, version: int, live: bool = True) -> None:
        self.facts[key] = (kind, digest, rank, version, live)
        if live:
            heapq.heappush(self.holders.setdefault((kind, digest), []), key)

    def holder(self, kind: str, digest: str) -> str | None:
        """Smallest id that holds this content now."""
        heap = self.holders.get((kind, digest), [])
        while heap and self.facts[heap[0]][:2] != (kind, digest):
            heapq.heappop(heap)
        return heap[0] if heap else None

    def submit(self, key: str, kind: str, digest: str, rank: int, expected: int | None) -> tuple[str, int | None, bool]:
        """(outcome, version written, whether a deleted fact lives again)."""
        same = self.holder(kind, digest)
        if same is not None:
            return "touch" if expected is None or expected == self.facts[same][3] else "conflict", None, False
        if key not in self.facts:
            self.put(key, kind, digest, rank, 1)
            return "insert", 1, False
        _, _, held, version, live = self.facts[key]
        if rank < held:
            return "dissent", None, False
        if expected is not None and expected != version:
            return "conflict", None, False
        self.put(key, kind, digest, rank, version + 1)
        return "amend", version + 1, not live


def upsert_facts(state: DataFrame, requests: DataFrame) -> DataFrame:
    """(seq, fact_id, outcome, version, revives_deleted) of each request (seq, fact_id, type, payload_hash, source, expected), in ``seq`` order.

    touch: the content (type and hash) is held by a live fact, in the snapshot or by an earlier request (conflict if
    ``expected`` is not that fact's version); else for a known id: dissent below its trust, conflict on
    another version, amend; else insert. Of several holders the smallest id counts. Version is set where a
    row is written. A deleted fact holds no content, but its id is known: trust and version count as for a live
    one, and an amendment makes it live again.

    Requests that can see each other share an id or a content; such groups are found as connected components,
    and each is worked off as a sorted stream, of which only the facts it names are held.
    """
    every = state.select(F.col("id").alias("fact_id"), "type", "payload_hash", trust("source").alias("rank"), "version", F.col("deleted_at").isNull().alias("live"))
    live = every.filter("live").drop("live")
    content = ["type", "payload_hash"]
    named = every.join(requests.select("fact_id").distinct(), "fact_id", "left_semi")
    others = live.join(requests.select(*content).distinct(), content, "left_semi").join(requests.select("fact_id").distinct(), "fact_id", "left_anti")
    held = others.groupBy(*content).agg(F.min(F.struct("fact_id", "rank", "version")).alias("f")).select("f.fact_id", *content, "f.rank", "f.version")
    before = named.unionByName(held.withColumn("live", F.lit(True))).withColumns({"seq": F.lit(None).cast("bigint"), "expected": F.lit(None).cast("int")})
    asked = requests.select("fact_id", *content, trust("source").alias("rank"), F.lit(None).cast("int").alias("version"), F.lit(True).alias("live"), F.col("seq").cast("bigint").alias("seq"), F.col("expected").cast("int").alias("expected"))
    rows = stage(before.unionByName(asked).withColumns({"a": F.xxhash64(F.lit("id"), "fact_id"), "b": F.xxhash64(F.lit("content"), *content)}), "upserts")
    groups = stage(components(rows.select("a", "b")).withColumnRenamed("id", "a"), "groups")
    grouped = rows.join(groups, "a").select("comp", "seq", "fact_id", *content, "rank", "version", "live", "expected")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, facts = None, _Facts()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["comp"] != comp:
                    comp, facts = r["comp"], _Facts()
                if r["seq"] is None:
                    facts.put(r["fact_id"], r["type"], r["payload_hash"], r["rank"], r["version"], r["live"])
                else:
                    out.append((r["seq"], r["fact_id"], *facts.submit(r["fact_id"], r["type"], r["payload_hash"], r["rank"], r["expected"])))
            columns = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_()), strict=True)], names=["seq", "fact_id", "outcome", "version", "revives_deleted"])

    return grouped.repartition("comp").sortWithinPartitions("comp", F.col("seq").asc_nulls_first()).mapInArrow(fold, "seq bigint, fact_id string, outcome string, version int, revives_deleted boolean")


def next_facts(state: DataFrame, requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(id, type, payload_hash, source, version, deleted_at) after the requests: the last write of each id replaces its row."""
    written = outcomes.filter("outcome in ('amend', 'insert')").join(requests.select("seq", "type", "payload_hash", "source"), "seq")
    last = written.groupBy(F.col("fact_id").alias("id")).agg(F.max(F.struct("seq", "type", "payload_hash", "source", "version")).alias("w"))
    columns = ["id", "type", "payload_hash", "source", "version", "deleted_at"]
    kept = state.select(*columns).join(last.select("id"), "id", "left_anti")
    return kept.unionByName(last.select("id", "w.type", "w.payload_hash", "w.source", "w.version", F.lit(None).cast(state.schema["deleted_at"].dataType).alias("deleted_at")))


def dissents_of(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(fact_id, payload_hash, submission_count) of the dissents that the requests file."""
    filed = outcomes.filter("outcome = 'dissent'").select("seq").join(requests, "seq")
    return filed.groupBy("fact_id", "payload_hash").agg(F.count(F.lit(1)).alias("submission_count"))


def file_dissents(pending: DataFrame, proposals: DataFrame, facts: DataFrame) -> DataFrame:
    """Pending dissents after filing on live facts: an identical payload raises the count, others are added; filings on dead or unknown facts are refused."""
    live = facts.filter("deleted_at is null").select(F.col("id").alias("fact_id"))
    filed = proposals.join(live, "fact_id", "left_semi")
    both = pending.select("fact_id", "payload", F.col("submission_count").cast("bigint").alias("n")).unionByName(filed.select("fact_id", "payload", F.lit(1).cast("bigint").alias("n")))
    return both.groupBy("fact_id", "payload").agg(F.sum("n").alias("submission_count"))


def resolve_dissents(dissents: DataFrame, facts: DataFrame, requests: DataFrame, source: str = "User") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, next facts, next dissents) of the requests (seq, dissent_id, action, expected), in ``seq`` order per fact.

    promoted, discarded, not_pending, missing or conflict; each sees the versions and dissents that those before it left. A promotion's
    payload, ``source`` and version replace the fact's.
    """
    d = dissents.select(F.col("id").alias("dissent_id"), "fact_id", "status", "payload")
    r = requests.select("seq", "dissent_id", "action", F.col("expected").cast("int").alias("expected")).join(d, "dissent_id", "left")
    asked = stage(r.select("seq", F.col("fact_id").alias("id"), "dissent_id", "action", "expected", "status", "payload", F.sha2(F.concat_ws(":", "fact_id", "payload"), 256).alias("payload_hash"), F.lit(source).alias("source")), "resolutions")
    after, done = apply_in_order(facts, asked, resolution)
    outcomes = stage(asked.select("seq", "dissent_id").join(done.select("seq", "outcome", "version"), "seq"), "outcomes")
    new = outcomes.filter("outcome in ('promoted', 'discarded')").select(F.col("dissent_id").alias("id"), F.col("outcome").alias("new"))
    return outcomes.select("seq", "dissent_id", "outcome", "version"), after, dissents.join(new, "id", "left").withColumn("status", F.coalesce("new", "status")).select(*dissents.columns)


def orphan_dissents(dissents: DataFrame, facts: DataFrame) -> DataFrame:
    """Pending dissents of deleted facts become orphaned."""
    gone = facts.filter("deleted_at is not null").select(F.col("id").alias("fact_id"), F.lit(True).alias("gone"))
    return dissents.join(gone, "fact_id", "left").select("id", F.when((F.col("status") == "pending") & F.col("gone"), "orphaned").otherwise(F.col("status")).alias("status"))


def delete_restore(state: DataFrame, requests: DataFrame, events: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(next state, outcomes) of the requests (seq, id, action) in order: ids of ``events`` are refused, repeats are no-ops, unknown ids are missing.

    Deleted rows get the time ``as_of``, restored ones lose it and ``superseded_by``, hard-deleted ones are gone.
    """
    parts = shares(requests)
    r = requests.repartition(parts, "id").join(events.select("id", F.lit(True).alias("event")).repartition(parts, "id"), "id", "left")
    return apply_in_order(state, r.select("seq", "id", "action", F.coalesce("event", F.lit(False)).alias("event"), as_of.alias("at")), deletion, parts=parts)


def remove_authors(authors: DataFrame, owned: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, outcome) of removals: refused while the author owns anything (``owned``: author_id) or is seeded, missing if unknown."""
    n = owned.groupBy(F.col("author_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    known = authors.select("id", F.lit(True).alias("known"))
    r = requests.select("id").join(known, "id", "left").join(n, "id", "left")
    return r.select("id", F.when(F.col("known").isNull(), "missing").when(F.coalesce("n", F.lit(0)) > 0, "refused").when(F.col("id").isin("system", "lost-author"), "refused").otherwise("removed").alias("outcome"))


def supersede(knowledge: DataFrame, requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(next state, outcomes) of the requests (seq, id, new_id, text, author_id) in order; a request may name what one before it wrote.

    superseded: the row is deleted and points to the new one, which inherits tags and volatility. missing: unknown, deleted, or superseded
    by then. not_agent_authored, and invalid for an empty text. ``new_id`` is new and given once. Requests on a row and on what
    replaces it form a chain, which pointer doubling gathers under its first row.
    """
    r = stage(requests.select("seq", "id", "new_id", "text", "author_id"), "supersessions")
    links = stage(r.select(F.col("new_id").alias("at"), F.col("id").alias("root")), "links")
    while True:
        step = links.select(F.col("at").alias("root"), F.col("root").alias("next"))
        if links.join(step, "root", "left_semi").isEmpty():
            break
        before, links = links, stage(links.join(step, "root", "left").select("at", F.coalesce("next", "root").alias("root")), "links")
        unstage(before)
    asked = r.join(links.select(F.col("at").alias("id"), "root"), "id", "left").select("seq", F.coalesce("root", "id").alias("id"), F.col("id").alias("old_id"), "new_id", "text", as_of.alias("at"))
    state = knowledge if "supersedes" in knowledge.columns else knowledge.withColumn("supersedes", F.lit(None).cast("string"))
    state = state if "superseded_by" in knowledge.columns else state.withColumn("superseded_by", F.lit(None).cast("string"))
    after, done = apply_in_order(state, asked, supersession)
    outcomes = stage(r.drop("text").join(done.select("seq", "outcome"), "seq"), "outcomes")
    won = outcomes.filter("outcome = 'superseded'")
    roots = asked.join(won.select("seq"), "seq", "left_semi").select("id", F.col("seq").alias("nth"))
    inherited = state.select("id", "tags", "volatility").join(roots, "id").select(F.col("nth").alias("seq"), "tags", "volatility")
    own = F.struct([F.lit(None).cast(f.dataType).alias(f.name) for f in state.schema.fields if f.name not in ("id", "text", "content_hash", "source", "tags", "volatility", "author_id", "created_at", "deleted_at", "supersedes", "superseded_by")])
    fresh = won.join(r.select("seq", "text"), "seq").join(inherited, "seq").join(won.select(F.col("id").alias("new_id"), F.col("new_id").alias("later")), "new_id", "left")
    made = fresh.withColumn("rest", own).select(F.col("new_id").alias("id"), "text", content_hash(F.col("text")).alias("content_hash"), F.lit("AgentProposal").alias("source"), "tags", "volatility", "author_id", as_of.alias("created_at"), F.when(F.col("later").isNotNull(), as_of).alias("deleted_at"), F.col("id").alias("supersedes"), F.col("later").alias("superseded_by"), "rest.*")
    return after.unionByName(made.select(*state.columns)), outcomes.select("seq", "id", "new_id", "outcome")


def update_in_place(knowledge: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next state, outcomes) of the requests (seq, id, text, tags, volatility) in order; null leaves what is there, a text brings its hash."""
    asked = requests.select("seq", "id", "text", content_hash(F.col("text")).alias("content_hash"), "tags", "volatility")
    return apply_in_order(knowledge, asked, update)


def file_proposals(requests: DataFrame) -> DataFrame:
    """Supersede proposals, equal ones (keeper, set of retirees, text) counted as one."""
    key = F.sha2(F.concat_ws("|", "keeper_id", F.array_join(F.array_sort("retire_ids"), ","), F.coalesce("text", F.lit(""))), 256)
    return requests.groupBy(key.alias("proposal_hash")).agg(F.min("keeper_id").alias("keeper_id"), F.count(F.lit(1)).alias("submission_count"))


def resolve_proposals(proposals: DataFrame, knowledge: DataFrame) -> DataFrame:
    """accepted or stale for each proposal (seq, keeper_id, retire_ids, and maybe the text of a merged row, which retires the keeper too), in ``seq`` order.

    A proposal is stale if a row it names is dead or was retired by an accepted one before it. A proposal waits for
    the first undecided one before it that retires a row it names. Each round accepts those that wait for none,
    and those that wait for one alone, and would be free without it, get the opposite of its outcome: such chains,
    however long, are shortened by pointer doubling. Rows that many proposals name are only ever seen through
    their first two retirers. Rounds go on until all are decided; the smallest undecided one always is.
    """
    alive = knowledge.filter("deleted_at is null and source = 'AgentProposal'").select(F.col("id").alias("row"))
    merged = F.col("text").isNotNull() if "text" in proposals.columns else F.lit(False)
    every = proposals.select("seq", F.explode(F.concat(F.array("keeper_id"), "retire_ids")).alias("row"), "keeper_id", merged.alias("merged"))
    retires = (F.col("row") != F.col("keeper_id")) | F.col("merged")
    named = stage(every.select("seq", "row", retires.alias("retires")).distinct(), "named")
    dead = named.join(alive, "row", "left_anti").select("seq").distinct()
    decided = stage(dead.withColumn("outcome", F.lit("stale")), "decided")
    while True:
        gone = named.filter("retires").join(decided.filter("outcome = 'accepted'").select("seq"), "seq").groupBy("row").agg(F.min("seq").alias("by"))
        left = named.join(decided, "seq", "left_anti")
        lost = left.join(gone, "row").filter("by < seq").select("seq").distinct()
        lost = stage(lost.withColumn("outcome", F.lit("stale")), "lost")
        left = stage(left.join(lost, "seq", "left_anti"), "left")
        first = left.filter("retires").groupBy("row").agg(F.min("seq").alias("first"))
        second = left.filter("retires").join(first, "row").filter("seq > first").groupBy("row").agg(F.min("seq").alias("second"))
        waits = F.coalesce(F.col("first") < F.col("seq"), F.lit(False))
        look = left.join(first, "row", "left").join(second, "row", "left").groupBy("seq").agg(
            F.bool_or(waits).alias("waits"),
            F.min(F.when(waits, F.col("first"))).alias("one"),
            F.max(F.when(waits, F.col("first"))).alias("other"),
            F.bool_and(~waits | F.coalesce(F.col("second") >= F.col("seq"), F.lit(True))).alias("alone"),
        )
        look = stage(look, "look")
        links = stage(look.filter("waits and alone and one = other").select("seq", F.col("one").alias("to"), F.lit(True).alias("odd")), "links")
        while True:
            step = links.select(F.col("seq").alias("to"), F.col("to").alias("next"), F.col("odd").alias("turn"))
            if links.join(step, "to", "left_semi").isEmpty():
                break
            joined = links.join(step, "to", "left").select("seq", F.coalesce("next", "to").alias("to"), (F.col("odd") != F.coalesce("turn", F.lit(False))).alias("odd"))
            before, links = links, stage(joined, "links")
            unstage(before)
        free = look.filter("not waits").select("seq", F.lit("accepted").alias("outcome"))
        chained = links.join(free.select(F.col("seq").alias("to")), "to").select("seq", F.when(F.col("odd"), "stale").otherwise("accepted").alias("outcome"))
        before, decided = decided, stage(decided.unionByName(lost).unionByName(free).unionByName(chained), "decided")
        done = look.filter("waits").select("seq").join(decided, "seq", "left_anti").isEmpty()
        unstage(before, lost, left, look, links)
        if done:
            unstage(named)
            return decided


def after_proposals(knowledge: DataFrame, proposals: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Knowledge after the accepted proposals: retired rows are deleted and point to the keeper, or to the merged row where there is a text.

    A merged row (``merged-<seq>``) has the proposal's text, its hash, and the keeper's tags and volatility. Each row is retired once,
    since a proposal that names a retired one is stale.
    """
    won = proposals.join(outcomes.filter("outcome = 'accepted'").select("seq"), "seq", "left_semi").withColumn("survivor", F.when(F.col("text").isNotNull(), F.concat(F.lit("merged-"), "seq")).otherwise(F.col("keeper_id")))
    rows = F.array_distinct(F.concat("retire_ids", F.when(F.col("text").isNotNull(), F.array("keeper_id")).otherwise(F.array().cast("array<string>"))))
    gone = won.select(F.explode(rows).alias("row"), "survivor").filter("row <> survivor")
    state = knowledge if "superseded_by" in knowledge.columns else knowledge.withColumn("superseded_by", F.lit(None).cast("string"))
    kept = state.join(gone, state["id"] == gone["row"], "left").withColumns({"deleted_at": F.when(F.col("survivor").isNotNull(), as_of).otherwise(F.col("deleted_at")), "superseded_by": F.coalesce("survivor", "superseded_by")}).select(*state.columns)
    keeper = state.select(F.col("id").alias("keeper_id"), "tags", "volatility", "author_id")
    own = F.struct([F.lit(None).cast(f.dataType).alias(f.name) for f in state.schema.fields if f.name not in ("id", "text", "content_hash", "source", "tags", "volatility", "author_id", "created_at")])
    made = won.filter("text is not null").join(keeper, "keeper_id").withColumn("rest", own)
    made = made.select(F.col("survivor").alias("id"), "text", content_hash(F.col("text")).alias("content_hash"), F.lit("AgentProposal").alias("source"), "tags", "volatility", "author_id", as_of.alias("created_at"), "rest.*")
    return kept.unionByName(made.select(*state.columns))


def repair_attribution(rows: DataFrame, links: DataFrame, authors: DataFrame, system: str = "system", lost: str = "lost-author") -> DataFrame:
    """(id, new_author, bucket) of system-owned rows: one other author linked and known: recovered; several or unknown: lost."""
    own = rows.filter(F.col("author_id") == system).select("id", "link")
    others = links.filter(F.col("author_id") != system).select("link", "author_id").distinct()
    seen = own.join(others, "link", "left").groupBy("id").agg(F.count_distinct("author_id").alias("n"), F.min("author_id").alias("one"))
    known = authors.select(F.col("id").alias("one"), F.lit(True).alias("known"))
    r = seen.join(known, "one", "left")
    bucket = F.when(F.col("n") == 0, "left").when((F.col("n") == 1) & F.coalesce("known", F.lit(False)), "recovered").otherwise("lost")
    return r.select("id", bucket.alias("bucket"), F.when(bucket == "recovered", F.col("one")).when(bucket == "lost", lost).otherwise(system).alias("new_author"))


def merge_authors(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows repointed by (from_id, to_id)."""
    return rows.join(mapping, rows["author_id"] == mapping["from_id"], "left").select("id", F.coalesce("to_id", "author_id").alias("author_id"))


def copies(knowledge: DataFrame) -> DataFrame:
    """(content, seq, machine, file, repo): where each content lies, each place once, with its first arrival.

    One row per place and content rather than an array per content, which has no bound. Rows without a hash are
    contents of their own.
    """
    live = knowledge.filter("deleted_at is null").withColumn("content", F.coalesce("content_hash", F.concat(F.lit("id:"), "id")))
    return live.groupBy("content", "machine", "file", "repo").agg(F.min("seq").alias("seq"))


def dedupe_with_copies(knowledge: DataFrame) -> DataFrame:
    """(content, seq, n): one live row per content, its first arrival and number of places."""
    return copies(knowledge).groupBy("content").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))


def drop_copy(places: DataFrame, machine: str) -> DataFrame:
    """Contents after one machine's copies are removed: those without copies go, the first copy left is canonical."""
    left = places.filter(~F.col("machine").eqNullSafe(F.lit(machine)))
    return left.groupBy("content").agg(F.count(F.lit(1)).alias("n_copies"), F.min_by("file", "seq").alias("file"))


def copy_sets(places: DataFrame) -> DataFrame:
    """(content, field, value, place): distinct machines, files and repositories of each content in order of arrival."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("machine", "file", "repo")])
    each = places.select("content", "seq", F.explode(fields).alias("f")).filter("f.value is not null")
    return each.groupBy("content", "f.field", "f.value").agg(F.min("seq").alias("seq"))


def canonical(places: DataFrame) -> DataFrame:
    """(content, machine, file, repo) of each content's first copy."""
    return places.groupBy("content").agg(F.min_by(F.struct("machine", "file", "repo"), "seq").alias("c")).select("content", "c.*")


def register_authors(requests: DataFrame) -> DataFrame:
    """One row an id: name and ``extra`` of the request seen last (of equal times the largest name, then extra), with the name's shape and slug."""
    last = requests.groupBy("id").agg(F.max(F.struct("seen_at", "agent_name", "extra")).alias("r")).select("id", "r.agent_name", F.col("r.seen_at").alias("last_seen_at"), "r.extra")
    ok = F.col("agent_name").rlike("^[a-z0-9_-]{2,64}$") & (F.octet_length(F.coalesce("extra", F.lit(""))) <= 16384)
    slug = F.regexp_replace(F.regexp_replace(F.lower("agent_name"), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")
    return last.select("id", "agent_name", "last_seen_at", ok.alias("valid"), slug.alias("slug"))


def decay_weight(as_of: Column) -> Column:
    """1 / (1 + rate x age in seconds), age since the last use or the creation; task facts age faster."""
    age = F.greatest(F.unix_timestamp(as_of) - F.unix_timestamp(F.coalesce("last_used_at", "created_at")), F.lit(0))
    return F.round(1 / (1 + F.when(F.col("type") == "TaskFact", 1e-6).otherwise(1e-9) * age), 6)


def decay(facts: DataFrame, as_of: Column) -> DataFrame:
    """The decay weight of live facts."""
    return facts.filter("deleted_at is null").select("id", decay_weight(as_of).alias("decay_weight"))


def merge_summaries(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New summaries replace those of the same key and are valid again."""
    return old.join(new.select(*keys), keys, "left_anti").select(*keys, "summary", "invalidated").unionByName(new.select(*keys, "summary", F.lit(False).alias("invalidated")))


def invalidate_summaries(summaries: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """Summaries of the given keys are marked invalid until they are made again."""
    hit = keys.select(*names).distinct().withColumn("hit", F.lit(True))
    return summaries.join(hit, names, "left").withColumn("invalidated", F.col("invalidated") | F.coalesce("hit", F.lit(False))).select(*summaries.columns)


def list_summaries(summaries: DataFrame, limit: int = 50, host: str | None = None) -> DataFrame:
    """Valid summaries, newest day first."""
    s = summaries.filter(~F.col("invalidated"))
    return (s.filter(F.col("host") == host) if host else s).orderBy(F.desc("day"), "host", "category").limit(limit)


def sibling_authors(rows: DataFrame, links: DataFrame, system: str = "system") -> DataFrame:
    """(id, author_id): the distinct other authors linked to each system-owned row."""
    own = rows.filter(F.col("author_id") == system).select("id", "link")
    return own.join(links.filter(F.col("author_id") != system).select("link", "author_id").distinct(), "link").select("id", "author_id").distinct()


def bump_usage(facts: DataFrame, reads: DataFrame) -> DataFrame:
    """use_count + 1 for each flush in which an id was read, however often; last_used_at of the last flush."""
    per = reads.select("id", "flush").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("bumps"), F.max("flush").alias("last"))
    return facts.join(per, "id", "left").select("id", (F.col("use_count") + F.coalesce("bumps", F.lit(0))).cast("bigint").alias("use_count"), F.coalesce("last", "last_used_at").alias("last_used_at"))
