"""Queries over scans, predicates, joins, aggregates and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import activity as act
from ..operators import context as cx
from ..operators import predicates as pr
from ..operators import ranking as rk
from ..operators import sketches as sk
from ..operators import timeline as tl
from ..operators import validation as va
from ..sources import files
from ..sources.staging import stage
from .adapters import AS_OF, MODEL, as_of, authors, dissents, events, facts, knowledge, table, with_vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, model: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = MODEL + sql if model else sql
        return f

    return add


@query("s2_manifest_diff", """, old AS (SELECT file AS path, seq AS m0, content_hash AS h0 FROM knowledge WHERE seq % 23 <> 0),
new AS (SELECT file AS path, CASE WHEN seq % 17 = 0 OR seq % 19 = 0 THEN seq + 1 ELSE seq END AS m1, CASE WHEN seq % 17 = 0 THEN 'edited' ELSE content_hash END AS h1 FROM knowledge WHERE seq % 13 <> 0)
SELECT path, CASE WHEN m1 IS NULL THEN 'prune' WHEN m0 IS NULL THEN 'index' WHEN m0 = m1 THEN 'skip' WHEN h0 = h1 THEN 'touch' ELSE 'reindex' END AS action FROM old FULL JOIN new USING (path)""")
def manifest_diff(spark, sf):
    k = knowledge(spark, sf).select(F.col("file").alias("path"), "seq", "content_hash")
    s = F.col("seq")
    old = k.filter(s % 23 != 0).withColumnRenamed("seq", "mtime")
    new = k.filter(s % 13 != 0).select("path", F.when((s % 17 == 0) | (s % 19 == 0), s + 1).otherwise(s).alias("mtime"), F.when(s % 17 == 0, "edited").otherwise(F.col("content_hash")).alias("content_hash"))
    return files.manifest_diff(old, new)


@query("s3_repository", """, p AS (SELECT '/root/' || repo || '/sub' || seq % 3 || '/' || seq || '.md' AS path, repo, seq FROM knowledge)
SELECT path, CASE WHEN seq % 3 = 1 THEN 'sub1' ELSE repo END AS repo FROM p""")
def repository(spark, sf):
    p = knowledge(spark, sf).select(F.concat(F.lit("/root/"), "repo", F.lit("/sub"), F.col("seq") % 3, F.lit("/"), "seq", F.lit(".md")).alias("path"), "repo")
    git = p.filter(F.col("path").rlike("/sub1/")).select(F.concat(F.lit("/root/"), "repo", F.lit("/sub1")).alias("dir")).union(p.filter(F.col("repo").endswith("2")).select(F.concat(F.lit("/root/"), "repo"))).distinct()
    return files.repository_of(p.select("path"), git, "/root")


@query("s4_facts_scan", "SELECT id, type, source, created_at FROM facts WHERE type = 'TaskFact' AND source = 'Task' AND created_at > TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '1997-01-01' AND deleted_at IS NULL ORDER BY created_at DESC, id DESC LIMIT 500")
def facts_scan(spark, sf):
    f = facts(spark, sf).filter((F.col("type") == "TaskFact") & (F.col("source") == "Task") & pr.within("created_at", "1995-01-01", "1997-01-01", closed=False) & pr.live())
    return f.orderBy(F.desc("created_at"), F.desc("id")).limit(500).select("id", "type", "source", "created_at")


@query("s5_events_scan", "SELECT id, category, created_at FROM ev WHERE (task_id = 't7' OR json_extract_string(payload, '$.service') = 's1') AND category = 'error' AND created_at > TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-20' ORDER BY created_at, id LIMIT 500")
def events_scan(spark, sf):
    e = events(spark, sf).filter(((F.col("task_id") == "t7") | pr.payload_equals("service", "s1")) & (F.col("category") == "error") & pr.within("created_at", "2024-01-05", "2024-01-20", closed=False))
    return e.orderBy("created_at", "id").limit(500).select("id", "category", "created_at")


@query("s7_upsert_split", "SELECT id, embedding IS NOT NULL AND len(embedding) = 64 AS accepted FROM knowledge")
def upsert_split(spark, sf):
    ok, bad = files.split_by_dimension(with_vectors(knowledge(spark, sf).select("seq", "id"), spark, sf), 64)
    return ok.select("id", F.lit(True).alias("accepted")).unionByName(bad.select("id", F.lit(False).alias("accepted")))


@query("s9_retention", "SELECT id FROM ev WHERE created_at >= TIMESTAMP '2024-03-01' - INTERVAL 45 DAY")
def retention(spark, sf):
    return files.retained(events(spark, sf), "created_at", as_of(), 45).select("id")


@query("s10_dissent_scan", "SELECT id, fact_id, submitted_at FROM dissents WHERE status = 'pending' AND source = 'AgentProposal' AND submitted_at >= TIMESTAMP '1996-01-01' ORDER BY submitted_at DESC, id DESC LIMIT 200")
def dissent_scan(spark, sf):
    d = dissents(spark, sf).filter((F.col("status") == "pending") & (F.col("source") == "AgentProposal") & pr.within("submitted_at", "1996-01-01"))
    return d.orderBy(F.desc("submitted_at"), F.desc("id")).limit(200).select("id", "fact_id", "submitted_at")


@query("s10_proposal_scan", "SELECT seq, keeper_id, submitted_at FROM (SELECT seq, id AS keeper_id, created_at AS submitted_at, CASE WHEN seq % 60 = 0 THEN 'accepted' ELSE 'pending' END AS status FROM knowledge WHERE seq % 30 = 0) WHERE status = 'pending' ORDER BY submitted_at, seq LIMIT 200")
def proposal_scan(spark, sf):
    p = knowledge(spark, sf).filter("seq % 30 = 0").select("seq", F.col("id").alias("keeper_id"), F.col("created_at").alias("submitted_at"), F.when(F.col("seq") % 60 == 0, "accepted").otherwise("pending").alias("status"))
    return p.filter("status = 'pending'").orderBy("submitted_at", "seq").limit(200).select("seq", "keeper_id", "submitted_at")


_ENVELOPE = """, envelope AS (
  SELECT 'fact' AS kind, id, author_id, created_at, CAST([] AS VARCHAR[]) AS tags, deleted_at, deleted_by FROM facts
  UNION ALL SELECT 'event', id, author_id, created_at, CAST([] AS VARCHAR[]), NULL, NULL FROM ev
  UNION ALL SELECT 'knowledge', id, author_id, created_at, tags, deleted_at, deleted_by FROM knowledge)
"""


def envelope(spark, sf):
    return tl.unified(facts(spark, sf), events(spark, sf), knowledge(spark, sf))


@query("p1_unified", _ENVELOPE + "SELECT kind, id, author_id, created_at, array_to_string(tags, ',') AS tags, CASE WHEN deleted_at IS NULL THEN 'live' ELSE 'deleted' END AS state FROM envelope")
def unified(spark, sf):
    return envelope(spark, sf).select("kind", "id", "author_id", "created_at", F.array_join("tags", ",").alias("tags"), "state")


@query("p2_knowledge_filters", "SELECT id FROM knowledge WHERE machine = 'host1' AND repo = 'src3' AND list_contains(tags, 'en') AND source = 'Task' AND created_at >= TIMESTAMP '2024-01-03' AND created_at <= TIMESTAMP '2024-02-25' AND deleted_at IS NULL")
def knowledge_filters(spark, sf):
    k = knowledge(spark, sf)
    return k.filter((F.col("machine") == "host1") & (F.col("repo") == "src3") & F.array_contains("tags", "en") & (F.col("source") == "Task") & pr.within("created_at", "2024-01-03", "2024-02-25") & pr.live()).select("id")


_LABELLED = """, labelled AS (SELECT 'event' AS kind, id, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS VARCHAR) AS source, created_at, 'h' || k % 8 AS host, 'r' || k % 3 AS repo, ['x' || k % 2, 'y'] AS tags FROM ev
UNION ALL SELECT 'fact', id, type, source, created_at, 'h' || CAST(substr(id, 2) AS BIGINT) % 8, 'r' || CAST(substr(id, 2) AS BIGINT) % 3, ['x' || CAST(substr(id, 2) AS BIGINT) % 2, 'y'] FROM facts)
"""


def labelled(df, n):
    """Rows whose payload names a host, a repository and tags."""
    return df.withColumn("payload", F.concat(F.lit('{"host":"h'), n % 8, F.lit('","repo":"r'), n % 3, F.lit('","tags":["x'), n % 2, F.lit('","y"]}')))


@query("p3_payload_filters", _LABELLED + """SELECT 'no type' AS asked, kind, id FROM labelled WHERE host = 'h3' AND repo = 'r1' AND list_has_all(tags, ['y', 'x1']) AND created_at >= TIMESTAMP '1995-01-01' AND created_at <= TIMESTAMP '2024-01-20'
UNION ALL SELECT 'type', kind, id FROM labelled WHERE kind = 'fact' AND type = 'TaskFact' AND source = 'Task' AND host = 'h2'""")
def payload_filters(spark, sf):
    """Two searches' filters over facts and events: one by payload, and one that asks for a type, which no event has."""
    f, e = labelled(facts(spark, sf), F.substring("id", 2, 20).cast("bigint")), labelled(events(spark, sf), F.col("k"))
    asked = {"no type": {"since": "1995-01-01", "until": "2024-01-20", "tags": ["y", "x1"], "host": "h3", "repo": "r1"}, "type": {"type_": "TaskFact", "source": "Task", "host": "h2"}}
    parts = [df.filter(pr.retrieval_filter(kind, **how)).select(F.lit(name).alias("asked"), F.lit(kind).alias("kind"), "id") for name, how in asked.items() for kind, df in (("fact", f), ("event", e))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("p4_time_window", "SELECT id FROM ev WHERE created_at <= TIMESTAMP '2024-01-02'")
def time_window(spark, sf):
    return events(spark, sf).filter(pr.within("created_at", None, "2024-01-02")).select("id")


@query("p5_all_tags", "SELECT id FROM knowledge WHERE list_has_all(tags, ['fr', 't2'])")
def all_tags(spark, sf):
    return knowledge(spark, sf).filter(pr.all_tags(["fr", "t2"])).select("id")


@query("p6_liveness", "SELECT CASE WHEN deleted_at IS NULL THEN 'live' ELSE 'deleted' END AS state, count(*) AS n FROM facts GROUP BY 1")
def liveness(spark, sf):
    return facts(spark, sf).groupBy(F.when(pr.live(), "live").otherwise("deleted").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("p7_json_containment", "SELECT id FROM ev WHERE json_extract_string(payload, '$.host') = 'h1' AND json_extract_string(payload, '$.k') = '9'")
def json_containment(spark, sf):
    return events(spark, sf).filter(pr.contains_json("payload", {"host": "h1", "k": 9})).select("id")


@query("p8_window_status", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'inverted' WHEN o_orderkey % 50 > 30 THEN 'too_wide' ELSE 'ok' END AS status FROM orders", model=False)
def window_status(spark, sf):
    o = table(spark, sf, "orders")
    days = F.when(F.col("o_orderkey") % 4 == 0, -1).otherwise(F.col("o_orderkey") % 50).cast("int")
    r = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("a"), F.timestamp_add("DAY", days, F.col("o_orderdate")).alias("b"))
    return r.select("id", pr.window_status("a", "b").alias("status"))


@query("p9_query_status", "SELECT doc_id, CASE WHEN trim(text) = '' OR doc_id % 11 = 0 THEN 'empty' WHEN strlen(text) > 1024 THEN 'too_long' WHEN doc_id % 60 NOT BETWEEN 1 AND 50 THEN 'bad_top_k' ELSE 'ok' END AS status FROM documents", model=False)
def query_status(spark, sf):
    """Texts and top-k values; every eleventh text is white space of several kinds."""
    text = F.when(F.col("doc_id") % 11 == 0, "\n\t \u00a0\u3000").otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.alias("text"), (F.col("doc_id") % 60).alias("k")).select("doc_id", pr.query_status("text", "k").alias("status"))


@query("p10_may_curate", "SELECT id, (seq % 9 = 0) OR coalesce(author_id = 'a' || seq % 4, false) AS allowed FROM knowledge")
def may_curate(spark, sf):
    k = knowledge(spark, sf).withColumns({"caller": F.concat(F.lit("a"), F.col("seq") % 4), "manages": F.col("seq") % 9 == 0})
    return k.select("id", pr.may_curate("caller", "author_id", "manages").alias("allowed"))


@query("j1_fact_author", "SELECT f.id, a.agent_name FROM facts f JOIN authors a ON a.id = f.author_id WHERE f.deleted_at IS NULL AND f.id IN (SELECT fact_id FROM dissents)")
def fact_author(spark, sf):
    a = authors(spark, sf).select(F.col("id").alias("author_id"), "agent_name")
    return facts(spark, sf).filter(pr.live()).join(dissents(spark, sf).select(F.col("fact_id").alias("id")), "id", "left_semi").join(a, "author_id").select("id", "agent_name")


@query("j2_event_author", "SELECT e.id, a.agent_name FROM ev e JOIN authors a ON a.id = e.author_id")
def event_author(spark, sf):
    return events(spark, sf).join(authors(spark, sf).select(F.col("id").alias("author_id"), "agent_name"), "author_id").select("id", "agent_name")


@query("j3_knowledge_author", "SELECT k.id, coalesce(a.agent_name, 'unknown') AS agent FROM knowledge k LEFT JOIN (SELECT * FROM authors WHERE id <> 'a3') a ON a.id = k.author_id")
def knowledge_author(spark, sf):
    a = authors(spark, sf).filter("id <> 'a3'").select(F.col("id").alias("author_id"), "agent_name")
    return knowledge(spark, sf).select("id", "author_id").join(a, "author_id", "left").select("id", F.coalesce("agent_name", F.lit("unknown")).alias("agent"))


@query("j4_deleted_facts", _ENVELOPE + "SELECT kind, e.id, deleted_at, deleted_by, coalesce(a.agent_name, 'unknown') AS deleter FROM envelope e LEFT JOIN authors a ON a.id = e.deleted_by WHERE kind = 'fact' AND deleted_at >= TIMESTAMP '2024-02-01' AND deleted_by = 'a4'")
def deleted_facts(spark, sf):
    return tl.deleted(envelope(spark, sf).filter("kind = 'fact'"), authors(spark, sf), "2024-02-01", "a4")


@query("j5_weight_update", "SELECT f.id, coalesce(round(1.0 / (1 + d.n), 6), 1.0) AS weight FROM facts f LEFT JOIN (SELECT fact_id, CAST(substr(id, 2) AS BIGINT) % 7 AS n FROM dissents) d ON d.fact_id = f.id")
def weight_update(spark, sf):
    pairs = dissents(spark, sf).select(F.col("fact_id").alias("id"), F.round(1.0 / (1 + F.substring("id", 2, 20).cast("bigint") % 7), 6).alias("new"))
    return facts(spark, sf).select("id").join(pairs, "id", "left").select("id", F.coalesce("new", F.lit(1.0)).alias("weight"))


@query("j7_section_dedupe", """, items AS (SELECT id, CASE seq % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'knowledge' ELSE 'event' END AS section, repo, CASE WHEN seq % 5 <> 4 THEN repo || '/' || (seq - seq % 3) || '.md' END AS file FROM knowledge),
k AS (SELECT * FROM items i WHERE section = 'knowledge' AND NOT EXISTS (SELECT 1 FROM items f WHERE f.section = 'fact' AND f.repo = i.repo AND f.file = i.file))
SELECT id, section FROM items WHERE section = 'fact' UNION ALL SELECT id, section FROM k UNION ALL SELECT id, section FROM items i WHERE section = 'event' AND NOT EXISTS (SELECT 1 FROM k WHERE k.repo = i.repo AND k.file = i.file)""")
def section_dedupe(spark, sf):
    s = F.col("seq")
    section = F.when(s % 3 == 0, "fact").when(s % 3 == 1, "knowledge").otherwise("event")
    items = knowledge(spark, sf).select(F.lit(1).alias("query_id"), "id", section.alias("section"), "repo", F.when(s % 5 != 4, F.concat("repo", F.lit("/"), s - s % 3, F.lit(".md"))).alias("file"))
    return cx.across_sections(items).select("id", "section")


_PROPOSALS = """, proposals AS (SELECT CAST(seq AS BIGINT) AS seq, id AS keeper_id, ['k' || (seq + 10), 'k' || (seq + 20)] AS retire_ids FROM knowledge WHERE seq % 30 = 0)
"""


def proposals(spark, sf):
    s = F.col("seq")
    return knowledge(spark, sf).filter(s % 30 == 0).select("seq", F.col("id").alias("keeper_id"), F.array(F.concat(F.lit("k"), s + 10), F.concat(F.lit("k"), s + 20)).alias("retire_ids"), F.lit(None).cast("string").alias("text"))


@query("j8_reference_check", _PROPOSALS + """SELECT p.seq, bool_and(k.id IS NOT NULL) AS valid FROM (SELECT seq, unnest(list_concat([keeper_id], retire_ids)) AS row FROM proposals) p
LEFT JOIN (SELECT id FROM knowledge WHERE deleted_at IS NULL AND source = 'AgentProposal') k ON k.id = p.row GROUP BY 1""")
def reference_check(spark, sf):
    ok = knowledge(spark, sf).filter("deleted_at is null and source = 'AgentProposal'").select(F.col("id").alias("row"), F.lit(True).alias("ok"))
    each = proposals(spark, sf).select("seq", F.explode(F.concat(F.array("keeper_id"), "retire_ids")).alias("row"))
    return each.join(ok, "row", "left").groupBy("seq").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("valid"))


_AUTHORS = """SELECT a.id, a.agent_name, a.last_seen_at, (SELECT count(*) FROM facts f WHERE f.author_id = a.id AND f.deleted_at IS NULL) AS fact_count, (SELECT count(*) FROM ev e WHERE e.author_id = a.id) AS event_count,
(SELECT count(*) FROM knowledge k WHERE k.author_id = a.id AND k.deleted_at IS NULL) AS knowledge_count, (SELECT count(*) FROM facts f WHERE f.deleted_by = a.id AND f.deleted_at IS NOT NULL) AS soft_deletes FROM authors a"""


@query("a1_author_rollup", _AUTHORS)
def author_rollup(spark, sf):
    return act.author_rollup(authors(spark, sf), facts(spark, sf), events(spark, sf), knowledge(spark, sf))


@query("a1_author_page", _AUTHORS + " WHERE last_seen_at >= TIMESTAMP '2024-01-05' AND agent_name = 'agent-1' AND (last_seen_at, id) < (TIMESTAMP '2025-01-01', 'a9') ORDER BY last_seen_at DESC, id DESC LIMIT 2")
def author_page(spark, sf):
    return act.author_page(authors(spark, sf), facts(spark, sf), events(spark, sf), knowledge(spark, sf), 2, ("2025-01-01", "a9"), "2024-01-05", "agent-1")


@query("a2_author_inventory", """, owned AS (SELECT author_id FROM facts UNION ALL SELECT author_id FROM ev UNION ALL SELECT author_id FROM knowledge)
SELECT a.id, a.agent_name, count(o.author_id) AS owned, count(o.author_id) = 0 AND a.id NOT IN ('system', 'lost-author') AS removable, (SELECT count(*) FROM authors b WHERE b.agent_name = a.agent_name) > 1 AS duplicate_name
FROM authors a LEFT JOIN owned o ON o.author_id = a.id GROUP BY 1, 2""")
def author_inventory(spark, sf):
    return act.author_inventory(authors(spark, sf), facts(spark, sf), events(spark, sf), knowledge(spark, sf))


@query("a3_dissent_count", "SELECT f.id, count(d.id) AS dissent_count FROM facts f LEFT JOIN (SELECT * FROM dissents WHERE status = 'pending') d ON d.fact_id = f.id GROUP BY 1")
def dissent_count(spark, sf):
    return act.pending_dissents(facts(spark, sf), dissents(spark, sf))


_CLUSTERS = """, subs AS (SELECT host, category, CAST(created_at AS DATE) AS day, service, count(*) AS n FROM ev GROUP BY ALL),
top AS (SELECT host, category, day, string_agg(n || '× ' || service, ', ' ORDER BY n DESC, service) AS top FROM (SELECT *, row_number() OVER (PARTITION BY host, category, day ORDER BY n DESC, service) AS rn FROM subs) WHERE rn <= 3 GROUP BY ALL),
clusters AS (SELECT host, category, CAST(created_at AS DATE) AS day, count(*) AS total, min(created_at) AS first_at, max(created_at) AS last_at FROM ev GROUP BY ALL)
"""


@query("a4_daily_clusters", _CLUSTERS + "SELECT host, category, day, total, first_at, last_at FROM clusters")
def daily_clusters(spark, sf):
    return act.daily_clusters(events(spark, sf)).drop("top")


@query("a4_cluster_members", "SELECT host, category, CAST(created_at AS DATE) AS day, id FROM ev")
def cluster_members(spark, sf):
    return act.cluster_members(events(spark, sf))


@query("a4_payload_labels", """, p AS (SELECT category, created_at, k, seq FROM ev)
SELECT CASE WHEN seq % 5 IN (0, 1) THEN 'h' || k % 8 ELSE '(unknown)' END AS host, category, CAST(created_at AS DATE) AS day, CASE WHEN seq % 5 = 0 THEN 's' || k % 5 WHEN seq % 5 = 1 THEN 'x' WHEN seq % 5 = 2 THEN 'y' ELSE '' END AS sub, count(*) AS total FROM p GROUP BY ALL""")
def payload_labels(spark, sf):
    """Events whose payloads name host and sub-category by different members, by ones that are no strings, or not at all."""
    k, s = F.col("k"), F.col("seq")
    host, service = F.concat(F.lit('"h'), k % 8, F.lit('"')), F.concat(F.lit('"s'), k % 5, F.lit('"'))
    payload = F.when(s % 5 == 0, F.concat(F.lit('{"host":'), host, F.lit(',"machine":"m","service":'), service, F.lit(',"type":"z"}'))).when(s % 5 == 1, F.concat(F.lit('{"host":7,"machine":'), host, F.lit(',"sub_category":"x","service":'), service, F.lit("}")))
    payload = payload.when(s % 5 == 2, '{"host":null,"type":"y","service":["s"]}').when(s % 5 == 3, "[1]").otherwise("no json")
    e = act.labelled(events(spark, sf).withColumn("payload", payload))
    return e.groupBy("host", "category", F.to_date("created_at").alias("day"), "sub").agg(F.count(F.lit(1)).alias("total"))


@query("a5_headlines", _CLUSTERS + "SELECT host, category, day, host || '/' || category || ' ' || strftime(first_at, '%H:%M') || '–' || strftime(last_at, '%H:%M') || ' — ' || total || ' events: ' || top AS headline FROM clusters JOIN top USING (host, category, day) WHERE total >= 2")
def headlines(spark, sf):
    return act.headlines(act.daily_clusters(events(spark, sf)), 2)


@query("a6_excerpts", "SELECT repo, regexp_extract(file, '^(.*)/[^/]*$', 1) AS folder, substr(arg_max(text, struct_pack(a := strlen(text), b := seq)), 1, 600) AS excerpt FROM (SELECT repo, text, seq, CASE WHEN seq % 3 = 0 THEN repo || '/sub' || seq % 2 || '/' || seq ELSE file END AS file FROM knowledge) GROUP BY 1, 2")
def excerpts(spark, sf):
    s = F.col("seq")
    return act.excerpts(knowledge(spark, sf).withColumn("file", F.when(s % 3 == 0, F.concat("repo", F.lit("/sub"), s % 2, F.lit("/"), s)).otherwise(F.col("file"))))


@query("a10_oversize_by_agent", "SELECT author_id, count(*) AS n, max(length(text)) AS longest, round(avg(length(text)), 6) AS mean FROM knowledge WHERE length(text) > 2000 GROUP BY 1")
def oversize_by_agent(spark, sf):
    n = F.length("text").cast("bigint")
    return knowledge(spark, sf).filter(n > 2000).groupBy("author_id").agg(F.count(F.lit(1)).alias("n"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"))


@query("a11_latency_profile", "SELECT category, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM ev GROUP BY 1")
def latency_profile(spark, sf):
    return act.latency_profile(events(spark, sf), "value", ["category"])


@query("a11_merged_profile", """, days AS (SELECT * FROM ev WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-19'), whole AS (SELECT category, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM days GROUP BY 1)
SELECT category, n, lo, hi, mean, true AS p50_close, true AS p95_close, true AS p99_close FROM whole""")
def merged_profile(spark, sf):
    """Two weeks' profile from the days' sketches; whether each quantile's exact rank is within two hundredths of the one asked for."""
    e = events(spark, sf)
    span = (F.col("day") >= F.lit("2024-01-05").cast("date")) & (F.col("day") < F.lit("2024-01-19").cast("date"))
    days = stage(sk.daily(e, "created_at", "value", "task_id", ["category"]), "days")
    p = sk.profile(sk.merged(days.filter(span), ["category"]), ["category"])
    ranks = e.filter(pr.within("created_at", "2024-01-05") & (F.col("created_at") < "2024-01-19")).join(F.broadcast(p.select("category", "p50", "p95", "p99")), "category")
    close = [((F.avg((F.col("value") < F.col(c)).cast("int")) <= q + 0.02) & (F.avg((F.col("value") <= F.col(c)).cast("int")) >= q - 0.02)).alias(f"{c}_close") for c, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return p.select("category", "n", "lo", "hi", F.round("mean", 6).alias("mean")).join(ranks.groupBy("category").agg(*close), "category")


@query("a12_activity_rates", "SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS window_start, author_id, category, round(count(*) / 5.0, 6) AS per_minute FROM ev GROUP BY ALL")
def activity_rates(spark, sf):
    return act.activity_rates(events(spark, sf), 5, ["author_id", "category"])


@query("w9_keyset_page", "SELECT id, created_at FROM ev WHERE (created_at, id) < (TIMESTAMP '2024-01-15', 'e5000') ORDER BY created_at DESC, id DESC LIMIT 100")
def keyset_page(spark, sf):
    return pr.keyset_after(events(spark, sf), "created_at", "id", ("2024-01-15", "e5000"), 100).select("id", "created_at")


@query("w9_next_cursor", "SELECT arg_min(id, struct_pack(t := created_at, i := id)) AS id, min(created_at) AS created_at FROM (SELECT id, created_at FROM ev WHERE (created_at, id) < (TIMESTAMP '2024-01-15', 'e5000') ORDER BY created_at DESC, id DESC LIMIT 100) HAVING count(*) >= 100")
def next_cursor(spark, sf):
    page = pr.keyset_after(events(spark, sf), "created_at", "id", ("2024-01-15", "e5000"), 100).select("id", "created_at")
    return pr.next_cursor(page, "created_at", "id", 100)


@query("w11_latest_per_key", "SELECT agent_name, last_seen_at, id FROM (SELECT *, row_number() OVER (PARTITION BY agent_name ORDER BY last_seen_at DESC, id DESC) AS rn FROM authors) WHERE rn = 1")
def latest_per_key(spark, sf):
    return rk.latest_per_key(authors(spark, sf), "agent_name", "last_seen_at").select("agent_name", "last_seen_at", "id")


@query("u1_timeline", _ENVELOPE + "SELECT kind, id, created_at FROM envelope WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-10' AND deleted_at IS NULL ORDER BY created_at DESC, id DESC LIMIT 300")
def merged_timeline(spark, sf):
    return tl.timeline(envelope(spark, sf), "2024-01-01", "2024-01-10", state="live", limit=300).select("kind", "id", "created_at")


@query("u2_author_timeline", _ENVELOPE + "SELECT kind, id, created_at, author_id FROM envelope WHERE author_id = 'a5' ORDER BY created_at DESC, id DESC LIMIT 500")
def author_timeline(spark, sf):
    return tl.timeline(envelope(spark, sf), authors=["a5"], limit=500).select("kind", "id", "created_at", "author_id")


@query("u3_deleted", _ENVELOPE + "SELECT kind, e.id, deleted_at, deleted_by, coalesce(a.agent_name, 'unknown') AS deleter FROM envelope e LEFT JOIN authors a ON a.id = e.deleted_by WHERE deleted_at >= TIMESTAMP '2024-02-01'")
def deleted_listing(spark, sf):
    return tl.deleted(envelope(spark, sf), authors(spark, sf), "2024-02-01")


@query("f1_normalised", r"""SELECT id, sha256(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '\r$', ''), '\s+$', '')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS h FROM knowledge""")
def normalised(spark, sf):
    return knowledge(spark, sf).select("id", F.sha2(tx.normalised(F.col("text")), 256).alias("h"))


@query("f2_content_hash", """SELECT id, sha256(text) AS content_hash, length(text) > 0 AND seq % 4 NOT IN (0, 1) AS accepted FROM knowledge""")
def content_hash(spark, sf):
    """Texts with other line ends and blank lines have the hash of the normalised text; some rows carry too many or too long tags."""
    s = F.col("seq")
    text = F.when(s % 3 == 0, F.concat("text", F.lit("  \r\n\n\n\n"))).when(s % 3 == 1, F.concat(F.lit("\n\n"), F.regexp_replace("text", "\n", " \t\r\n"))).otherwise(F.col("text"))
    many, long = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: i.cast("string")), F.array_append("tags", F.lit("x" * 65))
    k = knowledge(spark, sf).select("id", text.alias("text"), F.when(s % 4 == 0, many).when(s % 4 == 1, long).otherwise(F.col("tags")).alias("tags"))
    return k.select("id", tx.content_hash(F.col("text")).alias("content_hash"), tx.acceptable(F.col("text"), F.col("tags")).alias("accepted"))


@query("f3_fact_hash", """SELECT id, sha256(type || chr(0) || CASE type WHEN 'TaskFact' THEN '{"status":' || json_extract(payload, '$.status') || ',"task_id":' || json_extract(payload, '$.task_id') || '}' ELSE payload END) AS fact_hash FROM facts""")
def fact_hash(spark, sf):
    return facts(spark, sf).select("id", tx.fact_hash(F.col("type"), F.col("payload")).alias("fact_hash"))


@query("f5_token_estimate", r"SELECT id, CAST(2 + greatest(ceil(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / 3.0) + length(regexp_replace(text, '[\x00-\x7F]', '', 'g')), len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS tokens FROM knowledge")
def token_estimate(spark, sf):
    return knowledge(spark, sf).select("id", tx.token_estimate(F.col("text")).cast("bigint").alias("tokens"))


@query("f6_oversize_log", r"SELECT id, author_id, chars, estimate, 512 AS ceiling, 1530 AS max_chars, text FROM (SELECT id, author_id, text, CAST(length(text) AS BIGINT) AS chars, CAST(2 + greatest(ceil(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / 3.0) + length(regexp_replace(text, '[\x00-\x7F]', '', 'g')), len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS estimate FROM knowledge) WHERE estimate > 512")
def oversize_log(spark, sf):
    return tx.oversize(knowledge(spark, sf).select("id", "author_id", "text"))


_EXTENSIONS = ("md", "markdown", "mdx", "rs", "PY", "pyi", "sh", "bash", "zsh", "Toml", "txt", "xyz")
_LABELS = ("markdown", "markdown", "markdown", "rust", "python", "python", "shell", "shell", "shell", "toml", None, None)


@query("f7_language_label", f"SELECT page_id, [{', '.join('NULL' if x is None else repr(x) for x in _LABELS)}][page_id % 12 + 1] AS label FROM pages", model=False)
def language_label(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("page_id") % 12 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", tx.language_of(F.concat(F.lit("a.rs/b."), ext)).alias("label"))


@query("f10_token_cost", """SELECT id, CAST(ceil(length('{"id":"' || id || '","source":"' || source || '","repo":"' || repo || '"}') / 4.0) AS BIGINT) AS tokens FROM knowledge""")
def token_cost(spark, sf):
    return knowledge(spark, sf).select("id", tx.json_cost("id", "source", "repo").cast("bigint").alias("tokens"))


#: Payloads by type and the violations that each must be found to have, labelled by hand.
_PAYLOADS = (
    ("UserFact", '{"name":"n","email":"a@b.c","birthdate":"1990-02-03"}', ()),
    ("UserFact", "{}", (("payload.name", "required"),)),
    ("UserFact", '{"name":"","email":"bad"}', (("payload.name", "length"), ("payload.email", "email_shape"))),
    ("UserFact", '{"name":7,"birthdate":"soon"}', (("payload.name", "type"), ("payload.birthdate", "rfc3339"))),
    ("TaskFact", '{"task_id":"ansible-0123456789abcdef0123456789abcdef","status":"done"}', ()),
    ("TaskFact", '{"status":"nope"}', (("payload.task_id", "required"), ("payload.status", "enum"))),
    ("TaskFact", '{"task_id":"t1"}', (("payload.task_id", "shape"), ("payload.status", "required"))),
    ("EnvFact", '{"key":"lower","value":1}', (("payload.key", "shape"),)),
    ("EnvFact", '{"key":"OK_1","value":[1,2]}', ()),
    ("EnvFact", '{"key":"OK_1"}', (("payload.value", "required"),)),
    ("Service", '{"service":"s","host":"Bad_Host!","event":"up"}', (("payload.host", "hostname_shape"),)),
    ("Service", '{"service":"s","host":"h1","event":"sideways","port":70000}', (("payload.event", "enum"), ("payload.port", "numeric_range"))),
    ("Service", '{"service":"s","host":"h1.example","event":"up","port":80,"meta":{"created_at":"yesterday","deep":[{"ts":"1990-01-01T00:00:00Z","at":"2024-02-01T00:00:00Z"}]}}', (("payload.meta.created_at", "timestamp_range"), ("payload.meta.deep[0].ts", "timestamp_range"))),
    ("Execution", '{"task_id":"0f0e0d0c-0b0a-0908-0706-050403020100","tool":"t","phase":"started"}', ()),
    ("Execution", '{"tool":"","phase":5}', (("payload.task_id", "required"), ("payload.tool", "length"), ("payload.phase", "enum"))),
    ("Service", "[1]", (("payload", "type"),)),
    ("Odd", "{}", (("type", "unknown"),)),
)
_VIOLATIONS = f", labels AS (SELECT * FROM (VALUES {', '.join(f'({i}, {f!r}, {r!r})' for i, (_, _, bad) in enumerate(_PAYLOADS) for f, r in bad)}) t(i, field, rule)), broken AS (SELECT id, field, rule FROM ev JOIN labels ON i = seq % {len(_PAYLOADS)})\n"


def submissions(spark, sf):
    """One of the payloads for each event."""
    made = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(p).alias("payload")) for t, p, _ in _PAYLOADS])
    return events(spark, sf).select("id", F.get(made, (F.col("seq") % len(_PAYLOADS)).cast("int")).alias("p")).select("id", "p.type", "p.payload")


@query("f11_violations", _VIOLATIONS + "SELECT id, field, rule FROM broken")
def violations(spark, sf):
    return va.violations(submissions(spark, sf), AS_OF)


@query("f12_rejections", _VIOLATIONS + "SELECT rule, count(*) AS n FROM broken GROUP BY 1")
def rejections(spark, sf):
    return va.rejections_by_rule(va.violations(submissions(spark, sf), AS_OF))


@query("q3_approximate_census", "SELECT source, count(*) AS points, true AS close FROM knowledge GROUP BY 1")
def approximate_census(spark, sf):
    """Distinct contents by daily sketches, merged over all days; whether the estimate is within a tenth of the exact number."""
    k = knowledge(spark, sf)
    days = sk.daily(k.withColumn("size", F.length("text")), "created_at", "size", "content_hash", ["source"])
    found = sk.profile(sk.merged(days, ["source"]), ["source"]).select("source", F.col("n").alias("points"), "uniques")
    exact = k.groupBy("source", "content_hash").agg(F.lit(1).alias("one")).groupBy("source").agg(F.count("content_hash").alias("exact"))
    return found.join(exact, "source").select("source", "points", (F.abs(F.col("uniques") - F.col("exact")) <= F.col("exact") * 0.1).alias("close"))


@query("q3_duplicate_census", "SELECT count(*) AS points, count(DISTINCT content_hash) AS uniques, (SELECT count(*) FROM (SELECT content_hash FROM knowledge GROUP BY 1 HAVING count(*) > 1)) AS groups FROM knowledge")
def duplicate_census(spark, sf):
    g = knowledge(spark, sf).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("points"), F.count(F.lit(1)).alias("uniques"), F.count_if(F.col("n") > 1).alias("groups"))
