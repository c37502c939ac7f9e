"""Personal data by weak supervision, in DataFrame functions only.

Fixed patterns find e-mail addresses, IP addresses, payment cards and phone numbers. Beyond these,
candidates are the tokens that could be secrets or identity numbers: long runs of letters, digits
and ``_ - + /``, and hyphenated or lettered numbers. Labelers vote 1 (private), 0 (abstain) or -1
(not private) on each candidate:

- regex: whole-token shapes (hexadecimal key, prefixed key, identity number, bank account);
- gazetteer: a word before the token that announces a secret, or a token made of prose letters only;
- context: assignment or quotes around the token, or plain words on both sides;
- mixture: digits and letters together, or one kind of character alone.

Expectation-maximisation over the counts of the vote patterns estimates each labeler's accuracy and
the share of private tokens. The patterns' posteriors are the soft labels of a naive Bayes
classifier on token features (length and distinct characters, which no labeler sees, and share of digits, case
and neighbours, of which labelers see coarser forms); it decides about every candidate, also about those on which
all labelers abstain. The model is fitted on the candidates of all documents; only pattern and feature counts, at
most a few thousand, reach the driver. Added spans have kind ``secret``.

Defined results: null and empty texts have no spans. Offsets count code points, ends are exclusive.
A candidate that overlaps a fixed span is dropped. Without candidates only the fixed patterns act.
Repeated rows get equal results; other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prefix_sums, unused

KINDS = ("email", "ip", "card", "phone", "secret")
# A match can start only where a run of its characters starts or the last match ended; saying so
# finds the same matches and keeps long runs without @ linear. Repeated groups are possessive: nothing
# follows them, and Java matches other repeated groups by recursion, which ends the JVM on long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Tokens of 16 or more key characters, identity numbers, and bank accounts.
CANDIDATE = r"(?<![A-Za-z0-9_+/-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[A-Za-z0-9_+/-]{16,}+)(?![A-Za-z0-9_+/-])"
#: Code points of context seen on each side of a candidate.
REACH = 24
ANNOUNCES = r"(?i)(?:token|secret|passw(?:or)?d|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|bearer|credential|ssn|iban|passport)\W*$"
LABELERS = ("shape", "announced", "prose", "assigned", "plain", "mixed", "single")
FEATURES = ("length", "digits", "case", "distinct", "before", "after")
ROUNDS = 50


def spans(text: Column, pattern: str, order: int, keep=None) -> Column:
    """Array of (start, kind, end, piece) of the pattern's matches that pass ``keep``."""

    def place(pieces: Column, gaps: Column) -> Column:
        before = prefix_sums(F.zip_with(F.slice(gaps, 1, F.size(pieces)), pieces, lambda g, p: F.length(g) + F.length(p)))
        made = F.zip_with(F.zip_with(before, gaps, lambda b, g: (b + F.length(g)).cast("int")), pieces, lambda s, p: F.struct(s.alias("start"), F.lit(order).alias("kind"), (s + F.length(p)).alias("end"), p.alias("piece")))
        made = F.slice(made, 1, F.size(pieces))
        return F.filter(made, lambda m: keep(m["piece"])) if keep else made

    none = F.array().cast("array<struct<start:int,kind:int,end:int,piece:string>>")
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda g: place(m, g))))
    return found


def _digits(piece: Column) -> Column:
    return F.regexp_replace(piece, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def part(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), part), F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> Column:
    """The fixed patterns' spans by start, then by kind."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,piece:string>>")
    card = lambda p: let(_digits(p), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
    every = F.concat(
        F.when(F.contains(text, F.lit("@")), spans(text, EMAIL, 0)).otherwise(none),
        spans(text, IP, 1, lambda p: p.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$")),
        spans(text, CARD, 2, card),
        F.when(F.contains(text, F.lit("+")), spans(text, PHONE, 3, lambda p: F.length(_digits(p)).between(10, 15))).otherwise(none),
    )
    return F.sort_array(every)


def candidates(text: Column) -> Column:
    """Candidate spans with their context, as structs start, kind, end, piece, before, after."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,piece:string,before:string,after:string>>")

    def context(m: Column) -> Column:
        first = F.greatest(m["start"] - REACH, F.lit(0))
        return F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), m["piece"].alias("piece"), F.substring(text, first + 1, m["start"] - first).alias("before"), F.substring(text, m["end"] + 1, F.lit(REACH)).alias("after"))

    return let(spans(text, CANDIDATE, 4), lambda found: F.when(F.size(found) == 0, none).otherwise(F.transform(found, context)))


def votes(c: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate struct."""
    piece, before, after = c["piece"], c["before"], c["after"]
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)
    return {
        "shape": vote(piece.rlike(r"^(?:[0-9a-f]{24,}|[0-9A-F]{24,}|(?:sk|pk|ghp|AKIA|xox[a-z])[A-Za-z0-9_-]{12,}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})$"), piece.rlike("^[a-z]+$")),
        "announced": vote(before.rlike(ANNOUNCES)),
        "prose": vote(F.lit(False), piece.rlike("^[A-Za-z]?[a-z]+$") | piece.rlike("^[A-Z]+$")),
        "assigned": vote(before.rlike("[=:]\\s*[\"']?$")),
        "plain": vote(F.lit(False), before.rlike(r"[A-Za-z,.]\s$") & after.rlike(r"^[,.]?\s[A-Za-z]")),
        "mixed": vote(piece.rlike("[0-9]") & piece.rlike("[A-Za-z]") & ~piece.rlike("[-/]")),
        "single": vote(F.lit(False), piece.rlike(r"^(.)\1+$") | piece.rlike("^[-_+/]+$") | piece.rlike("^[0-9_+/-]{16,}$")),
    }


def features(c: Column) -> dict[str, Column]:
    """Each feature's value on a candidate struct, a small integer."""
    piece = c["piece"]
    n = F.length(piece)
    digit_share = F.length(_digits(piece)) * 4 / n
    upper, lower = piece.rlike("[A-Z]"), piece.rlike("[a-z]")
    neighbour = lambda s: F.when(s == "", 0).when(s.rlike("[\"'`]"), 1).when(s.rlike(r"\s"), 2).when(s.rlike("[=:]"), 3).otherwise(4)
    return {
        "length": F.when(n < 20, 0).when(n < 28, 1).when(n < 36, 2).when(n < 48, 3).otherwise(4),
        "digits": F.ceil(digit_share).cast("int"),
        "case": F.when(upper & lower, 3).when(upper, 2).when(lower, 1).otherwise(0),
        "distinct": F.least(F.floor(F.size(F.array_distinct(F.split(piece, ""))) / 4).cast("int"), F.lit(5)),
        "before": neighbour(F.right(c["before"], F.lit(1))),
        "after": neighbour(F.left(c["after"], F.lit(1))),
    }


def _expectation_maximisation(patterns: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern under conditionally independent labelers."""
    width = len(LABELERS)
    patterns = dict(sorted(patterns.items()))  # sums must not depend on the order in which tasks end
    post = {p: 1 / (1 + math.exp(-1.5 * sum(p))) for p in patterns}  # start: the sum of the votes
    for _ in range(ROUNDS):
        total = [sum(patterns.values()) + 2.0] * 2
        total[1] = sum(n * post[p] for p, n in patterns.items()) + 1.0
        total[0] -= total[1]
        table = [[{v: 1.0 for v in (-1, 0, 1)} for _ in range(width)] for _ in range(2)]
        for p, n in patterns.items():
            for j, v in enumerate(p):
                table[1][j][v] += n * post[p]
                table[0][j][v] += n * (1 - post[p])
        for p in patterns:
            odds = math.log(total[1] / total[0])
            for j, v in enumerate(p):
                odds += math.log(table[1][j][v] / (total[1] + 2.0)) - math.log(table[0][j][v] / (total[0] + 2.0))
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def fit(docs: DataFrame, text_col: str = "text") -> dict | None:
    """The span classifier: a bias and the log odds of every feature's values; None without candidates."""
    each = docs.select(F.explode(candidates(F.col(text_col))).alias("c"))
    v, f = votes(F.col("c")), features(F.col("c"))
    flat = each.select(*[v[x].alias(x) for x in LABELERS], *[f[x].alias(f"f_{x}") for x in FEATURES])
    seen = flat.select(*LABELERS, F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"f_{x}").alias("x")) for i, x in enumerate(FEATURES)])).alias("fx"))
    counts = sorted(seen.groupBy(*LABELERS, "fx.f", "fx.x").agg(F.count(F.lit(1)).alias("n")).collect())
    patterns: dict[tuple[int, ...], int] = {}
    for r in counts:
        if r["f"] == 0:
            p = tuple(r[x] for x in LABELERS)
            patterns[p] = patterns.get(p, 0) + r["n"]
    if not patterns:
        return None
    post = _expectation_maximisation(patterns)
    size = sum(patterns.values())
    private = sum(n * post[p] for p, n in patterns.items())
    model = {"bias": math.log((private + 1) / (size - private + 1)), "odds": {}}
    for i, x in enumerate(FEATURES):
        yes, no = {}, {}
        for r in counts:
            if r["f"] == i:
                q = post[tuple(r[y] for y in LABELERS)]
                yes[r["x"]] = yes.get(r["x"], 0) + r["n"] * q
                no[r["x"]] = no.get(r["x"], 0) + r["n"] * (1 - q)
        values = len(yes)
        model["odds"][x] = {k: math.log((yes[k] + 0.5) / (private + 0.5 * values)) - math.log((no[k] + 0.5) / (size - private + 0.5 * values)) for k in yes}
    return model


def _accepted(c: Column, model: dict) -> Column:
    f = features(c)
    score = F.lit(model["bias"])
    for x, odds in model["odds"].items():
        case = F.lit(0.0)
        for value, w in sorted(odds.items()):
            case = F.when(f[x] == value, F.lit(w)).otherwise(case)
        score = score + case
    return score > 0


def find(docs: DataFrame, text_col: str = "text", model: dict | None = None, base_col: str = "base_spans", all_col: str = "all_spans") -> DataFrame:
    """``docs`` with the columns base_col and all_col: arrays of (start, kind, end), kind indexing KINDS.

    Input columns of these names give way.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"))

    def both(t: Column) -> Column:
        def add(base: Column) -> Column:
            kept = F.transform(base, bare)
            if model is None:
                return F.struct(kept.alias("base"), kept.alias("every"))
            free = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
            more = F.transform(F.filter(candidates(t), lambda c: free(c) & _accepted(c, model)), bare)
            return F.struct(kept.alias("base"), F.sort_array(F.concat(kept, more)).alias("every"))

        return let(base_spans(t), add)

    (both_col,) = unused(docs, "__pii")
    return docs.withColumn(both_col, let(text, both)).withColumns({base_col: F.col(f"{both_col}.base"), all_col: F.col(f"{both_col}.every")}).drop(both_col)


def listed(array: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, array: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    joined = F.aggregate(
        array,
        F.array().cast("array<struct<start:int,kind:int,end:int>>"),
        lambda out, s: let(F.get(out, F.size(out) - 1), lambda last: F.when((F.size(out) > 0) & (s["start"] < last["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))))).otherwise(F.concat(out, F.array(s)))),
    )

    def rebuilt(m: Column) -> Column:
        ends = lambda i: F.coalesce(F.get(m, i - 1)["end"], F.lit(0))
        pieces = F.transform(m, lambda s, i: F.concat(F.substring(text, ends(i) + 1, s["start"] - ends(i)), F.get(names, s["kind"])))
        rest = F.get(m, F.size(m) - 1)["end"]
        return F.concat(F.array_join(pieces, ""), F.substring(text, rest + 1, F.length(text)))

    return F.when(F.size(array) == 0, text).otherwise(let(joined, rebuilt))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, model=fit(docs)).select("doc_id", "base_spans", "all_spans")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(4)), F.sha2(listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), listed(F.col("all_spans")).alias("spans"))
