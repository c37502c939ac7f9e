"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A document fails at once by the base rules (too few words, or too many words in repeated five-word
windows). The other rules form a cascade: each rule's cost and rejection rate are estimated on a random sample of
about ``SAMPLE_ROWS`` documents, drawn before anything is measured, and the rules are asked in the order of rejections
per cost; a document that one rule rejects is not shown to the next, so its text is not scanned by the costly rules
behind. (The counts are part of the result, so every document pays for them; the cascade saves the scans of
``capitals``, ``shouting`` and ``letters``.) A cost is the shortest of some runs over the sample held in memory and
repeated, less that of a run that asks nothing; rules too cheap to tell apart count alike. The verdict does not
depend on the order, so the sample and its timings affect only the speed.

Defined results: null text has no words and fails; empty and blank texts likewise. Repeated rows get
equal results. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, shingle_hashes, words_of

SAMPLE_ROWS = 2000
#: Times the sample is repeated in a run, and runs of which the shortest counts.
REPEATS, RUNS = 4, 2
WINDOW = 5
BLANKS = " \t\n\x0b\x0c\r"
#: Rules by name: SQL conditions under which a document is rejected.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "capitals": "2 * length(regexp_replace(text, '[^A-Z]', '')) > length(regexp_replace(text, '[^A-Za-z]', ''))",
    "shouting": "4 * length(regexp_replace(text, '[^!]', '')) > n_words",
    "letters": "2 * length(regexp_replace(text, '[^\\\\p{L}]', '')) < word_chars",
}


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Words that lie in a k-word window which occurs twice or more."""

    def positions(s: Column) -> Column:
        twin = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: twin(x, i - 1) | twin(x, i + 1)), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(k)), F.lit(k))), F.lit(0), lambda a, n: a + n)

    def count(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.sort_array(placed), lambda s: let(positions(s), covered)))

    return F.when(F.size(words) <= k, 0).otherwise(let(shingle_hashes(words, k), count))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text and the counts that the rules use."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return docs.select(F.col(id_col), text.alias("text"), counted.alias("__c"), lines.alias("__l")).select(
        F.col(id_col),
        "text",
        F.col("__c.n").cast("bigint").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        F.col("__l.n").cast("bigint").alias("n_lines"),
        F.col("__l.d").cast("bigint").alias("n_dup_lines"),
        F.col("__c.r").cast("bigint").alias("n_repeat_words"),
    )


def cascade_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, str] = RULES, rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per cost on a sample, most first; ties by name."""
    total = docs.select(F.lit(1)).count()
    if not total:
        return list(rules)
    sample = measures(docs.sample(min(1.0, rows / total), seed=7), id_col, text_col).persist()
    try:
        size = max(1, sample.count())
        many = sample.withColumn("__run", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

        def asked(rule: str) -> tuple[float, int]:
            took, found = [], 0
            for _ in range(RUNS):
                began = time.monotonic()
                found = many.agg(F.count_if(F.expr(rule))).first()[0]
                took.append(time.monotonic() - began)
            return min(took), found

        idle = asked("length(text) < 0")[0]
        worth = {}
        for name, rule in rules.items():
            took, rejected = asked(rule)
            worth[name] = rejected / (size * REPEATS) / max(took - idle, idle / 4)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda n: (-worth[n], n))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, str] = RULES, order: list[str] | None = None) -> DataFrame:
    """The counts, base_failed, kept and rule (the one that rejected a document that passed the base).

    ``order`` of the rules, where it is known already; else it is estimated.
    """
    measured = measures(docs, id_col, text_col)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    verdict = F.when(F.col("base_failed"), F.lit(None).cast("string"))
    for name in order or cascade_order(docs.select(id_col, text_col), id_col, text_col, rules):
        verdict = verdict.when(F.expr(rules[name]), F.lit(name))
    out = measured.withColumn("base_failed", failed).withColumn("rule", verdict)
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop("text")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
