"""The corpus pipeline: language, near duplicates, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the
last return the columns of ``docs`` unchanged in name and order; ``n_chars`` follows the text.

Defined results: decisions are made on rows, by their texts, so null and repeated ids lose nothing: rows with
different texts all stay whatever their ids, and of rows with near-equal texts (5-word shingles, 0.8) the one with the
smallest id stays (null ids last, one row where the smallest is repeated). A text without a letter is dropped by
the first stage; without any labelled text nothing else is. Columns of any name are kept; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import decontam, hyperdim, neardup, packing, pii
from mnemospark.llm.common import broadcast_if_small, stage, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which no language is found: null text, or no letter."""
    train = docs.filter(~hyperdim.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lang") != "und"))
    protos = hyperdim.prototypes(train, "text", "lang")
    if not protos:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    pred, score = unused(docs, "lang_pred", "lang_score")
    return hyperdim.identify(docs, protos, pred_col=pred, score_col=score).filter(F.col(pred) != "und").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at five-word shingles and 0.8."""
    (row,) = unused(docs, "row")
    keyed = stage(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row").alias("row"))
    found = neardup.near_duplicates(keyed, id_col=row, k=5).select(F.col(row).alias("row"), "component_id")
    groups = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("component_id")
    members = stage(found.join(groups, "component_id").join(keyed.select(F.col(row).alias("row"), "doc_id"), "row").select("component_id", "row", "doc_id"), "members")
    first = members.groupBy("component_id").agg(F.min(order)["row"].alias("row"))
    gone = members.select("row").join(first.select("row"), "row", "left_anti").withColumnRenamed("row", row)
    return keyed.join(broadcast_if_small(gone, 8), row, "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; the texts decide, so equal texts share one verdict."""
    (key,) = unused(docs, "key")
    texts = docs.select(F.md5(F.col("text").cast("binary")).alias("doc_id"), "text")
    hits = decontam.contaminated(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias(key)).distinct()
    left = docs.withColumn(key, F.md5(F.col("text").cast("binary"))).join(broadcast_if_small(hits, 64), key, "left_anti")
    return left.select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each span of personal data by its kind in brackets."""
    base, every = unused(docs, "base_spans", "all_spans")
    found = pii.find(docs, model=pii.fit(docs), base_col=base, all_col=every).withColumn("text", pii.redacted(F.col("text"), F.col(every)))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: MinHash links, the fitted classifier and the tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
