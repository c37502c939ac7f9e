"""The memory model over the given tables, as plain projections, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import decay_weight

AS_OF = "2024-03-01 00:00:00"
SOURCES = ("User", "Controller", "Task", "AgentProposal")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text memories, without their vectors."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("k"), d).alias("id"),
        d.alias("seq"),
        "text",
        F.sha2("text", 256).alias("content_hash"),
        F.when(d % 10 == 0, "AgentProposal").otherwise("Task").alias("source"),
        F.array("lang", F.concat(F.lit("t"), d % 7)).alias("tags"),
        F.col("source").alias("repo"),
        F.concat("source", F.lit("/"), d, F.lit(".md")).alias("file"),
        F.when(d % 10 != 0, F.concat(F.lit("host"), d % 3)).alias("machine"),
        F.col("lang").alias("language"),
        F.when(d % 20 == 0, "volatile").alias("volatility"),
        F.concat(F.lit("a"), d % 10).alias("author_id"),
        F.timestamp_add("DAY", (d % 60).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("created_at"),
        F.when(d % 37 == 0, F.lit("2024-02-15").cast("timestamp")).alias("deleted_at"),
        F.when(d % 37 == 0, F.concat(F.lit("a"), d % 3)).alias("deleted_by"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, embedding) of the memories that have a vector."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), "embedding")


def with_vectors(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with their optional embedding; choose their columns first, the join moves them."""
    return rows.join(vectors(spark, sf_dir), "seq", "left")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), "event_id").alias("id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("t"), "user_id").alias("task_id"),
        F.col("event_type").alias("category"),
        F.concat(F.lit('{"k":'), k, F.lit(',"host":"h'), k % 8, F.lit('","service":"s'), k % 5, F.lit('"}')).alias("payload"),
        F.concat(F.lit("h"), k % 8).alias("host"),
        F.concat(F.lit("s"), k % 5).alias("service"),
        k.alias("k"),
        "value",
        F.col("ts").alias("created_at"),
        F.concat(F.lit("a"), F.col("user_id") % 10).alias("author_id"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("planned")
    task = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), o).alias("id"),
        F.lit("TaskFact").alias("type"),
        F.concat(F.lit('{"task_id":"t'), "o_custkey", F.lit('","status":"'), status, F.lit('"}')).alias("payload"),
        F.element_at(F.array(*map(F.lit, SOURCES)), (o % 4 + 1).cast("int")).alias("source"),
        (o % 7).cast("int").alias("use_count"),
        F.col("o_orderdate").alias("created_at"),
        F.when(o % 3 == 0, F.timestamp_add("DAY", F.lit(10), F.col("o_orderdate"))).alias("last_used_at"),
        F.concat(F.lit("a"), F.col("o_custkey") % 10).alias("author_id"),
        F.when(o % 11 == 0, F.lit("2024-02-01").cast("timestamp")).alias("deleted_at"),
        F.when(o % 11 == 0, F.concat(F.lit("a"), o % 10)).alias("deleted_by"),
    )
    user = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("id"),
        F.lit("UserFact").alias("type"),
        F.concat(F.lit('{"name":"'), "c_name", F.lit('","segment":"'), "c_mktsegment", F.lit('"}')).alias("payload"),
        F.lit("User").alias("source"),
        F.lit(0).alias("use_count"),
        F.lit("2023-01-01").cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_used_at"),
        F.concat(F.lit("a"), F.col("c_custkey") % 10).alias("author_id"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
        F.lit(None).cast("string").alias("deleted_by"),
    )
    both = task.unionByName(user).withColumn("payload_hash", F.sha2(F.concat_ws(":", "type", "payload"), 256)).withColumn("version", F.lit(1))
    return both.withColumns({"confidence": (F.substring("id", 2, 20).cast("bigint") % 5 + 6) / 10, "decay_weight": decay_weight(as_of())})


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten authors seen in the events, and the two seeded ones, which were never seen."""
    n = F.col("user_id") % 10
    seen = table(spark, sf_dir, "events").groupBy(n.alias("n")).agg(F.max("ts").alias("last_seen_at"))
    seen = seen.select(F.concat(F.lit("a"), "n").alias("id"), F.concat(F.lit("agent-"), F.col("n") % 4).alias("agent_name"), "last_seen_at")
    seeded = spark.range(2).select(F.element_at(F.array(F.lit("system"), F.lit("lost-author")), (F.col("id") + 1).cast("int")).alias("name"))
    return seen.unionByName(seeded.select(F.col("name").alias("id"), F.col("name").alias("agent_name"), F.lit("2020-01-01").cast("timestamp").alias("last_seen_at")))


def dissents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").filter(o % 5 == 0).select(
        F.concat(F.lit("d"), o).alias("id"),
        F.concat(F.lit("o"), o).alias("fact_id"),
        F.concat(F.lit('{"task_id":"t'), "o_custkey", F.lit('","status":"blocked"}')).alias("payload"),
        F.lit("AgentProposal").alias("source"),
        F.when(o % 15 == 0, "promoted").when(o % 15 == 5, "discarded").otherwise("pending").alias("status"),
        F.timestamp_add("DAY", F.lit(1), F.col("o_orderdate")).alias("submitted_at"),
        F.lit(1).alias("submission_count"),
    )


MODEL = """
WITH RECURSIVE knowledge AS (
  SELECT 'k' || doc_id AS id, doc_id AS seq, text, sha256(text) AS content_hash,
    CASE WHEN doc_id % 10 = 0 THEN 'AgentProposal' ELSE 'Task' END AS source,
    [lang, 't' || doc_id % 7] AS tags, source AS repo, source || '/' || doc_id || '.md' AS file,
    CASE WHEN doc_id % 10 <> 0 THEN 'host' || doc_id % 3 END AS machine, lang AS language,
    CASE WHEN doc_id % 20 = 0 THEN 'volatile' END AS volatility, 'a' || doc_id % 10 AS author_id,
    CAST(embedding AS DOUBLE[]) AS embedding, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INT)) AS created_at,
    CASE WHEN doc_id % 37 = 0 THEN TIMESTAMP '2024-02-15' END AS deleted_at, CASE WHEN doc_id % 37 = 0 THEN 'a' || doc_id % 3 END AS deleted_by
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id
), ev0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ev AS (
  SELECT 'e' || event_id AS id, event_id AS seq, 't' || user_id AS task_id, event_type AS category,
    '{"k":' || k || ',"host":"h' || k % 8 || '","service":"s' || k % 5 || '"}' AS payload, 'h' || k % 8 AS host, 's' || k % 5 AS service,
    k, value, ts AS created_at, 'a' || user_id % 10 AS author_id
  FROM ev0
), facts0 AS (
  SELECT 'o' || o_orderkey AS id, 'TaskFact' AS type,
    '{"task_id":"t' || o_custkey || '","status":"' || CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'in_progress' ELSE 'planned' END || '"}' AS payload,
    ['User', 'Controller', 'Task', 'AgentProposal'][o_orderkey % 4 + 1] AS source, CAST(o_orderkey % 7 AS INT) AS use_count, o_orderdate AS created_at,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_days(10) END AS last_used_at, 'a' || o_custkey % 10 AS author_id,
    CASE WHEN o_orderkey % 11 = 0 THEN TIMESTAMP '2024-02-01' END AS deleted_at, CASE WHEN o_orderkey % 11 = 0 THEN 'a' || o_orderkey % 10 END AS deleted_by
  FROM orders
  UNION ALL
  SELECT 'c' || c_custkey, 'UserFact', '{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}', 'User', 0, TIMESTAMP '2023-01-01', NULL, 'a' || c_custkey % 10, NULL, NULL FROM customer
), facts AS (SELECT *, sha256(type || ':' || payload) AS payload_hash, 1 AS version, (CAST(substr(id, 2) AS BIGINT) % 5 + 6) / 10.0 AS confidence,
  round(1 / (1 + CASE type WHEN 'TaskFact' THEN 1e-6 ELSE 1e-9 END * greatest(CAST(epoch(TIMESTAMP '2024-03-01') - floor(epoch(coalesce(last_used_at, created_at))) AS BIGINT), 0)), 6) AS decay_weight FROM facts0),
authors AS (
  SELECT 'a' || user_id % 10 AS id, 'agent-' || user_id % 10 % 4 AS agent_name, max(ts) AS last_seen_at FROM events GROUP BY 1, 2
  UNION ALL SELECT x, x, TIMESTAMP '2020-01-01' FROM (SELECT unnest(['system', 'lost-author']) AS x)
), dissents AS (
  SELECT 'd' || o_orderkey AS id, 'o' || o_orderkey AS fact_id, '{"task_id":"t' || o_custkey || '","status":"blocked"}' AS payload, 'AgentProposal' AS source,
    CASE o_orderkey % 15 WHEN 0 THEN 'promoted' WHEN 5 THEN 'discarded' ELSE 'pending' END AS status, o_orderdate + to_days(1) AS submitted_at, 1 AS submission_count
  FROM orders WHERE o_orderkey % 5 = 0
), scored AS (
  SELECT q.vec_id AS query_id, k.*, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), k.embedding), 6) AS score
  FROM embeddings q, knowledge k WHERE q.vec_id % 20 = 0 AND k.embedding IS NOT NULL AND k.deleted_at IS NULL
)
"""
