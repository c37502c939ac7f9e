"""Streams against their batch twins: small Arrow batches, shuffled, late and replayed input."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import lifecycle
from mnemospark.sources import files
from mnemospark.streaming import jobs, upserts

AT = datetime.datetime(2024, 1, 1)
ROWS = "host string, service string, active boolean, version string, at timestamp, seq long"


@pytest.fixture
def small_batches(spark):
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": "5", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    held = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in held.items():
        spark.conf.set(n, v)


def parts(spark, rows, schema, folder, n):
    """The rows as n files, read one a micro-batch."""
    for i in range(n):
        spark.createDataFrame(rows[i::n] if n > 1 else rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def emitted(stream, tmp_path):
    """All rows that the stream's runs have written so far."""
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination(240)
    return stream.sparkSession.read.schema(stream.schema).parquet(out).collect()


@pytest.mark.parametrize("files_", [1, 3])
def test_edges_in_order(spark, small_batches, tmp_path, files_):
    """One file has all rows shuffled; of three, each has a third of every minute's rows, so later files bring earlier rows."""
    rng = random.Random(files_)
    rows = [(f"h{rng.randrange(2)}", "s", rng.choice((True, False, None)), rng.choice((None, "1", "1", "2")), AT + datetime.timedelta(seconds=rng.randrange(500)), n) for n in range(150)]
    want = {tuple(r) for r in jobs.state_edges(spark.createDataFrame(rows, ROWS)).collect()}
    mixed = rows[:]
    rng.shuffle(mixed)
    end = [("z", "z", None, None, AT + datetime.timedelta(hours=5), 999)]  # moves the watermark past all rows
    emitted(jobs.stream_edges(parts(spark, mixed, ROWS, tmp_path / "in", files_)), tmp_path)
    got = emitted(jobs.stream_edges(parts(spark, end, ROWS, tmp_path / "in", 1)), tmp_path)
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == want


def test_ingest_judges_each_row(spark, tmp_path):
    good, bad = '{"event":"up","host":"h1","service":"s1"}', '{"event":"up","host":"h1"}'
    rows = [("1", good), ("2", bad), (None, bad), (None, good), ("3", good), ("3", bad), ("4", None)]
    schema = "id string, payload string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    q = jobs.ingest_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c")).start()
    q.awaitTermination(120)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.id, r.payload) for r in spark.read.parquet(str(tmp_path / "good")).collect()), key=key) == sorted([("1", good), (None, good), ("3", good)], key=key)
    assert sorted(((r.id, r.payload) for r in spark.read.parquet(str(tmp_path / "bad")).select("id", "payload").distinct().collect()), key=key) == sorted([("2", bad), (None, bad), ("3", bad), ("4", None)], key=key)


def test_daily_counts_are_kept(spark, tmp_path):
    """Files with late rows, then the last micro-batch once more: the table is the batch's."""
    rng = random.Random(3)
    rows = [(f"h{rng.randrange(3)}", rng.choice(("a", "b")), AT + datetime.timedelta(hours=rng.randrange(24 * 5))) for _ in range(300)]
    schema, path = "host string, category string, created_at timestamp", str(tmp_path / "days")
    stream = parts(spark, rows, schema, tmp_path / "in", 4)
    jobs.stream_daily_counts(stream, path, str(tmp_path / "c")).start().awaitTermination(240)
    df = spark.createDataFrame(rows, schema)
    want = {(r.day, r.host, r.category, r.total) for r in df.groupBy(F.to_date("created_at").alias("day"), "host", "category").agg(F.count(F.lit(1)).alias("total")).collect()}
    table = lambda: [(r.day, r.host, r.category, r.total) for r in spark.read.parquet(path).collect()]
    assert len(table()) == len(want) and set(table()) == want
    last = df.groupBy(F.to_date("created_at").alias("day"), "host", "category").agg(F.count(F.lit(1)).alias("total")).withColumn("invalidated", F.lit(False))
    stale = last.withColumn("total", F.lit(0).cast("bigint"))
    upserts.upsert_by_key(last, path, ["host", "category"], "day", 9)
    upserts.upsert_by_key(last, path, ["host", "category"], "day", 9)
    upserts.upsert_by_key(stale, path, ["host", "category"], "day", 1)  # an old batch changes nothing
    assert len(table()) == len(want) and set(table()) == want


def test_upserts_leave_other_days(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, day date, v long"
    day = lambda n: datetime.date(2024, 1, n)
    upserts.upsert_by_key(spark.createDataFrame([("a", day(1), 1), ("b", day(2), 1)], schema), path, ["k"], "day", 0)
    upserts.upsert_by_key(spark.createDataFrame([("b", day(2), 2), ("c", day(2), 2), (None, day(2), 3)], schema), path, ["k"], "day", 1)
    upserts.upsert_by_key(spark.createDataFrame([], schema), path, ["k"], "day", 2)
    assert {(r.k, r.day, r.v) for r in spark.read.parquet(path).collect()} == {("a", day(1), 1), ("b", day(2), 2), ("c", day(2), 2), (None, day(2), 3)}


def test_usage_is_counted_once_a_flush(spark, tmp_path):
    rng = random.Random(5)
    reads = [(f"f{rng.randrange(6)}", AT + datetime.timedelta(seconds=rng.randrange(600))) for _ in range(120)]
    end = [("end", AT + datetime.timedelta(hours=3))]
    schema, path = "id string, at timestamp", str(tmp_path / "uses")
    stream = parts(spark, reads, schema, tmp_path / "in", 3)
    jobs.stream_usage(stream, path, str(tmp_path / "c")).start().awaitTermination(240)
    spark.createDataFrame(end, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    jobs.stream_usage(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), path, str(tmp_path / "c")).start().awaitTermination(240)
    facts = spark.createDataFrame([(f"f{n}", n, None) for n in range(8)], "id string, use_count long, last_used_at timestamp")
    want = lifecycle.bump_usage(facts, jobs.flushes(spark.createDataFrame(reads, schema), 60))
    got = lambda: sorted(map(tuple, jobs.counted_uses(facts, spark.read.parquet(path)).collect()))
    assert got() == sorted(map(tuple, want.collect()))


def test_additions_of_a_batch_count_once(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id string, uses long, last timestamp"
    one, two = spark.createDataFrame([("a", 1, AT), ("b", 2, AT)], schema), spark.createDataFrame([("a", 5, AT)], schema)
    for batch, n in ((one, 0), (one, 0), (two, 1), (two, 1)):
        upserts.add_by_key(batch, path, "id", "uses", "last", n)
    assert {(r.id, r.uses) for r in spark.read.parquet(path).collect()} == {("a", 6), ("b", 2)}


def test_search_logs_by_day(spark, tmp_path):
    """Three tables, batches that replace themselves, pruned reads, and days dropped as folders."""
    sample = spark.createDataFrame([("q1", None, AT), ("q2", "zero_hit", AT + datetime.timedelta(days=1)), ("q3", "low_score", AT + datetime.timedelta(days=3))], "query_id string, miss string, created_at timestamp")
    refused = spark.createDataFrame([("k1", 9000, 3002, 512, 1530, "text", AT)], "id string, chars int, estimate int, ceiling int, max_chars int, text string, created_at timestamp")
    folder = str(tmp_path / "logs")
    for batch in (0, 1, 0):
        files.write_search_logs(sample, refused, folder, "created_at", batch)
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    assert (read("search_sample").count(), read("search_miss").count(), read("oversize_write").count()) == (6, 4, 2)
    assert files.drop_days(spark, f"{folder}/search_sample", datetime.date(2024, 1, 3)) == ["day=2024-01-01", "day=2024-01-02"]
    kept = read("search_sample")
    assert {r.query_id for r in kept.collect()} == {"q3"}
    plan = kept.filter("day = date'2024-01-04'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert files.drop_days(spark, f"{folder}/none", datetime.date(2024, 1, 3)) == []
