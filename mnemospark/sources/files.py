"""File-corpus scan, incremental manifest, repository of a path, and snapshot sinks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a corpus scan keeps and skips.
SKIP_FOLDERS = (
    "target", "node_modules", ".pnpm-store", ".git", "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox",
    ".gradle", ".idea", ".svelte-kit", ".next", ".nuxt", ".cache", ".terraform", ".obsidian", "dist", "build",
)
EXTENSIONS = (
    "rs", "toml", "c", "h", "cc", "cpp", "cxx", "hpp", "go", "zig", "py", "pyi", "js", "jsx", "mjs", "cjs", "ts", "tsx", "svelte", "vue",
    "html", "htm", "css", "scss", "sass", "sh", "bash", "zsh", "fish", "ps1", "rb", "lua", "pl",
    "md", "mdx", "markdown", "txt", "rst", "adoc", "asciidoc", "org", "tex",
    "yaml", "yml", "ini", "cfg", "conf", "env", "properties", "sql", "proto",
)
NAMES = ("dockerfile", "containerfile", "makefile", "gnumakefile", "justfile", "readme", "vagrantfile", "procfile")
LOCKFILES = (
    "cargo.lock", "pnpm-lock.yaml", "package-lock.json", "yarn.lock", "poetry.lock", "pipfile.lock", "uv.lock", "composer.lock",
    "gemfile.lock", "flake.lock", "bun.lockb", "deno.lock",
)


def indexable(path):
    """Whether a path is kept: no skipped folder, no lockfile, and a known extension or name, in any case of letters."""
    parts = F.split(path, "/")
    name = F.lower(F.element_at(parts, -1))
    known = F.regexp_extract(name, r"[^.].*\.([^.]+)$", 1).isin(*EXTENSIONS) | name.isin(*NAMES)
    return known & ~name.isin(*LOCKFILES) & ~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, SKIP_FOLDERS)))


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size, text) of the indexable files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.filter(indexable(F.col("path"))).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))


def manifest_diff(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """(path, action): skip on equal mtime, touch on equal hash, reindex, index, prune."""
    m = manifest.select("path", F.col("mtime").alias("m0"), F.col("content_hash").alias("h0"))
    s = scan.select("path", F.col("mtime").alias("m1"), F.col("content_hash").alias("h1"))
    action = F.when(F.col("m1").isNull(), "prune").when(F.col("m0").isNull(), "index").when(F.col("m0") == F.col("m1"), "skip").when(F.col("h0") == F.col("h1"), "touch").otherwise("reindex")
    return m.join(s, "path", "full_outer").select("path", action.alias("action"))


def repository_of(paths: DataFrame, git_dirs: DataFrame, root: str) -> DataFrame:
    """(path, repo): deepest ancestor that is a git folder, else first segment under the root, else the root's name."""
    rest = F.substring(F.col("path"), F.lit(len(root) + 2), F.length("path"))
    parts = F.split(rest, "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.lit(root + "/"), F.array_join(F.slice(parts, 1, n), "/")))
    each = paths.filter(F.size(parts) > 1).select("path", F.explode(ups).alias("dir"))
    found = each.join(git_dirs.select("dir"), "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("git"))
    fallback = F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(root.rsplit("/", 1)[-1])
    return paths.join(found, "path", "left").select("path", F.coalesce(F.element_at(F.split("git", "/"), -1), fallback).alias("repo"))


def split_by_dimension(rows: DataFrame, dim: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the vector's length; rows without a vector are rejected."""
    ok = F.coalesce(F.size(F.col(vector)) == dim, F.lit(False)) & F.col(vector).isNotNull()
    return rows.filter(ok), rows.filter(~ok)


def append(rows: DataFrame, path: str, batch: str | int) -> None:
    """Add rows to a table as one batch; the same batch written again replaces itself, so a retry adds nothing twice."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def append_by_day(rows: DataFrame, path: str, ts: str, batch: str | int) -> None:
    """Add log rows as one batch, one folder a day; the same batch written again replaces its own files, day by day."""
    marked = rows.withColumns({"day": F.to_date(ts), "batch": F.lit(str(batch))})
    marked.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def drop_days(spark: SparkSession, path: str, before: date) -> list[str]:
    """Delete the folders of days before ``before`` without reading a row; their names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    days = [f.getPath() for f in store.listStatus(at) if f.getPath().getName().startswith("day=")] if store.exists(at) else []
    old = [d for d in days if d.getName()[4:14] < before.isoformat()]
    for day in old:
        store.delete(day, True)
    return sorted(d.getName() for d in old)


def write_search_logs(sample: DataFrame, oversize: DataFrame, folder: str, ts: str, batch: str | int) -> None:
    """One search's logs: every query's sample row, a miss row for each with a ``miss``, and the refused writes, as three tables by day."""
    append_by_day(sample, f"{folder}/search_sample", ts, batch)
    append_by_day(sample.filter("miss is not null"), f"{folder}/search_miss", ts, batch)
    append_by_day(oversize, f"{folder}/oversize_write", ts, batch)


def retained(log: DataFrame, ts: str, as_of, days: int) -> DataFrame:
    """Log rows not older than ``days``."""
    return log.filter(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))
