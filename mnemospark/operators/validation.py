"""Payload rules as columns: every violation is reported, a payload may break several.

Rules are kept by row type in ``RULES``; ``register`` adds a type. A rule is (field, name, condition under which it is
broken) over the columns ``payload`` (JSON text) and ``v`` (the same as variant). Fields at any depth named like
timestamps or hosts, and numbers at any depth, are checked for every type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import shared_folder, stage, unstage

# Enumerations, shapes and bounds of the payload rules.
STATUSES = ("planned", "in_progress", "blocked", "done", "cancelled")
SERVICE_EVENTS = ("up", "down", "restart", "version_changed")
PHASES = ("started", "completed", "failed")
TASK_ID = r"^(ansible-[0-9a-fA-F]{32}|\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?)$"
ENV_KEY = "^[A-Z][A-Z0-9_]*$"
ENV_VALUE_BYTES = 16 * 1024
YEARS = 10
TIMESTAMP_NAMES, TIMESTAMP_ENDS = ("at", "time", "ts", "timestamp"), ("_at", "_time", "_ts")
HOST_NAMES = ("hostname", "host")
HOST = r"\A[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*\z"
RFC3339 = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})\z"

Rule = tuple[str, str, Column]


def _kind(name: str) -> Column:
    """Type of a top-level field's value; null where the field is missing."""
    return F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))


def _text(name: str) -> Column:
    return F.try_variant_get("v", f"$.{name}", "string")


def required(name: str) -> Rule:
    return name, "required", _kind(name).isNull()


def string(name: str, least: int, most: int) -> list[Rule]:
    """A string of ``least`` to ``most`` bytes, if present."""
    is_text = _kind(name) == "STRING"
    return [(name, "type", _kind(name).isNotNull() & ~is_text), (name, "length", is_text & ~F.octet_length(_text(name)).between(least, most))]


def one_of(name: str, values: tuple[str, ...]) -> list[Rule]:
    return [required(name), (name, "enum", _kind(name).isNotNull() & ~((_kind(name) == "STRING") & _text(name).isin(*values)))]


def task_id() -> list[Rule]:
    is_text, short = _kind("task_id") == "STRING", F.octet_length(_text("task_id")) <= 64
    return [required("task_id"), ("task_id", "type", _kind("task_id").isNotNull() & ~is_text), ("task_id", "length", is_text & ~short), ("task_id", "shape", is_text & short & ~_text("task_id").rlike(TASK_ID))]


def _user() -> list[Rule]:
    email, born = _kind("email") == "STRING", _kind("birthdate") == "STRING"
    day = F.try_to_timestamp(_text("birthdate"), F.lit("yyyy-MM-dd")).isNotNull() | (_text("birthdate").rlike(r"T.*(Z|[+-]\d\d:\d\d)$") & F.try_to_timestamp(_text("birthdate")).isNotNull())
    return [
        required("name"), *string("name", 1, 256),
        ("email", "type", _kind("email").isNotNull() & ~email), ("email", "email_shape", email & ~_text("email").rlike(r"(?s)^[^@]+@.*\..*$")),
        ("birthdate", "type", _kind("birthdate").isNotNull() & ~born), ("birthdate", "rfc3339", born & ~day),
    ]


def _env() -> list[Rule]:
    value = F.octet_length(F.to_json(F.try_variant_get("v", "$.value", "variant")))
    shape = ("key", "shape", (_kind("key") == "STRING") & ~_text("key").rlike(ENV_KEY))
    return [required("key"), *string("key", 1, 256), shape, required("value"), ("value", "size", value > ENV_VALUE_BYTES)]


def _service() -> list[Rule]:
    port = (_kind("port") == "BIGINT") & F.try_variant_get("v", "$.port", "bigint").between(1, 65535)
    return [required("service"), *string("service", 1, 128), required("host"), *string("host", 1, 64), *one_of("event", SERVICE_EVENTS), *string("version", 0, 64), ("port", "numeric_range", _kind("port").isNotNull() & ~port)]


def _execution() -> list[Rule]:
    return [*task_id(), required("tool"), *string("tool", 1, 128), *one_of("phase", PHASES), *string("detail", 0, 4096)]


RULES: dict[str, Callable[[], Iterable[Rule]]] = {"UserFact": _user, "TaskFact": lambda: [*task_id(), *one_of("status", STATUSES)], "EnvFact": _env, "Service": _service, "Execution": _execution}


def register(kind: str, rules: Callable[[], Iterable[Rule]]) -> None:
    """Add or replace a type's rules."""
    RULES[kind] = rules


def _kind_of(value: str) -> Column:
    return F.schema_of_variant(value)


def _holds_more(value: str) -> Column:
    return F.coalesce(_kind_of(value).startswith("OBJECT") | _kind_of(value).startswith("ARRAY"), F.lit(False))


def _broken_checks(as_of: str) -> Column:
    """Names of the checks that a field (key, value) at any depth breaks."""
    text = F.when(_kind_of("value") == "STRING", F.try_variant_get("value", "$", "string"))
    number = F.when(_kind_of("value").isin("DOUBLE", "FLOAT"), F.try_variant_get("value", "$", "double"))
    host, time = F.col("key").isin(*HOST_NAMES), F.col("key").isin(*TIMESTAMP_NAMES)
    for end in TIMESTAMP_ENDS:
        time = time | F.endswith("key", F.lit(end))
    at = F.when(text.rlike(RFC3339), F.try_to_timestamp(F.upper(text)))
    near = F.abs(F.unix_seconds(at) - F.unix_seconds(F.lit(f"{as_of}+00:00").cast("timestamp"))) <= YEARS * 365 * 86400
    checks = (
        ("hostname_shape", host & ~F.coalesce(text.rlike(HOST), F.lit(False))),
        ("timestamp_range", time & text.isNotNull() & ~F.coalesce(near, F.lit(False))),
        ("numeric_range", F.isnan(number) | F.abs(number).isin(float("inf"))),
    )
    return F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in checks]))


def nested(rows: DataFrame, as_of: str) -> DataFrame:
    """(id, field, rule) of the checks that fields at any depth of rows (id, v, a variant) break.

    Payloads are opened level by level: objects and arrays inside others are staged and opened next, until none is left,
    so there is one job for each level of the deepest payload and no row is parsed in Python. What the levels below the
    first find is appended to one table, so that the plan does not grow with the depth.
    """
    spark = rows.sparkSession
    level, found, deeper = rows.filter(_holds_more("v")).select("id", F.lit("payload").alias("path"), "v"), None, None
    while True:
        opened = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        fields = opened.select("id", F.concat("path", step).alias("field"), "key", "value")
        broken = fields.select("id", "field", F.explode(_broken_checks(as_of)).alias("rule"))
        if found is None:
            found = broken
        else:
            deeper = deeper or f"{shared_folder(spark)}/deeper"
            broken.write.mode("append").parquet(deeper)
        done, level = level, stage(fields.filter(_holds_more("value")).select("id", F.col("field").alias("path"), F.col("value").alias("v")), "level")
        if deeper:  # the first level is no snapshot
            unstage(done)
        if level.isEmpty():
            unstage(level)
            return found.unionByName(spark.read.schema(found.schema).parquet(deeper)) if deeper else found


def violations(rows: DataFrame, as_of: str | None = None) -> DataFrame:
    """(id, field, rule) of every broken rule of rows (id, type, payload).

    A payload that is no JSON object breaks ``payload`` ``type``; an unknown type ``type`` ``unknown``. Times are
    compared with ``as_of`` (UTC, by default today). ``rows`` are read three times, so stage them where they cost much or
    where ids are drawn as they are read.
    """
    rows = rows.select("id", "type", "payload", F.try_parse_json("payload").alias("v"))
    broken = []
    for kind, rules in RULES.items():
        for field, name, bad in rules():
            entry = F.struct(F.lit(f"payload.{field}").alias("field"), F.lit(name).alias("rule"))
            broken.append(F.when((F.col("type") == kind) & F.col("object") & F.coalesce(bad, F.lit(False)), entry))
    broken.append(F.when(~F.col("object"), F.struct(F.lit("payload").alias("field"), F.lit("type").alias("rule"))))
    broken.append(F.when(~F.col("type").isin(*RULES), F.struct(F.lit("type").alias("field"), F.lit("unknown").alias("rule"))))
    shaped = rows.withColumn("object", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    top = shaped.select("id", F.explode(F.array_compact(F.array(*broken))).alias("b")).select("id", "b.field", "b.rule")
    return top.unionByName(nested(shaped.select("id", "v"), as_of or f"{date.today()} 00:00:00"))


def rejections_by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
