"""Payload checks at any depth against a walk in plain Python."""

import json
import math
import random
import re
from datetime import datetime

from mnemospark.operators import validation as va

AS_OF = "2024-03-01 00:00:00"
NOW = datetime.fromisoformat(AS_OF + "+00:00").timestamp()


def walk(value, path="payload"):
    """(field, rule) of every broken check, depth first."""
    for name, x in value.items() if isinstance(value, dict) else enumerate(value):
        here = f"{path}.{name}" if isinstance(value, dict) else f"{path}[{name}]"
        if name in ("host", "hostname"):
            labels = x.split(".") if isinstance(x, str) else [""]
            if not all(re.fullmatch("[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?", p) and len(p) < 64 for p in labels):
                yield here, "hostname_shape"
        if isinstance(name, str) and isinstance(x, str) and (name in ("at", "time", "ts", "timestamp") or name.endswith(("_at", "_time", "_ts"))):
            try:
                at = datetime.fromisoformat(x)
                if at.tzinfo is None or abs(at.timestamp() - NOW) > 10 * 365 * 86400:
                    yield here, "timestamp_range"
            except ValueError:
                yield here, "timestamp_range"
        if isinstance(x, float) and not math.isfinite(x):
            yield here, "numeric_range"
        if isinstance(x, (dict, list)):
            yield from walk(x, here)


def found(spark, payloads, kind="Odd"):
    rows = spark.createDataFrame([(f"i{n}", kind, p) for n, p in enumerate(payloads)], "id string, type string, payload string")
    return sorted((r.id, r.field, r.rule) for r in va.violations(rows, AS_OF).collect() if r.field not in ("type", "payload"))


def test_nested_checks_match_a_walk(spark):
    rng = random.Random(11)
    leaves = ("ok", "a.b-c", "-x", "x" * 64, "x" * 63, "a..b", "", "h\n", "2024-02-01T00:00:00Z", "2024-02-01t00:00:00+01:00", "2024-02-01", "1990-01-01T00:00:00Z", "2040-01-01T00:00:00.123456Z", 1, 2.5, None, True)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(leaves)
        if rng.random() < 0.4:
            return [made(depth - 1) for _ in range(rng.randrange(4))]
        return {k: made(depth - 1) for k in rng.sample(("host", "hostname", "at", "created_at", "ts", "x", "a b", "uptime_ts"), rng.randrange(5))}

    payloads = [{"n": made(5), "m": made(3)} for _ in range(80)] + [[made(3)] for _ in range(10)]
    want = sorted((f"i{n}", f, r) for n, p in enumerate(payloads) for f, r in walk(p))
    assert len(want) > 50 and found(spark, [json.dumps(p) for p in payloads]) == want


def test_deep_payloads_scalars_and_broken_text(spark):
    deep = '{"a":' * 12 + '{"host":"_"}' + "}" * 12
    got = found(spark, [deep, "5", None, "{", "{}", "[]", '{"n":[1e999]}'])
    assert got == [("i0", "payload" + ".a" * 12 + ".host", "hostname_shape"), ("i6", "payload.n[0]", "numeric_range")]
    assert found(spark, []) == []


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([("i", "Odd", '{"host":{"at":"x"}}')], "id string, type string, payload string")
    plan = va.violations(rows, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Generate variant_explode" in plan
