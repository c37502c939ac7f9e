"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that participant as the
assistant and the others as named users; the mask marks what the assistant says. System messages
are context, not a participant, and are never masked. Messages follow by turn, then role, then text.

A row holds at most about ``part_chars`` characters: message i of a dialogue is in part
floor(characters before it / part_chars), where every message counts as a user's. So a dialogue shorter than that
is one row (part 0) for each participant, and the texts of a longer one's parts, joined in order, are the
whole rendering; no conversation of any length meets in one task. Mask spans count from the start of the row's text.

Text and roles are escaped so that no message can forge a turn: each ``<|`` gets a backslash between its
two characters, or one more where there are some (taking one away restores the text); in roles ``|>`` likewise.

Defined results: a null text is rendered as empty, a null role is the participant ``unknown``, null
conversations and turns are groups of their own and come first; rows tied in turn, role and text are equal, and
repeated rows are all rendered. A conversation without participants gives no rows, nor does an empty table. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, let, prefix_sums, stage

PART_CHARS = 1 << 20
CONTEXT_ROLE = "system"
CONTEXT, ASSISTANT, USER, NAMED, END = "<|system|>\n", "<|assistant|>\n", "<|user name=", "|>\n", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_name(role: Column) -> Column:
    return F.regexp_replace(escaped(role), r"\|(\\*)>", r"|\\$1>")


def head(speaker: Column, role: Column) -> Column:
    """What stands before a message's text as the speaker sees it."""
    return F.when(role == CONTEXT_ROLE, F.lit(CONTEXT)).when(role == speaker, F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER), escaped_name(role), F.lit(NAMED)))


def _parts(rows: DataFrame, part_chars: int) -> DataFrame:
    """``rows`` (c, t, role, text, n) with the number of their part.

    Characters before a message are summed in two levels: inside ranges of the sorted rows, however many
    a conversation or a turn has, and over the ranges' totals.
    """
    order = ["t", "role", "text"]
    ranged = rows.withColumn("salt", F.rand(7)).repartitionByRange("c", *order, "salt").withColumn("range", F.spark_partition_id())
    ranged = stage(ranged.drop("salt"), "ranges")
    totals = ranged.groupBy("c", "range").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col("c").alias("c2"), F.col("range").alias("r2"), before.alias("before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("c", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("inside", inside).join(broadcast_if_small(totals, 32), F.col("c").eqNullSafe(F.col("c2")) & (F.col("range") == F.col("r2")))
    return placed.select("c", *order, F.floor((F.col("before") + F.col("inside")) / part_chars).cast("int").alias("part"))


def perspectives(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """(conv, speaker, part, first_turn, n_messages, n_spoken, text, mask): mask spans count code points, ends exclusive."""
    rows = messages.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(role, F.lit("unknown")).alias("role"), escaped(F.coalesce(text, F.lit(""))).alias("text"))
    rows = rows.withColumn("n", F.length("text") + F.length(escaped_name(F.col("role"))) + len(USER + NAMED + END))
    # at most one conversation for every part_chars characters of the input
    long = broadcast_if_small(rows.groupBy(F.col("c").alias("c2")).agg(F.sum("n").alias("total")).filter(F.col("total") > part_chars).select("c2"), 16)
    is_long = F.col("c").eqNullSafe(F.col("c2"))
    short = rows.join(long, is_long, "left_anti").select("c", "t", "role", "text", F.lit(0).alias("part"))
    placed = short.unionByName(_parts(rows.join(long, is_long, "left_semi"), part_chars))
    dialogues = placed.groupBy("c", "part").agg(F.sort_array(F.collect_list(F.struct("t", "role", "text"))).alias("m"))
    people = rows.filter(F.col("role") != CONTEXT_ROLE).select(F.col("c").alias("c3"), F.col("role").alias("speaker")).distinct()
    seen = dialogues.join(people, F.col("c").eqNullSafe(F.col("c3")))

    def view(m: Column) -> Column:
        """Text and mask of a dialogue for the row's speaker."""
        heads = F.transform(m, lambda x: head(F.col("speaker"), x["role"]))

        def made(hs: Column) -> Column:
            before = prefix_sums(F.zip_with(hs, m, lambda h, x: F.length(h) + F.length(x["text"]) + len(END)))
            starts = F.zip_with(before, hs, lambda b, h: b + F.length(h))
            spans = F.zip_with(starts, m, lambda s, x: F.struct((x["role"] == F.col("speaker")).alias("own"), s.alias("start"), (s + F.length(x["text"])).alias("end")))
            whole = F.array_join(F.zip_with(hs, m, lambda h, x: F.concat(h, x["text"], F.lit(END))), "")
            return F.struct(whole.alias("text"), F.filter(spans, lambda s: s["own"]).alias("mask"))

        return let(heads, made)

    out = seen.withColumn("view", let(F.col("m"), view))
    return out.select(
        F.col("c").alias(conv),
        "speaker",
        "part",
        F.get("m", F.lit(0))["t"].alias("first_turn"),
        F.size("m").cast("bigint").alias("n_messages"),
        F.size("view.mask").cast("bigint").alias("n_spoken"),
        F.col("view.text").alias("text"),
        F.array_join(F.transform("view.mask", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("mask"),
    )


def op10_chat(spark, sf_dir: str) -> DataFrame:
    """Every conversation as each of its participants sees it."""
    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
