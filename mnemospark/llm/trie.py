"""The prefix trie of conversations, by range-partitioned shards and a skeleton of splitter paths.

A conversation's path is the sequence of its turns' digests. Paths are cut into blocks of ``BLOCK`` turns, so that no row
grows with a conversation: a block is known by its number, a digest of all turns before it and the digests of its turns. A conversation
that ends where a block ends has an empty block behind it. Blocks are sorted by (block, conversation) and dealt to
shards at splitters, which are drawn from the blocks themselves. In this order the members of a node stand together,
so a node whose members lie in several shards is a prefix of a splitter. These prefixes form the skeleton, whose size
depends on the number of shards alone and which is broadcast with the splitters. A shard, read as a sorted stream, finishes all
its other nodes with a stack; of skeleton nodes it gives partial aggregates, which are then reduced.

Two such walks are needed. The first finds each node's members and smallest member, from which follows per conversation from which depth on it
is the smallest member of its nodes (it owns them), and whether it owns a leaf. The second adds these up: each node is owned by
one conversation, so sums over a subtree are sums over its members, without going down the tree: distinct words
below a node are the members' owned words, and all words below it are the members' words less what lies above.

Numbers of turns and digests of what comes before a block come from ``before``, which splits a conversation of very many turns.
The digests of ending conversations' ids are streamed in order; a skeleton node's ids come in pieces of up to 64 KB per row.

Defined results: rows without conv_id belong to no conversation and are left out. Turns are ordered by turn (null first), then role, then
text; a null role or text is an empty one. Repeated rows are turns of their own. An empty table has no conversation and no node, not even a
root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import before, broadcast_if_small, released, stage

#: Turns of a path that one row holds.
BLOCK = 32
#: Blocks in a shard, about.
SHARD_ROWS = 50_000
MOST_SHARDS = 2000
#: Blocks drawn for each splitter.
DRAWN = 8
PIECE = 1 << 16
HEAD = 20  # bytes of a key before the turns: block number and what comes before
TURN = 16  # bytes of a turn's digest

_WALKED = "kind string, conv_id bigint, depth int, parent bigint, above bigint, node bigint, up bigint, n bigint, ends bigint"
_NODES = "conv_id bigint, depth int, parent bigint, n bigint, children bigint, leaves bigint, saved bigint, ends_sha256 string, node bigint, shard int, piece int, ids binary, above bigint, words bigint, owned bigint, own_words bigint, own_owned bigint"


# -- turns and paths ---------------------------------------------------------------------------------------------


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, digest, words): each turn's place from 0, its digest and its number of words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), digest.alias("digest"), words.alias("words"), F.monotonically_increasing_id().alias("row"))
    return before(rows, "conv_id", ["turn", "role", "text", "row"], {"at": F.lit(1)}).select("conv_id", "at", "digest", "words")


def paths(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, key, words, above): the blocks of each conversation of ``convs``, with its turns' words and all words before the block.

    ``turns``: conv_id, depth (from 1, gapless), digest, words. ``above`` leaves out the turn that the block's first node stands for; ``first_words`` has it.
    """
    own = turns.select("conv_id", F.floor((F.col("depth") - 1) / block).cast("int").alias("block"), F.struct("depth", "digest", "words").alias("t"), F.lit(0).cast("bigint").alias("first_words"))
    ends = turns.filter(F.col("depth") % block == 0).select("conv_id", (F.col("depth") / block).cast("int").alias("block"), F.lit(None).cast(own.schema["t"].dataType).alias("t"), F.col("words").alias("first_words"))
    empty = convs.join(turns.filter("depth = 1").select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(0).alias("block"), F.lit(None).cast(own.schema["t"].dataType).alias("t"), F.lit(0).cast("bigint").alias("first_words"))
    hashed = lambda seed: F.coalesce(F.bit_xor(F.when(F.col("t").isNotNull(), F.xxhash64(F.lit(seed), "t.depth", "t.digest"))), F.lit(0).cast("bigint"))
    blocks = own.unionByName(ends).unionByName(empty).groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("t"), F.sum("first_words").alias("first_words"), F.coalesce(F.sum("t.words"), F.lit(0)).alias("held"), hashed(1).alias("x"), hashed(2).alias("y"))
    rows = before(blocks, "conv_id", ["block"], {"above": F.col("held")}, {"p": F.col("x"), "q": F.col("y")})
    padded = lambda c, n: F.lpad(F.hex(c), n, "0")
    key = F.unhex(F.concat(padded(F.col("block").cast("bigint"), 8), padded(F.col("p"), 16), padded(F.col("q"), 16), F.array_join(F.transform("t", lambda t: t["digest"]), "")))
    return rows.select("conv_id", key.alias("key"), F.transform("t", lambda t: t["words"]).alias("words"), (F.col("above") - F.col("first_words")).alias("above"), "first_words", "held")


# -- splitters and the skeleton ----------------------------------------------------------------------------------


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two blocks' paths share; -1 if they don't start from the same node."""
    if a[:HEAD] != b[:HEAD]:
        return -1
    at, most = HEAD, min(len(a), len(b))
    while at < most and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return (at - HEAD) // TURN


class Skeleton:
    """The trie of the splitters' paths: ``first[s][i]`` is the first splitter with the same i turns as splitter s, and numbers that node."""

    def __init__(self, splitters: list[tuple[bytes, int]], block: int):
        self.splitters, self.block, self.first = splitters, block, []
        for s, (key, _) in enumerate(splitters):
            shared = common_turns(key, splitters[s - 1][0]) if s else -1
            self.first.append([self.first[s - 1][i] if i <= shared else s for i in range((len(key) - HEAD) // TURN + 1)])

    def shard(self, key: bytes, conv: int) -> int:
        return bisect_right(self.splitters, (key, conv))

    def number(self, splitter: int, i: int) -> int:
        return self.first[splitter][i] * (self.block + 1) + i

    def spine(self, shard: int, key: bytes) -> list[int]:
        """Numbers of the nodes of this path that may have members in other shards: a prefix of it."""
        best, by = -1, 0
        for s in (shard - 1, shard):  # the shard's first splitter and the next shard's
            if 0 <= s < len(self.splitters) and (shared := common_turns(key, self.splitters[s][0])) > best:
                best, by = shared, s
        return [self.number(by, i) for i in range(best + 1)]

    def children(self) -> dict[int, int]:
        """Number of skeleton nodes right below each skeleton node, inside their block."""
        found = {(self.number(s, i), self.number(s, i - 1)) for s, row in enumerate(self.first) for i in range(1, len(row))}
        below: dict[int, int] = {}
        for _, up in found:
            below[up] = below.get(up, 0) + 1
        return below

    def links(self) -> list[tuple[int, int]]:
        """(node, node above it) inside blocks."""
        return sorted({(self.number(s, i), self.number(s, i - 1)) for s, row in enumerate(self.first) for i in range(1, len(row))})


def splitters_of(rows: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Every ``DRAWN``-th of a bounded number of blocks drawn by hash, in order."""
    drawn = sorted((bytes(r["key"]), r["conv_id"]) for r in rows.select("key", "conv_id").orderBy(F.xxhash64("key", "conv_id"), "conv_id").limit(shards * DRAWN).collect())
    return [drawn[i * len(drawn) // shards] for i in range(1, shards)] if len(drawn) >= shards > 1 else []


# -- the walk ----------------------------------------------------------------------------------------------------


class Node:
    """An open node of a shard's stack."""

    __slots__ = ("above", "children", "ends", "held", "i", "ids", "least", "leaves", "n", "number", "owned", "pending", "piece", "seen", "words")

    def __init__(self, i: int, number: int | None, above: int, words: int):
        self.i, self.number, self.above, self.held = i, number, above, words
        self.n = self.ends = self.children = self.leaves = self.words = self.owned = self.piece = 0
        self.least: tuple = ()
        self.pending: list[tuple[int, int]] = []
        self.seen = hashlib.sha256() if number is None else None
        self.ids: list[str] = []

    def add(self, n: int, least: tuple, words: int, owned: int, leaves: int) -> None:
        self.n += n
        self.words += words
        self.owned += owned
        self.leaves += leaves
        if not self.least or least < self.least:
            self.least = least


def _walk(rows: Iterator[dict[str, Any]], skeleton: Skeleton) -> Iterator[tuple[int, int, Node, Node | None]]:
    """(shard, block number, node, node above) for each node of the sorted rows, as it closes; the node above is still open.

    Of a node's ending members, ``ends`` counts all and ``seen`` digests the ids; a skeleton node's ids are left in ``ids`` and are
    handed on when ``PIECE`` is reached, with ``n`` at 0 (``Node.piece`` counts these pieces).
    """
    stack: list[Node] = []
    last, shard, number = b"", -1, 0

    def close(depth: int) -> Iterator[tuple[int, int, Node, Node | None]]:
        while len(stack) > depth:
            node = stack.pop()
            up = stack[-1] if stack else None
            yield shard, number, node, up
            if up is not None:
                up.add(node.n, node.least, node.words, node.owned, node.leaves)
                up.children += node.number is None

    for r in rows:
        key = bytes(r["key"])
        shared = common_turns(key, last) if r["shard"] == shard else -1
        yield from close(shared + 1)
        last, shard, number = key, r["shard"], int.from_bytes(key[:4], "big")
        spine, words, above = skeleton.spine(shard, key), r["words"], r["above"]
        for i in range(len(stack), len(words) + 1):
            own = words[i - 1] if i else r["first_words"]
            stack.append(Node(i, spine[i] if i < len(spine) else None, stack[-1].above + stack[-1].held if stack else above, own))
        top = stack[-1]
        least = (r["conv_id"], *r["own"])
        top.add(1, least, r["own_words"], r["owned"], r["leaf"])
        if top.i < skeleton.block:
            top.ends += 1
            if top.seen is not None:
                top.seen.update(f",{r['conv_id']}".encode() if top.ends > 1 else str(r["conv_id"]).encode())
            else:
                top.ids.append(str(r["conv_id"]))
                if 12 * len(top.ids) >= PIECE:
                    part = Node(top.i, top.number, top.above, top.held)
                    part.ids, part.piece, top.ids, top.piece = top.ids, top.piece, [], top.piece + 1
                    yield shard, number, part, None
    yield from close(0)


def _batches(found: Iterator[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in found:
        held.append(row)
        if len(held) >= most:
            yield told()
            held = []
    if held:
        yield told()


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions("shard", "key", "conv_id")


def _owners(rows: DataFrame, skeleton: Skeleton, told) -> DataFrame:
    """(conv_id, own_depth, own_parent, own_above, leaf) of the conversations that own nodes.

    A conversation owns the nodes of its path from ``own_depth`` on; ``own_parent`` owns the node above, and
    ``own_above`` is the number of words before the first owned node. ``told`` is the broadcast skeleton.
    """
    schema = pa.schema([("kind", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int32()), ("parent", pa.int64()), ("above", pa.int64()), ("node", pa.int64()), ("up", pa.int64()), ("n", pa.int64()), ("ends", pa.int64())])
    block = skeleton.block

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        plain = {"own": (), "own_words": 0, "owned": 0, "leaf": 0}
        for _, number, node, up in _walk(chain.from_iterable((r | plain for r in b.to_pylist()) for b in batches), told.value):
            if not node.n:
                continue
            depth = number * block + node.i
            if node.number is not None:
                yield ("part", node.least[0], depth, None, node.above, node.number, None, node.n, node.ends)
                continue
            least = node.least[0]
            if node.i < block and node.ends == node.n:
                yield ("leaf", least, depth, None, 0, None, None, 0, 0)
            for child, above in node.pending:
                if child != least:
                    yield ("own", child, depth + 1, least, above, None, None, 0, 0)
            if up is None:
                if not depth:
                    yield ("own", least, 0, None, 0, None, None, 0, 0)
            elif up.number is None:
                up.pending.append((least, node.above))
            else:
                yield ("below", least, depth, None, node.above, None, up.number, 0, 0)

    walked = stage(_in_order(rows).mapInArrow(lambda batches: released(_batches(found(batches), schema)), _WALKED), "walked")
    spark = rows.sparkSession
    # at most (shards - 1) * (block + 1) nodes
    nodes = stage(walked.filter("kind = 'part'").groupBy("node").agg(F.min("conv_id").alias("least"), F.max("depth").alias("depth"), F.max("above").alias("above"), F.sum("n").alias("n"), F.sum("ends").alias("ends")), "skeleton")
    links = spark.createDataFrame(skeleton.links(), "node bigint, up bigint")
    above = nodes.select(F.col("node").alias("up"), F.col("least").alias("parent"))
    inner = nodes.join(F.broadcast(links), "node").select(F.col("least").alias("conv_id"), "depth", "above", "up")
    below = walked.filter("kind = 'below'").select("conv_id", "depth", "above", "up").unionByName(inner)
    owned = below.join(F.broadcast(above), "up").filter("conv_id <> parent").select("conv_id", "depth", "parent", "above")
    root = nodes.filter("depth = 0").select(F.col("least").alias("conv_id"), "depth", F.lit(None).cast("bigint").alias("parent"), F.lit(0).cast("bigint").alias("above"))
    every = walked.filter("kind = 'own'").select("conv_id", "depth", "parent", "above").unionByName(owned).unionByName(root)
    leaves = walked.filter("kind = 'leaf'").select("conv_id").unionByName(nodes.filter((F.col("ends") == F.col("n")) & (F.col("node") % (block + 1) < block)).select(F.col("least").alias("conv_id")))
    both = every.withColumn("leaf", F.lit(0)).unionByName(leaves.select("conv_id", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("bigint").alias("parent"), F.lit(None).cast("bigint").alias("above"), F.lit(1).alias("leaf")))
    return both.groupBy("conv_id").agg(F.max("depth").alias("own_depth"), F.max("parent").alias("own_parent"), F.max("above").alias("own_above"), F.max("leaf").alias("leaf"))


def _digest(parts: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the pieces of ids (node, shard, piece, ids), streamed in order; the pieces of a node are few."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        node, seen, empty = None, hashlib.sha256(), True
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if key != node:
                    if node is not None:
                        yield node, seen.hexdigest()
                    node, seen, empty = key, hashlib.sha256(), True
                if ids:
                    seen.update(ids if empty else b"," + ids)
                    empty = False
        if node is not None:
            yield node, seen.hexdigest()

    schema = pa.schema([("node", pa.int64()), ("ends_sha256", pa.string())])
    ordered = parts.select("node", "shard", "piece", "ids").repartition("node").sortWithinPartitions("node", "shard", "piece")
    return ordered.mapInArrow(lambda batches: _batches(found(batches), schema), "node bigint, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, shards: int | None = None, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, depth, digest, words) of the conversations ``convs`` (conv_id).

    conv_id is the node's smallest member. Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = convs.sparkSession
    rows = stage(paths(turns, convs, block), "paths")
    if shards is None:
        shards = min(MOST_SHARDS, max(1, rows.count() // SHARD_ROWS, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // 500)))
    skeleton = Skeleton(splitters_of(rows, shards), block)
    told = spark.sparkContext.broadcast(skeleton)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = told.value.shard
        for batch in batches:
            found = [shard(k, c) for k, c in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "shard"])

    sharded = stage(rows.mapInArrow(dealt, T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType())])), "sharded")
    totals = sharded.groupBy("conv_id").agg(F.sum("held").alias("own_words"))
    facts = totals.join(_owners(sharded.drop("held"), skeleton, told), "conv_id", "left").select("conv_id", "own_words", F.when(F.col("own_depth").isNull(), 0).otherwise(F.col("own_words") - F.col("own_above")).alias("owned"), "own_depth", "own_parent", F.coalesce("leaf", F.lit(0)).alias("leaf"))
    known = sharded.drop("held").join(stage(facts, "facts"), "conv_id")
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("parent", pa.int64()), ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends_sha256", pa.string()), ("node", pa.int64()), ("shard", pa.int32()), ("piece", pa.int32()), ("ids", pa.binary()), ("above", pa.int64()), ("words", pa.int64()), ("owned", pa.int64()), ("own_words", pa.int64()), ("own_owned", pa.int64())])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
        for batch in batches:
            for r in batch.to_pylist():
                own = -1 if r["own_depth"] is None else r["own_depth"]
                yield r | {"own": (own, -1 if r["own_parent"] is None else r["own_parent"], r["own_parent"] is None, r["own_words"], r["owned"])}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for shard, number, node, _ in _walk(rows_of(batches), told.value):
            if node.i == block:
                continue  # the next block's first node
            depth, number_of = number * block + node.i, node.number
            if not node.n:
                yield (None, depth, None, 0, 0, 0, 0, None, number_of, shard, node.piece, ",".join(node.ids).encode(), node.above, 0, 0, 0, 0)
                continue
            conv, own_depth, own_parent, orphan, own_words, own_owned = node.least
            parent = conv if depth != own_depth else None if orphan else own_parent
            if number_of is None:
                saved = node.words - node.n * node.above - (node.owned - own_owned + own_words - node.above)
                yield (conv, depth, parent, node.n, node.children, node.leaves, saved, node.seen.hexdigest(), None, None, None, None, 0, 0, 0, 0, 0)
            else:
                yield (conv, depth, parent, node.n, node.children, node.leaves, 0, None, number_of, shard, node.piece, ",".join(node.ids).encode(), node.above, node.words, node.owned, own_words, own_owned)

    walked = stage(_in_order(known).mapInArrow(lambda batches: released(_batches(found(batches), schema)), _NODES), "nodes")
    done = walked.filter("node is null").select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")
    parts = walked.filter("node is not null")
    below = spark.createDataFrame(sorted(skeleton.children().items()), "node bigint, more bigint")
    least = F.min(F.when(F.col("conv_id").isNotNull(), F.struct("conv_id", "parent", "own_words", "own_owned"))).alias("m")
    reduced = parts.groupBy("node").agg(least, F.max("depth").alias("depth"), F.max("above").alias("above"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "words", "owned")])
    saved = F.col("words") - F.col("n") * F.col("above") - (F.col("owned") - F.col("m.own_owned") + F.col("m.own_words") - F.col("above"))
    spine = reduced.join(F.broadcast(below), "node", "left").join(broadcast_if_small(_digest(parts), 96), "node").select("m.conv_id", "depth", F.col("m.parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.col("children") + F.coalesce("more", F.lit(0))).alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), "ends_sha256")
    return done.unionByName(spine).withColumn("depth", F.col("depth").cast("bigint"))


def rebuilt(conversations: DataFrame, heads: int = 4, family: int = 20) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): each conversation c starts with up to crc32(c) % ``heads`` turns of conversation c - c % ``family``, then its own from there."""
    turns = stage(turns_of(conversations), "turns")
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % family
    first = turns.filter((base == F.col("conv_id")) & (F.col("at") < heads)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("at", "digest", "words"))).alias("head"))
    convs = turns.select("conv_id").distinct()
    none = F.array().cast(first.schema["head"].dataType)
    headed = stage(convs.withColumn("base", base).join(first, "base", "left").select("conv_id", F.coalesce(F.slice("head", 1, taken), none).alias("head")), "heads")
    # only where the base has too few turns
    short = broadcast_if_small(headed.filter(F.size("head") < taken).select("conv_id", F.size("head").alias("m")), 16)
    own = turns.filter(F.col("at") >= taken).join(short, "conv_id", "left").select("conv_id", (F.col("at") - taken + F.coalesce("m", taken) + 1).cast("int").alias("depth"), "digest", "words")
    new = headed.select("conv_id", F.posexplode("head").alias("p", "t")).select("conv_id", (F.col("p") + 1).alias("depth"), "t.digest", "t.words")
    return stage(own.unionByName(new), "rebuilt"), headed.select("conv_id")


def op11_trie(spark, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations."""
    return trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
