"""A trie of conversation prefixes, its subtrees summed up by time-forward processing.

Nodes are named by 128-bit running sums of what their turns hash to, so no text and no path is shuffled to find them. A node with many members
belongs to the top of the trie; the subtrees that hang there are dealt to shards. Each shard sorts its nodes by reverse level order (Spark's
external sort), takes them from the deepest up, and sends each node's totals to its parent through a priority queue that spills; what
the subtrees' roots send is summed up by parent, and the top is processed in the same way.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from groupwise.llm.common import field, stored, table

#: Conversations c of one c - c % FAMILY begin alike; the number of turns they share is below BEGIN.
FAMILY, BEGIN = 5, 9
#: Turns of a conversation that one window sums up; longer ones are cut, so that no conversation is one task's.
CHUNK = 1024
#: Messages that a queue holds in memory, and ids that one piece of a list holds.
HELD, IDS = 200_000, 50_000


# ---- Turns


def _digests(role: Column, text: Column) -> list[Column]:
    return [F.xxhash64(role, text).alias("g1"), F.xxhash64(F.lit(7), role, text).alias("g2")]


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv, at, g1, g2, bytes): each turn's place in its conversation, from 0, its 128-bit name and its text's bytes.

    The whole table is dealt by ranges of (conversation, turn, role, text) and sorted in each, so a conversation of any length spreads over tasks; the
    places follow from where a range and a conversation begin.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("conv"), F.col("turn").alias("turn"), filled("role").alias("role"), filled("text").alias("text"))
    order = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = dealt.select("conv", *_digests(F.col("role"), F.col("text")), F.octet_length("text").cast("long").alias("bytes"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    numbered = stored(numbered, "trie-turns")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("low"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    shifts = sizes.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    placed = numbered.join(F.broadcast(shifts), "part").withColumn("row", F.col("row") + F.col("shift"))
    first = placed.groupBy("conv").agg(F.min("row").alias("first"))
    return placed.join(first, "conv").select("conv", (F.col("row") - F.col("first")).alias("at"), "g1", "g2", "bytes")


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from its family's first: the CRC-32 of its decimal number, modulo BEGIN."""
    return F.crc32(conv.cast("string").cast("binary")) % BEGIN


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): (conv, length) and (conv, depth, g1, g2, bytes), depth from 1, of the rebuilt conversations.

    A family's first conversation lends its first turns, fewer than BEGIN, so what is lent is bounded whatever a conversation's length.
    """
    own = stored(ordered_turns(turns), "trie-ordered")
    lengths = own.groupBy("conv").agg(F.count("*").alias("own")).withColumn("h", shared_turns(F.col("conv"))).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    of_base = lengths.select(F.col("conv").alias("base"), F.col("own").alias("lent"))
    convs = lengths.join(of_base, "base", "left").withColumn("lent", F.least("h", F.coalesce("lent", F.lit(0))))
    convs = stored(convs.select("conv", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "trie-conversations")
    begins = own.where(F.col("at") < BEGIN - 1).withColumnRenamed("conv", "base")
    lent = convs.select("conv", "base", "lent").join(begins, "base").where("at < lent").select("conv", (F.col("at") + 1).alias("depth"), "g1", "g2", "bytes")
    rest = own.join(convs.select("conv", "h", "lent"), "conv").where("at >= h").select("conv", (F.col("lent") + F.col("at") - F.col("h") + 1).alias("depth"), "g1", "g2", "bytes")
    return convs.select("conv", "length"), lent.unionByName(rest)


# ---- Nodes


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, bytes, a, b, up_a, up_b): the name of each prefix, and that of the one before; the root's is (0, 0).

    Sums run over chunks of CHUNK turns, whose totals are summed up first.
    """
    low = F.lit(0xFFFFFFFF)
    mixed = turns.select("conv", "depth", "bytes", F.xxhash64("depth", "g1", "g2").alias("m"), F.xxhash64(F.lit(5), "depth", "g1", "g2").alias("k"), F.floor((F.col("depth") - 1) / CHUNK).alias("chunk"))
    words = mixed.select("conv", "depth", "bytes", "chunk", *(f(F.col(c)).alias(f"{c}{i}") for c in ("m", "k") for i, f in enumerate((lambda x: x.bitwiseAND(low), lambda x: F.shiftrightunsigned(x, 32)))))
    names = ["m0", "m1", "k0", "k1"]
    chunks = words.groupBy("conv", "chunk").agg(*(F.sum(c).alias(c) for c in names))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begins = chunks.select("conv", "chunk", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in names))
    running = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = words.join(begins, ["conv", "chunk"]).select("conv", "depth", "bytes", *names, *((F.col(f"{c}_before") + F.sum(c).over(running)).alias(f"{c}_sum") for c in names))
    name = lambda seed, depth, sums: F.xxhash64(F.lit(seed), depth, *sums)
    here, there = [F.col(f"{c}_sum") for c in names], [F.col(f"{c}_sum") - F.col(c) for c in names]
    up = lambda seed: F.when(F.col("depth") == 1, F.lit(0).cast("long")).otherwise(name(seed, F.col("depth") - 1, there))
    return summed.select("conv", "depth", "bytes", name(1, F.col("depth"), here).alias("a"), name(2, F.col("depth"), here).alias("b"), up(1).alias("up_a"), up(2).alias("up_b"))


def digests_of_ids(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): SHA-256 of each node's ids (a, b, conv), ascending, comma-joined.

    Ids are dealt by ranges and joined in pieces, so the ids of a node that ends a third of all conversations are sorted by many
    tasks; a digest itself takes bytes in order, so one task streams a node's pieces, held one at a time.
    """
    pieces_schema = "a long, b long, first long, ids string"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out and (out[-1][0], out[-1][1]) == (a, b) and len(out[-1][3]) < IDS:
                    out[-1][3].append(str(conv))
                else:
                    if len(out) > 2000 or sum(len(x[3]) for x in out[-2:]) >= IDS:
                        yield batch_of(out)
                        out = []
                    out.append([a, b, conv, [str(conv)]])
        if out:
            yield batch_of(out)

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        a, b, first, ids = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(first, pa.int64()), pa.array([",".join(x) for x in ids])], names=["a", "b", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha, out = None, None, []
        for batch in batches:
            for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != current:
                    if current is not None:
                        out.append((*current, sha.hexdigest()))
                    current, sha = (a, b), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if len(out) > 5000:
                yield rows_of(out)
                out = []
        if current is not None:
            out.append((*current, sha.hexdigest()))
        if out:
            yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        a, b, sha = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha)], names=["a", "b", "ends_sha256"])

    order = ["a", "b", "conv"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, pieces_schema)
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(hashed, "a long, b long, ends_sha256 string")


# ---- Time-forward processing


class SpillingQueue:
    """A priority queue of tuples that holds HELD of them at most in memory; the rest is in sorted runs in unnamed files of the task's own, which go with it."""

    def __init__(self, held: int | None = None):
        self.held = held or HELD
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []  # (head, number, reader)
        self.spilled = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            self.heap.sort()
            keep = self.held // 2
            self._spill(self.heap[keep:])
            self.heap = self.heap[:keep]  # sorted, so a heap

    def _spill(self, items: list[tuple]) -> None:
        file = tempfile.TemporaryFile()  # noqa: SIM115  open as long as its run is
        for at in range(0, len(items), 1000):
            pickle.dump(items[at : at + 1000], file, protocol=5)
        file.seek(0)
        self.spilled += 1
        self._next(self.spilled, self._read(file))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def _next(self, number: int, reader: Iterator[tuple]) -> None:
        head = next(reader, None)
        if head is not None:
            heapq.heappush(self.runs, (head, number, reader))

    def peek(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            head, number, reader = heapq.heappop(self.runs)
            self._next(number, reader)
            return head
        return heapq.heappop(self.heap)


_TOTALS = "a long, b long, n_children long, n_leaves long, saved long, ends boolean"


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of nodes (level, a, b, up_a, up_b, top, saved, children, leaves, below), deepest first and by name within a level.

    level is the depth with its sign turned. A node takes its children's messages from the queue, which come to its own (level, name) in order, adds
    what other shards have sent (children, leaves, below) and its own bytes saved, and sends the sum on unless it is a top of this shard.
    """
    queue = SpillingQueue()
    for batch in batches:
        out: list[tuple] = []
        for level, a, b, up_a, up_b, top, saved, children, leaves, below in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total = saved + below
            while (head := queue.peek()) is not None and head[:3] <= (level, a, b):
                _, _, _, own, more = queue.pop()
                children, leaves, total = children + 1, leaves + own, total + more
            leaves = leaves or 1
            out.append((a, b, children, leaves, total, top))
            if not top:
                queue.push((level + 1, up_a, up_b, leaves, total))
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.bool_())], names=["a", "b", "n_children", "n_leaves", "saved", "ends"])


def _processed(nodes: DataFrame, *shard: str) -> DataFrame:
    """Totals of each node; the nodes of a shard come to one task and are sorted there, level first."""
    columns = ["level", "a", "b", "up_a", "up_b", "top", "saved", "children", "leaves", "below"]
    dealt = nodes.repartition(*shard) if shard else nodes.repartition(1)
    return dealt.sortWithinPartitions("level", "a", "b").select(*columns).mapInArrow(_forward, _TOTALS)


def totals(nodes: DataFrame, paths: DataFrame, rows: int) -> DataFrame:
    """(a, b, n_children, n_leaves, saved) of each node, from nodes (a, b, depth, up_a, up_b, conv_id, n_convs, bytes) and paths (conv, a, b).

    The top holds the nodes of more than `most` members, the root of `rows` turns and conversations at least: most is the square root of rows, so no
    level of the top has more than that, nor has a subtree below it more members. What hangs there hangs in shards by its subtree's
    root. A node of one member begins a chain that ends in one leaf and saves nothing: its totals are known, the chain isn't
    processed, and only its first node sends a message.
    """
    most = max(2, math.isqrt(rows))
    zero = lambda c: F.lit(0).cast("long").alias(c)
    level, saved = (-F.col("depth")).alias("level"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")
    upper = nodes.where((F.col("n_convs") > most) | (F.col("depth") == 0))
    # fewer than a square root of all rows a level; each parent once
    parents = upper.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"))
    lower = nodes.where((F.col("n_convs") <= most) & (F.col("depth") > 0))
    roots = stored(lower.join(parents, ["up_a", "up_b"]).select("a", "b", "n_convs", "up_a", "up_b"), "trie-roots")
    shards = paths.join(roots.where("n_convs > 1").select("a", "b"), ["a", "b"]).select(F.col("conv").alias("conv_id"), F.col("a").alias("root_a"), F.col("b").alias("root_b"))
    several = lower.where("n_convs > 1").join(shards, "conv_id")
    # chains that hang on a node of several members, summed up before they are shuffled
    single = lower.where("n_convs = 1").select("a", "b", "up_a", "up_b")
    named = nodes.where("n_convs > 1 OR depth = 0").select(F.col("a").alias("up_a"), F.col("b").alias("up_b"))
    chains = stored(single.join(named, ["up_a", "up_b"]).groupBy("up_a", "up_b").agg(F.count("*").alias("chains")), "trie-chains").toDF("a", "b", "chains")
    hung = F.coalesce("chains", F.lit(0))
    of_shards = several.join(chains, ["a", "b"], "left").select(level, "a", "b", "up_a", "up_b", ((F.col("a") == F.col("root_a")) & (F.col("b") == F.col("root_b"))).alias("top"), saved, hung.alias("children"), hung.alias("leaves"), zero("below"), "root_a", "root_b")
    below = stored(_processed(of_shards, "root_a", "root_b"), "trie-shards")
    sent = below.where("ends").join(roots.select("a", "b", "up_a", "up_b"), ["a", "b"]).groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("shards"), F.sum("n_leaves").alias("shard_leaves"), F.sum("saved").alias("below"))
    met = upper.join(chains, ["a", "b"], "left").join(sent, ["a", "b"], "left")
    of_top = met.select(level, "a", "b", "up_a", "up_b", (F.col("depth") == 0).alias("top"), saved, (hung + F.coalesce("shards", F.lit(0))).alias("children"), (hung + F.coalesce("shard_leaves", F.lit(0))).alias("leaves"), F.coalesce("below", F.lit(0)).alias("below"))
    names = ["a", "b", "n_children", "n_leaves", "saved"]
    ends = lower.where("n_convs = 1").select("a", "b", "length", "depth").select("a", "b", (F.col("depth") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero("saved"))
    return _processed(of_top).select(*names).unionByName(below.select(*names)).unionByName(ends)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations, the textless root included.

    conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are rows (conv_id, turn, role, text) in order of turn, null turns first, ties by role and text; repeated rows are turns of their own; null
    roles and texts are empty. Conversation c is rebuilt from the first crc32(c) % 9 turns of c - c % 5 (none if that isn't there; % has the
    sign of c) and its own turns after as many. Rows without conv_id take no part. Texts are hashed and measured whole. A
    conversation, a first turn, or a group of copies may hold most rows: turns are ranked and summed up in pieces, members counted
    before they are shuffled. Prefixes are told apart by 128 bits. An empty table gives an empty result; other columns aren't read.
    """
    kind = field(turns, "conv_id").dataType
    convs, rebuilt_turns = rebuilt(turns)
    paths = stored(prefixes(rebuilt_turns), "trie-paths")
    counted = paths.groupBy("a", "b").agg(F.min("depth").alias("depth"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(zero.alias("a"), zero.alias("b"), zero.alias("depth"), zero.alias("up_a"), zero.alias("up_b"), "conv_id", "n_convs", zero.alias("bytes"))
    lengths = convs.select(F.col("conv").alias("conv_id"), "length")
    nodes = stored(counted.unionByName(root).join(lengths, "conv_id"), "trie-nodes")
    of_paths = paths.agg(F.count("*").alias("n")).first()["n"] + convs.count()
    found = totals(nodes, paths.select("conv", "a", "b"), of_paths)
    last = paths.join(convs, "conv").where("depth = length").select("a", "b", "conv").unionByName(convs.where("length = 0").select(zero.alias("a"), zero.alias("b"), "conv"))
    ends = digests_of_ids(last)
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.join(parents, ["up_a", "up_b"])
    whole = named.join(found, ["a", "b"]).join(ends, ["a", "b"], "left")
    none = hashlib.sha256(b"").hexdigest()
    parent = F.when(F.col("depth") > 0, F.col("parent_conv_id"))
    return whole.select(F.col("conv_id").cast(kind).alias("conv_id"), F.col("depth").cast("long").alias("depth"), parent.cast(kind).alias("parent_conv_id"), F.col("n_convs").cast("long").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of a conversation's decimal number, bit by bit.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: ascii(CAST(c AS VARCHAR)[i])::BIGINT)),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, unused: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""
OP13_SQL = f"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, count(*) AS n, c - c % {FAMILY} AS base FROM o GROUP BY c),
h AS (SELECT *, {_CRC_SQL} % {BEGIN} AS h FROM k),
m AS (SELECT h.c, h.base, h.h, least(h.h, coalesce(b.n, 0)) AS lent FROM h LEFT JOIN k b ON b.c = h.base),
r AS (SELECT m.c, i + 1 AS d, role, text FROM m JOIN o ON o.c = m.base AND i < lent UNION ALL SELECT m.c, lent + i - h + 1, role, text FROM m JOIN o ON o.c = m.c AND i >= h),
p AS (SELECT c, d, strlen(text) AS bytes, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY d)) AS path FROM r UNION ALL SELECT c, 0, 0, 'root' FROM m),
s AS (SELECT *, lag(path) OVER (PARTITION BY c ORDER BY d) AS up, lead(path) OVER (PARTITION BY c ORDER BY d) IS NULL AS last FROM p),
n AS (SELECT path, min(c) AS conv_id, max(d) AS depth, max(up) AS up, count(*) AS n_convs, max(bytes) AS bytes,
    sha256(coalesce(string_agg(CASE WHEN last THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM s GROUP BY path),
kids AS (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
t AS (SELECT n.*, q.conv_id AS parent_conv_id, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN n q ON n.up = q.path LEFT JOIN kids ON kids.up = n.path),
sums AS (SELECT p.path, count(CASE WHEN n_children = 0 THEN 1 END) AS n_leaves, CAST(sum((n_convs - 1) * t.bytes) AS BIGINT) AS saved_tokens FROM t JOIN p ON p.c = t.conv_id AND p.d <= t.depth GROUP BY p.path)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM t JOIN sums ON sums.path = t.path
"""
