"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced comparison.

Blocks of fingerprints stand as bit planes, one row of words a bit. A query is compared with 64 of them a word at once: what differs in a
plane is added to their distances, which are held as planes too, by carry-save adders, and what has passed the radius stays passed. A query
leaves a block, and a block's words leave, once all their distances have passed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.llm.common import field, stored, table
from groupwise.llm.components import components

WORDS = 4
BITS = 64
#: Differing bits up to which fingerprints link.
RADIUS = 4
#: Seed of the shingles' XXH64.
SEED = 42
#: Bytes of a text that are worked on at a time.
STRETCH = 1 << 20
#: Fingerprints that stand together, and the number that a bucket of evenly spread ones should hold.
BLOCK, BUCKET = 4096, 64
#: Words of a table of comparisons that are held at a time.
CELLS = 1 << 18


# ---- Fingerprints


def _stretches(data: bytes) -> Iterator[list[bytes]]:
    """The words of data by stretches that end between words."""
    at = 0
    while at < len(data):
        end = at + STRETCH
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None) -> int:
    """The SimHash of a text: a bit is set if it is set in over half of the hashes of its 4-word shingles, repeats included.

    Words are runs of other than spaces and the characters 9 to 13, A-Z in lower case. Fewer words than four are one shingle; no words, zero.
    """
    import xxhash

    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z alone change, and split() parts at those six characters
    counts, n, carried = np.zeros(BITS, np.int64), 0, []
    of = xxhash.xxh64_intdigest
    for words in _stretches(data):
        words = carried + words
        if len(words) >= WORDS:
            joined = b" ".join(words)
            ends = list(itertools.accumulate(len(w) + 1 for w in words))
            starts = [0, *ends[: len(words) - WORDS]]
            hashes = np.fromiter((of(joined[s : e - 1], SEED) for s, e in zip(starts, ends[WORDS - 1 :], strict=True)), np.uint64, len(starts))
            counts += _bit_counts(hashes)
            n += len(hashes)
            words = words[1 - WORDS :]
        carried = words
    if not n:
        return of(b" ".join(carried), SEED) if carried else 0
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist()))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, from the lowest."""
    out = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        out += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row, whole texts; fp is the fingerprint's 64 bits as a signed long."""
    schema = T.StructType([field(docs, id_col, "doc_id"), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = np.fromiter((fingerprint(t.as_py()) for t in part.column(1)), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


# ---- Bit-sliced comparison


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit j of word w of plane b is bit b of fingerprint 64 w + j. What pads the last word is 0."""
    words = -(-len(fps) // 64)
    bits = np.zeros((words * 64, BITS), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(planes: np.ndarray, n: int, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(query, standing) places of all pairs within the radius.

    Distances are counters of bit planes: `ones`, `twos`, `fours`, and `past` once four of the latter carry. Two planes and the ones make a sum
    and a carry, two carries and the twos the next, so four planes cost five adders. Every eight planes, queries all of whose distances have
    passed leave the table, and so do the words of the block that have passed for all queries.
    """
    if not radius <= 7:
        raise ValueError("counters hold distances up to 7")
    pad = np.zeros(planes.shape[1], np.uint64)
    if n % 64:
        pad[-1] = ~np.uint64((1 << (n % 64)) - 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, CELLS // max(planes.shape[1], 1))
    for first in range(0, len(queries), step):
        q, rows, columns, p = queries[first : first + step], np.arange(first, min(first + step, len(queries))), np.arange(planes.shape[1]), planes
        shape = (len(q), len(columns))
        ones, twos, fours, past = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64), np.zeros(shape, np.uint64), np.broadcast_to(pad, shape).copy()
        for plane in range(0, BITS, 4):
            # a query's bit, all over a word
            x = [p[b] ^ (np.uint64(0) - ((q >> np.uint64(b)) & np.uint64(1)))[:, None] for b in range(plane, plane + 4)]
            half = ones ^ x[0]
            carry_a = (ones & x[0]) | (half & x[1])
            ones = half ^ x[1]
            half = ones ^ x[2]
            carry_b = (ones & x[2]) | (half & x[3])
            ones = half ^ x[3]
            half = twos ^ carry_a
            carry = (twos & carry_a) | (half & carry_b)
            twos = half ^ carry_b
            past |= fours & carry
            fours ^= carry
            if plane % 8 == 4:
                gone = past | _over(ones, twos, fours, radius)
                open_ = gone != ~np.uint64(0)
                keep_rows, keep_columns = open_.any(axis=1), open_.any(axis=0)
                if not keep_rows.any():
                    rows = rows[:0]
                    break
                if keep_rows.sum() < 0.75 * len(rows) or keep_columns.sum() < 0.75 * len(columns):
                    at = np.ix_(keep_rows, keep_columns)
                    ones, twos, fours, past = ones[at], twos[at], fours[at], past[at]
                    q, rows, columns, p = q[keep_rows], rows[keep_rows], columns[keep_columns], p[:, keep_columns]
        if len(rows):
            near = np.ascontiguousarray(~(past | _over(ones, twos, fours, radius)))
            i, j = np.nonzero(np.unpackbits(near.astype("<u8").view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little"))
            found.append((rows[i], columns[j // 64] * 64 + j % 64))
    none = np.zeros(0, np.int64)
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (none, none)


def _over(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Where a counter of three bits is above the radius: at the highest bit in which they differ it has a one."""
    over, equal = np.zeros_like(ones), ~np.zeros_like(ones)
    for value, plane in ((4, fours), (2, twos), (1, ones)):
        if radius & value:
            equal &= plane
        else:
            over |= equal & plane
            equal &= ~plane
    return over


# ---- Links


def segments(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bits that two fingerprints must share to meet, one for each table.

    64 bits are cut into radius + k segments; within the radius, k of them agree, so a table for each choice of k loses no pair. k is the
    least for which n evenly spread fingerprints make buckets of BUCKET at most: 5, 15, 35 or 70 tables of keys of 12, 20, 26 or 32 bits or more.
    """
    for k in range(1, 5):
        parts = radius + k
        bounds = [BITS * i // parts for i in range(parts + 1)]
        masks = [sum(((1 << (bounds[i + 1] - bounds[i])) - 1) << bounds[i] for i in chosen) for chosen in itertools.combinations(range(parts), k)]
        if n <= BUCKET << min(m.bit_count() for m in masks):
            break
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) links from rows (table, key, part, visits, looks, fp) in that order: a bucket part's standing fingerprints come before its visitors.

    Links are those that join a part's components, at most one for each fingerprint in it, whatever the number of pairs.
    """
    current, standing, visitors, links = None, [], [], []

    def compared() -> None:
        """Links of what has come for the current part; visitors need not all be held at once."""
        nonlocal visitors
        if standing and visitors:
            links.extend(_joined(standing, visitors))
        visitors = []

    out = lambda: pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for t, key, part, visits, looks, fp in zip(*columns, strict=True):
            if (t, key, part) != current:
                compared()
                current, standing = (t, key, part), []
            if not visits:
                standing.append(fp)
            if looks:
                visitors.append(fp)
                if visits and len(visitors) >= BLOCK:
                    compared()
        if len(links) > 10_000:
            yield out()
            links.clear()
    compared()
    if links:
        yield out()


def _joined(standing: list[int], visitors: list[int]) -> list[tuple[int, int]]:
    """Links that make the components of visitors and what stands within the radius of them."""
    fps, asked = np.array(standing, np.int64).view(np.uint64), np.array(visitors, np.int64).view(np.uint64)
    i, j = within(planes_of(fps), len(fps), asked)
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = root[x]
        return x

    out = []
    for a, b in zip(asked[i].view(np.int64).tolist(), fps[j].view(np.int64).tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) between distinct fingerprints (fp, copies): all pairs within the radius are connected by them.

    Fingerprints meet in buckets of equal bits (see segments). A bucket's centre is its most frequent fingerprint; those within the
    radius of it are linked with it, so among themselves they need no comparison: only the others look up what stands in the bucket.
    Buckets of more than BLOCK are cut into parts, over tasks, and those that look visit all of them. Fingerprints alone in all
    their buckets are never compared.
    """
    masks = segments(distinct.count())
    keyed = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)))).alias("k")
    rows = distinct.select("fp", "copies", keyed).select("k.t", "k.key", "fp", "copies")
    buckets = rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.max_by("fp", F.struct("copies", "fp")).alias("centre")).where("n > 1")
    apart = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    placed = rows.drop("copies").join(buckets, ["t", "key"]).withColumn("near", apart("fp", "centre") <= RADIUS)
    placed = stored(placed.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), "simhash-buckets")
    centred = placed.where("near and fp <> centre").select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct()
    looks = ~F.col("near")
    single = F.col("parts") == 1
    # a bucket without others than its centre's has no one who looks
    stands = placed.select("t", "key", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("visits"), (single & looks).alias("looks"), "fp")
    visits = placed.where(~single & looks).select("t", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("visits"), F.lit(True).alias("looks"), "fp")
    order = ["t", "key", "part"]
    met = stands.unionByName(visits).repartition(*order).sortWithinPartitions(*order, "visits", "fp")
    return centred.unionByName(met.select(*order, "visits", "looks", "fp").mapInArrow(_linked, "a long, b long"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: 16 hex digits, and the least id among all texts that links reach.

    Fingerprints link at RADIUS or fewer differing bits; all pairs count, whatever the number of texts between them. Null and empty texts and those
    without words have the fingerprint zero, linked like any other. Texts are taken whole, whatever their length. Rows of one fingerprint are one node, so
    copies cost a row each and no pair. Repeated ids are rows of their own; null ids are kept and never the least unless a group
    has no other. An empty table gives an empty result. Only the two columns are read, so others may have any name.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "simhash")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "simhash-distinct")
    found = components(links(distinct.select("fp", "copies")))
    classes = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
