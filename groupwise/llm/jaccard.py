"""N-gram Jaccard self-join of documents by T-occurrence search with DivideSkip.

A partner of a set of n shingles must hold at least T = ceil(0.75 n) of them. All sets put their shingles into one order: by hash,
but those that more than a thousandth of all documents hold, whose inverted lists are long, last and the longest at the end. The
first n - T + 1 are enough to meet every partner, and for a pair of known sizes fewer are; only these lists are merged, by Spark's
sort (an external merge of sorted runs), long ones only where little else is left of a set. Whoever meets there is a candidate, unless sizes or a
bitmap of parities rule it out. The rest of the count comes from binary probes: each remaining shingle of the smaller set, long
lists' ones too, is looked up in the other's sorted set, in steps, until T is reached or out of reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.llm.common import field, stored, table
from groupwise.llm.components import components

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A shingle that about this share of all documents holds has a long list. It only orders shingles (all
#: orders give the same links) and bounds the table sent to tasks: at most 2 / LONG_SHARE lists a mean set's shingle.
LONG_SHARE = 0.001
#: Documents, and shingles, counted together at most when long lists are looked for.
COUNTED, COUNTED_SHINGLES = 4000, 2_000_000
#: Merged lists that two classes must share, where their sizes allow to ask for so many, before they are compared.
SHARED = 3
#: Words whose hash a worker remembers, and sets that a task remembers to have sent.
REMEMBERED = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()
_MULTIPLIER, _FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `words` words; fewer words make one shingle, none make none.

    A-Z become a-z; words are runs without space, tab, line feed, vertical tab, form feed or carriage return.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    take = min(words, len(h))
    out = np.full(len(h) - take + 1, take, np.uint64)
    for k in range(take):
        out = (out ^ h[k : len(h) - take + 1 + k]) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    out *= _FINAL
    out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def set_key(shingle_set: np.ndarray) -> int:
    """A 64-bit hash of the whole set; equal sets are one class."""
    import xxhash

    return xxhash.xxh3_64_intdigest(shingle_set.tobytes(), seed=len(shingle_set)) - (1 << 63)


def required(n: int, percent: int = PERCENT) -> int:
    """The least overlap with any partner of a set of n."""
    return -(-n * percent // 100)


def prefix(shingle_set: np.ndarray, long: np.ndarray, percent: int = PERCENT, rank: np.ndarray | None = None) -> np.ndarray:
    """The shingles whose lists are merged: the first n - T + 1 in an order that all sets share, those with long lists last, the longest (by rank) at the end."""
    n = len(shingle_set)
    if len(long):
        at = np.minimum(np.searchsorted(long, shingle_set), len(long) - 1)
        is_long = long[at] == shingle_set
        last = shingle_set[is_long]
        if rank is not None:
            last = last[np.argsort(rank[at[is_long]], kind="stable")]
        shingle_set = np.concatenate((shingle_set[~is_long], last))
    return shingle_set[: n - required(n, percent) + 1]


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets link: binary probes of the smaller one's shingles into the larger, given up once the overlap is out of reach."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    need = -(-percent * (len(a) + len(b)) // (100 + percent))  # 100 i >= p (|a| + |b| - i)
    found, step = 0, max(64, len(a) // 8)
    for at in range(0, len(a), step):
        part = a[at : at + step]
        where = np.minimum(np.searchsorted(b, part), len(b) - 1)
        found += int(np.count_nonzero(b[where] == part))
        if found >= need:
            return True
        if found + len(a) - at - len(part) < need:
            return False
    return found >= need


def parity_bits(shingle_set: np.ndarray) -> bytes:
    """For at least twice as many bins as shingles, whether each holds an odd number of them."""
    bins = max(64, 1 << (2 * len(shingle_set) - 1).bit_length()) if len(shingle_set) else 64
    return np.packbits(np.bincount(shingle_set & (bins - 1), minlength=bins) & 1, bitorder="little").tobytes()


def may_link(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes, percent: int = PERCENT) -> bool:
    """False only if the sets differ by more shingles than linked ones can: bins of unlike parity hold a shingle each that one set lacks."""
    a, b = np.frombuffer(bits_a, np.uint64), np.frombuffer(bits_b, np.uint64)
    while len(a) != len(b):  # bins are hashes' low bits, so halves fold
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    need = -(-percent * (n_a + n_b) // (100 + percent))
    return int(np.bitwise_count(a ^ b).sum()) <= n_a + n_b - 2 * need


def _batch(columns: list, schema: T.StructType, kinds: dict[str, pa.DataType] | None = None) -> pa.RecordBatch:
    kind = lambda f: (kinds or {}).get(f.name) or {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[f.dataType.simpleString()]
    return pa.RecordBatch.from_arrays([pa.array(c, kind(f)) for c, f in zip(columns, schema, strict=True)], names=schema.names)


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def _census(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, key, n, bits, *carry) for each document, and (shingle, holders) for those that many of a few thousand documents hold."""
    schema = T.StructType([field(docs, "doc_id"), *_longs("key", "n", "shingle", "holders"), T.StructField("bits", T.BinaryType()), *(field(docs, c) for c in carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        held = 0

        def common() -> Iterator[pa.RecordBatch]:
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= max(2, math.ceil(LONG_SHARE * len(sets)))
            values, counts = values[often], counts[often]
            none = [None] * len(values)
            yield _batch([none, none, none, values, counts, none, *(none for _ in carry)], schema, kinds)

        for batch in batches:
            kinds = {n: batch.schema.field(n).type for n in ("doc_id", *carry)}
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                own = [shingles(t) for t in part.column(1).to_pylist()]
                none = [None] * len(own)
                carried = (part.column(2 + i).to_pylist() for i in range(len(carry)))
                yield _batch([part.column(0).to_pylist(), [set_key(s) for s in own], [len(s) for s in own], none, none, [parity_bits(s) for s in own], *carried], schema, kinds)
                for one in own:
                    sets.append(one)
                    held += len(one)
                    if len(sets) >= COUNTED or held >= COUNTED_SHINGLES:
                        yield from common()
                        sets, held = [], 0
        if sets:
            yield from common()
        _HASHES.clear()  # workers live on

    return docs.select("doc_id", "text", *carry).mapInArrow(run, schema)


def _postings(docs: DataFrame, long: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(shingle, key, at): the short lists that are merged, with the shingle's place in its class's order; a task sends a class once."""
    schema = _longs("shingle", "key", "at")
    sent_long = docs.sparkSession.sparkContext.broadcast((long, rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out, keys, sizes = [np.zeros(0, np.int64)], [], []
                for text in batch.column(0).slice(at, 200).to_pylist():
                    own = shingles(text)
                    if len(own) and (key := set_key(own)) not in sent:
                        if len(sent) > REMEMBERED:
                            sent.clear()
                        sent.add(key)
                        out.append(prefix(own, sent_long.value[0], rank=sent_long.value[1]))
                        keys.append(key)
                        sizes.append(len(out[-1]))
                places = np.concatenate([np.arange(n) for n in sizes]) if sizes else np.zeros(0, np.int64)
                yield _batch([np.concatenate(out), np.repeat(np.array(keys, np.int64), np.array(sizes, np.int64)), places], schema)
        _HASHES.clear()

    return docs.select("text").mapInArrow(run, schema)


def _shared_lists(postings: DataFrame) -> DataFrame:
    """(shingle, key, at): the lists that hold at least two classes."""
    schema = _longs("shingle", "key", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shared, waiting = (None, None), None, None  # a list's only class so far waits for a second one; what follows a second one passes
        for batch in batches:
            if not batch.num_rows:
                continue
            s, k, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if waiting is not None:
                s, k, at = (np.concatenate(x) for x in zip(waiting, (s, k, at), strict=True))
            new = np.ones(len(s), bool)
            new[0] = waiting is not None or (s[0], k[0]) != last
            new[1:] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])
            last = (s[-1], k[-1])
            s, k, at = s[new], k[new], at[new]
            if not len(s):
                continue
            starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            sizes = np.diff(np.append(starts, len(s)))
            more = np.repeat(sizes > 1, sizes) | (s == shared if shared is not None else False)
            waiting = None if more[-1] else (s[-1:], k[-1:], at[-1:])
            shared = s[-1] if more[-1] else None
            yield _batch([s[more], k[more], at[more]], schema)

    return postings.repartition("shingle").sortWithinPartitions("shingle", "key").mapInArrow(run, schema)


def _centres(lists: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b): each class b with the most central class a of each list it is on.

    The original of a group has few shingles of its own, a copy has those that its changes made. So the class with the least share of
    merged lists to itself stands first in all lists of its group, and the pairs are few.
    """
    merged = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    rank = F.struct((1 - F.col("shared") / merged).alias("alone"), F.col("key"))
    ranked = lists.join(members.select("key", rank.alias("rank")), "key")
    first = ranked.groupBy("shingle").agg(F.min("rank").alias("first"))
    return ranked.join(first, "shingle").where("rank <> first").select(F.col("first.key").alias("a"), F.col("key").alias("b")).distinct()


def least_shared(n_a, n_b, percent: int = PERCENT):
    """T - L: how many merged lists two linked sets of these sizes share at least, as whatever else they have in common lies past one's prefix."""
    need = -(-percent * (n_a + n_b) // (100 + percent))
    past = np.maximum(-(-percent * n_a // 100), -(-percent * n_b // 100)) - 1
    return np.maximum(1, need - past)


def _open_pairs(lists: DataFrame, comp: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that aren't yet in one component and meet in a list early enough for their sizes.

    Of two sets that share `need` shingles the m-th one that they share, in the common order, has at least need - m after it in both. So
    only the beginnings of both lists of shingles are merged, shorter ones than a prefix for any partner, and there linked sets meet m times
    at least: SHARED, or as often as both prefixes reach. One shared passage or two don't make a pair. Who has that many shingles of its own
    there meets nobody, however large its group. A sort-merge join of the lists with themselves splits hot ones.
    """
    named = lists.join(members.select("key", "n"), "key").join(comp.withColumnRenamed("node", "key"), "key", "left").select("shingle", F.coalesce("component", "key").alias("component"), "key", "n", "at")
    open_ = named.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
    # with a partner of its own size or more a set needs more than with a smaller one: beyond this place it only meets smaller ones
    early = F.col("at") < F.col("n") - F.ceil(2 * PERCENT * F.col("n") / (100 + PERCENT)) + SHARED
    kept = stored(named.join(open_, "shingle", "left_semi").withColumn("early", early), "open-lists")
    side = lambda df, c: df.select("shingle", F.col("key").alias(c), F.col("component").alias(f"of_{c}"), F.col("n").alias(f"n_{c}"), F.col("at").alias(f"at_{c}"))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    need = F.ceil(PERCENT * (n_a + n_b) / (100 + PERCENT))
    reach = need - F.greatest(F.ceil(PERCENT * n_a / 100), F.ceil(PERCENT * n_b / 100)) + 1  # least_shared: more may lie past a prefix
    times = F.greatest(F.lit(1), F.least(F.lit(SHARED), reach))
    smaller = (n_a < n_b) | ((n_a == n_b) & (F.col("a") < F.col("b")))
    meet = smaller & (F.col("of_a") != F.col("of_b")) & (100 * n_a >= PERCENT * n_b) & (F.col("at_a") < n_a - need + times) & (F.col("at_b") < n_b - need + times)
    merged = side(kept.where("early"), "a").join(side(kept, "b"), "shingle").where(meet)
    often = merged.groupBy("a", "b").agg(F.count("*").alias("met"), F.first(times).alias("times")).where("met >= times")
    return often.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _possible(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and parity bits allow a link."""
    side = lambda c, what: members.select(F.col("key").alias(c), F.col(what).alias(f"{what}_{c}"))
    schema = _longs("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(a, b) for a, b, n_a, n_b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) if may_link(n_a, x, n_b, y)]
            yield _batch([[k[0] for k in kept], [k[1] for k in kept]], schema)

    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT
    joined = pairs.join(side("b", "n"), "b").join(side("a", "n"), "a").where(near).join(side("a", "bits"), "a").join(side("b", "bits"), "b")
    return joined.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, schema)


def _verified(pairs: DataFrame, members: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by the sets of their texts."""
    pairs = stored(pairs, "pairs")
    # stored, so that Spark knows its size and sends it whole to the texts where it is below the broadcast threshold
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(members, "key").select("doc_id", "key"), "wanted")
    texts = stored(_texts(docs, wanted), "texts")
    of = lambda side: texts.select(F.col("key").alias(side), F.col("text").alias(f"text_{side}"))
    schema = _longs("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_set = None, None
        for batch in batches:
            a_out, b_out = [], []
            for a, b, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != last_key:
                    last_key, last_set = a, shingles(text_a)
                if linked(last_set, shingles(text_b)):
                    a_out.append(a)
                    b_out.append(b)
            yield _batch([a_out, b_out], schema)

    joined = pairs.join(of("b"), "b").join(of("a"), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, schema)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    return jaccard_groups(docs).select("doc_id", "n_shingles", "component_id")


def jaccard_groups(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles, component_id, the smallest doc_id that links reach, group, a number that rows have in common
    if links join them and no others have, null for texts without words, and the columns named in carry.

    Equal sets are one class, told apart by a 64-bit hash and their size, and one row stands for it. First each class
    is compared with the most central one of each list it is on; these few pairs a document join the bulk of every group. Then
    the pairs that aren't yet in one component and meet early enough in a list are compared, so that no link
    between components is lost and a group's copies are not compared all with all. No partner is capped.
    Null, empty or wordless texts have 0 shingles and stand alone; repeated rows are one class; a row without doc_id has
    no place among the components and gets its class's. An empty table gives an empty result.
    """
    census = stored(_census(docs, carry), "census")
    docs = docs.select("doc_id", "text")
    rows = census.where("key is not null").select("doc_id", "key", "n", "bits", *carry)
    n_docs = rows.count()
    common = census.where("shingle is not null").groupBy("shingle").agg(F.sum("holders").alias("holders")).where(F.col("holders") >= max(4.0, LONG_SHARE * n_docs / 2))
    found = sorted((r["shingle"], r["holders"]) for r in common.collect())
    long, rank = (np.array([x[i] for x in found], np.int64) for i in (0, 1))
    classes = rows.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    lists = stored(_shared_lists(_postings(docs, long, rank)), "lists")
    members = stored(lists.groupBy("key").agg(F.count("*").alias("shared")).join(classes, "key"), "members")
    links = stored(_verified(_possible(_centres(lists, members), members), members, docs), "stars")
    more = _possible(_open_pairs(lists, components(links), members), members)
    links = links.union(stored(_verified(more, members, docs), "open"))
    comp = stored(components(links), "components")
    named = comp.join(classes.withColumnRenamed("key", "node"), "node").select("node", "component", "doc_id")
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    by_class = named.join(least, "component").select(F.col("node").alias("key"), F.col("least").alias("of_links"), "component")
    of_class = classes.join(by_class, "key", "left").select("key", F.coalesce("of_links", "doc_id").alias("component_id"), "component")
    out = rows.join(of_class, "key", "left")
    group = F.when(F.col("n") > 0, F.coalesce("component", "key"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), group.alias("group"), *carry)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) of one row for each wanted class (doc_id, key)."""
    schema = T.StructType([*_longs("key"), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key not in sent and set_key(shingles(text)) == key:
                    if len(sent) > REMEMBERED:
                        sent.clear()
                    sent.add(key)
                    rows.append((key, text))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=schema.names)

    # ids may repeat: texts that aren't the class's are left out, and rows of one id meet in one task, which sends one
    return docs.join(wanted, "doc_id").select("key", "text").mapInArrow(run, schema)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
