"""Nearest neighbours by collision counting over single projections, with query-centred windows and virtual rehashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.llm.common import field, table

NEAREST = 20
PROJECTIONS = 160
#: Share of projections whose window must hold a vector before it is verified.
THRESHOLD = 0.9
#: Windows stop growing once OVER * k vectors and this share of a block collide often enough; all that do are verified. With the
#: projections and the threshold they set recall, which README gives as measured.
SHARE, OVER = 0.1, 4
#: First half-width of a window, in standard deviations of a projection, and the factor by which it grows.
FIRST, GROWTH = 1.9, 1.08
#: Vectors of a block, which a task holds, and queries that are answered at once.
BLOCK, QUERY_BLOCK = 16_384, 256
SEED = 20
#: Largest norm by least norm of vectors that are searched together.
RATIO = 1.1


def lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    """One component more, so that all have the norm `largest`: then the largest inner product is the least distance."""
    rest = np.sqrt(np.maximum(largest**2 - np.einsum("ij,ij->i", vectors, vectors), 0))
    return np.hstack((vectors, rest[:, None]))


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Norms that neither overflow nor vanish where squares would."""
    most = np.abs(vectors).max(axis=1)
    return most * np.linalg.norm(vectors / most[:, None], axis=1)


def norm_ranges(norms: np.ndarray, ratio: float = RATIO) -> list[np.ndarray]:
    """Places of the vectors by range of norms, largest first; a range's norms differ by the ratio at most."""
    order = np.argsort(-norms, kind="stable")
    step = np.floor(np.log(norms[order[0]] / norms[order]) / np.log(ratio)).astype(int)
    return np.split(order, np.flatnonzero(np.diff(step)) + 1)


class Block:
    """A block's vectors by ranges of norms, with the sorted projections of each range.

    Norms of very different size leave nothing of inner products in distances, so each range of norms is lifted to its own largest
    norm, and so are queries, whose length changes no order.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, axes: np.ndarray):
        self.ids, self.points, self.axes = ids, points, axes
        norms = lengths(points)
        self.ranges = []
        for places in map(np.sort, norm_ranges(norms)):
            largest = float(norms[places].max())
            self.ranges.append((places, largest, SortedProjections(lifted(points[places], largest), axes)))

    def best(self, q_ids: np.ndarray, q_points: np.ndarray, k: int, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k best for each query. A range is left out for queries whose k-th best beats the largest inner product that its norms allow."""
        q_norms = lengths(q_points)
        best = [(self.ids[:0], np.zeros(0))] * len(q_ids)
        for places, largest, index in self.ranges:
            asking = [j for j, (_, s) in enumerate(best) if len(s) < k or s[-1] <= largest * q_norms[j] * (1 + 1e-9)]
            if not asking:
                continue
            to = q_points[asking] / q_norms[asking][:, None] * largest
            wanted = OVER * k + 1 + int(SHARE * len(places))
            for j, found in zip(asking, index.candidates(self.axes @ np.hstack((to, np.zeros((len(to), 1)))).T, wanted, threshold), strict=True):
                found = places[found]
                found = found[self.ids[found] != q_ids[j]]
                every, scores = np.concatenate((best[j][0], self.ids[found])), np.concatenate((best[j][1], (self.points[found] * q_points[j]).sum(axis=1)))
                first = np.lexsort((every, -scores))[:k]
                best[j] = every[first], scores[first]
        return best


def projections(dim: int, n: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, dim))


class SortedProjections:
    """One sorted array for each projection of a block of vectors."""

    def __init__(self, points: np.ndarray, axes: np.ndarray):
        values = axes @ points.T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.values = np.take_along_axis(values, self.order, axis=1)
        self.first = max(FIRST * float(np.median(values.std(axis=1))), 1e-12)

    def candidates(self, places: np.ndarray, wanted: int, threshold: int):
        """For each column of places (a query's projections): the vectors that `threshold` windows around them hold, at the first radius that gives `wanted`."""
        n = self.values.shape[1]
        edges = lambda half: [(np.searchsorted(v, p - half, "left"), np.searchsorted(v, p + half, "right")) for v, p in zip(self.values, places, strict=True)]
        at_first = edges(self.first)
        for q in range(places.shape[1]):
            low, high = np.array([a[q] for a, _ in at_first]), np.array([b[q] for _, b in at_first])
            # windows hold most of a block, so what they miss is counted: collisions are the projections less the misses
            outside = [o[:x] for o, x in zip(self.order, low.tolist(), strict=True)] + [o[x:] for o, x in zip(self.order, high.tolist(), strict=True)]
            misses = np.bincount(np.concatenate(outside), minlength=n)
            half, most = self.first, len(self.values) - threshold
            while True:
                found = np.flatnonzero(misses <= most)
                if len(found) >= min(wanted, n) or (not low.any() and (high == n).all()):
                    break
                # virtual rehashing: the same arrays with wider windows, of which only the new part is counted
                half *= GROWTH
                wider = [(int(np.searchsorted(v, p - half, "left")), int(np.searchsorted(v, p + half, "right"))) for v, p in zip(self.values, places[:, q], strict=True)]
                added = [o[x:y] for o, (x, _), y in zip(self.order, wider, low.tolist(), strict=True)] + [o[y:x] for o, (_, x), y in zip(self.order, wider, high.tolist(), strict=True)]
                misses -= np.bincount(np.concatenate(added), minlength=n)
                low, high = np.array([x for x, _ in wider]), np.array([x for _, x in wider])
            yield found


def nearest(vectors: DataFrame, is_query, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of the largest inner product for each row that is_query (a Column) picks, but for itself: query_id, rank, id, score.

    Every row is indexed once, in blocks of vectors; queries flow through all blocks, so a task holds BLOCK
    vectors and QUERY_BLOCK queries, and a block verifies all that collide often enough and keeps its k best. Scores
    are double-precision inner products of the vectors given. Ties go to the smaller id.
    Null vectors and ids, zero vectors, those that hold null, NaN or infinite components or another number of
    components than the most common length take no part. Repeated ids are candidates each; a query's own id never is.
    Fewer than k other rows give all of them; an empty table gives an empty result.
    """
    id_type = vectors.schema[id_col].dataType
    wide = F.transform(vector_col, lambda x: x.cast("double"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    clean = vectors.select(F.col(id_col).alias("vec_id"), wide.alias("vec"), is_query.alias("asks")).where(F.col("vec").isNotNull() & F.col("vec_id").isNotNull() & sound)
    size = F.size("vec").alias("size")
    sizes = clean.groupBy(size).agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("asking")).orderBy(F.desc("n"), "size").first()
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType())])
    if sizes is None:
        empty = clean.where("false")
        return empty.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    dim = sizes["size"]
    blocks = -(-sizes["n"] // BLOCK)
    clean = clean.where(F.size("vec") == dim)
    at = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("long")
    held = clean.select(at.alias("block"), F.lit(False).alias("asks"), "vec_id", "vec")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asked = clean.where("asks").groupBy("vec_id").agg(F.min("vec").alias("vec")).select(every.alias("block"), F.lit(True).alias("asks"), "vec_id", "vec")
    axes = projections(dim + 1, PROJECTIONS)
    threshold = int(np.ceil(THRESHOLD * PROJECTIONS))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by block, its vectors before the queries
        current, ids, points, block = None, [], [], None
        for batch in batches:
            kind = batch.schema.field("vec_id").type
            for low in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(low, QUERY_BLOCK)
                numbers, asks = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)
                names, vectors = part.column(2).to_numpy(zero_copy_only=False), np.asarray(part.column(3).flatten()).reshape(part.num_rows, dim)
                for number in dict.fromkeys(numbers.tolist()):
                    if number != current:
                        current, ids, points, block = number, [], [], None
                    own = numbers == number
                    ids.append(names[own & ~asks])
                    points.append(vectors[own & ~asks])
                    asking = own & asks
                    if not asking.any() or not sum(map(len, ids)):
                        continue
                    block = block or Block(np.concatenate(ids), np.concatenate(points), axes)
                    found = block.best(names[asking], vectors[asking], k, threshold)
                    of = np.repeat(names[asking], [len(x) for x, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(of, kind), pa.array(np.concatenate([x for x, _ in found]), kind), pa.array(np.concatenate([s for _, s in found]))], names=schema.names)

    local = held.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "asks", "vec_id").mapInArrow(search, schema)
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k)  # k rows from each block
    ranked = local.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.minus")).alias("score"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
