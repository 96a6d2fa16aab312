"""Latent semantic analysis: a truncated SVD of TF-IDF weights by randomised subspace iteration over rows (term, doc, weight).

Documents are dealt into blocks once, and stay there with the places of their terms among the block's. A step sends each block the vectors of its own terms, and gets
back one row a term of the block: what moves is blocks by their terms, whatever the number of postings. Orthonormalisation needs inner products alone, matrices
of the rank by itself, which are summed up by block and factored on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.functions.columns import tokens
from groupwise.operators.retrieval import postings
from groupwise.operators.sequence import kept, written

#: Directions beyond the rank that speed convergence up, and rows that a task multiplies at a time.
OVERSAMPLED, STRETCH = 8, 8192
#: Characters of text, or rows (term, doc), of a block at most, but for chance: a task holds one block.
BLOCK_CHARS, BLOCK_ROWS = 128_000_000, 10_000_000


def weights(docs: DataFrame, doc: str, text: str, least_df: int = 2) -> tuple[DataFrame, DataFrame]:
    """((term, doc, w), (term, idf)): L2-normalised TF-IDF weights, terms of least_df documents or more, idf ln((1+n)/(1+df)) + 1."""
    found = kept(postings(docs, doc, text).select("term", "doc", "tf"))
    n = docs.agg(F.count("*").alias("n_docs"))
    idf = found.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_df).crossJoin(F.broadcast(n)).select("term", (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    idf = kept(idf)
    raw = found.join(idf, "term").select("term", "doc", (F.col("tf") * F.col("idf")).alias("w"))
    norms = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return kept(raw.join(norms, "doc").select("term", "doc", (F.col("w") / F.col("norm")).alias("w"))), idf


def _multiplied(rows: DataFrame, vectors: DataFrame, key: str, to: str, width: int) -> DataFrame:
    """(to, v): the sums of w times the vectors (key, v) that rows meet."""
    met = rows.join(vectors, key)
    summed = met.groupBy(to).agg(*(F.sum(F.col("w") * F.col("v")[i]).alias(f"v{i}") for i in range(width)))
    return summed.select(to, F.array(*(F.col(f"v{i}") for i in range(width))).alias("v"))


def _products(vectors: DataFrame, width: int) -> np.ndarray:
    """Inner products of the vectors' columns: one partial sum a partition, then Spark's."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, width))
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, width)
            out += x.T @ x
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(width * width), pa.int64()), "v": out.ravel()})

    out = np.zeros(width * width)
    for r in vectors.select("v").mapInArrow(part, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(width, width)


def _turned(vectors: DataFrame, key: str, by: np.ndarray) -> DataFrame:
    """(key, v): each row's vector times a small matrix."""
    schema = T.StructType([vectors.schema[key], T.StructField("v", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STRETCH):
                b = whole.slice(at, STRETCH)
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, by.shape[0]) @ by
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, by.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))], names=schema.names)

    return vectors.select(key, "v").mapInArrow(run, schema)


@dataclass
class Blocks:
    """A matrix of documents by terms in blocks of documents: cells (block, doc, at, w), at being places among the block's words (block, at, term, scale).

    An entry is w times its term's scale, and where `unit` is set, over the length of its row then.
    """

    cells: DataFrame
    words: DataFrame
    parts: int
    unit: bool


def _dealt(rows: DataFrame, doc: str, size: int) -> tuple[DataFrame, int]:
    """rows with their block, a document's in one, in as many partitions as there are blocks."""
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, size)
    return rows.withColumn("block", F.pmod(F.xxhash64(doc), F.lit(parts))).repartition(parts, "block"), parts


def _encoded(rows: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """(block, doc, at, w) and (block, at, term, df) of rows (block, doc, term, w), or of (block, doc, t), the tokens of a document; equal places add up."""
    kind = rows.schema["doc"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc", kind), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("place", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("df", T.LongType())])
    listed = "t" in rows.columns

    def run(table: pa.Table) -> pa.Table:
        docs = _whole(pc.dictionary_encode(table["doc"], null_encoding="encode"))
        of = docs.indices.to_numpy()
        if listed:
            lists = _whole(table["t"])
            of, found = np.repeat(of, pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()
            w = np.ones(len(of))
        else:
            found, w = _whole(table["term"]), table["w"].to_numpy()
        found = found.dictionary_encode()
        many = len(found.dictionary)
        key = of.astype(np.int64) * max(1, many) + found.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        w = np.add.reduceat(w[order], starts) if len(starts) else w[:0]
        row, at = np.divmod(key[starts], max(1, many))
        held = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        offsets = pa.array(np.append(held, len(row)), pa.int32())
        lists = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (at.astype(np.int32), w))
        n, block = len(held), table["block"][0].as_py()
        none = lambda size, kind: pa.nulls(size, kind)
        cells = [pa.array([block] * n, pa.int64()), docs.dictionary.take(pa.array(row[held])), *lists, none(n, pa.int32()), none(n, pa.string()), none(n, pa.int64())]
        words = [pa.array([block] * many, pa.int64()), none(many, docs.dictionary.type), none(many, pa.list_(pa.int32())), none(many, pa.list_(pa.float64())), pa.array(np.arange(many), pa.int32()), found.dictionary.cast(pa.string()), pa.array(np.bincount(at, minlength=many), pa.int64())]
        return pa.concat_tables([pa.Table.from_arrays(x, names=schema.names) for x in (cells, words)])

    every = written(rows.groupBy("block").applyInArrow(run, schema).repartition(parts, "block").sortWithinPartitions("block"))
    return every.where("term is null").select("block", "doc", "at", "w"), written(every.where("term is not null").select("block", F.col("place").alias("at"), "term", "df"))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def row_blocks(rows: DataFrame) -> Blocks:
    """The blocks of rows (term, doc, w) as they stand."""
    sound = rows.where("term is not null").select("doc", "term", F.col("w").cast("double").alias("w"))
    dealt, parts = _dealt(sound, "doc", -(-sound.count() // BLOCK_ROWS))
    cells, words = _encoded(dealt, parts)
    return Blocks(cells, words.select("block", "at", "term", F.lit(1.0).alias("scale")), parts, False)


def text_blocks(docs: DataFrame, doc: str, text: str, least_df: int = 2) -> tuple[Blocks, DataFrame]:
    """The blocks of `weights`, and (term, idf): texts are dealt, and their tokens counted in the blocks."""
    texts = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    dealt, parts = _dealt(texts, "doc", -(-whole[1] // BLOCK_CHARS))
    cells, words = _encoded(dealt.select("block", "doc", tokens(F.col("text")).alias("t")), parts)
    idf = kept(words.groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") >= least_df).select("term", (F.ln((1 + F.lit(whole[0])) / (1 + F.col("df"))) + 1).alias("idf")))
    scaled = written(words.join(idf, "term").select("block", "at", "term", F.col("idf").alias("scale")))
    return Blocks(cells, scaled, parts, True), idf


def _sent(blocks: Blocks, vectors: DataFrame) -> DataFrame:
    """(to, at, scale, term, v): the vectors (term, v) of each block's terms, to the block."""
    return blocks.words.join(vectors, "term").select(F.col("block").alias("to"), "at", "scale", "term", "v")


def _product(left: pa.Table, right: pa.Table, width: int, unit: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(products, row, at, w) of a block: its documents' products with its terms' vectors, and its entries."""
    lists, places = _whole(left["at"]), right["at"].to_numpy()
    at, w = lists.flatten().to_numpy(), _whole(left["w"]).flatten().to_numpy()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    scale = np.zeros(max(at.max(initial=-1), places.max(initial=-1)) + 1)
    scale[places] = right["scale"].to_numpy()
    v = np.zeros((width, len(scale)))
    v[:, places] = _whole(right["v"]).flatten().to_numpy().reshape(-1, width).T
    on = scale[at] != 0
    row, at = row[on], at[on]
    w = w[on] * scale[at]
    if unit:
        w = w / np.sqrt(np.bincount(row, w * w, len(lists)))[row]
    out = np.empty((len(lists), width))
    for j in range(width):
        out[:, j] = np.bincount(row, w * v[j][at], len(lists))
    return out, row, at, w


def _there_and_back(blocks: Blocks, vectors: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """((term, v), inner products): what the matrix and then its transpose make of the terms' vectors, and the inner products of the columns that lie between."""
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("line", T.IntegerType()), *(T.StructField(f"v{i}", T.DoubleType()) for i in range(width))])
    unit = blocks.unit

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], pa.schema([("term", pa.string()), ("line", pa.int32()), *((f"v{i}", pa.float64()) for i in range(width))]))
        between, row, at, w = _product(left, right, width, unit)
        places, inner = right["at"].to_numpy(), between.T @ between
        many = int(max(at.max(initial=0), places.max())) + 1
        back = [np.append(np.bincount(at, w * between[:, j][row], many)[places], inner[:, j]) for j in range(width)]
        terms = pa.concat_arrays([_whole(right["term"]).cast(pa.string()), pa.nulls(width, pa.string())])
        lines = pa.array(np.append(np.full(len(places), -1), np.arange(width)), pa.int32())
        return pa.Table.from_arrays([terms, lines, *map(pa.array, back)], names=schema.names)

    parts = blocks.cells.groupBy("block").cogroup(_sent(blocks, vectors).groupBy("to")).applyInArrow(run, schema)
    summed = parts.groupBy("term", "line").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(width)))
    summed = written(summed.select("term", "line", F.array(*(f"v{i}" for i in range(width))).alias("v")))
    inner = np.zeros((width, width))
    for r in summed.where("term is null").collect():  # as many rows as directions
        inner[r["line"]] = r["v"]
    return summed.where("term is not null").select("term", "v"), inner


def _inverse_root(inner: np.ndarray) -> np.ndarray:
    """What makes columns of these inner products orthonormal. They are taken to length one first, so that short ones keep their digits; directions without length go."""
    length = np.sqrt(inner.diagonal())
    long = length > length.max(initial=0.0) * 1e-13**0.5
    e, q = np.linalg.eigh(inner[np.ix_(long, long)] / np.outer(length[long], length[long]))
    on = e > max(e.max(initial=0.0), 0.0) * 1e-13
    out = np.zeros((len(inner), int(on.sum())))
    out[long] = (q[:, on] / np.sqrt(e[on]) / length[long][:, None])[:, ::-1]
    return out


def _orthonormal(vectors: DataFrame, key: str, width: int) -> tuple[DataFrame, int]:
    """Vectors whose columns are orthonormal and span the same, twice over so that rounding leaves nothing; directions without length go."""
    for _ in range(2):
        vectors = written(vectors)
        e, q = np.linalg.eigh(_products(vectors, width))
        on = e > max(e.max(initial=0.0), 0.0) * 1e-13
        by = (q[:, on] / np.sqrt(e[on]))[:, ::-1]
        vectors, width = _turned(vectors, key, by), by.shape[1]
    return written(vectors), width


@dataclass
class Latent:
    """Singular values, falling, and the terms' (term, v) right vectors."""

    values: np.ndarray
    terms: DataFrame


def truncated_svd(rows: DataFrame, k: int, iterations: int = 8, seed: int = 0, tolerance: float = 1e-9) -> Latent:
    """The k largest singular values of rows (term, doc, w) and the terms' vectors; fewer if the rank is less, none of no rows.

    Iterations end once no value moves by more than tolerance of the largest. Signs make each vector's products with the documents' begin direction follow the driver's
    eigenvectors, so they are the same for all rows of a fit.
    """
    return _svd(row_blocks(rows), k, iterations, seed, tolerance)


def _svd(blocks: Blocks, k: int, iterations: int = 8, seed: int = 0, tolerance: float = 1e-9) -> Latent:
    width = k + OVERSAMPLED
    uniform = lambda i, s: (F.pmod(F.xxhash64("term", F.lit(i), F.lit(seed * 2 + s)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    normal = [F.sqrt(-2 * F.ln(uniform(i, 0))) * F.cos(2 * np.pi * uniform(i, 1)) for i in range(width)]
    terms = blocks.words.select("term").distinct().select("term", F.array(*normal).alias("v"))
    before, found, spectrum = np.zeros(0), terms, (np.zeros(0), np.zeros((width, 0)))
    for _ in range(iterations):
        found, inner = _there_and_back(blocks, terms, width)
        by = _inverse_root(inner)
        if not by.shape[1]:
            return Latent(np.zeros(0), blocks.words.select("term", F.array().cast("array<double>").alias("v")).limit(0))
        # the products of the transpose with orthonormal columns are `found` times `by`
        e, q = np.linalg.eigh(by.T @ _products(found, width) @ by)
        spectrum = (np.sqrt(np.maximum(e[::-1], 0)), by @ q[:, ::-1])
        now = spectrum[0][:k]
        if len(before) == len(now) and np.abs(before - now).max(initial=0.0) <= tolerance * now.max(initial=0.0):
            break
        before = now
        terms, width = _orthonormal(_turned(found, "term", by), "term", by.shape[1])
    values, q = spectrum
    keep = min(k, int((values > values.max(initial=0.0) * 1e-6).sum()))
    return Latent(values[:keep], written(_turned(found, "term", q[:, :keep] / values[:keep])))


def projected(rows: DataFrame, key: str, latent: Latent) -> DataFrame:
    """(key, v): rows (term, key, w) in the latent space, of length 1; what has no term there is left out."""
    k = len(latent.values)
    raw = _multiplied(rows, latent.terms, "term", key, k)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return raw.withColumn("__n", norm).where("__n > 0").select(key, F.transform("v", lambda x: x / F.col("__n")).alias("v"))


def _best(blocks: Blocks, latent: Latent, asked: DataFrame, top: int) -> DataFrame:
    """(query, doc, score): of each block, the `top` documents nearest to each query (query, v) by their cosines, ties to the lesser document."""
    k, unit = len(latent.values), blocks.unit
    doc, query = blocks.cells.schema["doc"].dataType, asked.schema["query"].dataType
    schema = T.StructType([T.StructField("query", query), T.StructField("doc", doc), T.StructField("score", T.DoubleType())])
    none = F.lit(None)
    every = asked.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks.parts - 1).cast("long"))))
    sent = _sent(blocks, latent.terms).select("to", "at", "scale", none.cast(query).alias("query"), F.lit(False).alias("asks"), "v")
    sent = sent.unionByName(every.select("to", none.cast("int").alias("at"), none.cast("double").alias("scale"), "query", F.lit(True).alias("asks"), "v"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asks, held = right.filter(right["asks"]), right.filter(pc.invert(right["asks"]))
        numbers, rows, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and held.num_rows and asks.num_rows:
            near = _product(left, held, k, unit)[0]
            length = np.sqrt((near * near).sum(axis=1))
            at = np.flatnonzero(length > 0)
            near = near[at] / length[at][:, None]
            place = np.empty(left.num_rows, np.int64)
            place[pc.sort_indices(left["doc"]).to_numpy()] = np.arange(left.num_rows)
            for i, v in enumerate(_whole(asks["v"]).flatten().to_numpy().reshape(-1, k)):
                score = near @ v
                rounded = np.rint(score * 1e9)
                some = np.arange(len(score))
                if top < len(score):
                    some = np.flatnonzero(rounded >= np.partition(rounded, len(score) - top)[len(score) - top])
                some = some[np.lexsort((place[at[some]], -rounded[some]))][:top]
                numbers.append(np.full(len(some), i))
                rows.append(at[some])
                scores.append(score[some])
        numbers, rows = pa.array(np.concatenate(numbers)), pa.array(np.concatenate(rows))
        return pa.Table.from_arrays([_whole(asks["query"]).take(numbers), _whole(left["doc"]).take(rows), pa.array(np.concatenate(scores))], names=schema.names)

    return blocks.cells.groupBy("block").cogroup(sent.groupBy("to")).applyInArrow(run, schema)


def lsa_scores(docs: DataFrame, queries: DataFrame, doc: str, text: str, query: str, query_text: str, k: int = 32, top: int = 100, iterations: int = 8) -> DataFrame:
    """(query, doc, score): the cosine in the latent space of each query's `top` best documents, ties to the lesser document.

    The queries are a stated set, held beside each block of documents; a block gives each query's best of its own, so what is put together is at most
    `top` rows a query and block.
    """
    from pyspark.sql.window import Window

    blocks, idf = text_blocks(docs, doc, text)
    latent = _svd(blocks, k, iterations)
    if not len(latent.values):
        kinds = [T.StructField("query", queries.schema[query].dataType), T.StructField("doc", docs.schema[doc].dataType), T.StructField("score", T.DoubleType())]
        return docs.sparkSession.createDataFrame([], T.StructType(kinds))
    asked = queries.select(F.col(query).alias("query"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("tf")).join(idf, "term")
    each = projected(asked.select("term", "query", (F.col("tf") * F.col("idf")).alias("w")), "query", latent)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.bround("score", 9)), "doc"))
    return _best(blocks, latent, each, top).withColumn("place", place).where(F.col("place") <= top).select("query", "doc", "score")
