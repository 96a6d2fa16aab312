"""Byte-level BPE by a global distinct-word shuffle, and decoding by the token-byte table."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.llm.common import field, table
from groupwise.llm.pretokens import read_ranks, runs

#: Characters of text whose words travel together; it bounds memory and changes no result.
BLOCK_CHARS = 14_000_000
#: Words that an encoding task remembers; it starts anew beyond that.
REMEMBERED = 1_000_000


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _planes(numbers: np.ndarray) -> bytes:
    """Small numbers byte plane by byte plane, which compresses well."""
    return _squeeze(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_expand(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _word_list(words: list[bytes]) -> bytes:
    return _planes(np.fromiter(map(len, words), np.int64, len(words))) + b"|WORDS|" + _squeeze(b"".join(words))


def _words(data: bytes) -> list[bytes]:
    sizes, _, joined = data.partition(b"|WORDS|")
    ends = np.cumsum(_from_planes(sizes)).tolist()
    whole = _expand(joined)
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


class _Numbered(dict):
    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class _Block:
    """The distinct pre-tokens of some documents and where each stands."""

    def __init__(self, pattern):
        self.pattern, self.words = pattern, _Numbered()
        self.seen: dict[str, tuple[int, ...]] = {}
        self.docs, self.sizes, self.flat, self.chars = [], [], [], 0

    def add(self, doc, text: str) -> None:
        head, rest = runs(text)
        seen, number, split = self.seen, self.words.__getitem__, self.pattern.findall
        for r in set(rest).difference(seen):
            seen[r] = tuple(map(number, split(f" {r}")))
        flat = np.fromiter(chain(map(number, split(head)), chain.from_iterable(map(seen.__getitem__, rest))), np.int32)
        self.docs.append(doc)
        self.sizes.append(len(flat))
        self.flat.append(flat)
        self.chars += len(text)

    def parts(self, buckets: int, kind: pa.DataType) -> Iterator[tuple]:
        """(bucket, number of parts, documents, words, counts, gaps) for each bucket of words; positions are gaps from a word's one before."""
        words = [w.encode("utf-8", "surrogatepass") for w in self.words]
        flat = np.concatenate(self.flat) if self.flat else np.zeros(0, np.int32)
        counts = np.bincount(flat, minlength=len(words))
        order = np.argsort(flat, kind="stable")
        starts = np.concatenate(([0], np.cumsum(counts)))
        gaps = np.diff(order, prepend=0)
        gaps[starts[:-1]] = order[starts[:-1]]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        used = np.unique(bucket).tolist() or [0]
        sink = pa.BufferOutputStream()
        docs = pa.RecordBatch.from_arrays([pa.array(self.docs, kind), pa.array(self.sizes, pa.int64())], names=["doc_id", "words"])
        with pa.ipc.new_stream(sink, docs.schema) as writer:
            writer.write_batch(docs)
        for k, b in enumerate(used):
            own = np.flatnonzero(bucket == b)
            at = np.repeat(starts[own], counts[own]) + _within(counts[own])
            yield b, len(used), sink.getvalue().to_pybytes() if k == 0 else None, _word_list([words[i] for i in own.tolist()]), _planes(counts[own]), _planes(gaps[at])


def _within(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ids (binary, little-endian unsigned 32-bit) by the ranks in a .tiktoken file: doc_id, ids.

    Tasks cut texts into pre-tokens and send the distinct ones of a block of documents, with the positions of each,
    to the task that has the word's bucket; there each distinct word is encoded once; ids and positions go back by
    block, where they are put in order. So a word costs one row a block however often it stands there, and no word
    is a hot key. A null or empty text gives no ids, a null id stays null, and repeated rows each give their row.
    The input should be a stored table: its rows must come in the same order if a task runs again.
    """
    import public_tokenizers

    pattern = public_tokenizers.PATTERN
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_field = field(docs, id_col, "doc_id")
    binary = lambda *names: [T.StructField(n, T.BinaryType()) for n in names]
    number = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    split_schema = T.StructType([*number("bucket", "block", "parts"), *binary("docs", "words", "counts", "gaps")])
    coded_schema = T.StructType([*number("block", "parts"), *binary("docs", "sizes", "ids", "counts", "gaps")])
    out_schema = T.StructType([id_field, *binary("ids")])

    def batch_of(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
        kinds = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64() for f in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled, made, kind = regex.compile(pattern), 0, None
        block = _Block(compiled)

        def flush() -> Iterator[pa.RecordBatch]:
            # the content's checksum is part of the name: a block made anew with other rows can't be mixed with this one
            check = zlib.crc32(repr((block.docs, block.sizes)).encode())
            name = ((TaskContext.get().partitionId() << 40) | (made << 24)) ^ (check >> 8)
            for b, *rest in block.parts(buckets, kind):
                yield batch_of([(b, name, *rest)], split_schema)

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.add(doc, text or "")
                if block.chars >= BLOCK_CHARS:
                    yield from flush()
                    block, made = _Block(compiled), made + 1
        if block.docs:
            yield from flush()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, known = _encoding(ranks_path), {}
        for batch in batches:
            for row in batch.to_pylist():
                words = _words(row["words"])
                new = set(words).difference(known)
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = set(words)
                for w in new:
                    known[w] = encoding.encode_ordinary(w.decode("utf-8", "surrogatepass"))
                ids = [known[w] for w in words]
                sizes, flat = np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.int64)
                yield batch_of([(row["block"], row["parts"], row["docs"], _planes(sizes), _planes(flat), row["counts"], row["gaps"])], coded_schema)

    def rebuild(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        if len(rows) != rows[0]["parts"]:
            raise RuntimeError(f"block {rows[0]['block']} has {len(rows)} of {rows[0]['parts']} parts")
        docs = pa.ipc.open_stream(next(r["docs"] for r in rows if r["docs"] is not None)).read_all()
        per_doc = docs.column("words").to_numpy()
        word_at = np.zeros(per_doc.sum(), np.int64)
        sizes, ids, before = [], [], 0
        for r in rows:
            size, counts, gaps = (_from_planes(r[n]) for n in ("sizes", "counts", "gaps"))
            total = np.cumsum(gaps)
            first = np.cumsum(counts) - counts
            base = total[first] - gaps[first] if len(first) else total
            word_at[total - np.repeat(base, counts)] = np.repeat(np.arange(before, before + len(size)), counts)
            sizes.append(size)
            ids.append(_from_planes(r["ids"]))
            before += len(size)
        sizes, ids = np.concatenate(sizes), np.concatenate(ids).astype("<u4")
        offsets = np.cumsum(sizes) - sizes
        ends = np.cumsum(per_doc)
        for at in range(0, len(per_doc), 200):
            out = []
            for low, high in zip((ends - per_doc)[at : at + 200].tolist(), ends[at : at + 200].tolist(), strict=True):
                own = word_at[low:high]
                n = sizes[own]
                out.append(ids[np.repeat(offsets[own], n) + _within(n)].tobytes())
            yield pa.RecordBatch.from_arrays([docs.column("doc_id").slice(at, 200).combine_chunks(), pa.array(out, pa.binary())], names=out_schema.names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["block"] != row["block"]:
                    yield from rebuild(held)
                    held = []
                held.append(row)
        if held:
            yield from rebuild(held)

    words = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(split, split_schema)
    coded = words.repartition(buckets, "bucket").mapInArrow(code, coded_schema)
    return coded.repartition("block").sortWithinPartitions("block").mapInArrow(gather, out_schema)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with decoded (binary): the bytes of each id, looked up in the token-byte table, whose size the vocabulary fixes. Null ids give null."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = {rank: token for token, rank in read_ranks(ranks_path).items()}
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                out = [None if ids is None else b"".join(map(table_of.__getitem__, np.frombuffer(ids, "<u4").tolist())) for ids in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
