"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.llm.common import field, table
from groupwise.llm.pretokens import runs

LENGTH = 1024
#: Pieces packed together. It bounds memory (a group holds at most GROUP * LENGTH ids) and the loss to at
#: most one part-filled sequence a group; it drops nothing.
GROUP = 4096
#: Encoded runs that a Python worker remembers; it starts anew beyond that.
REMEMBERED = 300_000


class _Known(dict):
    """Ids of runs seen before; a new one is encoded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, run: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[run] = ids = _packed(self.encode(f" {run}"))
        return ids


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()  # unsigned 32-bit, little-endian on every platform Spark supports well


def _ranked(spec: dict) -> dict[bytes, int] | None:
    """Token bytes and ids of a byte-level BPE whose ids rise with its merges, so that they are ranks; None for others."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)):
        return None
    # byte-level vocabularies write a byte as its own character if that is visible, the others as those from 256 on
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


class BatchEncoder:
    """Ids of the tokenizers library as little-endian unsigned 32-bit integers.

    Texts are cut into runs, and equal runs are encoded once. If the file's vocabulary is a plain byte-level BPE, tiktoken
    encodes new runs with the same vocabulary, which gives the same ids in a third of the time; else, and for texts that
    hold a special token's string, the library itself encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = _ranked(spec)
        self.plain = ranks and tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = _Known(self.plain.encode_ordinary) if ranks else None

    def __call__(self, text: str) -> bytes:
        if not self.plain or any(s in text for s in self.special):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        head, rest = runs(text)
        return _packed(self.plain.encode_ordinary(head)) + b"".join(map(self.known.__getitem__, rest))


_ENCODERS: dict[str, BatchEncoder] = {}


def _encoder(path: str) -> BatchEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(path)
    return _ENCODERS[path]


def tokenize(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """Each document's ids with end_id after them, cut every `length` ids: id, start, length, doc_tokens, ids (binary).

    A null or empty text is end_id alone; a null id stays null; rows that repeat give their pieces each time.
    """
    schema = T.StructType([field(docs, id_col, "doc_id"), *(T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens")), T.StructField("ids", T.BinaryType())])
    end, step = int(end_id).to_bytes(4, "little"), 4 * length

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[list] = [[], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encoder(text or "") + end
                    for i in range(0, len(ids), step):
                        piece = ids[i : i + step]
                        for column, value in zip(rows, (doc, i // 4, len(piece) // 4, len(ids) // 4, piece), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], part.schema.field(0).type), *(pa.array(r, pa.int64()) for r in rows[1:4]), pa.array(rows[4], pa.binary())], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, schema)


class TournamentTree:
    """Bins in the order they were opened; a node holds the largest room below it, so the first bin with room is found from the root."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for size, whose room shrinks by it."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bin_ = node - self.leaves
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return bin_


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers by bin; larger items come first, equal ones in the order given."""
    tree, bins = TournamentTree(len(sizes), capacity), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = tree.place(sizes[item])
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
    return bins


def fill_gaps(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Moves pieces (item, from, to) of the emptiest bins into the room of the fullest, cutting where one doesn't fit: one bin at most stays part-filled."""
    fill = lambda b: sum(to - at for _, at, to in b)
    full = [b for b in bins if fill(b) == capacity]
    part = sorted((b for b in bins if fill(b) < capacity), key=fill)
    low, high = 0, len(part) - 1
    room = capacity - fill(part[high]) if part else 0
    while low < high:
        item, at, to = part[low].pop()
        taken = min(room, to - at)
        part[high].append((item, at, at + taken))
        if taken < to - at:
            part[low].append((item, at + taken, to))
        room -= taken
        low += not part[low]
        if not room:
            high -= 1
            room = capacity - fill(part[high])
    return full + [b for b in part if b]


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Packs pieces of at most `length` ids into sequences of at most `length`.

    Returns doc_id, start, length, doc_tokens, sequence_id, offset and ids. A hash of its content gives each piece a
    random place; each run of `group` pieces in that order is packed on its own by first-fit decreasing, then the
    room left in its fuller sequences is filled from the emptiest ones. Repeated rows are packed each time.
    An empty table gives an empty result. No task holds more than one group.
    """
    schema = T.StructType([field(pieces, "doc_id"), *(T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")), T.StructField("ids", T.BinaryType())])

    def packed(rows: list[tuple], first: int, kind: pa.DataType) -> tuple[list[pa.RecordBatch], int]:
        bins = first_fit_decreasing([r[2] for r in rows], length)
        bins = fill_gaps([[(i, 0, rows[i][2]) for i in b] for b in bins], length)
        out = []
        for at in range(0, len(bins), 500):
            columns: list[list] = [[] for _ in schema.names]
            for k, b in enumerate(bins[at : at + 500]):
                offset = 0
                for item, low, high in b:
                    doc, start, _, total, ids = rows[item]
                    for column, value in zip(columns, (doc, start + low, high - low, total, first + at + k, offset, ids[4 * low : 4 * high]), strict=True):
                        column.append(value)
                    offset += high - low
            out.append(pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.binary())], names=schema.names))
        return out, first + len(bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        next_id, kind = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            kind = batch.schema.field(0).type
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= group:
                out, next_id = packed(held[:group], next_id, kind)
                held = held[group:]
                yield from out
        if held:
            yield from packed(held, next_id, kind)[0]

    place = F.xxhash64("doc_id", "start", "ids")
    keyed = pieces.select("doc_id", "start", "length", "doc_tokens", "ids", place.alias("place"))
    ordered = keyed.repartition("place").sortWithinPartitions("place", "doc_id", "start", "length", "doc_tokens")
    return ordered.select("doc_id", "start", "length", "doc_tokens", "ids").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    return pack(tokenize(docs, tokenizer_path, length=length), length, group)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
