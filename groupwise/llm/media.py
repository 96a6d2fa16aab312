"""Media columns: payloads as PNG images in tar shards, addressed by content, with metadata by header-only range reads."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.llm.common import field, filesystem, new_path, stored, table, tasks_for

#: Samples of a pixel row: 64 pixels of three 8-bit samples.
ROW = 192
SHARD_BYTES = 64_000_000
#: Digests that a task remembers to have written; beyond that it may write a payload again, which only costs room.
REMEMBERED = 200_000
#: Bytes at a tar member's begin that hold its tar header and all PNG chunks before the samples.
HEADER_BYTES = 1024
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes, row: int = ROW) -> bytes:
    """data with spaces after it, up to a positive multiple of row bytes."""
    return data + b" " * (-len(data) % row or (row if not data else 0))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """An RGB image of 64 pixels a row whose samples are the padded bytes; the unpadded length is a text chunk before them."""
    payload = np.frombuffer(padded(data), np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(payload), ROW + 1), np.uint8)  # each row begins with its filter, none
    lines[:, 1:] = payload
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, len(payload), 8, 2, 0, 0, 0))
    return SIGNATURE + head + _chunk(b"tEXt", b"n_bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def _chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, data) of the chunks that are there whole."""
    if not png.startswith(SIGNATURE):
        raise ValueError("not a PNG image")
    at = len(SIGNATURE)
    while at + 8 <= len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        if at + 12 + size > len(png):
            return
        yield kind, png[at + 8 : at + 8 + size]
        at += 12 + size


def read_header(png: bytes) -> dict[str, int]:
    """width, height, depth, channels and n_bytes from an image's first bytes."""
    chunks = dict(x for x in _chunks(png) if x[0] in (b"IHDR", b"tEXt"))
    width, height, depth, colour = struct.unpack(">IIBB", chunks[b"IHDR"][:10])
    return {"width": width, "height": height, "depth": depth, "channels": {0: 1, 2: 3, 6: 4}[colour], "n_bytes": int(chunks[b"tEXt"].partition(b"\0")[2])}


def read_samples(png: bytes) -> bytes:
    """The samples of an image that to_png made."""
    data = zlib.decompress(b"".join(d for kind, d in _chunks(png) if kind == b"IDAT"))
    return np.frombuffer(data, np.uint8).reshape(-1, ROW + 1)[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean and standard deviation in thousandths and a 16-bin histogram, all in whole numbers."""
    values = np.frombuffer(samples, np.uint8)
    bins = np.bincount(values >> 4, minlength=16)
    counts = np.bincount(values, minlength=256).tolist()
    n, total = len(values), sum(v * c for v, c in enumerate(counts))
    squares = sum(v * v * c for v, c in enumerate(counts))
    variance = max(0, squares * n - total * total)
    return f"mean={1000 * total // n};sd={int(1000 * variance**0.5 / n)};bins=" + ",".join(map(str, bins.tolist()))


def write_shards(rows: DataFrame, folder: str, id_col: str = "doc_id", data_col: str = "data") -> DataFrame:
    """Writes each row's bytes as an image into tar shards: doc_id, digest, shard, offset, length.

    digest is the SHA-256 of the bytes before padding and names the tar member; a task writes a digest once. Two tasks may both
    write it; all rows of a digest then name one of these places, by one rule (media_columns). offset is the tar
    header's, length covers header and image. Shards have names of their own, so a lost or repeated task leaves at most
    a shard that no row names. Null data is empty; a null id stays null.
    """
    schema = T.StructType([field(rows, id_col, "doc_id"), T.StructField("digest", T.BinaryType()), T.StructField("shard", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        places: dict[bytes, tuple[str, int, int]] = {}
        out = shard = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows_out = []
                for data in part.column(1).to_pylist():
                    data = data or b""
                    digest = hashlib.sha256(data).digest()
                    if digest not in places:
                        if out is None:
                            name = f"{uuid.uuid4().hex}.tar"
                            shard, out = f"{folder}/{name}", fs.open_output_stream(f"{root}/{name}")
                        image = to_png(data)
                        info = tarfile.TarInfo(f"{digest.hex()}.png")
                        info.size = len(image)
                        if len(places) > REMEMBERED:
                            places.clear()
                        places[digest] = (shard, out.tell(), tarfile.BLOCKSIZE + len(image))
                        out.write(info.tobuf(tarfile.USTAR_FORMAT) + image + b"\0" * (-len(image) % tarfile.BLOCKSIZE))
                    rows_out.append((digest, *places[digest]))
                    if out is not None and out.tell() >= SHARD_BYTES:
                        out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
                        out.close()
                        out = None
                kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows_out, strict=True), kinds, strict=True))], names=schema.names)
        if out is not None:
            out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
            out.close()

    return rows.select(F.col(id_col).alias("doc_id"), F.col(data_col).alias("data")).mapInArrow(run, schema)


def _read_places(places: DataFrame, fields: list[tuple[str, T.DataType, pa.DataType]], read) -> DataFrame:
    """places (digest, shard, offset, length) with what read(file, offset, length) gives for each; a task reads a shard's places in order."""
    schema = T.StructType([*places.schema.fields, *(T.StructField(n, kind) for n, kind, _ in fields)])
    at = [places.columns.index(n) for n in ("shard", "offset", "length")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = file = None
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                out = []
                for path, offset, length in zip(*(part.column(i).to_pylist() for i in at), strict=True):
                    if path != shard:
                        if file is not None:
                            file.close()
                        fs, local = filesystem(path)
                        shard, file = path, fs.open_input_file(local)
                    out.append(read(file, offset, length))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, kind) for c, (_, _, kind) in zip(zip(*out, strict=True), fields, strict=True))], names=schema.names)
        if file is not None:
            file.close()

    return places.mapInArrow(run, schema)


def header_metadata(places: DataFrame) -> DataFrame:
    """places with width, height, depth, channels and n_bytes, by reading only the first bytes of each member."""
    names = ("width", "height", "depth", "channels", "n_bytes")

    def read(file, offset: int, length: int) -> tuple:
        head = file.read_at(min(HEADER_BYTES, length), offset)
        found = read_header(head[tarfile.BLOCKSIZE :])
        return tuple(found[n] for n in names)

    return _read_places(places, [(n, T.LongType(), pa.int64()) for n in names], read)


def stored_features(places: DataFrame) -> DataFrame:
    """places with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, from the stored bytes read back."""

    def read(file, offset: int, length: int) -> tuple:
        image = file.read_at(length, offset)[tarfile.BLOCKSIZE :]
        samples = read_samples(image)
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)

    longs, texts = (T.LongType(), pa.int64()), (T.StringType(), pa.string())
    kinds = {"payload_bytes": longs, "payload_sha256": texts, "tail_crc32": longs, "media_bytes": longs, "media_sha256": texts, "feature": texts}
    return _read_places(places, [(n, *k) for n, k in kinds.items()], read)


def media_columns(rows: DataFrame, folder: str, id_col: str = "doc_id", data_col: str = "data") -> DataFrame:
    """Each row's doc_id, digest, shard, offset and length, header metadata and features.

    A digest's place is the least of those written. Metadata and features are read once a distinct digest and joined to
    its rows, so equal payloads have equal values. Rows with empty or null data have one row of spaces; repeated rows
    each give a row; an empty table gives an empty result.
    """
    written = stored(write_shards(rows, folder, id_col, data_col), "media-rows")
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    places = written.groupBy("digest").agg(place).select("digest", "place.*")
    total = written.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    # the number is given, as places are so small beside what they name that adaptive execution would merge them
    in_order = places.repartition(tasks_for(rows.sparkSession, total), "shard", (F.col("offset") / 4_000_000).cast("long")).sortWithinPartitions("shard", "offset")
    known = stored_features(header_metadata(in_order))
    return written.select("doc_id", "digest").join(known, "digest")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    media = media_columns(docs, new_path(spark, "media"))
    return media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
