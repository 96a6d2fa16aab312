"""WARC archives: a writer with revisit records, and a splittable reader of gzip members."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.llm.common import filesystem, new_path, stored, table, tasks_for

#: Payloads of fewer bytes are always written whole.
REVISIT_BYTES = 1000
SPLIT_BYTES = 8_000_000
#: Bytes that a writer puts into one archive before it opens another.
ARCHIVE_BYTES = 64_000_000
CHUNK = 1 << 20
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(headers: dict[str, str], body: bytes) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(body)}\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode()) + squeeze.compress(body) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def record(page_id, url: str | None, payload: bytes | None, size: int, sha1: bytes, refers_to) -> bytes:
    """A response record, or without payload a revisit of page refers_to's."""
    named = lambda x: f"<urn:page:{'none' if x is None else x}>"
    kind = "response" if payload is not None else "revisit"
    headers = {"WARC-Type": kind, "WARC-Record-ID": named(page_id)}
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")
    headers |= {"WARC-Date": "2024-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha1:{base64.b32encode(sha1).decode()}", "Content-Type": "application/http; msgtype=response"}
    if payload is None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": named(refers_to)}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return member(headers, http + (payload or b""))


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as .warc.gz files of one gzip member a record: (path, bytes, records).

    Of the pages with one payload of at least revisit_bytes, that with the largest page_id is the response, the others
    revisit it; smaller ones are all responses. Null html is an empty payload, null urls have no target, and pages
    without id never are revisited, and revisit only if their payload has a page with one. Rows that repeat are
    written each time. A task writes under a name of its own attempt, so a lost or repeated task leaves at most a file
    that no row names.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", html.alias("payload")).withColumn("sha1", F.sha1("payload"))
    large = keyed.where(F.length("payload") >= revisit_bytes)
    owner = large.where("page_id is not null").groupBy(F.col("sha1").alias("owned")).agg(F.max("page_id").alias("owner"))
    joined = keyed.join(owner, (F.col("sha1") == F.col("owned")) & (F.length("payload") >= revisit_bytes), "left")
    revisits = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id"))
    rows = joined.select("page_id", "url", F.when(~revisits, F.col("payload")).alias("payload"), F.length("payload").cast("long").alias("size"), F.unhex("sha1").alias("sha1"), "owner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        made, out, written, records = 0, None, 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([written], pa.int64()), "records": pa.array([records], pa.int64())})

        for batch in batches:
            for page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{made:03d}.warc.gz"
                    path, out = f"{folder}/{name}", fs.open_output_stream(f"{root}/{name}", compression=None)
                    written, records, made = 0, 0, made + 1
                data = record(*page)
                out.write(data)
                written, records = written + len(data), records + 1
                if written >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return rows.mapInArrow(run, "path string, bytes long, records long")


def _whole_member(read, at: int, first: bytes) -> tuple[bytes, int] | None:
    """The record of the gzip member at `at` and the member's size; None if what stands there is no member of a WARC record."""
    squeeze, out, taken, data = zlib.decompressobj(31), [], 0, first
    begun = b""
    while True:
        try:
            out.append(squeeze.decompress(data))
        except zlib.error:
            return None
        if len(begun) < 5:
            begun = b"".join(out)[:5]
            if not b"WARC/".startswith(begun[:5]):
                return None
        taken += len(data) - len(squeeze.unused_data)
        if squeeze.eof:
            return (b"".join(out), taken) if begun == b"WARC/" else None
        data = read(at + taken, CHUNK)
        if not data:
            return None


#: Members in a row, or fewer up to the file's end, that must follow one another before a range's first candidate counts.
CHAIN = 4


def members_in(read, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the members that start in [start, end), by read(offset, bytes).

    The range is scanned for gzip magic; a candidate counts if it decodes to a WARC header and to its end, and what follows is
    another such member, CHAIN times or up to the file's end. So a member that a record stores uncompressed, and that a range which
    begins inside that record meets first, is passed over: the record's own end follows it. A stored archive of CHAIN or more members in a row can't be told from
    the file's own by a range that begins inside it. Whatever a member holds is passed over too.
    """
    at, window, base = start, b"", start
    held: list[tuple[int, bytes]] = []
    sure = start == 0
    while not (sure and at >= end):
        if at < base or at + len(MAGIC) > base + len(window):
            base, window = at, read(at, CHUNK)
        if held or sure:  # a chain goes on right here or ends
            follows = window[at - base : at - base + len(MAGIC)] == MAGIC
            found = _whole_member(read, at, window[at - base :]) if follows else None
            if found is None:
                if held and at - base < len(window):
                    at, held = held[0][0] + 1, []  # no member, nor the file's end: the chain was none
                    continue
                yield from (h for h in held if h[0] < end)
                if at >= end or at - base >= len(window):
                    return
                held, sure = [], False  # broken bytes between members
                continue
        else:
            if at >= end:
                return
            hit = window.find(MAGIC, at - base)
            if hit < 0:
                if len(window) < CHUNK:
                    return
                at = base + len(window) - len(MAGIC) + 1
                continue
            at = base + hit
            if at >= end:
                return
            found = _whole_member(read, at, window[hit:])
            if found is None:
                at += 1
                continue
        if sure:
            yield at, found[0]
        else:
            held.append((at, found[0]))
            if len(held) >= CHAIN:
                yield from (h for h in held if h[0] < end)
                held, sure = [], True
        at += found[1]


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return headers, rest[: int(headers.get("content-length", "0"))]


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the .warc.gz files (path, bytes), each read by the task whose byte range holds its first byte.

    path, offset, record_type, record_id, target_uri, refers_to, payload_digest (as written), payload (what the block holds
    after its HTTP header; null for a revisit) and payload_bytes (the HTTP header's Content-Length). A range is scanned for
    members whatever the lengths of others; a task holds one record and a chunk. No files give no rows.
    """
    schema = T.StructType([T.StructField(n, T.LongType() if n in ("offset", "payload_bytes") else T.BinaryType() if n == "payload" else T.StringType()) for n in ("path", "offset", "record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload")])
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = files.where("path is not null and bytes > 0").select("path", F.explode(pieces).alias("start"), "bytes").select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if f.dataType == T.LongType() else pa.binary() if f.dataType == T.BinaryType() else pa.string() for f in schema]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, local = filesystem(path)
                rows, held = [], 0
                with fs.open_input_file(local) as file:
                    for offset, data in members_in(lambda at, n, f=file: (f.seek(at), f.read(n))[1], start, end):
                        headers, block = parse_record(data)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length"), None)
                        kind = headers.get("warc-type")
                        rows.append((path, offset, kind, headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), headers.get("warc-payload-digest"), size, None if kind == "revisit" else payload))
                        held += len(payload)
                        if len(rows) >= 1000 or held > 8_000_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    # the number is given, as range rows are so small that adaptive execution would merge them into one task
    return ranges.repartition(tasks_for(files.sparkSession, total), "path", "start").mapInArrow(run, schema)


#: The letters of base 32 (RFC 4648), in order of value.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def hex_digest(labelled):
    """Lower-case hex of a column sha1:BASE32: 32 letters of five bits are 40 hex digits of four."""
    letters = F.substring_index(labelled, ":", -1)
    bits = F.array_join(F.transform(F.split(letters, ""), lambda x: F.lpad(F.bin(F.position(x, F.lit(BASE32)) - 1), 5, "0")), "")
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(F.conv(F.substring(bits, i * 20 + 1, 20), 2, 16), 5, "0")), ""))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    files = stored(write_archives(pages, new_path(spark, "warc")), "warc-files")
    records = read_archives(files)
    of_urn = lambda c: F.nullif(F.regexp_extract(c, "<urn:page:(.*)>", 1), F.lit("none")).cast(pages.schema["page_id"].dataType)
    return records.select(of_urn("record_id").alias("page_id"), "payload_bytes", hex_digest(F.col("payload_digest")).alias("payload_digest"), "record_type", of_urn("refers_to").alias("refers_to"))
