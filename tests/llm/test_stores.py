"""Media columns, WARC archives, nearest neighbours and the pipeline against brute force, with odd inputs."""

import base64
import gzip
import hashlib
import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groupwise.llm import ann, media, warc
from groupwise.llm.common import new_path, shared_dir


# ---- Media


def test_images_hold_their_bytes():
    for data in (b"", b"a", b"x" * 192, b"x" * 193, os.urandom(5000)):
        image = media.to_png(data)
        assert media.read_samples(image) == media.padded(data) and len(media.padded(data)) % 192 == 0 and media.padded(data)
        assert media.read_header(image[: media.HEADER_BYTES]) == {"width": 64, "height": len(media.padded(data)) // 192, "depth": 8, "channels": 3, "n_bytes": len(data)}


def test_media_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = media.op8_media(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        payload = media.padded(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len(docs[r.doc_id]), len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        image = media.to_png(docs[r.doc_id])
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(image), hashlib.sha256(image).hexdigest(), media.feature(payload))


def test_odd_payloads_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(media, "SHARD_BYTES", 4000)
    rows = [(1, None), (2, b""), (3, b"abc"), (4, b"abc "), (None, b"abc"), (5, b"z" * 100_000), (5, b"z" * 100_000), *((10 + i, bytes([i]) * 500) for i in range(40))]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], "doc_id long, data binary, digest string").repartition(3)
    got = media.media_columns(df, new_path(spark, "media-test")).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(a), len(b or b"")) for a, b in rows)
    assert len({r.media_sha256 for r in got if r.n_bytes == 3}) == 1
    by_three = {r.digest: (r.shard, r.offset) for r in got}
    assert all((r.shard, r.offset) == by_three[r.digest] for r in got)
    assert media.media_columns(df.where("false"), new_path(spark, "media-test")).count() == 0


def test_shards_are_tar_files(spark):
    import tarfile

    folder = new_path(spark, "media-tar")
    written = media.write_shards(spark.createDataFrame([(1, b"one"), (2, b"two")], "doc_id long, data binary"), folder).collect()
    for r in written:
        with tarfile.open(r.shard.removeprefix("file:")) as tar:
            names = tar.getnames()
            assert f"{bytes(r.digest).hex()}.png" in names
            assert media.read_samples(tar.extractfile(f"{bytes(r.digest).hex()}.png").read()).rstrip() in (b"one", b"two")


# ---- WARC


def pages_frame(spark):
    big, other = "<p>" + "x" * 3000, "é" * 600
    rows = [(1, "http://a/ b", big), (2, "http://b\r\nX: y", big), (3, None, big), (4, "u", other), (5, "u", other), (6, "u", "small"), (7, "u", "small"), (8, "u", None), (None, "u", big), (9, "u", ""), (9, "u", ""), (10, "u", "\x1f\x08" * 900 + "WARC/1.1\r\n\r\n")]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, payload string, bytes int"), rows


@pytest.mark.parametrize("split", [37, 5000, warc.SPLIT_BYTES])
def test_records_are_read_once_whatever_the_ranges(spark, split):
    pages, rows = pages_frame(spark)
    files = warc.write_archives(pages.repartition(2), new_path(spark, "warc-test"))
    files.cache()
    got = warc.read_archives(files, split).collect()
    assert len(got) == len(rows)
    of = lambda x: x.split("page:")[1][:-1]
    last = {h: max(i for i, _, x in rows if x == h and i is not None) for h in {r[2] for r in rows if r[2] and len(r[2].encode()) >= 1000}}
    for r in got:
        page = of(r.record_id)
        html = next((h or "") for i, _, h in rows if str(i) == page or (i is None and page == "none"))
        want = "revisit" if html in last and str(last[html]) != page else "response"
        assert r.record_type == want and r.payload_bytes == len(html.encode())
        assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert (bytes(r.payload) == html.encode()) if want == "response" else (r.payload is None and of(r.refers_to) == str(last[html]))
    files.unpersist()


def test_archives_are_gzip_members_of_warc_records(spark):
    pages, rows = pages_frame(spark)
    paths = [r.path for r in warc.write_archives(pages.coalesce(1), new_path(spark, "warc-gz")).collect()]
    data = b"".join(gzip.open(p.removeprefix("file:")).read() for p in paths)
    assert data.startswith(b"WARC/1.1\r\n") and data.count(b"WARC-Record-ID: <urn:page:") == len(rows)


@given(st.lists(st.binary(max_size=60), max_size=8), st.integers(1, 90))
@settings(max_examples=100, deadline=None)
def test_ranges_own_members_that_start_inside(payloads, split):
    data = b"".join(warc.member({"WARC-Type": "response"}, warc.MAGIC + p) for p in payloads)
    read = lambda at, n: data[at : at + n]
    found = [warc.parse_record(r)[1] for start in range(0, len(data), split) for _, r in warc.members_in(read, start, min(len(data), start + split))]
    assert found == [warc.MAGIC + p for p in payloads]


@pytest.mark.parametrize("split", [1, 7, 50, 113, 1000])
def test_members_that_records_store_are_no_records(split):
    inner = b"".join(warc.member({"WARC-Type": "response"}, bytes([k]) * 9) for k in range(warc.CHAIN - 1))

    def plain(headers, body):  # a member that stores its record uncompressed
        squeeze = zlib.compressobj(0, zlib.DEFLATED, 31)
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(body)}\r\n\r\n"
        return squeeze.compress(head.encode() + body + b"\r\n\r\n") + squeeze.flush()

    bodies = [b"first", inner, b"middle" * 30, inner * 1, b"last"]
    data = b"".join(plain({"WARC-Type": "response"}, b) for b in bodies)
    read = lambda at, n: data[at : at + n]
    found = [warc.parse_record(r)[1] for start in range(0, len(data), split) for _, r in warc.members_in(read, start, min(len(data), start + split))]
    assert found == bodies


def test_warc_query_against_brute_force(spark, sf_dir):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    last: dict = {}
    for i, h in pages:
        if len(h) >= 1000:
            last[h] = max(i, last.get(h, i))
    want = sorted((i, len(h), hashlib.sha1(h).hexdigest(), *(("response", None) if last.get(h, i) == i else ("revisit", last[h]))) for i, h in pages)
    assert sorted(tuple(r) for r in warc.op10_warc(spark, sf_dir).collect()) == want
    empty = spark.read.parquet(f"{sf_dir}/pages.parquet").where("false")
    assert warc.read_archives(warc.write_archives(empty, new_path(spark, "warc-empty"))).count() == 0


# ---- Nearest neighbours


def test_neighbours_against_brute_force(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    rows = spark.read.parquet(f"{big}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got: dict = {}
    for r in ann.op9_ann(spark, big).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == {i for i in ids.tolist() if i % 20 == 0}
    found = 0
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21))
        assert [(-s, v) for _, v, s in hits] == sorted((-s, v) for _, v, s in hits)
        scores = x @ x[ids == q][0]
        assert all(abs(s - scores[ids == v][0]) < 1e-12 for _, v, s in hits)
        best = [int(ids[i]) for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        found += len(set(best) & {v for _, v, _ in hits})
    assert found >= 0.9 * 20 * len(got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.5, 0.5], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (None, [1.0, 1.0], 1), (9, [1.0], 1), (20, [-3.0, 0.0], 1), (3, [0.5, 0.5], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int")
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.5), (0, 4, 3, 0.5), (0, 5, 20, -3.0), (20, 1, 3, -1.5), (20, 2, 3, -1.5), (20, 3, 0, -3.0), (20, 4, 1, -3.0), (20, 5, 2, -3.0)]
    assert ann.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_blocks_change_no_result_of_small_tables(spark, monkeypatch):
    x = np.random.default_rng(1).standard_normal((300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    one = sorted(map(tuple, ann.nearest(df, F.col("vec_id") < 30, k=5).collect()))
    monkeypatch.setattr(ann, "BLOCK", 40)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    many = sorted(map(tuple, ann.nearest(df, F.col("vec_id") < 30, k=5).collect()))
    truth = x @ x[:30].T
    exact = {(q, int(i)) for q in range(30) for i in [j for j in np.argsort(-truth[:, q]) if j != q][:5]}
    assert len({r[:1] + r[2:3] for r in one} & exact) >= 0.9 * len(exact)
    assert len({r[:1] + r[2:3] for r in many} & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("norms", ["one long vector", "lognormal"])
def test_recall_on_unequal_norms(spark, norms):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "lognormal":
        x *= rng.lognormal(0, 0.5, len(x))[:, None]
    else:
        x[4321] *= 10
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") < 60).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = [len(got[q] & set([i for i in np.argsort(-(x @ x[q]), kind="stable").tolist() if i != q][:20])) for q in range(60)]
    assert sum(found) >= 0.9 * 20 * 60 and min(found) >= 10


# ---- Shared folder and pipeline


def test_the_shared_folder_is_the_session_s(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert new_path(spark, "x").startswith(shared_dir(spark))


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as pipeline
    from groupwise.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before = docs
    out = {}
    for name, stage in pipeline.STAGES:
        after = stored(stage(spark, before, sf_dir), name)
        if name != "packing":
            assert after.columns == docs.columns
        out[name], before = after, after
    kept = {r.doc_id for r in out["quality"].collect()}
    wrong = [d for d, q in labels.items() if (d in kept) != bool(q)]
    assert len(wrong) <= 0.05 * len(labels)
    lined = {r.doc_id: r.text for r in out["line_dedup"].collect()}
    assert lined.keys() <= kept and all(lined.values())
    near = {r.doc_id for r in out["near_duplicates"].collect()}
    assert near <= lined.keys() and {r.doc_id for r in out["secrets"].collect()} == near
    assert {r.doc_id for r in out["packing"].collect()} == near
    assert not out["secrets"].where("n_chars <> length(text)").count()
