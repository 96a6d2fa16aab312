"""SimHash fingerprints and their links against brute force, with hot buckets and odd texts."""

import random
import re

import numpy as np
import pytest
import xxhash

from groupwise.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(nodes):
    """Least id by fingerprint, for (id, fingerprint) pairs."""
    fps = sorted({f for _, f in nodes})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[root(b)] = root(a)
    least = {}
    for d, f in nodes:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return {f: least.get(root(f)) for f in fps}


TEXTS = [None, "", " \t\n", "one", "One two THREE", "a b c d", "a b c d e f g", "x " * 300, "É é Ä ä ß A", "a b c\x1cd e f", "a\x0bb\x0cc\rd\te", "\U0001f600 b c d e", "w" * 5000 + " b c d"]


@pytest.mark.parametrize("stretch", [1, 3, 50, simhash.STRETCH])
def test_fingerprints(monkeypatch, stretch):
    monkeypatch.setattr(simhash, "STRETCH", stretch)
    rnd = random.Random(stretch)
    texts = TEXTS + [" ".join(rnd.choice(["ab", "Cd", "é", "x", "longer-word"]) for _ in range(rnd.randrange(60))) for _ in range(60)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def noisy(rnd, base, most):
    for b in rnd.sample(range(64), rnd.randrange(most + 1)):
        base ^= 1 << b
    return base


@pytest.mark.parametrize(("n", "queries", "radius"), [(1, 5, 4), (64, 64, 4), (65, 3, 4), (1000, 200, 4), (300, 100, 0), (300, 100, 3), (300, 100, 7)])
def test_planes_find_all_pairs_within_the_radius(monkeypatch, n, queries, radius):
    rnd = random.Random(n + radius)
    bases = [rnd.getrandbits(64) for _ in range(4)]
    draw = lambda: noisy(rnd, rnd.choice(bases), 8) if rnd.random() < 0.6 else rnd.getrandbits(64)
    fps, asked = [draw() for _ in range(n)], [draw() for _ in range(queries)] + [0, (1 << 64) - 1]
    want = {(i, j) for i, q in enumerate(asked) for j, f in enumerate(fps) if (q ^ f).bit_count() <= radius}
    for cells in (simhash.CELLS, 7):
        monkeypatch.setattr(simhash, "CELLS", cells)
        i, j = simhash.within(simhash.planes_of(np.array(fps, np.uint64)), n, np.array(asked, np.uint64), radius)
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize(("n", "tables"), [(0, 5), (1000, 5), (10**7, 15), (10**9, 35), (10**11, 70)])
def test_tables_lose_no_pair(n, tables):
    masks = simhash.segments(n)
    assert len(masks) == tables
    rnd = random.Random(n)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), 4):
            b ^= 1 << bit
        assert any((a ^ b) & m == 0 for m in masks)


def signed(f):
    return f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize(("block", "bucket"), [(4096, 64), (8, 64), (8, 1 << 40), (64, 0)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(simhash, "BLOCK", block)
    if bucket == 0:  # finer keys than so few need
        finer = simhash.segments(10**9)
        monkeypatch.setattr(simhash, "segments", lambda n: finer)
    else:
        monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(block)
    bases = [rnd.getrandbits(64) for _ in range(3)] + [0, (1 << 64) - 1]
    fps = [noisy(rnd, rnd.choice(bases), 9) for _ in range(500)] + [rnd.getrandbits(64) for _ in range(200)] + bases
    chain = rnd.getrandbits(64)
    for bit in range(0, 40, 4):  # each is linked with the next alone
        chain ^= 0xF << bit
        fps.append(chain)
    counted = [(signed(f), fps.count(f)) for f in set(fps)]
    found = simhash.links(spark.createDataFrame(counted, "fp long, copies long")).collect()
    parent = {f: f for f, _ in counted}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for r in found:
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4
        parent[root(r.a)] = root(r.b)
    want = brute_groups([(f, f) for f in set(fps)])
    mine = {}
    for f in set(fps):
        mine.setdefault(root(signed(f)), set()).add(f)
    theirs = {}
    for f, least in want.items():
        theirs.setdefault(least, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def check(rows, got):
    fps = {t: brute_fingerprint(t) for t in {t for _, t in rows}}
    least = brute_groups([(d, fps[t]) for d, t in rows])
    key = lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2]))
    want = sorted(((d, f"{fps[t]:016x}", least[fps[t]]) for d, t in rows), key=key)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == want


def test_query_on_whole_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(rows, simhash.op12_simhash(spark, sf_dir).collect())


def test_odd_documents(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (3, "other words of one id"), (None, "null id alone here"), (None, "one")]
    for g in range(6):
        base = [rnd.choice(words) for _ in range(200)]
        for k in range(12):
            rows.append((100 + 20 * g + k, " ".join(base[: 200 - rnd.randrange(3)] + ["x"] * rnd.randrange(3))))
    rows += [(1000 + i, "the same text for very many of all rows") for i in range(200)]
    frame = spark.createDataFrame([(d, t, 7, "clash", 1, 2) for d, t in rows], "doc_id long, text string, fp int, component string, first int, copies int").repartition(6)
    check(rows, simhash.simhash_groups(frame).collect())
    assert simhash.simhash_groups(frame.where("false")).collect() == []
