"""Latent semantic analysis against numpy's SVD."""

import random

import numpy as np
import pytest

from groupwise.operators import latent


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(6)
    topics = [[f"t{k}w{i}" for i in range(8)] for k in range(4)]
    docs = [(d, " ".join(rnd.choice(topics[d % 4]) if rnd.random() < 0.8 else f"common{rnd.randrange(5)}" for _ in range(30))) for d in range(60)] + [(98, None), (99, "alone")]
    return docs, spark.createDataFrame(docs, "doc long, text string").repartition(3)


def dense(rows):
    terms, docs = (sorted({r[i] for r in rows}) for i in (0, 1))
    a = np.zeros((len(docs), len(terms)))
    for t, d, w in rows:
        a[docs.index(d), terms.index(t)] = w
    return a, docs, terms


def test_singular_values_are_numpy_s(corpus):
    rows, _ = latent.weights(corpus[1], "doc", "text")
    a, _, terms = dense([tuple(r) for r in rows.select("term", "doc", "w").collect()])
    assert np.allclose((a**2).sum(axis=1), 1)
    got = latent.truncated_svd(rows, 5, iterations=20)
    want = np.linalg.svd(a, compute_uv=False)[:5]
    assert np.allclose(got.values, want, atol=1e-6)
    v = {r.term: r.v for r in got.terms.collect()}
    m = np.array([v[t] for t in terms])
    assert np.allclose(m.T @ m, np.eye(5), atol=1e-8) and np.allclose(np.linalg.norm(a @ m, axis=0), want, atol=1e-6)


def test_scores(spark, corpus):
    asked = spark.createDataFrame([(1, "t0w0 t0w1 t0w2"), (2, "t3w5 t3w5 common1"), (3, "unknown words")], "q long, words string")
    got = latent.lsa_scores(corpus[1], asked, "doc", "text", "q", "words", k=4, top=10, iterations=10).collect()
    by = {q: sorted((r for r in got if r.query == q), key=lambda r: -r.score) for q in (1, 2, 3)}
    assert len(by[1]) == len(by[2]) == 10 and not by[3]
    assert all(r.doc % 4 == 0 for r in by[1]) and all(r.doc % 4 == 3 for r in by[2]) and by[1][0].score > 0.9
    assert latent.lsa_scores(corpus[1].where("false"), asked, "doc", "text", "q", "words", k=4).count() == 0


def test_a_step_moves_blocks_by_terms_and_is_exact(spark, corpus):
    docs = spark.createDataFrame([(d, " ".join(f"w{(d * i) % 13}" for i in range(40))) for d in range(600)], "doc long, text string")
    rows, _ = latent.weights(docs, "doc", "text")
    a, _, terms = dense([tuple(r) for r in rows.select("term", "doc", "w").collect()])
    blocks, idf = latent.text_blocks(docs, "doc", "text")
    vectors = idf.select("term", latent.F.array(latent.F.length("term").cast("double"), latent.F.col("idf")).alias("v"))
    assert latent._sent(blocks, vectors).count() <= blocks.parts * len(terms) < rows.count()
    v = {r.term: r.v for r in vectors.collect()}
    x = a @ np.array([v[t] for t in terms])
    back, inner = latent._there_and_back(blocks, vectors, 2)
    found = {r.term: r.v for r in back.collect()}
    assert np.allclose(inner, x.T @ x) and np.allclose(np.array([found[t] for t in terms]), a.T @ x)
