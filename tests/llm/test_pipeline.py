"""The corpus pipeline and the quality query against versions of them without Spark."""

import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from groupwise.llm import lines, quality, secrets
from test_text_operators import brute_components, edit_distance

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, p double, spans string, keep string, score int, __x string"


def judged(rows, labels):
    """(p, score) of each (doc_id, text, host, path) row, by the same features and fit, with sums made anew."""
    label = {}
    for d, q in labels:
        if d is not None and q is not None:
            label.setdefault(d, []).append(q)
    label = {d: sum(q) / len(q) for d, q in label.items()}
    x = [quality.features(np.frombuffer((t or "").encode(), np.uint8)) for _, t, _, _ in rows]
    shown = [i for i, r in enumerate(rows) if r[0] in label]
    model = quality.fit_logistic(np.array([x[i] for i in shown]).reshape(-1, quality.N_FEATURES), np.array([label[rows[i][0]] for i in shown]))
    p = [float(model.probability(v[None])[0]) for v in x]
    own = [label.get(r[0], q) for r, q in zip(rows, p, strict=True)]
    host, path = {}, {}
    for (_, _, h, l), g in zip(rows, own, strict=True):
        for table, key in ((host, h), (path, (h, l))):
            n, good = table.get(key, (0, 0.0))
            table[key] = n + 1, good + g
    total, n = sum(own), len(own)
    rate = total / n

    def strength(level):
        big = [(g / k, 1 / k) for k, g in level.values() if k >= 20]
        spread = rate * (1 - rate)
        if len(big) < 2 or spread <= 0:
            return quality.STRENGTH
        true = max(1e-6, np.var([r for r, _ in big], ddof=1) - spread * np.mean([i for _, i in big]))
        return float(np.clip(spread / true - 1, *quality.STRENGTH_BOUNDS))

    at_host, at_path = strength(host), strength(path)
    logit = lambda v: np.log((w := min(max(v, 1e-6), 1 - 1e-6)) / (1 - w))
    out = []
    for (_, _, h, l), q, g in zip(rows, p, own, strict=True):
        base = (total - g) / (n - 1)
        of_host = (host[h][1] - g + base * at_host) / (host[h][0] - 1 + at_host)
        of_path = (path[h, l][1] - g + of_host * at_path) / (path[h, l][0] - 1 + at_path)
        out.append((q, 1 / (1 + np.exp(-(logit(q) + logit(of_path) - logit(base))))))
    return out


def test_quality_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    want = {r[0]: v for r, v in zip(docs, judged(docs, labels), strict=True)}
    for r in quality.op6_quality(spark, sf_dir).collect():
        assert (r.p, r.score) == pytest.approx(want[r.doc_id], abs=2e-6)
        assert r.keep == (want[r.doc_id][1] >= quality.KEEP_FROM)


def fixture_rows():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(3, 9)))
    line = lambda: " ".join(word() for _ in range(draw.randrange(5, 12))).capitalize() + "."
    texts = ["\n".join(line() for _ in range(draw.randrange(2, 6))) for _ in range(40)]
    for t in texts[:8]:  # near copies, line by line changed beyond two edits
        texts.append("\n".join(x.replace(" ", " also ", 1) if k == 0 else x + " Indeed so." for k, x in enumerate(t.split("\n"))))
    texts += [texts[3], texts[4] + "\n" + line(), "key = aB3xK9pQ7mZ2vL5nR8tY1wC4hJ6fD0sG and password: hunter2222", "", "   ", "BUY!! NOW!! CHEAP!! " * 20, "x%%% y### z&&& " * 30]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, line()), (7, texts[7]), (7, texts[7]), (None, line()), (None, texts[9] + " More."), (90, None)]
    return rows


def dropped_lines(rows):
    """(id, line number, line) of dropped lines."""
    every = {(d, i, x.strip(" ")) for d, t in rows for i, x in enumerate((t or "").split("\n"))}
    first = {}
    for d, i, x in every:
        if len(x) >= lines.LEAST_CHARS:
            first[x] = min(first.get(x, (True, 10**9, 0)), (d is None, d or 0, i))
    near = {b for b in first if any(a != b and abs(len(a) - len(b)) <= lines.EDITS and first[a] < first[b] and edit_distance(a, b) <= lines.EDITS for a in first)}
    return {(d, i, x) for d, i, x in every if x in near or (x in first and first[x] != (d is None, d or 0, i))}


def brute_pipeline(rows, labels):
    """(doc_id, text) that reach the secret scan, by the stages' docstrings."""
    scores = judged([(d, t, "s", "en") for d, t in rows], labels)
    rows = [r for r, (_, s) in zip(rows, scores, strict=True) if s >= quality.KEEP_FROM]
    dropped, out = dropped_lines(rows), []
    for d, t in rows:
        new = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i, x.strip(" ")) not in dropped)
        if t is None or not t.strip(" ") or new.replace("\n", "").strip(" "):
            out.append((d, new))
    texts = list(dict.fromkeys(r for r in out if (r[1] or "").split()))
    groups = {}
    for n, _, component in brute_components(list(enumerate(t for _, t in texts))):
        groups.setdefault(component, []).append((texts[n][0] is None, texts[n][0] or 0, texts[n]))
    for g in groups.values():
        assert len({x[:2] for x in g}) == len(g)  # ties by the text's hash are not planted
    return [min(g)[2] for g in groups.values()] + [r for r in out if not (r[1] or "").split()]


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as pipeline

    rows = fixture_rows()
    labels = [(d, int("!!" not in (t or "") and "%%%" not in (t or ""))) for d, t in rows if d is not None and d % 2 == 0] + [(53, 0), (54, 0), (55, 0), (None, 1)]
    sf = str(tmp_path)
    spark.createDataFrame([(d, t, "en", "s", len(t or ""), 0.5, "S", "K", 7, "x") for d, t in rows], COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    after = docs
    for _, stage in pipeline.STAGES[:3]:
        after = stage(spark, after, sf)
        assert after.schema.names == docs.columns
    want = brute_pipeline(rows, labels)
    got = after.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
    assert all((r.spans, r.keep, r.score, r["__x"], r.p) == ("S", "K", 7, "x", 0.5) for r in got)
    clean = pipeline.secrets(spark, after, sf)
    assert clean.columns == docs.columns
    texts = {(r.doc_id, r.text) for r in clean.collect()}
    assert any("[SECRET] and [SECRET]" in (t or "") for _, t in texts) and not any("hunter2222" in (t or "") for _, t in texts)
    assert {(d, t) for d, t in want if not secrets_in(t)} <= texts and len(texts) == len(set(want))
    assert not clean.where("n_chars <> length(text)").count()
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    run = pipeline.run(spark, sf)
    totals = sorted((str(r.doc_id), r.n) for r in run.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect())
    by_doc = {}
    for r in clean.collect():
        by_doc.setdefault((str(r.doc_id), ids(r.text)), []).append(ids(r.text))
    assert totals == sorted((d, sum(n)) for (d, _), n in by_doc.items())


def secrets_in(text):
    import re

    return text is not None and ("password" in text or re.search(secrets.CANDIDATE, text))


@pytest.mark.parametrize("stage", ["quality", "line_dedup", "near_duplicates", "secrets"])
def test_stages_on_odd_tables(spark, sf_dir, stage):
    import corpus_pipeline as pipeline

    run = dict(pipeline.STAGES)[stage]
    rows = [(1, None, None, None), (1, None, None, None), (None, "", "en", "s"), (2, "word " * 50_000, "en", "s"), (3, "One plain sentence stands here alone.", "en", "s")]
    bare = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = run(spark, bare, sf_dir)
    assert got.columns == bare.columns and {r.doc_id for r in got.collect()} <= {1, 2, 3, None}
    if stage != "quality":
        assert got.count() == (5 if stage != "near_duplicates" else 5)
    clashing = ("__name", "__check", "__of", "key", "group", "first", "rows", "spans", "base_spans", "n", "h", "doc", "__had", "__extra", "keep", "p")
    wide = bare.selectExpr("*", *(f"'own' AS `{c}`" for c in clashing))
    more = run(spark, wide, sf_dir)
    assert more.columns == wide.columns and sorted(map(str, (r.doc_id for r in more.collect()))) == sorted(map(str, (r.doc_id for r in got.collect())))
    assert all(r[c] == "own" for r in more.collect() for c in clashing)
    assert run(spark, bare.where("false"), sf_dir).columns == bare.columns
    assert run(spark, bare.where("false"), sf_dir).count() == 0
