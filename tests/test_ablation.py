"""Documents of groups, queries drawn from them, and what retrievers find, against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from groupwise.operators import ablation

FIELDS = "doc string, names array<string>, rows long, per_100 double, three double, rim double, mid double, level string, below_floor boolean, tags array<string>, archetypes array<string>"
KINDS = ("perimeter scorer", "interior big", "balanced wing")


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(4)
    people = [f"Mabel{chr(97 + i)} Tovar" for i in range(9)]
    rows = [
        (f"d{i:02}", rnd.sample(people, 4), 50 + i, 90.0 + i, 0.4, 0.3, 0.2, rnd.choice(["in the top quintile", "in the bottom quintile"]), i % 2 == 0, rnd.sample(["three-heavy", "balanced"], rnd.randint(1, 2)), rnd.sample(KINDS, 2))
        for i in range(40)
    ] + [("lone", ["Only One"], 60, 1.0, 0.1, 0.1, 0.1, "in the top quintile", True, ["balanced"], []), ("none", None, 60, 1.0, 0.1, 0.1, 0.1, None, True, None, None)]
    return rows, spark.createDataFrame(rows, FIELDS).repartition(3)


def test_documents(spark):
    possessions = [("a", 1, 2020, [3, 1, 2], 2)] * 6 + [("b", 1, 2020, [4, 5, 6], 1)] * 5 + [("c", 1, 2020, [1, 5, 6], 3)] * 4 + [(None, 1, 2020, [1, 2, 3], 3)] * 9 + [("z", 1, 2020, [7, 8, 9], 0)] * 5
    shots = [("a", 1, "top_three")] * 6 + [("a", 2, "restricted_area")] * 4 + [("b", 4, "mid_top")] * 2 + [(None, 1, "mid_top"), ("a", None, "mid_wing")]
    names = [(1, "One"), (3, "Three"), (4, None)]
    got = ablation.lineup_documents(spark.createDataFrame(possessions, "key string, team int, season int, members array<int>, points int"), spark.createDataFrame(shots, "key string, shooter int, zone_id string"), spark.createDataFrame(names, "member int, name string"), 5, 6, 4)
    by = {r.key: r for r in got.collect()}
    assert sorted(by) == ["a", "b"]  # c has too few possessions, z no shots
    a, b = by["a"], by["b"]
    assert (a.doc, a.names, a.rows, a.points, a.per_100, a.below_floor) == ("a:1:2020", ["Three", "One", "2"], 6, 12, 200.0, False)
    assert (round(a.three, 6), round(a.rim, 6), round(a.mid, 6)) == (round(6 / 11, 6), round(4 / 11, 6), round(1 / 11, 6)) and a.tags == ["three-heavy", "rim-pressuring"]
    assert a.archetypes == ["balanced wing", "perimeter scorer", "interior big"]
    assert (b.names, b.archetypes, b.below_floor, b.tags) == (["4", "5", "6"], ["balanced wing"], True, ["mid-range-reliant"])
    assert a.level == "above the league median" and b.level == "below the league median"  # z, without shots, still lies below both
    assert ablation.lineup_documents(spark.createDataFrame([], "key string, team int, season int, members array<int>, points int"), spark.createDataFrame(shots, "key string, shooter int, zone_id string"), spark.createDataFrame(names, "member int, name string")).count() == 0


def test_facts(spark, docs):
    one = docs[1].where("doc = 'd03'").withColumn("key", F.lit("k"))
    shots = spark.createDataFrame([("k", "mid_top")] * 2 + [("k", "top_three"), ("other", "mid_top"), (None, "mid_top")], "key string, zone_id string")
    got = {r.fact: r.value for r in ablation.facts(one, shots).collect()}
    zones = {k: v for k, v in got.items() if k.startswith("share_")}
    assert len(zones) == 9 and sum(v == 0 for v in zones.values()) == 7
    assert {k: v for k, v in got.items() if v or k not in zones} == {"possessions": 53.0, "points_per_100": 93.0, "three_rate": 0.4, "rim_rate": 0.3, "mid_rate": 0.2, "share_mid_top": 0.6667, "share_top_three": 0.3333}


def test_named(spark):
    rows = spark.createDataFrame([("x", [5, 1, 5]), ("y", [9])], "k string, m array<int>")
    got = ablation.named(rows, "k", "m", spark.createDataFrame([(1, "One"), (5, "Five")], "member int, name string"))
    assert {r.k: r.names for r in got.collect()} == {"x": ["Five", "One", "Five"], "y": ["9"]}


def test_queries_name_what_their_documents_hold(spark, docs):
    rows, df = docs
    asked, relevant = ablation.generated_queries(df, 3, 10)
    found = {}
    for r in relevant.collect():
        found.setdefault(r.query, set()).add(r.doc)
    asked = {r.query: r for r in asked.collect()}
    assert set(asked) == set(found) and {r.kind for r in asked.values()} == {"players", "style", "composite"}
    held = {r[0]: {*(r[1] or []), *(r[9] or []), *(r[10] or []), r[7]} for r in rows}
    for q, r in asked.items():
        text = {"players": r"group with (.*) and (.*)", "style": r"(.*) group with a (.*)", "composite": r"group with a (.*), (.*)"}[r.kind]
        wanted = set(re.fullmatch(text, r.text).groups())
        assert found[q] == {d for d, h in held.items() if wanted <= h}
    players = [q for q, r in asked.items() if r.kind == "players"]
    assert 9 <= len(players) <= 10 and all(q.split(":")[1] in found[q] for q in players)
    again, _ = ablation.generated_queries(df.repartition(7), 3, 10)
    assert {r.query: r for r in again.collect()} == asked
    other, _ = ablation.generated_queries(df, 4, 10)
    assert {r.query for r in other.collect()} != set(asked)
    few, none = ablation.generated_queries(df.limit(19), 3)
    assert few.count() == none.count() == 0


def test_documents_alike_are_scored_once(spark, docs):
    asked, _ = ablation.generated_queries(docs[1], 3, 4)
    copies = docs[1].crossJoin(spark.range(7)).withColumn("doc", F.concat_ws(":", "doc", "id")).drop("id")
    few, many = (ablation._bm25_classes(ablation.corpora(df), asked)[1].count() for df in (docs[1], copies))
    assert few == many > 0
    texts = ablation.corpora(copies)
    for depth in (3, 100):
        by_document = ablation.first_ranks(ablation.corpora_bm25(texts, asked), depth)
        assert {tuple(r) for r in ablation.bm25_ranks(texts, asked, depth).collect()} == {tuple(r) for r in by_document.collect()}


def test_bm25_by_corpus_and_means(spark, docs):
    rows, df = docs
    asked, relevant = ablation.generated_queries(df, 3, 10)
    texts = ablation.corpora(df)
    ranked = ablation.first_ranks(ablation.corpora_bm25(texts, asked), 100).collect()
    got = {}
    for r in ranked:
        got.setdefault((r.corpus, r.query), []).append((r["rank"], r.doc))
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    queries, wanted = {r.query: r for r in asked.collect()}, {}
    for r in relevant.collect():
        wanted.setdefault(r.query, set()).add(r.doc)
    recalls = {}
    for corpus in ("events", "numbers", "full"):
        held = {r.doc: words(r.text) for r in texts.where(f"corpus = '{corpus}'").collect()}
        mean, n = sum(map(len, held.values())) / len(held), len(held)
        assert n == len(rows)
        for q, r in queries.items():
            scores = {}
            for t in words(r.text):
                df_ = sum(t in w for w in held.values())
                for d, w in held.items():
                    if t in w:
                        tf = w.count(t)
                        scores[d] = scores.get(d, 0.0) + math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
            order = sorted(scores, key=lambda d: (-round(scores[d], 9), d))
            assert [d for _, d in sorted(got.get((corpus, q), []))] == order[:100]
            recalls.setdefault(corpus, []).append(len(set(order[:10]) & wanted[q]) / min(10, len(wanted[q])))
    one = spark.createDataFrame([(r.corpus, "bm25", r.query, r.doc, r["rank"]) for r in ranked], "corpus string, retriever string, query string, doc string, rank int")
    means = {(r.corpus, r.kind): r for r in ablation.ablation(one, asked, relevant).collect()}
    for corpus, values in recalls.items():
        r = means[(corpus, "all")]
        assert r.n == len(queries) and r.recall == pytest.approx(sum(values) / len(values)) and 0 <= r.ndcg <= 1 and 0 <= r.mrr <= 1
    assert means[("full", "all")].recall > means[("numbers", "all")].recall
    assert sum(means[("full", k)].n for k in ("players", "style", "composite")) == len(queries)


def test_rankings_hold_every_leg(docs):
    asked, relevant = ablation.generated_queries(docs[1], 3, 4)
    ranked = ablation.rankings(ablation.corpora(docs[1]), asked, depth=12, k=6, iterations=3).collect()
    legs = {}
    for r in ranked:
        legs.setdefault((r.corpus, r.query, r.retriever), {})[r.doc] = r["rank"]
    assert {k[2] for k in legs} == set(ablation.RETRIEVERS) and all(sorted(v.values()) == list(range(1, len(v) + 1)) and len(v) <= 12 for v in legs.values())
    for (corpus, q, leg), places in legs.items():
        if leg == "rrf":
            score = {}
            for other in ("bm25", "lsa"):
                for d, p in legs.get((corpus, q, other), {}).items():
                    score[d] = score.get(d, 0) + 1 / (60 + p)
            assert sorted(places, key=places.get) == sorted(score, key=lambda d: (-round(score[d], 9), d))[:12]
