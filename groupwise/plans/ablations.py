"""Queries of documents about groups, the queries drawn from them, and how they are found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupwise.functions import columns as C
from groupwise.operators import ablation
from groupwise.operators.sequence import kept
from groupwise.plans.registry import query, rounded
from groupwise.plans.roles import LINED_SQL, possessions, shots

#: Possessions of a document, and of one that may state a point estimate, at the size of the given tables' groups.
_LEAST, _FLOOR, _SEED = 12, 18, 7
_THREES = "('corner_three_left', 'corner_three_right', 'wing_three', 'top_three')"
_SHARES = f"""avg(CASE WHEN zone_id IN {_THREES} THEN 1.0 ELSE 0.0 END) AS three, avg(CASE WHEN zone_id IN ('restricted_area', 'paint_non_ra') THEN 1.0 ELSE 0.0 END) AS rim,
  avg(CASE WHEN zone_id IN ('mid_baseline', 'mid_wing', 'mid_top') THEN 1.0 ELSE 0.0 END) AS mid"""
_DOCS_SQL = f"""{LINED_SQL}, dp AS (SELECT own_key AS key, unit // 50 AS team, CASE WHEN year(played) < 1995 THEN 1 ELSE 2 END AS season, own, points FROM possessions),
dz AS (SELECT md5(array_to_string(own, ',')) AS key, shooter, CASE WHEN zone_id IN {_THREES} AND (game_id // 16) % 4 < shooter % 4 THEN 'restricted_area' ELSE zone_id END AS zone_id FROM ls),
dg AS (SELECT key, team, season, count(*) AS "rows", CAST(sum(points) AS BIGINT) AS points, min(own) AS members, 100.0 * sum(points) / count(*) AS per_100, concat_ws(':', key, team, season) AS doc FROM dp GROUP BY key, team, season HAVING count(*) >= {_LEAST}),
dl AS (SELECT *, (rank() OVER (ORDER BY round(per_100, 9)) - 1) / count(*) OVER () AS below FROM dg), dx AS (SELECT key, {_SHARES} FROM dz GROUP BY key),
da AS (SELECT shooter AS member, {_SHARES} FROM dz GROUP BY shooter HAVING count(*) >= 50),
dk AS (SELECT member, CASE WHEN three >= 0.45 AND rim <= 0.25 THEN 'perimeter scorer' WHEN rim >= 0.45 AND three <= 0.15 THEN 'interior big' WHEN three >= 0.35 AND rim >= 0.30 THEN 'stretch big' WHEN rim >= 0.38 THEN 'slashing guard' ELSE 'balanced wing' END AS kind FROM da),
de AS (SELECT doc, unnest(members) AS member, unnest(range(5)) AS seat FROM dg), dn AS (SELECT doc, seat, 'M' || translate(CAST(de.member AS VARCHAR), '0123456789', 'abcdefghij') || 'o Dabarelli' AS name, coalesce(kind, 'balanced wing') AS kind FROM de LEFT JOIN dk ON de.member = dk.member),
du AS (SELECT doc, list(name ORDER BY seat) AS names FROM dn GROUP BY doc), dr AS (SELECT doc, kind, min(seat) AS seat FROM dn GROUP BY doc, kind), dv AS (SELECT doc, list(kind ORDER BY seat) AS archetypes FROM dr GROUP BY doc),
docs AS (SELECT dl.doc, names, "rows", points, per_100, three, rim, mid, archetypes, "rows" < {_FLOOR} AS below_floor,
  CASE WHEN below >= 0.8 THEN 'in the top quintile' WHEN below >= 0.6 THEN 'above the league median' WHEN below >= 0.4 THEN 'around the league median' WHEN below >= 0.2 THEN 'below the league median' ELSE 'in the bottom quintile' END AS level,
  string_split(coalesce(nullif(concat_ws(',', CASE WHEN three >= 0.42 THEN 'three-heavy' END, CASE WHEN rim >= 0.34 THEN 'rim-pressuring' END, CASE WHEN mid >= 0.22 THEN 'mid-range-reliant' END), ''), 'balanced'), ',') AS tags
  FROM dl JOIN dx ON dl.key = dx.key JOIN du ON dl.doc = du.doc JOIN dv ON dl.doc = dv.doc)"""
_QUERIES_SQL = f"""{_DOCS_SQL}, ix AS (SELECT DISTINCT 'name' AS attribute, unnest(names) AS value, doc FROM docs UNION SELECT DISTINCT 'tag', unnest(tags), doc FROM docs UNION SELECT DISTINCT 'archetype', unnest(archetypes), doc FROM docs UNION SELECT 'level', level, doc FROM docs),
qp AS (SELECT 'players:' || doc AS query, 'players' AS kind, 'group with ' || names[1] || ' and ' || names[2] AS text, 'name' AS a1, names[1] AS v1, 'name' AS a2, names[2] AS v2 FROM docs ORDER BY md5('{_SEED}:players:' || doc), doc LIMIT 15),
vo AS (SELECT DISTINCT attribute, value FROM ix WHERE attribute <> 'name'), ki AS (SELECT unnest(['style', 'style', 'composite', 'composite']) AS kind, unnest(['tag', 'archetype', 'archetype', 'level']) AS attribute, unnest([0, 1, 0, 1]) AS place),
tr AS (SELECT kind, place, vo.attribute, draw, arg_min(value, md5('{_SEED}:' || kind || ':' || draw || ':' || vo.attribute || ':' || value)) AS value FROM vo JOIN ki ON vo.attribute = ki.attribute CROSS JOIN (SELECT unnest(range(15)) AS draw) d GROUP BY kind, place, vo.attribute, draw),
dd AS (SELECT kind, draw, max(CASE WHEN place = 0 THEN value END) AS v1, max(CASE WHEN place = 1 THEN value END) AS v2, max(CASE WHEN place = 0 THEN attribute END) AS a1, max(CASE WHEN place = 1 THEN attribute END) AS a2 FROM tr GROUP BY kind, draw),
aq AS (SELECT * FROM qp UNION ALL SELECT kind || ':' || draw AS query, kind, CASE WHEN kind = 'style' THEN v1 || ' group with a ' || v2 ELSE 'group with a ' || v1 || ', ' || v2 END AS text, a1, v1, a2, v2 FROM dd),
rel AS (SELECT query, kind, text, x.doc FROM aq JOIN ix x ON x.attribute = a1 AND x.value = v1 JOIN ix y ON y.attribute = a2 AND y.value = v2 AND y.doc = x.doc), aqk AS (SELECT DISTINCT query, kind, text FROM rel)"""


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Groups' documents from orders, and shots by group; members of some numbers take their threes at the rim in some games, so that groups differ."""
    rows = possessions(spark, sf_dir)
    season = F.when(F.year("played") < 1995, 1).otherwise(2)
    played = rows.select(F.col("own_key").alias("key"), F.expr("unit div 50").alias("team"), season.alias("season"), F.col("own").alias("members"), "points")
    taken = shots(spark, sf_dir).join(rows.select("game_id", "own", "own_key"), "game_id").select(F.col("own_key").alias("key"), F.get("own", F.col("shooter_id") % 5).alias("shooter"), "zone_id", "game_id")
    moved = F.col("zone_id").isin(*C.THREES) & (F.expr("(game_id div 16) % 4") < F.col("shooter") % 4)
    taken = taken.withColumn("zone_id", F.when(moved, "restricted_area").otherwise(F.col("zone_id")))
    people = played.select(F.explode("members").alias("member")).distinct()
    names = people.withColumn("name", F.concat(F.lit("M"), F.translate(F.col("member").cast("string"), "0123456789", "abcdefghij"), F.lit("o Dabarelli")))
    return ablation.lineup_documents(played, taken, names, _LEAST, _FLOOR), taken


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[0]


@query(f"""WITH {_DOCS_SQL} SELECT doc, array_to_string(names, ',') AS names, "rows", points, round(per_100, 6) AS per_100, round(three, 6) AS three, round(rim, 6) AS rim, round(mid, 6) AS mid, array_to_string(archetypes, ',') AS archetypes,
  array_to_string(tags, ',') AS tags, level, below_floor FROM docs""")
def lineup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, tags, archetypes and level of every group, team and season with enough possessions."""
    docs = _documents(spark, sf_dir).withColumns({c: F.array_join(c, ",") for c in ("names", "archetypes", "tags")})
    return rounded(docs.select("doc", "names", "rows", "points", "per_100", "three", "rim", "mid", "archetypes", "tags", "level", "below_floor"))


@query(f"""WITH {_DOCS_SQL}, zn AS (SELECT unnest([{', '.join(f"'{z}'" for z in C.ZONES)}]) AS zone), zs AS (SELECT key, zone, avg(CASE WHEN zone_id = zone THEN 1.0 ELSE 0.0 END) AS share FROM dz CROSS JOIN zn GROUP BY key, zone)
SELECT doc, 'possessions' AS fact, CAST("rows" AS DOUBLE) AS value FROM docs UNION ALL SELECT doc, 'points_per_100', round(per_100, 2) FROM docs UNION ALL SELECT doc, 'three_rate', round(three, 4) FROM docs
UNION ALL SELECT doc, 'rim_rate', round(rim, 4) FROM docs UNION ALL SELECT doc, 'mid_rate', round(mid, 4) FROM docs UNION ALL SELECT dg.doc, 'share_' || zone, round(share, 4) FROM zs JOIN dg ON dg.key = zs.key""")
def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure that a narrative about a document may state."""
    docs, taken = _parts(spark, sf_dir)
    return ablation.facts(kept(docs), taken)


@query(f"WITH {_QUERIES_SQL} SELECT query, kind, text, doc FROM rel")
def generated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries drawn from the documents' attributes, a row a relevant document."""
    asked, relevant = ablation.generated_queries(kept(_documents(spark, sf_dir)), _SEED)
    return asked.join(relevant, "query")


@query(rf"""WITH {_QUERIES_SQL}, pc AS (SELECT *, CAST(round_even(100 * three, 0) AS INT) AS pt, CAST(round_even(100 * rim, 0) AS INT) AS pr, CAST(round_even(100 * mid, 0) AS INT) AS pm, array_to_string(names, ', ') AS nm FROM docs),
sh AS (SELECT *, CASE WHEN three >= 0.45 THEN 'a heavy share' WHEN three >= 0.35 THEN 'an above-average share' WHEN three >= 0.22 THEN 'a modest share' ELSE 'a small share' END || ' (' || pt || '%)' AS s3,
  CASE WHEN rim >= 0.45 THEN 'a heavy share' WHEN rim >= 0.35 THEN 'an above-average share' WHEN rim >= 0.22 THEN 'a modest share' ELSE 'a small share' END || ' (' || pr || '%)' AS sr FROM pc),
co AS (SELECT 'events' AS corpus, doc, nm || ' three ' || pt || '% rim ' || pr || '% mid-range ' || pm || '%' AS text FROM sh
  UNION ALL SELECT 'numbers', doc, printf('group %s rows=%d per_100=%.2f three=%.4f rim=%.4f mid=%.4f', doc, "rows", per_100, three, rim, mid) FROM sh
  UNION ALL SELECT 'full', doc, concat_ws(' ', printf('%s were together for %d rows.', nm, "rows"), 'Roles: ' || array_to_string(archetypes, ', ') || '.', 'Style: ' || array_to_string(tags, ', ') || '.', printf('Worth %.1f per 100, %s.', per_100, level),
    s3 || ' from three, ' || sr || ' at the rim.', CASE WHEN below_floor THEN 'Below the reporting floor: a direction alone.' ELSE 'Enough for a point estimate.' END) FROM sh),
tk AS (SELECT corpus, doc, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM co), sz AS (SELECT corpus, count(*) AS n_docs, avg(len(w)) AS mean_length FROM tk GROUP BY corpus),
tt AS (SELECT corpus, doc, term, count(*) AS tf, max(length) AS length FROM (SELECT corpus, doc, len(w) AS length, unnest(w) AS term FROM tk) GROUP BY corpus, doc, term), tdf AS (SELECT corpus, term, count(*) AS df FROM tt GROUP BY corpus, term),
qt AS (SELECT query, term, count(*) AS times FROM (SELECT query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM aqk) GROUP BY query, term),
sc AS (SELECT tt.corpus, query, doc, sum(times * greatest(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) AS score
  FROM tt JOIN tdf ON tt.corpus = tdf.corpus AND tt.term = tdf.term JOIN qt ON qt.term = tt.term JOIN sz ON sz.corpus = tt.corpus GROUP BY tt.corpus, query, doc),
rk AS (SELECT *, row_number() OVER (PARTITION BY corpus, query ORDER BY round(score, 9) DESC, doc) AS place FROM sc), rn AS (SELECT query, kind, count(*) AS n_rel FROM rel GROUP BY query, kind),
ht AS (SELECT corpus, rk.query, count(CASE WHEN place <= 10 THEN 1 END) AS found, min(place) AS first, sum(CASE WHEN place <= 10 THEN 1 / log2(place + 1) ELSE 0 END) AS dcg FROM rk JOIN rel ON rel.query = rk.query AND rel.doc = rk.doc WHERE place <= 100 GROUP BY corpus, rk.query),
me AS (SELECT c.corpus, rn.query, kind, coalesce(found, 0) / least(n_rel, 10) AS recall, coalesce(1 / first, 0) AS mrr, coalesce(dcg, 0) / list_sum([1 / log2(i + 1) for i in range(1, least(n_rel, 10) + 1)]) AS ndcg FROM rn CROSS JOIN (SELECT DISTINCT corpus FROM rk) c LEFT JOIN ht ON ht.query = rn.query AND ht.corpus = c.corpus),
al AS (SELECT corpus, kind, recall, mrr, ndcg FROM me UNION ALL SELECT corpus, 'all', recall, mrr, ndcg FROM me)
SELECT corpus, 'bm25' AS retriever, kind, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM al GROUP BY corpus, kind""")
def keyword_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well BM25 finds relevant documents in three corpora of the same facts."""
    docs = kept(_documents(spark, sf_dir))
    asked, relevant = ablation.generated_queries(docs, _SEED)
    ranked = kept(ablation.bm25_ranks(ablation.corpora(docs), asked)).withColumn("retriever", F.lit("bm25"))
    return rounded(ablation.ablation(ranked, asked, relevant))


@query()
def retrieval_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well BM25, a latent space and both fused find relevant documents in three corpora of the same facts, by kind of query."""
    docs = kept(_documents(spark, sf_dir))
    asked, relevant = ablation.generated_queries(docs, _SEED)
    ranked = ablation.rankings(kept(ablation.corpora(docs)), asked, k=16, iterations=3)
    return rounded(ablation.ablation(ranked, asked, relevant))
