"""What of a document makes it found: documents of groups, queries whose relevant documents follow from their attributes, and how corpora and retrievers do on them.

Relevance is by construction: a query names two attributes, and the documents with both are relevant. It says whether facts that a query names are found,
which is less than what people would find relevant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groupwise.functions.columns import ZONES, tokens
from groupwise.operators import latent, metrics, narratives, retrieval
from groupwise.operators.sequence import kept, share_below

#: Queries of each kind, the least number of documents to ask about, and how many documents a ranking holds.
DRAWS, LEAST_DOCS, DEPTH = 15, 20, 100
RETRIEVERS = ("bm25", "lsa", "rrf")
#: Rows of a group for a document and for a point estimate, and attempts for a member's kind.
LEAST_ROWS, FLOOR_ROWS, LEAST_ATTEMPTS = 50, 200, 50
#: Fixed words: where a group's worth lies among all groups, by the share of them below it.
LEVELS = ((0.8, "in the top quintile"), (0.6, "above the league median"), (0.4, "around the league median"), (0.2, "below the league median"))
LOWEST, USUAL_KIND = "in the bottom quintile", "balanced wing"
_AT = {"three": ("corner_three_left", "corner_three_right", "wing_three", "top_three"), "rim": ("restricted_area", "paint_non_ra"), "mid": ("mid_baseline", "mid_wing", "mid_top")}


def _shares(counted: str = "__known") -> list[Column]:
    return [(F.sum(name) / F.nullif(F.sum(counted), F.lit(0))).alias(name) for name in _AT]


def _taken(shots: DataFrame) -> DataFrame:
    """(key, shooter, n, __known, three, rim, mid): shots, those of a known zone, and those at each place, counted once for all shares."""
    at = [F.count_if(F.col("zone_id").isin(*zones)).alias(name) for name, zones in _AT.items()]
    return kept(shots.groupBy("key", "shooter").agg(F.count("*").alias("n"), F.count("zone_id").alias("__known"), *at))


def named(rows: DataFrame, key: str, members: str, names: DataFrame) -> DataFrame:
    """(key, names): each distinct key's members by name (member, name), in their order; a member without a name goes by its id."""
    each = rows.select(key, F.posexplode(members).alias("at", "member")).join(names.select("member", "name"), "member", "left")
    said = F.struct("at", F.coalesce("name", F.col("member").cast("string")).alias("name"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["name"]).alias("names"))


def lineup_documents(possessions: DataFrame, shots: DataFrame, names: DataFrame, least: int = LEAST_ROWS, floor: int = FLOOR_ROWS, attempts: int = LEAST_ATTEMPTS) -> DataFrame:
    """A document a group, team and season with `least` possessions or more: doc, key, team, season, members, names, rows, points, per_100, three, rim, mid, level,
    below_floor (fewer than `floor` possessions), tags and archetypes.

    possessions are (key, team, season, members, points), a key standing for one set of members; shots (key, shooter, zone_id); names (member, name). Possessions
    without a key count nowhere. Shares are of all the group's shots, and a group without shots has no document, though its worth counts in what others are compared
    with. Archetypes are the members' kinds, each once, in the members' order; a member of fewer than `attempts` shots has the usual kind.
    """
    groups = possessions.where("key is not null").groupBy("key", "team", "season").agg(F.count("*").alias("rows"), F.sum("points").alias("points"), F.min("members").alias("members")).where(F.col("rows") >= least)
    worth = groups.withColumn("per_100", 100.0 * F.col("points") / F.col("rows")).withColumn("doc", F.concat_ws(":", "key", "team", "season"))
    level = F.lit(LOWEST)
    for from_, words in reversed(LEVELS):
        level = F.when(F.col("__below") >= from_, words).otherwise(level)
    placed = share_below(worth, "per_100", "doc", name="__below").withColumn("level", level).drop("__below")
    taken = _taken(shots)
    mix = taken.where("key is not null").groupBy("key").agg(*_shares())
    kinds = taken.where("shooter is not null").groupBy(F.col("shooter").alias("member")).agg(F.sum("n").alias("n"), *_shares()).where(F.col("n") >= attempts)
    kinds = kinds.select("member", narratives.archetype(F.col("three"), F.col("rim")).alias("kind"))
    each = placed.select("doc", F.posexplode("members").alias("at", "member")).join(names.select("member", "name"), "member", "left").join(kinds, "member", "left")
    told = F.struct("at", F.coalesce("name", F.col("member").cast("string")).alias("name"), F.coalesce("kind", F.lit(USUAL_KIND)).alias("kind"))
    people = each.groupBy("doc").agg(F.array_sort(F.collect_list(told)).alias("__m"))  # a group's members
    people = people.select("doc", F.transform("__m", lambda x: x["name"]).alias("names"), F.array_distinct(F.transform("__m", lambda x: x["kind"])).alias("archetypes"))
    tags = narratives.style_tags(F.col("three"), F.col("rim"), F.col("mid"))
    return placed.join(mix, "key").join(people, "doc").withColumns({"below_floor": F.col("rows") < floor, "tags": tags})


def facts(docs: DataFrame, shots: DataFrame) -> DataFrame:
    """(doc, fact, value): every figure of a document that a narrative may state, by name: possessions, points_per_100 (two digits), the three shares and that of each
    of the nine zones (four digits), 0 where its group took none. shots are (key, zone_id)."""
    own = (("possessions", F.col("rows").cast("double")), ("points_per_100", F.round("per_100", 2)), ("three_rate", F.round("three", 4)), ("rim_rate", F.round("rim", 4)), ("mid_rate", F.round("mid", 4)))
    stated = docs.select("doc", F.inline(F.array(*(F.struct(F.lit(n).alias("fact"), v.alias("value")) for n, v in own))))
    mix = shots.where("key is not null").groupBy("key").agg(*(F.avg((F.coalesce("zone_id", F.lit("")) == z).cast("double")).alias(z) for z in ZONES))
    each = F.inline(F.array(*(F.struct(F.lit(f"share_{z}").alias("fact"), F.round(z, 4).alias("value")) for z in ZONES)))
    return stated.unionByName(mix.join(docs.select("key", "doc"), "key").select("doc", each))


def attributes(docs: DataFrame) -> DataFrame:
    """(attribute, value, doc): the inverted index of documents' names, tags, archetypes and levels."""
    of = lambda attribute, values: F.transform(F.array_distinct(values), lambda x: F.struct(F.lit(attribute).alias("attribute"), x.alias("value")))
    every = F.concat(of("name", F.col("names")), of("tag", F.col("tags")), of("archetype", F.col("archetypes")), of("level", F.array("level")))
    return docs.select("doc", F.inline(F.filter(every, lambda x: x["value"].isNotNull())))


def _drawn(vocabulary: DataFrame, seed: int, draws: int) -> DataFrame:
    """(kind, draw, first, second): for each draw of a kind one value of each of its two attributes, that of the least seeded hash."""
    session = vocabulary.sparkSession
    kinds = session.createDataFrame([("style", 0, "tag"), ("style", 1, "archetype"), ("composite", 0, "archetype"), ("composite", 1, "level")], "kind string, place int, attribute string")
    tries = kinds.crossJoin(session.range(draws).withColumnRenamed("id", "draw"))  # four rows by draws
    chance = F.md5(F.concat_ws(":", F.lit(str(seed)), "kind", "draw", "attribute", "value"))
    one = vocabulary.join(F.broadcast(tries), "attribute").groupBy("kind", "draw", "place").agg(F.min_by("value", F.struct(chance, "value")).alias("value"))
    of = lambda place: F.max(F.when(F.col("place") == place, F.col("value")))
    return one.groupBy("kind", "draw").agg(of(0).alias("first"), of(1).alias("second"))


def generated_queries(docs: DataFrame, seed: int = 0, draws: int = DRAWS) -> tuple[DataFrame, DataFrame]:
    """((query, kind, text), (query, doc)): queries of three kinds, and each one's relevant documents, those with both attributes that it names.

    `players` names the first two members of `draws` documents drawn without replacement, `style` a tag and an archetype, `composite` an archetype and a level, each
    drawn anew. Draws follow seeded hashes, so they are the same whatever the partitions. What no document satisfies is no query, nor is a document of fewer than two
    names; fewer than LEAST_DOCS documents get none.
    """
    index = attributes(docs)
    if docs.limit(LEAST_DOCS).count() < LEAST_DOCS:
        index, docs = index.where("false"), docs.where("false")
    chance = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("players"), "doc"))
    people = docs.select("doc", F.get("names", F.lit(0)).alias("first"), F.get("names", F.lit(1)).alias("second"), chance.alias("h")).orderBy("h", "doc").limit(draws).where("first is not null and second is not null")
    pick = lambda kind, key, a, b, text: F.struct(F.concat_ws(":", F.lit(kind), key).alias("query"), F.lit(kind).alias("kind"), text.alias("text"), F.array_distinct(F.array(*(F.struct(F.lit(t).alias("attribute"), F.col(c).alias("value")) for t, c in ((a, "first"), (b, "second"))))).alias("wanted"))
    said = lambda *parts: F.concat(*(F.col(p) if p in ("first", "second") else F.lit(p) for p in parts))
    players = people.select(F.inline(F.array(pick("players", F.col("doc"), "name", "name", said("group with ", "first", " and ", "second")))))
    drawn = _drawn(index.where("attribute <> 'name'").select("attribute", "value").distinct(), seed, draws).where("first is not null and second is not null")
    style = drawn.where("kind = 'style'").select(F.inline(F.array(pick("style", F.col("draw"), "tag", "archetype", said("first", " group with a ", "second")))))
    composite = drawn.where("kind = 'composite'").select(F.inline(F.array(pick("composite", F.col("draw"), "archetype", "level", said("group with a ", "first", ", ", "second")))))
    asked = kept(players.unionByName(style).unionByName(composite))
    wanted = asked.select("query", F.size("wanted").alias("needed"), F.inline("wanted"))
    relevant = kept(index.join(F.broadcast(wanted), ["attribute", "value"]).groupBy("query", "doc", "needed").agg(F.count("*").alias("n")).where("n = needed").select("query", "doc"))  # two rows a query
    return asked.join(relevant.select("query").distinct(), "query", "left_semi").select("query", "kind", "text"), relevant


def corpora(docs: DataFrame) -> DataFrame:
    """(corpus, doc, text): each document in all variants."""
    texts = [narratives.rendered(docs, v).select(F.lit(v).alias("corpus"), "doc", "text") for v in narratives.VARIANTS]
    return texts[0].unionByName(texts[1]).unionByName(texts[2])


def _bm25_classes(texts: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((corpus, length, held, doc), (corpus, length, held, query, score)): what each document holds of the asked terms, and BM25 by what is held.

    Documents of a corpus that hold the same asked terms as often, and are as long, have one score. So only tokens of asked terms leave the texts' rows,
    once, dealt by document, and a score is computed once for all documents alike. A document is one row of a corpus.
    """
    counted = texts.select("corpus", "doc", tokens(F.coalesce("text", F.lit(""))).alias("t"))
    size = counted.groupBy("corpus").agg(F.count("*").alias("n_docs"), F.avg(F.size("t")).alias("mean_length"))
    terms = kept(asked.select("query", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times")))
    sent = F.broadcast if terms.count() <= retrieval.ASKED else lambda df: df
    words = counted.select("corpus", "doc", F.size("t").alias("length"), F.explode("t").alias("term")).join(sent(terms.select("term").distinct()), "term", "left_semi")
    tf = words.repartition("corpus", "doc").groupBy("corpus", "doc", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    docs = kept(tf.groupBy("corpus", "doc").agg(F.first("length").alias("length"), F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("held")))  # a document's asked terms
    classes = kept(docs.groupBy("corpus", "length", "held").agg(F.count("*").alias("docs")))
    each = classes.select("corpus", "length", "held", "docs", F.inline("held"))
    df = each.groupBy("corpus", "term").agg(F.sum("docs").alias("df"))
    joined = each.join(sent(df), ["corpus", "term"]).join(sent(terms), "term").join(F.broadcast(size), "corpus")  # a row a corpus
    return docs, joined.groupBy("corpus", "length", "held", "query").agg(F.sum(F.col("times") * retrieval.term_score()).alias("score"))


def corpora_bm25(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(corpus, query, doc, score): BM25 of each query in each corpus, of all documents that share a term with it."""
    docs, scores = _bm25_classes(texts, asked)
    return docs.join(scores, ["corpus", "length", "held"]).select("corpus", "query", "doc", "score")


def bm25_ranks(texts: DataFrame, asked: DataFrame, depth: int = DEPTH) -> DataFrame:
    """first_ranks of corpora_bm25, without a row for each document and query: a document among the first has fewer than `depth` classes of documents before it, and is among the first of its own."""
    docs, scores = _bm25_classes(texts, asked)
    alike = ["corpus", "length", "held"]
    better = F.rank().over(Window.partitionBy("corpus", "query").orderBy(F.desc(F.bround("score", 9))))
    best = kept(scores.withColumn("__rank", better).where(F.col("__rank") <= depth).drop("__rank"))
    place = F.row_number().over(Window.partitionBy(*alike).orderBy("doc"))
    firsts = docs.join(best.select(alike).distinct(), alike, "left_semi").withColumn("__place", place).where(F.col("__place") <= depth)
    return first_ranks(firsts.join(best, alike).select("corpus", "query", "doc", "score"), depth)


def first_ranks(scores: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(corpus, query, doc, rank) of each query's `depth` best by rounded score, ties to the lesser doc; the rest isn't ranked."""
    place = F.row_number().over(Window.partitionBy("corpus", "query").orderBy(F.desc(F.bround("score", 9)), "doc"))
    return scores.withColumn("rank", place).where(F.col("rank") <= depth).select("corpus", "query", "doc", "rank")


def rankings(texts: DataFrame, asked: DataFrame, depth: int = DEPTH, k: int = 32, iterations: int = 8) -> DataFrame:
    """(corpus, retriever, query, doc, rank): each query's best documents in each corpus by BM25, in a latent space of k directions, and by both fused.

    A latent space is fitted per corpus. Documents beyond `depth`, and those that share no term with a query, are not ranked.
    """
    legs = {"bm25": bm25_ranks(texts, asked, depth)}
    near = None
    for corpus in narratives.VARIANTS:
        part = latent.lsa_scores(texts.where(F.col("corpus") == corpus), asked, "doc", "text", "query", "text", k, depth, iterations).withColumn("corpus", F.lit(corpus))
        near = part if near is None else near.unionByName(part)
    legs["lsa"] = first_ranks(near, depth)
    legs = {name: kept(leg) for name, leg in legs.items()}
    both = [leg.select(F.struct("corpus", "query").alias("query"), "doc", "rank") for leg in legs.values()]
    legs["rrf"] = first_ranks(retrieval.fuse(*both).select("query.*", "doc", "score"), depth)
    out = None
    for name, leg in legs.items():
        part = leg.select("corpus", F.lit(name).alias("retriever"), "query", "doc", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def ablation(ranked: DataFrame, asked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(corpus, retriever, kind, n, recall, mrr, ndcg): means over queries of each kind, and of `all`, of recall@k, reciprocal rank and nDCG@k.

    A query that a retriever finds nothing for counts with zeros; a relevant document that isn't ranked has reciprocal rank 0.
    """
    runs = ranked.select("corpus", "retriever").distinct()  # a row a corpus and retriever
    every = relevant.crossJoin(F.broadcast(runs)).select(F.struct("corpus", "retriever", "query").alias("query"), "doc")
    each = metrics.ranking_metrics(ranked.select(F.struct("corpus", "retriever", "query").alias("query"), "doc", "rank"), every, k).select("query.*", "recall", "mrr", "ndcg")
    kinds = asked.select("query", F.explode(F.array(F.lit("all"), "kind")).alias("kind"))
    return each.join(kinds, "query").groupBy("corpus", "retriever", "kind").agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in ("recall", "mrr", "ndcg")))
