"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.llm.common import field, stored, table

#: Labelled rows that the document classifier is fitted on at most: those of the least hashed ids.
FIT_ROWS = 20_000
#: Strength of the prior from which sites' rates are shrunk, if moments give none, and its bounds.
STRENGTH, STRENGTH_BOUNDS = 50.0, (5.0, 5000.0)
KEEP_FROM = 0.5
#: Bins of hashed runs of three bytes, and how much more their weights are shrunk than those of the other features.
BINS, BIN_PENALTY = 64, 30.0
_PUNCTUATION = b"!|%$#&*@^~<>{}[]=+_\\/"


def _characters(data: np.ndarray) -> list[float]:
    """Shares of kinds of characters, lengths of words and lines, all by one count of bytes."""
    counts = np.bincount(data, minlength=256).astype(float)
    n = max(1.0, counts.sum())
    upper, lower, digit = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    beyond, spaces, lines = counts[128:].sum(), counts[32] + counts[9], counts[10]
    odd = counts[list(_PUNCTUATION)]
    letters = upper + lower + beyond
    shares = counts[counts > 0] / n
    return [
        upper / n, lower / n, digit / n, beyond / n, spaces / n, lines / n, counts[46] / n, counts[44] / n, odd.sum() / n, odd.max() / n,
        np.log1p(odd.sum()), np.log1p(counts[33]), np.log1p(counts[124]), upper / (1 + letters), np.log1p(letters / (1 + spaces + lines)), np.log1p(counts.sum()), -(shares * np.log(shares)).sum(),
    ]


_SPACE, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:"]] = True


def _repeats(data: bytes, values: np.ndarray) -> list[float]:
    """How varied words and lines are, and how many words end in a sign."""
    words = data.split()
    n, distinct = max(1, len(words)), len(set(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    twice = sum(map(bytes.__eq__, words, words[1:]))
    signs = np.count_nonzero(_SIGN[values] & np.append(_SPACE[values[1:]], True)) if len(values) else 0
    return [distinct / n, twice / n, np.log1p(n), len(set(lines)) / max(1, len(lines)), signs / n, np.log1p(distinct) / np.log1p(n)]


def _hashed(data: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed runs of three bytes."""
    if len(data) < 3:
        return np.zeros(BINS)
    wide = data.astype(np.uint32)
    h = wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    return np.sqrt(np.bincount((h >> np.uint32(16)) % np.uint32(BINS), minlength=BINS) / len(h))


def features(data: np.ndarray) -> np.ndarray:
    """A document's features from all its UTF-8 bytes."""
    return np.concatenate((_characters(data), _repeats(data.tobytes(), data), _hashed(data)))


N_FEATURES = len(features(np.zeros(0, np.uint8)))


def _rows_of_bytes(texts: pa.Array) -> Iterator[np.ndarray]:
    for text in texts.cast(pa.large_binary()):
        yield np.frombuffer(text.as_py() or b"", np.uint8)


@dataclass(frozen=True)
class Model:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0], -30, 30)
        return 1 / (1 + np.exp(-z))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> Model:
    """Newton steps on the penalised likelihood; the intercept has no penalty. Without rows, one half for all."""
    if not len(x):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    design = np.hstack((np.ones((len(x), 1)), (x - mean) / scale))
    own = max(0, x.shape[1] - BINS)
    weights, penalty = np.zeros(design.shape[1]), np.diag([1e-6, *[ridge] * own, *[ridge * BIN_PENALTY] * (x.shape[1] - own)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        step = np.linalg.solve(design.T * (p * (1 - p)) @ design + penalty, design.T @ (y - p) - penalty @ weights)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, scale, weights)


def document_features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of each document."""
    schema = T.StructType([field(docs, "doc_id"), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(d) for d in _rows_of_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def one_label(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) with one row a document: the mean of its labels; rows without either go."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("quality"))


def chosen_labels(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, quality) of at most `rows` labelled documents, those of the least hashed ids."""
    return one_label(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, chosen: DataFrame) -> Model:
    """The document classifier, on the chosen labels, of which there are FIT_ROWS at most."""
    of_docs = document_features(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
    seen = of_docs.join(F.broadcast(chosen), "doc_id").select("x", "quality").collect()
    x = np.array([r["x"] for r in seen]).reshape(-1, N_FEATURES)
    return fit_logistic(x, np.array([r["quality"] for r in seen]))


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """docs with p, the classifier's probability that the document is good."""
    schema = T.StructType([*docs.schema.fields, T.StructField("p", T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                x = np.array([features(d) for d in _rows_of_bytes(part.column(at))])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.probability(x))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _strength(sites: DataFrame, rate: float) -> float:
    """Strength of a Beta prior by moments: how much the rates of sites vary beyond what their sizes explain."""
    r = F.col("good") / F.col("n")
    row = sites.where("n >= 20").agg(F.var_samp(r).alias("var"), F.avg(1 / F.col("n")).alias("inverse"), F.count("*").alias("sites")).first()
    spread = rate * (1 - rate)
    if row["sites"] < 2 or spread <= 0:
        return STRENGTH
    true = max(1e-6, (row["var"] or 0.0) - spread * row["inverse"])
    return float(np.clip(spread / true - 1, *STRENGTH_BOUNDS))


@dataclass(frozen=True)
class Sites:
    """Sums by (host, path) and by host, and the priors between the levels."""

    sums: DataFrame  # host, path, n, good, host_n, host_good
    n: float
    good: float
    at_host: float
    at_path: float

    @property
    def rate(self) -> float:
        return float(self.good / self.n) if self.n else 0.5

    def base(self, own: Column | None = None) -> Column:
        """The rate of all rows, without one whose evidence is own."""
        return F.lit(self.rate) if own is None or self.n <= 1 else (F.lit(self.good) - own) / (self.n - 1)

    def posteriors(self, own: Column | None = None, of=F.col) -> tuple[Column, Column]:
        """Host's and path's rates, shrunk toward all rows' and the host's, without one row whose evidence is own."""
        less, given = (0, F.lit(0.0)) if own is None else (1, own)
        host = (of("host_good") - given + self.base(own) * self.at_host) / (of("host_n") - less + self.at_host)
        return host, (of("good") - given + host * self.at_path) / (of("n") - less + self.at_path)


def sites_of(rows: DataFrame, host: str = "source", path: str = "lang") -> Sites:
    """The sites of rows with those columns and good, a row's evidence.

    The priors' strengths come from the moments of each level's rates. Rows are summed by (host, path) first, so a hot host is a few sums.
    """
    by_path = stored(rows.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n"), F.sum("good").alias("good")), "sites")
    by_host = by_path.groupBy(F.col("host").alias("of_host")).agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = by_path.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    n, good = float(total["n"] or 0), float(total["good"] or 0)
    rate = good / n if n else 0.5
    at_host, at_path = _strength(by_host.select(F.col("host_n").alias("n"), F.col("host_good").alias("good")), rate), _strength(by_path, rate)
    return Sites(by_path.join(by_host, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host"), n, good, at_host, at_path)


def site_posteriors(rows: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(host, path, host_posterior, path_posterior, base_rate) from rows with those columns and good, a row's evidence."""
    sites = sites_of(rows, host, path)
    of_host, of_path = sites.posteriors()
    return sites.sums.select("host", "path", of_host.alias("host_posterior"), of_path.alias("path_posterior"), sites.base().alias("base_rate"))


def _logit(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(bounded / (1 - bounded))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """docs with p, host_posterior, path_posterior, score and keep (score of KEEP_FROM or more).

    A site's evidence is the label of each document that the classifier is fitted on and p of each other one, over all documents. A
    document's own is left out of its site's posteriors, so it counts once: score is the posterior of p's evidence with the path's
    rate in place of the base rate, the log odds of p plus those of the path's posterior less those of the base rate.
    A null or empty text is judged by the same features; texts are read whole; null hosts and paths are sites of their own; documents
    without id have no label; repeated rows count each time and are judged alike; labels of documents that aren't there do nothing,
    and with none at all p is one half. An empty table gives an empty result. Columns named like the new ones are replaced.
    """
    new = ("p", "host_posterior", "path_posterior", "score", "keep")
    docs = docs.drop(*new)
    chosen = stored(chosen_labels(labels), "chosen-labels")
    of_label = F.broadcast(chosen.select(F.col("doc_id").alias("__labelled"), F.col("quality").alias("__quality")))  # FIT_ROWS at most
    model = fit(docs, chosen)

    def judged(rows: DataFrame) -> DataFrame:
        return evidence(rows, model).join(of_label, F.col("doc_id") == F.col("__labelled"), "left").withColumn("__own", F.coalesce("__quality", "p"))

    narrow = judged(docs.select("doc_id", "text", F.col(host).alias("host"), F.col(path).alias("path")))
    sites = sites_of(narrow.select("host", "path", F.col("__own").alias("good")), "host", "path")
    shrunk = sites.sums.select(F.struct("*").alias("__site"))
    of = lambda c: F.col(f"__site.{c}")
    joined = judged(docs).join(shrunk, F.col(host).eqNullSafe(of("host")) & F.col(path).eqNullSafe(of("path")), "left")
    with_sums = joined.select(*docs.columns, "p", "__own", F.struct(*(of(c).alias(c) for c in ("n", "good", "host_n", "host_good"))).alias("__sums"))
    return _scored(with_sums, sites).select(*docs.columns, *new)


def _scored(rows: DataFrame, sites: Sites) -> DataFrame:
    """rows (p, __own, __sums) with their posteriors, score and keep."""
    own, of = F.col("__own"), lambda c: F.col(f"__sums.{c}")
    host, path = sites.posteriors(own, of)
    out = rows.withColumn("host_posterior", host).withColumn("path_posterior", path)
    log_odds = _logit(F.col("p")) + _logit(F.col("path_posterior")) - _logit(sites.base(own))
    return out.withColumn("score", 1 / (1 + F.exp(-log_odds))).withColumn("keep", F.col("score") >= KEEP_FROM)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rounded = lambda c: F.round(c, 6).alias(c)
    return judged.select("doc_id", "source", "lang", rounded("p"), rounded("host_posterior"), rounded("path_posterior"), rounded("score"), "keep")
