"""The corpus pipeline: five stages over documents, each written and read again by whoever runs them.

All stages share what follows. Extra columns pass through under any name, those that operators use inside too. Texts are
taken whole. Null ids are kept. An empty table gives an empty one with the same columns. Where a stage changes a text,
n_chars, if there is such a column, becomes its new length; a null text keeps the n_chars it had.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupwise.llm.common import stored, table
from groupwise.llm.jaccard import jaccard_groups
from groupwise.llm.lines import dedup_lines
from groupwise.llm.packing import pack_documents
from groupwise.llm.quality import classify
from groupwise.llm.secrets import redact, scan

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null and empty texts are judged by their features like others; repeated rows are judged alike; null hosts and languages
    are sites of their own. There are no ties: a score of one half or more is kept.
    """
    boxed = _boxed(docs, "doc_id", "text", "source", "lang")
    return _unboxed(classify(boxed, table(spark, sf_dir, "labels")).where("keep"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand elsewhere first; documents all of whose text goes that way go too.

    Of equal lines that of the least doc_id stays. Null texts, empty ones and lines of few characters stay. Repeated rows of an
    id and text lose the same lines; rows of one id with other texts lose their own.
    """
    done = dedup_lines(_boxed(docs, "doc_id", "text").withColumn("__had", F.length(F.trim("text")) > 0))
    left = F.col("text").isNull() | ~F.col("__had") | (F.length(F.trim(F.translate("text", "\n", ""))) > 0)
    return _measured(_unboxed(done.where(left), docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links reach: that of the least doc_id, null ids last, ties by the text's hash.

    Texts without words, null ones too, link with nothing and all stay. Rows of one id with other texts are documents of their
    own; of rows that agree in id and text one stays.
    """
    name = [F.xxhash64("text").alias("__name"), F.xxhash64(F.lit(1), "text").alias("__check")]
    boxed = _boxed(docs, "doc_id", "text")
    rows = stored(jaccard_groups(boxed.select("doc_id", "text", *name), carry=("__name", "__check")).where("group is not null"), "grouped")
    this = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__name", "__check")
    grouped = rows.groupBy("group").agg(F.min(this).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    spare = rows.join(grouped, "group").where(this != F.col("first")).select("doc_id", "__name", "__check").distinct()
    again = rows.groupBy("doc_id", "__name", "__check").count().where("count > 1").drop("count")
    of = lambda df: df.select(F.struct(F.col("doc_id").alias("id"), F.col("__name").alias("n"), F.col("__check").alias("c")).alias("__of"))
    same = F.col("doc_id").eqNullSafe(F.col("__of.id")) & (F.col("__name") == F.col("__of.n")) & (F.col("__check") == F.col("__of.c"))
    kept = boxed.select("*", *name).join(of(stored(spare, "spare")), same, "left_anti")
    repeated = of(stored(again, "repeated"))
    once = kept.join(repeated, same, "left_anti")
    one_each = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__name", "__check"])
    return _unboxed(once.unionByName(one_each).drop("__name", "__check"), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of each secret. Null and empty texts stay as they are; rows never meet, so repeats and ties play no part."""
    return _measured(_unboxed(redact(scan(_boxed(docs, "doc_id", "text"))), docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 1024. A null or empty text is its end mark alone; repeated rows are packed each; ties go by hash."""
    packed = pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _boxed(docs: DataFrame, *core: str) -> DataFrame:
    """docs with all but the core columns in one, so that names don't clash."""
    extra = [c for c in docs.columns if c not in core]
    return docs.select(*core, *([F.struct(*(F.col(f"`{c}`") for c in extra)).alias("__extra")] if extra else []))


def _unboxed(boxed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, in their order."""
    at_hand = [c for c in docs.columns if c in boxed.columns and c in ("doc_id", "text", "source", "lang")]
    return boxed.select(*((F.col(c) if c in at_hand else F.col("__extra").getField(c)).alias(c) for c in docs.columns))


def _measured(changed: DataFrame) -> DataFrame:
    """With n_chars, where there is one, of the changed texts."""
    if "n_chars" not in changed.columns:
        return changed
    length = F.length("text").cast(changed.schema["n_chars"].dataType)
    return changed.withColumn("n_chars", F.coalesce(length, "n_chars"))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]
#: The classifier and the tokenizer are beyond SQL; tests hold run() against a version of all five stages without Spark.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
