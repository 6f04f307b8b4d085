"""The training-data pipeline: five stages over ``documents``, each written as Parquet before the next one reads it.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  A null or empty text has no language and goes in the first stage.  Rows that are equal in id
and text are one document to the stage that removes near duplicates: one row of them stays at most, the one
whose columns have the least hash.  Null ids are documents of their own text; very long texts are whole
documents; further columns, whatever their names, go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestow.llm.best_fit_packing import pack_documents
from lodestow.llm.common import table, written
from lodestow.llm.language_id import identify_documents
from lodestow.llm.line_dedup import dedup_lines
from lodestow.llm.ngram_join import near_duplicates
from lodestow.llm.quality_classifier import THRESHOLD, score_quality, train_quality


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay; ``lang`` becomes the identified one."""
    found = identify_documents(docs, table(spark, sf_dir, "pages")).where("accepted")
    return found.select(*[F.col("language").alias("lang") if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold stay; it learns from labelled ones among these."""
    scored = score_quality(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), train_quality(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("score") >= THRESHOLD).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the passages that an earlier one has; ``n_chars`` follows the text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    spare = "_" * (1 + max(map(len, docs.columns)))  # a struct needs one field, of no column's name
    done = dedup_lines(docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias(spare)).alias("row")))
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")}
    return done.select(*[new.get(c, F.col("row")[c].alias(c)) for c in docs.columns])


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, the one with the least id (null last)."""
    groups = near_duplicates(docs)
    first = F.min_by(F.struct("doc_id", "text_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    stay = groups.groupBy("class_key").agg(first.alias("f")).select(F.col("f.doc_id").alias("_id"), F.col("f.text_key").alias("_text"))
    stay = stay.select(F.xxhash64("_id", "_text").alias("stay"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("stay"))
    # of rows equal in id and text the one whose columns have the least hash
    kept = keyed.join(stay, "stay").groupBy("stay").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        return pack_documents(docs, f.read())


STAGES = [("language_id", language_id), ("quality_classifier", quality), ("line_dedup", lines), ("ngram_join", near_duplicate_groups), ("best_fit_packing", packing)]

#: The stages learn models and hash n-grams: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
