"""A corpus pipeline: language, exact copies, near copies, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.common import single, stash, text_mark, text_or_empty, without
from veritrace.llm.decontaminate import decontaminate
from veritrace.llm.exact_dedup import exact_dedup
from veritrace.llm.jaccard_join import jaccard_components
from veritrace.llm.language_id import identify
from veritrace.llm.packing import pack

#: A prediction below this mean probability is no better than chance among four languages.
LEAST_SCORE = 0.3


def _row(name: str, of) -> dict:
    """What tells rows apart: the id, and something of the text."""
    return {"doc_id": F.col("doc_id").cast("long"), name: of(text_or_empty("text"))}


def _sha() -> dict:
    return _row("text_sha256", lambda t: F.sha2(t, 256))


def _mark() -> dict:
    return _row("text_mark", text_mark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or whose language is anyone's guess, go.
    Each row is judged by itself: repeated rows, ids and rows without an id need no care."""
    return identify(docs, carry=True).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty), the row with the largest id stays. Rows are told apart by id
    and text, so another text under the same id stays; of rows that agree in both, one stays."""
    found = exact_dedup(docs).where("group_size > 1")
    left = without(docs, found.where(~F.col("kept")), _sha())
    return single(left, found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1"), _sha())


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays: the one with the smallest id (rows without an id
    come last), then the smallest hash of its text. Rows without a shingle are linked with nothing
    and all stay. Rows that agree in id and text link like others: one of them stays."""
    rows = stash(jaccard_components(docs, marks=True).where("group_size > 1"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_mark")
    parts = F.ceil(F.col("group_size") / 1024).cast("int")  # of a group, so that no task looks up a whole one
    first = rows.groupBy("class").agg(F.min(place).alias("first"), F.max(parts).alias("n")).select("class", "first", F.explode(F.sequence(F.lit(1), "n")).alias("part"))
    stay = rows.withColumn("part", (F.pmod(F.xxhash64("text_mark"), parts) + 1).cast("int")).join(first, ["class", "part"]).withColumn("stays", F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_mark") == F.col("text_mark")))
    left = without(docs, stay.where(~F.col("stays")), _mark())
    return single(left, stay.where("stays").groupBy("doc_id", "text_mark").count().where("count > 1"), _mark())


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows are told apart by id and text, nulls included."""
    return without(docs, decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), _mark())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 1024; a null text is an empty one."""
    return pack(docs)


STAGES = [("language", language), ("exact_dedup", copies), ("near_dedup", near_copies), ("decontamination", leaks), ("packing", packed)]
#: The stages train a model, link by similarity and tokenize: SQL expresses none of the results.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Stages decide by a row's id and text; further columns, whatever
    their names, come along up to packing, and an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
