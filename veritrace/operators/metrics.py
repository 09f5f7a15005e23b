"""Metrics over linked rows: one aggregation each, one row out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent
from .linking import status_weight


def rate(rows: DataFrame, hit: Column, name: str = "percentage") -> DataFrame:
    """(total, matched, percentage) of a condition; 0 over no rows."""
    got = rows.agg(F.count("*").alias("total"), F.count_if(hit).alias("matched"))
    return got.withColumn(name, percent(F.col("matched"), F.col("total")))


def flagged(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """rows with `hit`: whether their key is among keys. keys is made distinct first."""
    marks = keys.select(on).where(F.col(on).isNotNull()).distinct().withColumn("hit", F.lit(True))
    return rows.join(marks, on, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def weighted(rows: DataFrame, status: str = "verified_status") -> DataFrame:
    """Sum of status weights over all rows, in halves so that the percentage is exact."""
    got = rows.agg(F.count("*").alias("total"), F.coalesce(F.sum((status_weight(F.col(status)) * 2).cast("bigint")), F.lit(0)).alias("halves"))
    return got.select("total", (F.col("halves") / 2.0).alias("score"), percent(F.col("halves"), F.col("total") * 2).alias("percentage"))


def status_counts(rows: DataFrame, status: str = "verified_status") -> DataFrame:
    return rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def multiset_f1(actual: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """F1 of two multisets of rows in percent: 100 if both are empty, 0 if one is."""
    sides = actual.select(*by, F.lit(1).alias("a"), F.lit(0).alias("e")).union(expected.select(*by, F.lit(0), F.lit(1)))
    counts = sides.groupBy(*by).agg(F.sum("a").alias("a"), F.sum("e").alias("e"))
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in ((F.least("a", "e"), "common"), (F.col("a"), "actual"), (F.col("e"), "expected"))])
    both = F.col("actual") + F.col("expected")
    return total.withColumn("f1", F.when(both == 0, F.lit(100.0)).otherwise(percent(F.col("common") * 2, both)))


def field_completeness(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Share of filled fields, over all rows and fields; 100 over none."""
    filled = sum((F.when(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != ""), 1).otherwise(0) for f in fields), F.lit(0))
    got = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(filled), F.lit(0)).alias("filled"))
    return got.select("n", "filled", F.when(F.col("n") == 0, F.lit(100.0)).otherwise(percent(F.col("filled"), F.col("n") * len(fields))).alias("percentage"))


def covered_pages(chunks: DataFrame, first: str, last: str) -> DataFrame:
    """Distinct pages of page ranges; pages below 1 do not exist."""
    return chunks.where(F.col(last) >= F.greatest(F.col(first), F.lit(1))).select(F.explode(F.sequence(F.greatest(F.col(first), F.lit(1)), F.col(last))).alias("page")).distinct()
