"""Agreement of several reviewers' findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded


def finding_key(page_a: Column, section_a: Column, page_b: Column, section_b: Column, category: Column) -> Column:
    """An identity that does not depend on which side came first; a null page comes last."""
    flat = folded
    side = lambda p, s: F.struct(p.isNull().alias("none"), F.coalesce(p, F.lit(-1)).alias("page"), flat(s).alias("section"))
    return F.struct(F.array_sort(F.array(side(page_a, section_a), side(page_b, section_b))).alias("sides"), flat(category).alias("category"))


def consensus(findings: DataFrame, key: Column, reviewer: str, confidence: Column, order: list[str], majority: int) -> DataFrame:
    """Findings that `majority` reviewers reported, each reviewer counting once; the one of highest confidence (the
    first of equals) stands for its group. Two aggregations, the first per reviewer, so that a
    finding that everyone reports combines before the shuffle."""
    rows = F.struct(confidence.alias("_rank"), *[(-F.col(o)).alias(f"_{o}") for o in order], *[c for c in findings.columns])
    per = findings.withColumn("key", key).groupBy("key", reviewer).agg(F.max(rows).alias("best"))
    votes = per.groupBy("key").agg(F.count("*").alias("votes"), F.max("best").alias("best")).where(F.col("votes") >= majority)
    return votes.select("votes", *[F.col("best")[c].alias(c) for c in findings.columns])


def majority(reviewers: int, planned: int = 6) -> int:
    """Votes that a finding needs; fewer results than a majority of the planned reviewers are an error."""
    if reviewers < planned // 2 + 1:
        raise ValueError(f"{reviewers} of {planned} reviewers are no majority")
    return reviewers // 2 + 1


def confidence_rank(c: Column) -> Column:
    return F.when(c == "Low", 0).when(c == "Medium", 1).when(c == "High", 2).otherwise(-1)


def listed(found: DataFrame) -> DataFrame:
    """Consensus rows (votes, confidence, page_a, title): most votes and highest confidence first, then by page
    (none last) and title."""
    return found.orderBy(F.desc("votes"), confidence_rank(F.col("confidence")).desc(), F.col("page_a").asc_nulls_last(), "title")
