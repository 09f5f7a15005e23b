"""Stages of plan generation: what a model answered, a table here, is checked batch by batch and put in place.

Answers carry the number of their batch (from 0) and of the attempt. The first attempt of a batch that is right counts,
as a whole: a batch is right if it returns each of its ids exactly once and nothing that is not allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ordering, planning
from ..sources.shared import settled

#: Requirements of a batch of assignments, and of one of plan rows.
ASSIGNMENT_BATCH, PLAN_BATCH = 100, 40


def _shown(rows: DataFrame, columns: list[str], shown: int = 10) -> str:
    """The first few rows, for a message."""
    return "; ".join(", ".join(f"{c} {r[c]}" for c in columns if r[c] is not None) for r in rows.select(columns).orderBy(columns).limit(shown).collect())


def _spelled(answers: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """answers with _parent and _child in the taxonomy's spelling, null where it does not have the pair."""
    low = lambda c: F.lower(F.col(c))
    legal = taxonomy.groupBy(low("category").alias("_p"), low("subcategory").alias("_c")).agg(F.min(F.struct(F.col("category").alias("_parent"), F.col("subcategory").alias("_child"))).alias("_pair"))
    return answers.withColumns({"_p": low("category"), "_c": low("subcategory")}).join(legal, ["_p", "_c"], "left").select(*answers.columns, "_pair._parent", "_pair._child")


def right_attempts(answers: DataFrame, batched: DataFrame, allowed: Column) -> DataFrame:
    """(batch, attempt): of each batch the first attempt that returns each id of batched (batch, id) once, and
    nothing else or that is not allowed. Everything is counted per batch, so no batch is held as one row."""
    expected = batched.where("id is not null").select("batch", F.col("id").cast("string").alias("requirement_id")).distinct()
    of = expected.groupBy("batch").agg(F.count("*").alias("_of"))
    met = answers.withColumn("_allowed", allowed).join(expected.withColumn("_known", F.lit(True)), ["batch", "requirement_id"], "left")
    counts = met.groupBy("batch", "attempt").agg(F.count("*").alias("_rows"), F.count_distinct("requirement_id").alias("_ids"), F.count_if(F.col("_known").isNull() | ~F.coalesce("_allowed", F.lit(False))).alias("_bad"))
    right = counts.join(of, "batch").where("_bad = 0 and _rows = _of and _ids = _of")
    return right.groupBy("batch").agg(F.min("attempt").alias("attempt"))


def categorise(requirements: DataFrame, taxonomy: DataFrame, answers: DataFrame, order: list[str], size: int = ASSIGNMENT_BATCH) -> tuple[DataFrame, DataFrame]:
    """requirements (id, ...) with requirement_category and requirement_subcategory, and (batch) of those that no
    attempt got right: theirs are Uncategorised. taxonomy: (category, subcategory), an error if names repeat
    in it; answers: (batch, attempt, requirement_id, category, subcategory). Batches are of `size`
    requirements in their order. An id of several batches gets what the last right one says."""
    if not (errors := planning.taxonomy_errors(taxonomy)).isEmpty():
        raise ValueError(f"the taxonomy is not valid: {_shown(errors, ['error', 'category', 'subcategory'])}")
    batched = settled(ordering.batches(requirements.select("id", *[c for c in order if c != "id"]), order, size))
    said = _spelled(answers.withColumn("requirement_id", F.col("requirement_id").cast("string")), taxonomy)
    right = settled(right_attempts(said, batched, F.col("_parent").isNotNull()))
    last = said.join(right, ["batch", "attempt"]).groupBy(F.col("requirement_id").alias("_id")).agg(F.max_by(F.struct("_parent", "_child"), "batch").alias("_pair"))
    out = requirements.join(last, F.col("id").cast("string") == F.col("_id"), "left")
    none = F.lit(planning.UNCATEGORISED)
    out = out.withColumns({"requirement_category": F.coalesce("_pair._parent", none), "requirement_subcategory": F.coalesce("_pair._child", none)}).drop("_id", "_pair")
    return out, batched.select("batch").distinct().join(right, "batch", "left_anti")


def plan_batches(requirements: DataFrame, order: list[str], size: int = PLAN_BATCH) -> DataFrame:
    """Categorised requirements with planning_category, planning_subcategory, part, parts and the number of
    their batch: categories as they are first met, subcategories together, `size` at most."""
    name = lambda c: planning.requirement_category(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(planning.UNCATEGORISED)))
    rows = requirements.withColumns({"planning_category": name("requirement_category"), "planning_subcategory": name("requirement_subcategory")})
    out = settled(ordering.category_batches(rows, "planning_category", "planning_subcategory", order, size))
    parts = out.select("category_order", "part").distinct().withColumn("batch", F.row_number().over(Window.orderBy("category_order", "part")) - 1)  # a row per batch
    return out.join(parts, ["category_order", "part"]).drop("category_order")


def generate(batched: DataFrame, answers: DataFrame, order: str = "pos") -> DataFrame:
    """Plan rows of all batches (of plan_batches) in order: answers (batch, pos, requirement_id, test_id,
    supporting_requirement_ids, ...) with the batch's category, the requirement's subcategory, the
    supporting ids that the batch has (sorted, each once, not the row's own), and test ids that are each
    used once. A batch without answers is an error: nothing is left out silently."""
    numbers = batched.select("batch").distinct()
    lost = numbers.join(answers.select("batch").distinct(), "batch", "left_anti")
    if not lost.isEmpty():
        raise ValueError(f"no plan rows came back for: {_shown(lost, ['batch'])}")
    ids = batched.where("id is not null").select("batch", F.col("id").cast("string").alias("_id"), "planning_subcategory", *[F.col(order).alias("_place")] if order in batched.columns else [F.lit(0).alias("_place")])
    first = ids.groupBy("batch", F.col("_id").alias("requirement_id")).agg(F.min_by("planning_subcategory", "_place").alias("_sub"))
    kinds = batched.select("batch", F.col("planning_category").alias("requirement_category")).distinct()
    rows = answers.withColumn("requirement_id", F.col("requirement_id").cast("string"))
    cited = rows.select("batch", order, "requirement_id", F.explode(F.array_distinct(F.transform("supporting_requirement_ids", lambda x: x.cast("string")))).alias("_id")).where(F.col("_id").isNotNull() & ~F.col("_id").eqNullSafe(F.col("requirement_id")))
    kept = cited.join(ids.select("batch", "_id").distinct(), ["batch", "_id"], "left_semi").groupBy("batch", order).agg(F.array_sort(F.collect_set("_id")).alias("_ids"))
    out = rows.join(kinds, "batch").join(first, ["batch", "requirement_id"], "left").join(kept, ["batch", order], "left")
    out = out.withColumns({"requirement_subcategory": F.coalesce("_sub", F.lit(planning.UNCATEGORISED)), "supporting_requirement_ids": F.coalesce("_ids", F.array().cast("array<string>"))}).drop("_sub", "_ids")
    return ordering.suffixed(out, "test_id", ["batch", order]).withColumn("test_id", F.col("unique_id")).drop("unique_id")


def category_hints(existing: DataFrame, enrichments: DataFrame) -> DataFrame:
    """(category) that later batches are told: the ones there already and those that the first batch gave, each once."""
    usable = enrichments.select("category").where(F.col("category") != planning.UNCATEGORISED)
    return existing.select("category").union(usable).where("category is not null").distinct()


def merged_evidence(requirements: DataFrame, by: list[str], order: str, evidence: str = "evidence") -> DataFrame:
    """Of requirements that agree in `by` the first, with the evidence of all of them: each piece once, compared as
    JSON, in the order in which it is first met. evidence: an array of structs; a requirement's is bounded, and
    equal pieces of a group meet in each task before they are collected."""
    piece = rows_of(requirements, by, order, evidence).groupBy(*by, F.to_json("_e").alias("_json")).agg(F.min(F.struct(order, "_i", "_e")).alias("_m"))
    every = piece.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("_m")), lambda m: m["_e"]).alias("_all"))
    fields = [c for c in requirements.columns if c not in by]
    first = requirements.groupBy(*by).agg(F.min_by(F.struct(*fields), order).alias("_r")).select(*by, "_r.*")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by])
    held = every.toDF(*[f"_k_{c}" for c in by], "_all")
    return first.join(held, same, "left").withColumn(evidence, F.coalesce("_all", F.slice(evidence, 1, 0))).select(requirements.columns)


def rows_of(requirements: DataFrame, by: list[str], order: str, evidence: str) -> DataFrame:
    return requirements.select(*by, order, F.posexplode(evidence).alias("_i", "_e"))


#: What a reviewer is told of an extracted document.
COUNTED = ["sections", "requirements", "tables", "figures", "notes", "acronyms", "cross_references", "semantic_chunks"]


def extraction_summary(documents: DataFrame) -> DataFrame:
    """documents: rows with document_name, total_pages and arrays. How many of each there are; absent ones are 0."""
    none = F.lit(0)
    size = lambda c: F.coalesce(F.size(c), none) if c in documents.columns else none
    counted = [F.when(size(c) < 0, 0).otherwise(size(c)).alias(c) for c in COUNTED]
    pages = F.coalesce(F.col("total_pages"), none) if "total_pages" in documents.columns else none
    return documents.select("document_name", pages.cast("long").alias("total_pages"), *counted)
