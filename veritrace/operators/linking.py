"""Linking requirements to plan rows, evidence and assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import STATUS_ALIASES, STATUS_WEIGHTS
from ..functions.text import clean, first_present, present, strip

#: Resolution of an id, by module: which fields are tried, in order.
KEY_ORDER = {"plan": ("requirement_id", "id"), "spec": ("id", "requirement_id"), "evidence": ("requirement_id", "id", "req_id"), "version": ("requirement_id", "id", "identifier", "name", "req_id", "requirement")}


def key(df: DataFrame, kind: str) -> Column:
    """The id of a row under one module's precedence; null if no field gives one."""
    found = [F.col(c) for c in KEY_ORDER[kind] if c in df.columns and (kind != "evidence" or df.schema[c].dataType.typeName() == "string")]
    if kind == "evidence":  # only strings are ids there
        found = [strip(c) for c in found]
    if kind == "version":
        found = [clean(c.cast("string")) for c in found]
    return first_present(*found) if found else F.lit(None).cast("string")


def test_id(pos: Column, *fields: Column) -> Column:
    return F.coalesce(first_present(*fields), F.format_string("VPLAN_ITEM_%03d", pos.cast("int") + 1))


def mapped(requirements: DataFrame, plan: DataFrame, on: str, plan_on: str) -> DataFrame:
    """Requirement rows that some plan row names. Duplicates stay; a null key never maps."""
    return requirements.join(plan.select(F.col(plan_on).alias(on)), on, "left_semi")


def unmapped(requirements: DataFrame, plan: DataFrame, on: str, plan_on: str) -> DataFrame:
    return requirements.join(plan.select(F.col(plan_on).alias(on)), on, "left_anti")


def nest(rows: DataFrame, on: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """Rows of each key as an array in input order; null keys are dropped."""
    packed = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    return rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.transform(packed, lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(name))


def first_wins(rows: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*on).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def canonical_status(c: Column) -> Column:
    """Aliases of a coverage status to its one spelling; unknown is Uncovered."""
    table = F.create_map(*[F.lit(x) for kv in STATUS_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(strip(c))), F.lit("Uncovered"))


def status_weight(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STATUS_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.lit(0.0))


def complete_test(description: Column, steps: Column, results: Column) -> Column:
    some = lambda a: F.coalesce(F.exists(a, present), F.lit(False))
    return present(description) & some(steps) & some(results)


def classify(n_rows: Column, n_complete: Column, n_covered: Column, n_labelled: Column, ambiguous: Column) -> Column:
    """The status of a requirement from counts over its plan rows. n_complete: complete and not
    labelled uncovered; n_labelled, n_covered: of those, with a recognised label, and labelled covered."""
    none = F.when(ambiguous, "Ambiguous / not yet plannable").otherwise("Uncovered")
    full = (n_complete == n_rows) & ~ambiguous & (n_labelled == n_complete) & (n_covered == n_complete)
    return F.when((n_rows == 0) | (n_complete == 0), none).when(full, "Covered").otherwise("Partially covered")


_REASONS = {
    "id": "Requirement has no identifiable requirement ID.",
    "none_ambiguous": "Requirement has no generated tests and has linked weak-word or edge-case signals.",
    "none": "Requirement has no generated tests.",
    "empty": "No linked row contains a complete executable test and observable expected result",
    "full": "Every linked row contains a complete executable test, every row is marked covered, and no linked ambiguity evidence was found.",
    "partial": "At least one concrete test is available, but full coverage is not justified because ",
}


def reason(has_id: Column, n_rows: Column, n_complete: Column, n_covered: Column, n_labelled: Column, n_partial: Column, ambiguous: Column) -> Column:
    """Why a requirement has its status; the counts are those of classify, n_partial: labelled partial."""
    part = lambda c, said: F.when(c, said)
    why = F.array_compact(F.array(
        F.when(n_rows > n_complete, F.concat((n_rows - n_complete).cast("string"), F.lit(" linked row(s) lack complete executable test content"))), part(n_labelled < n_complete, "one or more complete tests have no recognised vPlan coverage label"),
        part(n_partial > 0, "one or more complete tests are marked partially covered"), part(ambiguous, "weak-language or edge-case evidence is linked"),
    ))
    full = (n_complete == n_rows) & ~ambiguous & (n_labelled == n_complete) & (n_covered == n_complete)
    partial = F.concat(F.lit(_REASONS["partial"]), F.coalesce(F.nullif(F.array_join(why, "; "), F.lit("")), F.lit("the linked evidence is incomplete")), F.lit("."))
    return (
        F.when(~has_id, _REASONS["id"]).when((n_rows == 0) & ambiguous, _REASONS["none_ambiguous"]).when(n_rows == 0, _REASONS["none"]).when((n_complete == 0) & ambiguous, _REASONS["empty"] + "; ambiguity evidence is also present.")
        .when(n_complete == 0, _REASONS["empty"] + ".").when(full, _REASONS["full"]).otherwise(partial)
    )


def recognised(*labels: Column) -> Column:
    """The first of several label fields that holds a known coverage label, lower case."""
    known = ["covered", "partially_covered", "uncovered"]
    return F.coalesce(*[F.when(F.lower(strip(c)).isin(known), F.lower(strip(c))) for c in labels])


def verified(requirements: DataFrame, plan: DataFrame, edge_cases: DataFrame, weak_flags: DataFrame, order: str = "pos") -> DataFrame:
    """The labelled requirements: each with its status, reason, tests, labels, supporting ids (valid ones as
    records, invalid ones as ids), edge cases and weak wording flags, in input order.

    plan: (requirement_id, test_id, coverage, complete, supporting_requirement_ids, pos); edge_cases and
    weak_flags: requirement_id, pos and fields of their own. Each side is grouped before it is joined; the
    nested arrays are what the result is made of, so a requirement's evidence bounds its row."""
    label = recognised(*[F.col(c) for c in ("coverage", "test_coverage", "status") if c in plan.columns])
    rows = plan.where(F.col("requirement_id").isNotNull()).withColumn("_label", label).withColumn("_usable", F.col("complete") & (F.coalesce("_label", F.lit("")) != "uncovered"))
    listed = lambda c: F.transform(F.filter(F.array_sort(F.collect_list(F.struct(order, F.col(c).alias("x")))), lambda s: s["x"].isNotNull()), lambda s: s["x"])
    cited = F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list("supporting_requirement_ids")), lambda x: x != "")))
    per = rows.groupBy("requirement_id").agg(
        F.count("*").alias("n_rows"), F.count_if("_usable").alias("n_complete"), F.count_if(F.col("_usable") & F.col("_label").isNotNull()).alias("n_labelled"),
        F.count_if(F.col("_usable") & (F.col("_label") == "covered")).alias("n_covered"), F.count_if(F.col("_usable") & (F.col("_label") == "partially_covered")).alias("n_partial"),
        listed("test_id").alias("linked_tests"), listed("_label").alias("original_vplan_coverage_values"), cited.alias("linked_supporting_requirement_ids"),
    )
    nested = lambda df, name: nest(df, "requirement_id", [order], [c for c in df.columns if c not in ("requirement_id", order)], name)
    none = F.array().cast("array<string>")
    out = requirements.join(per, "requirement_id", "left").join(nested(edge_cases, "linked_edge_cases"), "requirement_id", "left").join(nested(weak_flags, "linked_weak_word_flags"), "requirement_id", "left")
    out = out.fillna(0, ["n_rows", "n_complete", "n_labelled", "n_covered", "n_partial"]).withColumns({c: F.coalesce(c, none) for c in ("linked_tests", "original_vplan_coverage_values", "linked_supporting_requirement_ids")})
    for c in ("linked_edge_cases", "linked_weak_word_flags"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast(out.schema[c].dataType)))
    doubt = (F.size("linked_edge_cases") > 0) | (F.size("linked_weak_word_flags") > 0)
    counts = [F.col(c) for c in ("n_rows", "n_complete", "n_covered", "n_labelled")]
    has_id = F.col("requirement_id").isNotNull()
    out = out.withColumn("coverage_verification_reason", reason(has_id, *counts, F.col("n_partial"), doubt)).withColumn("verified_coverage_status", F.when(~has_id, "Ambiguous / not yet plannable").otherwise(classify(*counts, doubt)))
    return out.drop("n_rows", "n_complete", "n_labelled", "n_covered", "n_partial")


def supporting_records(labelled: DataFrame, requirements: DataFrame, order: str = "pos") -> DataFrame:
    """(requirement_id, records, invalid): of the ids that a labelled requirement's tests cite, those that
    exist (the last requirement of an id; never the row itself) as records, and those that do not."""
    fields = {"text": first_present(*[F.col(c) for c in ("text", "description") if c in requirements.columns]), "source_section": first_present(*[F.col(c) for c in ("source_section", "section") if c in requirements.columns]) if {"source_section", "section"} & set(requirements.columns) else F.lit(None).cast("string")}
    known = requirements.where("requirement_id is not null").groupBy(F.col("requirement_id").alias("id")).agg(F.max_by(F.struct(*[F.coalesce(c, F.lit("")).alias(n) for n, c in fields.items()]), order).alias("_r"))
    cited = labelled.select("requirement_id", F.explode("linked_supporting_requirement_ids").alias("id")).distinct().join(known, "id", "left")
    own = F.col("_r").isNotNull() & (F.col("id") != F.col("requirement_id"))
    return cited.groupBy("requirement_id").agg(F.array_sort(F.collect_list(F.when(own, F.struct("id", "_r.text", "_r.source_section")))).alias("records"), F.array_sort(F.collect_list(F.when(F.col("_r").isNull(), F.col("id")))).alias("invalid"))


def traceability(labelled: DataFrame) -> DataFrame:
    """The traceability table: requirements with an id, and whether they have either kind of evidence."""
    return labelled.where("requirement_id is not null").select("requirement_id", F.col("linked_tests").alias("linked_test_ids"), "linked_supporting_requirement_ids", "original_vplan_coverage_values", "verified_coverage_status", (F.size("linked_edge_cases") > 0).alias("has_edge_case_flags"), (F.size("linked_weak_word_flags") > 0).alias("has_weak_word_flags"))


def verify(requirements: DataFrame, tests: DataFrame, evidence: DataFrame) -> DataFrame:
    """requirements (requirement_id, ...), tests (requirement_id, label, complete), evidence
    (requirement_id): each requirement with verified_status and the counts behind it. Tests and
    evidence are aggregated before the joins, so a hot requirement is one row on each side."""
    label = F.lower(strip(F.col("label")))
    usable = F.col("complete") & (F.coalesce(label, F.lit("")) != "uncovered")
    per = tests.where(F.col("requirement_id").isNotNull()).groupBy("requirement_id").agg(
        F.count("*").alias("n_rows"), F.count_if(usable).alias("n_complete"),
        F.count_if(usable & label.isin("covered", "partially covered", "partially_covered")).alias("n_labelled"), F.count_if(usable & (label == "covered")).alias("n_covered"),
    )
    doubt = evidence.select("requirement_id").where("requirement_id is not null").distinct().withColumn("ambiguous", F.lit(True))
    out = requirements.join(per, "requirement_id", "left").join(doubt, "requirement_id", "left")
    out = out.fillna(0, ["n_rows", "n_complete", "n_labelled", "n_covered"]).withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))
    status = classify(*[F.col(c) for c in ("n_rows", "n_complete", "n_covered", "n_labelled", "ambiguous")])
    return out.withColumn("verified_status", F.when(F.col("requirement_id").isNull(), "Ambiguous / not yet plannable").otherwise(status))


def assess(requirements: DataFrame, linked: DataFrame, assessments: DataFrame, label: str, default: str = "unclear") -> DataFrame:
    """Requirements with a reviewer's label: the first assessment wins, a linked requirement without
    one (or with `not_mapped`) is `unclear`, one without linked tests `not_mapped`."""
    has = linked.select("requirement_id").distinct().withColumn("_linked", F.lit(True))
    first = first_wins(assessments, ["requirement_id"], ["pos"]).select("requirement_id", label)
    out = requirements.join(has, "requirement_id", "left").join(first, "requirement_id", "left")
    value = F.when(F.col("_linked").isNull(), "not_mapped").otherwise(F.coalesce(F.nullif(F.col(label), F.lit("not_mapped")), F.lit(default)))
    return out.withColumn(label, value).drop("_linked")


def supporting(requirements: DataFrame, on: str = "requirement_id", ids: str = "supporting_requirement_ids") -> tuple[DataFrame, DataFrame]:
    """Cited requirements that exist, without the row itself; and the citations that do not."""
    cited = requirements.select(on, F.explode(F.array_sort(F.array_distinct(ids))).alias("cited")).where(f"cited <> {on}")
    known = requirements.select(F.col(on).alias("cited")).distinct()
    return cited.join(known, "cited", "left_semi"), cited.join(known, "cited", "left_anti")


def duplicate_details(rows: DataFrame, on: str, fields: list[str], order: str = "pos") -> DataFrame:
    """Ids that several rows have, with those rows' fields in order."""
    return nest(rows, on, [order], fields, "rows").where(F.size("rows") > 1).withColumn("n", F.size("rows").cast("long"))


def duplicate_ids(rows: DataFrame, on: str) -> DataFrame:
    return rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("n")).where("n > 1")


def resolve_traces(items: DataFrame, values: DataFrame, known: DataFrame) -> DataFrame:
    """items (item), values (item, id), known (id): whether any value of an item resolves. Values stay rows."""
    hit = values.join(known.select("id").distinct(), "id", "left_semi").select("item").distinct()
    return items.join(hit.withColumn("resolved", F.lit(True)), "item", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
