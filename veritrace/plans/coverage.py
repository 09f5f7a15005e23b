"""The final coverage report: one labelled frame, every metric from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent
from ..operators import linking, metrics, traceability
from ..sources import sinks

AMBIGUOUS = "Ambiguous / not yet plannable"


def report(requirements: DataFrame, tests: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """requirements (requirement_id), tests (requirement_id, label, complete), evidence (requirement_id).
    A caller that uses several of the frames may persist `labelled` first; none is cached here."""
    labelled = linking.verify(requirements, tests, evidence)
    covered = F.col("verified_status").isin("Covered", "Partially covered")
    return {
        "labelled": labelled,
        "mapping": metrics.rate(labelled, F.col("n_rows") > 0),
        "weighted": metrics.weighted(labelled),
        "testability": metrics.rate(labelled.where("n_rows > 0"), covered),
        "ambiguous": metrics.rate(labelled, (F.col("verified_status") == AMBIGUOUS) | ((F.col("verified_status") == "Uncovered") & F.col("ambiguous"))),
        "orphans": metrics.rate(metrics.flagged(tests, requirements, "requirement_id"), ~F.col("hit")),
        "status": metrics.status_counts(labelled),
        "gaps": labelled.where("verified_status <> 'Covered'"),
    }


def any_uncovered(values: Column) -> Column:
    return F.coalesce(F.exists(values, lambda v: F.lower(F.trim(v)).isin("uncovered", "not covered", "not_covered")), F.lit(False))


def ambiguity_uncovered(labelled: DataFrame) -> Column:
    """An ambiguous status, or an original label uncovered together with evidence of ambiguity."""
    doubt = (F.size("linked_edge_cases") > 0) | (F.size("linked_weak_word_flags") > 0)
    return F.lower("verified_coverage_status").isin("ambiguous", AMBIGUOUS.lower()) | (any_uncovered(F.col("original_vplan_coverage_values")) & doubt)


def ambiguity_rate(requirements: DataFrame, labelled: DataFrame) -> DataFrame:
    """Share of specification rows whose labelled requirement is uncovered because of ambiguity."""
    hit = labelled.where(ambiguity_uncovered(labelled)).select("requirement_id")
    return metrics.rate(metrics.flagged(requirements, hit, "requirement_id"), F.col("hit"))


def granularity_rate(assessments: DataFrame, good: str = "suitable_detail", label: str = "label") -> DataFrame:
    """Share of assessed requirements with plan rows (not not_mapped) that have the good label."""
    return metrics.rate(assessments.where(F.col(label) != "not_mapped"), F.col(label) == good)


def weighted_rows(labelled: DataFrame) -> DataFrame:
    """Each labelled requirement's status and weight."""
    status = linking.canonical_status(F.col("verified_coverage_status"))
    return labelled.select("requirement_id", status.alias("status"), linking.status_weight(status).alias("coverage_score"))


def both_sides(requirements: DataFrame, plan: DataFrame) -> DataFrame:
    """One row of counts: of requirements, all and those with a plan row; of plan rows, all, those whose
    requirement does not exist, and those with a filled trace field. Each table is read once: both are counted by id,
    and the counts meet. Rows without an id meet nothing."""
    own = requirements.groupBy("requirement_id").agg(F.count("*").alias("specs"))
    rows = plan.groupBy("requirement_id").agg(F.count("*").alias("rows"), F.count_if(traceability.has_field_trace(plan, True)).alias("traced"))
    total = lambda c, name, when=None: F.coalesce(F.sum(F.when(when, F.col(c)) if when is not None else F.col(c)), F.lit(0)).alias(name)
    return own.join(rows, "requirement_id", "full").agg(total("specs", "total_spec_items"), total("specs", "mapped", F.col("rows") > 0), total("rows", "vplan_items"), total("rows", "orphan_vplan_items", F.col("specs").isNull()), total("traced", "traced"))


def final_report(requirements: DataFrame, plan: DataFrame, labelled: DataFrame) -> dict[str, DataFrame]:
    """The report's parts: summary (one row), percentages (one row), gaps, ambiguity, and the rows behind them.

    requirements: (requirement_id, …); plan: its rows with trace fields; labelled: linking.verified."""
    status = linking.canonical_status(F.col("verified_coverage_status"))
    is_a = lambda s: F.count_if(status == s)
    sides = both_sides(requirements, plan)
    linked = F.size("linked_tests") > 0
    good = status.isin("Covered", "Partially covered")
    one = labelled.agg(
        is_a("Covered").alias("covered"), is_a("Partially covered").alias("partially_covered"), F.count_if(~status.isin("Covered", "Partially covered", AMBIGUOUS)).alias("uncovered"), is_a(AMBIGUOUS).alias("ambiguity_uncovered"),
        percent(F.coalesce(F.sum((linking.status_weight(status) * 2).cast("bigint")), F.lit(0)), F.count("*") * 2).alias("weighted_coverage"), percent(F.count_if(linked & good), F.count_if(linked)).alias("testability_coverage"),
    )
    every = one.withColumn("_s", sides.select(F.struct("*")).scalar())
    summary = every.select(F.col("_s.total_spec_items"), "covered", "partially_covered", "uncovered", "ambiguity_uncovered", F.col("_s.orphan_vplan_items"))
    share = lambda part, of: percent(F.col(f"_s.{part}"), F.col(f"_s.{of}"))
    shares = every.select(share("mapped", "total_spec_items").alias("requirement_mapping_coverage"), "weighted_coverage", share("traced", "vplan_items").alias("traceability_coverage"), "testability_coverage", share("orphan_vplan_items", "vplan_items").alias("orphan_rate"))
    fields = [c for c in ("source_section", "text") if c in labelled.columns]
    rows = labelled.select("requirement_id", *fields, status.alias("coverage_status"), "linked_tests", F.col("coverage_verification_reason").alias("reason"), "linked_edge_cases", "linked_weak_word_flags")
    doubt = (F.size("linked_edge_cases") > 0) | (F.size("linked_weak_word_flags") > 0)
    return {
        "coverage_summary": summary, "coverage_percentages": shares, "gap_report": rows.where("coverage_status <> 'Covered'").drop("linked_edge_cases", "linked_weak_word_flags"), "ambiguity_report": rows.where((F.col("coverage_status") == AMBIGUOUS) | doubt),
        "unmapped_requirements": linking.unmapped(requirements, plan, "requirement_id", "requirement_id"), "orphan_items": plan.join(requirements.select("requirement_id").distinct(), "requirement_id", "left_anti"), "weighted_rows": weighted_rows(labelled),
        "not_testable_items": rows.where(F.size("linked_tests") > 0).where(~F.col("coverage_status").isin("Covered", "Partially covered")), "untraceable_items": plan.where(~traceability.has_field_trace(plan, True)),
    }


def enriched(parts: dict[str, DataFrame], ambiguity: DataFrame, granularity: DataFrame) -> dict[str, DataFrame]:
    """The report with the ambiguity-related rate and the granularity adequacy (each a rate) among its percentages."""
    more = {"ambiguity_uncovered_rate": ambiguity.select("percentage").scalar(), "granularity_adequacy": granularity.select("percentage").scalar()}
    return parts | {"coverage_percentages": parts["coverage_percentages"].withColumns(more)}


def write_report(parts: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """The report's four files: summary (counts and percentages), gaps, ambiguity, and the rows behind the metrics."""
    both = parts["coverage_summary"].select(F.struct("*").alias("coverage_summary")).withColumn("coverage_percentages", parts["coverage_percentages"].select(F.struct("*")).scalar())
    metric = None
    for name in ("unmapped_requirements", "orphan_items", "weighted_rows", "not_testable_items", "untraceable_items"):
        rows = parts[name].select(F.lit(name).alias("metric"), F.to_json(F.struct("*")).alias("row"))
        metric = rows if metric is None else metric.union(rows)
    out = {"coverage_summary": both, "gap_report": parts["gap_report"], "ambiguity_report": parts["ambiguity_report"], "supporting_metrics": metric}
    for name, df in out.items():
        sinks.write_json(df, f"{folder}/{name}.json")
    return {name: f"{folder}/{name}.json" for name in out}


def coverage_csv(labelled: DataFrame, path: str) -> None:
    """Labelled requirements as CSV, lists joined by a comma and a space, the overall score on each row."""
    score = metrics.weighted(labelled.withColumn("_s", linking.canonical_status(F.col("verified_coverage_status"))), "_s").select("percentage").scalar()
    rows = labelled.select("requirement_id", linking.canonical_status(F.col("verified_coverage_status")).alias("status"), linking.status_weight(linking.canonical_status(F.col("verified_coverage_status"))).alias("coverage_score"), "linked_tests", F.col("coverage_verification_reason").alias("reason")).withColumn("overall_coverage", score)
    sinks.write_csv(rows, path, rows.columns)
