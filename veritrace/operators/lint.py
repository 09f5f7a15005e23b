"""Wording checks of requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.text import present, strip, terms_of

WEAK, MISSING = "weak_or_optional_language", "missing_strong_requirement_language"
_MESSAGES = {
    WEAK: "Requirement contains weak or optional wording. Do not infer mandatory behaviour unless it is explicitly stated.",
    MISSING: "Requirement does not contain strong requirement wording such as must, shall, should, required, or requires.",
}


def display_text(text: Column, description: Column) -> Column:
    """Text and description, each once, blanks left out."""
    return F.array_join(F.array_distinct(F.filter(F.array(strip(text), strip(description)), present)), " ")


def source_section(requirement_id: Column, *fields: Column) -> Column:
    """The first filled field, or what the id says: REQ_a2_1_003 gives A2.1.003; null without either."""
    derived = F.upper(F.translate(F.regexp_extract(F.coalesce(requirement_id, F.lit("")), r"(?i)REQ_([A-Z]+\d+(?:_\d+)*)", 1), "_", "."))
    return F.coalesce(*[F.when(present(f), strip(f)) for f in fields], F.nullif(derived, F.lit("")))


def check_language(requirements: DataFrame, text: str = "text", weak: list[str] = terms.WEAK_WORDS, strong: list[str] = terms.STRONG_WORDS) -> DataFrame:
    """Up to two issues per requirement: weak wording with its terms, and no strong wording."""
    none = F.array().cast("array<string>")
    issue = lambda kind, words: F.struct(F.lit(kind).alias("issue_type"), words.alias("matched_words"), F.lit(_MESSAGES[kind]).alias("message"))
    issues = lambda found: F.array_compact(F.array(F.when(F.size(found[0]) > 0, issue(WEAK, found[0])), F.when(F.size(found[1]) == 0, issue(MISSING, none))))
    return requirements.withColumn("_issue", F.explode(terms_of(F.col(text), [weak, strong], issues))).select(*requirements.columns, "_issue.*")


def flagged(requirements: DataFrame, issues: DataFrame, on: str = "id") -> DataFrame:
    """Requirements with an issue; one without an id is never flagged, though its issues exist."""
    return requirements.where(F.col(on).isNotNull()).join(issues.select(F.col("requirement_id").cast("string").alias("_id")).distinct(), F.col(on).cast("string") == F.col("_id"), "left_semi")


def language_report(requirements: DataFrame, weak: list[str] = terms.WEAK_WORDS, strong: list[str] = terms.STRONG_WORDS) -> DataFrame:
    """Issues as the report has them: (requirement_id, requirement_text, source_section, issue_type,
    matched_words, message); a row without an id is UNKNOWN, one without text has no issue."""
    null = F.lit(None).cast("string")
    has = lambda c: F.col(c) if c in requirements.columns else null
    rows = requirements.select(F.coalesce(F.nullif(has("id").cast("string"), F.lit("")), F.lit("UNKNOWN")).alias("requirement_id"), display_text(F.coalesce(has("text"), F.lit("")), F.coalesce(has("description"), F.lit(""))).alias("requirement_text"), source_section(has("id"), has("source_section"), has("section"), has("chapter")).alias("source_section"))
    return check_language(rows.where("requirement_text <> ''"), "requirement_text", weak, strong)


def summary_lines(issues: DataFrame, shown: int = 50) -> list[str]:
    """A console summary: the number of issues, the first of them, and how many more there are."""
    total = issues.count()
    rows = issues.select("requirement_id", "issue_type", "matched_words").orderBy("requirement_id", "issue_type").limit(shown).collect()
    said = [f"- {r.requirement_id}: " + (f"weak language found ({', '.join(r.matched_words)})" if r.issue_type == WEAK else "missing strong requirement language") for r in rows]
    more = [f"... {total - shown} additional language issues saved to the JSON report."] if total > shown else []
    return [f"Language issues found: {total}", *said, *more]
