"""Source traces of plan rows: whether a row cites anything, and whether that exists in the specification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_walk
from ..functions.terms import TRACE_FIELDS, TRACE_PATTERNS
from ..functions.text import strip
from .metrics import rate

#: Patterns whose matches are trace values (a page in free text is a trace, but names no source).
_VALUE_PATTERNS = ("requirement", "section", "table", "figure")


def has_content(record: Column) -> Column:
    """Whether a Variant holds text or a number at any depth: blank strings, nulls and empty brackets are none."""
    return F.coalesce(F.exists(json_walk.leaves(F.to_json(record)), lambda x: strip(x) != ""), F.lit(False))


def has_field_trace(plan: DataFrame, blank_counts: bool) -> Column:
    """Whether one of the trace fields that plan has as columns is filled. Of arrays, any element; with
    blank_counts a blank string and an array of blanks count too (null, "" and [] never do)."""
    hits = F.lit(False)
    for name in TRACE_FIELDS:
        if name not in plan.columns:
            continue
        c = F.col(name)
        if plan.schema[name].dataType.typeName() == "array":
            held = F.size(c) > 0 if blank_counts else F.exists(c, lambda x: F.coalesce(strip(x.cast("string")) != "", F.lit(False)))
        else:
            held = c.cast("string") != "" if blank_counts else strip(c.cast("string")) != ""
        hits = hits | F.coalesce(held, F.lit(False))
    return hits


def has_text_trace(text: Column) -> Column:
    """Whether free text cites a section, requirement, table, figure or page."""
    hits = F.lit(False)
    for name, pattern in TRACE_PATTERNS.items():
        hits = hits | text.rlike(pattern if name in ("section", "requirement") else "(?i)" + pattern)
    return F.coalesce(hits, F.lit(False))


def row_text(plan: DataFrame) -> Column:
    """A plan row as JSON text, nulls left out."""
    return F.to_json(F.struct(*[F.col(c) for c in plan.columns]))


def headline(plan: DataFrame) -> DataFrame:
    """Traceability as the final report counts it: any filled trace field; a blank one counts."""
    return rate(plan.select(has_field_trace(plan, True).alias("traced")), F.col("traced"))


def traced(plan: DataFrame) -> DataFrame:
    """plan with `traced`: a trace field with content, or a citation anywhere in the row's text."""
    return plan.withColumn("traced", has_field_trace(plan, False) | has_text_trace(row_text(plan)))


def drill_down(plan: DataFrame) -> DataFrame:
    return rate(traced(plan), F.col("traced"))


def source_ids(requirements: DataFrame | None = None, sections: DataFrame | None = None, tables: DataFrame | None = None, figures: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(kind, id) of everything a row may trace to; entities have an id, pages a page_number."""
    parts = [d.select(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("id")) for kind, name, d in (("requirement", "id", requirements), ("section", "id", sections), ("table", "id", tables), ("figure", "id", figures), ("page", "page_number", pages)) if d is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("id is not null and id <> ''").distinct()


def bare_reference(c: Column) -> Column:
    """Table A2.1 as A2.1."""
    return strip(F.regexp_replace(strip(c), r"(?i)^(table|figure)\s+", ""))


def trace_values(plan: DataFrame, item: str) -> DataFrame:
    """(item, value) of a plan row's trace fields and of the citations in its text; long, never collected."""
    found = F.array().cast("array<string>")
    for name in TRACE_FIELDS:
        if name in plan.columns:
            c = F.col(name)
            each = F.transform(c, lambda x: x.cast("string")) if plan.schema[name].dataType.typeName() == "array" else F.array(c.cast("string"))
            found = F.concat(found, F.coalesce(each, F.array().cast("array<string>")))
    text = row_text(plan)
    for name in _VALUE_PATTERNS:
        pattern = TRACE_PATTERNS[name] if name in ("section", "requirement") else "(?i)" + TRACE_PATTERNS[name]
        found = F.concat(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return plan.select(F.col(item).alias("item"), F.explode(found).alias("value")).where(strip(F.col("value")) != "").select("item", strip(F.col("value")).alias("value"))


def resolved(items: DataFrame, values: DataFrame, known: DataFrame) -> DataFrame:
    """items (item) with `linked`: whether any of its values names a source, or does so without the
    word table or figure before it (not for requirements and pages). Values meet known by hash, each value
    of an item once; a value that very many items cite is one row of known, joined to all of them."""
    plain = values.select("item", F.col("value").alias("id"), F.lit(False).alias("bare")).union(values.select("item", bare_reference(F.col("value")).alias("id"), F.lit(True))).distinct()
    ids = known.groupBy("id").agg(F.bool_or(F.col("kind").isin("section", "table", "figure")).alias("bare_ok"))
    hit = plain.join(ids, "id").where("not bare or bare_ok").select("item").distinct().withColumn("linked", F.lit(True))
    return items.join(hit, "item", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def orphan_rate(plan: DataFrame, item: str, known: DataFrame) -> DataFrame:
    """Share of plan rows none of whose trace values resolves."""
    out = resolved(plan.select(F.col(item).alias("item")), trace_values(plan, item), known)
    return rate(out, ~F.col("linked"))
