"""The whole difference of two versions of a document, as numbered change rows.

A version is a dict of frames: metadata (key, value), sections (pos, id, title), requirements and notes
(pos, text, page, section), figures (pos, caption, page, section), tables (pos, table_text, preview, page,
section; cells: pos, row, cells), pages (pos, page, text). Absent entities are empty. Changes go by
area, then phase (moved, modified, removed, added), then the order of the phase.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.patterns import REPORT_LAYOUT
from ..functions.similarity import first_change, ratio_bound, similarity, similarity_from
from ..functions.text import clean, comparison_text, first_present, stable_hash
from ..sources.shared import settled
from . import diff, ordering

AREAS = ["metadata", "section", "requirement", "note", "figure", "table", "page"]
PHASES = ["structural", "moved", "modified", "removed", "added"]
METADATA_KEYS = ["title", "version", "revision"]
COLUMNS = ["area", "change_type", "difference_category", "identifier", "section", "page", "old_page", "new_page", "preview", "display_title", "old_value", "new_value", "detail", "similarity", "similarity_score", "page_shift"]
_SCHEMA = "area string, change_type string, difference_category string, identifier string, section string, page string, old_page string, new_page string, preview string, display_title string, old_value string, new_value string, detail string, similarity double, similarity_score double, page_shift int, _place array<long>, _key string"


def _change(rows: DataFrame, area: str, kind: str, place: list[Column], key: Column | None = None, **fields: Column) -> DataFrame:
    """rows as change rows; place orders them within their phase (key first, if given)."""
    c = {k: F.lit(None) for k in COLUMNS} | {"area": F.lit(area), "change_type": F.lit(kind), "old_value": F.lit(""), "new_value": F.lit("")} | fields
    types = dict(x.split(" ") for x in _SCHEMA.split(", ")[: len(COLUMNS)])
    return rows.select(*[c[k].cast(types[k]).alias(k) for k in COLUMNS], F.array(*[p.cast("long") for p in place]).alias("_place"), (key if key is not None else F.lit("")).alias("_key"))


def metadata_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Title, version and revision whose clean values differ; absent is empty."""
    side = lambda df, v: df.where(F.lower("key").isin(METADATA_KEYS)).select("key", clean(F.col("value")).alias(v))
    both = side(old, "a").join(side(new, "b"), "key", "full").fillna("", ["a", "b"]).where("a <> b")
    return _change(both, "metadata", "modified", [], F.col("key"), difference_category=F.lit("metadata_change"), identifier=F.col("key"), old_value=F.col("a"), new_value=F.col("b"), detail=F.concat(F.lit("Metadata field changed: "), "key"))


def keyed_sections(sections: DataFrame) -> DataFrame:
    """(key, title, …): the id, else the title's hash and place; a key that repeats gets its place too."""
    key = F.coalesce(F.nullif(clean(F.col("id")), F.lit("")), F.concat(F.lit("title:"), stable_hash(F.col("title")), F.lit(":"), F.col("pos").cast("string")))
    out = ordering.numbered(sections.withColumn("key", key), ["key"], ["pos"], "_n")
    return out.withColumn("key", F.when(F.col("_n") == 1, F.col("key")).otherwise(F.concat("key", F.lit(":"), F.col("pos").cast("string")))).drop("_n")


def _class(old: Column, new: Column, score: Column) -> Column:
    return diff.change_class(old, new, score)


def section_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    a = keyed_sections(old).select("key", F.col("title").alias("a"), F.lit(True).alias("has_a"))
    b = keyed_sections(new).select("key", F.col("title").alias("b"), F.lit(True).alias("has_b"))
    both = a.join(b, "key", "full")
    one = lambda kind, rows, value: _change(rows, "section", kind, [], F.col("key"), difference_category=F.lit(f"section_{kind}"), identifier=F.col("key"), section=F.col("key"), detail=F.lit(f"{kind.title()} section"), **value)
    changed = both.where("has_a and has_b").where(clean(F.col("a")) != clean(F.col("b"))).withColumn("score", similarity(comparison_text(F.col("a")), comparison_text(F.col("b"))))
    modified = _change(changed, "section", "modified", [], F.col("key"), difference_category=_class(F.col("a"), F.col("b"), F.col("score")), identifier=F.col("key"), section=F.col("key"), old_value=clean(F.col("a")), new_value=clean(F.col("b")))
    return one("added", both.where("has_a is null"), {"new_value": clean(F.col("b"))}).union(one("removed", both.where("has_b is null"), {"old_value": clean(F.col("a"))})).union(modified)


def acronym_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(acronym) of each side: added and removed ones, each once."""
    side = lambda df: df.select(clean(F.col("acronym")).alias("acronym")).distinct()
    a, b = side(old), side(new)
    one = lambda kind, rows, **v: _change(rows, "acronym", kind, [], F.col("acronym"), difference_category=F.lit(f"acronym_{kind}"), identifier=F.col("acronym"), detail=F.lit(f"{kind.title()} acronym"), **v)
    return one("added", b.join(a, "acronym", "left_anti"), new_value=F.col("acronym")).union(one("removed", a.join(b, "acronym", "left_anti"), old_value=F.col("acronym")))


def matched(old: DataFrame, new: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of records (of diff.records): exact ones (old_pos, new_pos), and similar ones of the rest,
    one to one, with their score (similarity). Empty records match nothing."""
    full = lambda df: df.where("content <> ''")
    exact = settled(diff.exact_pairs(full(old), full(new), "hash", "pos", hashed=True).select("old_pos", "new_pos"))
    rest = lambda df, p: full(df).join(exact.select(F.col(p).alias("pos")), "pos", "left_anti")
    a, b = rest(old, "old_pos"), rest(new, "new_pos")
    a = settled(diff.contenders(a, "content", "pos", of="normalized", length="length"))
    pairs = diff.similarities(diff.candidates(a, b, "content", "pos", tokens="tokens"), a, b, "content", "pos", limit, of="normalized", tokens="tokens", length="length")
    return exact, diff.one_to_one(settled(pairs)).select("old_pos", "new_pos", "similarity")


def table_difference(old: DataFrame, new: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs of tables (old_pos, new_pos), how their cells differ: (old_pos, new_pos, detail, old_cells,
    new_cells, context). old and new: (pos, row from 1, cells). With unequal numbers of rows, the first row
    that only one side has counts, unless a cell before it differs is no matter: it wins."""
    side = lambda df, p, n: df.select(F.col("pos").alias(p), "row", F.col("cells").alias(n))
    a, b = pairs.select("old_pos", "new_pos").join(side(old, "old_pos", "a"), "old_pos"), pairs.select("old_pos", "new_pos").join(side(new, "new_pos", "b"), "new_pos")
    rows = a.join(b, ["old_pos", "new_pos", "row"], "full")
    line = lambda c: F.array_join(c, " | ")
    cell = lambda c, i: F.coalesce(F.get(F.col(c), i), F.lit(""))
    wide = F.greatest(F.size("a"), F.size("b"))
    each = F.transform(F.sequence(F.lit(0), wide - 1), lambda i: F.struct(F.col("row").alias("row"), (i + 1).alias("col"), cell("a", i).alias("a"), cell("b", i).alias("b")))
    cells = F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & (wide > 0), F.filter(each, lambda x: clean(x["a"]) != clean(x["b"])))
    per = rows.withColumn("cells", cells).groupBy("old_pos", "new_pos").agg(
        F.count("a").alias("n_a"), F.count("b").alias("n_b"),
        F.min(F.when(F.col("a").isNull(), F.struct("row", line(F.col("b")).alias("text")))).alias("added"), F.min(F.when(F.col("b").isNull(), F.struct("row", line(F.col("a")).alias("text")))).alias("removed"),
        F.array_sort(F.flatten(F.collect_list("cells"))).alias("cells"), F.min(F.when(F.size("cells") > 0, F.struct("row", line(F.col("b")).alias("text")))).alias("first"),
    ).where("n_a > 0 and n_b > 0")
    told = lambda r: F.concat(F.lit("Row "), r["row"].cast("string"), F.lit(": "), r["text"])
    one = F.get("cells", F.lit(0))
    listed = lambda side: F.array_join(F.transform("cells", lambda x: F.concat(F.lit("[row "), x["row"].cast("string"), F.lit(", col "), x["col"].cast("string"), F.lit("] "), x[side])), "\n")
    pick = lambda added, removed, single, many: F.when(F.col("added").isNotNull(), added).when(F.col("removed").isNotNull(), removed).when(F.size("cells") == 1, single).when(F.size("cells") > 1, many)
    out = per.select(
        "old_pos", "new_pos",
        pick(F.lit("Row added"), F.lit("Row removed"), F.concat(F.lit("Cell changed (row "), one["row"].cast("string"), F.lit(", col "), one["col"].cast("string"), F.lit(")")), F.concat(F.size("cells").cast("string"), F.lit(" cells changed"))).alias("detail"),
        pick(F.lit(""), F.col("removed.text"), one["a"], listed("a")).alias("old_cells"), pick(F.col("added.text"), F.lit(""), one["b"], listed("b")).alias("new_cells"),
        pick(told(F.col("added")), told(F.col("removed")), told(F.col("first")), told(F.col("first"))).alias("context"),
    )
    return out.where("detail is not null")


def area_changes(old: DataFrame, new: DataFrame, area: str, relocation: bool, cells: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Changes of a content area; old and new are diff.records."""
    old, new = settled(old), settled(new)
    exact, similar = matched(old, new, terms.MATCH_LIMITS[area])
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("pos", "content", "normalized", "page", "section", "preview")])
    join = lambda pairs: pairs.join(side(old, "old"), "old_pos").join(side(new, "new"), "new_pos")
    title = lambda kind: F.lit(f"{area.title()} {kind}")
    parts = []
    if relocation:
        moved = join(exact).where(~F.col("old_page").eqNullSafe(F.col("new_page")) | (clean(F.col("old_section")) != clean(F.col("new_section"))))
        parts.append(_change(moved, area, "moved", [F.col("old_pos")], stable_hash(F.col("old_normalized")), difference_category=F.lit(f"{area}_moved"), identifier=F.col("old_preview"), section=first_present(F.col("new_section"), F.col("old_section")), page=F.col("new_page"), old_page=F.col("old_page"), new_page=F.col("new_page"), preview=F.col("old_preview"), display_title=title("moved"), detail=F.lit("Content unchanged")))
    changed = join(similar)
    if cells:
        changed = changed.join(table_difference(*cells, similar), ["old_pos", "new_pos"], "left")
    else:
        none = F.lit(None).cast("string")
        changed = changed.withColumns({"detail": none, "old_cells": none, "new_cells": none, "context": none})
    preview = first_present(F.col("context"), F.col("new_preview"), F.col("old_preview"))
    parts.append(_change(
        changed, area, "modified", [-F.round(F.col("similarity") * 10_000), F.col("old_pos")], difference_category=_class(F.col("old_normalized"), F.col("new_normalized"), F.col("similarity")), identifier=preview,
        section=first_present(F.col("new_section"), F.col("old_section")), page=F.coalesce("new_page", "old_page"), old_page=F.col("old_page"), new_page=F.col("new_page"), preview=preview, display_title=title("modified"),
        old_value=clean(F.coalesce("old_cells", "old_content")), new_value=clean(F.coalesce("new_cells", "new_content")), detail=F.col("detail"), similarity_score=F.col("similarity"),
    ))
    pairs = exact.union(similar.select("old_pos", "new_pos"))
    for kind, df, p, value in (("removed", old, "old", "old_value"), ("added", new, "new", "new_value")):
        left = df.join(pairs.select(F.col(f"{p}_pos").alias("pos")), "pos", "left_anti")
        parts.append(_change(left, area, kind, [F.col("pos")], difference_category=F.lit(f"{area}_{kind}"), identifier=F.col("preview"), section=F.col("section"), page=F.col("page"), preview=F.col("preview"), display_title=title(kind), detail=F.lit(f"{kind.title()} {area}"), **{value: F.col("content"), f"{p}_page": F.col("page")}))
    return reduce(DataFrame.union, parts)


def _range(low: Column, high: Column) -> Column:
    return F.when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("–"), high.cast("string")))


def page_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of pages (diff.records): matched pages say by how much pages moved, if three agree; the
    rest meet the page that far on and count as modified if similar enough; others are removed or added."""
    old, new = settled(old), settled(new)
    exact, similar = matched(old, new, terms.MATCH_LIMITS["page"])
    pairs = settled(exact.union(similar.select("old_pos", "new_pos")))
    pages = pairs.join(old.select(F.col("pos").alias("old_pos"), F.col("page").alias("old_page")), "old_pos").join(new.select(F.col("pos").alias("new_pos"), F.col("page").alias("new_page")), "new_pos").where("old_page <> new_page")
    shift = settled(ordering.most_common_offset(pages, "old_page", "new_page", order="old_pos"))
    told = pages.join(shift, F.col("new_page") - F.col("old_page") == F.col("offset")).groupBy("offset").agg(F.min("old_page").alias("low"), F.max("old_page").alias("high"))
    a, b, moved = _range(F.col("low"), F.col("high")), _range(F.col("low") + F.col("offset"), F.col("high") + F.col("offset")), F.format_string("%+d", "offset")
    detail = F.concat(F.lit("Structural page shift detected. Pages "), a, F.lit(" were renumbered by "), moved, F.lit(". Content was matched successfully."))
    out = [_change(told, "page", "moved", [F.lit(-1)], difference_category=F.lit("structural_page_shift"), identifier=F.lit("Structural page shift"), old_page=a, new_page=b, page_shift=F.col("offset"), detail=detail, display_title=F.lit("Structural page shift detected"))]
    rest = lambda df, p: df.join(pairs.select(F.col(f"{p}_pos").alias("pos")), "pos", "left_anti")
    by = F.coalesce(shift.agg(F.max("offset").alias("by")).select("by").scalar(), F.lit(0))
    last = new.where("page is not null").groupBy("page").agg(F.max("pos").alias("pos"))  # of pages of one number, the last
    targets = rest(new, "new").join(last, ["page", "pos"]).select(F.col("page").alias("new_page"), F.col("pos").alias("new_pos"), F.col("content").alias("new_content"), F.col("normalized").alias("new_normalized"))
    sources = rest(old, "old").where("page is not null").select(F.col("page").alias("old_page"), F.col("pos").alias("old_pos"), F.col("content").alias("old_content"), F.col("normalized").alias("old_normalized"))
    met = sources.join(targets, F.col("old_page") + by == F.col("new_page")).withColumns({"_a": comparison_text(F.col("old_normalized")), "_b": comparison_text(F.col("new_normalized"))})
    met = met.where(ratio_bound(F.length("_a"), F.length("_b")) >= terms.MATCH_LIMITS["page"]).withColumn("score", similarity_from(terms.MATCH_LIMITS["page"])(F.col("_a"), F.col("_b"))).where("score is not null").drop("_a", "_b")
    met = settled(met.withColumn("_n", F.row_number().over(Window.partitionBy("new_pos").orderBy("old_pos"))).where("_n = 1"))
    out.append(_change(met, "page", "modified", [F.col("old_pos")], difference_category=_class(F.col("old_normalized"), F.col("new_normalized"), F.col("score")), identifier=F.concat(F.lit("Page "), F.col("old_page").cast("string")), page=F.col("new_page"), old_page=F.col("old_page"), new_page=F.col("new_page"), display_title=F.lit("Page modified"), old_value=F.col("old_content"), new_value=F.col("new_content"), similarity_score=F.col("score")))
    for kind, df, p in (("removed", old, "old"), ("added", new, "new")):
        left = rest(df, p).join(met.select(F.col(f"{p}_pos").alias("pos")), "pos", "left_anti")
        out.append(_change(left, "page", kind, [F.col("pos")], difference_category=F.lit(f"page_{kind}"), identifier=F.concat(F.lit("Page "), F.coalesce(F.col("page").cast("string"), F.lit("None"))), page=F.col("page"), display_title=F.lit(f"Page {kind}"), detail=F.lit(f"{kind.title()} page"), **{f"{p}_page": F.col("page")}))
    return reduce(DataFrame.union, out)


def completed(changes: DataFrame) -> DataFrame:
    """Changes with detail, similarity and numbers CHG-0001, … in their order."""
    ends = first_change(comparison_text(F.col("old_value")), comparison_text(F.col("new_value")))
    out = changes.withColumn("_c", F.when(F.col("detail").isNull(), ends)).withColumn("similarity", similarity(comparison_text(F.col("old_value")), comparison_text(F.col("new_value"))))
    said = F.when((F.col("_c.old") != "") | (F.col("_c.new") != ""), F.concat(F.lit("Changed '"), "_c.old", F.lit("' to '"), "_c.new", F.lit("'"))).otherwise(F.replace("change_type", F.lit("_"), F.lit(" ")))
    out = out.withColumn("detail", F.coalesce("detail", said)).drop("_c")
    phase = lambda c: F.when(F.col("area").isin("metadata", "section"), 0).otherwise(F.array_position(F.array(*map(F.lit, PHASES)), c))
    out = out.withColumns({"_area": F.array_position(F.array(*map(F.lit, [*AREAS, "acronym"])), F.col("area")), "_phase": phase(F.when(F.col("difference_category") == "structural_page_shift", "structural").otherwise(F.col("change_type"))), "_all": F.lit(0)})
    out = ordering.ranked(settled(out), ["_all"], ["_area", "_phase", "_key", "_place", "identifier"], "_n")
    return out.select(F.concat(F.lit("CHG-"), F.format_string("%04d", "_n")).alias("change_id"), F.col("_n").alias("change_number"), *COLUMNS)


def compare(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """All changes from old to new."""
    null = F.lit(None).cast("string")

    def both(entity: str, make):
        return [make(v[entity]) for v in (old, new)] if entity in old and entity in new else None

    def column(df: DataFrame, name: str) -> Column:
        return F.col(name) if name in df.columns else null

    def texts(field: str, label: str):
        short = clean(F.col(field))
        preview = F.when(short == "", label).when(F.length(short) <= 120, short).otherwise(F.concat(F.substring(short, 1, 117), F.lit("...")))
        whole = F.coalesce(F.nullif(short, F.lit("")), F.lit(label)) if label == "Figure" else preview
        return lambda df: diff.records(df, F.col(field), whole, "pos", column(df, "page"), column(df, "section"))

    parts = []
    if pair := both("metadata", lambda d: d):
        parts.append(metadata_changes(*pair))
    if pair := both("sections", lambda d: d):
        parts.append(section_changes(*pair))
    for entity, area, make, relocation in (("requirements", "requirement", texts("text", "Requirement"), False), ("notes", "note", texts("text", "Note"), True), ("figures", "figure", texts("caption", "Figure"), True)):
        if pair := both(entity, make):
            parts.append(area_changes(*pair, area, relocation))
    if pair := both("tables", lambda d: diff.records(d, F.col("table_text"), F.coalesce(F.nullif(column(d, "preview"), F.lit("")), F.lit("Table")), "pos", column(d, "page"), column(d, "section"))):
        parts.append(area_changes(*pair, "table", True, both("cells", lambda d: d)))
    if pair := both("pages", texts("text", "Page")):
        parts.append(page_changes(*pair))
    return completed(reduce(DataFrame.union, parts))


def table_texts(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """tables with table_text (rows by line, cells by a bar, else what else names the table) and preview
    (the first four filled cells of the first such row, else the caption)."""
    per = cells.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("_rows"))
    lines = F.array_join(F.transform("_rows", lambda r: F.array_join(r["cells"], " | ")), "\n")
    filled = F.filter(F.transform("_rows", lambda r: F.filter(r["cells"], lambda c: c != "")), lambda r: F.size(r) > 0)
    names = [clean(F.col(c)) for c in ("caption", "title", "text", "ocr_text", "accessibility_description") if c in tables.columns]
    other = F.array_join(F.filter(F.array(*names) if names else F.array().cast("array<string>"), lambda x: x != ""), " ")
    caption = F.coalesce(F.nullif(clean(F.col("caption")), F.lit("")), F.lit("Table")) if "caption" in tables.columns else F.lit("Table")
    head = F.coalesce(F.array_join(F.slice(F.get(filled, F.lit(0)), 1, 4), " | "), F.lit("Table"))
    return tables.join(per, "pos", "left").withColumn("table_text", F.when(F.col("_rows").isNotNull(), lines).otherwise(other)).withColumn("preview", F.when(F.col("_rows").isNotNull(), head).otherwise(caption)).drop("_rows")


def bucket(changes: DataFrame) -> Column:
    """Where a report lists a change."""
    area, kind, category = F.col("area"), F.col("change_type"), F.col("difference_category")
    content = kind.isin("added", "removed", "modified")
    out = F.when((area == "requirement") & (category == "numeric_value_change"), "numeric_changes").when((area == "requirement") & (category == "requirement_strength_change"), "requirement_strength_changes").when(area == "requirement", "requirement_changes")
    for name in ("table", "figure", "note"):
        out = out.when((area == name) & content, f"modified_{name}s").when((area == name) & (kind == "moved"), f"moved_{name}s")
    for name in ("section", "page"):
        for what in ("added", "removed"):
            out = out.when((area == name) & (kind == what), f"{name}s_{what}")
    out = out.when(category == "structural_page_shift", "page_shifts")
    key = F.lower(clean(F.col("identifier")))
    return out.when((area == "metadata") & key.isin(METADATA_KEYS), F.concat(F.lit("metadata_"), key)).otherwise("requirement_changes")


def report_groups(changes: DataFrame) -> DataFrame:
    """All groups of a report in their order, the empty ones too: (place, heading, label, bucket, n)."""
    layout = changes.sparkSession.createDataFrame([(i, *row) for i, row in enumerate(REPORT_LAYOUT)], "place int, heading string, label string, bucket string")
    counts = changes.groupBy(bucket(changes).alias("bucket")).agg(F.count("*").alias("n"))
    return layout.join(counts, "bucket", "left").fillna(0, ["n"]).select("place", "heading", "label", "bucket", "n")


def counts(changes: DataFrame) -> DataFrame:
    """Numbers of changes by area, by type and by category, in one pass: (by, value, n), largest first."""
    by = ["area", "change_type", "difference_category"]
    got = changes.groupingSets([[b] for b in by], *by).agg(F.count("*").alias("n"), F.grouping_id(*by).alias("g"))
    name = F.when(F.col("g") == 3, by[0]).when(F.col("g") == 5, by[1]).otherwise(by[2])
    return got.select(name.alias("by"), F.coalesce(*by).alias("value"), "n").orderBy("by", F.desc("n"), "value")


def by_page(changes: DataFrame) -> DataFrame:
    """Changes by page (page, else new, else old), those without one last, then by number."""
    page = F.coalesce(*[F.col(c).try_cast("int") for c in ("page", "new_page", "old_page")])
    return changes.orderBy(page.asc_nulls_last(), "change_number")
