"""Chapters, facets and look-ups as a reader of the results needs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_present, lenient_decimal, natural_key, strip
from .ordering import section_ids

NORMATIVE = r"(?i)\b(shall|must|required|requires|requirement|must not|shall not|not permitted|is permitted|are permitted|can only|cannot|always|never|supports|does not support)\b"
DERIVED = r"(?i)\b(?:in\s+)?(?:figure|table)\s+[a-z]\d+\.\d+\b"
EXPLAINING = r"(?i)\bfor example\b|\bhappen(?:s|ed)? to\b|\bshows?\b|\billustrates?\b|\bdepicts?\b|\bpoint to signals\b"


def in_chapter(section: Column, chapter: Column | str) -> Column:
    """The chapter itself or a section below it."""
    c = F.lit(chapter) if isinstance(chapter, str) else chapter
    return F.coalesce((section == c) | section.startswith(F.concat(c, F.lit("."))), F.lit(False))


def chapter_of(section: Column) -> Column:
    """Letters and number that a section begins with: A2 of A2.1.3."""
    return F.nullif(F.regexp_extract(section, r"^([A-Za-z]*\d+)", 1), F.lit(""))


def chapters(rows: DataFrame, section: str) -> DataFrame:
    """Distinct chapters with their place in natural order (few rows: one per chapter)."""
    found = rows.select(chapter_of(F.col(section)).alias("chapter")).where("chapter is not null").distinct()
    return found.withColumn("place", F.row_number().over(Window.orderBy(natural_key(F.col("chapter")))))


def by_section(rows: DataFrame, section: str, id_col: str, search: str = "") -> DataFrame:
    """(section, n, ids) of rows whose JSON holds the search text, in any case."""
    hit = searched(rows, search)
    return hit.groupBy(F.coalesce(F.nullif(strip(F.col(section)), F.lit("")), F.lit("Other")).alias("section")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(id_col)).alias("ids"))


def searched(rows: DataFrame, query: str) -> DataFrame:
    """Rows whose whole record, as JSON, contains the query in any case."""
    q = query.strip().lower()
    return rows.where(F.contains(F.lower(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})), F.lit(q))) if q else rows


def faceted(plan: DataFrame, query: str = "", **facets: str | int) -> DataFrame:
    """Rows that match the search and every facet that is not "all", by priority and test id."""
    out = searched(plan, query)
    for name, value in facets.items():
        if value != "all":
            out = out.where(F.col(name).cast("string") == str(value))
    return out.orderBy("priority", "test_id")


def shown_id(*fields: Column) -> Column:
    """The first field that is not null, if it is a string; else empty. Pass string columns or null."""
    return F.coalesce(*fields, F.lit(""))


def section_of_id(requirement_id: Column) -> Column:
    """A2.1 of REQ_A2_01_003; Other without one."""
    up = F.upper(requirement_id)
    part = lambda i: F.regexp_extract(up, r"^REQ_([A-Z]+\d+)_(\d+)", i)
    return F.when(part(1) != "", F.concat(part(1), F.lit("."), part(2).cast("bigint").cast("string"))).otherwise("Other")


def shown_section(requirement_id: Column, *fields: Column) -> Column:
    return F.coalesce(*[F.nullif(strip(f), F.lit("")) for f in fields], section_of_id(requirement_id))


def requirement_texts(requirements: DataFrame, plan: DataFrame) -> DataFrame:
    """(requirement_id, text): of requirements the last, else the first plan row's."""
    own = requirements.where("requirement_id <> '' and text <> ''").groupBy("requirement_id").agg(F.max_by("text", "pos").alias("a"))
    other = plan.where("requirement_id <> '' and requirement_text <> ''").groupBy("requirement_id").agg(F.min_by("requirement_text", "pos").alias("b"))
    return own.join(other, "requirement_id", "full").select("requirement_id", F.coalesce("a", "b").alias("text"))


def normal_text(c: Column) -> Column:
    """For telling requirements apart: lower case, without references to figures and tables and without marks."""
    out = F.regexp_replace(F.lower(c), r"\b(?:figure|table)\s+[a-z]\d+\.\d+\b", "")
    return strip(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9\s]", " "), r"\s+", " "))


def explains(text: Column, kind: Column) -> Column:
    """An explanation of a figure or table, without normative wording."""
    derived = text.rlike(DERIVED) | F.coalesce(F.lower(kind).rlike("figure|ocr|caption"), F.lit(False))
    return derived & text.rlike(EXPLAINING) & ~text.rlike(NORMATIVE)


def merged_requirements(rows: DataFrame, order: str = "pos") -> DataFrame:
    """rows (pos, id, text, source_section, source_kind): explanations of figures and tables go; of rows
    that agree in section and normal text the first stays, with the others' evidence (those derived from
    a figure or table), and ids are numbered anew per section; original_id keeps the old one."""
    text, kind = F.coalesce("text", F.lit("")), F.coalesce("source_kind", F.lit(""))
    kept = rows.where(~explains(text, kind))
    derived = text.rlike(DERIVED) | F.lower(kind).rlike("figure|ocr|caption")
    evidence = F.when(derived, F.struct(F.col("id").alias("original_id"), F.col("source_section").alias("section"), F.col("text").alias("said")))
    row = F.struct(order, F.col("id").alias("original_id"), "text", "source_section")
    per = kept.withColumn("_k", normal_text(text)).groupBy(F.coalesce("source_section", F.lit("")).alias("_s"), "_k").agg(F.min(row).alias("first"), F.array_sort(F.collect_set(F.struct(F.col(order).alias("at"), evidence.alias("e")))).alias("all"), F.count("*").alias("n"))
    later = F.transform(F.filter("all", lambda x: x["e"].isNotNull() & (x["at"] != F.col("first")[order])), lambda x: x["e"])
    out = per.select("first.*", later.alias("evidence"), "n")
    return section_ids(out.withColumn("_sec", F.coalesce("source_section", F.lit("REQ"))), "_sec", [order]).drop("_sec")


def chapter_subset(entities: dict[str, DataFrame], chapter: str) -> dict[str, DataFrame]:
    """A chapter's part of a document: sections, headings (section_id, page), requirements, notes and the like.

    Sections are those of the chapter; pages those that name it or have a heading of one of its sections;
    entities with a section go by it, others by their page; acronyms stay if a page's text has them."""
    out = {}
    sections = entities["sections"].where((F.col("parent") == chapter) | in_chapter(F.col("id"), chapter))
    ids = sections.select(F.col("id").alias("section_id")).distinct()
    marker = F.col("text").rlike(rf"\bChapter\s+{chapter}\b")
    headed = entities["headings"].join(ids, "section_id", "left_semi").select("page").distinct().withColumn("_h", F.lit(True))
    pages = entities["pages"].join(headed, "page", "left").where(marker | F.col("_h")).drop("_h")
    numbers = pages.select("page").distinct()
    for name, df in entities.items():
        if name == "sections":
            out[name] = sections
        elif name == "pages":
            out[name] = pages
        elif name == "acronyms":
            token = pages.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(\w+)\b"), F.lit(1)))).alias("acronym")).distinct()
            out[name] = df.join(token, "acronym", "left_semi")
        elif found := [c for c in ("source_section", "section", "section_id") if c in df.columns]:
            out[name] = df.where(in_chapter(first_present(*map(F.col, found)), chapter))
        else:
            out[name] = df.join(numbers, "page", "left_semi")
    return out


def chapter_options(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """(chapter, title, n): a chapter's title stands after its name on the first page that has it."""
    per = sections.where("id <> ''").groupBy(F.coalesce(F.nullif(F.col("parent"), F.lit("")), F.get(F.split("id", r"\."), F.lit(0))).alias("chapter")).agg(F.count("*").alias("n"))
    name = lambda i: F.regexp_extract("text", r"\bChapter\s+([A-Za-z]*\d+)\b(?:\s*\n|\.\s*)?([^\n]*)", i)
    named = pages.select(name(1).alias("chapter"), F.struct("page", strip(F.regexp_replace(name(2), r"\s+", " ")).alias("title")).alias("t")).where("chapter <> ''").groupBy("chapter").agg(F.min("t").alias("t"))
    return per.join(named, "chapter", "left").select("chapter", F.coalesce(F.nullif("t.title", F.lit("")), "chapter").alias("title"), "n")


def category_options(plan: DataFrame) -> DataFrame:
    """(parent, label, value) of what priorities can select; rows without a hierarchy under a legacy parent."""
    has = (F.col("requirement_category") != "") & (F.col("requirement_category") != "Uncategorised") & (F.col("requirement_subcategory") != "")
    has = F.coalesce(has, F.lit(False))
    parent, label = F.when(has, F.col("requirement_category")).otherwise("Legacy test categories"), F.when(has, F.col("requirement_subcategory")).otherwise(F.col("category"))
    return plan.select(parent.alias("parent"), label.alias("label"), F.when(has, F.concat(parent, F.lit("::"), label)).otherwise(label).alias("value")).distinct()


def grouped_issues(issues: DataFrame) -> DataFrame:
    """(section, requirements): issues by requirement, requirements by section."""
    per = issues.groupBy("source_section", "requirement_id").agg(F.array_sort(F.collect_list(F.struct("issue_type", F.array_join("matched_words", ", ").alias("words")))).alias("issues"))
    return per.groupBy(F.coalesce("source_section", F.lit("Other")).alias("section")).agg(F.array_sort(F.collect_list(F.struct("requirement_id", "issues"))).alias("requirements"))


def label(c: Column) -> Column:
    """snake_case as words with capitals."""
    return F.initcap(F.translate(c, "_", " "))


def shown_number(c: Column) -> Column:
    return F.coalesce(F.format_number(c, 0), F.lit("—"))


def shown_cost(c: Column) -> Column:
    """$ and four decimals; what is no number stays, nothing is a dash."""
    value = c.cast("string")
    return F.when(value.isNull() | (value == ""), "—").when(value.try_cast("double").isNull(), value).otherwise(F.concat(F.lit("$"), F.format_string("%.4f", lenient_decimal(c).cast("double"))))


def highlighted(text: Column, found: list[str], before: str = "**", after: str = "**") -> Column:
    """text with each occurrence of a term marked; longer terms win over those inside them."""
    ordered = sorted({t for t in found if t}, key=lambda t: (-len(t), t))
    if not ordered:
        return text
    quoted = "|".join("".join("\\" + c if not (c.isalnum() or c.isspace()) else c for c in t) for t in ordered)
    return F.regexp_replace(text, f"(?iU)(?<!\\w)({quoted})(?!\\w)", f"{before}$1{after}")
