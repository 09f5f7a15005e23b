"""Quality of an extracted document against its source pages: component scores, three means, a verdict.

A document is a dict of frames; each score is a small aggregate, and all come out as rows (component,
value), value a percentage. Frames: keys (key), pages (pos, page_number, text), requirements (text,
category, section), page_requirements (text, category), figures (caption), page_figures (page, caption),
tables (page, csv_file, caption), table_captions (page, caption), cross_references (reference), chunks
(pages, page, page_start, page_end), images (page). The source: page_texts (page, text), tables (page, n),
images (page, n).
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.phrases import let
from ..functions.similarity import ratio
from ..functions.text import lines, single_spaced, strip
from .containment import contained
from .ordering import greatest_so_far, scanned, summing


def normal(c: Column) -> Column:
    """A bullet glyph is a space; white space collapsed, lower case; null is empty."""
    return F.lower(strip(single_spaced(F.translate(F.coalesce(c.cast("string"), F.lit("")), "", " "))))


def clamped(part: Column, whole: Column, empty: float = 100.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) * part / whole)))


def mean(rows: DataFrame, value: str = "value") -> DataFrame:
    """One row: the mean, 100 over no rows."""
    return rows.agg(F.coalesce(F.avg(value), F.lit(100.0)).alias("value"))


def _number(rows: DataFrame) -> Column:
    """The number of rows, as a scalar subquery."""
    return rows.agg(F.count("*")).scalar()


def counted(rows: DataFrame, key: Column) -> DataFrame:
    """A multiset as (key, n); null keys are no members."""
    return rows.select(key.alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("n"))


def f1(expected: DataFrame, captured: DataFrame, neutral: bool = False) -> DataFrame:
    """F1 of two multisets (key, n) in percent: 100 if both are empty (or, with neutral, if nothing is
    expected), 0 if one is."""
    both = expected.select("key", F.col("n").alias("e"), F.lit(0).alias("c")).union(captured.select("key", F.lit(0), "n")).groupBy("key").agg(F.sum("e").alias("e"), F.sum("c").alias("c"))
    t = both.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in ((F.least("e", "c"), "hit"), (F.col("e"), "e"), (F.col("c"), "c"))])
    free = (F.col("e") == 0) if neutral else (F.col("e") + F.col("c") == 0)
    return t.select(F.when(free, 100.0).otherwise(F.lit(200.0) * F.col("hit") / (F.col("e") + F.col("c"))).alias("value"))


def same(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ok): whether two multisets (key, n) are equal."""
    odd = a.select("key", "n").union(b.select("key", -F.col("n"))).groupBy("key").agg(F.sum("n").alias("n")).where("n <> 0")
    return odd.agg((F.count("*") == 0).alias("ok"))


def captions(pages: DataFrame, pattern: str) -> DataFrame:
    """Lines of page texts that begin like a caption, as page:line with their counts."""
    rows = pages.select("page", F.explode(lines(F.col("text"))).alias("line")).where(F.col("line").rlike(pattern))
    return counted(rows, F.concat(F.col("page").cast("string"), F.lit(":"), normal(F.col("line"))))


def page_captions(items: DataFrame) -> DataFrame:
    return counted(items.where("caption <> ''"), F.concat(F.col("page").cast("string"), F.lit(":"), normal(F.col("caption"))))


def per_page(rows: DataFrame) -> DataFrame:
    return counted(rows, F.col("page").cast("string"))


def requirement_keys(rows: DataFrame) -> DataFrame:
    """category|text of requirements with text."""
    return counted(rows.where(normal(F.col("text")) != ""), F.concat(normal(F.col("category")), F.lit("|"), normal(F.col("text"))))


def _suffixes() -> tuple[list[str], list[str]]:
    """The two lists of endings in the pattern of bus signals."""
    a, b = re.findall(r"\(\?:([A-Z|]+)\)", P.BUS_SIGNAL)
    return a.lower().split("|"), b.lower().split("|")


#: Words without which neither pattern of a whole word can match: they only decide whether it is tried.
BUS_WORDS = [a + b + x for a in "ar" for b in "rw" for x in _suffixes()[0]] + [a + x for a in "rwb" for x in _suffixes()[1]]
REGISTER_WORDS = re.findall(r"[a-z]{3,}", P.CONTROL_REGISTER) + ["rv32", "rv64", "rv128"]
_BUS, _REGISTER = "\1", "\2"

_KEYWORDS = sorted({w for found in P.CATEGORY_KEYWORDS.values() for w in found})


@F.pandas_udf(T.ArrayType(T.StringType()))
def keywords_in(low: pd.Series) -> pd.Series:
    """The category keywords that a lower-cased text contains anywhere, and marks of what patterns are worth trying.
    Python looks for a substring some twenty times as fast as the built-in does, and there are a hundred."""
    marks = ((_BUS, BUS_WORDS), (_REGISTER, REGISTER_WORDS))
    return low.map(lambda t: [] if t is None else [w for w in _KEYWORDS if w in t] + [m for m, words in marks if any(w in t for w in words)])


def _hits(there: Column, found: list[str]) -> Column:
    return F.size(F.array_intersect(there, F.split(F.lit("|".join(sorted(set(found)))), "[|]")))


def category(text: Column) -> Column:
    """The first category, in their order, one of whose keywords occurs; else Functional."""

    def of(there: Column) -> Column:
        out = F.lit("Functional")
        for name, found in reversed(P.CATEGORY_KEYWORDS.items()):
            out = F.when(_hits(there, found) > 0, name).otherwise(out)
        return F.when(F.size(there) > 0, out).otherwise("Functional")

    return let(keywords_in(F.lower(text)), of)


def scored_category(text: Column) -> Column:
    """The category with most keywords; bus signals and control registers count two for theirs; of
    equals the one that comes first in the priority order."""

    def of(x: Column) -> Column:
        there = x["there"]
        score = {name: _hits(there, found) for name, found in P.CATEGORY_KEYWORDS.items()}
        for name, mark, pattern in (("Protocol", _BUS, P.BUS_SIGNAL), ("Architecture", _REGISTER, P.CONTROL_REGISTER)):
            score[name] = score[name] + F.when(F.array_contains(there, mark), F.when(x["text"].rlike(pattern), 2).otherwise(0)).otherwise(0)
        best = F.array_max(F.array(*[F.struct(score[name].alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, name in enumerate(P.CATEGORY_PRIORITY)]))
        return F.when(F.size(there) > 0, let(best, lambda b: F.when(b["n"] > 0, b["name"]).otherwise("Functional"))).otherwise("Functional")

    return let(F.struct(text.alias("text"), keywords_in(F.lower(text)).alias("there")), of)


def tokens(rows: DataFrame, pattern: str) -> DataFrame:
    found = rows.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(1))).alias("t"))
    return counted(found, F.upper("t"))


def requirement_recall(page_texts: DataFrame, requirements: DataFrame) -> DataFrame:
    """Requirements found, of the source's lines with requirement wording; at most 100."""
    said = page_texts.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r")).alias("line")).agg(F.count_if(F.col("line").rlike(P.QUALITY_REQUIREMENT)).alias("of"))
    return said.select(clamped(_number(requirements), F.col("of")).alias("value"))


def reference_recall(page_texts: DataFrame, references: DataFrame, literal_compat: bool = False) -> DataFrame:
    """References of the source that were captured. The source's are bare numbers; literal_compat compares
    them with captured ones as they are written (section 2.3), so that none is met."""
    found = lambda p: F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(p), F.lit(1))
    expected = page_texts.select(F.explode(F.concat(found(P.QUALITY_SECTION_REFERENCE), found(P.QUALITY_TABLE_REFERENCE))).alias("r")).select(normal(F.col("r")).alias("r")).distinct()
    captured = references.select(normal(F.col("reference")).alias("r"))
    captured = captured if literal_compat else captured.select(F.regexp_replace("r", "^(section|table)\\s+", "").alias("r"))
    hit = expected.join(captured.distinct().withColumn("hit", F.lit(1)), "r", "left")
    return hit.agg(clamped(F.count("hit"), F.count("*")).alias("value"))


def page_ranges(chunks: DataFrame) -> DataFrame:
    """Pages from 1 that chunks name, as ranges that neither meet nor touch: (first, last). A chunk names a list,
    one page (also as digits), or a range, however long."""
    number = lambda c: F.when(strip(c.cast("string")).rlike(r"^-*\d+$"), strip(c.cast("string")).try_cast("int"))
    one = lambda p: F.struct(p.cast("long").alias("first"), p.cast("long").alias("last"))
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    span = F.struct(F.col("page_start").cast("long").alias("first"), F.col("page_end").cast("long").alias("last"))
    every = F.concat(F.coalesce(F.transform("pages", lambda p: one(number(p))), none), F.array(one(number(F.col("page")))), F.array(span))
    return merged_ranges(chunks.select(F.explode(every).alias("r")).select(F.greatest("r.first", F.lit(1)).alias("first"), F.col("r.last").alias("last")))


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """ranges: (first, last), whole numbers. Their union as ranges apart from each other: a range that begins
    beyond all earlier ends opens an island. Empty and unknown ranges are nothing."""
    rows = ranges.where("first <= last").select("first", "last").distinct().withColumn("_all", F.lit(0))
    # What came before: the running greatest end of the ranges that begin earlier, each begin once.
    begins = rows.groupBy("_all", "first").agg(F.max("last").alias("last"))
    shifted = begins.select("_all", F.col("first").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("end"), "first", "last")
    ends = begins.select("_all", F.col("first").alias("at"), F.lit(2).alias("asks"), F.col("last").alias("end"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    reach = scanned(shifted.union(ends), greatest_so_far(F.col("end")), ["_all"], ["at", "asks"], "_reach").where("asks = 1")
    opens = F.when(F.col("_reach").isNull() | (F.col("first") > F.col("_reach") + 1), 1).otherwise(0)
    island = scanned(reach.select("_all", "first", "last", opens.alias("_opens")), summing(F.col("_opens")), ["_all"], ["first"], "_island")
    return island.groupBy("_island").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last")


def covered_pages(chunks: DataFrame) -> DataFrame:
    """The pages of page_ranges one by one: for ranges that a document can have."""
    return page_ranges(chunks).select(F.explode(F.sequence("first", "last")).alias("page")).select(F.col("page").cast("int").alias("page"))


def covered_count(chunks: DataFrame) -> DataFrame:
    """One row: how many pages chunks name."""
    return page_ranges(chunks).agg(F.coalesce(F.sum(F.col("last") - F.col("first") + 1), F.lit(0)).alias("n"))


def inherited(chunks: DataFrame) -> DataFrame:
    """Chunks nested in a page (page_number) that say nothing of pages get that one."""
    bare = F.col("pages").isNull() & F.col("page").isNull() & F.col("page_start").isNull()
    return chunks.withColumn("page", F.when(bare, F.col("page_number").cast("string")).otherwise(F.col("page")))


def record_completeness(document: dict[str, DataFrame]) -> DataFrame:
    """Mean over requirements, figures and tables (those with a record) of the share of filled fields."""
    parts = []
    for name, fields in (("requirements", ["text", "category"]), ("figures", ["caption"]), ("tables", ["page", "csv_file"])):
        filled = reduce(lambda a, b: a + b, [F.when(F.col(f).cast("string") != "", 1).otherwise(0) for f in fields])
        parts.append(document[name].agg(F.count("*").alias("n"), F.sum(filled).alias("k")).where("n > 0").select(clamped(F.col("k"), F.col("n") * len(fields)).alias("value")))
    return mean(reduce(DataFrame.union, parts))


def _named(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [df.select(F.lit(name).alias("component"), F.col("value").cast("double").alias("value")) for name, df in parts.items()])


def completeness(document: dict[str, DataFrame], page_texts: DataFrame, total_pages: int = 0, literal_compat: bool = False) -> DataFrame:
    keys = document["keys"].where(F.col("key").isin(P.REQUIRED_KEYS)).agg(F.countDistinct("key").alias("n")).select(clamped(F.col("n"), F.lit(len(P.REQUIRED_KEYS))).alias("value"))
    chars = lambda df: df.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)))
    sizes = page_texts.agg(F.count("*").alias("src_rows"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("src_chars"))
    sizes = sizes.withColumns({"out_rows": _number(document["pages"]), "out_chars": chars(document["pages"]).scalar(), "chunked": covered_count(document["chunks"]).scalar()})
    expected = F.when(F.col("src_rows") > 0, F.col("src_rows")).otherwise(F.lit(total_pages))
    return _named({
        "required_json_field": keys, "page_coverage": sizes.select(clamped(F.col("out_rows"), expected).alias("value")), "text_coverage": sizes.select(clamped(F.least("out_chars", "src_chars"), F.col("src_chars")).alias("value")),
        "semantic_chunk_coverage": sizes.select(clamped(F.col("chunked"), expected).alias("value")), "record_field_completeness": record_completeness(document),
        "cross_reference_recall": reference_recall(page_texts, document["cross_references"], literal_compat), "requirement_recall": requirement_recall(page_texts, document["requirements"]),
    })


def page_fidelity(page_texts: DataFrame, pages: DataFrame) -> DataFrame:
    """Mean similarity of each source page with the output page at its place (none: an empty one)."""
    both = page_texts.select("page", F.col("text").alias("a")).join(pages.select(F.col("pos").alias("page"), F.col("text").alias("b")), "page", "left")
    return mean(both.select((F.lit(100.0) * ratio(normal(F.col("a")), normal(F.col("b")))).alias("value")))


def traceable(page_texts: DataFrame, requirements: DataFrame) -> DataFrame:
    """Share of requirements whose normal text stands in the source's, pages joined by a space."""
    flat = page_texts.select("page", normal(F.col("text")).alias("t"))
    need = requirements.select(normal(F.col("text")).alias("n")).where("n <> ''")
    found = contained(flat, need)
    k = need.join(found.withColumn("hit", F.lit(1)), "n", "left").agg(F.count("hit").alias("k"))
    return k.select(clamped(F.col("k"), _number(requirements)).alias("value"))


def category_consistency(requirements: DataFrame, expected: Column) -> DataFrame:
    valid = [*P.CATEGORY_KEYWORDS, "Functional"]
    named = requirements.where("text <> '' and category <> ''")
    return named.agg(clamped(F.count_if((F.col("category") == expected) & F.col("category").isin(valid)), F.count("*")).alias("value"))


def references_resolve(document: dict[str, DataFrame]) -> DataFrame:
    """(ok): every section reference names a requirement's section, every table reference a caption's number."""
    ref = document["cross_references"].select(F.lower(F.regexp_extract(strip(F.col("reference")), P.CROSS_REFERENCE, 1)).alias("kind"), normal(F.regexp_extract(strip(F.col("reference")), P.CROSS_REFERENCE, 2)).alias("id")).where(F.col("kind").isin("section", "table"))
    sections = document["requirements"].where("section <> ''").select(F.lit("section").alias("kind"), normal(F.col("section")).alias("id"))
    number = F.regexp_extract(strip(F.col("caption")), P.QUALITY_TABLE_CAPTION, 1)
    tables = document["table_captions"].where(number != "").select(F.lit("table"), normal(number))
    return ref.join(sections.union(tables).distinct(), ["kind", "id"], "left_anti").agg((F.count("*") == 0).alias("ok"))


def internal_checks(document: dict[str, DataFrame]) -> DataFrame:
    """(check, ok) of the five consistency checks."""
    every = lambda rows, ok: rows.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("ok"))
    caption = lambda df: counted(df.where("caption <> ''"), normal(F.col("caption")))
    numbers = document["pages"].select(F.col("page_number").cast("string").alias("page")).distinct()
    lost = document["tables"].select(F.col("page").cast("string").alias("page")).join(numbers, "page", "left_anti")
    checks = {
        "requirements_match_page_aggregation": same(requirement_keys(document["requirements"]), requirement_keys(document["page_requirements"])),
        "section_format_valid": every(document["requirements"].where("section <> ''"), F.col("section").rlike(P.QUALITY_SECTION_ID)),
        "cross_references_resolve": references_resolve(document),
        "figures_match_page_aggregation": same(caption(document["figures"]), caption(document["page_figures"])),
        "tables_have_valid_pages": lost.agg((F.count("*") == 0).alias("ok")),
    }
    return reduce(DataFrame.union, [df.select(F.lit(n).alias("check"), "ok") for n, df in checks.items()])


def accuracy(document: dict[str, DataFrame], page_texts: DataFrame, gold: dict[str, DataFrame] | None = None) -> DataFrame:
    """Eight components; with a gold document, five."""
    requirements = document["requirements"]
    inner = internal_checks(document).agg((F.lit(100.0) * F.count_if("ok") / F.count("*")).alias("value"))
    fidelity = page_fidelity(page_texts, document["pages"])
    if gold is not None:
        caption = lambda df: counted(df.where("caption <> ''"), normal(F.col("caption")))
        return _named({"requirement_f1": f1(requirement_keys(gold["requirements"]), requirement_keys(requirements)), "figure_caption_f1": f1(caption(gold["figures"]), caption(document["figures"])), "table_caption_f1": f1(caption(gold["tables"]), caption(document["tables"])), "page_text_fidelity": fidelity, "json_internal_consistency": inner})
    pages = page_texts.select(F.col("page").cast("string").alias("page")).join(document["pages"].select(F.col("page_number").cast("string").alias("page"), F.lit(1).alias("hit")).distinct(), "page", "left")
    signal = lambda p: f1(tokens(page_texts, p), tokens(requirements, p), neutral=True)
    return _named({
        "page_text_fidelity": fidelity, "requirement_traceability": traceable(page_texts, requirements), "category_consistency": category_consistency(requirements, category(F.col("text"))),
        "page_number_accuracy": pages.agg(clamped(F.count("hit"), F.count("*")).alias("value")), "json_internal_consistency": inner,
        "category_consistency_priority": category_consistency(requirements, scored_category(F.col("text"))), "axi_signal_fidelity": signal(P.BUS_SIGNAL), "riscv_csr_fidelity": signal(P.CONTROL_REGISTER),
    })


def capture(document: dict[str, DataFrame], source: dict[str, DataFrame], existing: DataFrame) -> DataFrame:
    """Tables and figures caught. existing: (csv_file) of files that are there (see sources.paths)."""
    expected = source["tables"].select(F.col("page").cast("string").alias("key"), "n")
    tables = document["tables"]
    there = tables.where("csv_file <> ''").join(existing.distinct(), "csv_file", "left_semi").agg(F.count("*").alias("k"))
    files = there.withColumns({"n": _number(tables), "of": expected.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()})
    share = F.when(F.col("n") == 0, F.when(F.col("of") == 0, 100.0).otherwise(0.0)).otherwise(clamped(F.col("k"), F.col("n")))
    return _named({
        "table_detection_f1": f1(expected, per_page(tables)), "table_caption_f1": f1(captions(source["page_texts"], P.QUALITY_TABLE_CAPTION), page_captions(document["table_captions"])), "table_file_existence": files.select(share.alias("value")),
        "figure_caption_f1": f1(captions(source["page_texts"], P.QUALITY_FIGURE_CAPTION), page_captions(document["page_figures"])), "image_capture_f1": f1(source["images"].select(F.col("page").cast("string").alias("key"), "n"), per_page(document["images"])),
    })


def overall(scores: dict[str, DataFrame], threshold: float = 95.0) -> DataFrame:
    """(score, percentage, status) of each score and of all: means of unrounded components; pass from the threshold on."""
    if not 0 <= threshold <= 100:
        raise ValueError("the threshold must be between 0 and 100")
    each = reduce(DataFrame.union, [df.agg(F.coalesce(F.avg("value"), F.lit(100.0)).alias("v")).select(F.lit(name).alias("score"), "v") for name, df in scores.items()])
    rows = each.union(each.agg(F.avg("v").alias("v")).select(F.lit("overall"), "v"))
    return rows.select("score", F.round("v", 2).alias("percentage"), F.when(F.col("v") >= threshold, "pass").otherwise("fail").alias("status"))
