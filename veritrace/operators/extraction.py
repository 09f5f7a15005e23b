"""Requirement records and page entities from page text, by fixed rules, in native expressions.

Pages are rows (doc, page, text, ...). Sentences, lines and records carry their place, so that order
is data. A page's own arrays are bounded by the page; what runs across pages is a window or a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import phrases
from ..functions.text import acronyms, cross_references, first_present, folded, lines, present, signals, single_spaced, strip, words
from .ordering import first_seen, section_ids

_SENTENCE_END = "\u0001"


def collapsed(c: Column) -> Column:
    return strip(single_spaced(F.coalesce(c, F.lit(""))))


def relevant(text: Column, features: bool = False, literal_compat: bool = False) -> Column:
    """Whether a sentence states something to verify: no figure reference, no lead-in, and the wording of
    a requirement, a declared or conditional behaviour or (with features) a feature. literal_compat
    keeps the empty alternative of the declared behaviours: then any text with a word counts."""
    verbs = phrases.alternatives(P.CONDITION_VERBS)
    ways = {
        P.REQUIREMENT: phrases.ways_of(P.REQUIREMENT_PHRASES), P.FEATURE: phrases.ways_of(P.FEATURE_PHRASES), P.FIGURE_REFERENCE: [["figure"], ["fig"]],
        P.DECLARATIVE: [[w] for w in [*P.STATES, *phrases.alternatives(P.ACTIONS), "cause", "causes"]] + [["can", "be", "either", "or"]], P.CONDITIONAL: [[w, v] for w in ("when", "if") for v in verbs],
    }
    any_word = sorted({w for way in ways.values() for g in way for w in g})

    def of(x: Column) -> Column:
        c, there = x["c"], x["there"]
        says = lambda p: phrases.said(c, there, p, ways[p])
        found = says(P.REQUIREMENT) | says(P.DECLARATIVE) | says(P.CONDITIONAL)
        if features:
            found = found | says(P.FEATURE)
        if literal_compat:
            found = found | c.rlike(r"\w")
        return (c != "") & ~says(P.FIGURE_REFERENCE) & ~F.substring(c, 1, 64).rlike(P.LEAD_IN) & found

    there = lambda c: phrases.among(phrases.bag(F.lower(c), phrases.BOUNDED_WORD), any_word)
    return phrases.let(collapsed(text), lambda c: phrases.let(F.struct(c.alias("c"), there(c).alias("there")), of))


def blank_texts(requirements: DataFrame, order: str = "pos", shown: int = 10) -> list:
    """Places of the first records without text; a caller that must not have any raises on them."""
    return [r[0] for r in requirements.where(~present(F.col("text"))).select(order).orderBy(order).limit(shown).collect()]


def refine(requirements: DataFrame, literal_compat: bool = False, order: str = "pos") -> DataFrame:
    """The records that state something; records without text are an error that names their places."""
    if bad := blank_texts(requirements, order):
        raise ValueError(f"every requirement needs text; places without: {', '.join(map(str, bad))}")
    return requirements.where(relevant(F.col("text"), True, literal_compat))


def refinement_counts(requirements: DataFrame, literal_compat: bool = False) -> DataFrame:
    got = requirements.agg(F.count("*").alias("input_requirements"), F.count_if(relevant(F.col("text"), True, literal_compat)).alias("relevant_requirements"))
    return got.withColumn("excluded_requirements", F.col("input_requirements") - F.col("relevant_requirements"))


def plausible_heading(title: Column) -> Column:
    """No lower-case start, no closing mark, no month and year, at most 12 words."""
    t = strip(title)
    return (t != "") & ~t.rlike(r"(?U)^\p{Ll}") & ~t.rlike(r"[.,;:]$") & ~t.rlike(r"^[A-Z][a-z]{2,8}\s+\d{4}$") & (F.size(words(t)) <= 12)


def valid_section(c: Column) -> Column:
    return F.coalesce(c.cast("string").rlike(P.SECTION_ID), F.lit(False))


def cover_page(text: Column) -> Column:
    """A chapter's cover: its name, then no numbered line, and three references to its sections."""
    found = lines(text)
    refs = F.size(F.filter(found, lambda x: x.rlike(r"^•?\s*A\d+\.\d+")))
    return F.coalesce(F.get(found, F.lit(0)).rlike(r"^Chapter\s+[A-Z]\d+") & ~F.get(found, F.lit(1)).startswith("A") & (refs >= 3), F.lit(False))


def _heading(line: Column, least: int) -> Column:
    sid, title = F.regexp_extract(line, P.SECTION_LINE, 1), strip(F.regexp_extract(line, P.SECTION_LINE, 2))
    ok = line.rlike(P.SECTION_LINE) & ~line.rlike(P.CONTENTS_LINE) & ~line.rlike(r"^\d+$") & sid.rlike(P.SECTION_ID) & (F.length(title) >= least) & plausible_heading(title)
    return F.when(ok, F.struct(sid.alias("section_id"), title.alias("title")))


def heading_of_text(text: Column, scanned: int = 80) -> Column:
    """The first heading among a page's first lines (a limit of the rule: headings stand on top)."""
    top = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), 1, scanned), strip)
    found = F.filter(F.transform(F.filter(top, lambda x: (x != "") & ~F.lower(x).startswith("chapter")), lambda x: _heading(x, 3)), lambda h: h.isNotNull())
    return F.get(found, F.lit(0))


def headings_of_layout(layout: Column) -> Column:
    """layout: array<struct<spans: array<struct<text, size>>>> of text lines. Headings with their largest font."""
    text = lambda l: strip(F.array_join(F.transform(l["spans"], lambda s: s["text"]), ""))  # noqa: E731, E741
    size = lambda l: F.array_max(F.transform(l["spans"], lambda s: s["size"]))  # noqa: E731, E741
    found = F.transform(layout, lambda l: F.struct(_heading(text(l), 1).alias("h"), size(l).alias("font_size")))  # noqa: E741
    return F.transform(F.filter(found, lambda x: x["h"].isNotNull()), lambda x: F.struct(x["h"]["section_id"].alias("section_id"), x["h"]["title"].alias("title"), x["font_size"].alias("font_size")))


def without_headings(text: Column, headings: Column) -> Column:
    """Page text without lines that begin with a heading's number, and without the first occurrence of
    its title at the beginning of a line. headings: array<struct<section_id, title>>."""
    quoted = lambda c: F.regexp_replace(c, r"([^\w\s])", r"\\$1")

    def drop(t: Column, h: Column) -> Column:
        sid, title = strip(F.coalesce(h["section_id"], F.lit(""))), strip(F.coalesce(h["title"], F.lit("")))
        t = F.when(sid == "", t).otherwise(F.regexp_replace(t, F.concat(F.lit(r"(?m)^\s*"), quoted(sid), F.lit(r"\s+.*$")), F.lit("")))
        once = F.regexp_replace(t, F.concat(F.lit(r"(?s)\A((?:.*?\n)??)[^\S\n]*"), quoted(title), F.lit(r"\s*")), F.lit("$1"))
        return F.when(title == "", t).otherwise(once)

    return F.aggregate(headings, text, drop)


def section_tree(headings: DataFrame) -> DataFrame:
    """(…, section_id, title) with parent: the number before its last dot."""
    return headings.withColumn("parent", F.when(F.col("section_id").contains("."), F.regexp_replace("section_id", r"\.[^.]*$", "")))


def notes(text: Column) -> Column:
    """array<struct<type, text>> of lines that begin like a note; the kind is what stands before a colon."""
    return F.transform(F.filter(lines(text), lambda x: x.rlike(P.NOTE_LINE)), lambda x: F.struct(F.upper(F.get(F.split(x, ":"), F.lit(0))).alias("type"), x.alias("text")))


def table_captions(text: Column) -> Column:
    return F.filter(lines(text), lambda x: x.rlike(P.TABLE_LINE))


def document_acronyms(text: Column) -> Column:
    return acronyms(text, P.ACRONYM_STOPLIST)


def _sentences(text: Column) -> Column:
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: ~x.rlike(r"(?i)^\s*(Figure|Table)\s+"))
    flat = collapsed(F.array_join(kept, "\n"))
    for pattern in P.PAGE_FURNITURE:
        flat = F.regexp_replace(flat, pattern, "")
    return F.transform(F.split(flat, r"(?=•)|(?<=[.!?])\s+"), strip)


def _trimmed(s: Column) -> Column:
    for pattern in P.SENTENCE_HEADS:
        s = strip(F.regexp_replace(s, pattern, ""))
    dropped = s.rlike(P.PRESENCE_SENTENCE)
    for pattern in P.SENTENCE_HEADS_LATER:
        s = F.regexp_replace(s, pattern, "")
    s = strip(s)
    for pattern in P.SKIPPED_SENTENCES:
        dropped = dropped | s.rlike(pattern)
    return F.when(~dropped & (s != ""), s)


def requirement_sentences(pages: DataFrame, by: list[str], text: str = "text", literal_compat: bool = False) -> DataFrame:
    """One row per requirement sentence of a page: (by…, sentence_pos, text, signals, type).

    A sentence that ends with a colon and has a requirement word is the parent of the bullets after it,
    until the next one: it goes before them, from its first requirement word on, and is no row itself."""
    rows = pages.select(*by, F.posexplode(_sentences(F.col(text))).alias("sentence_pos", "s"))
    parent = F.col("s").rlike(r":$") & F.col("s").rlike(P.REQUIREMENT)
    start = F.regexp_instr(F.col("s"), F.lit(P.PARENT_START))
    lead = F.when(parent, F.when(start > 0, F.substr("s", start)).otherwise(F.col("s")))
    w = Window.partitionBy(*by).orderBy("sentence_pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("parent", F.last(lead, ignorenulls=True).over(w)).where(~parent)
    whole = F.when(F.col("s").startswith("•") & F.col("parent").isNotNull(), F.concat("parent", F.lit(" "), "s")).otherwise(F.col("s"))
    out = rows.withColumn("text", _trimmed(whole)).where(F.col("text").isNotNull() & relevant(F.col("text"), literal_compat=literal_compat))
    return out.select(*by, "sentence_pos", "text", signals(F.col("text")).alias("signals"), F.lit("protocol_rule").alias("type"))


def encoding_rules(text: Column) -> Column:
    """Rows `code name meaning` of encoding tables in text whose meaning states something."""
    part = lambda i: F.regexp_extract_all(text, F.lit(P.ENCODING_ROW), F.lit(i))
    spaced = lambda m: collapsed(F.regexp_replace(m, r"(?<=[a-z])(?=[A-Z])", " "))
    rows = F.transform(F.arrays_zip(part(1).alias("code"), part(2).alias("name"), part(3).alias("meaning")), lambda r: F.struct(r["code"].alias("code"), r["name"].alias("name"), spaced(r["meaning"]).alias("meaning")))
    said = F.filter(rows, lambda r: r["meaning"].rlike(P.REQUIREMENT) | r["meaning"].rlike(P.FEATURE))
    return F.transform(said, lambda r: F.concat_ws(" | ", r["code"], r["name"], r["meaning"]))


def header_name(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "))


def table_rules(cells: Column) -> Column:
    """cells: array<array<string>>, the header first. Rows whose description states something, as text.
    The description is the first column of a known name, else the header's last."""
    header = F.transform(F.get(cells, F.lit(0)), header_name)
    known = F.array_position(F.transform(header, lambda h: h.isin(P.DESCRIPTION_COLUMNS)), F.lit(True))
    at = F.when(known > 0, known - 1).otherwise(F.size(header) - 1).cast("int")
    body = F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda r: F.transform(r, lambda x: strip(F.regexp_replace(F.coalesce(x, F.lit("")), "\n", " "))))
    said = lambda d: d.rlike("[A-Za-z]") & (d.rlike(P.REQUIREMENT) | d.rlike(P.FEATURE) | d.rlike(P.DECLARATIVE))
    return F.transform(F.filter(body, lambda r: F.coalesce(said(F.get(r, at)), F.lit(False))), lambda r: F.array_join(F.filter(r, lambda x: x != ""), " | "))


def without_contained(rules: DataFrame, sentences: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Encoding rules of a page that neither contain one of its sentences nor are contained in one, letters
    and digits alone compared. Both sides of a page meet in arrays: a page bounds them."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"(?U)[\W_]+", ""))
    held = sentences.groupBy(*by).agg(F.collect_list(bare(F.col(text))).alias("_held"))
    own = bare(F.col(text))
    met = F.exists("_held", lambda h: h.contains(own) | own.contains(h))
    return rules.join(held, by, "left").where(~F.coalesce(met, F.lit(False))).drop("_held")


def text_key(c: Column) -> Column:
    """Equal for texts that differ in white space and case only."""
    return folded(c)


def requirement_type(text: Column) -> Column:
    """The first type one of whose keywords occurs; else Functional."""
    low, out = F.lower(text), F.lit("Functional")
    for name, found in reversed(P.TYPE_KEYWORDS.items()):
        hit = F.lit(False)
        for w in found:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def document(pages: DataFrame, by: str = "doc", order: str = "page") -> dict[str, DataFrame]:
    """The entities of documents given as page texts: requirements with ids, headings, sections, notes,
    captions, acronyms, cross references. Cover pages give no requirements; texts that repeat anywhere
    in a document count once, where they first stand; a page without a heading belongs to the last one."""
    heads = pages.withColumn("heading", heading_of_text(F.col("text")))
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = heads.withColumn("source_section", F.coalesce(F.last("heading.section_id", ignorenulls=True).over(w), F.lit("Unknown")))
    body = placed.where(~cover_page(F.col("text"))).withColumn("text", F.when(F.col("heading").isNull(), F.col("text")).otherwise(without_headings(F.col("text"), F.array("heading"))))
    said = requirement_sentences(body, [by, order, "source_section"])
    coded = body.select(by, order, "source_section", F.posexplode(encoding_rules(F.col("text"))).alias("sentence_pos", "text"))
    coded = without_contained(coded, said, [by, order]).select(by, order, "source_section", (F.col("sentence_pos") + 1_000_000).alias("sentence_pos"), "text", signals(F.col("text")).alias("signals"), F.lit("encoding_rule").alias("type"))
    every = said.select(by, order, "source_section", "sentence_pos", "text", "signals", "type").union(coded)
    once = first_seen(every, F.struct(by, text_key(F.col("text")).alias("k")), [order, "sentence_pos"])
    headings = heads.where("heading is not null").select(by, order, "heading.*")
    each = lambda c, name: pages.select(by, order, F.posexplode(c).alias("pos", name))
    return {
        "requirements": section_ids(once, "source_section", [order, "sentence_pos"], by=[by]),
        "headings": headings,
        "sections": section_tree(headings),
        "notes": each(notes(F.col("text")), "note").select(by, order, "pos", "note.*"),
        "table_captions": each(table_captions(F.col("text")), "caption"),
        "acronyms": pages.select(by, F.explode(document_acronyms(F.col("text"))).alias("acronym")).distinct(),
        "cross_references": each(cross_references(F.col("text")), "reference"),
    }


def metadata(info: DataFrame) -> DataFrame:
    """A file's information fields under the names of a document's metadata; absent ones are null."""
    names = {"title": "title", "author": "author", "subject": "subject", "keywords": "keywords", "creator": "creator", "producer": "producer", "creationDate": "creation_date", "modDate": "modification_date"}
    return info.select(*[(F.col(a) if a in info.columns else F.lit(None).cast("string")).alias(b) for a, b in names.items()])


def named_page(*fields: Column) -> Column:
    """The first of page, page_number and source_page that is there, as a whole number; else null."""
    return first_present(*fields).try_cast("int")
