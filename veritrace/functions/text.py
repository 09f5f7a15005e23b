"""Text and number expressions with the semantics that the analytics need."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phrases


#: White space, as (?U)\s has it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Removes all white space at both ends, not only U+0020; what lies between is not looked at."""
    return F.btrim(c, F.lit(SPACES))


def single_spaced(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def present(c: Column) -> Column:
    """Not null and not blank."""
    return F.coalesce(strip(c.cast("string")) != "", F.lit(False))


def first_present(*columns: Column) -> Column:
    """The first that is neither null nor empty, as a string."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def clean(c: Column) -> Column:
    """No space around hyphens, runs of white space as one space, stripped; null is empty."""
    tight = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s*-\s*", "-")
    return strip(single_spaced(tight))


def comparison_text(c: Column) -> Column:
    return F.lower(clean(c))


def stable_hash(c: Column) -> Column:
    """Twelve hex digits that stay the same across runs and case."""
    return F.substring(F.sha1(comparison_text(c)), 1, 12)


def percent(k: Column, n: Column) -> Column:
    """100 k / n to two decimals, half up on the exact ratio; 0 when n is 0.

    Integer arithmetic, so that no engine's float rounding shows; ties differ from rounding to even.
    """
    k, n = k.cast("bigint"), n.cast("bigint")
    return F.when(n == 0, F.lit(0.0)).otherwise(F.floor((k * 20000 + n) / (n * 2)).cast("double") / 100.0)


def percent_sql(k: str, n: str) -> str:
    return f"CASE WHEN ({n}) = 0 THEN 0.0::double ELSE (((({k})::bigint * 20000 + ({n})) // (({n}) * 2))::double / 100.0) END"


def matched_terms(c: Column, terms: list[str]) -> Column:
    """The terms that occur in lower-cased text as whole words, longest first, then by name."""
    return terms_of(c, [terms], lambda found: found[0])


def terms_of(c: Column, lists: list[list[str]], f) -> Column:
    """f of the matched terms of each list, all lists found in one pass over the text's words."""
    known = [{t.lower() for t in terms} for terms in lists]
    single, other = sorted({t for k in known for t in k if re.fullmatch(r"\w+", t)}), sorted({t for k in known for t in k if not re.fullmatch(r"\w+", t)})
    bounded = lambda t: r"(?U)(?<!\w)(?:" + re.sub(r"([^\w\s])", r"\\\1", t) + r")(?!\w)"
    by_length = lambda x: F.transform(F.array_sort(F.transform(x, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda y: y["t"])

    def of(x: Column) -> Column:
        parts = [phrases.among(x["words"], single)] if single else []
        parts += [phrases.found(x["low"], x["words"], other, bounded)] if other else []
        every = by_length(F.concat(*parts)) if parts else F.array().cast("array<string>")
        if len(lists) == 1:
            return f([every])
        return phrases.let(every, lambda e: f([F.array_intersect(e, phrases.strings(sorted(k))) for k in known]))

    low = F.lower(F.coalesce(c, F.lit("")))
    return phrases.let(low, lambda x: phrases.let(F.struct(x.alias("low"), phrases.bag(x).alias("words")), of))


def significant_tokens(c: Column, common: list[str]) -> Column:
    """Distinct tokens of three characters or more, in order, without the common ones."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9_]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(common)))


def natural_key(c: Column) -> Column:
    """A key under which A2 comes before A10: letters, then the dotted numbers as numbers."""
    parts = F.regexp_extract_all(c, F.lit(r"([0-9]+)"), F.lit(1))
    return F.struct(F.regexp_extract(c, r"^([^0-9]*)", 1).alias("letters"), F.transform(parts, lambda p: p.cast("bigint")).alias("numbers"), c.alias("text"))


def signals(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\b([A-Z][A-Z0-9_]{2,})\b"), F.lit(1))))


def acronyms(c: Column, stop: list[str]) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\b([A-Z]{2,10})\b"), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")))


def cross_references(c: Column) -> Column:
    """Section references, then table references, duplicates kept."""
    of = lambda word: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?i)\b({word}\s+[A-Z]?\d+(?:[.-]\d+)*)"), F.lit(1))
    return F.concat(of("section"), of("table"))


def lenient_decimal(c: Column) -> Column:
    """$1,234.50 and the like; junk, blank and null are 0."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"[$,\s]", "").try_cast("decimal(38,18)"), F.lit(0).cast("decimal(38,18)"))


def folded(c: Column) -> Column:
    """White space collapsed, case folded (sharp s as ss)."""
    return F.replace(F.lower(strip(single_spaced(F.coalesce(c, F.lit(""))))), F.lit("ß"), F.lit("ss"))


def has_content(c: Column, kind: str = "string") -> Column:
    """Content at any depth of a string, an array of strings or a number. kind: string, array or scalar."""
    if kind == "array":
        return F.coalesce(F.exists(c, present), F.lit(False))
    return present(c) if kind == "string" else c.isNotNull()


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first, also after an apostrophe or a digit."""
    parts = F.regexp_extract_all(c, F.lit(r"(?U)(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def lines(c: Column) -> Column:
    """Stripped, non-empty lines."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), strip), lambda x: x != "")


def lenient_tokens(c: Column, grouped: bool = True) -> Column:
    """Whole tokens; with grouped, 1,234.5 is 1234, else only plain whole numbers count; the rest is 0."""
    text = c.cast("string")
    number = F.regexp_replace(text, r"[,\s]", "").try_cast("decimal(38,6)").cast("bigint") if grouped else F.when(strip(text).rlike(r"^[+-]?\d+$"), strip(text).try_cast("bigint"))
    return F.coalesce(number, F.lit(0).cast("bigint"))
