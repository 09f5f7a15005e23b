"""Sequence similarity and paragraph normalising: the places where no built-in expression has the semantics."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import TECHNICAL_TOKEN


@F.pandas_udf(T.DoubleType())
def similarity(old: pd.Series, new: pd.Series) -> pd.Series:
    """Matching-blocks ratio of old against new to four decimals; not symmetric."""
    return pd.Series([None if a is None or b is None else round(difflib.SequenceMatcher(None, a, b).ratio(), 4) for a, b in zip(old, new)], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("old", T.StringType()), T.StructField("new", T.StringType())]))
def first_change(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """The first phrase in which the words of two texts differ."""
    rows = []
    for a, b in zip(old, new):
        x, y = (a or "").split(), (b or "").split()
        ops = (o for o in difflib.SequenceMatcher(None, x, y).get_opcodes() if o[0] != "equal")
        o = next(ops, None)
        rows.append((" ".join(x[o[1] : o[2]]), " ".join(y[o[3] : o[4]])) if o else ("", ""))
    return pd.DataFrame(rows, columns=["old", "new"])


@F.pandas_udf(T.DoubleType())
def ratio(old: pd.Series, new: pd.Series) -> pd.Series:
    """As similarity, not rounded; a null text is empty."""
    return pd.Series([difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(old, new)], dtype="float64")


#: Characters that are counted one by one; all others are counted together, which only loosens a bound.
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 ,.-_()/:"


def character_counts(text: Column) -> Column:
    """How often each counted character occurs, then how many others there are: array<int>."""
    n = F.length(text)
    each = [n - F.length(F.translate(text, c, "")) for c in COUNTED]
    return F.array(*each, F.length(F.translate(text, COUNTED, "")))


def ratio_bound(old_length: Column, new_length: Column, old_counts: Column | None = None, new_counts: Column | None = None) -> Column:
    """An upper bound of the matching-blocks ratio, to four decimals as similarity is: matched characters
    are no more than the shorter text has, nor, with character_counts, than both have of each kind."""
    total = old_length + new_length
    shared = F.least(old_length, new_length)
    if old_counts is not None:
        shared = F.aggregate(F.zip_with(old_counts, new_counts, lambda a, b: F.least(a, b)), F.lit(0), lambda s, x: s + x)
    return F.when(total > 0, F.round(F.lit(2.0) * shared / total + 1e-9, 4)).otherwise(1.0)


def _at_least(a: str, b: str, limit: float, matcher: difflib.SequenceMatcher) -> float | None:
    """similarity of a and b, or None as soon as it must be below limit: blocks are taken longest first, and what
    lies beside them can match in its shorter text at most. matcher has b already."""
    matcher.set_seq1(a)
    total = len(a) + len(b)
    if not total:
        return 1.0
    parts, matched = [(0, len(a), 0, len(b))], 0
    open_ = min(len(a), len(b))
    while parts:
        alo, ahi, blo, bhi = parts.pop()
        open_ -= min(ahi - alo, bhi - blo)
        i, j, k = matcher.find_longest_match(alo, ahi, blo, bhi)
        if k:
            matched += k
            for part in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                if part[0] < part[1] and part[2] < part[3]:
                    parts.append(part)
                    open_ += min(part[1] - part[0], part[3] - part[2])
        if round(2.0 * (matched + open_) / total, 4) < limit:
            return None
    found = round(2.0 * matched / total, 4)
    return found if found >= limit else None


def similarity_from(limit: float):
    """similarity where it is limit at least, else null. Pairs of one new text share its index: it is
    worked out once for those that stand together in a batch."""

    @F.pandas_udf(T.DoubleType())
    def score(old: pd.Series, new: pd.Series) -> pd.Series:
        out: list[float | None] = [None] * len(old)
        matcher, held = difflib.SequenceMatcher(None), None
        for k in new.dropna().sort_values(kind="stable").index:
            if old[k] is None:
                continue
            if new[k] != held:
                held = new[k]
                matcher.set_seq2(held)
            out[k] = _at_least(old[k], held, limit, matcher)
        return pd.Series(out, dtype="float64")

    return score.asNondeterministic()  # else a filter on the score works it out a second time, before rows are dealt


_TECHNICAL = re.compile(TECHNICAL_TOKEN)
_RULES = [(re.compile(a), b) for a, b in ((r"(\w)-\s*\n\s*(\w)", r"\1-\2"), (r"(?<!\n)\n(?!\n)", " "), (r"\s+", " "), (r"\s+([,.;:])", r"\1"))]


def normalized(text: str | None) -> str:
    """Text without what extraction leaves behind: soft hyphens, wrapped lines, stray spaces, in one
    Unicode form. Technical tokens (numbers in hexadecimal, dotted mnemonics, register names) keep theirs."""
    held: list[str] = []

    def keep(m: re.Match) -> str:
        held.append(m[0])
        return f"\0{len(held) - 1}\0"

    out = unicodedata.normalize("NFKC", _TECHNICAL.sub(keep, text or "")).replace("\u00ad", "")
    for pattern, by in _RULES:
        out = pattern.sub(by, out)
    return re.sub("\0(\\d+)\0", lambda m: held[int(m[1])], out.strip())


@F.pandas_udf(T.StringType())
def paragraph(text: pd.Series) -> pd.Series:
    return text.map(normalized)
