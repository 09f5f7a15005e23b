"""Many phrases looked for in one pass over a text's words.

A text is cut into its different words once, whatever the number of lists. Words of a list are found among them
by hash; a phrase, or a pattern, is tried on the text only if the words that it cannot do without are there,
the rarest of them first in effect, since most texts lack one of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words as (?U)\w has them, and as \b bounds them: letters, digits and underscores.
WORD, BOUNDED_WORD = r"(?U)(\w+)", r"([\p{L}\p{Nd}_]+)"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def bag(lower: Column, word: str = WORD) -> Column:
    """The different words of a lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(word), F.lit(1)))


def strings(values: list[str]) -> Column:
    """A constant array of words."""
    return F.split(F.lit("|".join(values)), "[|]") if values else F.array().cast("array<string>")


def words_of(phrase: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\w+", phrase.lower())))


def among(words: Column, wanted: list[str]) -> Column:
    """Those of the wanted words that a text's words have."""
    return F.array_intersect(strings(sorted(set(wanted))), words)


def all_of(there: Column, needed: list[str]) -> Column:
    """Whether all needed words are in a short array."""
    return reduce(lambda a, b: a & b, [F.array_contains(there, w) for w in needed], F.lit(True))


def found(lower: Column, words: Column, phrases: list[str], bounded: Callable[[str], str]) -> Column:
    """The phrases, in their order, that occur in a lower-cased text as whole words. Phrases of one word are the
    caller's: they are words. bounded: a phrase's pattern; a phrase without a word is always tried."""
    needs = {p: words_of(p) for p in phrases}

    def tried(there: Column) -> Column:
        one = lambda p: F.when(all_of(there, needs[p]), F.when(lower.contains(p), F.when(lower.rlike(bounded(p)), p)))
        every = F.array_compact(F.array(*[one(p) for p in phrases]))
        return every if any(not n for n in needs.values()) else F.when(F.size(there) > 0, every).otherwise(F.array().cast("array<string>"))

    return let(among(words, [w for n in needs.values() for w in n]), tried)


def said(text: Column, there: Column, pattern: str, ways: list[list[str]]) -> Column:
    """Whether a pattern matches a text. ways: of each way to match, words that it needs; without all words of
    one way among those that are there, the pattern is not tried."""
    gates = {tuple(sorted(set(w))) for w in ways}
    gates = [g for g in gates if not any(set(h) < set(g) for h in gates)]  # a gate that another implies
    return F.when(reduce(lambda a, b: a | b, [all_of(there, list(g)) for g in sorted(gates)]), text.rlike(pattern)).otherwise(False)


def ways_of(phrases: list[str]) -> list[list[str]]:
    return [words_of(p) for p in phrases]


def alternatives(patterns: list[str]) -> list[str]:
    """What words with an optional last letter (`resets?`) stand for."""
    return [x for p in patterns for x in ([p[:-2], p[:-1]] if p.endswith("?") else [p])]
