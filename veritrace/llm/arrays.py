"""Array expressions whose work does not grow with the square of an array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block. An aggregate that appends copies what it has: a block at most, here.
BLOCK = 256


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _summed(lengths: Column, start: Column) -> Column:
    """start, start + lengths[0], ...: one element less than all sums."""
    none = F.array().cast("array<int>")
    first = F.struct(start.alias("at"), none.alias("out"))
    return F.aggregate(lengths, first, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]


def starts(lengths: Column) -> Column:
    """Where each piece begins when pieces of these lengths (int) follow each other from 0.

    In blocks of BLOCK: sums within a block from where the block begins, which is a sum of sums."""

    def of(x: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))
        total = lambda b: F.aggregate(b, F.lit(0), lambda s, v: s + v)
        return let(cut, lambda blocks: F.flatten(F.zip_with(blocks, _summed(F.transform(blocks, total), F.lit(0)), _summed)))

    return let(lengths, lambda x: F.when(F.size(x) > 0, of(x)).otherwise(F.array().cast("array<int>")))


#: Code points of a block of a text that is cut in many places.
SPAN = 256


def blocks(text: Column) -> Column:
    """A text in blocks of SPAN code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SPAN}}}"), F.lit(0))


def cut(held: Column, start: Column, length: Column) -> Column:
    """substr(text, start + 1, length) from a text's blocks: a substring of a long text would be
    counted out from its beginning each time."""
    first = F.floor(start / SPAN).cast("int")
    last = F.floor((start + length) / SPAN).cast("int")
    return F.substr(F.array_join(F.slice(held, first + 1, last - first + 1), ""), (start - first * SPAN + 1).cast("int"), length)
