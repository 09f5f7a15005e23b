"""Operators whose result depends on input order, which every frame carries as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled


def first_seen(rows: DataFrame, by: Column, order: list[str]) -> DataFrame:
    """Of rows with equal keys, the first; as an aggregation, so equal rows combine before the shuffle."""
    fields = F.struct(*order, *[c for c in rows.columns if c not in order])
    return rows.groupBy(by.alias("_key")).agg(F.min(fields).alias("_row")).select(*[F.col("_row")[c].alias(c) for c in rows.columns])


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "n") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def section_ids(rows: DataFrame, section: str, order: list[str], prefix: str = "REQ_", by: list[str] | None = None) -> DataFrame:
    """Ids numbered within each section's cleaned name (and document, given `by`): REQ_A2_1_003. A section
    without a letter or digit, or null, is UNKNOWN.

    Sections may be few and hot: rows of a hot one are range-partitioned by section and order, numbered
    within each partition's part of it, and moved on by the number of rows that earlier partitions
    have of it (one row per partition and section)."""
    name = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(section).cast("string"), F.lit("")), r"[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    keys = [*(by or []), "_name"]
    out = ranked(rows.withColumn("_name", F.when(name == "", "UNKNOWN").otherwise(name)), keys, order, "_n")
    return out.withColumn("new_id", F.concat(F.lit(prefix), "_name", F.lit("_"), F.format_string("%03d", "_n"))).drop("_name", "_n")


#: Rows of one key that a task sorts; a key with more is hot.
HOT_ROWS = 1 << 20


class Scan:
    """An associative running value: over the rows so far of a window, summed up over a part's rows, carried over
    the parts before, and joined with what is carried in."""

    def __init__(self, over, total, carried, joined):
        self.over, self.total, self.carried, self.joined = over, total, carried, joined


def summing(value: Column) -> Scan:
    return Scan(lambda w: F.sum(value).over(w), lambda order: F.sum(value), lambda t, w: F.sum(t).over(w), lambda own, before: F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0)))


def greatest_so_far(value: Column) -> Scan:
    return Scan(lambda w: F.max(value).over(w), lambda order: F.max(value), lambda t, w: F.max(t).over(w), lambda own, before: F.greatest(own, before))


def last_known(value: Column) -> Scan:
    last = lambda order: F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("_last"))))["_last"]
    return Scan(lambda w: F.last(value, ignorenulls=True).over(w), last, lambda t, w: F.last(t, ignorenulls=True).over(w), F.coalesce)


def scanned(rows: DataFrame, scan: Scan, by: list[str], order: list[str], name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with a running value over the rows of each key in their order. No task sorts more than hot_rows of a
    key: keys are counted first, combined in each task, and rows of hot keys, of which there are few, are
    scanned by ranges: within each range, plus what the ranges before carry (one row per range and key). The
    same values come out wherever the bound lies. Rows of equal order have any order among them."""
    so_far = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    plain = lambda df: df.withColumn(name, scan.joined(scan.over(so_far(*by)), F.lit(None)))
    counts = rows.groupBy(*by).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows)
    hot = settled(counts.select(*by)).toDF(*[f"_k{i}" for i in range(len(by))])
    if hot.isEmpty():
        return plain(rows)
    meets = lambda extra=F.lit(True): reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], extra)
    usual, many = rows.join(hot, meets(), "left_anti"), settled(rows.join(hot, meets(), "left_semi"))
    # Settled before, so that finding the ranges does not work the rows out again, and after, since both uses must see the same ranges.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(many.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy(*by, "_part").agg(scan.total(order).alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_before", scan.carried(F.col("_total"), earlier)).drop("_total").toDF(*[f"_k{i}" for i in range(len(by))], "_p", "_before")
    own = dealt.withColumn("_own", scan.over(so_far(*by, "_part"))).join(before, meets(F.col("_part") == F.col("_p")))
    return plain(usual).unionByName(own.withColumn(name, scan.joined(F.col("_own"), F.col("_before"))).select(*rows.columns, name))


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """As numbered, for keys that a large share of all rows may have: the running count."""
    return scanned(rows, summing(F.lit(1)), by, order, name, hot_rows).withColumn(name, F.col(name).cast("int"))


def carried(rows: DataFrame, value: Column, by: list[str], order: list[str], name: str, default: str = "Unknown", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The last non-null value so far within a document, however large it is."""
    out = scanned(rows.withColumn("_value", value), last_known(F.col("_value")), by, order, name, hot_rows)
    return out.withColumn(name, F.coalesce(name, F.lit(default))).drop("_value")


def chunks(rows: DataFrame, opens: Column, by: list[str], order: list[str], text: str) -> DataFrame:
    """Runs of rows that each begin where `opens` holds; rows before the first are dropped."""
    marked = scanned(rows.withColumn("_opens", F.when(opens, 1).otherwise(0)), summing(F.col("_opens")), by, order, "chunk").where("chunk > 0").drop("_opens")
    parts = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return marked.groupBy(*by, "chunk").agg(F.count("*").alias("n_rows"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"))


def suffixed(rows: DataFrame, id_col: str, order: list[str], blank: str = "TEST_UNKNOWN") -> DataFrame:
    """Second and later uses of an id get _DUP2, _DUP3, ..."""
    base = F.coalesce(F.nullif(F.col(id_col).cast("string"), F.lit("")), F.lit(blank))
    out = ranked(rows.withColumn("_base", base), ["_base"], order, "_n")
    return out.withColumn("unique_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("_DUP"), "_n"))).drop("_base", "_n")


def category_batches(rows: DataFrame, category: str, sub: str, order: list[str], size: int) -> DataFrame:
    """Rows of each category by subcategory in parts of `size`: part k of n. category_order numbers the
    categories as they are first met. A category may be hot: ranks come from range partitions."""
    seen = rows.groupBy(category).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("_rows"))
    seen = seen.withColumn("category_order", F.row_number().over(Window.orderBy("_first"))).select(F.col(category).alias("_c"), "_rows", "category_order")  # one row per category
    out = ranked(rows.withColumn("_sub", F.lower(sub)), [category], ["_sub", *order], "_n").drop("_sub")
    out = out.join(seen, F.col(category).eqNullSafe(F.col("_c"))).withColumn("part", (F.floor((F.col("_n") - 1) / size) + 1).cast("int"))
    return out.withColumn("parts", F.ceil(F.col("_rows") / size).cast("int")).drop("_n", "_c", "_rows")


def most_common_offset(pairs: DataFrame, old: str, new: str, least: int = 3, order: str | None = None) -> DataFrame:
    """The most frequent difference of two page numbers, if it occurs `least` times. Of equals, with
    order the one that is met first, else the smallest."""
    met = F.min(order) if order else F.first(F.col(new) - F.col(old))
    counts = pairs.groupBy((F.col(new) - F.col(old)).alias("offset")).agg(F.count("*").alias("n"), met.alias("met"))
    best = counts.agg(F.max_by(F.struct("offset", "n"), F.struct("n", (-F.col("met")).alias("m"))).alias("b"))
    return best.select("b.offset", "b.n").where(F.col("n") >= least)


def batches(rows: DataFrame, order: list[str], size: int, by: list[str] | None = None, name: str = "batch") -> DataFrame:
    """Rows in order, in batches of `size` numbered from 0, per key if given."""
    out = ranked(rows.withColumn("_all", F.lit(0)), by or ["_all"], order, "_n")
    return out.withColumn(name, F.floor((F.col("_n") - 1) / size).cast("int")).drop("_all", "_n")
