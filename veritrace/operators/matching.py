"""Greedy one-to-one matching of scored pairs, as taking pairs one by one from the best gives it.

Pairs that share no record, not even through others, do not touch each other's choice. So the graph of pairs is
cut into its connected components, and the pairs of each, in order, are taken in one pass: a pair counts
if neither of its records has one yet. A pass holds the records of one component that are taken.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.shared import settled

#: Pairs of a component that one task takes in order; the pairs of a larger one are first thinned in rounds.
ONE_PASS = 1 << 22


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """edges: pairs of longs. (node, component) of every end, component being its least node.

    Large-star and small-star steps in turn: each node is linked to the least it knows, until nothing changes.
    Each round is one table; whether it changed anything is observed as it is written."""
    now = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a <> b").distinct()
    state = None
    while True:
        seen = Observation()
        now = settled(now.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")))
        if state == seen.get:
            end = lambda c: F.struct(F.col(c).alias("node"), F.col("b").alias("component"))
            return now.select(F.explode(F.array(end("a"), end("b"))).alias("x")).select("x.*").distinct()
        state = seen.get
        both = now.union(now.select("b", "a"))
        large = _least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = _least(large)
        now = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", "m")).where("a <> b").distinct()


def _least(edges: DataFrame) -> DataFrame:
    """Of each a: (a, b, m), m the least of a and all it is linked to. Aggregated first: no node's links meet in one place."""
    return edges.join(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("m")).hint("merge"), "a")


def _taken(batches):
    """Pairs sorted by component and order: those that are taken."""
    component, old, new = None, set(), set()
    for batch in batches:
        keep = []
        for c, a, b in zip(*(batch.column(n).to_pylist() for n in ("_component", "old_pos", "new_pos"))):
            if c != component:
                component, old, new = c, set(), set()
            free = a not in old and b not in new
            if free:
                old.add(a)
                new.add(b)
            keep.append(free)
        yield batch.filter(pa.array(keep, pa.bool_()))


ORDER = [F.desc, F.asc, F.asc, F.asc]
BY = ["similarity", "old_pos", "rank", "new_pos"]


def _order() -> list:
    return [f(c) for f, c in zip(ORDER, BY)]


def _thinned(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round on a graph too large for a pass: pairs that are best for both their records are taken."""
    best = pairs.withColumn("_o", F.row_number().over(Window.partitionBy("old_pos").orderBy(*_order()))).withColumn("_n", F.row_number().over(Window.partitionBy("new_pos").orderBy(*_order())))
    now = settled(best.where("_o = 1 and _n = 1").drop("_o", "_n"))
    left = pairs.join(now.select("old_pos"), "old_pos", "left_anti").join(now.select("new_pos"), "new_pos", "left_anti")
    return now, settled(left.select(pairs.columns))


def one_to_one(pairs: DataFrame, one_pass: int = ONE_PASS) -> DataFrame:
    """pairs: (old_pos, new_pos, similarity, rank, ...), at most one of each old and new. Those that greedy
    matching takes, by similarity (descending), then old_pos, rank and new_pos. Components of more than one_pass
    pairs are thinned by rounds that take what is best for both sides, which greedy takes too, until
    they are small enough or fall apart. A pair of null places or similarity is no pair."""
    light = settled(pairs.select(F.col("old_pos").cast("long").alias("old_pos"), F.col("new_pos").cast("long").alias("new_pos"), "similarity", F.col("rank").cast("long").alias("rank")).where("old_pos is not null and new_pos is not null and similarity is not null"))
    done, left = [], light
    while True:
        # Old records are even nodes, new ones odd.
        nodes = components(left.select((F.col("old_pos") * 2).alias("u"), (F.col("new_pos") * 2 + 1).alias("v")), "u", "v")
        named = left.join(nodes.where("node % 2 = 0").select((F.col("node") / 2).cast("long").alias("old_pos"), F.col("component").alias("_component")).hint("merge"), "old_pos")
        of = named.groupBy("_component").agg(F.count("*").alias("_pairs"))
        large = settled(of.where(F.col("_pairs") > one_pass).select("_component"))
        small = named.join(large, "_component", "left_anti")
        dealt = small.repartition("_component").sortWithinPartitions("_component", *_order())
        columns = ["_component", "old_pos", "new_pos"]
        done.append(dealt.select(columns).mapInArrow(_taken, "_component long, old_pos long, new_pos long").select("old_pos", "new_pos"))
        if large.isEmpty():
            break
        took, left = _thinned(named.join(large, "_component", "left_semi").drop("_component"))
        done.append(took.select("old_pos", "new_pos"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return pairs.join(out.hint("merge"), ["old_pos", "new_pos"]).select(pairs.columns)
