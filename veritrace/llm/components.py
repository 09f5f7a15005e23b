"""Connected components of a graph whose edges stay distributed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, stash


def _least(edges: DataFrame) -> DataFrame:
    """Of each u: (u, v, m), m the least of u and all its neighbours."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(low, "u")


#: Edges up to which one task joins them (16 bytes each): the rounds of a larger graph would mostly wait.
ONE_TASK = 1 << 20


def _joined(batches):
    """All components of the edges of one task, by passing least labels along edges and up their chains."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held))
    node, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = place[: len(u)], place[len(u) :]
    label = np.arange(len(node))
    while True:
        least = np.minimum(label[u], label[v])
        now = label.copy()
        np.minimum.at(now, label[u], least)
        np.minimum.at(now, label[v], least)
        np.minimum.at(now, u, least)
        np.minimum.at(now, v, least)
        while (now[now] != now).any():
            now = now[now]
        if (now == label).all():
            break
        label = now
    for at in range(0, len(node), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(node[at : at + 100_000]), pa.array(node[label[at : at + 100_000]])], names=["node", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """edges: (u long, v long). Returns (node, component): the least node that links reach, for each node that
    has an edge. Up to one_task edges are joined by one task. Beyond, large-star and small-star steps
    alternate; each is an aggregation and a join, and a table in the shared folder cuts the lineage. A
    hot node costs no more than its edges."""
    now = stash(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct())
    if now.count() <= one_task:
        return now.coalesce(1).transform(in_arrow, _joined, "node long, component long")
    state = None
    while True:  # each round shortens all paths, so it ends; a graph of n nodes takes some log n rounds
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == tuple(seen):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        state = tuple(seen)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)
        now = stash(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
