"""The token join and one-to-one matching against brute force, with tokens and ties that all records have."""

import random

import pytest
from pyspark.sql import functions as F

from veritrace.operators import matching, token_join


def brute(old, new, best):
    out = set()
    for i, s in old:
        shared = []
        for j, t in new:
            both = set(s) & set(t)
            if both:
                shared.append((-len(both), min(s.index(x) for x in both), j))
        for rank, (n, _, j) in enumerate(sorted(shared)[:best], 1):
            out.add((i, j, -n, rank))
    return out


def frames(spark, old, new):
    make = lambda rows: spark.createDataFrame(rows, "pos long, tokens array<string>").repartition(3)
    return make(old), make(new)


@pytest.mark.parametrize(("words", "size", "best"), [(12, 4, 3), (40, 8, 5), (400, 12, 20), (6, 3, 20)])
def test_most_shared(spark, words, size, best):
    rng = random.Random(words)
    weights = [1 / (k + 1) for k in range(words)]  # a few words most records have

    def rows(n):
        made = [[f"t{k}" for k in dict.fromkeys(rng.choices(range(words), weights, k=rng.randint(0, size)))] for _ in range(n)]
        made += made[: n // 4]  # equal lists
        return list(enumerate([["all", *t] if rng.random() < 0.9 else t for t in made]))

    old, new = rows(120), rows(150)
    got = token_join.most_shared(*frames(spark, old, new), "pos", "pos", "tokens", best)
    assert {tuple(r) for r in got.collect()} == brute(old, new, best)


def test_least_share_leaves_out_only_what_fails_it(spark):
    rng = random.Random(7)
    rows = lambda: [(i, [f"t{k}" for k in dict.fromkeys(rng.choices(range(60), k=40))]) for i in range(80)]
    old, new = rows(), rows()
    sizes = {i: len(t) for i, t in old}
    got = {tuple(r) for r in token_join.most_shared(*frames(spark, old, new), "pos", "pos", "tokens", 20, 0.3).collect()}
    want = brute(old, new, 20)
    assert got <= want and {r for r in want if r[2] >= 0.3 * sizes[r[0]]} <= got


def test_a_token_of_all_records_is_not_paired_in_full(spark, monkeypatch):
    n, seen = 1500, []
    real = token_join.posted
    monkeypatch.setattr(token_join, "posted", lambda a, b: seen.append(real(a, b)) or seen[-1])
    old = [(i, ["all", "also", f"a{i}", f"b{i // 3}"]) for i in range(n)]
    new = [(i, ["also", "all", f"b{i // 3}", f"c{i}"]) for i in range(n)]
    got = token_join.most_shared(*frames(spark, old, new), "pos", "pos", "tokens", 20)
    rows = got.where("rank <= 3").collect()
    assert {(r.old_pos, r.new_pos) for r in rows} == {(i, j) for i in range(n) for j in range(i - i % 3, i - i % 3 + 3)}
    monkeypatch.setattr(token_join, "posted", real)
    one = [(i, ["all", f"a{i}", f"b{i // 3}"]) for i in range(n)]
    two = [(i, ["all", f"b{i // 3}", f"c{i}"]) for i in range(n)]
    monkeypatch.setattr(token_join, "posted", lambda a, b: seen.append(real(a, b)) or seen[-1])
    token_join.most_shared(*frames(spark, one, two), "pos", "pos", "tokens", 20).collect()
    assert seen[-1].count() <= 3 * n  # of n * n


def test_tokens_of_all_records_beside_names_of_their_own(spark, monkeypatch):
    """Lists that are equal from a token on are posted under it a few times, not each."""
    n, seen = 600, []
    real = token_join.posted
    monkeypatch.setattr(token_join, "posted", lambda a, b: seen.append(real(a, b)) or seen[-1])
    old = [(i, ["all", "also", f"a{i}", *([f"u{i % 50}"] if i % 3 else []), "units"]) for i in range(n)]
    new = [(i, ["units", "also", f"u{i % 40}", "all", f"a{i + n // 2}"]) for i in range(n)]
    got = token_join.most_shared(*frames(spark, old, new), "pos", "pos", "tokens", 5)
    assert {tuple(r) for r in got.collect()} == brute(old, new, 5)
    assert seen[-1].count() <= 12 * n  # of n * n


def greedy(pairs):
    old, new, out = set(), set(), set()
    for s, a, k, b in sorted((-s, a, k, b) for a, b, s, k in pairs):
        if a not in old and b not in new:
            old.add(a)
            new.add(b)
            out.add((a, b))
    return out


PAIRS = "old_pos long, new_pos long, similarity double, rank int"


@pytest.mark.parametrize("one_pass", [matching.ONE_PASS, 30])
def test_one_to_one_is_greedy(spark, one_pass):
    rng = random.Random(2)
    pairs = {(rng.randrange(300), rng.randrange(300)): (rng.choice([0.7, 0.8, 0.8, 0.9]), rng.randint(1, 20)) for _ in range(450)}
    rows = [(a, b, s, k) for (a, b), (s, k) in pairs.items()]
    got = matching.one_to_one(spark.createDataFrame(rows, PAIRS).repartition(3), one_pass=one_pass)
    assert {(r.old_pos, r.new_pos) for r in got.collect()} == greedy(rows)


def test_thousands_of_ties_take_few_jobs(spark):
    rows = [(i, (i + d) % 2000, 0.9, d + 1) for i in range(2000) for d in range(20)]
    frame = spark.createDataFrame(rows, PAIRS)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ties", "ties")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it makes a job of each stage
    try:
        got = matching.one_to_one(frame)
        found = {(r.old_pos, r.new_pos) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sparkContext.setJobGroup("", "")
    assert found == greedy(rows) and len(tracker.getJobIdsForGroup("ties")) < 20


def test_nothing_to_match(spark):
    assert matching.one_to_one(spark.createDataFrame([], PAIRS)).collect() == []
    none = spark.createDataFrame([(None, 1, 0.9, 1), (1, None, 0.9, 1), (1, 1, None, 1)], PAIRS)
    assert matching.one_to_one(none).collect() == []
    rows = spark.createDataFrame([], "pos long, tokens array<string>")
    assert token_join.most_shared(rows, rows, "pos", "pos", "tokens", 5).collect() == []
    assert matching.components(spark.createDataFrame([(1, 2), (4, 2), (7, 8), (9, 9)], "u long, v long"), "u", "v").where(F.col("node") != F.col("component")).count() == 3
