"""Bounds and identity: rows without ids, repeated texts in samples, thousands of spans, hot sets."""

import time
from collections import Counter

from pyspark.sql import functions as F

from veritrace.llm import common, html_extract, language_id, pii, substring_dedup


def test_rows_of_one_short_hash_keep_their_words(spark):
    """Texts without an id, or of one id, whose 32-bit hashes are equal: none takes another's spans."""
    made = spark.range(300_000).select(F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("id").cast("string")) for i in range(40)]).alias("text"))
    same = made.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("texts")).where(F.size("texts") > 1).limit(3).collect()
    assert same
    rows = []
    for i, r in enumerate(same):
        a, b = r.texts[:2]
        rows += [(None, a), (i, a), (None, b), (i + 100, b[:0]), (i, b + " end")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(frame).collect())
    want = Counter()
    windows = Counter(" ".join(t.split()[j : j + 35]) for _, t in rows for j in range(len(t.split()) - 34))
    for i, t in rows:
        w, gone = t.split(), set()
        for j in range(len(w) - 34):
            if windows[" ".join(w[j : j + 35])] > 1:
                gone |= set(range(j, j + 35))
        want[i, len(w), len(gone)] += 1
    assert got == want


def test_language_sample_is_bounded(spark, monkeypatch):
    """A text that a third of the rows have is drawn once, and each label gives so many texts at most."""
    rows = [(None if i % 3 == 0 else i, "the same text again" if i % 3 == 0 else f"text number {i} of some words", ["aa", "bb"][i % 2]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language_id.Network, "train", lambda self, x, mask, y: seen.append((len(x), Counter(y.tolist()))))
    language_id.fit(frame, F.col("text"), F.col("lang"), sample_docs=50)
    assert seen and all(n <= 50 * language_id.SAMPLE_SEGMENTS for n in seen[0][1].values())
    monkeypatch.setattr(language_id, "MOST_LABELS", 1)
    assert language_id.fit(frame, F.col("text"), F.col("lang"), sample_docs=50).languages == ["aa"]


def test_pii_of_thousands_of_spans(spark):
    """Each candidate is looked up among the spans, not compared with all; the choice is the same."""

    def text(n):
        return " ".join(f"ab{i} (at) host{i % 7} (dot) com tel 030 {1000000 + i} mail u{i}@h{i % 5}.org token = {'%040x' % (i * 2654435761)}" for i in range(n))

    model = pii.Boosted()
    model.models, model.threshold = {k: (1.0, [0.0]) for k in range(3)}, {k: 0.5 for k in range(3)}  # all candidates pass
    frame = spark.createDataFrame([(1, text(30)), (2, text(2500))], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.find_pii(frame, model=model).collect()}
    assert time.time() - began < 60  # a comparison of all pairs takes hours
    for r in got.values():
        base = [m for k in ("email", "ip", "card", "phone") for m in r[k]]
        hits = [(m.start, m.end) for m in base]
        assert hits and len(r.added) >= 2 * len(r.email)
        if r.doc_id == 1:
            for m in r.added:
                assert not any(a < m.end and m.start < b for a, b in hits)
    # By brute force: what was proposed and is gone meets a base span or one of an earlier kind.
    one = frame.where("doc_id = 1").select(pii.candidates(F.col("text")).alias("c")).collect()[0].c
    order = [k for k, _ in pii.GENERATORS]
    base = [m for k in ("email", "ip", "card", "phone") for m in got[1][k]]
    free = [c for c in one if not any(b.start < c.end and c.start < b.end for b in base)]
    want = [(order[c.kind], c.start, c.end) for c in free if not any(d.kind < c.kind and d.start < c.end and c.start < d.end for d in free)]
    assert [(m.kind, m.start, m.end) for m in got[1].added] == sorted(want, key=lambda x: (order.index(x[0]), x[1]))


def test_grouped_join(spark):
    """Hot keys meet by broadcast, others by a shuffle: as a plain left join."""
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 900).alias("a"), (F.col("id") % 2).alias("b"), "id")
    table = rows.where("a <> 5").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    plain = rows.join(table, ["a", "b"], "left").select("a", "b", "id", "n", "top")
    got = common.grouped_join(rows, table, ["a", "b"], "n", "id")
    assert sorted(map(repr, got.select("a", "b", "id", "n", "top").collect())) == sorted(map(repr, plain.collect()))


def test_html_of_great_depth():
    """Work is in proportion to the page: open elements, closing tags that close nothing, nested names."""
    began = time.time()
    deep = html_extract.main_text("<div class=a>" * 50_000 + "<p>Hello, world. This is a text, of a page.</p>" + "</nothing>" * 20_000)
    assert deep == "Hello, world. This is a text, of a page."
    html_extract.main_text("<x>" * 50_000 + "<p>hello there, you.</p></q>" * 20_000)
    html_extract.main_text("".join(f"<div class=a{i}>word, word. " for i in range(50_000)))
    assert time.time() - began < 20


def test_language_network_works_in_place():
    """Bytes are looked up step by step: as the layers by themselves give it, in a fraction of the memory."""
    import tracemalloc

    import numpy as np

    from veritrace.llm.language_id import Network

    rng = np.random.default_rng(4)
    network = Network(["a", "b", "c"])
    x, length = rng.integers(0, 256, (128, 1024)).astype(np.uint8), rng.integers(1, 129, 1024)
    masks = [None, (np.arange(128)[:, None] < length).astype(np.float32)[..., None]]
    for mask in masks:
        ahead = network.ahead.forward(x, mask)
        back = network.back.forward(x[::-1], None if mask is None else mask[::-1])[::-1]
        want = Network._softmax(np.concatenate([ahead, back], 2) @ network.out + network.bias)
        assert np.abs(network.probabilities(x, mask) - np.moveaxis(want, 2, 0)).max() < 1e-5
    tracemalloc.start()
    network.probabilities(x, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20
