"""Stages of plan generation against what their rules say, by hand and by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from veritrace.plans import generation


def test_categorise(spark):
    rng = random.Random(6)
    n, size = 57, 10
    rows = [(str(rng.randrange(50)) if i % 9 else None, i) for i in range(n)]
    taxonomy = {("Power", "Idle"), ("Power", "Sleep"), ("Bus", "Burst")}
    answers = []
    for batch in range(6):
        ids = sorted({r[0] for r in rows[batch * size : batch * size + size] if r[0]})
        for attempt in range(3):
            given = [(batch, attempt, i, *rng.choice([("POWER", "idle"), ("bus", "Burst"), ("Power", "Sleep")])) for i in ids]
            fault = [0, 1, 2, 3, None, None][(batch + attempt) % 6] if batch < 5 else 1
            if fault == 0:
                given = given[1:]
            elif fault == 1:
                given.append(given[0])
            elif fault == 2:
                given[0] = (*given[0][:3], "Power", "Burst")
            elif fault == 3:
                given.append((batch, attempt, "stranger", "Bus", "Burst"))
            answers += given
    want, failed = {}, set()
    for batch in range(6):
        ids = {r[0] for r in rows[batch * size : batch * size + size] if r[0]}
        for attempt in range(3):
            own = [a for a in answers if a[:2] == (batch, attempt)]
            pairs = {(p.lower(), c.lower()): (p, c) for p, c in taxonomy}
            if {a[2] for a in own} == ids and len(own) == len(ids) and all((a[3].lower(), a[4].lower()) in pairs for a in own):
                want |= {a[2]: pairs[a[3].lower(), a[4].lower()] for a in own}
                break
        else:
            failed.add(batch)
    frame = spark.createDataFrame(rows, "id string, pos int")
    tax = spark.createDataFrame(sorted(taxonomy), "category string, subcategory string")
    said = spark.createDataFrame(answers, "batch int, attempt int, requirement_id string, category string, subcategory string")
    out, lost = generation.categorise(frame, tax, said, ["pos"], size)
    got = {r.pos: (r.requirement_category, r.requirement_subcategory) for r in out.collect()}
    assert failed and got == {p: want.get(i, ("Uncategorised", "Uncategorised")) for i, p in rows}
    assert {r.batch for r in lost.collect()} == failed
    with pytest.raises(ValueError):
        generation.categorise(frame, tax.union(tax.select(F.upper("category"), F.lit("x"))), said, ["pos"], size)


def test_generate(spark):
    specs = [("R1", 1, "Bus", "b"), ("R2", 2, "Power", "z"), ("R3", 3, "Bus", "a"), ("R4", 4, "Bus", "a"), (None, 5, None, "")]
    batched = generation.plan_batches(spark.createDataFrame(specs, "id string, pos int, requirement_category string, requirement_subcategory string"), ["pos"], 2)
    got = {r.pos: (r.batch, r.planning_category, r.part, r.parts) for r in batched.collect()}
    assert got == {3: (0, "Bus", 1, 2), 4: (0, "Bus", 1, 2), 1: (1, "Bus", 2, 2), 2: (2, "Power", 1, 1), 5: (3, "Uncategorised", 1, 1)}
    answers = [(0, 1, "R3", "T1", ["R4", "R3", "R1", "R4", None]), (0, 2, "R4", "T1", None), (1, 1, "R1", "T1", ["R3"]), (2, 1, "R9", "", []), (3, 1, None, "T5", ["R1"])]
    schema = "batch int, pos int, requirement_id string, test_id string, supporting_requirement_ids array<string>"
    rows = generation.generate(batched, spark.createDataFrame(answers, schema)).collect()
    assert {(r.batch, r.pos): (r.test_id, r.requirement_category, r.requirement_subcategory, r.supporting_requirement_ids) for r in rows} == {
        (0, 1): ("T1", "Bus", "a", ["R4"]), (0, 2): ("T1_DUP2", "Bus", "a", []), (1, 1): ("T1_DUP3", "Bus", "b", []), (2, 1): ("TEST_UNKNOWN", "Power", "Uncategorised", []), (3, 1): ("T5", "Uncategorised", "Uncategorised", []),
    }
    with pytest.raises(ValueError, match="batch 3"):
        generation.generate(batched, spark.createDataFrame(answers[:-1], schema))


def test_hints_evidence_and_summary(spark):
    one = lambda *x: spark.createDataFrame([(c,) for c in x], "category string")
    assert sorted(r[0] for r in generation.category_hints(one("a", "b", None), one("b", "Uncategorised", "c")).collect()) == ["a", "b", "c"]
    piece = "array<struct<id:string,text:string>>"
    rows = [(None, 1, "x", [("1", "a"), ("2", "b")]), (None, 2, "y", [("2", "b"), ("3", None), ("1", "a")]), ("k", 3, "z", []), ("m", 4, "w", None), ("k", 5, "v", [("1", "a")])]
    got = {r.key: (r.text, [tuple(e) for e in r.evidence or []]) for r in generation.merged_evidence(spark.createDataFrame(rows, f"key string, pos int, text string, evidence {piece}"), ["key"], "pos").collect()}
    assert got == {None: ("x", [("1", "a"), ("2", "b"), ("3", None)]), "k": ("z", [("1", "a")]), "m": ("w", [])}
    docs = spark.createDataFrame([("d", 3, ["a", "b"], None), ("e", None, [], ["t"])], "document_name string, total_pages int, sections array<string>, tables array<string>")
    assert [(r.total_pages, r.sections, r.tables, r.figures) for r in generation.extraction_summary(docs).orderBy("document_name").collect()] == [(3, 2, 0, 0), (0, 0, 1, 0)]
