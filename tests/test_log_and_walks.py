"""The usage log under failures and late records; JSON walked at any depth; the report's counts in one pass."""

import json

import pytest
from pyspark.sql import functions as F

from veritrace.functions import json_walk
from veritrace.operators import traceability
from veritrace.plans import coverage
from veritrace.sources import envelopes
from veritrace.streaming import usage_log

ROWS = [("2026-01-01 10:00:00", "a", "m", 5, 1), ("2026-01-01 10:30:00", "a", "m", 7, 2), ("2026-01-01 11:30:00", "b", None, 1, 0)]


def add(path, name, rows):
    path.mkdir(exist_ok=True)
    names = ["timestamp", "agent_name", "model_name", "prompt_tokens", "completion_tokens"]
    (path / name).write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))


def test_log_is_appended_once(spark, tmp_path, monkeypatch):
    source, log, mark = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "mark")
    add(source, "1.json", ROWS)
    stream = lambda: spark.readStream.schema(usage_log.SCHEMA).json(str(source))
    run = lambda: usage_log.append_once(stream(), log, "r1", mark).awaitTermination()
    total = lambda: usage_log.read_log(spark, log).agg(F.count("*"), F.sum("prompt_tokens")).first()

    real = usage_log.DataFrame.write.fget
    failed = []

    def write(self):  # the batch is written, then its driver dies before the batch is noted
        out = real(self)
        if not failed:
            failed.append(out.mode("overwrite").parquet(f"{log}/run=r1/batch=0"))
            raise RuntimeError("lost")
        return out

    from pyspark.sql.classic.dataframe import DataFrame

    real = DataFrame.write.fget
    monkeypatch.setattr(DataFrame, "write", property(write))
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(DataFrame, "write", property(real))
    run()
    assert tuple(total()) == (3, 13)
    run()
    add(source, "2.json", [("2026-01-02 00:00:00", "c", "m", 100, 0)])
    run()
    usage_log.append_once(stream(), log, "r2", str(tmp_path / "mark2")).awaitTermination()
    got = {(r.run, r.n) for r in usage_log.read_log(spark, log).groupBy("run").agg(F.count("*").alias("n")).collect()}
    assert got == {("r1", 4), ("r2", 4)}
    with pytest.raises(ValueError):
        usage_log.append_once(stream(), log, "a/b", mark)


def test_late_records(spark, tmp_path):
    source = tmp_path / "in"
    add(source, "1.json", ROWS)
    out = str(tmp_path / "out")

    def run():
        q = usage_log.usage_by_window(spark, str(source), "1 hour", "1 hour").writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    add(source, "2.json", [("2026-01-01 11:45:00", "b", None, 10, 0), ("2026-01-01 20:00:00", "z", None, 1, 0)])  # 11:45 is awaited still
    run()
    add(source, "3.json", [("2026-01-01 10:05:00", "a", "m", 1000, 0), ("2026-01-02 20:00:00", "z", None, 1, 0)])  # 10:05 is not
    run()
    got = {(r.window.start.hour, r.agent_name): r.prompt_tokens for r in spark.read.parquet(out).collect()}
    assert got[10, "a"] == 12 and got[11, "b"] == 11
    batch = usage_log.windowed(spark.read.schema(usage_log.SCHEMA).json(str(source)))
    assert batch.where("agent_name = 'a'").first().prompt_tokens == 1012


DEEP = {"id": "REQ_1", "a": [{"id": "REQ_2", "x": None, "n": -1.5e3, "t": True, "s": 'q"\\,{[:é\n'}, "id", "REQ_no", {"b": {"id": ["REQ_3", {"id": " REQ_4"}]}}], "c\"d": {"id": {"id": "REQ_5"}}, "e": "", "f": []}


def walk(v, name=None):
    if isinstance(v, dict):
        for k, x in v.items():
            yield from walk(x, k)
    elif isinstance(v, list):
        for x in v:
            yield from walk(x)
    elif v is not None:
        yield name, v


def test_json_walk(spark):
    nested = DEEP
    for _ in range(300):
        nested = {"deep": [nested, "REQ_x"], "id": 7}
    for doc in (DEEP, nested, [], {}, "text", 5, [[["a"]]], None):
        frame = spark.createDataFrame([(json.dumps(doc, ensure_ascii=False),)], "j string")
        got = frame.select(json_walk.leaves(F.col("j")).alias("a"), json_walk.named(F.col("j"), "id").alias("b"), json_walk.named(F.col("j"), 'c"d').alias("c")).first()
        text = lambda x: x if isinstance(x, str) else json.dumps(x)
        assert got.a == [text(x) for _, x in walk(doc)] and got.b == [text(x) for n, x in walk(doc) if n == "id"] and got.c == []


def test_nested_ids_take_one_job(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DEEP))
    docs = envelopes.documents(spark, str(tmp_path / "a.json"))
    spark.sparkContext.setJobGroup("walk", "walk")
    got = sorted(r.id for r in envelopes.nested_ids(docs).collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("walk"))
    spark.sparkContext.setJobGroup("", "")
    assert got == ["REQ_1", "REQ_2", "REQ_5"] and jobs == 1
    blank = spark.createDataFrame([(json.dumps(x),) for x in ({"a": [" ", None]}, {"a": [{"b": "x"}]}, {}, {"a": 0})], "j string")
    assert [r[0] for r in blank.select(traceability.has_content(F.parse_json("j"))).collect()] == [False, True, False, True]


def test_report_counts_each_table_once(spark):
    specs = spark.createDataFrame([(1,), (2,), (2,), (None,), (5,)], "requirement_id long")
    plan = spark.createDataFrame([(1, "A1"), (1, ""), (9, None), (None, "x"), (2, "s"), (None, None)], "requirement_id long, source_section string")
    got = coverage.both_sides(specs, plan)
    assert tuple(got.first()) == (5, 3, 6, 3, 5)
    assert tuple(coverage.both_sides(specs.limit(0), plan.limit(0)).first()) == (0, 0, 0, 0, 0)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("LogicalRDD") + text.count("Scan") + text.count("LocalRelation") <= 2


def test_named_values_are_taken_without_a_step_per_token(spark):
    texts = [r'{"x": "\"id\": \"REQ_no\"", "id" : "REQ_1", "d": [{"id": {"id": -2.5e3}}, {"id": null}, {"id": ["id", {"id": true}]}]}', '{"a.b": 1, "aXb": 2, "id": ""}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", json_walk.named(F.col("t"), "id").alias("v"), json_walk.named(F.col("t"), "a.b").alias("w"))
    assert [(r.v, r.w) for r in out.orderBy("i").collect()] == [(["REQ_1", "-2.5e3", "true"], []), ([""], ["1"]), (None, None)]
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()
