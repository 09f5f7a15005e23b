"""Token and cost accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import MODEL_PRICES
from ..functions.text import lenient_decimal, lenient_tokens


def priced(usage: DataFrame, model: str, tokens_in: str, tokens_out: str, prices=MODEL_PRICES) -> DataFrame:
    """Adds cost by the model's prices per million tokens; an unknown model costs nothing. The price
    table is a literal, so it is a map lookup and not a join."""
    of = lambda i: F.try_element_at(F.create_map(*[x for p in prices for x in (F.lit(p[0]), F.lit(p[i]).cast("decimal(8,4)"))]), F.col(model))
    part = lambda c, i: F.col(c).cast("decimal(16,0)") * F.coalesce(of(i), F.lit(0).cast("decimal(8,4)"))
    # A product with 0.000001 is exact; a division by a million would round.
    return usage.withColumn("cost", ((part(tokens_in, 1) + part(tokens_out, 2)) * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(38,10)"))


def totals(usage: DataFrame, by: list[str], tokens_in: str, tokens_out: str) -> DataFrame:
    return usage.groupBy(*by).agg(F.sum(tokens_in).alias("prompt_tokens"), F.sum(tokens_out).alias("completion_tokens"), F.sum(F.col(tokens_in) + F.col(tokens_out)).alias("total_tokens"), F.sum("cost").alias("cost"))


def final_cost(calculated: Column, callback: Column) -> Column:
    """The calculated cost if it is above 0, else what the callback said."""
    return F.when(calculated > 0, calculated).otherwise(lenient_decimal(callback))


def merged(batches: DataFrame) -> DataFrame:
    """One row for the usage of several batches; tokens that are no whole numbers count 0."""
    whole = lambda c: F.sum(lenient_tokens(F.col(c), grouped=False)).alias(c)
    return batches.agg(whole("prompt_tokens"), whole("completion_tokens"), whole("total_tokens"), F.sum(lenient_decimal(F.col("total_cost"))).alias("total_cost"), F.count("*").alias("number_of_batches"))


def token_value(record: Column, preferred: str, fallback: str) -> Column:
    """The preferred field of a Variant if it is there, even if null (then 0), else the other, else 0."""
    there = F.array_contains(F.json_object_keys(F.to_json(record)), preferred)
    value = F.when(there, F.try_variant_get(record, f"$.{preferred}", "bigint")).otherwise(F.try_variant_get(record, f"$.{fallback}", "bigint"))
    return F.coalesce(value, F.lit(0).cast("bigint"))


def runs_and_agents(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """log (pos, run: Variant), runs in order: (runs, agents) with ids from 1, models of a run sorted."""
    get = lambda v, p, t="string": F.try_variant_get(v, f"$.{p}", t)
    summary = F.try_variant_get("run", "$.summary", "variant")
    agents = F.coalesce(F.try_variant_get("run", "$.summary.agents", "array<variant>"), F.array().cast("array<variant>"))
    base = log.select((F.col("pos") + 1).alias("run_id"), get(F.col("run"), "timestamp").alias("timestamp"), get(F.col("run"), "output_file").alias("output_file"), summary.alias("s"), agents.alias("agents"))
    models = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("agents", lambda a: get(a, "model_name")), lambda m: m != ""))), ", ")
    numbers = lambda v: [token_value(v, "prompt_tokens", "input_tokens").alias("prompt_tokens"), token_value(v, "completion_tokens", "output_tokens").alias("completion_tokens"), F.coalesce(get(v, "total_tokens", "bigint"), F.lit(0)).alias("total_tokens"), F.coalesce(get(v, "total_cost").try_cast("double"), F.lit(0.0)).alias("total_cost")]
    runs = base.select("run_id", "timestamp", "output_file", F.coalesce(F.nullif(models, F.lit("")), F.lit("Unknown model")).alias("models_used"), *numbers(F.col("s")))
    each = base.select("run_id", "timestamp", "output_file", F.explode("agents").alias("a"))
    name = lambda c, other: F.coalesce(F.nullif(get(F.col("a"), c), F.lit("")), F.lit(other)).alias(c)
    return runs, each.select("run_id", "timestamp", "output_file", name("agent_name", "Unknown agent"), name("model_name", "Unknown model"), *numbers(F.col("a")))


def chart_series(runs: DataFrame, agents: DataFrame) -> dict[str, DataFrame]:
    """What the four usage charts draw: cost and tokens by run, cost and tokens by agent and model."""
    by = agents.groupBy("agent_name", "model_name").agg(F.sum("total_cost").alias("total_cost"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("total_tokens").alias("total_tokens"))
    by = by.withColumn("label", F.concat_ws("\n", "agent_name", "model_name"))
    return {"cost_by_run": runs.select("run_id", "total_cost").orderBy("run_id"), "tokens_by_run": runs.select("run_id", "prompt_tokens", "completion_tokens").orderBy("run_id"), "cost_by_agent": by.select("label", "total_cost").orderBy(F.desc("total_cost")), "tokens_by_agent": by.select("label", "total_tokens").orderBy(F.desc("total_tokens"))}


def prioritise(tests: DataFrame, category: str, first: list[str], second: list[str], most: int = 12) -> DataFrame:
    """Priority 1, 2 or 3 by selected categories. One first priority at least, two in all, `most` at most,
    none in both, all of them known: anything else is an error. Names compare without case and white space."""
    flat = lambda s: " ".join(s.split()).lower()
    one, two = {flat(x) for x in first if x.strip()}, {flat(x) for x in second if x.strip()}
    if not one or one & two or not 2 <= len(one | two) <= most:
        raise ValueError(f"selections must be disjoint, with one first priority at least and 2 to {most} in all")
    value = F.array_join(F.filter(F.split(F.lower(category), r"\s+"), lambda w: w != ""), " ")
    known = {r[0] for r in tests.where(value.isin(sorted(one | two))).select(value).distinct().collect()}  # `most` at most
    if unknown := (one | two) - known:
        raise ValueError(f"unknown categories: {', '.join(sorted(unknown))}")
    return tests.withColumn("priority", F.when(value.isin(sorted(one)), 1).when(value.isin(sorted(two)), 2).otherwise(3))


def clear_uncovered(rows: DataFrame, label: str = "coverage") -> DataFrame:
    """Rows labelled uncovered lose what they speculate: name, description, steps, results."""
    bare = F.lower(F.col(label)) == "uncovered"
    text = {c: F.when(bare, F.lit("")).otherwise(F.col(c)) for c in ("test_name", "test_description") if c in rows.columns}
    lists = {c: F.when(bare, F.array().cast("array<string>")).otherwise(F.col(c)) for c in ("test_steps", "expected_results") if c in rows.columns}
    return rows.withColumns(text | lists)
