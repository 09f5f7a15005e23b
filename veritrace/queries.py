"""All queries over the synthetic tables, each with its SQL for DuckDB.

Stand-ins: orders are requirements, line items plan rows (label by return flag, complete when the
status is O), events evidence and usage, documents and conversations texts, labels assessments.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import patterns, terms
from .functions.patterns import REPORT_LAYOUT
from .functions.text import acronyms, cross_references, matched_terms, natural_key, percent_sql, signals
from .operators import chapters, containment, diff, extraction, linking, lint, metrics, ordering, planning, quality, traceability, usage, version_diff
from .operators import consensus as agree
from .plans import coverage, generation
from .sources import envelopes
from .sources.shared import fresh_path, settled, spread
from .streaming import usage_log

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _texts(spark, d):
    """Documents, for work on whole texts."""
    return spread(_t(spark, d, "documents").select("doc_id", "text"))


def _requirements(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("requirement_id"), F.col("o_orderpriority").alias("category"), "o_orderstatus")


def _tests(spark, d):
    label = F.when(F.col("l_returnflag") == "R", "covered").when(F.col("l_returnflag") == "A", "Partially Covered").otherwise("uncovered")
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("requirement_id"), label.alias("label"), (F.col("l_linestatus") == "O").alias("complete"))


def _evidence(spark, d):
    return _t(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("requirement_id"))


def _report(spark, d):
    return coverage.report(_requirements(spark, d), _tests(spark, d), _evidence(spark, d))


def _plan(spark, d):
    """Line items as whole plan rows: some without requirement, section or supporting ids."""
    rows = _t(spark, d, "lineitem")
    label = F.when(F.col("l_returnflag") == "R", "covered").when(F.col("l_returnflag") == "A", " Partially_Covered").otherwise("uncovered")
    return rows.select(
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_orderkey")).alias("requirement_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("test_id"), F.when(F.col("l_suppkey") % 7 != 0, label).alias("coverage"),
        (F.col("l_linestatus") == "O").alias("complete"), F.array((F.col("l_orderkey") + 1).cast("string"), F.lit("none")).alias("supporting_requirement_ids"),
        F.when(F.col("l_linenumber") == 1, " ").when(F.col("l_linenumber") == 2, "A1").alias("source_section"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"),
    )


_PLAN = """plan AS (SELECT CASE WHEN l_partkey % 11 <> 0 THEN l_orderkey END AS requirement_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS test_id,
  CASE WHEN l_suppkey % 7 <> 0 THEN CASE l_returnflag WHEN 'R' THEN 'covered' WHEN 'A' THEN 'partially_covered' ELSE 'uncovered' END END AS label, l_linestatus = 'O' AS complete,
  CASE l_linenumber WHEN 1 THEN ' ' WHEN 2 THEN 'A1' END AS source_section, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""


def _labelled(spark, d):
    spec = _requirements(spark, d).where("o_orderstatus <> 'P'").select("requirement_id")
    flags = lambda kind: _t(spark, d, "events").where(F.col("event_type") == kind).select(F.col("event_id").alias("requirement_id"), F.col("event_id").alias("pos"), F.col("user_id").alias("flag"))
    return spec, linking.verified(spec, _plan(spark, d), flags("error"), flags("login"))


_VERIFIED = f"""WITH {_PLAN}, u AS (SELECT *, complete AND coalesce(label, '') <> 'uncovered' AS usable FROM plan),
per AS (SELECT requirement_id, count(*) AS n, count(*) FILTER (usable) AS c, count(*) FILTER (usable AND label IS NOT NULL) AS l, count(*) FILTER (usable AND label = 'covered') AS f,
  count(*) FILTER (usable AND label = 'partially_covered') AS p, string_agg(test_id, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS tests FROM u WHERE requirement_id IS NOT NULL GROUP BY 1),
e AS (SELECT event_id AS requirement_id, count(*) FILTER (event_type = 'error') AS edges, count(*) FILTER (event_type = 'login') AS weak FROM events WHERE event_type IN ('error', 'login') GROUP BY 1),
j AS (SELECT o_orderkey AS requirement_id, coalesce(n, 0) AS n, coalesce(c, 0) AS c, coalesce(l, 0) AS l, coalesce(f, 0) AS f, coalesce(p, 0) AS p, coalesce(tests, '') AS tests, coalesce(edges, 0) + coalesce(weak, 0) > 0 AS amb
  FROM orders LEFT JOIN per ON o_orderkey = per.requirement_id LEFT JOIN e ON o_orderkey = e.requirement_id WHERE o_orderstatus <> 'P'),
verified AS (SELECT *, CASE WHEN n = 0 OR c = 0 THEN CASE WHEN amb THEN 'Ambiguous / not yet plannable' ELSE 'Uncovered' END WHEN c = n AND NOT amb AND l = c AND f = c THEN 'Covered' ELSE 'Partially covered' END AS status FROM j)
"""


_LABELLED = """
WITH per AS (SELECT l_orderkey AS requirement_id, count(*) AS n_rows,
    count(*) FILTER (l_linestatus = 'O' AND l_returnflag IN ('R', 'A')) AS n_complete,
    count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'R') AS n_covered FROM lineitem GROUP BY 1),
doubt AS (SELECT DISTINCT event_id AS requirement_id, true AS ambiguous FROM events WHERE event_type = 'error'),
j AS (SELECT o_orderkey AS requirement_id, o_orderpriority AS category, coalesce(n_rows, 0) AS n_rows, coalesce(n_complete, 0) AS n_complete, coalesce(n_covered, 0) AS n_covered, coalesce(ambiguous, false) AS ambiguous
    FROM orders LEFT JOIN per ON o_orderkey = per.requirement_id LEFT JOIN doubt ON o_orderkey = doubt.requirement_id),
labelled AS (SELECT *, CASE WHEN n_rows = 0 OR n_complete = 0 THEN CASE WHEN ambiguous THEN 'Ambiguous / not yet plannable' ELSE 'Uncovered' END
    WHEN n_complete = n_rows AND NOT ambiguous AND n_covered = n_complete THEN 'Covered' ELSE 'Partially covered' END AS verified_status FROM j)
"""


def _rate_sql(source: str, hit: str, before: str = "") -> str:
    return f"{before} SELECT count(*) AS total, count(*) FILTER ({hit}) AS matched, {percent_sql(f'count(*) FILTER ({hit})', 'count(*)')} AS percentage FROM {source}"


@query(_rate_sql("orders", "o_orderkey IN (SELECT l_orderkey FROM lineitem)"))
def mapping_coverage(spark, d):
    return metrics.rate(metrics.flagged(_requirements(spark, d), _tests(spark, d), "requirement_id"), F.col("hit"))


@query("SELECT o_orderkey AS requirement_id, o_orderpriority AS category FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unmapped_requirements(spark, d):
    return linking.unmapped(_requirements(spark, d), _tests(spark, d), "requirement_id", "requirement_id").select("requirement_id", "category")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def orphan_items(spark, d):
    spec = _requirements(spark, d).where("o_orderstatus <> 'P'")
    return linking.unmapped(_t(spark, d, "lineitem"), spec, "l_orderkey", "requirement_id").select("l_orderkey", "l_linenumber", "l_partkey")


@query(_rate_sql("lineitem", "l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"))
def orphan_rate(spark, d):
    return metrics.rate(metrics.flagged(_tests(spark, d), _requirements(spark, d).where("o_orderstatus <> 'P'"), "requirement_id"), ~F.col("hit"))


@query(_LABELLED + "SELECT requirement_id, category, n_rows, n_complete, n_covered, ambiguous, verified_status FROM labelled")
def status_classifier(spark, d):
    return linking.verify(_requirements(spark, d), _tests(spark, d), _evidence(spark, d)).select("requirement_id", "category", "n_rows", "n_complete", "n_covered", "ambiguous", "verified_status")


@query(_LABELLED + "SELECT verified_status AS status, count(*) AS n FROM labelled GROUP BY 1")
def status_counts(spark, d):
    return _report(spark, d)["status"]


@query(_LABELLED + f"SELECT count(*) AS total, sum(CASE verified_status WHEN 'Covered' THEN 1.0 WHEN 'Partially covered' THEN 0.5 ELSE 0 END)::double AS score, {percent_sql('sum(CASE verified_status WHEN $$Covered$$ THEN 2 WHEN $$Partially covered$$ THEN 1 ELSE 0 END)', 'count(*) * 2')} AS percentage FROM labelled")
def weighted_coverage(spark, d):
    return _report(spark, d)["weighted"]


@query(_LABELLED + "SELECT requirement_id, category, verified_status, ambiguous FROM labelled WHERE verified_status <> 'Covered'")
def gap_report(spark, d):
    return _report(spark, d)["gaps"].select("requirement_id", "category", "verified_status", "ambiguous")


@query(_rate_sql("labelled", "verified_status LIKE 'Ambig%' OR (verified_status = 'Uncovered' AND ambiguous)", _LABELLED))
def ambiguity_uncovered(spark, d):
    return _report(spark, d)["ambiguous"]


@query(_rate_sql("labelled WHERE n_rows > 0", "verified_status IN ('Covered', 'Partially covered')", _LABELLED))
def testability_headline(spark, d):
    return _report(spark, d)["testability"]


@query("SELECT o_orderkey AS requirement_id, coalesce(string_agg(l_linenumber::varchar || ':' || l_partkey::varchar, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS tests FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def links_by_requirement(spark, d):
    nested = linking.nest(_t(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], ["l_linenumber", "l_partkey"], "tests")
    out = _requirements(spark, d).join(nested, F.col("requirement_id") == F.col("l_orderkey"), "left")
    return out.select("requirement_id", F.coalesce(F.array_join(F.transform("tests", lambda t: F.concat_ws(":", t["l_linenumber"], t["l_partkey"])), ","), F.lit("")).alias("tests"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    rows = _t(spark, d, "lineitem").withColumn("id", F.struct("l_orderkey", "l_linenumber"))
    return linking.duplicate_ids(rows, "id").select("id.l_orderkey", "id.l_linenumber", "n")


@query("""SELECT event_id, CASE WHEN n = 1 THEN base ELSE base || '_DUP' || n END AS unique_id FROM
(SELECT event_id, user_id::varchar AS base, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)""")
def dup_suffix(spark, d):
    return ordering.suffixed(_t(spark, d, "events"), "user_id", ["event_id"]).select("event_id", "unique_id")


@query("""SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY lower(o_orderpriority), o_orderkey) - 1) // 4 + 1)::int AS part,
ceil(count(*) OVER (PARTITION BY o_custkey) / 4.0)::int AS parts FROM orders""")
def category_batches(spark, d):
    return ordering.category_batches(_t(spark, d, "orders"), "o_custkey", "o_orderpriority", ["o_orderkey"], 4).select("o_orderkey", "part", "parts")


@query("SELECT min(doc_id) AS doc_id, sha256(lower(text)) AS key_hash FROM documents GROUP BY lower(text)")
def first_seen_dedup(spark, d):
    """By a 256-bit hash, so that no text is a shuffle key."""
    rows = _t(spark, d, "documents").select("doc_id", F.sha2(F.lower("text"), 256).alias("key_hash"))
    return ordering.first_seen(rows, F.col("key_hash"), ["doc_id"])


@query("SELECT doc_id, 'REQ_' || source || '_' || lpad(n::varchar, greatest(3, length(n::varchar))::int, '0') AS new_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)")
def section_sequence_ids(spark, d):
    return ordering.section_ids(_t(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"]).select("doc_id", "new_id")


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn::varchar END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'Unknown') AS section FROM conversations")
def carry_forward_section(spark, d):
    value = F.when(F.col("role") == "user", F.col("turn").cast("string"))
    return ordering.carried(_t(spark, d, "conversations"), value, ["conv_id"], ["turn"], "section").select("conv_id", "turn", "section")


@query("""WITH m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS chunk FROM conversations)
SELECT conv_id, chunk::bigint AS chunk, count(*) AS n_rows, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS text_md5 FROM m WHERE chunk > 0 GROUP BY 1, 2""")
def semantic_chunks(spark, d):
    out = ordering.chunks(_t(spark, d, "conversations"), F.col("role") == "user", ["conv_id"], ["turn"], "text")
    return out.select("conv_id", "chunk", "n_rows", F.md5("text").alias("text_md5"))


#: Common words beside the weak terms: the synthetic texts have no weak wording.
_LINT = ["the", "and", "for", "with", "that", *terms.WEAK_WORDS]
#: Words in RE2, whose own boundaries know ASCII only: maximal runs of letters, marks, digits and underscores.
_WORD = r"[\p{L}\p{M}\p{N}_]"
_NO_WORD = r"[^\p{L}\p{M}\p{N}_]"
_TOKENS = f"regexp_extract_all(coalesce(text, ''), '{_WORD}+')"


def _whole(t: str) -> str:
    """SQL: whether lower-cased text has the term as whole words."""
    quoted = "".join(c if c.isalnum() or c == " " else "\\" + c for c in t)
    return f"regexp_matches(lower(coalesce(text, '')), '(^|{_NO_WORD}){quoted}($|{_NO_WORD})')"


def _by_length(found):
    return sorted({t.lower() for t in found}, key=lambda t: (-len(t), t))


_LINT_SQL = " || ".join(f"CASE WHEN {_whole(t)} THEN '{t},' ELSE '' END" for t in _by_length(_LINT))


@query(f"SELECT doc_id, {_LINT_SQL} AS terms FROM documents")
def term_lint(spark, d):
    return _texts(spark, d).select("doc_id", F.array_join(F.transform(matched_terms(F.col("text"), _LINT), lambda t: F.concat(t, F.lit(","))), "").alias("terms"))


def _found_sql(pattern: str) -> str:
    return f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter({_TOKENS}, lambda x: regexp_full_match(x, '{pattern}')))), ',') AS found FROM documents"


@query(_found_sql("[A-Z]{2,10}"))
def acronym_list(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(acronyms(F.col("text"), []), ",").alias("found"))


@query(_found_sql("[A-Z][A-Z0-9_]{2,}"))
def signal_list(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(signals(F.col("text")), ",").alias("found"))


_CLEAN = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '\\s*-\\s*', '-', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(lower({_CLEAN}), '{terms.NUMBER_PATTERN}'), ',') AS found FROM documents")
def number_extract(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(diff.found(F.col("text"), terms.NUMBER_PATTERN), ",").alias("found"))


@query(f"""WITH c AS (SELECT l_partkey, l_quantity, count(*) FILTER (l_linestatus = 'O') AS a, count(*) FILTER (l_linestatus = 'F') AS e FROM lineitem GROUP BY 1, 2),
t AS (SELECT sum(least(a, e))::bigint AS common, sum(a)::bigint AS actual, sum(e)::bigint AS expected FROM c)
SELECT common, actual, expected, {percent_sql('common * 2', 'actual + expected')} AS f1 FROM t""")
def multiset_f1(spark, d):
    rows = _t(spark, d, "lineitem")
    return metrics.multiset_f1(rows.where("l_linestatus = 'O'"), rows.where("l_linestatus = 'F'"), ["l_partkey", "l_quantity"])


def _versions(spark, d):
    docs = spread(_t(spark, d, "documents").select("doc_id", "text", "source"))
    return docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")


@query("""WITH h AS (SELECT doc_id, substr(sha1(lower(trim(regexp_replace(regexp_replace(coalesce(text, ''), '\\s*-\\s*', '-', 'g'), '\\s+', ' ', 'g')))), 1, 12) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY h, doc_id % 2 ORDER BY doc_id) AS k FROM h)
SELECT a.doc_id AS old_pos, b.doc_id AS new_pos FROM r a JOIN r b ON a.h = b.h AND a.k = b.k AND a.doc_id % 2 = 0 AND b.doc_id % 2 = 1""")
def exact_pairing(spark, d):
    old, new = _versions(spark, d)
    return diff.exact_pairs(old, new, "text", "doc_id").select("old_pos", "new_pos")


@query("""WITH c AS (SELECT n_name AS old_name, s_suppkey % 7 AS shift, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
o AS (SELECT s_suppkey, s_name || ' in ' || n_name AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 0),
n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name || '  IN ' || n_name ELSE s_name || ' at ' || n_name END AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 0)
SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, CASE WHEN o.text IS NULL THEN 'added' WHEN n.text IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM o FULL JOIN n ON o.s_suppkey = n.s_suppkey WHERE o.text IS NULL OR n.text IS NULL OR lower(regexp_replace(o.text, '\\s+', ' ', 'g')) <> lower(regexp_replace(n.text, '\\s+', ' ', 'g'))""")
def full_outer_diff(spark, d):
    rows = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    old = rows.where("s_suppkey % 5 <> 0").select("s_suppkey", F.concat("s_name", F.lit(" in "), "n_name").alias("text"))
    new = rows.where("s_suppkey % 4 <> 0").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit("  IN "), "n_name")).otherwise(F.concat("s_name", F.lit(" at "), "n_name")).alias("text"))
    return diff.by_key(old, new, "s_suppkey", "text").select("s_suppkey", "change")


@query()
def similar_changes(spark, d):
    """Similar pairs of two versions' part descriptions, matched one to one, with the kind of change."""
    rows = _t(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type", F.lit("size"), "p_size").alias("text"))
    old, new = rows.where("p_partkey % 2 = 0"), rows.where("p_partkey % 2 = 1")
    some = settled(diff.contenders(old, "text", "p_partkey"))
    pairs = diff.similarities(diff.candidates(some, new, "text", "p_partkey"), some, new, "text", "p_partkey", terms.MATCH_LIMITS["requirement"])
    out = diff.with_texts(diff.one_to_one(settled(pairs)), some, new, "text", "p_partkey")
    return out.withColumn("change", diff.wording_class("old_text", "new_text")).select("old_pos", "new_pos", "similarity", "change")


@query("""WITH p AS (SELECT l_shipdate::date - o_orderdate::date AS delta, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT delta::int AS "offset", n FROM p WHERE n >= 3 ORDER BY n DESC, delta LIMIT 1""")
def page_offset_mode(spark, d):
    pairs = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    epoch = F.to_date(F.lit("1970-01-01"))
    pairs = pairs.select(F.datediff(F.to_date("o_orderdate"), epoch).alias("old_page"), F.datediff(F.to_date("l_shipdate"), epoch).alias("new_page"))
    return ordering.most_common_offset(pairs, "old_page", "new_page")


@query("""WITH per AS (SELECT event_type, (event_id // 50) AS page, user_id, max(value) AS best FROM events GROUP BY 1, 2, 3)
SELECT event_type, page, count(*) AS votes, max(best) AS value FROM per GROUP BY 1, 2 HAVING count(*) >= 4""")
def consensus_votes(spark, d):
    rows = _t(spark, d, "events").withColumn("page", F.floor(F.col("event_id") / 50).cast("bigint")).select("event_id", "user_id", "event_type", "page", "value")
    none = F.lit(None).cast("bigint")
    key = agree.finding_key(F.col("page"), F.lit("a"), none, F.lit("b"), F.col("event_type"))
    return agree.consensus(rows, key, "user_id", F.col("value"), ["event_id"], 4).select("event_type", "page", "votes", "value")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 2 ELSE 3 END AS priority FROM orders")
def priorities(spark, d):
    return usage.prioritise(_t(spark, d, "orders"), "o_orderpriority", ["1-URGENT"], ["2-HIGH", "3-MEDIUM"]).select("o_orderkey", "priority")


def _usage(spark, d):
    models = F.array(*[F.lit(m) for m, _, _ in terms.MODEL_PRICES], F.lit("unknown"))
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    return _t(spark, d, "events").select(F.col("event_type").alias("agent"), F.get(models, (F.col("user_id") % 7).cast("int")).alias("model"), tokens.alias("tin"), (tokens * 3).alias("tout"))


_USAGE = "WITH u AS (SELECT event_type AS agent, [" + ", ".join(f"'{m}'" for m, _, _ in terms.MODEL_PRICES) + ", 'unknown'][user_id % 7 + 1] AS model, (props->>'$.k')::bigint AS tin, (props->>'$.k')::bigint * 3 AS tout FROM events), prices(model, pin, pout) AS (VALUES " + ", ".join(f"('{m}', {i}, {o})" for m, i, o in terms.MODEL_PRICES) + ")"


@query(_USAGE + " SELECT agent, model, sum(tin)::bigint AS prompt_tokens, sum(tout)::bigint AS completion_tokens, sum(tin + tout)::bigint AS total_tokens, round(sum(coalesce(tin * pin + tout * pout, 0))::double / 1e6, 8) AS cost FROM u LEFT JOIN prices USING (model) GROUP BY 1, 2")
def usage_by_agent(spark, d):
    out = usage.totals(usage.priced(_usage(spark, d), "model", "tin", "tout"), ["agent", "model"], "tin", "tout")
    return out.withColumn("cost", F.round(F.col("cost").cast("double"), 8))


@query("SELECT event_type, user_id % 10 AS area, count(*) AS n, grouping(event_type) * 2 + grouping(user_id % 10) AS level FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 10), ())")
def grouped_change_summary(spark, d):
    rows = _t(spark, d, "events").withColumn("area", F.col("user_id") % 10)
    return rows.groupingSets([["event_type"], ["area"], []], "event_type", "area").agg(F.count("*").alias("n"), F.grouping_id("event_type", "area").alias("level"))


@query("SELECT source, row_number() OVER (ORDER BY regexp_extract(source, '^([^0-9]*)', 1), regexp_extract(source, '([0-9]+)', 1)::bigint, source)::int AS place FROM (SELECT DISTINCT source FROM documents)")
def natural_sort_chapters(spark, d):
    from pyspark.sql import Window

    rows = _t(spark, d, "documents").select("source").distinct()
    return rows.withColumn("place", F.row_number().over(Window.orderBy(natural_key(F.col("source")))))


@query("SELECT o_orderkey FROM orders WHERE contains(lower(o_orderkey::varchar || '|' || o_orderstatus || '|' || o_orderpriority), '7|o|1-urg')")
def record_search(spark, d):
    row = F.lower(F.concat_ws("|", "o_orderkey", "o_orderstatus", "o_orderpriority"))
    return _t(spark, d, "orders").where(row.contains("7|o|1-urg")).select("o_orderkey")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'not_mapped' WHEN quality = 1 THEN 'suitable_detail' ELSE 'unclear' END AS label FROM documents LEFT JOIN labels USING (doc_id)")
def assessment_defaults(spark, d):
    reqs = _t(spark, d, "documents").select(F.col("doc_id").alias("requirement_id"))
    found = _t(spark, d, "labels").select(F.col("doc_id").alias("requirement_id"), F.when(F.col("quality") == 1, "suitable_detail").otherwise("not_mapped").alias("label"), F.lit(0).alias("pos"))
    return linking.assess(reqs, found, found, "label").select(F.col("requirement_id").alias("doc_id"), "label")


@query(f"SELECT count(*) AS n, (count(nullif(trim(text), '')) + count(nullif(trim(lang), '')) + count(nullif(trim(source), '')))::bigint AS filled, {percent_sql('count(nullif(trim(text), $$$$)) + count(nullif(trim(lang), $$$$)) + count(nullif(trim(source), $$$$))', 'count(*) * 3')} AS percentage FROM documents")
def field_completeness(spark, d):
    return metrics.field_completeness(_t(spark, d, "documents"), ["text", "lang", "source"])


@query("SELECT DISTINCT unnest(range(greatest(p_size - 2, 1)::bigint, p_size + 3)) AS page FROM part")
def chunk_page_ranges(spark, d):
    rows = _t(spark, d, "part").select((F.col("p_size") - 2).cast("bigint").alias("a"), (F.col("p_size") + 2).cast("bigint").alias("b"))
    return metrics.covered_pages(rows, "a", "b")


@query("SELECT l_orderkey % 1000 AS item, bool_or(l_partkey % 50 = 0) AS resolved FROM lineitem GROUP BY 1")
def trace_resolution(spark, d):
    values = _t(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("item"), F.col("l_partkey").alias("id"))
    known = _t(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id"))
    return linking.resolve_traces(values.select("item").distinct(), values, known).select("item", "resolved")


@query(_VERIFIED + """SELECT requirement_id, status, tests, CASE WHEN n = 0 AND amb THEN 'Requirement has no generated tests and has linked weak-word or edge-case signals.' WHEN n = 0 THEN 'Requirement has no generated tests.'
WHEN c = 0 AND amb THEN 'No linked row contains a complete executable test and observable expected result; ambiguity evidence is also present.' WHEN c = 0 THEN 'No linked row contains a complete executable test and observable expected result.'
WHEN status = 'Covered' THEN 'Every linked row contains a complete executable test, every row is marked covered, and no linked ambiguity evidence was found.'
ELSE 'At least one concrete test is available, but full coverage is not justified because ' || array_to_string(list_filter([CASE WHEN n > c THEN (n - c) || ' linked row(s) lack complete executable test content' END, CASE WHEN l < c THEN 'one or more complete tests have no recognised vPlan coverage label' END,
CASE WHEN p > 0 THEN 'one or more complete tests are marked partially covered' END, CASE WHEN amb THEN 'weak-language or edge-case evidence is linked' END], lambda x: x IS NOT NULL), '; ') || '.' END AS reason FROM verified""")
def verified_requirements(spark, d):
    _, out = _labelled(spark, d)
    return out.select("requirement_id", F.col("verified_coverage_status").alias("status"), F.array_join("linked_tests", ",").alias("tests"), F.col("coverage_verification_reason").alias("reason"))


@query(_VERIFIED + f"""SELECT {percent_sql("count(*) FILTER (requirement_id IN (SELECT requirement_id FROM plan WHERE requirement_id IS NOT NULL))", "count(*)")} AS requirement_mapping_coverage,
{percent_sql("sum(CASE status WHEN $$Covered$$ THEN 2 WHEN $$Partially covered$$ THEN 1 ELSE 0 END)", "count(*) * 2")} AS weighted_coverage, any_value(t.traceability_coverage) AS traceability_coverage,
{percent_sql("count(*) FILTER (n > 0 AND status IN ($$Covered$$, $$Partially covered$$))", "count(*) FILTER (n > 0)")} AS testability_coverage, any_value(t.orphan_rate) AS orphan_rate
FROM verified, (SELECT {percent_sql("count(*) FILTER (requirement_id IS NOT NULL OR source_section <> $$$$)", "count(*)")} AS traceability_coverage,
{percent_sql("count(*) FILTER (requirement_id IS NULL OR requirement_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> $$P$$))", "count(*)")} AS orphan_rate FROM plan) t""")
def final_percentages(spark, d):
    spec, labelled = _labelled(spark, d)
    return coverage.final_report(spec, _plan(spark, d), labelled)["coverage_percentages"]


@query(_VERIFIED + """SELECT count(*) AS total_spec_items, count(*) FILTER (status = 'Covered') AS covered, count(*) FILTER (status = 'Partially covered') AS partially_covered, count(*) FILTER (status = 'Uncovered') AS uncovered, count(*) FILTER (status LIKE 'Amb%') AS ambiguity_uncovered,
(SELECT count(*) FROM plan WHERE requirement_id IS NULL OR requirement_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) AS orphan_vplan_items FROM verified""")
def final_summary(spark, d):
    spec, labelled = _labelled(spark, d)
    return coverage.final_report(spec, _plan(spark, d), labelled)["coverage_summary"]


@query(f"WITH {_PLAN} " + _rate_sql("plan", "requirement_id IS NOT NULL OR source_section <> ''"))
def traceability_headline(spark, d):
    return traceability.headline(_plan(spark, d))


def _cited(spark, d):
    """Parts as plan rows that cite sections and tables in their fields or text, or nothing."""
    return _t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("B"), "p_size")).when(F.col("p_size") % 4 == 1, "  ").alias("section"), F.when(F.col("p_size") % 6 == 0, F.concat("p_name", F.lit(" see table A"), "p_size")).otherwise(F.col("p_name")).alias("test_description"))


_CITED = """cited AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'B' || p_size WHEN 1 THEN '  ' END AS section, CASE WHEN p_size % 6 = 0 THEN p_name || ' see table A' || p_size ELSE p_name END AS said, p_size FROM part)"""


@query(f"WITH {_CITED} " + _rate_sql("cited", r"trim(section) <> '' OR regexp_matches(said, '\b[A-Z]\d+(\.\d+)*\b') OR regexp_matches(said, '(?i)\bTable\s+[A-Z]?\d+(\.\d+)*\b')"))
def traceability_drill_down(spark, d):
    return traceability.drill_down(_cited(spark, d).drop("p_partkey"))


@query(f"WITH {_CITED} SELECT p_partkey AS item, coalesce(section IN ('B4', 'B8', 'B20'), false) OR (p_size % 6 = 0 AND p_size IN (6, 12, 18)) AS linked FROM cited")
def trace_linking(spark, d):
    plan = _cited(spark, d)
    known = spark.createDataFrame([("section", "B4"), ("section", "B8"), ("requirement", "B20"), ("table", "A6"), ("table", "A12"), ("figure", "A18"), ("requirement", "A24")], "kind string, id string")
    known = known.where("id <> 'A24'")
    return traceability.resolved(plan.select(F.col("p_partkey").alias("item")), traceability.trace_values(plan, "p_partkey"), known)


_REPORTED = "changes AS (SELECT event_id, ['metadata', 'section', 'requirement', 'note', 'figure', 'table', 'page'][event_id % 7 + 1] AS area, ['added', 'removed', 'modified', 'moved'][user_id % 4 + 1] AS change_type, CASE user_id % 5 WHEN 0 THEN 'numeric_value_change' WHEN 1 THEN 'structural_page_shift' ELSE 'content_change' END AS category, ['Title', 'version', 'author'][user_id % 3 + 1] AS identifier FROM events)"
_BUCKET = """CASE WHEN area = 'requirement' AND category = 'numeric_value_change' THEN 'numeric_changes' WHEN area = 'requirement' THEN 'requirement_changes' WHEN area IN ('table', 'figure', 'note') AND change_type <> 'moved' THEN 'modified_' || area || 's'
WHEN area IN ('table', 'figure', 'note') THEN 'moved_' || area || 's' WHEN area IN ('section', 'page') AND change_type IN ('added', 'removed') THEN area || 's_' || change_type WHEN category = 'structural_page_shift' THEN 'page_shifts'
WHEN area = 'metadata' AND lower(identifier) IN ('title', 'version', 'revision') THEN 'metadata_' || lower(identifier) ELSE 'requirement_changes' END"""


def _reported(spark, d):
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.when(u % 5 == 0, "numeric_value_change").when(u % 5 == 1, "structural_page_shift").otherwise("content_change")
    return _t(spark, d, "events").select("event_id", pick(version_diff.AREAS, e % 7).alias("area"), pick(["added", "removed", "modified", "moved"], u % 4).alias("change_type"), kind.alias("difference_category"), pick(["Title", "version", "author"], u % 3).alias("identifier"))


@query(f"WITH {_REPORTED}, layout(bucket, place) AS (VALUES " + ", ".join(f"('{b}', {i})" for i, (_, _, b) in enumerate(REPORT_LAYOUT)) + f") SELECT bucket, place::int AS place, count(event_id) AS n FROM layout LEFT JOIN (SELECT event_id, {_BUCKET} AS bucket FROM changes) USING (bucket) GROUP BY 1, 2")
def report_groups(spark, d):
    return version_diff.report_groups(_reported(spark, d)).select("bucket", "place", "n")


@query(f"WITH {_REPORTED} SELECT 'area' AS \"by\", area AS value, count(*) AS n FROM changes GROUP BY 2 UNION ALL SELECT 'change_type', change_type, count(*) FROM changes GROUP BY 2 UNION ALL SELECT 'difference_category', category, count(*) FROM changes GROUP BY 2")
def change_counts(spark, d):
    return version_diff.counts(_reported(spark, d))


_LOW = "lower(coalesce(text, ''))"
_HITS = {name: "(" + " + ".join(f"contains({_LOW}, '{w}')::int" for w in found) + ")" for name, found in patterns.CATEGORY_KEYWORDS.items()}
_BUS, _CSR = (f"(len(list_filter({_TOKENS}, lambda x: regexp_full_match(x, '" + p.replace("\\b", "") + "'))) > 0)::int * 2" for p in (patterns.BUS_SIGNAL, patterns.CONTROL_REGISTER))
_SCORES = ", ".join(f"({_HITS[n]} + {_BUS if n == 'Protocol' else _CSR if n == 'Architecture' else 0}) AS s{i}" for i, n in enumerate(patterns.CATEGORY_PRIORITY))
_BEST = "greatest(" + ", ".join(f"s{i}" for i in range(len(patterns.CATEGORY_PRIORITY))) + ")"


@query("WITH s AS (SELECT doc_id, CASE " + " ".join(f"WHEN {h} > 0 THEN '{n}'" for n, h in _HITS.items()) + f" ELSE 'Functional' END AS category, {_SCORES} FROM documents) SELECT doc_id, category, CASE WHEN {_BEST} = 0 THEN 'Functional' " + " ".join(f"WHEN s{i} = {_BEST} THEN '{n}'" for i, n in enumerate(patterns.CATEGORY_PRIORITY)) + " END AS scored FROM s")
def requirement_categories(spark, d):
    return _texts(spark, d).select("doc_id", quality.category(F.coalesce("text", F.lit(""))).alias("category"), quality.scored_category(F.coalesce("text", F.lit(""))).alias("scored"))


#: Text for RE2, whose words are ASCII: other letters as underscores, which are words as well.
_FLAT = r"trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x00-\x7f]', '_', 'g'), '\s+', ' ', 'g'))"
_SAID = " OR ".join(f"regexp_matches({_FLAT}, '{p}')" for p in (patterns.REQUIREMENT, patterns.DECLARATIVE, patterns.CONDITIONAL, patterns.FEATURE))


@query(f"SELECT doc_id, {_FLAT} <> '' AND NOT regexp_matches({_FLAT}, '{patterns.FIGURE_REFERENCE}') AND NOT regexp_matches({_FLAT}, '{patterns.LEAD_IN}') AND ({_SAID}) AS relevant FROM documents")
def relevance_filter(spark, d):
    return _texts(spark, d).select("doc_id", extraction.relevant(F.col("text"), True).alias("relevant"))


@query("SELECT doc_id, coalesce(list_count(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x, E' \\t\\r\\f\\v'), '(?i)^(NOTE|WARNING|CAUTION|IMPORTANT|ASSUMPTION)([^0-9a-z_]|$)'))), 0)::int AS notes, len(regexp_extract_all(coalesce(text, ''), '(?i)section\\s+\\d+(\\.\\d+)*'))::int AS refs FROM documents")
def page_entities(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(extraction.notes(F.col("text"))).alias("notes"), F.size(cross_references(F.col("text"))).alias("refs"))


@query(f"WITH {_PLAN}, named AS (SELECT requirement_id AS id FROM plan WHERE requirement_id IS NOT NULL), known AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P') SELECT problem, count(*) AS n, sum(n)::bigint AS total FROM (SELECT 'missing' AS problem, 1 AS n FROM known WHERE id NOT IN (SELECT id FROM named) UNION ALL SELECT 'unexpected', 1 FROM (SELECT DISTINCT id FROM named) WHERE id NOT IN (SELECT id FROM known) UNION ALL SELECT 'duplicate_test', count(*) FROM plan GROUP BY test_id HAVING count(*) > 1 UNION ALL SELECT 'several_tests', count(*) FROM named GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'row_without_id', count(*) FROM plan WHERE requirement_id IS NULL) GROUP BY 1")
def plan_check(spark, d):
    spec = _requirements(spark, d).where("o_orderstatus <> 'P'").select(F.col("requirement_id").alias("id"))
    return planning.plan_check(spec, _plan(spark, d)).groupBy("problem").agg(F.count("*").alias("n"), F.sum("n").alias("total"))


@query(f"""WITH {_PLAN} SELECT requirement_id, '{{"test_ids": [' || string_agg('"' || test_id || '"', ', ' ORDER BY l_linenumber, l_partkey, l_suppkey) || '], "supporting_requirement_ids": ["' || (requirement_id + 1) || '", "none"]}}' AS related_tests FROM plan WHERE requirement_id IS NOT NULL GROUP BY 1""")
def requirement_links(spark, d):
    return planning.link_cells(planning.links(_plan(spark, d)))


@query("""WITH t AS (SELECT p_partkey, list_filter(string_split_regex(regexp_replace(p_name || ' ' || p_brand || ' ' || p_type, '[^\\w\\- /]', '', 'g'), '\\s+'), lambda w: w <> '')[1:8] AS w FROM part)
SELECT p_partkey, array_to_string(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') OR (upper(x) = x AND lower(x) <> x) THEN x ELSE upper(x[1]) || lower(x[2:]) END), ' ') AS name, len(w) >= 2 AS usable FROM t""")
def test_names(spark, d):
    raw = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return _t(spark, d, "part").select("p_partkey", planning.test_name(raw).alias("name"), planning.usable_name(raw).alias("usable"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 < 3 THEN 'Class ' || (o_custkey % 5) ELSE 'Uncategorised' END AS requirement_category, CASE WHEN o_custkey % 5 < 3 THEN 'Sub ' || (o_custkey % 5) ELSE 'Uncategorised' END AS requirement_subcategory FROM orders""")
def taxonomy_assignment(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("k"))
    given = rows.select(F.col("id").alias("requirement_id"), F.concat(F.lit("CLASS "), "k").alias("category"), F.concat(F.lit("sub "), "k").alias("subcategory"))
    legal = spark.range(3).select(F.concat(F.lit("Class "), "id").alias("category"), F.concat(F.lit("Sub "), "id").alias("subcategory"))
    return planning.assigned(rows.select("id"), given, legal)


@query(f"""WITH {_PLAN}, edge AS (SELECT event_id AS requirement_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT test_id, label AS coverage, coalesce(n, 0)::int AS edge_cases, CASE WHEN l_partkey % 3 = 0 THEN 'Define observable pass/fail criteria for this requirement.' WHEN n > 0 THEN 'Clarify the edge-case behaviour before treating this requirement as fully testable.' ELSE 'Review requirement wording and provide enough detail for verification.' END AS required_clarification
FROM plan LEFT JOIN edge USING (requirement_id) WHERE label IN ('uncovered', 'partially_covered')""")
def uncovered_report(spark, d):
    plan = _plan(spark, d).withColumn("coverage", F.lower(F.trim("coverage"))).withColumns({"test_description": F.lit("x"), "test_constraints": F.when(F.col("pos.l_partkey") % 3 == 0, "Pass/Fail is open")})
    edges = _t(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("requirement_id"), F.struct(F.col("event_id").cast("int").alias("l_linenumber"), F.lit(0).cast("long").alias("l_partkey"), F.lit(0).cast("long").alias("l_suppkey")).alias("pos"), F.col("event_id").alias("edge_case_id"), F.col("event_type").alias("edge_case_type"), F.lit("").alias("edge_case_description"))
    return planning.uncovered_report(plan, edges).select("test_id", "coverage", F.coalesce(F.size("related_edge_cases"), F.lit(0)).alias("edge_cases"), "required_clarification")


_STRONG = ["the", "der", "les"]


@query(f"SELECT doc_id::varchar AS requirement_id, issue_type, words FROM (SELECT doc_id, 'weak_or_optional_language' AS issue_type, {_LINT_SQL} AS words FROM documents WHERE trim(text) <> '' UNION ALL SELECT doc_id, 'missing_strong_requirement_language', '' FROM documents WHERE trim(text) <> '' AND NOT ({' OR '.join(map(_whole, _STRONG))})) WHERE issue_type LIKE 'missing%' OR words <> ''")
def language_issues(spark, d):
    rows = _texts(spark, d).select(F.col("doc_id").alias("id"), "text")
    out = lint.language_report(rows, _LINT, _STRONG)
    return out.select("requirement_id", "issue_type", F.array_join(F.transform("matched_words", lambda w: F.concat(w, F.lit(","))), "").alias("words"))


_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\b(figure|table)\s+[a-z]\d+\.\d+\b', '', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH k AS (SELECT doc_id, source, {_NORMAL} AS t FROM documents), f AS (SELECT min(doc_id) AS pos, source, count(*) AS n FROM k GROUP BY source, t)
SELECT pos, n, 'REQ_' || source || '_' || lpad(i::varchar, greatest(3, length(i::varchar))::int, '0') AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS i FROM f)""")
def merged_requirements(spark, d):
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"), "text", F.col("source").alias("source_section"), F.lit(None).cast("string").alias("source_kind"))
    return chapters.merged_requirements(rows).select("pos", "n", "new_id")


@query("SELECT event_type AS agent_name, 'm' || (user_id % 3) AS model_name, sum((props->>'$.k')::bigint)::bigint AS prompt_tokens, count(*) AS n FROM events GROUP BY 1, 2")
def usage_agents(spark, d):
    """Usage records as they are logged: JSON with tokens under either of two names."""
    name = F.when(F.col("event_id") % 2 == 0, "prompt_tokens").otherwise("input_tokens")
    agent = F.concat(F.lit('{"agent_name": "'), "event_type", F.lit('", "model_name": "m'), (F.col("user_id") % 3).cast("string"), F.lit('", "'), name, F.lit('": '), F.get_json_object("props", "$.k"), F.lit("}"))
    log = _t(spark, d, "events").select(F.col("event_id").alias("pos"), F.parse_json(F.concat(F.lit('{"summary": {"agents": ['), agent, F.lit("]}}"))).alias("run"))
    _, agents = usage.runs_and_agents(log)
    return agents.groupBy("agent_name", "model_name").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.count("*").alias("n"))


@query()
def version_changes(spark, d):
    """Two versions of supplier notes under nation sections, end to end."""
    notes = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.concat(F.lit("Supplier shall deliver "), (F.col("s_suppkey") * 37 % 1000).cast("string"), F.lit(" units of lot "), F.col("s_name"), F.lit(" when requested")).alias("text"), (F.col("s_suppkey") / 4).cast("int").alias("page"), F.col("s_nationkey").cast("string").alias("section"))
    nations = _t(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"))
    meta = lambda v: spark.range(1).select(F.lit("version").alias("key"), F.lit(v).alias("value"))
    old = {"metadata": meta("1"), "sections": nations.where("pos % 5 <> 0"), "notes": notes.where("pos % 7 <> 0")}
    new = {"metadata": meta("2"), "sections": nations.where("pos % 4 <> 0").withColumn("title", F.when(F.col("pos") % 3 == 0, F.concat("title", F.lit(" 2"))).otherwise(F.col("title"))), "notes": notes.where("pos % 6 <> 0").withColumns({"text": F.when(F.col("pos") % 10 == 0, F.replace("text", F.lit("shall"), F.lit("may"))).otherwise(F.col("text")), "page": F.col("page") + (F.col("pos") % 2).cast("int")})}
    return version_diff.compare(old, new).select("change_id", "area", "change_type", "difference_category", "identifier", "old_page", "new_page", "similarity_score")


@query("""WITH r AS (SELECT greatest(l_partkey * 7, 1) AS a, l_partkey * 7 AS b FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT greatest(l_orderkey * 2 - 5, 1), l_orderkey * 2 - 5 + l_quantity::bigint FROM lineitem WHERE l_linenumber = 2),
o AS (SELECT a, b, max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE a <= b),
i AS (SELECT a, b, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT min(a) AS first, max(b) AS last FROM i GROUP BY k""")
def page_range_union(spark, d):
    """Pages that line items name, one by one or as ranges, as ranges apart from each other."""
    rows = _t(spark, d, "lineitem").where("l_linenumber in (1, 2)")
    first = F.col("l_orderkey") * 2 - 5
    chunks = rows.select(F.lit(None).cast("array<string>").alias("pages"), F.when(F.col("l_linenumber") == 1, (F.col("l_partkey") * 7).cast("string")).alias("page"), F.when(F.col("l_linenumber") == 2, first).alias("page_start"), F.when(F.col("l_linenumber") == 2, first + F.col("l_quantity").cast("bigint")).alias("page_end"))
    return quality.page_ranges(chunks)


_PART_TEXT = "concat_ws(' ', p_name, p_brand, p_type, 'size', p_size)"


@query(f"""WITH w AS (SELECT p_partkey, unnest(regexp_extract_all(lower({_PART_TEXT}), '[a-z0-9_]+')) AS token, generate_subscripts(regexp_extract_all(lower({_PART_TEXT}), '[a-z0-9_]+'), 1) AS place FROM part),
t AS (SELECT p_partkey, token, min(place) AS place FROM w WHERE length(token) >= 3 AND token NOT IN ({", ".join(f"'{t}'" for t in terms.COMMON_TOKENS)}) GROUP BY ALL),
p AS (SELECT a.p_partkey AS old_pos, b.p_partkey AS new_pos, count(*)::int AS token_score, min(a.place) AS touched FROM t a JOIN t b ON a.token = b.token AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1 GROUP BY ALL)
SELECT old_pos, new_pos, token_score, row_number() OVER (PARTITION BY old_pos ORDER BY token_score DESC, touched, new_pos)::int AS rank FROM p QUALIFY rank <= {terms.CANDIDATES}""")
def token_candidates(spark, d):
    """Of each even part's description the odd parts' that share most tokens with it."""
    rows = _t(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type", F.lit("size"), "p_size").alias("text"))
    return diff.candidates(rows.where("p_partkey % 2 = 0"), rows.where("p_partkey % 2 = 1"), "text", "p_partkey")


def _flat_sql(column: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({column}, '')), '\\s+', ' ', 'g'))"


@query(f"""WITH n AS (SELECT doc_id, {_flat_sql("text")} AS t FROM documents), whole AS (SELECT string_agg(t, ' ' ORDER BY doc_id) AS s FROM n WHERE t <> '')
SELECT item_id, contains(s, {_flat_sql("text")}) AND {_flat_sql("text")} <> '' AS found FROM benchmark, whole""")
def contained_passages(spark, d):
    """Whether a benchmark text stands in the documents, read as the pages of one source."""
    pages = _t(spark, d, "documents").select("doc_id", quality.normal(F.col("text")).alias("t"))
    need = _t(spark, d, "benchmark").select("item_id", quality.normal(F.col("text")).alias("n"))
    there = containment.contained(pages, need, order=["doc_id"]).withColumn("found", F.lit(True))
    return need.join(there, "n", "left").select("item_id", F.coalesce("found", F.lit(False)).alias("found"))


@query("SELECT event_type AS agent_name, ts::date AS day, sum(event_id % 1000)::bigint AS prompt_tokens, sum(user_id)::bigint AS completion_tokens FROM events GROUP BY ALL")
def usage_log_totals(spark, d):
    """Events as a stream of usage records, appended to a log exactly once, then summed by agent and day."""
    path, log = f"{d}/events.parquet", fresh_path(spark, "log")
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, as the source takes a file by it
    records = rows.select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("agent_name"), F.lit("m").alias("model_name"), (F.col("event_id") % 1000).alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"))
    usage_log.append_once(records, log, "events", f"{log}-checkpoint").awaitTermination()
    per = usage_log.windowed(usage_log.read_log(spark, log), "1 day")
    return per.select("agent_name", F.to_date("window.start").alias("day"), "prompt_tokens", "completion_tokens")


@query("""SELECT o_orderkey::varchar AS path, 'REQ_O' || o_orderkey AS id FROM orders UNION ALL SELECT l_orderkey::varchar, 'REQ_L' || l_partkey FROM lineitem WHERE l_linenumber <> 2
UNION ALL SELECT l_orderkey::varchar, 'REQ_D' || l_suppkey FROM lineitem""")
def nested_record_ids(spark, d):
    """Ids at any depth of documents: orders with their line items and, deeper, their suppliers."""
    line = F.struct(F.when(F.col("l_linenumber") == 2, F.lit("x")).otherwise(F.concat(F.lit("REQ_L"), F.col("l_partkey").cast("string"))).alias("id"), F.col("l_quantity").alias("n"), F.array(F.struct(F.struct(F.concat(F.lit("REQ_D"), F.col("l_suppkey").cast("string")).alias("id")).alias("of"))).alias("deep"))
    lines = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("lines"))
    orders = _t(spark, d, "orders").join(lines, "o_orderkey", "left")
    doc = F.struct(F.concat(F.lit("REQ_O"), F.col("o_orderkey").cast("string")).alias("id"), "lines")
    return envelopes.nested_ids(orders.select(F.col("o_orderkey").cast("string").alias("path"), F.to_variant_object(doc).alias("doc")))


_FIRST_LINE = r"trim(split_part(coalesce(text, ''), chr(10), 1), ' ' || chr(9) || chr(11) || chr(12) || chr(13))"


@query(rf"SELECT doc_id, {_FIRST_LINE} <> '' AND NOT regexp_matches({_FIRST_LINE}, '^\p{{Ll}}') AND NOT regexp_matches({_FIRST_LINE}, '[.,;:]$') AND NOT regexp_matches({_FIRST_LINE}, '^[A-Z][a-z]{{2,8}}\s+\d{{4}}$') AND len(list_filter(string_split_regex({_FIRST_LINE}, '\s+'), lambda w: w <> '')) <= 12 AS heading FROM documents")
def heading_rules(spark, d):
    """Whether a document's first line may be a heading."""
    first = F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0))
    return _t(spark, d, "documents").select("doc_id", extraction.plausible_heading(first).alias("heading"))


@query(f"WITH {_CITED}, linked AS (SELECT p_partkey, coalesce(section IN (SELECT 'B' || p_size FROM part WHERE p_size % 8 = 0), false) OR (p_size % 6 = 0 AND 'A' || p_size IN (SELECT 'A' || p_size FROM part WHERE p_size % 12 = 0)) AS linked FROM cited) " + _rate_sql("linked", "NOT linked"))
def broad_orphan_rate(spark, d):
    """Share of parts none of whose citations names a section or table that exists; those come from the table itself."""
    known = lambda letter, n: _t(spark, d, "part").where(F.col("p_size") % n == 0).select(F.concat(F.lit(letter), F.col("p_size").cast("string")).alias("id"))
    return traceability.orphan_rate(_cited(spark, d), "p_partkey", traceability.source_ids(sections=known("B", 8), tables=known("A", 12)))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS requirement_id, l_partkey AS id FROM lineitem),
k AS (SELECT c.*, o_orderkey IS NOT NULL AS known, o_orderpriority, o_orderstatus FROM c LEFT JOIN orders ON o_orderkey = id)
SELECT requirement_id, coalesce(string_agg(id || '/' || o_orderpriority || '/' || o_orderstatus, ',' ORDER BY id) FILTER (known AND id <> requirement_id), '') AS records, coalesce(string_agg(id::varchar, ',' ORDER BY id) FILTER (NOT known), '') AS invalid FROM k GROUP BY 1""")
def supporting_requirements(spark, d):
    """Line items' parts as cited requirements: those that exist as records, and those that do not."""
    labelled = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("requirement_id")).agg(F.collect_list("l_partkey").alias("linked_supporting_requirement_ids"))
    known = _t(spark, d, "orders").select(F.col("o_orderkey").alias("requirement_id"), F.col("o_orderpriority").alias("text"), F.col("o_orderstatus").alias("section"), F.col("o_orderkey").alias("pos"))
    out = linking.supporting_records(labelled, known)
    told = F.transform("records", lambda r: F.concat_ws("/", r["id"].cast("string"), r["text"], r["source_section"]))
    return out.select("requirement_id", F.array_join(told, ",").alias("records"), F.array_join(F.transform("invalid", lambda i: i.cast("string")), ",").alias("invalid"))


@query("SELECT l_orderkey, l_linenumber, coalesce(o_orderpriority, '') AS requirement_text FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P'")
def requirement_texts(spark, d):
    """Plan rows with the text of their requirement, where it exists."""
    specs = _t(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("pos"))
    plan = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("requirement_id"))
    return planning.with_text(plan, specs).select("l_orderkey", "l_linenumber", "requirement_text")


_TAXONOMY = "SELECT DISTINCT upper(o_orderpriority) AS p, o_orderstatus AS c FROM orders WHERE o_orderkey % 7 = 0 AND (o_orderpriority <> '5-LOW' OR o_orderstatus = 'F') AND o_orderstatus <> 'P'"


@query(f"SELECT o_orderkey AS requirement_id FROM orders LEFT JOIN ({_TAXONOMY}) ON lower(p) = lower(o_orderpriority) AND lower(c) = lower(o_orderstatus) WHERE p IS NULL")
def illegal_assignments(spark, d):
    """Orders whose priority and status are no pair of the taxonomy that a seventh of them makes."""
    orders = _t(spark, d, "orders")
    taxonomy = orders.where("o_orderkey % 7 = 0 and (o_orderpriority <> '5-LOW' or o_orderstatus = 'F') and o_orderstatus <> 'P'").select(F.upper("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("subcategory")).distinct()
    given = orders.select(F.col("o_orderkey").alias("requirement_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("subcategory"))
    return planning.illegal_assignments(given, taxonomy).select("requirement_id")


@query(_rate_sql("(SELECT CASE o_orderstatus WHEN 'P' THEN 'not_mapped' WHEN 'F' THEN 'suitable_detail' ELSE 'too_coarse' END AS label FROM orders) WHERE label <> 'not_mapped'", "label = 'suitable_detail'"))
def granularity(spark, d):
    label = F.when(F.col("o_orderstatus") == "P", "not_mapped").when(F.col("o_orderstatus") == "F", "suitable_detail").otherwise("too_coarse")
    return coverage.granularity_rate(_t(spark, d, "orders").select(label.alias("label")))


@query(rf"WITH l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), s AS (SELECT count(*) FILTER (regexp_matches(regexp_replace(line, '[^\x00-\x7f]', '_', 'g'), '{patterns.QUALITY_REQUIREMENT}')) AS said FROM l) SELECT CASE WHEN said = 0 THEN 100.0::double ELSE least(100.0, 100.0 * n / said)::double END AS value FROM s, (SELECT count(*) AS n FROM benchmark)")
def requirement_recall(spark, d):
    """Benchmark rows as captured requirements, of the documents' lines with requirement wording."""
    return quality.requirement_recall(_t(spark, d, "documents"), _t(spark, d, "benchmark"))


@query("WITH c AS (SELECT CASE " + " ".join(f"WHEN {h} > 0 THEN '{n}'" for n, h in _HITS.items()) + " ELSE 'Functional' END AS expected, CASE WHEN doc_id % 2 = 0 THEN 'Functional' ELSE 'Interface' END AS category FROM documents WHERE text <> '') SELECT CASE WHEN count(*) = 0 THEN 100.0::double ELSE (100.0 * count(*) FILTER (category = expected) / count(*))::double END AS value FROM c")
def category_consistency(spark, d):
    """Share of documents whose given category is what their keywords say."""
    rows = _t(spark, d, "documents").withColumn("category", F.when(F.col("doc_id") % 2 == 0, "Functional").otherwise("Interface"))
    return quality.category_consistency(rows, quality.category(F.col("text")))


@query("""WITH b AS (SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS batch FROM orders),
r AS (SELECT batch, bool_and(NOT (p = '1-URGENT' AND s = 'P')) AS first, batch % 2 = 0 AS second FROM b GROUP BY batch)
SELECT o_orderkey, CASE WHEN first OR second THEN p ELSE 'Uncategorised' END AS category, CASE WHEN first THEN s WHEN second THEN 'F' ELSE 'Uncategorised' END AS subcategory FROM b JOIN r USING (batch)""")
def assignment_batches(spark, d):
    """Orders categorised in batches of 100: a first answer with an illegal pair fails its batch, a second one comes for even batches."""
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))
    taxonomy = orders.where("not (p = '1-URGENT' and s = 'P')").select(F.col("p").alias("category"), F.col("s").alias("subcategory")).distinct()
    numbered = ordering.batches(orders, ["id"], 100)
    answer = lambda n, rows, status: rows.select("batch", F.lit(n).alias("attempt"), F.col("id").alias("requirement_id"), F.upper("p").alias("category"), F.lower(status).alias("subcategory"))
    answers = answer(0, numbered, F.col("s")).union(answer(1, numbered.where("batch % 2 = 0"), F.lit("F")))
    out, _ = generation.categorise(orders, taxonomy, answers, ["id"], 100)
    return out.select(F.col("id").alias("o_orderkey"), F.col("requirement_category").alias("category"), F.col("requirement_subcategory").alias("subcategory"))


@query("""WITH e AS (SELECT l_partkey, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS pos, unnest([l_returnflag || l_linenumber, l_linestatus || '0']) AS piece, generate_subscripts([1, 2], 1) AS i FROM lineitem),
f AS (SELECT l_partkey, piece, min(pos * 10 + i) AS met FROM e GROUP BY ALL), k AS (SELECT l_partkey, min_by(l_suppkey, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1)
SELECT l_partkey, l_suppkey, string_agg(piece, ',' ORDER BY met, piece) AS evidence FROM f JOIN k USING (l_partkey) GROUP BY ALL""")
def merged_evidence(spark, d):
    """Line items of one part as one record, with the evidence of all, each piece once."""
    piece = lambda a, b: F.struct(F.concat(a, b).alias("id"))
    pos = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_suppkey")
    rows = _t(spark, d, "lineitem").select("l_partkey", pos.alias("pos"), "l_suppkey", F.array(piece("l_returnflag", F.col("l_linenumber").cast("string")), piece("l_linestatus", F.lit("0"))).alias("evidence"))
    return generation.merged_evidence(rows, ["l_partkey"], "pos").select("l_partkey", "l_suppkey", F.array_join(F.transform("evidence", lambda e: e["id"]), ",").alias("evidence"))


@query("""SELECT conv_id::varchar AS document_name, max(turn) AS total_pages, (count(*) FILTER (role = 'system'))::int AS sections, (count(*) FILTER (role = 'user'))::int AS requirements, 0 AS tables, 0 AS figures,
(count(*) FILTER (role = 'assistant'))::int AS notes, 0 AS acronyms, 0 AS cross_references, count(*)::int AS semantic_chunks FROM conversations GROUP BY conv_id""")
def extraction_counts(spark, d):
    """Conversations as extracted documents: how many entities of each kind."""
    of = lambda role: F.collect_list(F.when(F.col("role") == role, F.col("turn")))
    docs = _t(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("document_name")).agg(F.max("turn").alias("total_pages"), of("system").alias("sections"), of("user").alias("requirements"), of("assistant").alias("notes"), F.collect_list("turn").alias("semantic_chunks"))
    return generation.extraction_summary(docs)


def _extracted(spark, d):
    """An extracted document and its source, made of the tables: some pages lost, some fields empty."""
    docs, keys = _t(spark, d, "documents"), F.array(*map(F.lit, patterns.REQUIRED_KEYS))
    empty = lambda c, n, value: F.when(F.col(c) % n == 0, "").otherwise(value)
    return {
        "keys": _t(spark, d, "nation").select(F.get(keys, (F.col("n_nationkey") % 15).cast("int")).alias("key")), "pages": docs.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("page_number"), "text"),
        "requirements": _t(spark, d, "benchmark").select("text", empty("item_id", 3, "Functional").alias("category")), "figures": _t(spark, d, "part").select(empty("p_size", 5, F.col("p_name")).alias("caption")),
        "tables": _t(spark, d, "supplier").select(F.col("s_nationkey").alias("page"), empty("s_suppkey", 4, F.col("s_name")).alias("csv_file")), "cross_references": _t(spark, d, "nation").select(F.concat(F.lit("Section "), F.col("n_nationkey").cast("string")).alias("reference")),
        "chunks": docs.where("doc_id % 3 = 0").select(F.lit(None).cast("array<string>").alias("pages"), (F.col("doc_id") + 1).cast("string").alias("page"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end")),
    }, docs.select(F.col("doc_id").alias("page"), "text")


def _share_sql(part: str, whole: str) -> str:
    return f"(CASE WHEN ({whole}) = 0 THEN 100.0 ELSE greatest(0.0, least(100.0, 100.0 * ({part}) / ({whole}))) END)::double"


_NUMBERED = " UNION ALL ".join(rf"SELECT unnest(regexp_extract_all(coalesce(text, ''), '{p}', 1)) AS r FROM documents" for p in (patterns.QUALITY_SECTION_REFERENCE, patterns.QUALITY_TABLE_REFERENCE))
_COMPLETE = rf"""k AS (SELECT count(DISTINCT n_nationkey % 15) FILTER (n_nationkey % 15 < {len(patterns.REQUIRED_KEYS)}) AS n FROM nation),
s AS (SELECT count(*) AS src, count(*) FILTER (doc_id % 10 <> 0) AS kept, coalesce(sum(length(text)), 0) AS src_chars, coalesce(sum(length(text)) FILTER (doc_id % 10 <> 0), 0) AS kept_chars, count(DISTINCT doc_id) FILTER (doc_id % 3 = 0) AS chunked FROM documents),
f AS (SELECT avg(v) AS v FROM (SELECT {_share_sql("count(*) + count(*) FILTER (item_id % 3 <> 0)", "count(*) * 2")} AS v FROM benchmark UNION ALL SELECT {_share_sql("count(*) FILTER (p_size % 5 <> 0)", "count(*)")} FROM part UNION ALL SELECT {_share_sql("count(*) + count(*) FILTER (s_suppkey % 4 <> 0)", "count(*) * 2")} FROM supplier)),
x AS (SELECT DISTINCT lower(r) AS r FROM ({_NUMBERED})),
l AS (SELECT count(*) AS said FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE regexp_matches(regexp_replace(line, '[^\x00-\x7f]', '_', 'g'), '{patterns.QUALITY_REQUIREMENT}')),
complete AS (SELECT 'required_json_field' AS component, {_share_sql("n", str(len(patterns.REQUIRED_KEYS)))} AS value FROM k UNION ALL SELECT 'page_coverage', {_share_sql("kept", "src")} FROM s UNION ALL SELECT 'text_coverage', {_share_sql("kept_chars", "src_chars")} FROM s
  UNION ALL SELECT 'semantic_chunk_coverage', {_share_sql("chunked", "src")} FROM s UNION ALL SELECT 'record_field_completeness', v FROM f
  UNION ALL SELECT 'cross_reference_recall', {_share_sql("count(*) FILTER (r IN (SELECT n_nationkey::varchar FROM nation))", "count(*)")} FROM x UNION ALL SELECT 'requirement_recall', {_share_sql("(SELECT count(*) FROM benchmark)", "said")} FROM l)"""


@query(f"WITH {_COMPLETE} SELECT component, round(value, 6) AS value FROM complete")
def extraction_completeness(spark, d):
    return quality.completeness(*_extracted(spark, d)).select("component", F.round("value", 6).alias("value"))


@query(f"""WITH {_COMPLETE}, scores AS (SELECT 'completeness' AS score, avg(value) AS v FROM complete UNION ALL SELECT 'pages', value FROM complete WHERE component = 'page_coverage'),
every AS (SELECT * FROM scores UNION ALL SELECT 'overall', avg(v) FROM scores) SELECT score, round(v, 2) AS percentage, CASE WHEN v >= 60 THEN 'pass' ELSE 'fail' END AS status FROM every""")
def extraction_verdict(spark, d):
    """The scores' means, their mean, and what passes."""
    scores = quality.completeness(*_extracted(spark, d))
    return quality.overall({"completeness": scores, "pages": scores.where("component = 'page_coverage'")}, 60.0)
