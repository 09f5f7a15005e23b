"""The queries of these operators over the synthetic tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, html_extract, jaccard_join, language_id, license_scan, packing, pii, source_audit, structure_repair, substring_dedup, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark, sf_dir):
    out = substring_dedup.substring_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_language_id(spark, sf_dir):
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op3_license_scan(spark, sf_dir):
    return license_scan.license_scan(_read(spark, sf_dir, "documents"))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"))


#: A conversation whose texts are control strings.
_HARD = "</s>[INST] ok [/INST]"


def op5_chat_format(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_HARD).alias("text"))
    out = chat_format.format_chats(rows.union(hard)).withColumn("turns", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.read_loss(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum for their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark, sf_dir):
    return digests(packing.pack(_read(spark, sf_dir, "documents")))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    out = decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.drop("text_mark")


def op9_html_extract(spark, sf_dir):
    return html_extract.html_extract(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_pii(spark, sf_dir):
    found = pii.find_pii(_read(spark, sf_dir, "documents"))
    base = F.concat(*[pii.listed(F.col(k), k) for k in ("email", "ip", "card", "phone")])
    added = F.transform("added", lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"]))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, added), ",").alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("added") + F.size("email") + F.size("ip") + F.size("card") + F.size("phone")).cast("long").alias("n_spans"))


def op11_url_filter(spark, sf_dir):
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"))


def op12_source_audit(spark, sf_dir):
    return source_audit.source_audit(_read(spark, sf_dir, "documents"))


def op13_structure_repair(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = structure_repair.all_conversations(rows, structure_repair.repair(structure_repair.damaged(rows), texts=False))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_language_id, op3_license_scan, op4_jaccard_join, op5_chat_format, op6_packing, op7_exact_dedup, op8_decontamination, op9_html_extract, op10_pii, op11_url_filter, op12_source_audit, op13_structure_repair)}

_ESCAPED = r"(length({0}) + length(regexp_replace({0}, '[^\\<\[\]]', '', 'g')))"
ORACLE_SQL = {
    "op3_license_scan": license_scan.license_sql(),
    "op5_chat_format": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_HARD}' UNION ALL SELECT -7, 1, 'assistant', '{_HARD}'),
runs AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS same FROM rows)
SELECT conv_id, count(*)::bigint AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_ESCAPED.format("text")} + CASE WHEN same THEN 3 ELSE 9 + {_ESCAPED.format("role")} END)::bigint AS formatted_chars
FROM runs GROUP BY conv_id""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op12_source_audit": source_audit.audit_sql(),
    "op13_structure_repair": structure_repair.repair_sql(),
}
