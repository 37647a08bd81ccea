"""The queries of this subpackage and their SQL: each takes (spark, sf_dir) and applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kabund.llm.common import table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kabund.llm.simhash_dedup import EXACT_2, simhash_components

    return simhash_components(table(spark, sf_dir, "documents"), EXACT_2)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kabund.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece, with its place in the document and in its bin, and the MD5 of the bin's tokens."""
    from kabund.llm.packing import pack

    bins = pack(table(spark, sf_dir, "documents")).select("bin", "residual", "segments", F.md5("tokens").alias("tokens_md5"))
    s = F.col("_s")
    return bins.select("bin", "residual", "tokens_md5", F.explode("segments").alias("_s")).select(*[s[c].alias(c) for c in ("doc_id", "piece", "start", "n_tokens", "offset")], "bin", "residual", "tokens_md5")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kabund.llm.token_counts import document_token_counts

    return document_token_counts(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kabund.llm.sharding import shard_documents

    stored = shard_documents(table(spark, sf_dir, "documents"))
    return stored.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "shard")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kabund.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kabund.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kabund.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = (F.col("_lines") - F.col("_gone")).cast("long")
    return out.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), kept.alias("n_kept"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kabund.llm.langid import detect_language

    return detect_language(table(spark, sf_dir, "documents"))


def op10_doc_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kabund.llm.doc_fingerprints import document_fingerprints

    return document_fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_token_counts": op4_token_counts,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_line_dedup": op8_line_dedup,
    "op9_langid": op9_langid,
    "op10_doc_fingerprints": op10_doc_fingerprints,
}

ORACLES: dict[str, str] = {
    # a line goes if an earlier one is within an edit for each 12 code points of the shorter, two at most
    "op8_line_dedup": """
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
each AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
firsts AS (SELECT line, min((doc_id, pos)) AS f, length(line) AS n FROM each WHERE line <> '' GROUP BY line),
near AS (
  SELECT DISTINCT b.line FROM firsts a JOIN firsts b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.f < b.f
  WHERE least(a.n, b.n) >= 12 AND levenshtein(a.line, b.line) <= least(2, least(a.n, b.n) // 12)),
gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM each l JOIN firsts USING (line)
  WHERE (l.doc_id, l.pos) <> firsts.f OR l.line IN (SELECT line FROM near))
SELECT e.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g.pos IS NULL) AS n_kept,
       md5(coalesce(string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (WHERE g.pos IS NULL), '')) AS text_md5
FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos GROUP BY e.doc_id
""",
}
