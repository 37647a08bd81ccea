"""A corpus pipeline over the documents table; each stage works on all that the one before it kept.

1. quality: documents that the quality classifier rejects go.
2. lines: lines that repeat an earlier one (up to two edits) are taken out; a document without a word left by that goes.
3. near_duplicates: one document of each group of near copies (sets of five-word shingles with a Jaccard likeness of 0.8 or more) stays.
4. decontamination: documents that hold a benchmark item go.
5. packing: the pieces of all documents in bins of 2,048 tokens, no two of a source or of a duplicate cluster in one bin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kabund.llm.common import new_folder, table, text_of
from kabund.llm.decontaminate import clean_only
from kabund.llm.line_dedup import dedup_lines
from kabund.llm.packing import pack, placed
from kabund.llm.quality import keep_good
from kabund.llm.simhash_dedup import NEAR_08, keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels table (and the texts of docs), and keeps all rows that score 0.3 or more. Null ids are kept by their
    texts' scores; a null or empty text is scored as one without n-grams."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """text without repeated lines, n_chars to match; rows that lose no line stay as they are, also blank ones and null texts."""
    out = dedup_lines(docs, length_col="n_chars" if "n_chars" in docs.columns else None)
    return out.where((F.col(out.columns[-1]) == 0) | text_of().rlike(r"\S")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the lowest id; null ids and texts without words stay."""
    return keep_one(docs, NEAR_08)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no item of the benchmark table."""
    return clean_only(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, n_tokens, bin, offset, residual: a row for each piece, in bins of 2,048 tokens."""
    return placed(pack(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has no classifier, fingerprints, bit-parallel search or packing in order: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
