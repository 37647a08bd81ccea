"""FASTA sources: plain, gzip and zstd files, manifests, headers with abundances."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kabund.session import ship, spread

#: Tags before an abundance in a header; the first one that a header has counts (fixed values).
TAGS = ("km:f:", "ka:f:")
RECORDS = "path string, record_idx long, id string, description string, seq string"


def hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_manifest(spark: SparkSession, path: str) -> list[str]:
    """Paths of a manifest, one a line, trimmed, without blank lines, in order."""
    fs, p = hadoop(spark, path)
    stream = fs.open(p)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return [x.strip() for x in text.splitlines() if x.strip()]


@dataclass(frozen=True)
class InputFile:
    path: str
    bytes: int | None  # None: it can't be read
    kind: str = "plain"  # plain, gzip, zstd by name (Spark's codecs read these), or sniffed-gzip, sniffed-zstd by first bytes


def inspect(spark: SparkSession, paths: list[str]) -> list[InputFile]:
    """Size and compression of each file: zstd by its first bytes, gzip by name or first bytes, else plain."""
    out = []
    for path in paths:
        fs, p = hadoop(spark, path)
        try:
            size = fs.getFileStatus(p).getLen()
            stream = fs.open(p)
            head = bytes(max(0, stream.read()) for _ in range(min(4, size)))
            stream.close()
        except Exception as e:  # py4j wraps what the store throws
            if "java." not in str(e) and "hadoop" not in str(e):
                raise
            out.append(InputFile(path, None))
            continue
        if head == b"\x28\xb5\x2f\xfd":
            kind = "zstd" if path.endswith(".zst") else "sniffed-zstd"
        elif path.endswith(".gz"):
            kind = "gzip"
        else:
            kind = "sniffed-gzip" if head[:2] == b"\x1f\x8b" else "plain"
        out.append(InputFile(path, size, kind))
    return out


def sort_by_size(files: list[InputFile]) -> list[InputFile]:
    """Ascending by size, unreadable ones last, otherwise in the order given."""
    return sorted(files, key=lambda f: (f.bytes is None, f.bytes or 0))


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else zstandard.ZstdDecompressor().decompressobj().decompress(content)
            records = data.decode("utf-8", "replace").split("\n>")
            for at in range(0, len(records), 10_000):
                yield pd.DataFrame({"path": path, "start": 0, "rec": records[at : at + 10_000]})


def _counted(raw: DataFrame) -> DataFrame:
    """(_at, start, n, rec) of (path, start, rec) without blank records: n goes up by one from each record of a split to the next."""
    record = F.regexp_replace(F.regexp_replace("rec", "\r", ""), r"^\s*>", "")
    rows = raw.select(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/").alias("_at"), "start", record.alias("rec")).where(F.length(F.trim("rec")) > 0)
    return rows.select("_at", "start", F.monotonically_increasing_id().alias("n"), "rec")


def read_fasta(spark: SparkSession, files: list[InputFile], numbered: bool = False) -> DataFrame:
    """Records of the files that can be read, with path as given. record_idx counts a file's records from 0 if numbered, else it
    only orders the records of one split. Sequences are upper case, without line breaks."""
    parts: list[DataFrame] = []
    by_codec = [f.path for f in files if f.bytes and not f.kind.startswith("sniffed")]
    sniffed = [f.path for f in files if f.bytes and f.kind.startswith("sniffed")]
    if by_codec:
        text = spark.read.option("lineSep", "\n>").text(by_codec)
        parts.append(spread(_counted(text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("rec")))))
    if sniffed:
        ship(spark)
        raw = spark.read.format("binaryFile").load(sniffed).select("path", "content")
        parts.append(_counted(raw.mapInPandas(_unpacked, "path string, start long, rec string")))
    if not parts:
        return spark.createDataFrame([], RECORDS)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    header = F.substring_index("rec", "\n", 1)
    body = F.when(F.instr("rec", "\n") > 0, F.expr("substring(rec, instr(rec, '\n') + 1)")).otherwise(F.lit(""))
    split = F.split(header, r"\s+", 2)
    rows = rows.select("_at", "start", "n", F.element_at(split, 1).alias("id"), F.when(F.size(split) > 1, F.element_at(split, 2)).alias("description"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"))
    if numbered:  # from a split's first record, and from the splits before it; no record is moved
        sizes = rows.groupBy(F.col("_at").alias("_a"), F.col("start").alias("_s")).agg(F.count("*").alias("_size"), F.min("n").alias("_least"))
        before = F.coalesce(F.sum("_size").over(Window.partitionBy("_a").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = sizes.select("_a", "_s", "_least", before.alias("_before"))  # a row for each split, which the driver lists
        rows = rows.join(F.broadcast(offsets), (F.col("_at") == F.col("_a")) & (F.col("start") == F.col("_s"))).withColumn("record_idx", F.col("_before") + F.col("n") - F.col("_least"))
    else:
        rows = rows.withColumn("record_idx", F.col("start") * 0 + F.col("n"))
    import re

    names = {re.sub(r"^[a-z0-9]+:/+", "/", f.path if "/" in f.path[:1] or ":" in f.path else _absolute(f.path)): f.path for f in files if f.bytes}
    known = spark.createDataFrame([(a, b) for a, b in names.items()], "_at string, path string")
    # a row for each input file, which is what the driver lists anyway
    return rows.join(F.broadcast(known), "_at").select("path", "record_idx", "id", "description", "seq")


def _absolute(path: str) -> str:
    import os

    return os.path.abspath(path)


def dialect(header: Column) -> Column:
    """The tag that a header has, null if none."""
    return F.when(header.contains(TAGS[0]), F.lit(TAGS[0])).when(header.contains(TAGS[1]), F.lit(TAGS[1]))


def header_count(header: Column, tag: Column) -> Column:
    """Abundance behind the tag in the first of the header's words that starts with it: a float, cut to a whole number from 0 to
    65535; null where there is none."""
    at = F.when(tag == TAGS[0], F.regexp_extract(header, r"(?:^|\s)km:f:(\S+)", 1)).otherwise(F.regexp_extract(header, r"(?:^|\s)ka:f:(\S+)", 1))
    value = at.try_cast("float").cast("double")
    return F.when(value.isNotNull(), F.when(F.isnan(value), F.lit(0)).otherwise(F.least(F.lit(65535.0), F.greatest(F.lit(0.0), F.floor(value)))).cast("int"))


def with_counts(records: DataFrame, allow_in_id: bool = True) -> DataFrame:
    """records with count, by the dialect (tag, and whether it stands in the id or the description) of each file's first record.

    A record without the tag or with a bad number has a null count; so have all records of a file whose first record has no tag.
    """
    found = F.coalesce(F.when(dialect(F.col("description")).isNotNull(), F.struct(dialect(F.col("description")).alias("tag"), F.lit(False).alias("in_id"))), F.when(dialect(F.col("id")).isNotNull() & F.lit(allow_in_id), F.struct(dialect(F.col("id")).alias("tag"), F.lit(True).alias("in_id"))))
    first = records.groupBy("path").agg(F.min_by(F.struct(found.alias("d")), "record_idx").alias("_f")).select(F.col("path").alias("_p"), F.col("_f.d.tag").alias("_tag"), F.col("_f.d.in_id").alias("_in_id"))
    header = F.when(F.col("_in_id"), F.col("id")).otherwise(F.col("description"))
    joined = records.join(F.broadcast(first), F.col("path") == F.col("_p"), "left")  # a row for each input file, which the driver lists
    return joined.select(*records.columns, F.when(F.col("_tag").isNotNull(), header_count(header, F.col("_tag"))).alias("count"))
