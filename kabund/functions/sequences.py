"""Sequence functions as Columns: canonical s-mers, hashes, minimizers, sampling, levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from kabund.functions import gathering, packed
from kabund.params import Quantiser, Sampling
from kabund.session import ship

def reverse_complement(seq: Column) -> Column:
    """A and T, C and G change places, N becomes T, any other letter a NUL."""
    turned = F.translate(F.reverse(seq), "ACGTN", "TGCAT")
    return F.when(seq.rlike("[^ACGTN]"), F.translate(F.reverse(F.regexp_replace(seq, "[^ACGTN]", "\x01")), "ACGTN\x01", "TGCAT\x00")).otherwise(turned)


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer (N read as A) and its reverse complement, as it is written."""
    rc = reverse_complement(kmer)
    return F.when(F.translate(kmer, "N", "A") <= rc, kmer).otherwise(rc)


def explode_keys(df: DataFrame, size: int, strand_free: bool = True, seq: str = "seq", hashed: bool = False, mini: int | None = None) -> DataFrame:
    """df without seq, and pos (from 0), code and odd: length(seq) - size + 1 rows for each row; none of a shorter sequence.

    (code, odd) is the s-mer, see packed.py and smer_text. hashed: also h, the XXH3 of its letters. mini: also mini, the least MD5 hash of
    its runs of so many letters. Letters are upper case; those outside ASCII are read as question marks.
    """
    if size < 1 or mini is not None and not 1 <= mini <= size:
        raise ValueError("s-mers need a letter at least, and minimizers are at most as long")
    ship(df.sparkSession)
    kept = [f for f in df.schema if f.name != seq]
    added = [StructField("pos", IntegerType()), StructField("code", LongType()), StructField("odd", StringType())]
    added += [StructField("h", LongType())] * hashed + [StructField("mini", LongType())] * (mini is not None)
    schema = StructType([*kept, *added])
    of = packed.exploder(size, strand_free, hashed, mini, schema.fieldNames(), to_arrow_schema(schema))
    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(seq).cast("string").alias(seq)).mapInArrow(of, schema)


def mapped(df: DataFrame, letters: str, bases: str, text: str = "text") -> DataFrame:
    """df with seq in text's place, at its end: bases for letters (a to z) of either case, and nothing for all else. Worked out once a row,
    wherever seq is used."""
    ship(df.sparkSession)
    kept = [f for f in df.schema if f.name != text]
    schema = StructType([*kept, StructField("seq", StringType())])
    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).cast("string").alias(text)).mapInArrow(packed.mapper(letters, bases, schema.fieldNames()), schema)


def digests(df: DataFrame, wanted: list[str], size: int, mini: int | None = None, seq: str = "seq") -> DataFrame:
    """df without seq, and the wanted sums of its s-mers (see packed._Digest), for each row that has one; letters are A, C, G and T."""
    ship(df.sparkSession)
    kept = [f for f in df.schema if f.name != seq]
    schema = StructType([*kept, *(StructField(x, LongType()) for x in wanted)])
    of = packed.digester(wanted, size, mini, schema.fieldNames())
    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(seq).cast("string").alias(seq)).mapInArrow(of, schema)


def minimizer_parts(df: DataFrame, size: int, mini: int, parts: int, seq: str = "seq") -> DataFrame:
    """(part, n): how many s-mers' minimizers fall into each part, several rows for each; letters are A, C, G and T."""
    ship(df.sparkSession)
    return df.select(F.col(seq).cast("string").alias(seq)).mapInArrow(packed.mini_counter(size, mini, parts, ["part", "n"]), "part int, n long")


def found_keys(rows: DataFrame, size: int, strand_free: bool, keys: pa.Table, sampling: Sampling, mini: int) -> DataFrame:
    """(code, odd, color_id, level): those of rows (color_id, level, seq) that have one of the keys (code, odd); a few rows for each
    key and dataset, one of them with its greatest level."""
    ship(rows.sparkSession)
    codes, odd = np.asarray(keys["code"].combine_chunks()).astype(np.int64), keys["odd"].to_pylist()
    plain = np.sort(codes[[x == "" for x in odd]]) if len(codes) else codes
    kept = None if sampling.kind == "none" or not sampling.zero_bits else packed.in_sample(sampling.kind, sampling.zero_bits, mini, strand_free)
    of = packed.finder(size, strand_free, plain, {x.encode() for x in odd if x}, kept, ["code", "odd", "color_id", "level"])
    whose = rows.schema["color_id"].dataType.simpleString()
    return rows.select("color_id", F.col("level").cast("int").alias("level"), F.col("seq").cast("string")).mapInArrow(of, f"code long, odd string, color_id {whose}, level int")


def whole(df: DataFrame) -> DataFrame:
    """df behind a step that changes nothing: whatever uses it asks for the same columns, so that a shuffle under it is made once and not
    once for each choice of columns."""
    return df.mapInArrow(_as_it_is, df.schema)


def _as_it_is(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches


def gathered(rows: DataFrame, size: int, strand_free: bool, low: int, reducer, schema: str) -> DataFrame:
    """What reducer (see gathering.py) makes of all s-mers of rows (tag, seq); letters are A, C, G and T. One shuffle, of some two bytes an s-mer."""
    ship(rows.sparkSession)
    cut = rows.select(F.col("tag").cast("long"), F.col("seq").cast("string")).mapInArrow(gathering.cutter(size), gathering.CUT)
    return cut.repartition("slot").sortWithinPartitions("slot").mapInArrow(gathering.gatherer(size, strand_free, low, reducer), schema)


def smer_text(size: int, code: str = "code", odd: str = "odd") -> Column:
    """The letters of a key: the digits to base 4 of its code, or what odd says."""
    digits = F.lpad(F.conv(F.col(code).cast("string"), 10, 4), size, "0")
    return F.when(F.col(odd) != "", F.col(odd)).otherwise(F.translate(digits, "0123", "ACGT"))


def explode_smers(df: DataFrame, size: int, strand_free: bool = True, seq: str = "seq") -> DataFrame:
    """df without seq, and pos and smer, as explode_keys."""
    rows = explode_keys(df, size, strand_free, seq)
    return rows.select(*[c for c in rows.columns if c not in ("code", "odd")], smer_text(size).alias("smer"))


def md5_hash(text: Column) -> Column:
    """60 bits of MD5: a hash that other SQL engines can compute as well."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


@F.pandas_udf(LongType())
def _xxh3(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import numpy as np
    import xxhash

    for t in texts:
        yield pd.Series(np.fromiter((xxhash.xxh3_64_intdigest(x) for x in t), dtype=np.uint64, count=len(t)).astype(np.int64))


def xxh3_hash(text: Column) -> Column:
    """XXH3 (64 bits) of the letters, as a signed long; Spark has no such function, so it is an Arrow one."""
    ship(SparkSession.active())
    return _xxh3(text)


def explode_minimizers(df: DataFrame, size: int, m: int, strand_free: bool = True, seq: str = "seq") -> DataFrame:
    """As explode_smers, and mini: the least hash of the s-mer's m-mers."""
    rows = explode_keys(df, size, strand_free, seq, mini=m)
    return rows.select(*[c for c in rows.columns if c not in ("code", "odd", "mini")], smer_text(size).alias("smer"), "mini")


def sampled(sampling: Sampling, smer_hash: Column | None, mini: Column | None) -> Column:
    """Whether an s-mer is in the sample: the low bits of its hash, or of its minimizer's, are zero."""
    if sampling.kind == "none" or sampling.zero_bits == 0:
        return F.lit(True)
    return (smer_hash if sampling.kind == "kmer" else mini).bitwiseAND(F.lit((1 << sampling.zero_bits) - 1)) == 0


def encode_level(count: Column, q: Quantiser) -> Column:
    """Level of an abundance of 1 or more: how many levels' least abundances it reaches, less one. For records, not for k-mers."""
    least = F.lit([x[1] for x in q.table]).cast("array<int>")
    levels = F.lit([x[0] for x in q.table]).cast("array<int>")
    v = F.least(count, F.lit(q.greatest))
    return F.element_at(levels, F.size(F.filter(least, lambda x: x <= v)))


def decode_level(level: Column, q: Quantiser) -> Column:
    """Abundance of a level; null of null."""
    values = F.lit([q.decode(x) for x in range(q.table[-1][0] + 1)]).cast("array<int>")
    return F.element_at(values, level + F.lit(1))


def bloom_slot(h: Column, bloom_bits_log2: int) -> Column:
    """Slot of a hash in a filter of 2^bits."""
    return h.bitwiseAND(F.lit((1 << bloom_bits_log2) - 1))


def bit_address(slot: Column, color: Column, level: Column, colors: int, levels: int) -> Column:
    """Place of (slot, color, level) where all colors and levels of a slot stand together."""
    return (slot * F.lit(colors) + color) * F.lit(levels) + level


def file_prefix(path: Column) -> Column:
    """A path's file name up to its first dot; a name that starts with a dot keeps it."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_extract(name, r"^(\.?[^.]*)", 1)


def plain_number(x: Column) -> Column:
    """A double as text: 99, 75.125, NaN; never an exponent."""
    text = x.cast("string")
    whole = (F.abs(x) < 1e37) & (x == F.floor(x))
    spelled = F.when(text.contains("E"), F.regexp_replace(F.format_number(x, 25), "[,]|0+$", "")).otherwise(text)
    return F.when(F.isnan(x), F.lit("NaN")).when(whole, x.cast("decimal(38,0)").cast("string")).otherwise(spelled)


def full_header(record_id: Column, description: Column) -> Column:
    return F.trim(F.concat(F.lit(">"), record_id, F.lit(" "), F.coalesce(description, F.lit(""))))
