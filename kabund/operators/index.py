"""Index operators: s-mers of unitigs to postings, totals per dataset, dense and sparse keys, statistics, merging."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kabund.functions import gathering
from kabund.functions import sequences as S
from kabund.params import IndexParams


#: Columns of an s-mer's key, and how many keys (some 40 bytes each) are broadcast at most.
KEY = ["code", "odd"]
FEW_KEYS = 1_000_000


def accepted(unitigs: DataFrame, p: IndexParams) -> DataFrame:
    """Records with a count above the minimum (strictly; a count of 0 never is) and at least one s-mer, with their level."""
    ok = unitigs.where((F.col("count") > p.abundance_min) & (F.col("count") > 0) & (F.length("seq") >= p.s))
    return ok.withColumn("level", S.encode_level(F.col("count"), p.quantiser))


def acceptance(records: DataFrame, p: IndexParams) -> DataFrame:
    """color_id, records, no_count (a null one), few (not above the minimum), short (under an s-mer's length), accepted: how many
    records of each dataset fall under what, the first reason counting."""
    none, few = F.col("count").isNull(), (F.col("count") <= p.abundance_min) | (F.col("count") <= 0)
    why = F.when(none, "no_count").when(few, "few").when(F.length("seq") < p.s, "short").otherwise("accepted")
    each = [F.sum((why == x).cast("long")).alias(x) for x in ("no_count", "few", "short", "accepted")]
    return records.groupBy("color_id").agg(F.count("*").alias("records"), *each)


def smers_of(rows: DataFrame, p: IndexParams) -> DataFrame:
    """rows without seq, with pos, the key (code, odd) and keep (whether the s-mer is in the sample)."""
    kind = p.sampling.kind if p.sampling.zero_bits else "none"
    if kind == "minimizer":
        out = S.explode_keys(rows, p.s, p.canonical, mini=min(p.m, p.s))
        return out.withColumn("keep", S.sampled(p.sampling, None, F.col("mini"))).drop("mini")
    if kind == "kmer":
        out = S.explode_keys(rows, p.s, p.canonical, hashed=True)
        return out.withColumn("keep", S.sampled(p.sampling, F.col("h"), None)).drop("h")
    return S.explode_keys(rows, p.s, p.canonical).withColumn("keep", F.lit(True))


def partition_of(partitions: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(partitions)).cast("int")


def postings(unitigs: DataFrame, p: IndexParams, only: DataFrame | None = None) -> DataFrame:
    """(part, code, odd, color_id, level): the greatest level of each s-mer and dataset. Levels are made once for each record; the
    maxima are partial before the one shuffle.

    only: keys (code, odd) in the sample, each once; others are left out before anything is shuffled. Up to FEW_KEYS are looked for where
    records are read, and no other s-mer is made a row.
    """
    rows = accepted(unitigs, p).select("color_id", "level", "seq")
    few = only.select(*KEY).limit(FEW_KEYS + 1).toArrow() if only is not None else None
    if few is not None and few.num_rows <= FEW_KEYS:
        best = S.found_keys(rows, p.s, p.canonical, few, p.sampling, min(p.m, p.s)).groupBy(*KEY, "color_id").agg(F.max("level").alias("level"))
        best = S.whole(best)  # what is found is asked for in several ways, and records should be read once
    else:
        kept = smers_of(rows, p).where("keep")
        if only is not None:
            kept = kept.join(only, KEY, "left_semi")
        best = kept.groupBy(*KEY, "color_id").agg(F.max("level").alias("level"))
    return best.select(partition_of(p.partitions).alias("part"), *KEY, "color_id", "level")


def some_keys(keys: DataFrame) -> DataFrame:
    """keys, marked for a broadcast if they are counted and found to be few."""
    return F.broadcast(keys) if keys.count() <= FEW_KEYS else keys


def with_text(post: DataFrame, p: IndexParams) -> DataFrame:
    """Postings with the s-mers' letters (smer) in place of their keys."""
    return post.select(*[c for c in post.columns if c not in KEY], S.smer_text(p.s).alias("smer"))


def kmer_counts(unitigs: DataFrame, p: IndexParams) -> DataFrame:
    """(color_id, kmer_count): sum of count times k-mers over the accepted records; shorter ones than k add nothing."""
    rows = accepted(unitigs, p)
    return rows.groupBy("color_id").agg(F.sum(F.col("count").cast("long") * F.greatest(F.lit(0), F.length("seq") - F.lit(p.k - 1))).alias("kmer_count"))


def dense_split(post: DataFrame, colors: int, missing: int = 0) -> DataFrame:
    """(code, odd, n_colors, dense): a key is dense if at most `missing` datasets lack it. A key has one posting for each dataset."""
    return post.groupBy(*KEY).agg(F.count("color_id").alias("n_colors")).withColumn("dense", F.col("n_colors") >= F.lit(colors - missing))


def dense_rows(post: DataFrame, colors: int, missing: int = 0) -> DataFrame:
    """(part, code, odd, levels): dense keys with an array of level + 1 by dataset, 0 where absent."""
    got = post.groupBy("part", *KEY).agg(F.map_from_entries(F.collect_list(F.struct("color_id", "level"))).alias("m"), F.count("*").alias("n")).where(F.col("n") >= colors - missing)
    return got.select("part", *KEY, F.transform(F.sequence(F.lit(0), F.lit(colors - 1)), lambda c: F.coalesce(F.try_element_at("m", c) + 1, F.lit(0))).alias("levels"))


def sparse_rows(post: DataFrame, colors: int, missing: int = 0) -> DataFrame:
    """The postings of the keys that are not dense."""
    few = dense_split(post, colors, missing).where("not dense").select(*KEY)
    return post.join(few, KEY, "left_semi").select("part", *KEY, "color_id", "level")


def from_dense(dense: DataFrame) -> DataFrame:
    """Postings of dense rows."""
    return dense.select("part", *KEY, F.posexplode("levels").alias("color_id", "_l")).where("_l > 0").select("part", *KEY, "color_id", (F.col("_l") - 1).alias("level"))


def totals(post: DataFrame, colors: int, missing: int = 0) -> DataFrame:
    """One row: how many keys there are, how many of them are dense and sparse, and how many postings they have."""
    split = dense_split(post, colors, missing)
    return split.agg(F.count("*").alias("keys"), F.coalesce(F.sum(F.col("dense").cast("long")), F.lit(0)).alias("dense"), F.coalesce(F.sum((~F.col("dense")).cast("long")), F.lit(0)).alias("sparse"), F.coalesce(F.sum("n_colors"), F.lit(0)).alias("postings"))


def sketch(post: DataFrame, p: IndexParams, smer_hash=S.xxh3_hash) -> DataFrame:
    """(slot, color_id, level, keys, levels): a filter with one hash instead of exact keys; keys of one slot share the greatest level."""
    slot = S.bloom_slot(smer_hash(S.smer_text(p.s)), p.bloom_bits_log2)
    rows = post.select(slot.alias("slot"), "color_id", "level")
    return rows.groupBy("slot", "color_id").agg(F.max("level").alias("level"), F.count("*").alias("keys"), F.countDistinct("level").alias("levels"))


def statistics(sketched: DataFrame) -> DataFrame:
    """One row: ones (bits set), misleading (slots of a dataset with several levels), silent (keys that share a slot and a level)."""
    return sketched.agg(F.sum("levels").alias("ones"), F.sum(F.when(F.col("levels") > 1, F.col("levels") - 1).otherwise(0)).alias("misleading"), F.sum(F.col("keys") - F.col("levels")).alias("silent"))


def chunk_of(ordinal: Column, size: int) -> Column:
    """Number of the chunk of `size` consecutive datasets."""
    return F.floor(ordinal / F.lit(size)).cast("int")


def merge_postings(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Postings of several indexes, each with its number of datasets: ids go on where the ones before end."""
    out, offset = None, 0
    for post, colors in parts:
        moved = post.withColumn("color_id", F.col("color_id") + F.lit(offset))
        out = moved if out is None else out.unionByName(moved)
        offset += colors
    if out is None:
        raise ValueError("nothing to merge")
    return out


# sums over all postings of records in no index: none of them is ever a row. Letters are A, C, G and T, and s-mers are not sampled.
#: Records (color_id, count, seq) and what is added to their color_id, of each index that is merged.
Parts = list[tuple[DataFrame, int]]


def _level_bits(p: IndexParams) -> int:
    return int(p.quantiser.table[-1][0]).bit_length()


def _tagged(parts: Parts, p: IndexParams) -> DataFrame:
    """(tag, seq): a record's dataset and level."""
    if p.sampling.kind != "none" and p.sampling.zero_bits:
        raise ValueError("sampled s-mers are not summed up here")
    out = None
    for unitigs, offset in parts:
        rows = accepted(unitigs, p).select(F.shiftleft(F.col("color_id").cast("long") + F.lit(offset), _level_bits(p)).bitwiseOR(F.col("level").cast("long")).alias("tag"), "seq")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("there are no records to sum up")
    return out


def level_sums(parts: Parts, p: IndexParams) -> DataFrame:
    """(color_id, level, n, least, greatest): how many keys of a dataset have a level, and the codes of the outermost."""
    low = _level_bits(p)
    each = S.gathered(_tagged(parts, p), p.s, p.canonical, low, gathering.Levels, "tag long, n long, least long, greatest long")
    owner, level = F.shiftright("tag", low).cast("int").alias("color_id"), F.col("tag").bitwiseAND(F.lit((1 << low) - 1)).cast("int").alias("level")
    return each.groupBy(owner, level).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def owner_sums(parts: Parts, p: IndexParams) -> DataFrame:
    """(n_colors, keys): how many keys so many datasets have."""
    each = S.gathered(_tagged(parts, p), p.s, p.canonical, _level_bits(p), gathering.Owners, "n_colors long, keys long")
    return each.groupBy("n_colors").agg(F.sum("keys").alias("keys"))


def sketch_sums(parts: Parts, p: IndexParams) -> DataFrame:
    """As statistics of a sketch by md5_hash: one row."""
    low = _level_bits(p)
    reducer = partial(gathering.Sketched, p.s, p.bloom_bits_log2)
    rows = S.gathered(_tagged(parts, p), p.s, p.canonical, low, reducer, gathering.SKETCHED)
    sums = rows.repartition("place").sortWithinPartitions("place").mapInArrow(gathering.statistician(low), "keys long, ones long, owned long")
    t = sums.agg(*[F.sum(c).alias(c) for c in ("keys", "ones", "owned")], F.max("keys").alias("_any"))
    ones, keys, owned = (F.when(F.col("keys") > 0, F.col(c)) for c in ("ones", "keys", "owned"))
    return t.select(ones.alias("ones"), (ones - owned).alias("misleading"), (keys - ones).alias("silent"))


def differences(one: list[DataFrame], other: list[DataFrame], p: IndexParams) -> DataFrame:
    """different: how many (name, key, level) one side has more often than the other. Records (color_id, count, seq) of each index on
    either side, whose color_id is the number of a name, the same on both sides."""
    builds = max(len(one), len(other))
    parts = [(u.withColumn("color_id", F.col("color_id").cast("long") * (2 * builds) + (2 * i + side)), 0) for side, all_of in enumerate((one, other)) for i, u in enumerate(all_of)]
    each = S.gathered(_tagged(parts, p), p.s, p.canonical, _level_bits(p), partial(gathering.Differing, builds, _level_bits(p)), "different long")
    return each.agg(F.coalesce(F.sum("different"), F.lit(0)).alias("different"))
