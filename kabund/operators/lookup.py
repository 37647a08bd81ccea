"""Lookup of query s-mers in all datasets, and k-mer abundances as rolling minima.

Datasets in which a query has no hit at all take no part: what a query looks like in them is worked out once for each query, under the
dataset id NOWHERE, and filled in where an answer is wanted for all datasets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kabund.functions import sequences as S
from kabund.operators.index import KEY, partition_of, postings, smers_of, some_keys
from kabund.params import IndexParams

#: Dataset id of what a query without any hit looks like. Positions of a sequence that are handled together.
NOWHERE, STRETCH = -1, 4096


def query_smers(queries: DataFrame, p: IndexParams) -> DataFrame:
    """(query_idx, pos, code, odd, keep) of queries that have a k-mer at least."""
    return smers_of(queries.where(F.length("seq") >= p.k).select("query_idx", "seq"), p)


def asked_keys(smers: DataFrame) -> DataFrame:
    """(code, odd): the distinct keys that are looked up."""
    return smers.where("keep").select(*KEY).distinct()


def hits(smers: DataFrame, post: DataFrame, p: IndexParams, dense: DataFrame | None = None) -> DataFrame:
    """(query_idx, pos, color_id, ab): the s-mers that a dataset has. The postings are cut down to the queries' distinct keys first.

    dense: (part, code, odd, levels). A key is looked for there first, and in post only where it is not dense: post holds the
    postings of the other keys.
    """
    asked = smers.where("keep").select("query_idx", "pos", *KEY)
    keys = some_keys(asked_keys(smers).withColumn("part", partition_of(p.partitions)))
    level = S.decode_level(F.col("level"), p.quantiser).alias("ab")
    found = post.join(keys, ["part", *KEY], "left_semi").select(*KEY, "color_id", level)
    if dense is not None:
        full = dense.join(keys, ["part", *KEY], "left_semi").select(*KEY, F.posexplode("levels").alias("color_id", "_l")).where("_l > 0")
        found = found.unionByName(full.select(*KEY, "color_id", S.decode_level(F.col("_l") - 1, p.quantiser).alias("ab")))
    return asked.join(found, KEY).select("query_idx", "pos", "color_id", "ab")


def hits_in_records(smers: DataFrame, unitigs: DataFrame, p: IndexParams) -> DataFrame:
    """As hits, of records that are in no index: s-mers that nobody asks for are left out before they are summed up."""
    found = postings(unitigs, p, only=asked_keys(smers)).select(*KEY, "color_id", S.decode_level(F.col("level"), p.quantiser).alias("ab"))
    return smers.where("keep").select("query_idx", "pos", *KEY).join(found, KEY).select("query_idx", "pos", "color_id", "ab")


def smer_abundances(smers: DataFrame, found: DataFrame) -> DataFrame:
    """(query_idx, color_id, pos, ab) with a row for each position of each query and dataset with a hit, and of each query and
    NOWHERE: 0 for absent, null for s-mers that are not in the sample."""
    everyone = smers.select("query_idx", F.lit(NOWHERE).alias("color_id")).distinct()
    pairs = found.select("query_idx", "color_id").distinct().unionByName(everyone)
    grid = smers.select("query_idx", "pos", "keep").join(pairs, "query_idx")
    joined = grid.join(found, ["query_idx", "pos", "color_id"], "left")
    return joined.select("query_idx", "color_id", "pos", F.when(F.col("keep"), F.coalesce("ab", F.lit(0))).alias("ab"))


def rolling_minimum(ab: DataFrame, z: int) -> DataFrame:
    """k-mer abundances: the minimum over z + 1 s-mers from each position; nulls count only where all are null. The last z
    positions of a sequence start no k-mer.

    A sequence is cut into stretches, each with the first z positions of the next one, so that a chromosome is many tasks' work.
    """
    if z == 0:
        return ab
    size = max(STRETCH, z + 1)
    own = F.floor(F.col("pos") / size).cast("int")
    also = F.when((F.col("pos") % size < z) & (F.col("pos") >= size), own - 1)
    rows = ab.select("query_idx", "color_id", "pos", "ab", own.alias("_own"), F.explode(F.array_compact(F.array(own, also))).alias("_stretch"))
    ahead = Window.partitionBy("query_idx", "color_id", "_stretch").orderBy("pos").rowsBetween(0, z)
    rolled = rows.select("query_idx", "color_id", "pos", "_own", "_stretch", F.min("ab").over(ahead).alias("ab"), F.count(F.lit(1)).over(ahead).alias("_n"))
    return rolled.where((F.col("_n") == z + 1) & (F.col("_own") == F.col("_stretch"))).select("query_idx", "color_id", "pos", "ab")


def kmer_abundances(smers: DataFrame, found: DataFrame, p: IndexParams) -> DataFrame:
    """(query_idx, color_id, pos, ab): abundance of each k-mer of each query, in each dataset with a hit and in NOWHERE."""
    return rolling_minimum(smer_abundances(smers, found), p.findere_z)


def everywhere(cells: DataFrame, colors: DataFrame, value: str) -> DataFrame:
    """(query_idx, color_id, value) for all datasets: where a query has no cell of its own, that of NOWHERE."""
    default = cells.where(F.col("color_id") == NOWHERE).select("query_idx", F.col(value).alias("_d"))
    own = cells.where(F.col("color_id") != NOWHERE).select("query_idx", "color_id", F.col(value).alias("_v"), F.lit(True).alias("_own"))
    all_cells = default.crossJoin(colors.select("color_id"))  # what is asked for: a cell for each query and dataset
    joined = all_cells.join(own, ["query_idx", "color_id"], "left")
    return joined.select("query_idx", "color_id", F.when(F.col("_own"), F.col("_v")).otherwise(F.col("_d")).alias(value))
