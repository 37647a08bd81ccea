"""Sharding by size-tiered compaction, with DataFrame reads and writes only.

A store is a folder of immutable shards (parquet files) and of manifests. An arrival is appended as the small shards that its
own partitions make, without a shuffle. Shards fall into tiers by the logarithm of their size; once a tier below the
target has `fanout` shards, its shards are merged, smallest first, in groups up to the target size: each group is read by one task
and written as one shard, many groups side by side in one job. A merge changes shards only through the next manifest.

A manifest lists the shards of a version. It is written aside and takes effect by one rename to the version's name that
fails if the name exists: readers see the old version or the new one, and of two writers one loses and may try again.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kabund.llm.common import file_system, new_folder


@dataclass(frozen=True)
class ShardParams:
    """target: bytes of a finished shard. base: bytes of the lowest tier's upper end. fanout: shards that start a merge, and ratio of
    the tiers' sizes. at_once: merges of a job."""

    target: int = 128 << 20
    base: int = 1 << 20
    fanout: int = 4
    at_once: int = 64

    def __post_init__(self) -> None:
        if self.target < self.base or self.base < 1 or self.fanout < 2 or self.at_once < 1:
            raise ValueError("target >= base >= 1, fanout >= 2 and at_once >= 1 are needed")


@dataclass(frozen=True)
class Shard:
    name: str  # version, and numbers within it
    path: str
    bytes: int


#: Folder's version and first number, and a file's number, in the path of a shard.
_NAME = r"/(v\d+_\d+)-[^/]*/part-(\d+)[^/]*$"


def shard_name(path: str) -> str:
    version, number = re.search(_NAME, path).groups()
    return f"{version}/{number}"


class VersionExists(RuntimeError):
    """Another writer has committed this version."""


def tier(size: int, p: ShardParams) -> int:
    """0 up to base, then one more for each factor of fanout; finished shards have the tier of the target."""
    return 0 if size <= p.base else math.ceil(round(math.log(min(size, p.target) / p.base, p.fanout), 9))


def plan_merges(shards: list[Shard], p: ShardParams) -> list[list[Shard]]:
    """Groups to merge: in each tier that has fanout shards under half the target, runs of similar size up to the target."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.bytes <= p.target // 2:
            tiers.setdefault(tier(s.bytes, p), []).append(s)
    out = []
    for _, some in sorted(tiers.items()):
        if len(some) < p.fanout:
            continue
        group: list[Shard] = []
        for s in sorted(some, key=lambda s: (s.bytes, s.name)):
            if group and sum(x.bytes for x in group) + s.bytes > p.target:
                out.append(group)
                group = []
            group.append(s)
        out.append(group)
    return [g for g in out if len(g) > 1]


class ShardStore:
    """A versioned set of shards under one folder of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, params: ShardParams = ShardParams()) -> None:
        self.spark, self.root, self.p = spark, root.rstrip("/"), params

    # manifests
    def _listed(self, folder: str) -> list:
        fs, path = file_system(self.spark, folder)
        return list(fs.listStatus(path)) if fs.exists(path) else []

    def version(self) -> int:
        """The last version, 0 before the first commit."""
        return max((int(s.getPath().getName()[1:11]) for s in self._listed(f"{self.root}/manifest") if s.getPath().getName().startswith("v")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        fs, path = file_system(self.spark, f"{self.root}/manifest/v{version:010d}.json")
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**x) for x in json.loads(text)["shards"]]

    def _commit(self, version: int, shards: list[Shard]) -> None:
        jvm = self.spark.sparkContext._jvm
        fs, aside = file_system(self.spark, f"{self.root}/manifest/.{uuid.uuid4().hex}")
        fs.mkdirs(aside.getParent())
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": version, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        name = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/v{version:010d}.json")
        try:
            context.rename(aside, name, options)
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(name):
                raise VersionExists(f"version {version} exists") from e
            raise

    # data
    def _write(self, df: DataFrame, version: int, after: int = 0) -> list[Shard]:
        folder = f"{self.root}/data/v{version:06d}_{after}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        files = sorted(((s.getPath().getName(), s.getPath().toString(), s.getLen()) for s in self._listed(folder) if s.getPath().getName().endswith(".parquet")))
        return [Shard(shard_name(path), path, size) for _, path, size in files]

    def append(self, arrival: DataFrame) -> int:
        """Add an arrival, and return the new version. An empty one makes a version with the same shards."""
        version = self.version()
        before = self.shards(version)
        if before and [f for f in self._schema(before)] != [f for f in arrival.schema]:
            raise ValueError("the arrival's columns are not those of the store")
        self._commit(version + 1, before + self._write(arrival, version + 1))
        return version + 1

    def _schema(self, shards: list[Shard]):
        return self.spark.read.parquet(shards[0].path).schema

    def compact(self) -> int:
        """Merge until no tier has enough shards; returns the last version. A merge that loses to another writer raises
        VersionExists, and nothing but its own unlisted files is left behind."""
        while True:
            version = self.version()
            shards = self.shards(version)
            merges = plan_merges(shards, self.p)
            if not merges:
                return version
            schema, made = self._schema(shards), []
            for at in range(0, len(merges), self.p.at_once):
                some = merges[at : at + self.p.at_once]
                read = [self.spark.read.schema(schema).parquet(*[s.path for s in g]).coalesce(1) for g in some]
                made += self._write(reduce(DataFrame.union, read), version + 1, len(made))
            gone = {s.path for g in merges for s in g}
            self._commit(version + 1, [s for s in shards if s.path not in gone] + made)

    def vacuum(self, keep: int = 1) -> None:
        """Remove all manifests but the last `keep`, and the files that none of these lists. Not while others write."""
        last = self.version()
        kept = {s.path for v in range(max(1, last - keep + 1), last + 1) for s in self.shards(v)}
        for s in self._listed(f"{self.root}/manifest"):
            name = s.getPath().getName()
            if name.startswith("v") and int(name[1:11]) <= last - keep:
                file_system(self.spark, s.getPath().toString())[0].delete(s.getPath(), False)
        for folder in self._listed(f"{self.root}/data"):
            files = [f.getPath() for f in self._listed(folder.getPath().toString())]
            fs = file_system(self.spark, folder.getPath().toString())[0]
            if not any(f.toString() in kept for f in files):
                fs.delete(folder.getPath(), True)
            else:
                for f in files:
                    if f.getName().endswith(".parquet") and f.toString() not in kept:
                        fs.delete(f, False)

    def read(self, version: int | None = None, with_shard: str | None = None) -> DataFrame:
        """The rows of a version; with_shard names a column that gets the shard's name."""
        shards = self.shards(version)
        if not shards:
            raise ValueError("the store is empty")
        df = self.spark.read.schema(self._schema(shards)).parquet(*[s.path for s in shards])
        if with_shard is None:
            return df
        if with_shard in df.columns:
            raise ValueError(f"the store has a column {with_shard}")
        at = F.col("_metadata.file_path")  # the name is in the path: no join
        return df.select("*", F.concat(F.regexp_extract(at, _NAME, 1), F.lit("/"), F.regexp_extract(at, _NAME, 2)).alias(with_shard))


def shard_documents(docs: DataFrame, arrivals: int = 5, p: ShardParams = ShardParams(), root: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """docs taken in as `arrivals` arrivals by ranges of the id, compacted after each; the rows of the last version and their
    shard.

    All rows and columns stay, whatever is null in them; null ids come with the first arrival. Repeated rows stay repeated. An
    empty table gives an empty one. The table must not have a column named shard.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root or new_folder(spark, "shards"), p)
    at = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / arrivals for i in range(1, arrivals)], 10_000)).first()[0] if arrivals > 1 else None
    cuts = sorted(set(at or []))
    x = F.col(id_col).cast("long")
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        cond = (F.lit(True) if low is None else x > low) & (F.lit(True) if high is None else x <= high)
        store.append(docs.where(cond | x.isNull() if low is None else cond))
        store.compact()
        store.vacuum()
    if not store.shards():
        return docs.where("false").withColumn("shard", F.lit(None).cast("string"))
    return store.read(with_shard="shard")
