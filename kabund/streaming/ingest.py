"""Incremental indexing: FASTA files that arrive in a folder are appended to an index, a dataset each."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kabund.params import IndexParams
from kabund.plans.engine import KmerIndex


def watch(spark: SparkSession, folder: str, index_root: str, params: IndexParams, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch becomes an index of its own under index_root, named by its batch number; a batch that is run again after
    a failure replaces what it left. all_parts() reads all of them as one index."""
    names = spark.readStream.format("text").option("wholetext", "true").schema("value string").load(folder).select(F.col("_metadata.file_path").alias("path"))

    def append(batch: DataFrame, number: int) -> None:
        paths = sorted(r["path"] for r in batch.distinct().toLocalIterator())
        if not paths:
            return
        target = f"{index_root}/batch-{number:08d}"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        KmerIndex.build(spark, paths, params, sort=False).save(target)

    writer = names.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def all_parts(spark: SparkSession, index_root: str) -> KmerIndex:
    """The batches under index_root, in order, as one index."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index_root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("batch-"))
    if not parts:
        raise ValueError("no batch has been indexed")
    indexes = [KmerIndex.open(spark, x) for x in parts]
    if len(indexes) == 1:
        return indexes[0]
    open_end = [KmerIndex(x.spark, replace(x.params, capacity=0), x.postings, x.colors) for x in indexes]
    return KmerIndex.merge(open_end)
