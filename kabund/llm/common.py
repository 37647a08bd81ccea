"""What the operators of this subpackage share: input tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kabund.session import ship

#: Rows handed to a Python worker at once. Arrow also bounds the bytes of a batch (spark.sql.execution.arrow.maxBytesPerBatch).
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Long texts: hand Python workers, which get this package's code, few rows and few bytes at a time."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Only where neither is set and all of Spark runs on this machine (tests), a temporary folder is taken; a cluster must name one.
    """
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="kabund-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and Path for a location; works for any store that Spark can reach."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # the session may be gone at exit; the cluster's own clean-up has the folder then
        return


def new_folder(spark: SparkSession, what: str) -> str:
    """A new name in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/kabund/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """As written(), with the place, for tables that their user removes as soon as they are not needed."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def text_of(name: str | Column = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce((F.col(name) if isinstance(name, str) else name).cast("string"), F.lit(""))


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores behind it until no column is called so (in any case of letters)."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def row_key(*cols: Column) -> list[Column]:
    """128 bits that tell rows apart by these columns, nulls included; rows that agree in all of them have one key."""
    told = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(n), *told) for n in (1, 2)]


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; -1 where doc_id is null."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int"), F.lit(-1))
