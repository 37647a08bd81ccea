"""Sinks for query results: comma separated medians, tab separated matrices, annotated FASTA. Text as it is, without quoting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_NAMES = {"median": "_query_results.csv", "colored": "_colored_graph.fa", "matrix": "_query_results.tsv"}


def default_output(index_dir: str, kind: str) -> str:
    return index_dir.rstrip("/") + DEFAULT_NAMES["matrix" if kind.startswith("matrix") else kind]


def default_index(manifest: str) -> str:
    """Beside the manifest, its name without what follows the last dot, and _index."""
    folder, slash, name = manifest.rpartition("/")
    return f"{folder}{slash}{name.rpartition('.')[0] or name}_index"


def as_lines(df: DataFrame, separator: str, header: list[str] | None = None, drop: tuple[str, ...] = ("query_idx", "color_id")) -> DataFrame:
    """value: a line for each row (in order of query_idx and color_id), behind a header line if one is given."""
    order = [c for c in drop if c in df.columns]
    cols = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns if c not in drop]
    lines = df.select(F.lit(1).alias("_o"), *[F.col(c).cast("long").alias(f"_{c}") for c in order], F.concat_ws(separator, *cols).alias("value"))
    if header is not None:
        top = df.sparkSession.range(1).select(F.lit(0).alias("_o"), *[F.lit(-1).cast("long").alias(f"_{c}") for c in order], F.lit(separator.join(header)).alias("value"))
        lines = top.unionByName(lines)
    return lines.orderBy("_o", *[f"_{c}" for c in order]).select("value")


def write_lines(lines: DataFrame, path: str) -> None:
    """One part for each range of the order; a reader gets the lines in order of the parts' names."""
    lines.write.mode("errorifexists").text(path)
