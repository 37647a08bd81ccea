"""KmerIndex: build, open, query, merge, describe and rename indexes that are kept as parquet tables.

An index is a folder with postings (partitioned by `part`, sorted by key within), colors-* (a row for each dataset) and
meta.json. Postings are exact: what is not there is not found. A key is (code, odd), see functions/packed.py.
"""

from __future__ import annotations

import json
import logging
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kabund.functions.sequences import full_header
from kabund.operators import formats as O
from kabund.operators import index as I
from kabund.operators import lookup as L
from kabund.params import IndexParams, QueryFormat, capacity_for
from kabund.sources import fasta, sinks

log = logging.getLogger("kabund")
POSTINGS = "code long, odd string, color_id int, level int, part int"
DENSE = "code long, odd string, levels array<int>, part int"
COLORS = "color_id int, name string, path string, bytes long, kmer_count long"


def dataset_name(path: str) -> str:
    """File name up to its first dot; a leading dot stays."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    lead = "." if name.startswith(".") else ""
    return lead + name[len(lead) :].split(".", 1)[0]


class KmerIndex:
    def __init__(self, spark: SparkSession, params: IndexParams, sparse: DataFrame, colors: DataFrame, path: str | None = None, dense: DataFrame | None = None, unitigs: DataFrame | None = None) -> None:
        """sparse: postings of the keys that are not in dense (of all keys if that is None). unitigs: records of an index that isn't saved."""
        self.spark, self.params, self.sparse, self.colors, self.path, self.dense, self.unitigs = spark, params, sparse, colors, path, dense, unitigs
        self.records: DataFrame | None = None
        #: Of an index that isn't saved: records of each index that was merged, with what their color_id goes up by.
        self.parts: I.Parts = [] if unitigs is None else [(unitigs, 0)]
        #: (color_id, name), without what it takes to count a dataset's k-mers.
        self.names = colors.select("color_id", "name")

    @property
    def postings(self) -> DataFrame:
        """(part, code, odd, color_id, level) of all keys."""
        return self.sparse if self.dense is None else self.sparse.unionByName(I.from_dense(self.dense))

    # build
    @staticmethod
    def from_unitigs(unitigs: DataFrame, colors: DataFrame, params: IndexParams) -> KmerIndex:
        """unitigs: color_id, count, seq (upper case). colors: color_id, name and, if known, path and bytes. A dataset without
        any accepted record stays, with a count of 0."""
        counts = I.kmer_counts(unitigs, params)
        extra = [F.col(c) if c in colors.columns else F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("bytes", "long"))]
        named = colors.select(F.col("color_id").cast("int").alias("color_id"), "name", *extra).join(counts, "color_id", "left")
        named = named.select("color_id", "name", "path", "bytes", F.coalesce("kmer_count", F.lit(0)).cast("long").alias("kmer_count"))
        index = KmerIndex(unitigs.sparkSession, params, I.postings(unitigs, params), named, unitigs=unitigs)
        index.names = colors.select(F.col("color_id").cast("int").alias("color_id"), "name")
        return index

    @staticmethod
    def build(spark: SparkSession, paths: list[str], params: IndexParams, sort: bool = True, allow_in_id: bool = False) -> KmerIndex:
        """An index of FASTA files, one dataset each. Datasets are numbered in the order of their files' sizes, or as given.

        Files that can't be read and records without an abundance are left out; their dataset stays. The former are logged, and
        skipped() counts the latter. allow_in_id: the abundance may stand right behind the angle bracket.
        """
        files = fasta.inspect(spark, paths)
        for f in files:
            if f.bytes is None:
                log.warning("%s can't be read; its dataset stays empty", f.path)
        files = fasta.sort_by_size(files) if sort else files
        capacity = capacity_for(params.capacity, len(files))
        colors = spark.createDataFrame([(i, dataset_name(f.path), f.path, f.bytes) for i, f in enumerate(files)], "color_id int, name string, path string, bytes long")
        # one file may be given several times, each time as a dataset of its own
        records = fasta.with_counts(fasta.read_fasta(spark, list({f.path: f for f in files}.values())), allow_in_id)
        ids = F.broadcast(colors.select("color_id", F.col("path").alias("_path")))  # a row for each input file
        named = records.join(ids, F.col("path") == F.col("_path")).select("color_id", "count", "seq")
        index = KmerIndex.from_unitigs(named.where(F.col("count").isNotNull()), colors, replace(params, capacity=capacity))
        index.records = named
        return index

    def skipped(self) -> DataFrame:
        """color_id, records, no_count, few, short, accepted: what became of each dataset's records; of an index just built from files."""
        if self.records is None:
            raise ValueError("only an index that was just built from files knows its records")
        return I.acceptance(self.records, self.params)

    def totals(self) -> DataFrame:
        """keys, dense, sparse, postings: one row."""
        return I.totals(self.postings, self.colors.count(), self.params.dense_missing)

    @staticmethod
    def build_manifest(spark: SparkSession, manifest: str, params: IndexParams, sort: bool = True, allow_in_id: bool = False) -> KmerIndex:
        return KmerIndex.build(spark, fasta.read_manifest(spark, manifest), params, sort, allow_in_id)

    # storage
    def save(self, path: str) -> KmerIndex:
        """Write to a folder that must not exist, and give the index that is read from there.

        A dense index keeps the keys of (almost) all datasets as arrays in dense/, and only the others in postings/.
        """
        all_keys, colors = self.postings, self._write_colors(path)
        p = self.params
        if p.dense:
            n = self.colors.count()
            self._write_part(all_keys, f"{path}/all", ["color_id"])
            all_keys = self.spark.read.schema(POSTINGS).parquet(f"{path}/all")
            self._write_part(I.dense_rows(all_keys, n, p.dense_missing), f"{path}/dense")
            all_keys = I.sparse_rows(all_keys, n, p.dense_missing)
        self._write_part(all_keys, f"{path}/postings", ["color_id"])
        if p.dense:
            fs, there = fasta.hadoop(self.spark, f"{path}/all")
            fs.delete(there, True)
        # the datasets' files as they are numbered here, to build the same index again
        paths = [r["path"] for r in self.colors.orderBy("color_id").collect() if r["path"]]
        if paths:
            fs, p_ = fasta.hadoop(self.spark, f"{path}/manifest.txt")
            out = fs.create(p_, True)
            out.write(bytearray(("\n".join(paths) + "\n").encode()))
            out.close()
        KmerIndex._write_meta(self.spark, path, {"params": p.to_json(), "colors": colors})
        return KmerIndex.open(self.spark, path)

    def _write_part(self, rows: DataFrame, path: str, also: list[str] = []) -> None:
        dealt = rows.repartition(self.params.partitions, "part").sortWithinPartitions("part", *I.KEY, *also)
        dealt.write.mode("errorifexists").partitionBy("part").option("compression", "zstd").parquet(path)

    def _write_colors(self, path: str) -> str:
        """Write the table of datasets under a new name, which is given back; it counts once meta.json names it."""
        name = f"colors-{uuid.uuid4().hex}"
        self.colors.coalesce(1).write.mode("errorifexists").parquet(f"{path}/{name}")
        return name

    @staticmethod
    def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
        """Written aside and put in place by one rename, so that readers see the old state or the new one."""
        fs, aside = fasta.hadoop(spark, f"{path}/.meta-{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        jvm = spark.sparkContext._jvm
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(aside, jvm.org.apache.hadoop.fs.Path(f"{path}/meta.json"), options)

    @staticmethod
    def _read_meta(spark: SparkSession, path: str) -> dict:
        fs, p = fasta.hadoop(spark, f"{path}/meta.json")
        stream = fs.open(p)
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    @staticmethod
    def open(spark: SparkSession, path: str) -> KmerIndex:
        meta = KmerIndex._read_meta(spark, path)
        params = IndexParams.from_json(meta["params"])
        dense = spark.read.schema(DENSE).parquet(f"{path}/dense") if params.dense else None
        colors = spark.read.schema(COLORS).parquet(f"{path}/{meta['colors']}")
        return KmerIndex(spark, params, spark.read.schema(POSTINGS).parquet(f"{path}/postings"), colors, path, dense)

    # catalog
    def infos(self) -> DataFrame:
        """color_id, name, kmer_count and the parameters, a row for each dataset."""
        p = self.params
        return self.colors.select("color_id", "name", "kmer_count", F.lit(p.k).alias("k"), F.lit(p.m).alias("m"), F.lit(p.findere_z).alias("findere_z"), F.lit(p.abundance_levels).alias("abundance_levels"), F.lit(p.abundance_min).alias("abundance_min"), F.lit(p.abundance_max).alias("abundance_max"), F.lit(p.canonical).alias("canonical"), F.lit(p.dense).alias("dense"), F.lit(p.sampling.kind).alias("sampling"), F.lit(p.capacity).alias("capacity"))

    def describe(self) -> str:
        p = self.params
        head = f"k={p.k} m={p.m} z={p.findere_z} levels={p.abundance_levels} min={p.abundance_min} max={p.abundance_max} canonical={p.canonical} dense={p.dense} sampling={p.sampling.kind}:{p.sampling.zero_bits} capacity={p.capacity}"
        return "\n".join([head, *(f"{r['name']}\t{r['kmer_count']}" for r in self.colors.orderBy("color_id").collect())])

    def report(self, built: KmerIndex) -> str:
        """Text: the totals of this index, and what was skipped of the records that it was built from."""
        t = self.totals().first()
        lines = [f"keys={t['keys']} dense={t['dense']} sparse={t['sparse']} postings={t['postings']}"]
        names = {r["color_id"]: r["name"] for r in self.colors.collect()}
        for r in built.skipped().orderBy("color_id").collect():
            lines.append(f"{names[r['color_id']]}\t" + " ".join(f"{c}={r[c]}" for c in ("records", "no_count", "few", "short", "accepted")))
        return "\n".join(lines)

    def rename(self, old: str, new: str) -> KmerIndex:
        """The first dataset called old is called new. LookupError if new is taken (which is looked at first) or old is missing."""
        names = [(r["color_id"], r["name"]) for r in self.colors.orderBy("color_id").collect()]
        if any(n == new for _, n in names):
            raise LookupError(f"{new} already appears in the list of indexed files")
        first = next((i for i, n in names if n == old), None)
        if first is None:
            raise LookupError(f"{old} was not found")
        colors = self.colors.withColumn("name", F.when(F.col("color_id") == first, F.lit(new)).otherwise(F.col("name")))
        renamed = KmerIndex(self.spark, self.params, self.sparse, colors, self.path, self.dense, self.unitigs)
        if self.path:
            meta = KmerIndex._read_meta(self.spark, self.path)
            KmerIndex._write_meta(self.spark, self.path, {**meta, "colors": renamed._write_colors(self.path)})
            fs, old_table = fasta.hadoop(self.spark, f"{self.path}/{meta['colors']}")
            fs.delete(old_table, True)
            return KmerIndex.open(self.spark, self.path)
        return renamed

    @staticmethod
    def merge(indexes: list[KmerIndex]) -> KmerIndex:
        """One index of all datasets in order; parameters are those of the first. Needs two at least, alike in what keys and levels
        mean, and not more datasets than the first's capacity (0: no bound)."""
        if len(indexes) < 2:
            raise ValueError("two indexes at least are needed to merge")
        first = indexes[0]
        if not all(first.params.can_merge(x.params) for x in indexes[1:]):
            raise ValueError("the indexes have different parameters")
        sizes = [x.names.count() for x in indexes]
        if first.params.capacity and sum(sizes) > first.params.capacity:
            raise ValueError(f"{sum(sizes)} datasets are more than the capacity of {first.params.capacity}")
        post = I.merge_postings([(x.postings, n) for x, n in zip(indexes, sizes, strict=True)])
        colors = names = None
        parts: I.Parts = []
        for x, at in zip(indexes, [sum(sizes[:i]) for i in range(len(sizes))], strict=True):
            moved, called = (df.withColumn("color_id", (F.col("color_id") + at).cast("int")) for df in (x.colors, x.names))
            colors = moved if colors is None else colors.unionByName(moved)
            names = called if names is None else names.unionByName(called)
            parts += [(u, offset + at) for u, offset in x.parts]
        merged = KmerIndex(first.spark, first.params, post.select("part", *I.KEY, "color_id", "level"), colors)
        merged.names, merged.parts = names, parts if all(x.parts for x in indexes) else []
        return merged

    @staticmethod
    def merge_manifest(spark: SparkSession, manifest: str) -> KmerIndex:
        return KmerIndex.merge([KmerIndex.open(spark, p) for p in fasta.read_manifest(spark, manifest)])

    # query
    def read_queries(self, path: str) -> DataFrame:
        """query_idx, id, description, seq of a FASTA file, numbered in order."""
        records = fasta.read_fasta(self.spark, fasta.inspect(self.spark, [path]), numbered=True)
        return records.select(F.col("record_idx").alias("query_idx"), "id", "description", "seq")

    def abundances(self, queries: DataFrame) -> DataFrame:
        """(query_idx, color_id, pos, ab) of each k-mer, in the datasets where the query has a hit, and in L.NOWHERE."""
        smers = L.query_smers(queries, self.params)
        if self.unitigs is not None:  # not saved: what is looked up is all that is indexed
            return L.kmer_abundances(smers, L.hits_in_records(smers, self.unitigs, self.params), self.params)
        return L.kmer_abundances(smers, L.hits(smers, self.sparse, self.params, self.dense), self.params)

    def query(self, queries: DataFrame, fmt: QueryFormat = QueryFormat()) -> DataFrame:
        """The answer as a table.

        median: query_idx, color_id, header, file, abundance. colored: query_idx, fasta. matrix-*: query_idx, query, and
        a column for each dataset, named by its id. Queries shorter than k get a slash in each cell of a matrix, and no line of the others.
        """
        fmt.check(self.params)
        ab = self.abundances(queries)
        counts, to = self.colors, fmt.normalize
        if fmt.kind == "median":
            cells = O.normalised(O.covered_medians(ab, fmt.coverage_min), counts, to)
            named = cells.join(self.colors.select("color_id", F.col("name").alias("file")), "color_id").join(queries.select("query_idx", full_header(F.col("id"), F.col("description")).alias("header")), "query_idx")
            return named.select("query_idx", "color_id", "header", "file", F.col("value").alias("abundance"))
        if fmt.kind == "colored":
            cells = L.everywhere(O.normalised(O.median_cells(ab), counts, to), counts, "value").where("value is not null")
            tag = F.concat(F.lit("col:"), F.col("color_id"), F.lit(":"), O.plain_number(F.col("value")))
            tags = cells.select("query_idx", "color_id", tag.alias("tag")).groupBy("query_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("color_id", "tag"))), lambda s: s["tag"]).alias("tags"))
            head = F.concat_ws(" ", full_header(F.col("id"), F.col("description")), F.array_join("tags", " "))
            return queries.join(tags, "query_idx").select("query_idx", F.concat(head, F.lit("\n"), F.upper("seq")).alias("fasta"))
        ids = [r["color_id"] for r in self.colors.select("color_id").orderBy("color_id").collect()]
        if fmt.kind == "matrix-raw":
            cells = O.changepoint_cells(ab, fmt.breakpoints) if fmt.breakpoints is not None else O.run_length_cells(ab, counts, to)
        else:
            cells = O.normalised(O.median_cells(ab) if fmt.kind == "matrix-median" else O.mean_cells(ab), counts, to)
            cells = cells.select(*O.CELL, O.plain_number(F.col("value")).alias("cell"))
        # one column more: what stands in the cells of datasets without a hit
        wide = O.pivot_cells(cells, queries, [L.NOWHERE, *ids], "cell", F.lit(None).cast("string"))
        return wide.select("query_idx", "query", *[F.coalesce(F.col(str(c)), F.col(str(L.NOWHERE)), F.lit(O.NOT_QUERIED)).alias(str(c)) for c in ids])

    def lines(self, queries: DataFrame, fmt: QueryFormat = QueryFormat()) -> DataFrame:
        """The answer as lines of text (value), in order."""
        found = self.query(queries, fmt)
        if fmt.kind == "median":
            return sinks.as_lines(found.withColumn("abundance", O.plain_number(F.col("abundance"))), ",", ["header", "file", "abundance"])
        if fmt.kind == "colored":
            return sinks.as_lines(found, "\t")
        names = [r["name"] for r in self.colors.select("color_id", "name").orderBy("color_id").collect()]
        return sinks.as_lines(found, "\t", ["query", *names])
