"""Command line: index, query, merge, infos, rename."""

from __future__ import annotations

import argparse
import sys

from kabund.params import NORMALIZE_TO, IndexParams, QueryFormat, Sampling


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kabund", description="k-mer abundance indexes on Spark")
    sub = top.add_subparsers(dest="command", required=True)
    b = sub.add_parser("index", aliases=["build"], help="index the FASTA files of a manifest")
    b.add_argument("manifest")
    b.add_argument("-o", "--output", default=None, help="by default the manifest's name with _index")
    b.add_argument("--allow-count-right-after-angle-bracket", action="store_true", help="take >ka:f:3 as an abundance")
    b.add_argument("--report", action="store_true", help="print what was skipped and how many keys there are; reads the input again")
    b.add_argument("-k", type=int, required=True)
    b.add_argument("-m", "--minimizer", type=int, default=15)
    b.add_argument("-z", "--findere", type=int, default=None)
    b.add_argument("-b", "--bloom", type=int, default=32)
    b.add_argument("-a", "--abundance", type=int, default=255, help="number of levels")
    b.add_argument("--abundance-min", type=int, default=0)
    b.add_argument("--abundance-max", type=int, default=65024)
    b.add_argument("--chunk-size", type=int, default=128)
    b.add_argument("--capacity", type=int, default=0)
    b.add_argument("--partitions", type=int, default=64)
    b.add_argument("--dense", action="store_true")
    b.add_argument("--stranded", action="store_true")
    b.add_argument("--no-sort", action="store_true", help="number the datasets as listed, not by size")
    b.add_argument("--kmer-sampling", type=int, default=None, help="low bits of a k-mer's hash that must be zero")
    b.add_argument("--minimizer-sampling", type=int, default=None)
    q = sub.add_parser("query", help="look the sequences of a FASTA file up")
    q.add_argument("index")
    q.add_argument("fasta")
    q.add_argument("-f", "--format", default="median", choices=["median", "colored", "matrix-raw", "matrix-median", "matrix-average"])
    q.add_argument("-o", "--output", default=None)
    q.add_argument("-n", "--normalize", type=int, nargs="?", const=NORMALIZE_TO, default=None)
    q.add_argument("-C", "--coverage-min", type=float, default=0.5)
    q.add_argument("--breakpoints", type=float, default=None)
    m = sub.add_parser("merge", help="merge the indexes of a manifest")
    m.add_argument("manifest")
    m.add_argument("-o", "--output", required=True)
    i = sub.add_parser("infos", help="show an index")
    i.add_argument("index")
    r = sub.add_parser("rename", help="rename a dataset")
    r.add_argument("index")
    r.add_argument("old")
    r.add_argument("new")
    return top


def sampling_of(kmer: int | None, minimizer: int | None) -> Sampling:
    if kmer is not None and minimizer is not None:
        raise ValueError("k-mer and minimizer sampling exclude each other")
    if kmer is not None:
        return Sampling("kmer", kmer)
    return Sampling("minimizer", minimizer) if minimizer is not None else Sampling()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from kabund.plans.engine import KmerIndex
    from kabund.sources.sinks import default_index, default_output, write_lines

    spark = SparkSession.builder.appName("kabund").getOrCreate()
    try:
        if a.command in ("index", "build"):
            params = IndexParams(k=a.k, m=a.minimizer, findere_z=a.findere, bloom_bits_log2=a.bloom, abundance_levels=a.abundance, abundance_min=a.abundance_min, abundance_max=a.abundance_max, chunk_size=a.chunk_size, dense=a.dense, canonical=not a.stranded, sampling=sampling_of(a.kmer_sampling, a.minimizer_sampling), capacity=a.capacity, partitions=a.partitions)
            index = KmerIndex.build_manifest(spark, a.manifest, params, sort=not a.no_sort, allow_in_id=a.allow_count_right_after_angle_bracket)
            saved = index.save(a.output or default_index(a.manifest))
            if a.report:
                print(saved.report(index))
        elif a.command == "query":
            index = KmerIndex.open(spark, a.index)
            fmt = QueryFormat(a.format, a.normalize, a.coverage_min, a.breakpoints)
            write_lines(index.lines(index.read_queries(a.fasta), fmt), a.output or default_output(a.index, a.format))
        elif a.command == "merge":
            KmerIndex.merge_manifest(spark, a.manifest).save(a.output)
        elif a.command == "infos":
            print(KmerIndex.open(spark, a.index).describe())
        else:
            KmerIndex.open(spark, a.index).rename(a.old, a.new)
            print(f"{a.old} was renamed to {a.new}")
    except (ValueError, LookupError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
