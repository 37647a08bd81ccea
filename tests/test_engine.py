"""End to end: files to index to answers, with the fixture's values."""

import gzip
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from kabund.params import IndexParams, QueryFormat, Sampling
from kabund.plans.engine import KmerIndex, dataset_name

S1 = "AACTTATACATTAGTCACCCAGGAATGCTACCTGAGAAGCGGCTGGCTAT"
S2 = "AGGAATGCTACCTGAGAAGCGGCTGGCTATAAGTGTCCCTGCCTTTCCGTCGGACAAAAATTTGGACAATTGGTTGACGA"
S3 = "CGGACAAAAATTTGGACAATTGGTTGACGACTATATTGAT"
A = f"> start ka:f:50\n{S1}\n> end ka:f:100\n{S2}\n> end ka:f:10\n{S3}\n"
B = f"> start ka:f:50\n{S1}\n> end ka:f:100\n{S2}\n"
ALL = "AACTTATACATTAGTCACCCAGGAATGCTACCTGAGAAGCGGCTGGCTATAAGTGTCCCTGCCTTTCCGTCGGACAAAAATTTGGACAATTGGTTGACGACTATATTGAT"
Q = f">all_present_with_variations\n{ALL}\n>single_present_kmer\n{ALL[:31]}\n>present_kmers_then_nothing\n{ALL[:38]}{'A' * 19}\n"
QUERY = Q.replace(f"{ALL[:38]}{'A' * 19}", "AACTTATACATTAGTCACCCAGGAATGCTACCTGAGAAAAAAAAAAAAAAAAAAAA")


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("fasta")
    (d / "datasetA.fa").write_text(A)
    (d / "datasetB.fa").write_text(B)
    (d / "query.fa").write_text(QUERY)
    return d


@pytest.fixture(scope="module")
def index(spark, files):
    return KmerIndex.build(spark, [str(files / "datasetA.fa"), str(files / "datasetB.fa")], IndexParams(k=31, partitions=4), sort=False).save(str(files / "index"))


def matrix(index, queries, **fmt):
    return [tuple(r)[1:] for r in index.query(queries, QueryFormat(**fmt)).orderBy("query_idx").collect()]


def test_raw_matrix(index, files):
    q = index.read_queries(str(files / "query.fa"))
    assert matrix(index, q, kind="matrix-raw") == [
        ("all_present_with_variations", "0-19:48,20-69:99,70-79:10", "0-19:48,20-69:99,70-79:*"),
        ("single_present_kmer", "0:48", "0:48"),
        ("present_kmers_then_nothing", "0-7:48,8-25:*", "0-7:48,8-25:*"),
    ]


def test_means_and_medians(index, files):
    q = index.read_queries(str(files / "query.fa"))
    assert [r[1:] for r in matrix(index, q, kind="matrix-average")] == [("75.125", "73.875"), ("48", "48"), ("14.76923076923077", "14.76923076923077")]
    assert [r[1:] for r in matrix(index, q, kind="matrix-median")] == [("99", "99"), ("48", "48"), ("0", "0")]


def test_covered_medians_drop_the_mostly_absent(index, files):
    q = index.read_queries(str(files / "query.fa"))
    lines = [r["value"] for r in index.lines(q).collect()]
    assert lines == ["header,file,abundance", ">all_present_with_variations,datasetA,99", ">all_present_with_variations,datasetB,99", ">single_present_kmer,datasetA,48", ">single_present_kmer,datasetB,48"]


def test_colored(index, files):
    q = index.read_queries(str(files / "query.fa"))
    got = [r["fasta"].split("\n")[0] for r in index.query(q, QueryFormat(kind="colored")).orderBy("query_idx").collect()]
    assert got == [">all_present_with_variations col:0:99 col:1:99", ">single_present_kmer col:0:48 col:1:48", ">present_kmers_then_nothing col:0:0 col:1:0"]


def test_breakpoints(index, files):
    q = index.read_queries(str(files / "query.fa"))
    assert [r[1:] for r in matrix(index, q, kind="matrix-raw", breakpoints=0.3)] == [("0,20,70", "0,20,70"), ("0", "0"), ("0,8", "0,8")]


def test_size_order_decides_the_columns(spark, files):
    index = KmerIndex.build(spark, [str(files / "datasetA.fa"), str(files / "datasetB.fa")], IndexParams(k=31, partitions=4))
    assert [r["name"] for r in index.colors.orderBy("color_id").collect()] == ["datasetB", "datasetA"]


def test_counts_and_normalisation(index, files):
    assert [tuple(r) for r in index.infos().select("name", "kmer_count").orderBy("color_id").collect()] == [("datasetA", 6100), ("datasetB", 6000)]
    q = index.read_queries(str(files / "query.fa"))
    got = matrix(index, q, kind="matrix-average", normalize=1_000_000)
    assert float(got[0][1]) == pytest.approx(75.125 / 6100 * 1e6) and float(got[1][2]) == pytest.approx(48 / 6000 * 1e6)
    assert matrix(index, q, kind="matrix-raw", normalize=6000)[1][2] == "0:48"


def test_merge_is_one_build(spark, index, files):
    one = [KmerIndex.build(spark, [str(files / f"dataset{x}.fa")], IndexParams(k=31, partitions=4, capacity=2)) for x in "AB"]
    q = index.read_queries(str(files / "query.fa"))
    both = KmerIndex.merge(one)
    assert matrix(both, q, kind="matrix-raw") == matrix(index, q, kind="matrix-raw")
    assert matrix(both, q, kind="matrix-average", normalize=1000) == matrix(index, q, kind="matrix-average", normalize=1000)
    with pytest.raises(ValueError):
        KmerIndex.merge(one[:1])
    with pytest.raises(ValueError):
        KmerIndex.merge([one[0], KmerIndex.build(spark, [str(files / "datasetB.fa")], IndexParams(k=31, findere_z=2))])
    with pytest.raises(ValueError):
        KmerIndex.merge([*one, one[0]])


def test_rename(spark, files, tmp_path):
    index = KmerIndex.build(spark, [str(files / "datasetB.fa"), str(files / "datasetA.fa")], IndexParams(k=31, partitions=2), sort=False).save(str(tmp_path / "i"))
    renamed = index.rename("datasetA", "datasetC")
    assert [r["name"] for r in KmerIndex.open(spark, str(tmp_path / "i")).colors.orderBy("color_id").collect()] == ["datasetB", "datasetC"]
    with pytest.raises(LookupError, match="datasetB already appears in the list of indexed files"):
        renamed.rename("missing", "datasetB")
    with pytest.raises(LookupError, match="missing was not found"):
        renamed.rename("missing", "new")


def test_strands(spark, tmp_path):
    rng = random.Random(4)
    seq = "".join(rng.choice("ACGT") for _ in range(50))
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    (tmp_path / "r.fa").write_text(f">x ka:f:3\n{back.lower()}\n")
    q = spark.createDataFrame([(0, "q", None, seq)], "query_idx long, id string, description string, seq string")
    for z in (0, 2, 4, 6, 8, 10):
        free = KmerIndex.build(spark, [str(tmp_path / "r.fa")], IndexParams(k=31, findere_z=z))
        assert matrix(free, q, kind="matrix-raw") == [("q", "0-19:3")]
    stranded = KmerIndex.build(spark, [str(tmp_path / "r.fa")], IndexParams(k=31, canonical=False))
    assert matrix(stranded, q, kind="matrix-raw") == [("q", "0-19:*")]


def test_sampling_keeps_places(spark, files):
    index = KmerIndex.build(spark, [str(files / "datasetA.fa"), str(files / "datasetB.fa")], IndexParams(k=31, sampling=Sampling("kmer", 1)), sort=False)
    q = index.read_queries(str(files / "query.fa"))
    ab = index.abundances(q).where("query_idx = 0 and color_id = 0").orderBy("pos").collect()
    assert len(ab) == 80 and {r["ab"] for r in ab} == {None, 48, 99, 10}
    cells = matrix(index, q, kind="matrix-raw")
    assert "/" in cells[0][1] and set(cells[1][1:]) <= {"0:48", "0:/"}
    with pytest.raises(ValueError):
        index.query(q, QueryFormat(kind="matrix-raw", breakpoints=1.0))
    mini = KmerIndex.build(spark, [str(files / "datasetA.fa")], IndexParams(k=31, m=11, sampling=Sampling("minimizer", 1)))
    got = {r["ab"] for r in mini.abundances(q).where("query_idx = 0").collect()}
    assert None in got and got & {48, 99}


def test_compressed_files_are_known_by_name_or_content(spark, files, tmp_path):
    (tmp_path / "a.fa.gz").write_bytes(gzip.compress(A.encode()))
    (tmp_path / "b.fa").write_bytes(gzip.compress(A.encode()))
    (tmp_path / "c.fa").write_bytes(zstandard.compress(A.encode()))
    (tmp_path / "d.fa").write_text(A.replace("\n", "\r\n").replace("GGCTAT\r\n", "GG\r\nCTAT\r\n"))
    paths = [str(tmp_path / n) for n in ("a.fa.gz", "b.fa", "c.fa", "d.fa", "missing.fa")]
    index = KmerIndex.build(spark, paths, IndexParams(k=31), sort=False)
    assert [r["kmer_count"] for r in index.colors.orderBy("color_id").collect()] == [6100, 6100, 6100, 6100, 0]
    sizes = KmerIndex.build(spark, paths, IndexParams(k=31))
    assert [r["name"] for r in sizes.colors.orderBy("color_id").collect()][-1] == "missing"


def test_repeated_ids_and_short_queries(spark, index):
    q = spark.createDataFrame([(0, "same", None, ALL[:31]), (1, "same", None, ALL[1:32]), (2, "short", "x", "ACGT")], "query_idx long, id string, description string, seq string")
    assert matrix(index, q, kind="matrix-raw") == [("same", "0:48", "0:48"), ("same", "0:48", "0:48"), ("short", "/", "/")]
    assert matrix(index, q, kind="matrix-median")[2] == ("short", "/", "/")
    assert {r["query_idx"] for r in index.query(q).collect()} == {0, 1}


def test_dense_rows(spark, files, index, tmp_path):
    from kabund.operators import index as I

    split = {r["dense"]: r["count"] for r in I.dense_split(index.postings, 2).groupBy("dense").count().collect()}
    dense = I.dense_rows(index.postings, 2)
    assert split[True] == dense.count() and split[False] > 0
    both = I.from_dense(dense).join(index.postings, ["part", "code", "odd", "color_id", "level"], "left_anti")
    assert both.count() == 0
    made = KmerIndex.build(spark, [str(files / "datasetA.fa"), str(files / "datasetB.fa")], IndexParams(k=31, dense=True, partitions=2), sort=False).save(str(tmp_path / "d"))
    assert made.dense.count() == dense.count() and made.sparse.count() == index.postings.count() - 2 * dense.count()
    q = made.read_queries(str(files / "query.fa"))
    for kind in ("matrix-raw", "matrix-average"):  # looked for in dense/ first, then in postings/
        assert matrix(made, q, kind=kind) == matrix(index, q, kind=kind)
    t = made.totals().first()
    assert (t["keys"], t["dense"], t["sparse"]) == (split[True] + split[False], split[True], split[False])


def test_reports_and_the_copy_of_the_manifest(spark, files, tmp_path):
    (tmp_path / "odd.fa").write_text(f">a ka:f:5\n{ALL}\n>b nothing\n{ALL}\n>c ka:f:0\n{ALL}\n>d ka:f:9\nACGT\n")
    built = KmerIndex.build(spark, [str(tmp_path / "odd.fa"), str(tmp_path / "missing.fa")], IndexParams(k=31, partitions=2), sort=False)
    assert [tuple(r) for r in built.skipped().collect()] == [(0, 4, 1, 1, 1, 1)]
    saved = built.save(str(tmp_path / "i"))
    assert "odd\trecords=4 no_count=1 few=1 short=1 accepted=1" in saved.report(built)
    assert (tmp_path / "i" / "manifest.txt").read_text() == f"{tmp_path}/odd.fa\n{tmp_path}/missing.fa\n"
    with pytest.raises(ValueError):
        saved.skipped()


def test_abundances_right_behind_the_bracket_need_leave(spark, tmp_path):
    (tmp_path / "x.fa").write_text(f">ka:f:7\n{ALL}\n")
    kmers = lambda **a: KmerIndex.build(spark, [str(tmp_path / "x.fa")], IndexParams(k=31), **a).colors.first()["kmer_count"]
    assert kmers() == 0 and kmers(allow_in_id=True) == 7 * 80


def test_sketch_keeps_the_greatest_level(spark, index):
    from dataclasses import replace

    from kabund.operators import index as I

    wide = I.sketch(index.postings, replace(index.params, bloom_bits_log2=32))
    tiny = I.sketch(index.postings, replace(index.params, bloom_bits_log2=4))
    assert wide.count() == index.postings.count() and tiny.count() <= 32
    top = index.postings.groupBy("color_id").agg(F.max("level").alias("m")).collect()
    assert {(r["color_id"], r["m"]) for r in top} == {(r["color_id"], r["m"]) for r in tiny.groupBy("color_id").agg(F.max("level").alias("m")).collect()}
    s = I.statistics(tiny).first()
    assert s["ones"] + s["silent"] == index.postings.count()


def test_names():
    assert [dataset_name(x) for x in ("/a/b.fa.gz", "c", "/d/.hidden.fa", "x/y.z")] == ["b", "c", ".hidden", "y"]


def test_streamed_files_make_one_index(spark, files, index, tmp_path):
    from kabund.streaming.ingest import all_parts, watch

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "datasetA.fa").write_text(A)
    args = (str(folder), str(tmp_path / "ix"), IndexParams(k=31, partitions=2), str(tmp_path / "cp"))
    watch(spark, *args).awaitTermination()
    (folder / "datasetB.fa").write_text(B)
    watch(spark, *args).awaitTermination()
    q = index.read_queries(str(files / "query.fa"))
    assert matrix(all_parts(spark, str(tmp_path / "ix")), q, kind="matrix-raw") == matrix(index, q, kind="matrix-raw")
