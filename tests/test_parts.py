"""Quantiser, sequences, headers, formats against values and brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kabund.functions import sequences as S
from kabund.operators import formats as O
from kabund.operators import index as I
from kabund.operators import lookup as L
from kabund.params import IndexParams, Quantiser, QueryFormat, Sampling, capacity_for, false_positive_rate, number_of_partitions, solve_base
from kabund.sources import fasta, sinks


def test_base_and_levels():
    assert solve_base(16, 1024) == pytest.approx(1.5635206, abs=1e-6)
    assert solve_base(32, 1024) == pytest.approx(1.218096, abs=1e-6)
    assert solve_base(8, 1024) == pytest.approx(2.740397, abs=1e-6)
    back = lambda q, *vs: [q.decode(q.encode(v)) for v in vs]
    assert back(Quantiser(255, 65024), 30, 50, 100, 250, 1000, 1500, 4, 65535) == [29, 48, 99, 249, 976, 1470, 4, 65023]
    assert back(Quantiser(256, 65535), 1000) == [997]
    assert back(Quantiser(255, 65535), 1000, 1500, 60000) == [979, 1476, 59149]
    assert back(Quantiser(255, 255), *range(1, 256), 1500) == [*range(1, 256), 255]


def test_levels_as_columns(spark):
    q = Quantiser(255, 65024)
    values = [1, 2, 28, 29, 30, 31, 100, 1000, 65023, 65024, 65535]
    df = spark.createDataFrame([(v,) for v in values], "v int").withColumn("l", S.encode_level(F.col("v"), q))
    got = df.select("v", "l", S.decode_level(F.col("l"), q).alias("d")).collect()
    assert [(r["l"], r["d"]) for r in got] == [(q.encode(v), q.decode(q.encode(v))) for v in values]


def test_sizes():
    assert number_of_partitions(255, 2, 32) == 510 and capacity_for(3, 5) == 5 and capacity_for(9, 5) == 9
    assert round(100 * false_positive_rate(1_000_000_000, 32), 2) == 20.77


@pytest.mark.parametrize("bad", [dict(k=0), dict(k=5, findere_z=5), dict(k=31, findere_z=2, sampling=Sampling("kmer", 1)), dict(k=33, dense=True), dict(k=5, abundance_max=70000)])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        IndexParams(**bad)


def test_formats_that_exclude_each_other():
    for bad in (dict(kind="median", breakpoints=1.0), dict(kind="matrix-raw", breakpoints=1.0, normalize=5), dict(kind="x"), dict(normalize=0)):
        with pytest.raises(ValueError):
            QueryFormat(**bad)
    with pytest.raises(ValueError):
        Sampling("none-such", 1)


def canon(x):
    rc = x[::-1].translate(str.maketrans("ACGTN", "TGCAT"))
    return x if x.replace("N", "A") <= rc else rc


def test_smers_and_minimizers(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGTN" if i == 2 else "ACGT") for _ in range(n)) for i, n in enumerate((0, 10, 700, 11, 256 + 10, 257 + 10, 1500))]
    df = spark.createDataFrame(list(enumerate(seqs)), "n int, seq string")
    got = {(r["n"], r["pos"]): r["smer"] for r in S.explode_smers(df, 11).collect()}
    assert got == {(n, i): canon(s[i : i + 11]) for n, s in enumerate(seqs) for i in range(len(s) - 10)}
    plain = {(r["n"], r["pos"]): r["smer"] for r in S.explode_smers(df, 11, False).collect()}
    assert plain == {(n, i): s[i : i + 11] for n, s in enumerate(seqs) for i in range(len(s) - 10)}
    import hashlib

    h = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    mini = {(r["n"], r["pos"]): r["mini"] for r in S.explode_minimizers(df, 11, 5).collect()}
    assert mini == {(n, i): min(h(canon(s[j : j + 5])) for j in range(i, i + 7)) for n, s in enumerate(seqs) for i in range(len(s) - 10)}


@pytest.mark.parametrize("size", [1, 2, 5, 16, 31, 32, 40])
def test_keys_of_any_letters_and_lengths(spark, size):
    """Slices, long s-mers, N and other letters, empty and null sequences."""
    rng = random.Random(size)
    seqs = ["", None, "A" * (size - 1), "".join(rng.choice("ACGT") for _ in range(3000)), "".join(rng.choice("ACGTNRY*") for _ in range(400)), "ACGTN" * 20]
    df = spark.createDataFrame(list(enumerate(seqs)), "n int, seq string").repartition(2)

    def key(x):
        rc = x[::-1].translate({**{i: 0 for i in range(128)}, **{ord(a): ord(b) for a, b in zip("ACGTN", "TGCAT")}})
        return x if x.replace("N", "A") <= rc else rc

    old, S.packed.SLICE = S.packed.SLICE, 700
    try:
        for free in (True, False):
            got = {(r["n"], r["pos"]): r["smer"] for r in S.explode_smers(df, size, free).collect()}
            assert got == {(n, i): key(s[i : i + size]) if free else s[i : i + size] for n, s in enumerate(seqs) if s for i in range(len(s) - size + 1)}
    finally:
        S.packed.SLICE = old
    codes = [r for r in S.explode_keys(df.where("n = 3"), size).collect()]
    assert all((r["code"] == -1) == (size > 31) == (r["odd"] != "") for r in codes)


def test_both_strands_hash_alike_and_sampling_rates(spark):
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(60_000))
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame([(0, seq), (1, back)], "n int, seq string")
    e = S.explode_minimizers(df, 31, 15).withColumn("h", S.xxh3_hash(F.col("smer")))
    k = S.sampled(Sampling("kmer", 2), F.col("h"), None).cast("int")
    m = S.sampled(Sampling("minimizer", 2), None, F.col("mini")).cast("int")
    a, b = e.groupBy("n").agg(F.count("*").alias("n1"), F.sum(k).alias("k"), F.sum(m).alias("m"), F.sum(F.col("h") % 1000).alias("s")).orderBy("n").collect()
    assert a[1:] == b[1:] and abs(a["k"] / a["n1"] - 0.25) < 0.0125 and abs(a["m"] / a["n1"] - 0.25) < 0.05
    one = e.where("n = 0 and pos = 0").first()
    want = xxhash.xxh3_64_intdigest(one["smer"])
    assert one["h"] % (1 << 64) == want


def test_headers(spark):
    rows = [("0 km:f:12.4 L:+:5:+", 12), ("0 ka:f:7.8 L:+:5392806:+", 7), ("0 ka:f:65537 x", 65535), ("0 ka:f:X ...", None), ("0 other:f:10.0", None), ("0 ka:f:-3", 0), ("ka:f:4.9", 4), ("0 ka:f:NaN", 0), ("0 xka:f:5", None)]
    df = spark.createDataFrame([(h,) for h, _ in rows], "h string")
    got = [r[0] for r in df.select(fasta.header_count(F.col("h"), fasta.dialect(F.col("h")))).collect()]
    assert got == [c for _, c in rows]


def test_first_record_decides_the_dialect(spark):
    rows = [("f", 0, "a", "ka:f:3"), ("f", 1, "b", "km:f:9"), ("f", 2, "ka:f:8", "none"), ("g", 0, "ka:f:5", None), ("g", 1, "ka:f:6", None), ("h", 0, "x", "y"), ("h", 1, "x", "ka:f:2")]
    df = spark.createDataFrame(rows, "path string, record_idx long, id string, description string").withColumn("seq", F.lit("A"))
    got = {(r["path"], r["record_idx"]): r["count"] for r in fasta.with_counts(df).collect()}
    assert got == {("f", 0): 3, ("f", 1): None, ("f", 2): None, ("g", 0): 5, ("g", 1): 6, ("h", 0): None, ("h", 1): None}
    strict = {(r["path"], r["record_idx"]): r["count"] for r in fasta.with_counts(df, allow_in_id=False).collect()}
    assert strict["g", 0] is None and strict["f", 0] == 3


def cells(spark, *arrays):
    return spark.createDataFrame([(0, c, i, v) for c, a in enumerate(arrays) for i, v in enumerate(a)], "query_idx long, color_id int, pos int, ab int")


def test_cells(spark):
    ab = cells(spark, [3, 3, 4, 5, 1, 1, 1, 8, 7, 7, 7, 7], list(range(100)), [None, None, 0, 0, 5], [None])
    rle = {r["color_id"]: r["cell"] for r in O.run_length_cells(ab).collect()}
    assert rle[0] == "0-1:3,2:4,3:5,4-6:1,7:8,8-11:7" and rle[2] == "0-1:/,2-3:*,4:5" and rle[3] == "0:/"
    assert {r["color_id"]: r["value"] for r in O.mean_cells(ab).collect()}[1] == 49.5
    assert {r["color_id"]: r["value"] for r in O.median_cells(ab).collect()} == {0: 4.5, 1: 49.5, 2: 0.0, 3: None}
    counts = spark.createDataFrame([(0, 10)], "color_id int, kmer_count long")
    assert O.normalised(O.mean_cells(cells(spark, [1, 2, 1])), counts, 100).first()["value"] == 13.333333333333334


def test_covered_medians(spark):
    ab = cells(spark, [0, 0, 4, 4], [0, 4, 4, 6], [None, 0, 4, 4], [0, 0, 0, 0])
    assert {r["color_id"]: r["value"] for r in O.covered_medians(ab, 0.5).collect()} == {1: 4.0, 2: 4.0}


def test_changepoints_are_best():
    assert O.changepoints(np.array([0] * 4 + [4] * 4 + [80] * 3 + [0] * 3), 1.0) == [0, 4, 8, 11]

    def cost(x, cuts, penalty):
        e = [*cuts, len(x)]
        return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(e, e[1:])) + penalty * (len(cuts) - 1)

    rng = np.random.default_rng(1)
    for _ in range(40):
        x = rng.integers(0, 6, rng.integers(1, 9)).astype(float)
        p = float(rng.choice([0.3, 1.0, 4.0]))
        best = min(cost(x, [0, *c], p) for n in range(len(x)) for c in combinations(range(1, len(x)), n))
        assert cost(x, O.changepoints(x, p), p) == pytest.approx(best)
    assert O.changepoints(np.array([]), 1.0) == []


def test_rolling_minimum_is_that_of_slices(spark):
    rng = random.Random(3)
    arrays = [[rng.choice([None, 0, 1, 5, 9]) for _ in range(n)] for n in (1, 3, 5, 6, 40)]
    for z in (0, 1, 4):
        got = {(r["color_id"], r["pos"]): r["ab"] for r in L.rolling_minimum(cells(spark, *arrays), z).collect()}
        want = {(c, i): min((v for v in a[i : i + z + 1] if v is not None), default=None) for c, a in enumerate(arrays) for i in range(len(a) - z)}
        assert got == want


def test_postings_against_brute_force(spark):
    rng = random.Random(5)
    p = IndexParams(k=7, findere_z=2, abundance_min=3, partitions=3)
    rows = [(rng.randrange(3), rng.randrange(0, 300), "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 60)))) for _ in range(60)]
    u = spark.createDataFrame(rows, "color_id int, count int, seq string")
    want: dict = {}
    totals: dict = {}
    for c, n, s in rows:
        if n > 3 and len(s) >= 5:
            totals[c] = totals.get(c, 0) + n * max(0, len(s) - 6)
            for i in range(len(s) - 4):
                key = (canon(s[i : i + 5]), c)
                want[key] = max(want.get(key, -1), p.quantiser.encode(n))
    assert {(r["smer"], r["color_id"]): r["level"] for r in I.with_text(I.postings(u, p), p).collect()} == want
    some = I.postings(u, p).select("code", "odd").distinct().where("code % 3 = 0")
    assert I.postings(u, p, only=some).count() == I.postings(u, p).where("code % 3 = 0").count() > 0
    assert {r["color_id"]: r["kmer_count"] for r in I.kmer_counts(u, p).collect()} == totals


def test_numbers_and_names(spark):
    df = spark.createDataFrame([(99.0,), (75.125,), (float("nan"),), (1e-7,), (1.5e15,)], "x double")
    assert [r[0] for r in df.select(S.plain_number(F.col("x"))).collect()] == ["99", "75.125", "NaN", "0.0000001", "1500000000000000"]
    names = spark.createDataFrame([("/a/b.fa.gz",), ("c",), ("/d/.hidden.fa",)], "p string")
    assert [r[0] for r in names.select(S.file_prefix(F.col("p"))).collect()] == ["b", "c", ".hidden"]
    assert sinks.default_output("ix/", "matrix-raw") == "ix_query_results.tsv"


def test_command_line(spark, tmp_path):
    from kabund.cli import main

    (tmp_path / "a.fa").write_text(">1 ka:f:30\nACGTACGATCGATCGACTAGCTACGATCGACTGATCGAT\n")
    (tmp_path / "q.fa").write_text(">q\nACGTACGATCGATCGACTAGCTACGATCGACTGATCGAT\n")
    (tmp_path / "fof.txt").write_text(f"{tmp_path}/a.fa\n\n")
    ix = str(tmp_path / "ix")
    assert main(["index", str(tmp_path / "fof.txt"), "-k", "31", "-o", ix, "--partitions", "2"]) == 0
    assert main(["query", ix, str(tmp_path / "q.fa"), "-o", str(tmp_path / "out")]) == 0
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()][-1] == ">q,a,29"
    assert main(["rename", ix, "nothing", "b"]) == 1 and main(["rename", ix, "a", "b"]) == 0 and main(["infos", ix]) == 0
