"""SimHash components, fingerprints, line dedup against brute force; odd rows."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kabund.llm import doc_fingerprints as D
from kabund.llm import line_dedup as LD
from kabund.llm import simhash_dedup as SD
from kabund.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return "0" * 16
    sh = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"


def test_fingerprint_of_the_contract():
    rng = random.Random(1)
    texts = ["", " \n", "one", "Two Words", "İstanbul ÄÖ a\x0bb\x0cc\x1cd e"] + [" ".join(rng.choice(["The", "cat", "sat", "é"]) for _ in range(n)) for n in (3, 4, 300)]
    assert [SD.fingerprint(t, SD.EXACT_2) for t in texts] == [plain_fingerprint(t) for t in texts]
    long = " ".join(f"w{i}" for i in range(SD.CHUNK + 500))
    assert SD.fingerprint(long, SD.EXACT_2) == plain_fingerprint(long)


def test_trees_find_all_within_the_radius():
    rng = random.Random(2)
    values = list({rng.getrandbits(12) for _ in range(300)})
    tree = SD.BKTree()
    for i, v in enumerate(values):
        tree.add(v, i)
    for r in (0, 1, 3, 12):
        for q in values[:40] + [rng.getrandbits(12) for _ in range(20)]:
            assert sorted(tree.within(q, r)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= r]
    assert SD.BKTree().within(5, 3) == []


def flipped(rng, v, n):
    for b in rng.sample(range(64), n):
        v ^= 1 << b
    return v


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_components_are_those_of_all_pairs(spark, shard_rows):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(120):  # chains and groups
        fps.append(flipped(rng, rng.choice(fps), rng.randint(1, 4)))
    fps = list(dict.fromkeys(fps))
    p = SD.SimHashParams(tables=SD.pigeonhole_tables(64, 2), shard_rows=shard_rows)
    rows = spark.createDataFrame([(f"{v:016x}", i) for i, v in enumerate(fps)], "fp string, rep long")
    got = {r["node"]: r["component"] for r in connected_components(SD.links(rows, p)).collect()}
    low = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    assert all(got.get(i, i) == low[i] for i in range(len(fps)))
    assert set(got) == {i for i in range(len(fps)) if low.count(low[i]) > 1}


def test_components_of_chains_and_empty_tables(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5), (None, 3)] + [(2000, 2000 + i) for i in range(1, 100)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1001] == 1000 and all(got[2000 + i] == 2000 for i in range(100))
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_of_odd_rows(spark, odd, clashing, none):
    got = SD.simhash_components(clashing).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert {r["component_id"] for i in (0, 1, 2) for r in by[i]} == {0} and by[0][0]["fingerprint"] == "0" * 16
    assert [r["component_id"] for r in by[4]] == [4, 4]
    assert SD.simhash_components(none).count() == 0
    kept = SD.keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect())
    assert ids == [-1, -1, 0, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    assert SD.keep_one(none).count() == 0


def at_distance(spark, monkeypatch, fps):
    """simhash_components of rows (doc_id, fingerprint) with given fingerprints."""
    rows = spark.createDataFrame(fps, "doc_id long, fingerprint string")
    monkeypatch.setattr(SD, "fingerprints", lambda *_: rows)
    return sorted((r["fingerprint"], str(r["doc_id"]), r["component_id"]) for r in SD.simhash_components(rows).collect())


def test_fingerprints_are_linked_whatever_ids_they_have(spark, monkeypatch):
    x = lambda v: f"{v:016x}"
    # a chain over a fingerprint that only a row without an id has; no link between unlike fingerprints of one id
    rows = [(9, x(0)), (None, x(3)), (4, x(15)), (5, x(0xABCDEF << 24)), (5, x(0xFF << 50)), (7, x(0xFF << 50 | 1)), (3, x(0xABCDEF << 24 | 1)), (None, x(0xF0F0 << 20))]
    want = {x(0): 4, x(3): 4, x(15): 4, x(0xABCDEF << 24): 3, x(0xABCDEF << 24 | 1): 3, x(0xFF << 50): 5, x(0xFF << 50 | 1): 5, x(0xF0F0 << 20): None}
    assert at_distance(spark, monkeypatch, rows) == sorted((f, str(i), want[f]) for i, f in rows)


def test_rows_are_told_by_id_and_text(spark):
    """Rows that share an id, or have none, lose nothing but true copies."""
    rng = random.Random(12)
    text = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    near = a.split()
    near[30] = "changed"
    rows = [(5, a, "x", None, 1), (5, b, "y", "s", 2), (7, " ".join(near), "x", "s", 3), (None, c, "x", "s", 4), (None, c, "x", "s", 4), (None, d, "x", "s", 5), (8, d, "x", "s", 6), (8, d, "x", "s", 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in SD.keep_one(df.withColumn("__c", F.lit(1)).withColumn("_r", F.lit(2)).withColumn("_stays", F.lit(True))).collect())
    assert kept == sorted([("5", a), ("5", b), ("None", c), ("8", d)])
    line = lambda: "".join(rng.choice("abcdefgh ") for _ in range(40))
    x, y, z = line(), line(), line()
    two = spark.createDataFrame([(1, x), (5, x), (5, f"{y}\n{x}"), (None, f"{x}\n{z}"), (None, f"{z}\nab\nab"), (5, x)], "doc_id long, text string").withColumn("_gone_doc", F.lit(1)).withColumn("_k", F.lit(1))
    got = sorted((str(r["doc_id"]), r["text"]) for r in LD.dedup_lines(two).collect())
    first = sorted([f"{x}\n{z}", f"{z}\nab\nab"])
    assert [g for g in got if g[0] != "None"] == [("1", x), ("5", ""), ("5", ""), ("5", y)]
    assert sorted(t for i, t in got if i == "None") in (sorted([z, "ab"]), sorted(["", f"{z}\nab"]))


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    base = [[rng.choice(words) for _ in range(rng.randint(150, 400))] for _ in range(40)]
    rows = [(i, " ".join(b), "en", "s", 1) for i, b in enumerate(base)]
    for k in range(200):  # copies with two words changed, and half texts, which are no copies
        b = list(base[k % 20])
        for _ in range(2):
            b[rng.randrange(len(b))] = "changed"
        rows.append((100 + k, " ".join(b), "en", "s", 1))
    for k in range(20):
        b = base[20 + k]
        rows.append((1000 + k, " ".join(b[: len(b) // 2] + [rng.choice(words) for _ in range(len(b) // 2)]), "en", "s", 1))
    kept = {r["doc_id"] for r in SD.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == set(range(40)) | set(range(1000, 1020))


def test_near_copies_are_those_of_all_pairs(spark):
    """Pairs right at and right below the likeness of 0.8, of several lengths."""
    rng = random.Random(7)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    texts = []
    for k in range(240):
        n = rng.choice([12, 40, 120, 400])
        a = [f"w{k}x{i}" for i in range(n)]
        b = list(a)
        least = rng.choice([0.8, 0.8, 0.66])
        while True:  # words change until one more would bring the likeness under `least`
            c = list(b)
            c[rng.randrange(n)] = f"v{k}y{rng.random()}"
            x, y = shingles(a), shingles(c)
            if len(x & y) < least * len(x | y):
                break
            b = c
        texts += [a, b]
    # a chain whose ends are unlike, and texts with one set of shingles in another order and number
    chain = [f"c{i}" for i in range(100)]
    texts += [chain[i : i + 60] for i in range(0, 30, 4)]
    texts += [["r", "s", "t"] * 30, ["s", "t", "r"] * 40]
    sets = [shingles(t) for t in texts]
    low = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(max(0, i - 10), i):  # only neighbours have a shingle in common
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = sorted((low[i], low[j]))
                low = [a if c == b else c for c in low]
    kept = {r["doc_id"] for r in SD.keep_one(spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert kept == set(low) and 100 < len(texts) - len(kept) < 220


def test_near_copies_are_searched_by_fingerprints(spark):
    """With keys that only sets with all minima in common share, what BK-trees link is found all the same, by any table's shard."""
    rng = random.Random(21)
    p = SD.NearParams(bands=1, rows=160)
    texts = []
    for k in range(12):
        base = [f"w{k}x{i}" for i in range(rng.choice([400, 800, 1600]))]
        for _ in range(10):
            b = list(base)
            for _ in range(3):
                b[rng.randrange(len(b))] = f"v{rng.random()}"
            texts.append(" ".join(b))
    sets = [SD.shingle_set(t, p.shingle) for t in texts]
    assert len({SD.signature(h, p)[0][0] for h in sets}) > 110
    kept = {r["doc_id"] for r in SD.keep_one(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA), p).collect()}
    assert kept == set(range(0, 120, 10))
    fps = spark.createDataFrame([(SD.set_fingerprint(h, p.words), i) for i, h in enumerate(sets)], "fp string, node long")
    pairs = SD._close_pairs(fps, p.simhash(len(sets))).collect()
    values = [int(SD.set_fingerprint(h, p.words), 16) for h in sets]
    assert pairs and all(r["u"] < r["v"] and (values[r["u"]] ^ values[r["v"]]).bit_count() <= p.radius for r in pairs)


def test_segment_keys_are_short(spark):
    """Two dozen keys a line are exchanged: five bytes each, and pairs that meet by chance are verified."""
    lines = spark.createDataFrame([(i, f"line {i} of some twenty and more letters") for i in range(200)], "_m long, _line string").select("_m", F.encode("_line", "UTF-32").alias("_wide"))
    for rows in (LD.index_rows(lines, ["_m"], LD._budgets(2)), LD.probe_rows(lines, ["_m"], LD._budgets(2))):
        least, most = rows.agg(F.min("_key"), F.max("_key")).first()
        assert 0 <= least < most < 1 << 40


def next_of(rows):
    """By descending id (null last), texts of one id by descending order."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode())
    o = sorted(((i, t or "") for i, t in rows), key=key, reverse=True)
    return [(o[i][0], o[i][1], o[(i + 1) % len(o)][1]) for i in range(len(o))]


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_next_document(spark, buckets):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(60)]), "".join(rng.choice("aé🙂 ") for _ in range(rng.randint(0, 6)))) for _ in range(90)]
    got = D.with_next(spark.createDataFrame(rows, "doc_id long, text string"), buckets).collect()
    assert sorted(((r["_id"], r["_text"], r["_next"]) for r in got), key=str) == sorted(next_of(rows), key=str)


def test_document_fingerprints(spark, odd, clashing, none):
    assert D.document_fingerprints(none).count() == 0
    one = D.document_fingerprints(spark.createDataFrame([(1, "a b c d e f g h i", 5)], "doc_id long, text string, n_chars long")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 17
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = sorted((str(i), len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()) for i, t, n in next_of(rows))
    got = D.document_fingerprints(clashing).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == want
    by = {r["n_chars"]: r for r in got}
    assert by[0]["fingerprint"] == "0" * 32 and len({r["fingerprint"] for r in got if r["doc_id"] == 4}) == 1
    for r in got:
        d = (int(r["fingerprint"], 16) ^ int(r["edited_fingerprint"], 16)).bit_count()
        assert r["near_edited"] == pytest.approx(max(0, math.cos(math.pi * d / 128)), abs=1e-9)


def test_votes_are_those_of_each_term(spark):
    texts = ["a b c d", "a b c a b c a b c", "x", "", "one two", "À la CARTE à la carte"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    hashes = {r["k"]: [h for h in r["h"]] for r in df.select("k", D.term_hashes(F.col("text")).alias("h")).collect()}
    assert [len(hashes[i]) for i in range(6)] == [2, 7, 1, 0, 1, 4]
    got = {r["k"]: r for r in D.fingerprint_columns(df, ["k"], F.col("text")).collect()}
    for k, hs in hashes.items():
        want = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hs) > len(hs))
        assert got[k]["f0"] & (2**64 - 1) == want


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(6)
    vs = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(40)]
    vs += [(flipped(rng, a, rng.randint(0, 2)), flipped(rng, b, rng.randint(0, 2))) for a, b in [rng.choice(vs) for _ in range(200)]]
    s = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, s(a), s(b)) for i, (a, b) in enumerate(vs)], "q long, f0 long, f1 long")
    for r in (0, 3):
        got = {x["q"]: x["n"] for x in D.within_radius(df, df, r).collect()}
        assert got == {i: sum((a ^ c).bit_count() + (b ^ d).bit_count() <= r for c, d in vs) for i, (a, b) in enumerate(vs)}


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def edited(rng, s, n, letters="abé🙂"):
    b = list(s)
    for _ in range(n):
        o, k = rng.randint(0, 2), rng.randint(0, len(b))
        if o == 0:
            b.insert(k, rng.choice(letters))
        elif b:
            k = min(k, len(b) - 1)
            b[k : k + 1] = [] if o == 1 else [rng.choice(letters)]
    return "".join(b)


def test_bit_parallel_band(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(500):
        a = "".join(rng.choice("abé🙂") for _ in range(rng.randint(0, 14)))
        a, b = sorted((a, edited(rng, a, rng.randint(0, 4))), key=len)
        rows.append((a, b, distance(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, d int")
    for t in range(4):
        assert df.where(LD.within_edits(F.col("a"), F.col("b"), t) != (F.col("d") <= t)).count() == 0
        assert df.where(~LD.may_be_within(LD.counts_of(F.col("a")), LD.counts_of(F.col("b")), t) & (F.col("d") <= t)).count() == 0
    with pytest.raises(ValueError):
        LD.within_edits(F.col("a"), F.col("b"), 4)


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_line_dedup_is_that_of_all_pairs(spark, most):
    rng = random.Random(5 + most)
    base = ["".join(rng.choice("ab é") for _ in range(n)) for n in [1, 2, 5, 10, 11, 12, 12, 13, 13, 22, 23, 23, 24, 24, 25, 25, 26, 36, 37, 40] * 3]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), rng.randint(0, 3), "ab é") if rng.random() < 0.9 else "" for _ in range(rng.randint(0, 7)))) for i in rng.sample(range(1000), 120)]
    got = {r["doc_id"]: r["text"] for r in LD.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), most).collect()}
    seen, gone = {}, set()
    for i, t in sorted(rows):
        for at, line in enumerate(t.split("\n")):
            if line:
                if line in seen or any(distance(line, x) <= min(most, len(x) // 12, len(line) // 12) for x in seen if abs(len(x) - len(line)) <= most):
                    gone.add((i, at))
                seen.setdefault(line, i)
    assert sum(len(t.split("\n")[at]) < 24 for i, t in rows for at in range(t.count("\n") + 1) if (i, at) in gone) > 40
    for i, t in rows:
        assert got[i] == "\n".join(x for at, x in enumerate(t.split("\n")) if (i, at) not in gone)


def test_line_dedup_of_odd_rows(spark, odd, clashing, none):
    got = LD.dedup_lines(clashing, length_col="n_chars")
    assert got.columns == [*clashing.columns, "_lines_", "_gone_"] and got.count() == odd.count()
    a = sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect())))
    assert a == sorted(map(str, ((r["doc_id"], r["text"]) for r in odd.collect())))  # repeated rows are one document
    assert LD.dedup_lines(none).count() == 0
    line = "a line that is long enough to count as one"
    two = spark.createDataFrame([(2, f"{line}\nshort\n", "x", "s", 9), (1, f"{line}s", "x", "s", 9)], SCHEMA)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in LD.dedup_lines(two, length_col="n_chars").collect()}
    assert got == {1: (f"{line}s", 43), 2: ("short\n", 6)}
