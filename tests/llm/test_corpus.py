"""Packing, token counts, shards, decontamination and the pipeline: brute force, round trips, odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kabund.llm import decontaminate as DC
from kabund.llm import packing, sharding
from kabund.llm import token_counts as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tightest(sizes, sources, clusters, capacity):
    bins, out = [], []
    for z, a, c in zip(sizes, sources, clusters, strict=True):
        ok = [(b["r"], i) for i, b in enumerate(bins) if b["r"] >= z and b["r"] > 0 and a not in b["s"] and c not in b["c"]]
        if ok:
            i = min(ok)[1]
        else:
            bins.append({"r": capacity, "s": set(), "c": set()})
            i = len(bins) - 1
        bins[i]["r"] -= z
        bins[i]["s"].add(a)
        bins[i]["c"].add(c)
        out.append(i)
    return out


def test_best_fit_is_the_tightest_of_all_bins():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(0, 150)
        z = sorted((rng.randint(0, 50) for _ in range(n)), reverse=True)
        a, c = [rng.choice("abcdefgh") for _ in z], [rng.randint(0, 60) for _ in z]
        assert packing.best_fit(z, a, [[x] for x in c], 50) == tightest(z, a, c, 50)


def plain_encoder(p):
    with open(p.tokens.vocabulary, "rb") as f:
        return T.encoder(f.read())


def test_packing_of_odd_rows(spark, odd, clashing, none, corpus):
    p = packing.PackParams(capacity=100, block_pieces=60)
    both = clashing.unionByName(corpus, allowMissingColumns=True)
    bins = packing.pack(both, p).collect()
    e = plain_encoder(p)
    want = sorted(str((r["doc_id"], e.encode_ordinary(r["text"] or ""))) for r in both.collect())
    # unpacking gives the documents' tokens back; rows that repeat a doc_id are told apart by what follows what
    parts, load, source = {}, Counter(), {r["doc_id"]: r["source"] for r in both.collect()}
    for b in bins:
        tokens = np.frombuffer(b["tokens"], "<u2").tolist()
        at = 0
        for s in b["segments"]:
            assert s["offset"] == at and s["start"] == 100 * s["piece"]
            at += s["n_tokens"]
            parts.setdefault((s["doc_id"], s["piece"]), []).append(tokens[s["offset"] : at])
        assert at == len(tokens) == b["n_tokens"] == 100 - b["residual"] <= 100
        held = Counter(source[s["doc_id"]] for s in b["segments"] if s["doc_id"] is not None)
        assert max(held.values(), default=0) <= 1
    for (d, k), x in parts.items():
        if len(x) == 1 and k == 0 and d is not None:
            whole = sum((parts[d, i][0] for i in range(sum(1 for y in parts if y[0] == d))), [])
            assert str((d, whole)) in want
    assert sum(len(x) for (d, k), x in parts.items() if k == 0) == both.count()
    assert sorted(t for x in parts.values() for y in x for t in y) == sorted(t for r in both.collect() for t in e.encode_ordinary(r["text"] or ""))
    assert packing.pack(none, p).count() == 0
    assert packing.pack(both.drop("source"), p).count() >= max(len(x) for x in parts.values())
    flat = packing.placed(packing.pack(both, p))
    assert flat.columns == ["doc_id", "piece", "start", "n_tokens", "bin", "offset", "residual"] and flat.count() == sum(map(len, parts.values()))


def test_near_copies_share_no_bin(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(500)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(30)]
    rows = []
    for i in range(150):
        b = list(base[i % 30])
        b[rng.randrange(60)] = "changed"
        rows.append((i, " ".join(b), f"source{i}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for cluster in (None, F.col("doc_id") % 30):
        for b in packing.pack(docs, packing.PackParams(capacity=4000), cluster).collect():
            assert len({s["doc_id"] % 30 for s in b["segments"]}) == len(b["segments"]) > 1


def test_many_rows_of_one_kind_are_dealt_to_many_blocks(spark):
    docs = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same few words").alias("text"))
    bins = packing.pack(docs, packing.PackParams(block_pieces=20)).collect()
    assert len({b["bin"].split("-")[0] for b in bins}) > 10 and sum(len(b["segments"]) for b in bins) == 300


def test_vocabularies_that_do_not_fit():
    with pytest.raises(ValueError):
        T.TokenFileParams(dtype="<i2")
    with pytest.raises(ValueError):
        T.vocabulary_of(T.TokenFileParams(dtype="|u1", eod=9))
    with pytest.raises(ValueError):
        T.vocabulary_of(T.TokenFileParams(eod=7))


def test_scan_is_that_of_one_pass(spark):
    rng = random.Random(5)
    p = T.TokenFileParams(eod=9, block=4, group=3)
    rows, want = [], []
    for f in range(10):
        t = [rng.choice([1, 2, 3, 9]) if rng.random() < 0.5 else rng.choice([1, 2, 3]) for _ in range(rng.randint(0, 90))]
        t = [1] * 50 if f == 0 else [9] * 30 if f == 1 else t
        rows += [(f, b // 4, bytearray(np.array(t[b : b + 4], "<u2").tobytes())) for b in range(0, len(t), 4)]
        n = o = 0
        for x in t:
            if x == 9:
                want.append((f, o, n, True))
                n, o = 0, o + 1
            else:
                n += 1
        if n:
            want.append((f, o, n, False))
    blocks = spark.createDataFrame(rows, "file int, block int, data binary").repartition(3)
    assert sorted(map(tuple, T.count_tokens(blocks, p).collect())) == sorted(want)


def test_token_counts_of_odd_rows_are_those_of_the_tokenizer(spark, odd, clashing, none):
    p = T.TokenFileParams(block=1000)
    with open(p.vocabulary, "rb") as f:
        e = T.encoder(f.read())
    want = sorted((str(r["doc_id"]), len(e.encode_ordinary(r["text"] or ""))) for r in odd.collect())
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in T.document_token_counts(clashing, p).collect()) == want
    assert T.document_token_counts(none, p).count() == 0


def test_raw_files(spark, tmp_path):
    p = T.TokenFileParams(eod=0, block=3)
    np.array([5, 6, 7, 8, 0, 0, 4, 0, 3], "<u2").tofile(tmp_path / "a.bin")
    (tmp_path / "empty.bin").write_bytes(b"")
    got = sorted((r["ordinal"], r["n_tokens"], r["terminated"]) for r in T.count_tokens(T.raw_blocks(spark, str(tmp_path), p), p).collect())
    assert got == [(0, 4, True), (1, 0, True), (2, 1, True), (3, 1, False)]


def test_tiers_and_plans():
    p = sharding.ShardParams(target=1000, base=10, fanout=3)
    assert [sharding.tier(x, p) for x in (0, 10, 11, 30, 31, 90, 91, 5000)] == [0, 0, 1, 1, 2, 2, 3, 5]
    s = lambda n, b: sharding.Shard(n, n, b)
    assert sharding.plan_merges([s("a", 9), s("b", 8)], p) == []
    some = [s(str(i), 300) for i in range(7)] + [s("big", 900)]
    groups = sharding.plan_merges(some, p)
    assert [len(g) for g in groups] == [3, 3] and all(sum(x.bytes for x in g) <= 1000 for g in groups)
    with pytest.raises(ValueError):
        sharding.ShardParams(target=1, base=2)


def test_shards_hold_all_rows_through_merges(spark, odd, clashing, none, corpus, tmp_path):
    both = clashing.unionByName(corpus, allowMissingColumns=True).repartition(6)
    p = sharding.ShardParams(target=60_000, base=2_000, fanout=3, at_once=2)
    out = sharding.shard_documents(both, 4, p, root=f"file://{tmp_path}/store")
    assert out.columns == [*both.columns, "shard"] and out.where("shard is null").count() == 0
    assert sorted(map(str, out.drop("shard").collect())) == sorted(map(str, both.collect()))
    assert out.select("shard").distinct().count() < 12
    assert sharding.shard_documents(none).count() == 0


def test_versions(spark, corpus, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", sharding.ShardParams(target=10**6, base=10**3, fanout=2))
    assert store.version() == 0 and store.shards() == []
    for i in range(4):
        store.append(corpus.where(F.col("doc_id") % 4 == i).coalesce(1))
    first = store.read(1).count()
    assert store.compact() > 4 and len(store.shards()) == 1 and store.read().count() == 400
    assert store.read(1).count() == first < 400  # an old version reads as it was
    with pytest.raises(sharding.VersionExists):
        store._commit(1, [])
    with pytest.raises(ValueError):
        store.append(corpus.drop("lang"))
    store.vacuum()
    assert store.read().count() == 400 and len(list((tmp_path / "s" / "data").iterdir())) == 1
    store.append(corpus.where("false"))
    assert store.read().count() == 400


def semi(a, b):
    p = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j - 1] + (x != y), p[j] + 1, q[-1] + 1))
        p = q
    return min(p)


def edit(rng, s, n):
    b = list(s)
    for _ in range(n):
        o, k = rng.randint(0, 2), rng.randint(0, max(0, len(b) - 1))
        b[k : k + 1] = [b[k], rng.choice("abc ")] if o == 0 else [] if o == 1 else [rng.choice("abcé")]
    return "".join(b)


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        assert DC.nearest(DC.masks(a), len(a), b)[0] == semi(a, b)


def test_matches_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(30)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(8, 25))) for i in range(15)] + [(90, ""), (91, None), (92, "!!! ...")]
    texts = []
    for i in range(60):
        body = say(rng.randint(0, 60))
        if i % 2:
            body += " " + edit(rng, items[i % 15][1], rng.randint(0, 12)).upper() + "; " + say(5)
        texts.append((i, body))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = {i: DC.normal(t or "") for i, t in items}
    want = {}
    for d, t in texts:
        for i, item in norm.items():
            if item and (e := semi(item, DC.normal(t))) <= int(0.08 * len(item)):
                want[d, i] = e
    for p in (DC.MatchParams(), DC.MatchParams(block_chars=300)):
        assert {(r["doc_id"], r["item_id"]): r["distance"] for r in DC.contaminated(docs, bench, p).collect()} == want
    assert len(want) > 10
    clean = {r["doc_id"] for r in DC.clean_only(docs, bench).collect()}
    assert clean == set(range(60)) - {d for d, _ in want}


def test_decontamination_of_odd_rows(spark, odd, clashing, none):
    bench = spark.createDataFrame([(1, "the same text twice in two rows"), (None, "a text without an id and a few"), (3, None)], "item_id long, text string")
    rows = DC.contaminated(clashing, bench).collect()
    assert sorted(map(str, ((r["doc_id"], r["item_id"]) for r in rows))) == ["(4, 1)", "(4, 1)", "(None, None)"]
    kept = DC.clean_only(clashing, bench)
    # each row is judged by its own text: the one without an id goes too, and others without an id stay
    assert kept.columns == clashing.columns and kept.count() == odd.count() - 3
    two = spark.createDataFrame([(5, "clean words only"), (5, "so: the same text, twice; in two rows!")], "doc_id long, text string")
    assert [r["text"] for r in DC.clean_only(two, bench).collect()] == ["clean words only"]
    assert DC.contaminated(none, bench).count() == 0 and DC.contaminated(odd, bench.where("false")).count() == 0


@pytest.fixture(scope="module")
def folder(spark, corpus, labels, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    labels.write.parquet(f"{d}/labels.parquet")
    corpus.write.parquet(f"{d}/documents.parquet")
    item = corpus.where("doc_id = 1003").first()["text"][:120]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_keep_columns_and_bear_odd_rows(spark, folder, odd, clashing, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, folder)
        assert out.columns == clashing.columns and out.count() <= odd.count(), name
        assert stage(spark, none, folder).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, none, folder).count() == 0


def test_pipeline_is_its_stages(spark, folder, labels):
    got = corpus_pipeline.run(spark, folder).collect()
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    ids = {r["doc_id"] for r in got}
    assert 1003 not in ids and len([i for i in ids if not y[i]]) < 10 and len(ids) > 0.9 * sum(y.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "packing"]
