"""Classifiers and language identification: held-out accuracy on a small corpus, mechanics, odd rows."""

import zlib

import numpy as np
import pytest

from kabund.llm import labelled, langid, quality, toxicity


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def auc(y, x):
    pos, neg = x[y == 1], x[y == 0]
    return float(np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos]))


def check_shape(rows, ids, folds, fold):
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, ids))
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and remainder(r["doc_id"], folds) == fold)


@pytest.mark.parametrize("op, label, folds, fold", [(quality.score_quality, "quality", 5, 0), (toxicity.score_toxicity, "toxic", 4, 2)])
def test_held_out_documents_are_told_apart(spark, corpus, labels, op, label, folds, fold):
    rows = op(corpus, labels).collect()
    check_shape(rows, range(1000, 1400), folds, fold)
    y = {r["doc_id"]: r[label] for r in labels.collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 40 and auc(np.array([y[r["doc_id"]] for r in held]), np.array([r["score"] for r in held])) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


@pytest.mark.parametrize("op, folds, fold", [(quality.score_quality, 5, 0), (toxicity.score_toxicity, 4, 2)])
def test_odd_rows_and_no_labels(spark, odd, clashing, none, corpus, labels, op, folds, fold):
    wide = clashing.unionByName(corpus, allowMissingColumns=True)
    rows = [r for r in op(wide, labels).collect() if r["doc_id"] is None or r["doc_id"] < 1000]
    check_shape(rows, [r["doc_id"] for r in odd.collect()], folds, fold)
    same = {r["score"] for r in rows if r["doc_id"] in (0, 1)}
    assert len(same) == 1  # null is empty
    assert op(none, labels).count() == 0
    assert {r["score"] for r in op(odd, labels.where("false")).collect()} == {0.5}


def test_rejected_documents_go(spark, odd, clashing, none, corpus, labels):
    kept = quality.keep_good(corpus.unionByName(corpus.where("doc_id = 1000")), labels)
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == corpus.columns and len({i for i in ids if y[i]}) > 0.95 * sum(y.values()) and len([i for i in ids if not y[i]]) < 10
    assert quality.keep_good(clashing, labels).columns == clashing.columns
    assert quality.keep_good(none, labels).count() == 0


def test_labels_are_learnt_outside_the_fold_and_within_the_bound(spark, corpus, labels):
    sample = labelled.labelled_sample(corpus, labels, "toxic", 4, 2, 50)
    assert all(remainder(i, 4) != 2 for i, _, _ in sample)
    assert [sum(1 for s in sample if s[2] == c) for c in (0, 1)] == [50, 50]
    assert labelled.labelled_sample(corpus, labels.where("false"), "toxic", 4, 2, 50) == []
    rows = labelled.labelled_rows(corpus, labels, "toxic", 4, 2, 50)
    assert labelled.fitted(rows, lambda s, p: (p, s), 3) == (3, sample)


def test_a_text_goes_with_the_label_of_its_own_row(spark):
    docs = spark.createDataFrame([(4, "b text", "en"), (4, "a text", "de"), (7, "x", "fr"), (7, "w", None)], "doc_id long, text string, lang string")
    held = lambda i: remainder(i, 5) == 0
    got = labelled.labelled_sample(docs, None, "lang", 5, 0, 9)
    assert got == [x for x in ((4, "b text", "en"), (7, "x", "fr")) if not held(x[0])] and got


def test_gram_slots_and_distinct():
    data = ("abcabcé🙂" * 50).encode()
    whole = [s.copy() for s in labelled.gram_slots(data, (1, 2, 3), 12)]
    before, labelled.CHUNK = labelled.CHUNK, 37
    try:
        parts = list(labelled.gram_slots(data, (1, 2, 3), 12))
    finally:
        labelled.CHUNK = before
    assert sorted(np.concatenate(whole)) == sorted(np.concatenate(parts)) and sum(map(len, whole)) == 3 * len(data) - 3
    d = labelled.Distinct(12)
    for _ in range(2):  # nothing is left of the text before
        assert sorted(np.concatenate(list(d.of(iter(parts))))) == sorted(set(np.concatenate(whole).tolist()))
    assert list(labelled.gram_slots(b"", (1,), 8)) == [] and len(list(labelled.gram_slots(b"a", (2,), 8))) == 0


def test_pairs_of_words():
    slots = lambda t, bits=16: np.concatenate([np.empty(0, np.uint32), *quality.pair_slots(t, bits)]).tolist()
    assert slots(b"") == slots(b"one") == slots(b" one ") == []
    a, b, c = slots(b"one two three one two"), slots(b"  one\ttwo\n"), slots(b"two one")
    assert len(a) == 4 and a[0] == a[3] == b[0] and b != c and all(1 << 16 <= x < 2 << 16 for x in a)
    text = " ".join(f"w{i % 97}" for i in range(1000)).encode()
    before, quality._WORDS = quality._WORDS, 7
    try:
        parts = slots(text)
    finally:
        quality._WORDS = before
    assert parts == slots(text) and len(parts) == 999


def test_a_score_is_the_sum_of_weights(corpus):
    """Recomputed slot by slot, and the descent's solution against the conditions of an optimum."""
    sample = sorted((r["doc_id"], r["text"], r["doc_id"] % 2) for r in corpus.limit(60).collect())
    p = quality.NbSvmParams(bits=10, epochs=400)
    model = quality.fit(sample, p)
    for _, text, _ in sample[:10]:
        data = text.encode()
        slots = {int(x) for part in (*labelled.gram_slots(data, p.orders, p.bits), *quality.pair_slots(data, p.bits)) for x in part}
        margin = sum(float(model.weights[s]) for s in slots) / len(slots) ** 0.5 + model.bias
        assert model.scores(iter([text]))[0] == pytest.approx(1 / (1 + np.exp(-(model.a * margin + model.b))), abs=1e-5)
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 12)).astype(np.int32) for _ in range(30)]
    y = np.array([1.0, -1.0] * 15)
    ratio = rng.normal(size=40)
    w, bias = quality._descend(rows, y, ratio, p)
    x = np.zeros((30, 40))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / len(r) ** 0.5
    loss = lambda w, b: (w @ w + b * b) / 2 + p.cost * np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = loss(w, bias)
    for _ in range(200):
        assert loss(w + rng.normal(size=40) * 0.01, bias + rng.normal() * 0.01) >= best - 1e-6


def test_a_language_is_that_of_the_mean_of_all_runs():
    rng = np.random.default_rng(1)
    p = langid.LangIdParams(bits=8, orders=(2, 3))
    model = langid.LangId(["a", "b", "c"], rng.normal(size=(256, 3)).astype(np.float32), rng.normal(size=3), 0.7, 0.5, p)
    for text in ("héllo wörld", "x y", "Ab " * 400):
        slots = [int(x) for part in labelled.gram_slots(text.lower().encode(), p.orders, p.bits) for x in part]
        z = (np.mean([model.table[s].astype(float) for s in slots], axis=0) + model.bias) / 0.7
        e = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        lang, score, rejected = model.predict(text)
        assert lang == "abc"[int(e.argmax())] and score == pytest.approx(e.max(), abs=1e-5) and rejected == (score < 0.5)


def test_gradients_are_those_of_differences():
    p = toxicity.GruParams(window=4, stride=2, hidden=3, word_dims=2, char_dims=2, word_bits=4, char_bits=4)
    model = toxicity.BiGru.fresh(p)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    words = [b"", b"ab", b"c", b"long-word", b"d"]
    ids = np.array([[1, 2, 3, 4], [4, 4, 0, 0], [3, 1, 2, 0]])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.2, 0.5, 0.3])
    loss, g, (dx, slots, chars, counts) = model.gradients(words, ids, y, weight)
    rng = np.random.default_rng(0)
    for name in g:
        flat = model.w[name].ravel()
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-3
            up = model.gradients(words, ids, y, weight)[0]
            flat[i] = old - 1e-3
            down = model.gradients(words, ids, y, weight)[0]
            flat[i] = old
            assert np.asarray(g[name]).ravel()[i] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_windows_cover_texts_of_any_length():
    p = toxicity.GruParams(window=8, stride=4, vocabulary=80, block=16)
    assert [toxicity.windows_of(n, p) for n in (0, 1, 8, 9, 12, 13)] == [[0], [0], [0], [0, 4], [0, 4], [0, 4, 8]]
    model = toxicity.BiGru.fresh(p)
    texts = ["", "a b", " ".join(f"w{i % 30}" for i in range(400)), "x " * 9, " ".join(f"u{i}" for i in range(300))]
    together = model.document_scores(texts)
    assert together == pytest.approx([float(model.document_scores([t])[0]) for t in texts], abs=1e-5)
    # the highest of all windows, one by one
    words = texts[2].encode().split()
    own = model.gates(model.inputs([b"", *dict.fromkeys(words)])[0])
    number = {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}
    tops = []
    for s in toxicity.windows_of(len(words), p):
        ids = [number[w] for w in words[s : s + 8]]
        tops.append(float(model.scores(own, np.array([ids + [0] * (8 - len(ids))]))[0]))
    assert float(list(model.document_logits([texts[2]]))[0]) == pytest.approx(max(tops), abs=1e-5)


def test_languages(spark, corpus, odd, clashing, none):
    rows = langid.detect_language(corpus).collect()
    lang = {r["doc_id"]: r["lang"] for r in corpus.collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 40 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    wide = clashing.unionByName(corpus, allowMissingColumns=True)
    got = [r for r in langid.detect_language(wide).collect() if r["doc_id"] is None or r["doc_id"] < 1000]
    check_shape(got, [r["doc_id"] for r in odd.collect()], 5, 0)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (0, 1, 2, 8))
    assert all(r["lang_pred"] in ("en", "de", "fr") for r in got if r["doc_id"] in (3, 4, 5, 6, 7))
    assert langid.detect_language(none).count() == 0
    assert {r["lang_pred"] for r in langid.detect_language(odd.where("lang is null")).collect()} == {"und"}


def test_rejection_is_calibrated():
    rng = np.random.default_rng(3)
    draw = lambda letters: "".join(rng.choice(list(letters), 60))
    sample = [(i, draw("abcde "), "x") for i in range(150)] + [(i, draw("cdefg "), "y") for i in range(150, 300)]
    model = langid.fit(sample)
    tests = [(draw("abcde "), "x") for _ in range(100)] + [(draw("cdefg "), "y") for _ in range(100)]
    found = [(model.predict(t), y) for t, y in tests]
    accepted = [(f, y) for f, y in found if not f[2]]
    assert len(accepted) > 100 and np.mean([f[0] == y for f, y in accepted]) > 0.95
