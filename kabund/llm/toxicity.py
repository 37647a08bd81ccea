"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the embedding of its hash next to the pooled embeddings of its hashed character n-grams. Windows of words that
overlap by a third are read by a gated recurrent unit in either direction; attention pools the states of a window, and a
linear layer scores it. A text's score is that of its highest window, calibrated. Labels are those of whole texts, so that
fitting is done on the windows that score highest (multiple-instance learning). One coordinate of either embedding starts
as the classes' log-count ratio, all others at random.

What depends on a word alone (its part of the gates' inputs) is computed once for each distinct word of a batch of rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kabund.llm.common import bounded_batches, text_of
from kabund.llm.labelled import fitted, fit_sigmoid, held_out, labelled_rows


@dataclass(frozen=True)
class GruParams:
    """window, stride: words. per_class: bound of the sample for each class. hidden: states for each direction."""

    window: int = 24
    stride: int = 16
    hidden: int = 8
    word_dims: int = 8
    char_dims: int = 8
    orders: tuple[int, ...] = (3, 6)
    word_bits: int = 16
    char_bits: int = 16
    per_class: int = 1500
    epochs: int = 8
    rate: float = 0.01
    threshold: float = 0.3
    vocabulary: int = 60_000  # distinct words kept at a time while scoring
    block: int = 2048  # windows scored at a time

    def __post_init__(self) -> None:
        if not 0 < self.stride <= self.window:
            raise ValueError("stride must be from 1 to window")
        if self.vocabulary < self.block * self.stride + self.window:
            raise ValueError("the vocabulary must hold the words of a block of windows")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def char_slots(words: list[bytes], bits: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all character n-grams of <word>, word after word, and how many each word has."""
    joined = np.frombuffer(b"".join(b"<" + w + b">" for w in words), dtype=np.uint8).astype(np.uint32)
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(joined))  # bytes from here to the word's end
    slots, of, h = [], [], np.zeros(len(joined), dtype=np.uint32)
    word = np.repeat(np.arange(len(words)), lengths)
    for n in range(1, max(orders) + 1):
        m = max(0, len(joined) - n + 1)
        h = h[:m] * np.uint32(0x01000193) + joined[n - 1 :] + np.uint32(1)
        if n in orders:
            inside = left[:m] >= n
            x = h[inside]
            slots.append((((x ^ (x >> np.uint32(13))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - bits)).astype(np.int64))
            of.append(word[:m][inside])
    slots, of = np.concatenate(slots), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return slots[order], np.bincount(of, minlength=len(words))


def word_slots(words: list[bytes], bits: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) & ((1 << bits) - 1) for w in words), dtype=np.int64, count=len(words))


def windows_of(n: int, p: GruParams) -> list[int]:
    """Starts of a text's windows: every stride words, the last one so that it reaches the end."""
    return list(range(0, max(1, n - p.window + p.stride), p.stride))


@dataclass
class BiGru:
    p: GruParams
    w: dict[str, np.ndarray] = field(default_factory=dict)
    a: float = 1.0
    b: float = 0.0

    @staticmethod
    def fresh(p: GruParams, seed: int = 5) -> BiGru:
        rng = np.random.default_rng(seed)
        d, h = p.word_dims + p.char_dims, p.hidden

        def draw(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        w = {"word": draw(1 << p.word_bits, p.word_dims, scale=0.05), "char": draw(1 << p.char_bits, p.char_dims, scale=0.05), "out": draw(2 * h, scale=0.3), "bias": np.zeros(1, np.float32), "att": draw(2 * h, scale=0.3)}
        for s in "fb":
            w |= {f"W{s}": draw(d, 3 * h, scale=d**-0.5), f"U{s}": draw(h, 3 * h, scale=h**-0.5), f"c{s}": np.zeros(3 * h, np.float32)}
        return BiGru(p, w)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """A row for each word, and what the way back needs."""
        slots, (chars, counts) = word_slots(words, self.p.word_bits), char_slots(words, self.p.char_bits, self.p.orders)
        starts = np.cumsum(counts) - counts
        mean = np.zeros((len(words), self.p.char_dims), np.float32)  # the filler has no trigrams
        some = counts > 0
        if some.any():
            mean[some] = np.add.reduceat(self.w["char"][chars], starts[some], axis=0) / np.sqrt(counts[some, None]).astype(np.float32)
        return np.hstack((self.w["word"][slots], mean)), (slots, chars, counts)

    def _run(self, own: np.ndarray, ids: np.ndarray, s: str, keep: bool):
        """States of one direction. own: of each word its part of the gates; ids: windows by places."""
        n, t = ids.shape
        by_place = np.ascontiguousarray(ids.T)
        hid, u = self.p.hidden, self.w[f"U{s}"]
        h, states, kept = np.zeros((n, hid), np.float32), [None] * t, [None] * t
        for i in range(t) if s == "f" else range(t - 1, -1, -1):
            x, r = np.take(own, by_place[i], axis=0), h @ u
            zr = _sigmoid(x[:, : 2 * hid] + r[:, : 2 * hid])
            z, reset = zr[:, :hid], zr[:, hid:]
            c = np.tanh(x[:, 2 * hid :] + reset * r[:, 2 * hid :])
            before, h = h, c + z * (h - c)
            states[i] = h
            if keep:
                kept[i] = (before, z, reset, c, r[:, 2 * hid :])
        return states, kept

    def scores(self, own: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
        """Logits of windows; id 0 fills up short ones."""
        e, s = np.zeros(ids.shape, np.float32), np.zeros(ids.shape, np.float32)
        h = self.p.hidden
        for k, side in enumerate("fb"):
            heads = np.stack((self.w["att"][k * h : k * h + h], self.w["out"][k * h : k * h + h]), axis=1)
            states, _ = self._run(own[side], ids, side, False)
            for i, x in enumerate(states):
                both = x @ heads
                e[:, i] += both[:, 0]
                s[:, i] += both[:, 1]
        e[ids == 0] = -1e9
        e -= e.max(axis=1, keepdims=True)
        np.exp(e, out=e)
        return (e * s).sum(axis=1) / e.sum(axis=1) + self.w["bias"][0]

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {s: x @ self.w[f"W{s}"] + self.w[f"c{s}"] for s in "fb"}

    def gradients(self, words: list[bytes], ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray], tuple]:
        """Of the weighted log loss over windows; embeddings' gradients come as rows of x with their slots."""
        h, t = self.p.hidden, ids.shape[1]
        x, (slots, chars, counts) = self.inputs(words)
        own = self.gates(x)
        run = {s: self._run(own[s], ids, s, True) for s in "fb"}
        states = np.concatenate([np.stack(run[s][0], axis=1) for s in "fb"], axis=2)
        e = states @ self.w["att"]
        e[ids == 0] = -1e9
        e = np.exp(e - e.max(axis=1, keepdims=True))
        e /= e.sum(axis=1, keepdims=True)
        sc = states @ self.w["out"]
        logit = (e * sc).sum(axis=1) + self.w["bias"][0]
        prob = _sigmoid(logit)
        loss = float(-(weight * np.where(y > 0, np.log(prob + 1e-7), np.log(1 - prob + 1e-7))).sum())
        d = (weight * (prob - y)).astype(np.float32)
        de = e * (sc - (e * sc).sum(axis=1, keepdims=True)) * d[:, None]
        ds = e * d[:, None]
        g = {"att": np.einsum("ij,ijk->k", de, states), "out": np.einsum("ij,ijk->k", ds, states), "bias": np.array([d.sum()], np.float32)}
        dstates = de[:, :, None] * self.w["att"] + ds[:, :, None] * self.w["out"]
        dx = np.zeros_like(x)
        for k, s in enumerate("fb"):
            u = self.w[f"U{s}"]
            du, down, dh = np.zeros_like(u), np.zeros_like(own[s]), np.zeros((len(ids), h), np.float32)
            for i in range(t - 1, -1, -1) if s == "f" else range(t):
                before, z, reset, c, rc = run[s][1][i]
                dh = dh + dstates[:, i, k * h : k * h + h]
                dz, dc = dh * (before - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
                dr = dc * rc * reset * (1 - reset)
                dpre = np.hstack((dz, dr, dc * reset))
                du += before.T @ dpre
                np.add.at(down, ids[:, i], np.hstack((dz, dr, dc)))
                dh = dh * z + dpre @ u.T
            g |= {f"U{s}": du, f"W{s}": x.T @ down, f"c{s}": down.sum(axis=0)}
            dx += down @ self.w[f"W{s}"].T
        return loss, g, (dx, slots, chars, counts)

    def document_logits(self, texts: list[str], seen: dict[bytes, int] | None = None) -> Iterator[float]:
        """The highest window's logit of each text; a text without words is a window of the filler alone."""
        p = self.p
        store = _Vocabulary(self)
        at, n_pending = 0, 0
        pending: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []  # text, windows
        best: dict[int, float] = {}

        def flush() -> None:
            nonlocal n_pending
            if pending:
                ids = np.concatenate(pending)
                logits = np.concatenate([self.scores(store.gates, ids[i : i + p.block]) for i in range(0, len(ids), p.block)])
                i = 0
                for text, n in owners:
                    best[text] = max(best.get(text, -1e9), float(logits[i : i + n].max()))
                    i += n
                pending.clear()
                owners.clear()
                n_pending = 0

        for text in texts:
            words = text.encode("utf-8", "surrogatepass").lower().split()
            starts = np.array(windows_of(len(words), p))
            for a in range(0, len(starts), p.block):  # a very long text goes in parts
                some = starts[a : a + p.block]
                part = words[int(some[0]) : int(some[-1]) + p.window]
                if not store.room(len(part)):
                    flush()
                    store.clear()
                flat = np.zeros(int(some[-1] - some[0]) + p.window, dtype=np.int64)
                flat[: len(part)] = store.ids(part)
                pending.append(flat[(some - some[0])[:, None] + np.arange(p.window)])
                owners.append((at, len(some)))
                n_pending += len(some)
                if n_pending >= p.block:
                    flush()
            at += 1
        flush()
        yield from (best[i] for i in range(at))

    def document_scores(self, texts: list[str]) -> np.ndarray:
        m = np.fromiter(self.document_logits(texts), dtype=np.float64, count=len(texts))
        return 1 / (1 + np.exp(-np.clip(self.a * m + self.b, -30, 30)))


class _Vocabulary:
    """Distinct words so far and their gates' inputs; 0 is the filler."""

    def __init__(self, model: BiGru) -> None:
        self.model, h = model, model.p.hidden
        self.size = model.p.vocabulary
        self.gates = {s: np.zeros((self.size + 1, 3 * h), np.float32) for s in "fb"}
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}

    def room(self, n: int) -> bool:
        """Whether n more words fit for certain; a part of a text always fits in an empty vocabulary."""
        return len(self.number) + n <= self.size or len(self.number) == 1

    def ids(self, words: list[bytes]) -> np.ndarray:
        before, put = len(self.number), self.number
        out = np.fromiter((put.setdefault(w, len(put)) for w in words), dtype=np.int64, count=len(words))
        if len(put) > before:
            new = list(put)[before:] if before == 1 else [w for w in dict.fromkeys(words) if put[w] >= before]
            x, _ = self.model.inputs(new)
            for s, g in self.model.gates(x).items():
                self.gates[s][before : before + len(new)] = g
        return out


class _Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.m, self.v, self.t = rate, {}, {}, 0

    def dense(self, w: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, x in g.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * x
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * x * x
            w[k] -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def _sparse_step(w: dict[str, np.ndarray], squares: dict[str, np.ndarray], back: tuple, p: GruParams, rate: float) -> None:
    """AdaGrad on the rows of the embeddings that took part."""
    dx, slots, chars, counts = back
    dword, dchar = dx[:, : p.word_dims], np.repeat(dx[:, p.word_dims :] / np.sqrt(np.maximum(counts, 1))[:, None].astype(np.float32), counts, axis=0)
    for name, at, d in (("word", slots, dword), ("char", chars, dchar)):
        u, inverse = np.unique(at, return_inverse=True)
        g = np.zeros((len(u), d.shape[1]), np.float32)
        np.add.at(g, inverse, d)
        squares[name][u] += g * g
        w[name][u] -= rate * g / (np.sqrt(squares[name][u]) + 1e-6)


def fit(sample: list[tuple[int, str, object]], p: GruParams = GruParams()) -> BiGru:
    """Fit on (id, text, 0 or 1). With fewer than two classes each text gets the share of ones (0.5 without rows)."""
    model = BiGru.fresh(p)
    y = np.array([1.0 if s[2] else 0.0 for s in sample], dtype=np.float32)
    if len(sample) < 10 or len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        model.a, model.b = 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return model
    number: dict[bytes, int] = {b"": 0}
    flat = [np.array([number.setdefault(w, len(number)) for w in t.encode("utf-8", "surrogatepass").lower().split()], dtype=np.int64) for _, t, _ in sample]
    words = list(number)
    # log-count ratios of what texts of either class hold: the start of the first coordinates
    chars, many = char_slots(words, p.char_bits, p.orders)
    first = np.cumsum(many) - many
    n1 = float(y.sum())

    def lean(size: int, held: Iterator[np.ndarray]) -> np.ndarray:
        counts = np.full((2, size), 0.5)
        for i, slots in enumerate(held):
            counts[int(y[i])][np.unique(slots)] += 1
        ratio = np.log(counts[1] / (n1 + 1)) - np.log(counts[0] / (len(y) - n1 + 1))
        return np.where(counts.sum(axis=0) >= 5, np.clip(ratio, -3, 3) / 3, 0).astype(np.float32)

    slot = word_slots(words, p.word_bits)
    model.w["word"][:, 0] = lean(1 << p.word_bits, (slot[f] for f in flat))
    inner = (np.concatenate([np.empty(0, np.int64), *(chars[first[w] : first[w] + many[w]] for w in np.unique(f))]) for f in flat)
    model.w["char"][:, 0] = lean(1 << p.char_bits, inner)
    ids, owner = [], []
    for i, f in enumerate(flat):
        starts = np.array(windows_of(len(f), p))
        padded = np.zeros(int(starts[-1]) + p.window, dtype=np.int64)
        padded[: len(f)] = f
        ids.append(padded[starts[:, None] + np.arange(p.window)])
        owner.append(np.full(len(starts), i))
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    rng = np.random.default_rng(17)
    order = rng.permutation(len(sample))
    kept = np.zeros(len(sample), dtype=bool)
    kept[order[: len(sample) // 5]] = True  # for calibration
    x = model.inputs(words)[0]
    start = (x[:, 0] + x[:, p.word_dims])[ids].max(axis=1)
    adam, squares = _Adam(p.rate), {k: np.zeros_like(model.w[k]) for k in ("word", "char")}

    def logits() -> np.ndarray:
        own = model.gates(model.inputs(words)[0])
        return np.concatenate([model.scores(own, ids[i : i + p.block]) for i in range(0, len(ids), p.block)])

    def best(values: np.ndarray, top: int) -> np.ndarray:
        """The highest `top` windows of each text."""
        by = np.lexsort((-values, owner))
        rank = np.arange(len(by)) - np.searchsorted(owner[by], owner[by])
        return by[rank < top]

    weights = np.where(y > 0, 0.5 / max(1.0, n1), 0.5 / max(1.0, len(y) - n1))
    for epoch in range(p.epochs):
        values = start if epoch == 0 else logits()
        chosen = np.concatenate((best(values, 1), best(values, 2)))
        chosen = np.unique(chosen[~kept[owner[chosen]]])
        chosen = rng.permutation(chosen[(y[owner[chosen]] == 0) | np.isin(chosen, best(values, 1))])
        for a in range(0, len(chosen), 128):
            rows = chosen[a : a + 128]
            u, inverse = np.unique(np.append(0, ids[rows].ravel()), return_inverse=True)
            own_words = [words[i] for i in u]
            weight = weights[owner[rows]]
            _, g, back = model.gradients(own_words, inverse[1:].reshape(len(rows), -1), y[owner[rows]], weight / weight.sum())
            rate = p.rate * (1 - 0.7 * epoch / p.epochs)
            adam.dense(model.w, g, rate)
            _sparse_step(model.w, squares, back, p, rate)
    values = logits()
    top = np.full(len(sample), -1e9)
    np.maximum.at(top, owner, values)
    at = np.flatnonzero(kept) if len(set(y[kept].tolist())) == 2 else np.arange(len(sample))
    model.a, model.b = fit_sigmoid(top[at], y[at])
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, p: GruParams = GruParams(), folds: int = 4, fold: int = 2, label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs.

    Labels are learnt from at most p.per_class documents of each class outside the fold held out. All windows of a text are
    scored, whatever its length. A null text counts as empty, and an empty one is scored as a window without words. A null
    doc_id is never held out and never learnt from. Other columns are ignored. An empty table gives an empty one; without
    labels each score is 0.5.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fitted(labelled_rows(docs, labels, label, folds, fold, p.per_class), fit, p))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": model.value.document_scores(b["text"].tolist())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds, fold).alias("held_out"), text_of().alias("text"))
    return rows.mapInPandas(of, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))
