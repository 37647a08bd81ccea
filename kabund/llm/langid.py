"""Language identification: averaged embeddings of hashed subwords under a linear softmax, by stochastic gradient descent.

The model is that of fastText (Joulin et al., 2017): a text is the mean of the embeddings of its byte n-grams. As softmax inputs
are linear in that mean, embeddings and output layer are folded into one table of scores for each n-gram before scoring.
Confidence is calibrated by a temperature, and a text whose confidence is under a calibrated bound is flagged as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kabund.llm.common import bounded_batches
from kabund.llm.labelled import fitted, gram_slots, held_out, labelled_rows

_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LangIdParams:
    """per_class: bound of the sample, for each language. accept: share of right answers that accepted texts should have."""

    orders: tuple[int, ...] = (2, 3, 4)
    bits: int = 16
    dims: int = 16
    per_class: int = 800
    epochs: int = 4
    rate: float = 0.5
    accept: float = 0.99


@dataclass
class LangId:
    languages: list[str]
    table: np.ndarray  # of a slot, the scores of all languages
    bias: np.ndarray
    temperature: float
    bound: float
    p: LangIdParams

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for slots in gram_slots(text.lower().encode("utf-8", "surrogatepass"), self.p.orders, self.p.bits):
            total += np.take(self.table, slots, axis=0).sum(axis=0, dtype=np.float64)
            n += len(slots)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, confidence, rejected; ("und", 0, True) for a text without letters."""
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0, True
        z = self.logits(text) / self.temperature
        e = np.exp(z - z.max())
        k = int(e.argmax())
        score = float(e[k] / e.sum())
        return self.languages[k], score, score < self.bound


def fit(sample: list[tuple[int, str, object]], p: LangIdParams = LangIdParams()) -> LangId:
    """Fit on (id, text, language). Whole texts and fragments of them are learnt from, so that short texts are no surprise."""
    sample = [s for s in sample if s[1] and _LETTER.search(s[1])]
    languages = sorted({str(s[2]) for s in sample})
    number = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(11)
    items: list[tuple[np.ndarray, np.ndarray, int]] = []
    for _, text, lang in sample:
        pieces = [text]
        for size in (24, 80, 240):
            if len(text) > size:
                at = int(rng.integers(0, len(text) - size))
                pieces.append(text[at : at + size])
        for piece in pieces:
            slots = np.concatenate([np.empty(0, np.uint32), *gram_slots(piece.lower().encode("utf-8", "surrogatepass"), p.orders, p.bits)])
            if len(slots):
                u, c = np.unique(slots, return_counts=True)
                items.append((u.astype(np.int64), (c / len(slots)).astype(np.float32), number[str(lang)]))
    n = len(languages)
    emb = rng.normal(0, 1 / p.dims, (1 << p.bits, p.dims)).astype(np.float32)
    out = np.zeros((p.dims, n), dtype=np.float32)
    bias = np.zeros(n, dtype=np.float32)
    order = rng.permutation(len(items))
    kept, rest = order[: len(items) // 10], order[len(items) // 10 :]
    total, done = max(1, p.epochs * len(rest)), 0
    for _ in range(p.epochs):
        for i in rng.permutation(rest):
            u, c, k = items[i]
            lr = p.rate * (1 - done / total)
            done += 1
            mean = c @ emb[u]
            z = mean @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[k] -= 1
            back = out @ g
            out -= lr * np.outer(mean, g)
            bias -= lr * 0.1 * g
            emb[u] -= (lr * 16 * c)[:, None] * back  # n-grams are rare: they learn faster than the output layer
    table = emb @ out if n else np.zeros((1 << p.bits, 0), np.float32)
    model = LangId(languages, table.astype(np.float32), bias.astype(np.float64), 1.0, 0.0, p)
    # temperature and bound by what was kept from the fit
    z = np.array([items[i][1] @ table[items[i][0]] + bias for i in kept], dtype=np.float64).reshape(len(kept), n)
    y = np.array([items[i][2] for i in kept], dtype=np.int64)
    if len(kept) and n > 1:
        def loss(t: float) -> float:
            s = z / t
            return float((np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(y)), y]).mean())

        model.temperature = min(np.geomspace(0.05, 20, 60), key=loss)
        s = z / model.temperature
        e = np.exp(s - s.max(axis=1, keepdims=True))
        best, right = e.max(axis=1) / e.sum(axis=1), e.argmax(axis=1) == y
        falling = np.argsort(-best)
        share = np.cumsum(right[falling]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(share >= p.accept)
        model.bound = float(best[falling[good[-1]]]) if len(good) else 1.0
    return model


def detect_language(docs: DataFrame, p: LangIdParams = LangIdParams(), folds: int = 5, fold: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), one row for each row of docs.

    Learns from text and lang of at most p.per_class documents of each language outside the fold held out. lang_pred is `und`,
    with the score 0, where the text is null or has no letter, or where nothing could be learnt. rejected: the calibrated
    confidence is under the bound at which accepted texts are right with p.accept. Other columns are ignored; a null doc_id
    is never held out; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fitted(labelled_rows(docs, None, "lang", folds, fold, p.per_class), fit, p))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [model.value.predict(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [x[0] for x in found], "score": np.array([x[1] for x in found], dtype=float), "rejected": np.array([x[2] for x in found], dtype=bool)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds, fold).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(of, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
