"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

Indicators of hashed n-grams, of up to four bytes and of two words, are scaled by the classes' log-count ratios; a linear
hinge-loss model over them is fitted by dual coordinate descent (Hsieh et al., 2008), and its margins are calibrated to
probabilities on a part that was kept from the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kabund.llm.common import bounded_batches, text_of
from kabund.llm.labelled import fitted, Distinct, fit_sigmoid, gram_slots, held_out, labelled_rows


@dataclass(frozen=True)
class NbSvmParams:
    """orders: lengths of the n-grams. bits: log2 of the slots, for bytes and for words each. per_class: bound of the labelled sample, for each class."""

    orders: tuple[int, ...] = (1, 2, 3, 4)
    bits: int = 17
    per_class: int = 3000
    smoothing: float = 1.0
    cost: float = 1.0
    epochs: int = 12
    threshold: float = 0.3


_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
#: An odd number and its inverse modulo 2^64, of a polynomial hash; words that are handled at a time.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORDS = 1 << 15


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def pair_slots(data: bytes, bits: int) -> Iterator[np.ndarray]:
    """Slots (2^bits to 2^(bits + 1)) of the pairs of words that follow one another, by hashes of the words."""
    raw = np.frombuffer(data, dtype=np.uint8)
    blank = np.concatenate(([True], _SPACE[raw], [True]))
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    for at in range(0, len(starts) - 1, _WORDS):
        s, e = starts[at : at + _WORDS + 1], ends[at : at + _WORDS + 1]
        part = raw[s[0] : e[-1]].astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * _powers(_INVERSE, len(part)), dtype=np.uint64)))
            words = (upto[e - s[0]] - upto[s - s[0]]) * _powers(_BASE, int(s[-1] - s[0]) + 1)[s - s[0]]
            words ^= words >> np.uint64(29)
            pairs = (words[:-1] * np.uint64(0xBF58476D1CE4E5B9) + words[1:]) * np.uint64(0x94D049BB133111EB)
            yield (pairs >> np.uint64(64 - bits)).astype(np.uint32) + np.uint32(1 << bits)


def features(text: str, distinct: Distinct, p: NbSvmParams) -> Iterator[np.ndarray]:
    """The distinct slots of a text: its byte n-grams, and its pairs of words."""
    data = text.encode("utf-8", "surrogatepass")
    return distinct.of(chain(gram_slots(data, p.orders, p.bits), pair_slots(data, p.bits)))


@dataclass
class NbSvm:
    weights: np.ndarray  # of a slot: its log-count ratio times its coefficient
    bias: float
    a: float
    b: float
    p: NbSvmParams

    def margins(self, texts: Iterator[str]) -> Iterator[float]:
        distinct = Distinct(self.p.bits + 1)
        for text in texts:
            total, n = 0.0, 0
            for slots in features(text, distinct, self.p):
                total += float(self.weights[slots].sum(dtype=np.float64))
                n += len(slots)
            yield total / np.sqrt(max(n, 1)) + self.bias

    def scores(self, texts: Iterator[str]) -> np.ndarray:
        m = np.fromiter(self.margins(texts), dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(self.a * m + self.b, -30, 30)))


def _values(row: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Scaled indicators, over the root of their number, so that long texts do not weigh more."""
    return ratio[row] / np.sqrt(max(len(row), 1))


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, p: NbSvmParams) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the bias is a feature of its own. Classes weigh the same in sum."""
    w, bias = np.zeros(len(ratio)), 0.0
    ends = np.cumsum([len(r) for r in rows])
    flat = np.empty(int(ends[-1]), dtype=np.float32)  # one array, which goes back to the system as a whole
    values = [flat[e - len(r) : e] for r, e in zip(rows, ends.tolist(), strict=True)]
    for r, v in zip(rows, values, strict=True):
        v[:] = _values(r, ratio)
    norms = np.array([float(v @ v) + 1.0 for v in values])
    share = {s: len(y) / (2 * max(1, int((y == s).sum()))) for s in (-1.0, 1.0)}
    upper = np.array([p.cost * share[s] for s in y])
    alpha = np.zeros(len(y))
    rng = np.random.default_rng(7)
    for _ in range(p.epochs):
        for i in rng.permutation(len(y)):
            r, v = rows[i], values[i]
            g = y[i] * (float(w[r] @ v) + bias) - 1.0
            new = min(max(alpha[i] - g / norms[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def fit(sample: list[tuple[int, str, object]], p: NbSvmParams = NbSvmParams()) -> NbSvm:
    """Fit on (id, text, 0 or 1). With fewer than two classes the model gives each text the share of ones (0.5 without rows)."""
    size = 2 << p.bits
    y = np.array([1.0 if s[2] else -1.0 for s in sample])
    if len(sample) < 10 or len(set(y)) < 2:
        share = float((y > 0).mean()) if len(y) else 0.5
        logit = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return NbSvm(np.zeros(size, dtype=np.float32), 0.0, 0.0, logit, p)
    distinct = Distinct(p.bits + 1)
    rows = [np.concatenate([np.empty(0, np.int32), *(x.astype(np.int32) for x in features(text, distinct, p))]) for _, text, _ in sample]
    ends = np.cumsum([len(r) for r in rows])
    flat = np.concatenate(rows)
    rows = [flat[e - len(r) : e] for r, e in zip(rows, ends.tolist(), strict=True)]

    def ratios(of: np.ndarray) -> np.ndarray:
        counts = {s: np.full(size, p.smoothing) for s in (-1.0, 1.0)}
        for i in of:
            counts[y[i]][rows[i]] += 1
        n = {s: float((y[of] == s).sum()) + 2 * p.smoothing for s in counts}
        return np.log(counts[1.0] / n[1.0]) - np.log(counts[-1.0] / n[-1.0])

    def fitted(of: np.ndarray) -> tuple[np.ndarray, float]:
        ratio = ratios(of)
        w, bias = _descend([rows[i] for i in of], y[of], ratio, p)
        return (w * ratio).astype(np.float32), bias

    # calibrate on what a model of the other four fifths has not seen; the model itself is fitted on all
    order = np.random.default_rng(3).permutation(len(y))
    kept, rest = order[: len(y) // 5], order[len(y) // 5 :]
    w, bias = fitted(rest if len(set(y[rest])) == 2 else order)
    margin = np.array([float(_values(rows[i], w).sum()) + bias for i in kept])
    a, b = fit_sigmoid(margin, y[kept])
    w, bias = fitted(order)
    return NbSvm(w, bias, a, b, p)


def score_quality(docs: DataFrame, labels: DataFrame, p: NbSvmParams = NbSvmParams(), folds: int = 5, fold: int = 0, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs.

    Labels are learnt from at most p.per_class documents of each class outside the fold held out. A null text counts as empty,
    and an empty one gets the model's score for no n-grams. A null doc_id is never held out and never learnt from. Other
    columns are ignored. An empty table gives an empty one; without labels each score is 0.5.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fitted(labelled_rows(docs, labels, label, folds, fold, p.per_class), fit, p))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": model.value.scores(iter(b["text"]))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds, fold).alias("held_out"), text_of().alias("text"))
    return rows.mapInPandas(of, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, p: NbSvmParams = NbSvmParams(), folds: int = 5, fold: int = 0) -> DataFrame:
    """docs without the rows that the classifier rejects (a score under p.threshold); all columns stay.

    Rows are scored where they are, in one pass, so that repeated ids and null ids keep their own decisions.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fitted(labelled_rows(docs, labels, "quality", folds, fold, p.per_class), fit, p))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(model.value.scores(iter(t)))

    return docs.where(score(text_of()) >= p.threshold)
