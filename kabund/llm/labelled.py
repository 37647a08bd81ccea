"""Bounded samples of labelled documents for fitting, and byte n-gram features shared by the classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kabund.llm.common import fold_of, text_of, written

#: Bytes whose n-grams are handled at a time.
CHUNK = 1 << 19


#: Classes that are learnt at most, those with most documents.
CLASSES = 200


def labelled_rows(docs: DataFrame, labels: DataFrame | None, label: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """(_id, _t, _y): id, text and label of at most per_class documents of each class, those whose ids have the lowest hashes.

    labels None: the label is a column of docs, and a text goes with the label of its own row. Rows of the fold that is held
    out, null labels and null ids are left out. A document with several label rows counts once, with the greatest label, and one
    with several texts with the least of them. The sample is bounded by per_class times the number of classes, CLASSES at
    most, whatever the input's size, and is chosen from the ids alone, before any text is read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), *([F.col(label).alias("_y")] if labels is None else []))
    ids = own if labels is None else labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).alias("_y"))
    ids = ids.where(F.col("_y").isNotNull() & F.col("_id").isNotNull() & (fold_of(F.col("_id"), folds) != held_out))
    ids = ids.groupBy("_id").agg(F.max("_y").alias("_y"))
    if labels is not None:  # labels of documents that are not there would use up the bound
        ids = ids.join(docs.select(F.col("doc_id").cast("long").alias("_id")), "_id", "left_semi")
    ids = written(ids, "labelled")
    classes = ids.groupBy("_y").count().orderBy(F.desc("count"), "_y").limit(CLASSES).collect()
    chosen = None
    for row in sorted(classes, key=lambda r: str(r["_y"])):
        own_class = ids.where(F.col("_y") == F.lit(row["_y"])).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = own_class if chosen is None else chosen.union(own_class)
    if chosen is None:
        chosen = ids.limit(0)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("_t"), *([F.col(label).alias("_own")] if labels is None else []))
    got = F.broadcast(chosen).join(texts, "_id")
    if labels is None:
        got = got.where(F.col("_own") == F.col("_y"))
    return got.groupBy("_id").agg(F.min("_t").alias("_t"), F.first("_y").alias("_y"))


def labelled_sample(*args) -> list[tuple[int, str, object]]:
    """The rows of labelled_rows, in order."""
    return sorted((r["_id"], r["_t"], r["_y"]) for r in labelled_rows(*args).collect())


def fitted(sample: DataFrame, fit, p):
    """fit(rows of sample in order, p), computed by one task: the sample is bounded, and neither texts nor work reach the driver."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted(x for b in batches for x in zip(b["_id"].tolist(), b["_t"].tolist(), b["_y"].tolist(), strict=True))
        yield pd.DataFrame({"model": [pickle.dumps(fit(rows, p))]})

    got = sample.select("_id", "_t", "_y").coalesce(1).mapInPandas(of, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([], p)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return fold_of(doc_id, folds) == F.lit(fold)


def gram_slots(data: bytes, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Slots (below 2^bits) of all byte n-grams, a chunk and an order at a time; chunks overlap so that none is lost or twice."""
    longest = max(orders)
    raw = np.frombuffer(data, dtype=np.uint8)
    shift = np.uint32(32 - bits)
    for at in range(0, len(raw), CHUNK):
        b = raw[at : at + CHUNK + longest - 1].astype(np.uint32)
        h = np.zeros(len(b), dtype=np.uint32)
        for n in range(1, longest + 1):
            m = len(b) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(1)
            if n in orders:
                part = h[: min(m, CHUNK)]
                yield ((part ^ (part >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> shift


class Distinct:
    """Distinct slots of one text at a time, in time that grows with the text only."""

    def __init__(self, bits: int) -> None:
        self.stamp = np.zeros(1 << bits, dtype=np.int32)
        self.seen = np.zeros(1 << bits, dtype=bool)

    def of(self, chunks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        given = []
        for slots in chunks:
            places = np.arange(len(slots), dtype=np.int32)
            self.stamp[slots] = places
            fresh = slots[(self.stamp[slots] == places) & ~self.seen[slots]]
            self.seen[fresh] = True
            given.append(fresh)
            yield fresh
        for fresh in given:
            self.seen[fresh] = False


def fit_sigmoid(margin: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Platt scaling: a, b of 1 / (1 + exp(-(a m + b))) by Newton's method, with the usual smoothed targets."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum(), (p - t).sum()])
        w = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if abs(step).max() < 1e-7:
            break
    return a, b
