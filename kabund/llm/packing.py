"""Conflict-constrained best-fit packing of token sequences.

Documents are tokenized and cut into pieces of at most `capacity` tokens; pieces go into bins of that capacity. A bin never holds
two pieces of one source, nor two documents of one duplicate cluster: it carries bitmaps of both. Bins are kept in the order of
their residuals; a piece takes the tightest bin that has room for it and no conflict, found by stepping from successor to
successor, and opens a new bin if there is none. A bin is given out as the tokens of its pieces, one after another, with a segment
for each piece.

Near copies share a cluster: without clusters of the caller's own, a document is in `sketch` clusters, the minima of as many
hashes over its runs of five tokens. Two documents whose sets of runs have a likeness of j conflict with a chance of
1 - (1 - j)^sketch, which is all but one pair in 15,625 at 0.8; exact copies always do.

Pieces are dealt to blocks of a bounded number of pieces by a hash of the row's own number, and each block is packed on its own
(largest first), so that memory is bounded whatever the ids, and blocks run side by side; a block leaves about one bin in a few
hundred less full.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kabund.llm.common import bounded_batches, text_of, written
from kabund.llm.token_counts import TokenFileParams, encoder, vocabulary_of

#: Tokens of a run, and tokens whose runs are hashed at a time.
RUN, CHUNK = 5, 1 << 16
BINS = "bin string, n_tokens int, residual int, segments array<struct<doc_id: long, piece: int, start: long, n_tokens: int, offset: int>>, tokens binary"


@dataclass(frozen=True)
class PackParams:
    """capacity: tokens of a bin. block_pieces: about the number of pieces that are packed together. sketch: clusters of a document.
    tokens: the vocabulary, and the width in which tokens are kept."""

    capacity: int = 2048
    block_pieces: int = 2000
    sketch: int = 6
    tokens: TokenFileParams = field(default_factory=TokenFileParams)

    def __post_init__(self) -> None:
        if self.capacity < 1 or self.block_pieces < 1 or self.sketch < 0:
            raise ValueError("capacity and block_pieces must be positive, and sketch not negative")


def clusters_of(tokens: np.ndarray, sketch: int) -> list[int]:
    """The least of each of `sketch` hashes over the runs of tokens; of all tokens where they are fewer than a run."""
    if not len(tokens) or not sketch:
        return []
    draw = np.random.Generator(np.random.PCG64(5))
    a, x = draw.integers(0, 1 << 64, size=(2, sketch, 1), dtype=np.uint64)
    width = min(RUN, len(tokens))
    least = np.full(sketch, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(tokens) - width + 1, CHUNK):
            t = tokens[at : at + CHUNK + width - 1].astype(np.uint64)
            h = t[: len(t) - width + 1].copy()
            for k in range(1, width):
                h = h * np.uint64(0x9E3779B97F4A7C15) + t[k : len(t) - width + 1 + k]
            h ^= h >> np.uint64(31)
            np.minimum(least, ((h[None, :] ^ x) * (a | np.uint64(1))).min(axis=1), out=least)
    return (least.astype(np.int64) ^ np.arange(sketch)).tolist()


def best_fit(sizes: list[int], sources: list[object], clusters: list[list], capacity: int) -> list[int]:
    """The bin (from 0) of each piece, in the order given. clusters: those of each piece; what one piece alone has is no conflict."""
    shared = Counter(c for cs in clusters for c in cs)
    bit_of: tuple[dict, dict] = ({}, {})
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out = []
    for size, source, own in zip(sizes, sources, clusters, strict=True):
        s_bit = 1 << bit_of[0].setdefault(source, len(bit_of[0]))
        c_bit = 0
        for c in own:
            if shared[c] > 1:
                c_bit |= 1 << bit_of[1].setdefault(c, len(bit_of[1]))
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not (source_bits[b] & s_bit or cluster_bits[b] & c_bit):
                break
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[b] |= s_bit
        cluster_bits[b] |= c_bit
        if residual > size:  # a full bin takes nothing more
            insort(open_bins, (residual - size, b))
        out.append(b)
    return out


def pieces(docs: DataFrame, p: PackParams, cluster: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """(row, doc_id, source, clusters, piece, start, n, tokens), written: the pieces of each row's tokens, from place `start` on."""
    spark = docs.sparkSession
    bounded_batches(spark)
    vocabulary = spark.sparkContext.broadcast(vocabulary_of(p.tokens))
    dtype, capacity, sketch = np.dtype(p.tokens.dtype), p.capacity, p.sketch

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary.value).encode_to_numpy
        for b in batches:
            rows = []
            for row, d, source, own, text in zip(b["row"].tolist(), b["doc_id"].astype("Int64"), b["source"], b["cluster"], b["text"], strict=True):
                t = encode(text, disallowed_special=()).astype(dtype)
                clusters = [int(own)] if own is not None else clusters_of(t, sketch)
                for k in range(max(1, -(-len(t) // capacity))):
                    part = t[k * capacity : (k + 1) * capacity]
                    rows.append((row, d, source, clusters, k, k * capacity, len(part), part.tobytes()))
            yield pd.DataFrame(rows, columns=["row", "doc_id", "source", "clusters", "piece", "start", "n", "tokens"]).astype({"doc_id": "Int64"})

    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    own = F.lit(None).cast("string") if cluster is None else F.xxhash64(cluster).cast("string")  # as text: a null leaves the others whole
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), own.alias("cluster"), text_of().alias("text"))
    cut = rows.mapInPandas(of, "row long, doc_id long, source string, clusters array<long>, piece int, start long, n int, tokens binary")
    return written(cut, "pieces")


def pack(docs: DataFrame, p: PackParams = PackParams(), cluster: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """(bin, n_tokens, residual, segments, tokens), one row for each bin: a document of n tokens has ceil(n / capacity) pieces.

    segments: of each piece in the bin, in order, its doc_id, number, place in the document's tokens, size and place in the bin. tokens: the
    bin's token ids, as p.tokens.dtype has them. cluster: what documents that must not meet have in common (see above if
    none is given). A document without tokens (a null or empty text) has one piece of size 0. A null source is a value like any
    other, and all rows of a table without that column have it; a null doc_id stays null; repeated rows are packed each. Other
    columns are ignored; an empty table gives an empty one.
    """
    cut = pieces(docs, p, cluster, id_col)
    blocks = max(1, -(-cut.count() // p.block_pieces))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)).cast("int")).repartition("block")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the rows of one block, which are together and in order

        def packed() -> pd.DataFrame:
            b = pd.concat(held, ignore_index=True)
            held.clear()
            clusters = [[] if c is None else list(c) for c in b["clusters"]]
            bins = best_fit(b["n"].tolist(), b["source"].tolist(), clusters, p.capacity)
            members: list[list[int]] = [[] for _ in range(max(bins) + 1)]
            for i, x in enumerate(bins):
                members[x].append(i)
            ids, number, start, n, tokens = (b[c].tolist() for c in ("doc_id", "piece", "start", "n", "tokens"))
            rows = []
            for x, of_bin in enumerate(members):
                segments, at = [], 0
                for i in of_bin:
                    segments.append({"doc_id": None if ids[i] is pd.NA else ids[i], "piece": number[i], "start": start[i], "n_tokens": n[i], "offset": at})
                    at += n[i]
                rows.append((f"{b['block'].iat[0]}-{x}", at, p.capacity - at, segments, b"".join(tokens[i] for i in of_bin)))
            return pd.DataFrame(rows, columns=["bin", "n_tokens", "residual", "segments", "tokens"])

        for batch in batches:
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            for _, part in batch.groupby("block", sort=False):
                if held and held[0]["block"].iat[0] != part["block"].iat[0]:
                    yield packed()
                held.append(part)
        if held:
            yield packed()

    return dealt.sortWithinPartitions("block", F.desc("n"), "row", "piece").mapInPandas(of, BINS)


def placed(bins: DataFrame) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin, offset, residual): a row for each piece."""
    s = F.col("_s")
    return bins.select("bin", "residual", F.explode("segments").alias("_s")).select(s["doc_id"].alias("doc_id"), s["piece"].alias("piece"), s["start"].alias("start"), s["n_tokens"].alias("n_tokens"), "bin", s["offset"].alias("offset"), "residual")
