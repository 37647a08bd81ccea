"""SimHash near-duplicates by BK-trees over shards of fingerprints.

A fingerprint is the majority vote of the bits of its shingles' hashes. Fingerprints at a Hamming distance up to a radius
are linked; linked documents form components. Candidate search works on distinct fingerprints: each goes to a shard for
each table (a set of bit positions; the shard is the value of these bits), a shard's fingerprints are put in a BK-tree
(children keyed by their Hamming distance to the parent), and a search follows only the edges between distance minus
radius and distance plus radius. With more disjoint tables than the radius, no link can be missed (pigeonhole); with fewer
or overlapping tables, the chance of a miss is (1 - (1 - r/b)^k)^tables for k bits a table.

Shards are split into sub-shards of a bounded number of fingerprints. Each sub-shard has its own tree, and the other
fingerprints of the shard are sent to it as searches: trees have a bounded size, whatever one shard's share of all rows is.
Trees are not sent to all tasks, as all trees together grow with the corpus; the searches are sent to the trees instead.
A task reports a spanning forest of what it found, not all pairs.

Near copies by a Jaccard likeness (near_components, keep_one) start from the same search: fingerprints of the shingle sets, shards,
BK-trees, and what these link is kept if the sets themselves are alike enough. At 0.8, 15 % of the bits differ, and tables of sampled bits
miss some: links that the trees leave are looked for by MinHash bands, among what is still apart, and the sets decide again.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kabund.llm.common import bounded_batches, row_key, text_of, written
from kabund.llm.components import connected_components

#: Shingles whose votes are counted at a time, so that a very long text takes bounded memory.
CHUNK = 1 << 15
_LANES = np.uint64(0x0101010101010101)


@dataclass(frozen=True)
class SimHashParams:
    """shingle: words of a shingle. words: 64-bit words of a fingerprint. radius: greatest Hamming distance of a link.
    tables: bit positions of each table. shard_rows: fingerprints of a tree."""

    shingle: int = 3
    words: int = 1
    radius: int = 2
    tables: tuple[tuple[int, ...], ...] = ()
    shard_rows: int = 4096

    def __post_init__(self) -> None:
        if self.shingle < 1 or self.words < 1 or self.radius < 0 or self.shard_rows < 1:
            raise ValueError("shingle, words and shard_rows must be positive, and radius not negative")


def pigeonhole_tables(bits: int, radius: int) -> tuple[tuple[int, ...], ...]:
    """radius + 1 disjoint blocks: two fingerprints within the radius agree on one of them at least."""
    edges = [bits * i // (radius + 1) for i in range(radius + 2)]
    return tuple(tuple(range(a, b)) for a, b in zip(edges, edges[1:], strict=False))


def sampled_tables(bits: int, width: int, tables: int, seed: int = 1) -> tuple[tuple[int, ...], ...]:
    """Tables of `width` bit positions drawn at random, for radii too wide for the pigeonhole principle."""
    draw = random.Random(seed)
    return tuple(tuple(sorted(draw.sample(range(bits), width))) for _ in range(tables))


#: Contract of op1: 3-word shingles, 64 bits, 2 differing bits, exact.
EXACT_2 = SimHashParams(shingle=3, words=1, radius=2, tables=pigeonhole_tables(64, 2))
@dataclass(frozen=True)
class NearParams:
    """shingle: words of a shingle. like: least Jaccard likeness of a link, as (numerator, denominator). bands, rows: MinHash keys of
    a document, and the minima in each; a pair at likeness j shares a key with a chance of 1 - (1 - j^rows)^bands. pivots: nodes of a
    key that all others are checked against before any pair is. minima: of a signature; pairs with too few in common are not checked.
    words, radius, tables: of the fingerprints that BK-trees search before; at 0.8 they differ by 19 of 128 bits, give or take 4."""

    shingle: int = 5
    like: tuple[int, int] = (4, 5)
    bands: int = 20
    rows: int = 4
    pivots: int = 16
    minima: int = 160
    words: int = 2
    radius: int = 30
    tables: int = 16

    def simhash(self, nodes: int) -> SimHashParams:
        """Shards of a few of that many nodes on average, so that the search grows with the nodes and not with their square."""
        return SimHashParams(self.shingle, self.words, self.radius, sampled_tables(64 * self.words, min(40, max(8, nodes.bit_length() - 2)), self.tables))

    def least_common(self) -> int:
        """Minima that two sets right at `like` have in common, less 4.5 deviations: at 0.8, 105 of 160."""
        n, j = self.minima, self.like[0] / self.like[1]
        return max(1, int(n * j - 4.5 * (n * j * (1 - j)) ** 0.5))

    def __post_init__(self) -> None:
        if self.shingle < 1 or self.bands < 1 or self.rows < 1 or self.pivots < 1 or self.minima < self.bands * self.rows or not 0 < self.like[0] <= self.like[1]:
            raise ValueError("shingle, bands and rows must be positive, and like in (0, 1]")
        if self.words < 1 or self.radius < 0 or self.tables < 1:
            raise ValueError("words and tables must be positive, and radius not negative")


#: Near copies: a Jaccard likeness of 0.8 or more of the sets of 5-word shingles. At 0.8 one pair in some 38,000 has no key in common.
NEAR_08 = NearParams()


def shingle_hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the text's shingles, in chunks."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        yield np.array([digest(joined, 42)], dtype=np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    for at in range(0, n, CHUNK):
        a, b = starts[at : min(n, at + CHUNK)].tolist(), ends[at + shingle - 1 : min(n, at + CHUNK) + shingle - 1].tolist()
        yield np.fromiter((digest(joined[i:j], 42) for i, j in zip(a, b, strict=True)), dtype=np.uint64, count=len(a))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of h have each of the 64 bits. Eight bits are counted at once in the bytes of a word."""
    out = np.zeros(64, dtype=np.int64)
    full = len(h) // 255 * 255
    for part in (h[:full].reshape(-1, 255), h[full:].reshape(1, -1)):
        if part.size:
            for i in range(8):
                lanes = ((part >> np.uint64(i)) & _LANES).sum(axis=1, dtype=np.uint64)
                out[i::8] += lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def _spread(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits of a hash (the finaliser of SplitMix64); the hash itself for the first word."""
    if word == 0:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * word) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(text: str, p: SimHashParams) -> str:
    """Lower-case hexadecimal digits, 16 for each word; zeros for a text without words."""
    counts, n = np.zeros((p.words, 64), dtype=np.int64), 0
    for h in shingle_hashes(text, p.shingle):
        n += len(h)
        for w in range(p.words):
            counts[w] += _bit_counts(_spread(h, w))
    return _digits(counts, n)


def _digits(counts: np.ndarray, n: int) -> str:
    return "".join(f"{sum(1 << int(i) for i in np.flatnonzero(2 * c > n)):016x}" if n else "0" * 16 for c in counts)


def fingerprints(docs: DataFrame, p: SimHashParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for each row. A null text counts as empty; other columns are ignored."""
    bounded_batches(docs.sparkSession)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fingerprint": [fingerprint(t, p) for t in b["text"]]}).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(of, "doc_id long, fingerprint string")


class BKTree:
    """Distinct integers under the Hamming distance."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: tuple | None = None  # (value, label, {distance: child})

    def add(self, value: int, label: int) -> None:
        if self.root is None:
            self.root = (value, label, {})
            return
        node = self.root
        while True:
            d = (value ^ node[0]).bit_count()
            child = node[2].get(d)
            if child is None:
                node[2][d] = (value, label, {})
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        """Labels of the values at up to radius from value."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            at, label, children = stack.pop()
            d = (value ^ at).bit_count()
            if d <= radius:
                out.append(label)
            if children:
                low, high = d - radius, d + radius
                if len(children) > 2 * radius + 1:
                    stack.extend(children[e] for e in range(max(low, 1), high + 1) if e in children)
                else:
                    stack.extend(c for e, c in children.items() if low <= e <= high)
        return out


class _Forest:
    """Union-find over the labels of one sub-shard."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[x] = y
        return x != y


def _shard_keys(p: SimHashParams):
    """Of each fingerprint and table, the table's number and the value of its bits in one integer."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = np.array([[int(fp[i : i + 16], 16) for i in range(0, 16 * p.words, 16)] for fp in b["fp"]], dtype=np.uint64).reshape(-1, p.words)
            keys = np.zeros((len(words), len(p.tables)), dtype=np.uint64)
            for n, bits in enumerate(p.tables):
                for i, bit in enumerate(bits):
                    keys[:, n] |= ((words[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)) << np.uint64(i)
                keys[:, n] |= np.uint64(n << 48)
            yield b.assign(shards=list(keys.astype(np.int64)))

    return of


def _search_shards(radius: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tree, forest = None, BKTree(), _Forest()
        for b in batches:
            u: list[int] = []
            v: list[int] = []
            for shard, sub, probe, fp, rep in zip(b["shard"].tolist(), b["sub"].tolist(), b["probe"].tolist(), b["fp"].tolist(), b["rep"].tolist(), strict=True):
                if (shard, sub) != key:
                    key, tree, forest = (shard, sub), BKTree(), _Forest()
                value = int(fp, 16)
                found = tree.within(value, radius)
                if probe:  # what this value brings together needs no entry of its own
                    kept = {}
                    for x in found:
                        kept.setdefault(forest.top(x), x)
                    for x in kept.values():
                        u.append(rep)
                        v.append(x)
                    first = next(iter(kept), None)
                    for x in kept:
                        forest.join(x, first)
                else:
                    for x in found:
                        if forest.join(rep, x):
                            u.append(rep)
                            v.append(x)
                    tree.add(value, rep)
            yield pd.DataFrame({"u": np.array(u, dtype=np.int64), "v": np.array(v, dtype=np.int64)})

    return of


def links(distinct: DataFrame, p: SimHashParams) -> DataFrame:
    """Edges (u, v) between labels that connect just the fingerprints within the radius of each other.

    distinct: fp (hexadecimal digits) and rep (a long that stands for it alone), one row for each fingerprint.
    """
    if not p.tables:
        raise ValueError("no tables")
    bounded_batches(distinct.sparkSession)
    rows = distinct.select("fp", "rep").mapInPandas(_shard_keys(p), "fp string, rep long, shards array<long>").select("fp", "rep", F.explode("shards").alias("shard"))
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    # sub-shards of a bounded size; a row enters its own tree, and searches those of the lower numbers
    sized = rows.join(sizes, "shard").withColumn("subs", F.ceil(F.col("n") / F.lit(p.shard_rows)).cast("int"))
    placed = sized.withColumn("own", F.pmod(F.xxhash64("fp", "shard"), F.col("subs")).cast("int")).select("fp", "rep", "shard", "own", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("sub"))
    placed = placed.select("shard", "sub", (F.col("sub") < F.col("own")).alias("probe"), "fp", "rep")
    dealt = placed.repartition("shard", "sub").sortWithinPartitions("shard", "sub", "probe", "rep")
    return dealt.mapInPandas(_search_shards(p.radius), "u long, v long")


def label_of(fp: Column) -> Column:
    """A long for a fingerprint: itself if it has one word, else numbers of rows would have to stand for it."""
    return F.conv(fp, 16, -10).cast("long")


def simhash_components(docs: DataFrame, p: SimHashParams = EXACT_2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs.

    What is linked are fingerprints (of one 64-bit word), whatever documents have them: rows that repeat a doc_id with other texts
    stay apart, and rows without a doc_id link like any other. component_id is the smallest doc_id of all rows that can be
    reached, itself included; null where none of them has a doc_id. Null and empty texts, and texts of white space, have the
    fingerprint zero and are linked like any other. Repeated rows stay repeated. An empty table gives an empty one.
    """
    if p.words != 1:
        raise ValueError("components are of fingerprints of one word")
    fps = written(fingerprints(docs, p, id_col, text_col), "fingerprints")
    distinct = fps.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")).withColumn("rep", label_of(F.col("fp")))
    components = connected_components(links(distinct, p))
    named = distinct.join(components, F.col("rep") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "rep").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = named.join(ids, "component").select("fp", "component_id")
    return fps.join(of_fp, F.col("fingerprint") == F.col("fp"), "left").select("doc_id", "fingerprint", "component_id")


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending."""
    parts = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.array([], dtype=np.uint64)


def set_fingerprint(h: np.ndarray, words: int) -> str:
    """As fingerprint(), of a set of hashes: what repeats in the text counts once."""
    return _digits(np.array([_bit_counts(_spread(h, w)) for w in range(words)]), len(h))


def _set_digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.astype("<u8").tobytes(), digest_size=16).digest()


def signature(h: np.ndarray, p: NearParams) -> tuple[list[int], list[int]]:
    """A key for each band: a hash of the band's number and of its minima over the set, which must not be empty. And 16 bits of each
    minimum, behind its number."""
    draw = np.random.Generator(np.random.PCG64(8))
    a, x = draw.integers(0, 1 << 64, size=(2, p.minima, 1), dtype=np.uint64)
    least = np.full(p.minima, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 1 << 11):
            z = (h[None, at : at + (1 << 11)] ^ x) * (a | np.uint64(1))
            np.minimum(least, z.min(axis=1), out=least)
    minima = least[: p.bands * p.rows].astype("<u8").reshape(p.bands, p.rows)
    short = (np.arange(len(least), dtype=np.int64) << 16) | (least & np.uint64(0xFFFF)).astype(np.int64)
    return [xxhash.xxh64_intdigest(row.tobytes(), n) - (1 << 63) for n, row in enumerate(minima)], short.tolist()


def _checked(pairs: DataFrame, sets: DataFrame, p: NearParams) -> DataFrame:
    """The pairs (u, v) whose sets are at least as alike as p.like; sets: node and set."""
    one = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("_a")), "u")
    both = one.join(sets.select(F.col("node").alias("v"), F.col("set").alias("_b")), "v")
    num, den = p.like
    na, nb = F.size("_a"), F.size("_b")
    sized = both.where((F.least(na, nb) * den >= F.greatest(na, nb) * num))
    shared = F.size(F.array_intersect("_a", "_b"))  # i / (na + nb - i) >= num / den
    return sized.where(shared * (num + den) >= (na + nb) * num).select(*pairs.columns)


def _close_pairs(nodes: DataFrame, p: SimHashParams) -> DataFrame:
    """(u, v), u < v: pairs of nodes (node, fp) that connect those whose fingerprints are within the radius of each other and share a shard."""
    of_fp = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    same = nodes.join(of_fp, "fp").where("node <> rep").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    found = links(of_fp, p)
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).union(same).distinct()


def _labelled(rows: DataFrame, at: str, found: DataFrame, name: str) -> DataFrame:
    """rows with the component that found (node, component) has for column `at`, or else what stands there."""
    f = found.select(F.col("node").alias("_f"), F.col("component").alias("_c"))
    return rows.join(f, F.col(at) == F.col("_f"), "left").withColumn(name, F.coalesce("_c", at)).drop("_f", "_c")


def near_components(rows: DataFrame, p: NearParams = NEAR_08) -> DataFrame:
    """(_a, _b, _id, c): of each row of rows (_a, _b: longs that tell rows apart, _id, _text: a text with words) the number of its component.

    Rows with one shingle set are one node. Nodes whose fingerprints the BK-trees link are candidates, and a link is kept only where the
    sets themselves are alike enough; so are, then, nodes that share a band key and are still apart. Of each key's nodes, all are first
    checked against p.pivots of them; what that has not brought together is then checked pair by pair. So a large group of copies
    costs a few checks a node, and no candidate is left out.
    """
    bounded_batches(rows.sparkSession)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, p.shingle) for t in b["_text"]]
            signs = [signature(h, p) for h in sets]
            yield pd.DataFrame({"_a": b["_a"], "_b": b["_b"], "_id": b["_id"].astype("Int64"), "digest": [_set_digest(h) for h in sets], "fp": [set_fingerprint(h, p.words) for h in sets], "n": [len(h) for h in sets], "keys": [s[0] for s in signs], "minima": [s[1] for s in signs]})

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, p.shingle) for t in b["_text"]]
            yield pd.DataFrame({"node": b["node"], "set": [h.view(np.int64) for h in sets]})

    signed = written(rows.mapInPandas(sign, "_a long, _b long, _id long, digest binary, fp string, n int, keys array<long>, minima array<int>"), "signatures")
    # numbered where they are written, so that a node keeps its number
    first = F.min(F.struct("_a", "_b")).alias("rep")
    nodes = signed.groupBy("digest").agg(first, F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("minima").alias("minima"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    close = written(_close_pairs(nodes.select("node", "fp"), p.simhash(nodes.count())), "close")
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    # the lowest node of a key in several orders, each the order of the numbers with other bits turned
    turns = [0, *(random.Random(3 + i).getrandbits(62) for i in range(p.pivots - 1))]
    least = [F.min(F.col("node").bitwiseXOR(F.lit(t).cast("long"))).alias(f"_l{i}") for i, t in enumerate(turns)]
    lows = F.array_distinct(F.array(*[F.col(f"_l{i}").bitwiseXOR(F.lit(t).cast("long")) for i, t in enumerate(turns)]))
    lowest = keyed.groupBy("key").agg(*least, F.count("*").alias("many")).where("many > 1").select("key", lows.alias("lows"))
    met = written(keyed.join(lowest, "key"), "met")
    asked = met.select("node").union(close.select("u")).union(close.select("v")).distinct()
    wanted = nodes.join(asked, "node", "left_semi").select("node", F.col("rep._a").alias("_a"), F.col("rep._b").alias("_b"))
    # a row that is there several times gives its node's set several times
    sets = written(rows.join(wanted, ["_a", "_b"]).select("node", "_text").mapInPandas(take, "node long, set array<long>").dropDuplicates(["node"]), "sets")

    by_trees = connected_components(_checked(close, sets, p))
    # of a node's keys together, so that a pair is made once and not at each key that both share
    asking = met.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("lows"))).alias("lows"))
    pairs = asking.select("node", F.explode("lows").alias("low")).where("node <> low").select(F.least("low", "node").alias("u"), F.greatest("low", "node").alias("v")).distinct()
    pairs = written(_labelled(_labelled(pairs, "u", by_trees, "l0"), "v", by_trees, "l1").where("l0 <> l1"), "pairs")
    by_keys = connected_components(_checked(pairs, sets, p).select(F.col("l0").alias("u"), F.col("l1").alias("v")))
    label = written(_labelled(_labelled(nodes.select("node"), "node", by_trees, "first"), "first", by_keys, "label").select("node", "label"), "labels")
    labelled = met.join(label, "node").select("key", "node", "n", "label")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    open_ = written(labelled.join(mixed, "key", "left_semi"), "open")
    open_ = open_.join(nodes.select("node", "keys", "minima"), "node")
    x, y = (open_.select("key", F.col("node").alias(f"n{i}"), F.col("n").alias(f"s{i}"), F.col("label").alias(f"l{i}"), F.col("keys").alias(f"k{i}"), F.col("minima").alias(f"m{i}")) for i in (0, 1))
    alike = F.least("s0", "s1") * p.like[1] >= F.greatest("s0", "s1") * p.like[0]
    # a pair is taken at the first key it shares; as its labels differ, all keys it shares are open
    alike = alike & (F.element_at(F.array_intersect("k0", "k1"), 1) == F.col("key"))
    alike = alike & (F.size(F.array_intersect("m0", "m1")) >= p.least_common())
    cross = x.join(y, "key").where((F.col("l0") < F.col("l1")) & alike)
    cross = cross.select(F.least("n0", "n1").alias("u"), F.greatest("n0", "n1").alias("v"), "l0", "l1").distinct().join(pairs.select("u", "v"), ["u", "v"], "left_anti")
    # what is left to join are components of the steps before, so that their rounds are not run again
    more = connected_components(_checked(cross, sets, p).select(F.col("l0").alias("u"), F.col("l1").alias("v")).distinct())
    joined = _labelled(nodes.select("node", "digest").join(label, "node"), "label", more, "c")
    return signed.select("_a", "_b", "_id", "digest").join(joined.select("digest", "c"), "digest").drop("digest")


def keep_one(docs: DataFrame, p: NearParams = NEAR_08, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, of several texts with one doc_id the one that comes first, of
    rows that repeat both the first by what its columns hold. All columns of docs stay.

    A row is told by its doc_id and its text, so that other texts with the same doc_id have components of their own. Rows
    without a doc_id take part, and stay only where no row of their component has one. Documents without any word are no copies
    of each other and stay, each row of them. An empty table gives an empty one.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_r"))
    ident, text = F.col("_r")[id_col].cast("long"), text_of(F.col("_r")[text_col])
    has_words = text.rlike(r"[^\x20\x09-\x0D]")
    a, b = row_key(ident, text)
    named = held.where(has_words).select(a.alias("_a"), b.alias("_b"), "_r")
    found = near_components(named.select("_a", "_b", ident.alias("_id"), text.alias("_text")), p)
    order = F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("i"), F.col("_a").alias("a"), F.col("_b").alias("b"))
    rows = found.groupBy("_a", "_b").agg(F.min("_id").alias("_id"), F.first("c").alias("c"), F.count("*").alias("_n")).withColumn("_o", order)
    # the least row of each component; rows that are alone in theirs and there once need no decision
    best = rows.groupBy("c").agg(F.min("_o").alias("_best"), F.count("*").alias("_rows"))
    decided = rows.join(best, "c").where("_rows > 1 or _n > 1").select("_a", "_b", (F.col("_o") == F.col("_best")).alias("_stays"), "_n")
    joined = named.join(decided, ["_a", "_b"], "left")
    once = joined.where("_stays is null or (_stays and _n = 1)").select("_r")
    many = joined.where("_stays and _n > 1").groupBy("_a", "_b").agg(F.min_by("_r", F.to_json("_r")).alias("_r")).select("_r")
    out = held.where(~has_words).unionByName(once).unionByName(many)
    return out.select(*[F.col("_r")[c].alias(c) for c in docs.columns])
