"""Document fingerprints: SimHash with DataFrame functions only.

The terms of a text are its lower-cased words in runs of `shingle`; a term's weight is how often the text has it. Each term's
hash votes on the signed bits of the fingerprint, with its weight. The votes are plain sums: two bit counters of 32 bits
share one long, so that 32 sums count 64 bits, and are partial sums of the task that holds the text. Nothing but the
counters of a text ever leaves it.

All fingerprints within a Hamming radius of given ones are found by permuted block tables: the fingerprint is cut into
radius + 1 blocks, table t leads with block t, and what agrees on a leading block is compared in full.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kabund.llm.common import text_of, written

#: 64-bit words of a fingerprint, and words of a term.
WORDS, SHINGLE = 2, 3
#: Low bits of the two counters that share a long.
_PAIR = (1 << 32) + 1


def term_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """array<long>: the hash of each run of `shingle` words; of the whole text if it has fewer words, none if it has none."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 0)

    def over(words: Column) -> Column:
        n = F.size(words) - F.lit(shingle - 1)
        runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*[F.element_at(words, i + F.lit(k)) for k in range(shingle)]))
        return F.when(n >= 1, runs).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))

    # a lambda's argument is computed once, a column that is used twice may be computed twice
    return F.element_at(F.transform(F.array(words), over), 1)


def _sums(h: Column, words: int) -> list[Column]:
    out = []
    for w in range(words):
        own = h if w == 0 else F.when(h.isNotNull(), F.xxhash64(h + F.lit(w)))  # the hash of a null is not null
        for i in range(32):
            out.append(F.sum(F.shiftrightunsigned(own, i).bitwiseAND(F.lit(_PAIR))).alias(f"_s{w}_{i}"))
    return out


def _vote(w: int, count: str = "_n") -> Column:
    """The long of word w: a bit is set where more than half of the weights vote for it."""
    bits = F.lit(0).cast("long")
    for i in range(32):
        s = F.coalesce(F.col(f"_s{w}_{i}"), F.lit(0).cast("long"))
        low, high = s.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(s, 32)
        for at, votes in ((i, low), (i + 32, high)):
            one = (1 << at) - (1 << 64 if at == 63 else 0)
            bits = bits.bitwiseOR(F.when(votes * 2 > F.col(count), F.lit(one).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def fingerprint_columns(rows: DataFrame, keys: list[str], text: Column, carry: tuple[str, ...] = (), shingle: int = SHINGLE, words: int = WORDS) -> DataFrame:
    """keys, carry and f0, f1, ... (longs): the fingerprint of each row's text; keys tell rows apart, carry are numbers that
    go along."""
    terms = rows.select(*keys, *carry, F.explode_outer(term_hashes(text, shingle)).alias("_h"))
    summed = terms.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carry], F.count("_h").alias("_n"), *_sums(F.col("_h"), words))
    return summed.select(*keys, *carry, *[_vote(w).alias(f"f{w}") for w in range(words)])


def as_hex(*words: Column) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(w), 16, "0") for w in words]))


def hamming(a: list[Column], b: list[Column]) -> Column:
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def likeness(distance: Column, bits: int) -> Column:
    """The share of differing bits estimates the angle between two texts' term vectors; this is its cosine, 0 at least."""
    return F.greatest(F.lit(0.0), F.round(F.cos(distance.cast("double") * F.lit(math.pi / bits)), 12))


def _bounds(ids: DataFrame, buckets: int) -> list[int]:
    """At most `buckets` - 1 ids that cut all ids into ranges of about the same number of rows."""
    at = ids.agg(F.percentile_approx("_id", [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] if buckets > 1 else []
    return sorted(set(at or []))


def _range_of(x: Column, bounds: list[int]) -> Column:
    """How many bounds are under x (0 for null): searched for among every k-th bound first, then among the k that follow."""
    if not bounds:
        return F.lit(0)
    k = math.isqrt(len(bounds)) + 1
    under = lambda some: F.size(F.filter(some, lambda b: b < x))
    all_bounds = F.lit(bounds).cast("array<bigint>")
    coarse = under(F.lit(bounds[k - 1 :: k] or bounds[:0] or [2**63 - 1]).cast("array<bigint>"))
    at = coarse * F.lit(k)
    return F.when(x.isNull(), 0).otherwise(at + under(F.slice(all_bounds, at + 1, F.lit(k))))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """_bucket, _rn, _id, _text, _next: each document's text and that of the next one, by descending doc_id; after the last
    comes the first. Documents of one doc_id are ordered by their text; a null doc_id comes last in descending order.

    Ids are cut into ranges of about equal size, and each range gets the greatest document of the ranges before it as well, so
    no task sees more than a range. Only the ranges' bounds and greatest ids, whose number is fixed, reach the driver.
    """
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("_text"))
    ids = rows.select("_id")
    bounds = _bounds(ids, buckets)
    bucket = _range_of(F.col("_id"), bounds)
    greatest = {r[0]: r[1] for r in ids.groupBy(bucket.alias("_b")).agg(F.max("_id")).collect()}
    filled = sorted(greatest)
    following = dict(zip(filled, [*filled[1:], *filled[:1]], strict=True))
    # by range: its greatest id, and the range that gets it as well
    places = range(len(bounds) + 1)
    last = F.element_at(F.lit([greatest.get(b, 0) if greatest.get(b) is not None else 0 for b in places]).cast("array<bigint>"), F.col("_bucket") + 1)
    to = F.element_at(F.lit([following.get(b, 0) for b in places]).cast("array<int>"), F.col("_bucket") + 1)
    empty = F.lit([b in greatest and greatest[b] is None for b in places])
    at_end = F.when(F.element_at(empty, F.col("_bucket") + 1), F.col("_id").isNull()).otherwise(F.coalesce(F.col("_id") == last, F.lit(False)))
    rows = rows.withColumn("_bucket", bucket.cast("int"))
    halo = F.when(at_end, to)
    # of equal greatest ids all go along, the order below picks the last; in the first range what goes along is the last of all
    dealt = rows.withColumn("_to", F.array_compact(F.array(F.struct("_bucket", F.lit(True).alias("_own")), F.when(halo.isNotNull(), F.struct(halo.alias("_bucket"), F.lit(False).alias("_own"))))))
    dealt = dealt.select("_id", "_text", F.explode("_to").alias("_to")).select("_to._bucket", "_to._own", "_id", "_text")
    order = Window.partitionBy("_bucket").orderBy("_own", F.col("_id").asc_nulls_first(), "_text")
    placed = dealt.select("*", F.row_number().over(order).alias("_rn"), F.lag("_text").over(order).alias("_next"))
    return placed.where("_own").select("_bucket", "_rn", "_id", "_text", "_next")


def edited_text(text: Column, following: Column) -> Column:
    """text, its last third (whole code points, rounded down) replaced by as much of the start of what follows."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3, words: int = WORDS) -> DataFrame:
    """(q, n): of each query, how many index rows have a fingerprint within the radius, by permuted block tables.

    queries: q and f0, f1, ...; index: f0, f1, .... Equal fingerprints are counted once and weighted, so that a large group of
    copies is one entry. Exact: with radius + 1 blocks, one block at least is equal. Queries with null words find nothing.
    """
    bits = 64 * words
    cuts = [bits * i // (radius + 1) for i in range(radius + 2)]

    def tables(df: DataFrame, *keep: str) -> DataFrame:
        keys = []
        for t, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            parts = []
            for w in range(words):  # the block's bits of each word, the rest masked
                mask = sum(1 << (i - 64 * w) for i in range(max(a, 64 * w), min(b, 64 * w + 64)))
                if mask:
                    parts.append(F.col(f"f{w}").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
            keys.append(F.xxhash64(F.lit(t), *parts))
        return df.select(*keep, *[f"f{w}" for w in range(words)], F.explode(F.array(*keys)).alias("_block"))

    fs = [f"f{w}" for w in range(words)]
    held = index.groupBy(*fs).agg(F.count("*").alias("_weight"))
    asked = tables(queries.select(*fs).distinct()).select(*[F.col(f).alias(f"q{f}") for f in fs], "_block")
    near = asked.join(tables(held, "_weight"), "_block").where(hamming([F.col(f"q{f}") for f in fs], [F.col(f) for f in fs]) <= radius)
    found = near.select(*[f"q{f}" for f in fs], *fs, "_weight").distinct().groupBy(*[f"q{f}" for f in fs]).agg(F.sum("_weight").alias("n"))
    same = [queries[f].eqNullSafe(found[f"q{f}"]) for f in fs]
    cond = same[0]
    for x in same[1:]:
        cond = cond & x
    return queries.join(found, cond, "left").select("q", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def document_fingerprints(docs: DataFrame, every: int = 50, radius: int = 3) -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    n_within.

    A null text counts as empty; an empty text's fingerprint is zero. near_* are the cosine estimated from the
    share of differing bits: 1 for equal texts, 0 for texts without common terms. n_within is a search: for each doc_id
    divisible by `every`, how many documents (itself included) have a fingerprint within `radius` bits; null for the others.
    Other columns of docs are ignored. Repeated rows stay repeated. An empty table gives an empty one.
    """
    rows = with_next(docs)
    edited = edited_text(F.col("_text"), F.col("_next"))
    sha = rows.select("_bucket", "_rn", "_id", F.length("_text").cast("long").alias("_chars"), "_text", edited.alias("_edited"))
    sha = sha.withColumn("_sha", F.sha2(F.col("_edited").cast("binary"), 256))
    parts = [F.conv(F.substring("_sha", 16 * i + 1, 16), 16, -10).cast("long").alias(f"_h{i}") for i in range(4)]
    both = sha.select("_bucket", "_rn", "_id", "_chars", *parts, F.posexplode(F.array("_text", "_edited")).alias("_which", "_of"))
    carry = ("_id", "_chars", "_h0", "_h1", "_h2", "_h3")
    each = fingerprint_columns(both, ["_bucket", "_rn", "_which"], F.col("_of"), carry)
    own = [F.max(F.when(F.col("_which") == 0, F.col(f"f{w}"))).alias(f"f{w}") for w in range(WORDS)]
    other = [F.max(F.when(F.col("_which") == 1, F.col(f"f{w}"))).alias(f"e{w}") for w in range(WORDS)]
    one = written(each.groupBy("_bucket", "_rn").agg(*[F.max(c).alias(c) for c in carry], *own, *other), "fingerprints")
    # the next document's fingerprint: the row before, in the same range or as the last of the range before
    ends = one.groupBy("_bucket").agg(*[F.max_by(f"f{w}", "_rn").alias(f"l{w}") for w in range(WORDS)])
    ring = Window.orderBy("_bucket")  # over one row for each range, whose number is fixed
    ends = ends.select("_bucket", *[F.coalesce(F.lag(f"l{w}").over(ring), F.last(f"l{w}").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias(f"l{w}") for w in range(WORDS)])
    order = Window.partitionBy("_bucket").orderBy("_rn")
    placed = one.join(ends, "_bucket").select("*", *[F.coalesce(F.lag(f"f{w}").over(order), F.col(f"l{w}")).alias(f"n{w}") for w in range(WORDS)])
    f, e, n = ([F.col(f"{x}{w}") for w in range(WORDS)] for x in "fen")
    asked = one.where(F.col("_id") % every == 0).select(F.col("_id").alias("q"), "f0", "f1")
    counts = within_radius(asked.distinct(), one, radius).groupBy("q").agg(F.max("n").alias("n_within"))
    return placed.join(counts, F.col("_id") == F.col("q"), "left").select(
        F.col("_id").alias("doc_id"),
        F.col("_chars").alias("n_chars"),
        as_hex(*[F.col(f"_h{i}") for i in range(4)]).alias("edited_sha256"),
        as_hex(*f).alias("fingerprint"),
        as_hex(*e).alias("edited_fingerprint"),
        likeness(hamming(f, e), 64 * WORDS).alias("near_edited"),
        likeness(hamming(f, n), 64 * WORDS).alias("near_next"),
        "n_within",
    )
