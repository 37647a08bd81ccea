"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters (lower case, runs of anything but letters and digits as one space) is found in a text that holds
it within floor(rate * n) edits. It is split into one piece more than that, so one piece at least stands there unchanged.
All pieces' exact hits come from one Aho-Corasick automaton over the pieces; around a hit, the item's least distance to
any part of the text is computed by Myers' bit-parallel algorithm (1999), a column of the matrix in one integer.

Items go to the tasks in blocks of a bounded number of characters, with a pass over the documents for each block: a
benchmark of any size is handled, and one within the bound takes one pass.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kabund.llm.common import bounded_batches, text_of

_APART = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class MatchParams:
    """rate: edits for each character of an item. block_chars: characters of the items of a pass."""

    rate: float = 0.08
    block_chars: int = 8_000_000


def normal(text: str) -> str:
    return _APART.sub(" ", text.lower()).strip()


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """(place, piece): floor(rate * n) + 1 pieces of about equal length; none of an empty item."""
    n = len(item)
    k = int(rate * n) + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def nearest(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least distance of the item to a part of text, the end of the first such part): the part may start anywhere."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    get = peq.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, at = score, j
    return best, at


class Matcher:
    """Finds all items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        texts = [(i, normal(t or "")) for i, t in items]
        self.items = [(i, t, int(rate * len(t)), masks(t)) for i, t in texts if t]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, t, _, _) in enumerate(self.items):
            for at, piece in pieces(t, rate):
                where[piece].append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item that is there: its nearest part, places in the normal text; the
        start is that of the hit's window, at most the budget before the part."""
        if self.empty:
            return
        t = normal(text)
        starts: dict[int, list[int]] = defaultdict(list)
        for end, (size, places) in self.automaton.iter(t):
            for k, at in places:
                starts[k].append(end + 1 - size - at)
        for k, places in starts.items():
            item, pattern, budget, peq = self.items[k]
            m, best = len(pattern), (budget + 1, 0, 0)
            places.sort()
            i = 0
            while i < len(places):  # hits whose windows meet are read once
                low = max(0, places[i] - budget)
                high = places[i] + m + budget
                i += 1
                while i < len(places) and places[i] - budget <= high:
                    high = places[i] + m + budget
                    i += 1
                distance, end = nearest(peq, m, t[low:high])
                if distance < best[0]:
                    best = (distance, max(low, low + end - m - distance), low + end)
            if best[0] <= budget:
                yield item, *best


_matchers: dict[str, Matcher] = {}


def matcher_of(given: tuple, rate: float) -> Matcher:
    """The matcher of a block (name, broadcast), made once in each Python worker and kept until another block comes."""
    name, items = given
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(items.value, rate)
    return _matchers[name]


def _blocks(benchmark: DataFrame, p: MatchParams) -> Iterator:
    """Names and broadcasts of (item_id, text) of all items, each of about p.block_chars characters at most."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of("text").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // p.block_chars))
    for block in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        yield uuid.uuid4().hex, spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in some.collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame, p: MatchParams = MatchParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, end): a row for each row of docs and each row of benchmark found in it.

    Null texts, and texts and items without letters and digits, match nothing. A null doc_id or item_id stays null. Repeated
    rows on either side give repeated results. Other columns are ignored; an empty table on either side gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    schema = "doc_id long, item_id long, distance int, start int, end int"
    out = None
    for given in _blocks(benchmark, p):

        def of(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            matcher = matcher_of(given, p.rate)
            for b in batches:
                found = [(d, *x) for d, t in zip(b["doc_id"].tolist(), b["text"], strict=True) for x in matcher.find(t)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "distance", "start", "end"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        found = rows.mapInPandas(of, schema)
        out = found if out is None else out.union(found)
    return out


def clean_only(docs: DataFrame, benchmark: DataFrame, p: MatchParams = MatchParams(), text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds a benchmark item; all columns stay.

    Rows are judged where they are, so that repeated ids and null ids keep their own decisions. Null and empty texts hold nothing.
    """
    bounded_batches(docs.sparkSession)
    for given in _blocks(benchmark, p):
        docs = docs.where(_holds_none(given, p.rate)(text_of(text_col)))
    return docs


def _holds_none(given: tuple, rate: float):
    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = matcher_of(given, rate)
        for t in texts:
            yield pd.Series([next(matcher.find(x), None) is None for x in t], dtype=bool)

    return clean
