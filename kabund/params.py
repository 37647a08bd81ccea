"""Parameters of indexes and queries, and the logarithmic quantiser of abundances."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, replace
from functools import cached_property

#: Extra s-mers that a k-mer must have when neither this nor sampling is asked for.
DEFAULT_Z = 4
NORMALIZE_TO = 1_000_000


@dataclass(frozen=True)
class Sampling:
    """kind: none, kmer or minimizer. zero_bits: low bits of the hash that must be zero, which keeps about 1 in 2^bits."""

    kind: str = "none"
    zero_bits: int = 0

    def __post_init__(self) -> None:
        if self.kind not in ("none", "kmer", "minimizer"):
            raise ValueError(f"unknown sampling {self.kind!r}")
        if not 0 <= self.zero_bits <= 62:
            raise ValueError("zero_bits must be from 0 to 62")


@dataclass(frozen=True)
class IndexParams:
    """What an index is built with. findere_z None: 0 with sampling, 4 without."""

    k: int
    m: int = 15
    findere_z: int | None = None
    bloom_bits_log2: int = 32
    abundance_levels: int = 255
    abundance_min: int = 0
    abundance_max: int = 65024
    chunk_size: int = 128
    dense: bool = False
    canonical: bool = True
    sampling: Sampling = field(default_factory=Sampling)
    capacity: int = 0
    partitions: int = 64
    dense_missing: int = 0

    def __post_init__(self) -> None:
        if self.k < 1 or self.m < 1:
            raise ValueError("k and m must be positive")
        if self.m > self.k:
            object.__setattr__(self, "m", self.k)
        sampled = self.sampling.kind != "none"
        if self.findere_z is None:
            object.__setattr__(self, "findere_z", 0 if sampled else min(DEFAULT_Z, self.k - 1))
        elif sampled and self.findere_z:
            raise ValueError("sampling and findere_z exclude each other")
        if not 0 <= self.findere_z < self.k:
            raise ValueError("findere_z must be less than k")
        if self.dense:
            if self.k > 32:
                raise ValueError("a dense index needs k of 32 at most")
            if self.abundance_levels > 255:
                object.__setattr__(self, "abundance_levels", 255)
        if self.abundance_levels < 1 or not 1 <= self.abundance_max <= 65535 or self.abundance_min < 0 or self.chunk_size < 1 or self.partitions < 1:
            raise ValueError("levels, abundance_max, chunk_size and partitions must be positive, abundance_max 65535 at most")

    @property
    def s(self) -> int:
        return self.k - self.findere_z

    @cached_property
    def quantiser(self) -> Quantiser:
        return Quantiser(self.abundance_levels, self.abundance_max)

    def to_json(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_json(d: dict) -> IndexParams:
        return IndexParams(**{**d, "sampling": Sampling(**d["sampling"])})

    def can_merge(self, other: IndexParams) -> bool:
        """Keys and levels of both mean the same. z counts too: s-mers of another length are other keys."""
        return replace(self, abundance_min=0, capacity=0, chunk_size=1, dense_missing=0) == replace(other, abundance_min=0, capacity=0, chunk_size=1, dense_missing=0)


@dataclass(frozen=True)
class QueryFormat:
    """kind: median, colored, matrix-raw, matrix-median or matrix-average. normalize: abundances for so many k-mers of the dataset.
    coverage_min: of the median format. breakpoints: the penalty, for matrix-raw as changepoints."""

    kind: str = "median"
    normalize: int | None = None
    coverage_min: float = 0.5
    breakpoints: float | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("median", "colored", "matrix-raw", "matrix-median", "matrix-average"):
            raise ValueError(f"unknown format {self.kind!r}")
        if self.breakpoints is not None and (self.kind != "matrix-raw" or self.normalize is not None):
            raise ValueError("breakpoints are for matrix-raw without normalize")
        if self.breakpoints is not None and self.breakpoints < 0:
            raise ValueError("the penalty must not be negative")
        if self.normalize is not None and self.normalize <= 0:
            raise ValueError("normalize must be positive")

    def check(self, params: IndexParams) -> None:
        if self.breakpoints is not None and params.sampling.kind != "none":
            raise ValueError("breakpoints need an index without sampling")


#: Between these bases (the upper one doubled until the root lies below it) scales are told apart at this width. Levels are
#: cut to whole numbers, so that the highest one depends on which of these bases is taken.
LOWEST_OVER, HIGHEST, WIDTH = 1e-9, 100.0, 2e-9


def solve_base(levels: int, greatest: int) -> float:
    """The base b whose logarithmic scale, linear up to t = 1 / (b - 1), takes just `levels` levels up to `greatest`, rounded to the
    middle of its cell of the grid of bases. Where all values have a level of their own, a base that is linear all the way.

    The root is found in t by Newton's method, kept inside a bracket.
    """
    if levels >= greatest:
        return 1 + 1 / (greatest + 1)
    if levels == 1:
        return float(greatest + 2) ** 2
    low, high, t = 0.0, float(greatest), levels / (1 + math.log(greatest / levels))
    for _ in range(200):
        growth = math.log1p(1 / t)
        steps = math.log(greatest / t) / growth
        over = steps + t - levels
        low, high = (low, t) if over > 0 else (t, high)
        slope = 1 - 1 / (t * growth) + steps / (growth * t * (t + 1))
        near = t - over / slope if slope else low
        near = near if low < near < high else (low + high) / 2
        if abs(near - t) <= 1e-15 * t:
            break
        t = near
    first, last = 1 + 1 / greatest + LOWEST_OVER, HIGHEST
    while 1 + 1 / t > last:
        last *= 2
    cell = (last - first) / 2 ** math.ceil(math.log2((last - first) / WIDTH))
    return first + (math.floor((1 + 1 / t - first) / cell) + 0.5) * cell


class Quantiser:
    """Abundance to level and back. Levels start at 0; values are never over-estimated."""

    def __init__(self, levels: int, greatest: int) -> None:
        self.levels, self.greatest = levels, greatest
        self.base = solve_base(levels, greatest)
        self.turn = 1 / (self.base - 1)

    def encode(self, value: int) -> int:
        v = min(value, self.greatest)
        if v < self.turn:
            return v - 1
        b = math.log(self.base)
        return int(math.log(v) / b + math.log(self.base - 1) / b + self.turn - 1)

    def decode(self, level: int) -> int:
        if level < self.turn:
            return level + 1
        return int(self.base ** (level + 1 - self.turn) * self.turn)

    @cached_property
    def table(self) -> list[tuple[int, int, int]]:
        """(level, least abundance, value) of all levels that occur, by level."""
        out: list[tuple[int, int, int]] = []
        for v in range(1, self.greatest + 1):
            level = self.encode(v)
            if not out or out[-1][0] != level:
                out.append((level, v, self.decode(level)))
        return out


def number_of_partitions(levels: int, datasets: int, bloom_bits_log2: int) -> int:
    """Bitmaps of 2^32 addresses that hold all slots of all datasets and levels."""
    return -(-levels * datasets * (1 << bloom_bits_log2) // (1 << 32))


def capacity_for(asked: int, datasets: int) -> int:
    return max(asked, datasets)


def false_positive_rate(distinct: int, bloom_bits_log2: int) -> float:
    """Of a Bloom filter with one hash."""
    return 1 - math.exp(-distinct / (1 << bloom_bits_log2))
