"""Similarities of sets, strings and vectors. Jaro-Winkler and the ratios of longest common subsequences have no JVM form and are Arrow UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """empty: the value for two empty sets; None for null."""
    value = F.try_divide(shared(a, b), F.size(F.array_union(a, b)))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """Of arrays without repeats, whose union need not be made; null for two empty ones."""
    both = shared(a, b)
    return F.try_divide(both, F.size(a) + F.size(b) - both)


def containment(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(shared(a, b), F.least(F.size(a), F.size(b))), F.lit(0.0))


def total(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def weights_of(words: Column, idf: Column, default: Column) -> Column:
    return F.transform(words, lambda t: F.coalesce(F.element_at(idf, t), default))


def idf_overlap(a: Column, b: Column, idf: Column, default: Column) -> Column:
    """Share of a's weight that b has too; 0 for an empty a."""
    return F.coalesce(F.try_divide(total(weights_of(F.array_intersect(a, b), idf, default)), total(weights_of(a, idf, default))), F.lit(0.0))


def squared(words: Column, idf: Column, default: Column) -> Column:
    return total(F.transform(weights_of(words, idf, default), lambda w: w * w))


def idf_cosine(a: Column, b: Column, idf: Column, default: Column) -> Column:
    """Null if a set is empty."""
    return F.try_divide(squared(F.array_intersect(a, b), idf, default), F.sqrt(squared(a, idf, default) * squared(b, idf, default)))


def idf_containment(a: Column, b: Column, idf: Column, default: Column) -> Column:
    return F.try_divide(squared(F.array_intersect(a, b), idf, default), F.least(squared(a, idf, default), squared(b, idf, default)))


def max_idf(words: Column, idf: Column, default: Column) -> Column:
    return F.coalesce(F.array_max(weights_of(words, idf, default)), F.lit(0.0))


def relative_difference(x: Column, y: Column) -> Column:
    return F.abs(x - y) / F.greatest(x, y, F.lit(1))


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    if reach < 0:
        return 0.0
    # Bit-parallel: the free places of each character in b, as the bits of a number.
    free: dict[str, int] = {}
    for j, c in enumerate(b):
        free[c] = free.get(c, 0) | 1 << j
    span, ours, taken = (1 << (2 * reach + 1)) - 1, [], 0
    for i, c in enumerate(a):
        lo = i - reach
        near = free.get(c, 0) & (span << lo if lo >= 0 else span >> -lo)
        if near:
            bit = near & -near  # the first free place in reach
            free[c] ^= bit
            taken |= bit
            ours.append(c)
    m = len(ours)
    if not m:
        return 0.0
    places = bin(taken)[:1:-1]
    theirs = [c for c, x in zip(b, places, strict=False) if x == "1"]
    moved = sum(x != y for x, y in zip(ours, theirs, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def winkler(a: str, b: str) -> float:
    """The common prefix (at most 4) counts where the plain similarity is above 0.7."""
    s = jaro(a, b)
    same = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return s + 0.1 * same * (1 - s) if s > 0.7 else s


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared tokens, and these with the rest of either side; 0 if a side is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_a or not only_b):
        return 1.0
    with_a, with_b = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    return max(ratio(with_a, with_b), *((ratio(both, with_a), ratio(both, with_b)) if both else (0.0,)))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer one of at most its length."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    n = len(a)
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def _udf(f):
    @F.pandas_udf(DoubleType())
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}  # names repeat: a pair of strings of a batch is scored once
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in known:
                known[pair] = None if None in pair else f(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return of


jaro_winkler_udf, ratio_udf, sort_ratio_udf, set_ratio_udf, partial_ratio_udf = map(_udf, (winkler, ratio, sort_ratio, set_ratio, partial_ratio))
