"""Benchmark decontamination by winnowing.

Of a text's k-grams of words, winnowing keeps the smallest hash in each window of ``WINDOW`` k-grams in a row (the last
one of a tie). A window spans 13 words, and two equal runs of 13 words keep the same k-gram: every shared run of 13
words leaves a shared fingerprint. The fingerprints of documents are joined with those of the benchmark, and each match
is extended word by word on both sides; where 13 words or more agree, the document's words are hit. An item of fewer
than 13 words is one window: its only fingerprint is the hash of all its words, looked up at every place of a document.

A benchmark of at most BLOCK_WORDS words is sent to all executors as an index, and documents stay in place. A larger one
never meets anywhere: its fingerprints, each with the words around it, are made on executors and joined by a shuffle with
those fingerprints of documents that pass a filter of a fixed size; equal surroundings of several items are one row. Words
are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z and are compared by 64-bit hashes.

Null and empty texts have no words, no hits and are not contaminated. Items without words, or without an id, match
nothing. Items of the same id count once. Repeated rows of documents are each judged. Very long texts are worked on
whole. With an empty benchmark nothing is hit; empty documents give none. Other columns are kept by ``mark``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._columns import free, lower_ascii
from ._sketch import filter_of, has_bits
from ._spark import cut
from ._tokens import PUNCT, U, grams, mix, tokens

SPAN, K = 13, 6
WINDOW = SPAN - K + 1
#: Words of a benchmark (some 50 bytes each) that is sent to all executors.
BLOCK_WORDS = 2_000_000
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STATE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_from", T.ArrayType(T.IntegerType())), T.StructField("hit_to", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])


def winnow(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the word hashes h, whose rows are given, and the index of the first word of each."""
    if len(h) < SPAN:
        return np.zeros(0, U), np.zeros(0, np.int64)
    n = len(h) - K + 1
    acc = h[:n].copy()
    for j in range(1, K):
        acc = acc * U(0x9E3779B97F4A7C15) + h[j : n + j]
    acc ^= acc >> U(29)
    acc *= U(0xBF58476D1CE4E5B9)
    acc ^= acc >> U(32)
    starts = np.flatnonzero(row[: len(h) - SPAN + 1] == row[SPAN - 1 :])
    least = acc[: n - WINDOW + 1].copy()
    where = np.zeros(len(least), np.int8)
    for j in range(1, WINDOW):
        other = acc[j : j + len(least)]
        later = other <= least
        np.copyto(least, other, where=later)
        where[later] = j
    at = starts + where[starts]
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    at = np.unique(at)
    return acc[at], at


class Index:
    """Fingerprints of items."""

    def __init__(self, ids: list[str], texts: list[str]):
        hashes, rows = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for lo, _, h, row in tokens(pa.array(texts, pa.large_string()), PUNCT):
            hashes.append(h)
            rows.append(row + lo)
        self.ids = np.array(ids, object)
        self.words, self.row = np.concatenate(hashes), np.concatenate(rows)
        f, at = winnow(self.words, self.row)
        order = np.argsort(f, kind="stable")
        self.prints, self.at = f[order], at[order]
        n = np.bincount(self.row, minlength=len(ids))
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(1, SPAN):
            items = np.flatnonzero(n == k)
            if len(items):
                h, at = grams(self.words, self.row, k)
                whole = np.isin(at, first[items])
                order = np.argsort(h[whole], kind="stable")
                self.short[k] = (h[whole][order], self.row[at[whole]][order])

    @staticmethod
    def matches(prints: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes (into prints, into h) of all equal pairs; prints are sorted."""
        if not len(prints):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo = np.searchsorted(prints, h)
        there = np.flatnonzero(prints[np.minimum(lo, len(prints) - 1)] == h)
        lo = lo[there]
        times = np.searchsorted(prints, h[there], "right") - lo
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(lo, times) + step, np.repeat(there, times)

    def hits(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, ends and items of the matched runs in documents."""
        f, at = winnow(h, row)
        i, j = self.matches(self.prints, f)
        theirs, ours = self.at[i], at[j]
        same = np.ones(len(ours), bool)
        for s in range(K):
            same &= h[ours + s] == self.words[theirs + s]
        theirs, ours = theirs[same], ours[same]
        out = []
        for sign, edge in ((-1, 0), (1, K - 1)):
            length, on = np.zeros(len(ours), np.int64), np.ones(len(ours), bool)
            for s in range(1, SPAN - K + 1):
                a, b = ours + edge + sign * s, theirs + edge + sign * s
                inside = (a >= 0) & (a < len(h)) & (b >= 0) & (b < len(self.words))
                a, b = np.where(inside, a, 0), np.where(inside, b, 0)
                on &= inside & (row[a] == row[ours]) & (self.row[b] == self.row[theirs])
                on &= h[a] == self.words[b]
                length += on
            out.append(length)
        lo, hi = ours - out[0], ours + K + out[1]
        long = hi - lo >= SPAN
        found = [(lo[long], hi[long], self.row[theirs[long]])]
        for k, (prints, items) in self.short.items():
            g, at = grams(h, row, k)
            i, j = self.matches(prints, g)
            found.append((at[j], at[j] + k, items[i]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as intervals apart."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > hi[:-1]]
    first = np.flatnonzero(new)
    return lo[first], hi[np.r_[first[1:] - 1, len(hi) - 1]]


def _marker(index, schema: pa.Schema):
    """index: a broadcast Index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for batch in batches:
            state = [[0] * batch.num_rows, *([None] * batch.num_rows for _ in range(3))]
            for lo, hi, h, row in tokens(batch.column(batch.schema.get_field_index("text")), PUNCT):
                state[0][lo:hi] = np.bincount(row, minlength=hi - lo).tolist()
                first, end, item = ix.hits(h, row)
                if not len(first):
                    continue
                start = np.searchsorted(row, np.arange(hi - lo))
                doc = row[first]
                order = np.argsort(doc, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
                    d = int(doc[part[0]])
                    a, b = _merged(first[part] - start[d], end[part] - start[d])
                    state[1][lo + d], state[2][lo + d] = a.tolist(), b.tolist()
                    state[3][lo + d] = sorted(set(ix.ids[np.unique(item[part])]))
            columns = {f.name: batch.column(batch.schema.get_field_index(f.name)) for f in schema if f.name in batch.schema.names}
            columns |= {name: pa.array(new, schema.field(name).type) for name, new in zip(STATE.names, state, strict=True)}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def _around(h: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words that may belong to a window around each fingerprint, and how many stand before it."""
    first = np.searchsorted(row, row[at])
    end = np.searchsorted(row, row[at], "right")
    lo, hi = np.maximum(first, at - WINDOW + 1), np.minimum(end, at + SPAN)
    n = hi - lo
    flat = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(h[flat].view(np.int64)))
    return words, at - lo


def _runs_of(h: np.ndarray, at: np.ndarray, k: int) -> pa.Array:
    flat = (at[:, None] + np.arange(k)).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), pa.array(h[flat].view(np.int64)))


def _item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """print, k (words of a short item, else 0), item, left, words: of id, text."""
    for batch in batches:
        for lo, hi, h, row in tokens(batch.column(1), PUNCT):
            ids, n = batch.column(0).slice(lo, hi - lo), np.bincount(row, minlength=hi - lo)
            start = np.cumsum(n) - n
            f, at = winnow(h, row)
            words, left = _around(h, row, at)
            parts = [(f, np.zeros(len(f), np.int32), row[at], left, words)]
            for k in range(1, SPAN):
                g, at = grams(h, row, k)
                whole = np.isin(at, start[n == k]) & (n[row[at]] == k)
                parts.append((g[whole], np.full(whole.sum(), k, np.int32), row[at[whole]], np.zeros(whole.sum(), np.int64), _runs_of(h, at[whole], k)))
            for g, k, of, left, words in parts:
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(k), ids.take(pa.array(of)), pa.array(left.astype(np.int32)), words], ["print", "k", "item", "left", "words"])


def _doc_prints(bits, short: list[int]):
    """id, hash, at (word), print, k, left, words of the fingerprints in a filter: of id, hash, text. bits: broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, row in tokens(batch.column(2), PUNCT):
                ids, hashes = (batch.column(i).slice(lo, hi - lo) for i in (0, 1))
                start = np.searchsorted(row, np.arange(hi - lo))
                for k in (0, *short):
                    g, at = grams(h, row, k) if k else winnow(h, row)
                    some = np.flatnonzero(has_bits(bits.value, mix(g)))
                    g, at = g[some], at[some]
                    words, left = (_runs_of(h, at, k), np.zeros(len(at), np.int64)) if k else _around(h, row, at)
                    of = pa.array(row[at])
                    yield pa.RecordBatch.from_arrays([ids.take(of), hashes.take(of), pa.array((at - start[row[at]]).astype(np.int32)), pa.array(g.view(np.int64)), pa.array(np.full(len(g), k, np.int32)), pa.array(left.astype(np.int32)), words], ["id", "hash", "at", "print", "k", "left", "words"])

    return run


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, hash, from, to, items of the pairs of fingerprints that lie in equal runs of SPAN words, or in a whole short item."""
    for batch in batches:
        keep, first, end = [], [], []
        for i, (at, k, a, x, b, y) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("at", "k", "left", "words", "left2", "words2")), strict=True)):
            if k:
                if x == y:
                    keep, first, end = [*keep, i], [*first, at], [*end, at + k]
                continue
            if x[a : a + K] != y[b : b + K]:
                continue
            up, down = 0, K
            while up < min(a, b) and x[a - up - 1] == y[b - up - 1]:
                up += 1
            while a + down < len(x) and b + down < len(y) and x[a + down] == y[b + down]:
                down += 1
            if up + down >= SPAN:
                keep, first, end = [*keep, i], [*first, at - up], [*end, at + down]
        part = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("hash"), pa.array(first, pa.int32()), pa.array(end, pa.int32()), part.column("items")], ["id", "hash", "from", "to", "items"])


def _merged_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_merged(*np.array([(r["from"], r["to"]) for r in runs]).T) for runs in batch.column("runs").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("of"), batch.column("of_hash"), *(pa.array([x[i].tolist() for x in out], pa.list_(pa.int32())) for i in (0, 1)), batch.column("items")], ["of", "of_hash", "hit_from", "hit_to", "items"])


def _joined(named: DataFrame, items: DataFrame) -> DataFrame:
    """named (text and more) with the columns of STATE, by a shuffled join of fingerprints. items: id, text."""
    spark = named.sparkSession
    prints = cut(items.mapInArrow(_item_prints, "print long, k int, item string, left int, words array<bigint>"))
    prints = cut(prints.groupBy("print", "k", "left", "words").agg(F.collect_set("item").alias("items")))
    bits = spark.sparkContext.broadcast(filter_of(prints.select("print")))
    short = sorted(r["k"] for r in prints.where("k > 0").select("k").distinct().collect())
    # Rows of one id and text are judged alike.
    keyed = named.withColumn("id", F.monotonically_increasing_id()).withColumn("hash", F.xxhash64("text"))
    keyed = cut(keyed)
    found = keyed.where("text is not null").select("id", "hash", "text").mapInArrow(_doc_prints(bits, short), "id long, hash long, at int, print long, k int, left int, words array<bigint>")
    pairs = found.join(prints.withColumnsRenamed({"left": "left2", "words": "words2"}), ["print", "k"])
    hits = pairs.mapInArrow(_extended, "id long, hash long, from int, to int, items array<string>")
    hits = hits.groupBy(F.col("id").alias("of"), F.col("hash").alias("of_hash")).agg(F.collect_set(F.struct("from", "to")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = hits.mapInArrow(_merged_runs, "of long, of_hash long, hit_from array<int>, hit_to array<int>, items array<string>")
    n_words = F.coalesce(F.regexp_count(lower_ascii(F.col("text")), F.lit(LETTERS)), F.lit(0)).cast("long")
    return keyed.withColumn("n_words", n_words).join(hits, (F.col("id") == F.col("of")) & (F.col("hash") == F.col("of_hash")), "left").drop("id", "hash", "of", "of_hash", "text")


def mark(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns ``keep`` of docs (all, if not given), n_words, hit_from and hit_to (word positions), items, n_hit, n_items and contaminated (with underscores added to names that are taken)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = docs.columns if keep is None else keep
    own = {c: f"_{i}_" for i, c in enumerate(keep)}  # their names may clash
    named = docs.select("text", *(F.col(c).alias(n) for c, n in own.items()))
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").where("item_id is not null and text is not null")
    # A word and what parts it from the next take two characters at least.
    size = items.agg(F.coalesce(F.sum(F.floor(F.length("text") / 2) + 1), F.lit(0))).collect()[0][0]
    if size <= block_words:
        rows = items.orderBy("id").collect()
        held = docs.sparkSession.sparkContext.broadcast(Index([r["id"] for r in rows], [r["text"] for r in rows]))
        schema = T.StructType([*(f for f in named.schema if f.name != "text"), *STATE])
        out = named.mapInArrow(_marker(held, to_arrow_schema(schema)), schema)
    else:
        out = _joined(named, items)
    n_hit = F.coalesce(F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    new = {"n_words": F.col("n_words"), "hit_from": F.col("hit_from"), "hit_to": F.col("hit_to"), "items": items_, "n_hit": n_hit, "n_items": F.size(items_).cast("long"), "contaminated": (n_hit > 0) & (20 * n_hit >= F.col("n_words"))}
    return out.select(*(F.col(n).alias(c) for c, n in own.items()), *(c.alias(free(n, keep)) for n, c in new.items()))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones."""
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    named = docs.select("text", *(F.col(c).alias(n) for c, n in own.items()))
    return mark(named, benchmark, list(own.values())).where(~F.col("contaminated")).select(*(F.col(n).alias(c) for c, n in own.items()))
