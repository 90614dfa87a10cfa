"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last WINDOW lines decides where a chunk ends, so that boundaries depend on the
lines at that place only and return after an insertion. A chunk, or the run of lines inside one, that is a passage of
several lines (``min_lines`` with a word in them, or one line of ``long_line`` words; ``min_words`` words in all) and
occurs again in the corpus is compared byte by byte with its first occurrence (the smallest doc_id, then the first
place) and removed. Single short lines that repeat everywhere are no passage and stay.

A passage need not begin and end where chunks do. So the shortest passages at every place are looked up as well: from
each line with a word on, and up to it, the fewest lines that pass the test. Those inside a repeated passage cover it
from its first line with a word to its last, wherever chunks end: no passage is missed, and all that goes was compared
by bytes. An occurrence that overlaps its first one is no second one.

A line of long_line words or more is a chunk of its own. The hashes of chunks and shortest passages are counted in one
aggregation with partial counts; the texts of repeated ones alone are shuffled, picked by a filter of a fixed size, and
once for all their places in a batch. A passage that a third of the documents share is thus one row for each batch.

Lines are parted by \\n. Null texts stay null, empty ones empty; a document whose lines all go keeps its row with an
empty text. Repeated rows: all passages after the first row's are repeats, but rows of one doc_id are one document (the
first place within them counts). Rows without a doc_id stay as they are. Ties go to the smaller doc_id, then the earlier
line. Very long texts and chunks are worked on whole. Other columns are kept by ``dedup_lines``, whatever their names;
an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._sketch import filter_of, has_bits
from ._spark import cut
from ._tokens import SPACE, U, hash_spans, mix, slices, words

WINDOW = 2
#: A chunk ends where the rolling hash falls below this share of its range.
ENDS = 0.3


def _lines(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the lines of each text; an empty text has one empty line."""
    breaks = np.flatnonzero(raw == 10)
    s = np.concatenate([at[:-1], breaks + 1])
    e = np.concatenate([breaks, at[1:]])
    row = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, breaks, "right") - 1])
    order = np.lexsort((s, row))
    row = row[order]
    # The ends in order: each line ends at the next break of its text, or at the text's end.
    return s[order], e[np.lexsort((e, np.concatenate([np.searchsorted(at, breaks, "right") - 1, np.arange(len(at) - 1)])))], row


class Chunks:
    """Lines and chunks of the texts of a slice."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, long_line: int):
        self.raw, self.long_line = raw, long_line
        self.s, self.e, self.row = _lines(raw, at)
        n = len(self.s)
        self.h = hash_spans(raw, self.s, self.e)
        ws, _, _ = words(raw, at, SPACE)
        self.n_words = np.bincount(np.searchsorted(self.s, ws, "right") - 1, minlength=n) if len(ws) else np.zeros(n, np.int64)
        last = np.r_[self.row[1:] != self.row[:-1], True]
        first = np.r_[True, last[:-1]]
        self.first_of_row = np.flatnonzero(first)
        self.line_no = np.arange(n) - self.first_of_row[self.row]
        rolled = np.zeros(n, U)
        for j in range(WINDOW):
            before = np.roll(self.h, j)
            before[self.line_no < j] = 0
            rolled = rolled * U(0x100000001B3) + before
        ends = mix(rolled + U(9)) < U(int(ENDS * 2**64) - 1)
        long = self.n_words >= long_line
        ends |= last | long
        ends[:-1] |= long[1:]
        start = np.flatnonzero(np.r_[True, ends[:-1]])
        size = np.diff(np.append(start, n))
        self.start, self.size = start, size
        self.chunk = hash_spans(raw, self.s[start], self.e[start + size - 1])

    def passages(self, min_lines: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, sizes and keys of the chunks that are passages, and of the shortest passages from each line with a word on and up to it."""
        full, total = (np.add.reduceat(x, self.start) for x in ((self.n_words > 0).astype(np.int64), self.n_words))
        own = (total >= min_words) & ((full >= min_lines) | (np.maximum.reduceat(self.n_words, self.start) >= self.long_line))
        start, size, keys = self.shortest(min_lines, min_words)
        return np.append(self.start[own], start), np.append(self.size[own], size), np.append(self.chunk[own], keys)

    def shortest(self, min_lines: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shortest passages; long lines are chunks already."""
        w = np.flatnonzero(self.n_words > 0)
        n, at = len(w), np.arange(len(w))
        total = np.append(0, np.cumsum(self.n_words[w]))
        long = np.flatnonzero(self.n_words[w] >= self.long_line)
        # The n-th line with a word is behind the last one, and -1 before the first: no passage.
        next_long = np.append(long, n)[np.searchsorted(long, at)]
        last_long = np.append(-1, long)[np.searchsorted(long, at, "right")]
        enough = np.searchsorted(total, total[:-1] + min_words) - 1
        to = np.maximum(np.minimum(at + max(min_lines, 1) - 1, next_long), np.maximum(enough, at))
        enough = np.searchsorted(total, total[1:] - min_words, "right") - 1
        since = np.minimum(np.maximum(at - max(min_lines, 1) + 1, last_long), np.minimum(enough, at))
        a, b = np.concatenate([at, since]), np.concatenate([to, at])
        there = (a >= 0) & (b < n)
        a, b = w[a[there]], w[b[there]]
        there = (self.row[a] == self.row[b]) & ((a != b) | (self.n_words[a] < self.long_line))
        a, b = np.divmod(np.unique(a[there] * len(self.s) + b[there]), len(self.s))
        return a, b - a + 1, mix(hash_spans(self.raw, self.s[a], self.e[b]) + U(0x70617373))


def _places(min_lines: int, min_words: int, long_line: int):
    """h, doc_id, line of every passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, _, raw, at in slices(batch.column(1)):
                c = Chunks(raw, at, long_line)
                start, _, keys = c.passages(min_lines, min_words)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[lo + c.row[start]]), pa.array(c.line_no[start].astype(np.int32))], ["h", "doc_id", "line"])

    return run


def _repeated(min_lines: int, min_words: int, long_line: int, bits):
    """h, n (lines) and text of the passages in a filter, and their places in a batch. bits: broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
            for lo, _, raw, at in slices(batch.column(1)):
                c = Chunks(raw, at, long_line)
                start, size, keys = c.passages(min_lines, min_words)
                k = np.flatnonzero(has_bits(bits.value, mix(keys)))
                s, size = start[k], size[k]
                data = raw.tobytes()
                for h, a, b, *place in zip(keys[k].view(np.int64).tolist(), c.s[s].tolist(), c.e[s + size - 1].tolist(), ids[lo + c.row[s]].tolist(), c.line_no[s].tolist(), size.tolist(), strict=True):
                    found.setdefault((h, data[a:b]), []).append(tuple(place))
            places = [x for p in found.values() for x in p]
            columns = [pa.array([p[i] for p in places], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            offsets = pa.array(np.cumsum([0, *map(len, found.values())]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["doc_id", "line", "n"]))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([t.decode() for _, t in found], pa.string()), lists], ["h", "text", "places"])

    return run


def repeated_runs(docs: DataFrame, min_lines: int = 2, min_words: int = 25, long_line: int = 50) -> DataFrame:
    """doc_id, from_line, to_line (exclusive) of the runs of lines to remove."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    places = docs.mapInArrow(_places(min_lines, min_words, long_line), "h long, doc_id long, line int")
    first = cut(places.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "line")).alias("first")).where("times > 1").select("h", "first"))

    bits = docs.sparkSession.sparkContext.broadcast(filter_of(first.select("h")))
    found = cut(docs.mapInArrow(_repeated(min_lines, min_words, long_line, bits), "h long, text string, places array<struct<doc_id:long,line:int,n:int>>").join(first, "h"))
    is_first = lambda p: (p["doc_id"] == F.col("first.doc_id")) & (p["line"] == F.col("first.line"))
    kept = found.where(F.exists("places", is_first)).groupBy("h").agg(F.min("text").alias("kept"))
    again = found.join(kept, "h").where(F.col("text") == F.col("kept"))
    overlaps = lambda p: (p["doc_id"] == F.col("first.doc_id")) & (p["line"] < F.col("first.line") + p["n"])
    runs = again.select(F.explode(F.filter("places", lambda p: ~is_first(p) & ~overlaps(p))).alias("p"))
    return runs.select("p.doc_id", F.col("p.line").alias("from_line"), (F.col("p.line") + F.col("p.n")).alias("to_line"))


def _merged(runs: list[dict]) -> list[tuple[int, int]]:
    """Runs of lines as runs apart, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["from_line"], r["to_line"]) for r in runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 25, long_line: int = 50, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs without the later occurrences of repeated passages; n_chars, if there is one, follows. counts: names of columns to add, for the lines and the removed ones."""
    runs = repeated_runs(docs, min_lines, min_words, long_line).distinct().groupBy("doc_id").agg(F.array_agg(F.struct("from_line", "to_line")).alias("runs")).withColumnRenamed("doc_id", "of")
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}  # their names may clash
    joined = docs.select(*(F.col(c).alias(n) for c, n in own.items())).withColumn("id", F.col(own["doc_id"]).cast("long")).join(runs, F.col("id") == F.col("of"), "left")
    schema = T.StructType([*(T.StructField(own[f.name], f.dataType) for f in docs.schema), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    length = own.get("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = data[own["text"]]
            breaks, removed = pc.fill_null(pc.add(pc.count_substring(texts, "\n"), 1), 0), np.zeros(len(texts), np.int64)
            changed = {}
            for k, found in enumerate(data["runs"]):
                if found.is_valid:
                    lines, kept, last = texts[k].as_py().split("\n"), [], 0
                    for a, b in _merged(found.as_py()):
                        kept += lines[last:a]
                        last, removed[k] = b, removed[k] + b - a
                    changed[k] = "\n".join(kept + lines[last:])
            if changed:
                mask = np.zeros(len(texts), bool)
                mask[list(changed)] = True
                put = lambda column, new: pc.replace_with_mask(column, pa.array(mask), pa.array(new, column.type))
                data[own["text"]] = put(texts, list(changed.values()))
                if length and pa.types.is_integer(data[length].type):
                    data[length] = put(data[length], [len(x) for x in changed.values()])
            data |= {"n_lines": breaks.cast(pa.int64()), "n_removed": pa.array(removed)}
            yield pa.RecordBatch.from_arrays([data[f.name] for f in schema], [f.name for f in schema])

    out = joined.select(*own.values(), "runs").mapInArrow(run, schema)
    added = [F.col(n).alias(c) for n, c in zip(("n_lines", "n_removed"), counts, strict=True)] if counts else []
    return out.select(*(F.col(n).alias(c) for c, n in own.items()), *added)
