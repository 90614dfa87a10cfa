"""Quality classifier with supervised subword embeddings.

Words, pairs of words, character 4-grams (of bytes, across word boundaries) and a mark for a word that repeats the one
before it (a bucket of its own) are hashed to BUCKETS rows of an embedding table; a document is the average of its rows, and a softmax layer over two
classes is trained with the table by stochastic gradient descent in numpy. As the layer is linear, scoring needs only
each row's difference of the two outputs: a table of BUCKETS floats, whatever the input.

Training takes the labelled rows outside the held-out fold; of more than ``sample`` (a documented bound) those with the
smallest hashes of doc_id. Each is read whole, as is every text that is scored. Labels, lang, source and doc_id never
enter a score.

Null and empty texts have no features and get the score of the bias. A null doc_id counts as held out. Very long texts
cost time in proportion to their length, and memory for one text at a time. A null label is no label; labels of one doc_id are
averaged, and a tie is no label. Repeated rows are scored each. With labels of one class, or none, every score is the
smoothed share of good labels. Other columns are kept by ``keep_good``. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tokens import BASE, SPACE, U, hash_spans, mix, slices, words

BITS = 17
BUCKETS = 1 << BITS
#: The bucket of a repeated word's mark, which no hash shares.
SAME = 0
DIM, EPOCHS, BATCH, RATE, SEED = 8, 12, 32, 60.0, 5


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, features, their rows) of slices of a text column."""
    for lo, hi, raw, at in slices(texts):
        s, e, row = words(raw, at, SPACE)
        h = hash_spans(raw, s, e) if len(s) else np.zeros(0, U)
        beside = np.flatnonzero(row[1:] == row[:-1])
        pairs = mix(h[beside] * U(BASE) + h[beside + 1])
        same = beside[h[beside] == h[beside + 1]]
        x = raw.astype(np.uint32)
        n = max(0, len(x) - 3)
        g = x[:n] | x[1 : n + 1] << np.uint32(8) | x[2 : n + 2] << np.uint32(16) | x[3 : n + 3] << np.uint32(24)
        of = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(at))
        inside = of[:n] == of[3:]
        g = (g * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        f = np.concatenate([(h >> U(64 - BITS)).astype(np.uint32), (pairs >> U(64 - BITS)).astype(np.uint32), g[inside]])
        f[f == SAME] = SAME ^ 1
        yield lo, hi, np.append(f, np.full(len(same), SAME, np.uint32)), np.concatenate([row.astype(np.int32), row[beside].astype(np.int32), of[:n][inside], row[same].astype(np.int32)])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label and the distinct features with their counts."""
    for batch in batches:
        for lo, hi, f, row in features(batch.column(1)):
            key, n = np.unique(row.astype(np.int64) << BITS | f, return_counts=True)
            cut = np.searchsorted(key >> BITS, np.arange(hi - lo + 1))
            ids = (key & (BUCKETS - 1)).astype(np.int32)
            pick = [slice(cut[d], cut[d + 1]) for d in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([ids[p].tobytes() for p in pick], pa.binary()), pa.array([n[p].astype(np.int32).tobytes() for p in pick], pa.binary())], ["label", "ids", "n"])


def train(bags: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """What each feature adds to the log-odds (times its share of the text), and the bias."""
    good = sum(y for y, _, _ in bags)
    prior = float(np.log((good + 1) / (len(bags) - good + 1)))
    if not 0 < good < len(bags):
        return np.zeros(BUCKETS, np.float32), prior
    rng = np.random.default_rng(SEED)
    table = ((rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM).astype(np.float32)
    layer = ((rng.random((DIM, 2)) - 0.5) / DIM).astype(np.float32)
    bias = np.array([-prior / 2, prior / 2], np.float32)
    steps, step = EPOCHS * -(-len(bags) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for k in range(0, len(bags), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            some = [bags[i] for i in order[k : k + BATCH] if len(bags[i][1])]
            if not some:
                continue
            ids = np.concatenate([x for _, x, _ in some])
            share = np.concatenate([n / n.sum() for _, _, n in some]).astype(np.float32)
            starts = np.concatenate([[0], np.cumsum([len(x) for _, x, _ in some])[:-1]])
            mean = np.add.reduceat(table[ids] * share[:, None], starts)
            out = mean @ layer + bias
            out = np.exp(out - out.max(1, keepdims=True))
            out /= out.sum(1, keepdims=True)
            out[np.arange(len(some)), [y for y, _, _ in some]] -= 1
            out /= len(some)
            back = np.repeat(out @ layer.T, np.diff(np.append(starts, len(ids))), axis=0) * share[:, None]
            layer -= rate / 20 * mean.T @ out
            bias -= rate / 600 * out.sum(0)
            for d in range(DIM):
                table[:, d] -= rate * np.bincount(ids, back[:, d], BUCKETS).astype(np.float32)
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = 5000) -> tuple[np.ndarray, float]:
    known = labels.select("doc_id", "quality").where("quality is not null and doc_id is not null").where(fold(F.col("doc_id"), folds) != 0)
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("mean")).where("mean <> 0.5").select(F.col("doc_id").alias("of"), (F.col("mean") > 0.5).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("of"), "of").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("of")).select("label", "text").mapInArrow(_bags, "label int, ids binary, n binary")
    return train([(r["label"], np.frombuffer(bytes(r["ids"]), np.int32), np.frombuffer(bytes(r["n"]), np.int32)) for r in rows.toLocalIterator()])


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs as own_0, own_1, ... (their names may clash), and score."""
    from pyspark.sql.pandas.types import to_arrow_schema

    held = docs.sparkSession.sparkContext.broadcast(model)
    own = {c: f"own_{i}" for i, c in enumerate(keep)}
    named = docs.select(F.col("text"), *(F.col(c).alias(n) for c, n in own.items()))
    schema = T.StructType([*(f for f in named.schema if f.name != "text"), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, bias = held.value
        for batch in batches:
            logit = np.full(batch.num_rows, bias)
            for lo, hi, f, row in features(batch.column(0)):
                n = np.bincount(row, minlength=hi - lo)
                logit[lo:hi] += np.bincount(row, gain[f], hi - lo) / np.maximum(n, 1)
            columns = [*batch.columns[1:], pa.array(1 / (1 + np.exp(-logit)))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return named.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    scored = score(docs, fit(docs, labels, folds), ["doc_id"])
    return scored.select(F.col("own_0").alias("doc_id"), (fold(F.col("own_0"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs that the classifier doesn't reject."""
    scored = score(docs, fit(docs, labels), docs.columns).where(F.col("score") >= threshold)
    return scored.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)))
