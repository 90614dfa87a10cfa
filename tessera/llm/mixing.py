"""Mixing sources to target weights by pivotal dependent rounding.

Sources, in code-point order with null last, weigh 1, 2, 3, 1, 2, 3, ... and share all sizes by weight; no source gets
more than ``most`` times its own size, and what that cuts off is shared by weight among the others (water filling, in
closed form over the table of sources). Every document of a source then wants target / source size copies. Its whole
part is taken; the fractional parts are paired, and words are moved at random from one of a pair to the other until one
is 0 or 1: the expected copies of each document stay as they were, and the words of a pair stay the same exactly.
Documents are dealt to buckets of about BUCKET rows by a hash of doc_id (of the text, where that is null); each bucket leaves one fraction at most, and
these meet in a tree of FAN-fold nodes until one per source is left and drawn. So a source's taken words miss its
target by less than one document.

Random numbers come from source, bucket and level, so that reruns agree. A null or empty text has size 0 and is never
taken. A null source is a source of its own, and rows without a doc_id are mixed like others. Repeated rows are each mixed, and of rows alike any may be taken. A table
without words has targets of 0; an empty table gives none. Other columns are kept by ``mix`` and ignored by the query.
"""

from __future__ import annotations

from math import ceil, log
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._columns import WORD, free
from ._spark import cut

BUCKET, FAN, SEED = 2_000, 64, 17
#: So many sources are joined by broadcast; more are joined by a shuffle.
FEW_SOURCES = 50_000
ROUNDED = "doc_id string, source string, size long, source_size long, target double, whole long, p double, bucket long"


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, n_docs, target: a row for each source."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # One task sorts the sources, of which there are few beside documents.
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sums.withColumn("turn", turn).withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("turn") % len(weights)))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", "turn")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.sum("source_size").over(every) - before) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", level)
    s = s.withColumn("water", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "turn", "level"))).over(every)["level"])
    return s.select("source", "source_size", "n_docs", F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")).alias("target"))


def _round(level: int, last: bool):
    def one_bucket(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Settles all fractions of a bucket but one; at the root also that one."""
        source, bucket = key[0], int(key[1])
        rng = np.random.default_rng([SEED, level, bucket, crc32(b"-" if source is None else b"+" + source.encode())])
        # The smallest come last, so that what is left open at the end is a small document.
        rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        p, size = rows["p"].to_numpy(float).copy(), rows["size"].to_numpy(float)
        open_ = np.flatnonzero((p > 0) & (p < 1) & (size > 0))
        p[size == 0] = 0
        if len(open_):
            draws = rng.random(len(open_))
            a = open_[0]
            for b, draw in zip(open_[1:], draws[1:], strict=True):
                up, down = min((1 - p[a]) * size[a], p[b] * size[b]), min(p[a] * size[a], (1 - p[b]) * size[b])
                if draw * (up + down) < down:
                    full = (1 - p[a]) * size[a] <= p[b] * size[b]
                    p[a], p[b] = (1.0, p[b] - up / size[b]) if full else (p[a] + up / size[a], 0.0)
                    done = full
                else:
                    gone = p[a] * size[a] <= (1 - p[b]) * size[b]
                    p[a], p[b] = (0.0, p[b] + down / size[b]) if gone else (p[a] - down / size[a], 1.0)
                    done = gone
                if done:
                    a = b
            if last and 0 < p[a] < 1:
                p[a] = float(draws[0] < p[a])
        rows["p"], rows["bucket"] = np.clip(p, 0.0, 1.0), bucket
        return rows

    return one_bucket


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: a row for each row of docs."""
    sized = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))).alias("dealt"))
    sized = cut(sized)
    sources = cut(targets(sized, weights, most))
    small = sources.agg(F.count(F.lit(1)).alias("n"), F.max("n_docs").alias("docs")).collect()[0]
    if small["n"] <= FEW_SOURCES:
        sources = F.broadcast(sources)
    named = sources.withColumnRenamed("source", "of")
    sized = sized.join(named, sized["source"].eqNullSafe(named["of"])).drop("of")
    wanted = F.least(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)), F.lit(float(most)))
    whole = F.floor(wanted).cast("long")
    buckets = F.ceil(F.col("n_docs") / BUCKET)
    rows = sized.select("doc_id", "source", "size", "source_size", "target", whole.alias("whole"), (wanted - whole).alias("p"), F.pmod(F.col("dealt"), buckets).alias("bucket"))
    levels = ceil(log(max(1, ceil((small["docs"] or 0) / BUCKET)), FAN))
    settled = []
    for level in range(levels + 1):
        rows = cut(rows.groupBy("source", "bucket").applyInPandas(_round(level, level == levels), ROUNDED))
        if level < levels:
            rest = (F.col("p") > 0) & (F.col("p") < 1)
            settled.append(rows.where(~rest))
            rows = rows.where(rest).withColumn("bucket", F.floor(F.col("bucket") / FAN))
    for more in settled:
        rows = rows.unionByName(more)
    copies = F.col("whole") + F.when(F.col("size") > 0, F.col("p").cast("long")).otherwise(0)
    copies = F.when(F.col("size") > 0, copies).otherwise(0)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """docs as the mix takes them: each row as often as it is taken, with copy_no from 1 (an own column of that name stays, and underscores are added to the new one's).

    doc_id is taken for a key: rows that repeat it are each taken as often as the one that is taken most.
    """
    taken = mix_sizes(docs, weights, most).where("copies > 0").select("doc_id", "copies")
    taken = taken.groupBy("doc_id").agg(F.max("copies").alias("copies")).withColumnRenamed("doc_id", "of")
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*(F.col(c).alias(n) for c, n in own.items()), F.col("doc_id").cast("long").alias("id"))
    joined = named.join(taken, F.col("id").eqNullSafe(F.col("of")))
    copied = joined.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copied.select(*(F.col(n).alias(c) for c, n in own.items()), F.col("copy_no").alias(free("copy_no", docs.columns)))
