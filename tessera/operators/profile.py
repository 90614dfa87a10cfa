"""Profiles of tables: counts, shares, quantiles, frequent tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_group(df: DataFrame, value: Column, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("median"), F.percentile(value, F.lit(0.9)).alias("p90"), F.avg(value).alias("mean"))


def histogram(counts: DataFrame, k: str = "k", most: int = 10) -> DataFrame:
    """bin, n, share; the last bin holds all larger values."""
    h = counts.groupBy(F.least(F.col(k), F.lit(most)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def crosstab(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    return df.groupBy(a).pivot(b, values).count().na.fill(0)


def top_tokens(df: DataFrame, words: Column, group: str, n: int = 10) -> DataFrame:
    """group, token, n, r: the most frequent tokens of each group."""
    c = df.select(group, F.explode(words).alias("token")).groupBy(group, "token").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "token"))).where(F.col("r") <= n)


def duplicate_share(df: DataFrame, *columns: str) -> DataFrame:
    """n, and the share of rows that repeat an earlier one in these columns."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("n"), (1 - F.count(F.lit(1)) / F.sum("c")).alias("dup_share"))


def address_flags(df: DataFrame, a: str, *by: str) -> DataFrame:
    """Shares of addresses with a 5-digit code, a 6-digit code, a landmark, a digit, and the mean number of commas."""
    c = F.col(a)
    share = lambda x: F.avg(x.cast("int"))
    return df.groupBy(*by).agg(
        share(c.rlike(r"\b[0-9]{5}\b")).alias("zip5"), share(c.rlike(r"\b[0-9]{6}\b")).alias("pin6"), share(c.rlike(r"\b[0-9]{3} [0-9]{3}\b")).alias("pin33"), share(c.rlike(r"(?i)\b(near|opp|behind|beside)\b")).alias("landmark"),
        share(c.rlike("[0-9]")).alias("digit"), share(c == "").alias("empty"), F.avg(F.regexp_count(c, F.lit(","))).alias("commas"),
    )


def compositions(pairs: DataFrame) -> DataFrame:
    """kind, n: queries by the sources of their matches. pairs: qi, src."""
    s = pairs.groupBy("qi").agg(F.max((F.col("src") == "S2").cast("int")).alias("a"), F.max((F.col("src") == "S3").cast("int")).alias("b"))
    kind = F.when((F.col("a") == 1) & (F.col("b") == 1), "S2+S3").when(F.col("a") == 1, "S2 only").otherwise("S3 only")
    return s.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def shared_owners(pairs: DataFrame) -> DataFrame:
    """m, owners: pool records with more than one owner."""
    return pairs.groupBy("m").agg(F.count_distinct("s1").alias("owners")).where("owners > 1")


def inverted_lookup(q: DataFrame, p: DataFrame, least: int = 20, share: float = 0.01) -> DataFrame:
    """qi, n_cand, n_tokens: pool records that share a token which stands in at most max(least, share of the pool) records. q: qi, words; p: pj, words."""
    held = p.select("pj", F.explode(F.array_distinct("words")).alias("token"))
    most = F.broadcast(p.agg(F.greatest(F.lit(least), F.floor(F.lit(share) * F.count(F.lit(1)))).alias("most")))  # one row
    rare = held.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(most, F.col("df") <= F.col("most")).select("token")
    found = q.select("qi", F.explode(F.array_distinct("words")).alias("token")).join(rare, "token").join(held, "token")
    return found.groupBy("qi", "pj").agg(F.count(F.lit(1)).alias("t")).groupBy("qi").agg(F.count(F.lit(1)).alias("n_cand"), F.max("t").alias("n_tokens"))


def signal_means(pairs: DataFrame, signals: list[str], *by: str) -> DataFrame:
    """Mean and median of each signal, for each group."""
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}_{c}") for c in signals for n, f in (("mean", F.avg), ("median", F.median))))


def coverage_share(records: DataFrame, used: DataFrame, key: str, *by: str) -> DataFrame:
    """The share of records whose key is among the used ones, for each group."""
    flagged = records.join(used.select(key).distinct().withColumn("used", F.lit(1)), key, "left")
    return flagged.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("used", F.lit(0))).alias("share"))


def ids_by(records: DataFrame, key: str, by: str) -> DataFrame:
    """by, ids: the sorted keys of each group, for groups that are known to be small."""
    return records.groupBy(by).agg(F.array_sort(F.collect_list(key)).alias("ids"))


def universe(s1: DataFrame, pool: DataFrame, native: Column, *by: str) -> DataFrame:
    """n, singletons (records without a match), pool, distractors (pool records without an owner) and native names, as counts and shares."""
    q = s1.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("k") == 0).cast("int")).alias("singletons"))
    p = pool.groupBy(*by).agg(F.count(F.lit(1)).alias("pool"), F.avg((F.col("owner") == "").cast("int")).alias("distractors"), F.avg(native.cast("int")).alias("native"))
    return q.join(p, list(by), "full_outer")


def error_profile(pairs: DataFrame, signals: list[str], kind: str = "kind", levels: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Means and quantiles of the signals of each kind of error (missed, false, right)."""
    return pairs.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in signals), *(F.percentile(c, F.lit(x)).alias(f"p{round(100 * x)}_{c}") for c in signals for x in levels))


def hardest(pairs: DataFrame, signal: str, n: int = 15, *ties: str) -> DataFrame:
    """The n pairs of the smallest signal."""
    return pairs.orderBy(signal, *ties).limit(n)


def largest_difference(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """n rows of both, rows of only one, and the largest absolute difference in each column: whether two ways to the same table agree."""
    other = b.select(*keys, *(F.col(c).alias(f"{c}_b") for c in columns), F.lit(1).alias("in_b"))
    j = a.withColumn("in_a", F.lit(1)).join(other, keys, "full_outer")
    return j.agg(F.count(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1)).alias("n"), F.count(F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), 1)).alias("alone"), *(F.max(F.abs(F.col(c) - F.col(f"{c}_b"))).alias(c) for c in columns))
