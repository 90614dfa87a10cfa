"""Vocabularies: document frequencies, inverse document frequencies, the learned dictionary, name uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prepare import drawn

def document_frequency(records: DataFrame, words: Column, group: str = "country") -> DataFrame:
    """group, token, df: in how many records of a group a token stands."""
    return records.select(group, F.explode(F.array_distinct(words)).alias("token")).groupBy(group, "token").agg(F.count(F.lit(1)).alias("df"))


def inverse_frequency(records: DataFrame, words: Column, group: str = "country", least_df: int = 2) -> DataFrame:
    """group, token, df, idf = ln((n + 1) / (df + 1)) + 1, and idf_default for tokens that are not in the table."""
    n = records.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    df = document_frequency(records, words, group).where(F.col("df") >= least_df)
    # There are few groups, but their number is the data's: adaptive execution broadcasts the counts if they are small.
    return df.join(n, group).select(group, "token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"), (F.log(F.col("n") + 1) + 1).alias("idf_default"))


def hashed_frequency(records: DataFrame, key: str, words: Column, buckets: int = 1 << 21, group: str = "country") -> DataFrame:
    """group, bucket, df: document frequencies of tokens dealt to buckets by their hash, which need no vocabulary."""
    bucket = (drawn(F.col("token"), 0) % buckets).alias("bucket")
    t = records.select(key, group, F.explode(F.array_distinct(words)).alias("token")).select(key, group, bucket).distinct()
    return t.groupBy(group, "bucket").agg(F.count(F.lit(1)).alias("df"))


def core_counts(records: DataFrame, core: str = "core", group: str = "country") -> DataFrame:
    return records.groupBy(group, core).agg(F.count(F.lit(1)).alias("n"))


def uniqueness(pairs: DataFrame, s1: DataFrame, pool: DataFrame, present: str | None = "present") -> DataFrame:
    """How many records share each side's core name, in either table, and whether the names agree and are unique.

    pairs: qi, pj, core_q, core_c, country_q, country_c. s1 and pool: country, core (and present).
    """
    n1 = core_counts(s1 if present is None else s1.where(F.col(present)))
    n2 = core_counts(pool)

    def counted(df: DataFrame, side: str, table: DataFrame, name: str) -> DataFrame:
        t = table.select(F.col("country").alias(f"country_{side}"), F.col("core").alias(f"core_{side}"), F.col("n").alias(name))
        return df.join(t, [f"country_{side}", f"core_{side}"], "left").withColumn(name, F.coalesce(name, F.lit(0)))

    for side, table, name in (("q", n1, "n_s1_core_q"), ("c", n1, "n_s1_core_c"), ("c", n2, "n_pool_core_c"), ("q", n2, "n_pool_core_q")):
        pairs = counted(pairs, side, table, name)
    same = (F.col("core_q") == F.col("core_c")) & (F.col("country_q") == F.col("country_c"))
    return pairs.withColumn("core_c_eq_unique_s1", (same & (F.col("n_s1_core_c") == 1)).cast("int"))


def learn_dictionary(pairs: DataFrame, is_native, positional: bool = True, min_count: int = 3, min_prob: float = 0.5) -> DataFrame:
    """native, latin, score: the Latin word for each native one, from true pairs.

    pairs: id, q (Latin tokens), c (tokens with native ones). is_native: column -> boolean. Words at equal places of
    texts of equal length count first; other words by association, p * p / base, where longer phrases win ties.
    """
    plain = lambda t: ~is_native(t) & ~t.rlike(r"^\d+$")
    pairs = pairs.where(F.exists("c", is_native))
    n_pairs = pairs.agg(F.count(F.lit(1)).alias("n_pairs"))
    aligned = pairs.where(F.size("q") == F.size("c")).select(F.explode(F.arrays_zip("c", "q")).alias("x")).select(F.col("x.c").alias("native"), F.col("x.q").alias("latin"))
    aligned = aligned.where(is_native(F.col("native")) & plain(F.col("latin")))
    every = Window.partitionBy("native")
    by_place = aligned.groupBy("native", "latin").agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.sum("n").over(every))
    by_place = by_place.where((F.col("n") >= min_count) & (F.col("n") >= min_prob * F.col("of")))
    by_place = by_place.withColumn("r", F.row_number().over(every.orderBy(F.desc("n"), "latin"))).where("r = 1")
    by_place = by_place.select("native", "latin", F.col("n").cast("double").alias("score"))
    if not positional:
        by_place = by_place.limit(0)

    native = pairs.select("id", F.explode(F.array_distinct(F.filter("c", is_native))).alias("native"))
    words = F.array_distinct(F.filter("q", plain))
    if not positional:  # names of places are often two words
        two = F.filter(F.transform("q", lambda t, i: F.when(t.rlike("^[a-z]+$") & F.get("q", i + 1).rlike("^[a-z]+$"), F.concat(t, F.lit(" "), F.get("q", i + 1)))), lambda t: t.isNotNull())
        words = F.array_union(words, two)
    latin = pairs.select("id", F.explode(words).alias("latin"))
    n_native = native.groupBy("native").agg(F.count(F.lit(1)).alias("n_native"))
    n_latin = latin.groupBy("latin").agg(F.count(F.lit(1)).alias("n_latin"))
    together = native.join(latin, "id").groupBy("native", "latin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    found = together.join(by_place.select("native"), "native", "left_anti").join(n_native, "native").join(n_latin, "latin").join(F.broadcast(n_pairs))
    p, base = F.col("n") / F.col("n_native"), F.col("n_latin") / F.col("n_pairs")
    found = found.where((p >= min_prob) & (p > base)).withColumn("score", p * p / base)
    best = Window.partitionBy("native").orderBy(F.desc("score"), F.desc(F.length("latin") - F.length(F.replace("latin", F.lit(" "), F.lit("")))), "latin")
    found = found.withColumn("r", F.row_number().over(best)).where("r = 1").select("native", "latin", "score")
    return by_place.unionByName(found)
