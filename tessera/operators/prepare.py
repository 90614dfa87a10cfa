"""Sources to tables: union, ownership, folds, slices and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Half-open slices of the priority.
SLICES = {"A": (0.0, 0.15), "B": (0.15, 0.30), "FT": (0.50, 0.53), "hidden": (0.30, 0.49), "dictionary": (0.60, 1.01)}


def drawn(key: Column, seed: int = 42) -> Column:
    """A whole number from 0 to 2**32 - 1 that depends on the key alone, on any partitioning and in any engine that has MD5."""
    return F.conv(F.left(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), F.lit(8)), 16, 10).cast("long")


def priority(key: Column, seed: int = 42) -> Column:
    """A number in [0, 1)."""
    return drawn(key, seed) / float(1 << 32)


def fold_of(key: Column, n: int = 5, seed: int = 7) -> Column:
    return (drawn(key, seed) % n).cast("tinyint")


def in_slice(prio: Column, name: str) -> Column:
    lo, hi = SLICES[name]
    return (prio >= lo) & (prio < hi)


def union_sources(**sources: DataFrame) -> DataFrame:
    """One table with the source's name as src."""
    tables = [df.withColumn("src", F.lit(name)) for name, df in sources.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def truth_pairs(truth: DataFrame, key: str = "source1_entity_id", matches: str = "matched_entity_ids") -> DataFrame:
    """(s1, m) of a table with a comma-separated list per row."""
    ids = F.filter(F.split(F.coalesce(matches, F.lit("")), ","), lambda x: F.trim(x) != "")
    return truth.select(F.col(key).alias("s1"), F.explode(F.transform(ids, lambda x: F.trim(x))).alias("m"))


def with_owner(pool: DataFrame, pairs: DataFrame, key: str = "entity_id") -> DataFrame:
    """owner of each pool record; '' where there is none."""
    owners = pairs.select(F.col("m").alias(key), F.col("s1").alias("owner")).dropDuplicates([key])
    return pool.join(owners, key, "left").withColumn("owner", F.coalesce("owner", F.lit("")))


def with_match_count(s1: DataFrame, pairs: DataFrame, key: str = "entity_id") -> DataFrame:
    """k: how many true matches each record has, 0 where there is none."""
    k = pairs.groupBy(F.col("s1").alias(key)).agg(F.count(F.lit(1)).alias("k"))
    return s1.join(k, key, "left").withColumn("k", F.coalesce("k", F.lit(0)))


def propagated(pool: DataFrame, s1: DataFrame, key: str = "entity_id") -> DataFrame:
    """Priority and fold of the owner; of a record without one, its own. pool: owner; s1: key, prio, fold."""
    of = s1.select(F.col(key).alias("owner"), F.col("prio").alias("owner_prio"), F.col("fold").alias("owner_fold"))
    own = F.col(key)
    return pool.join(of, "owner", "left").withColumn("prio", F.coalesce("owner_prio", priority(own))).withColumn("fold", F.coalesce("owner_fold", fold_of(own))).drop("owner_prio", "owner_fold")


def training_pairs(s1: DataFrame, pairs: DataFrame, pool: DataFrame, key: str = "entity_id") -> DataFrame:
    """True pairs (s1, m) of a slice of records, with both sides' columns as structs q and c."""
    q = s1.select(F.col(key).alias("s1"), F.struct(*(c for c in s1.columns if c != key)).alias("q"))
    c = pool.select(F.col(key).alias("m"), F.struct(*(x for x in pool.columns if x != key)).alias("c"))
    return pairs.select("s1", "m").join(q, "s1").join(c, "m")


def build_split(sources: dict[str, DataFrame], truth: DataFrame | None, path: str | None = None, key: str = "entity_id") -> tuple[DataFrame, DataFrame]:
    """The reference table (with prio, fold and k, where the truth is known) and the pool (with owner, prio and fold); written below path, if it is given.

    sources: S1 and the pool's sources by name."""
    s1 = sources["S1"]
    pool = union_sources(**{n: df for n, df in sources.items() if n != "S1"})
    if truth is not None:
        pairs = truth_pairs(truth, s1.columns[0] if "source1_entity_id" not in truth.columns else "source1_entity_id")
        s1 = with_match_count(s1.withColumn("prio", priority(F.col(key))).withColumn("fold", fold_of(F.col(key))), pairs, key)
        pool = propagated(with_owner(pool, pairs, key), s1, key)
    if path:
        for name, df in (("s1", s1), ("pool", pool)):
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        s1, pool = (s1.sparkSession.read.parquet(f"{path}/{name}") for name in ("s1", "pool"))
    return s1, pool


def negatives(positives: DataFrame, q: DataFrame, p: DataFrame, n: int = 1, seed: int = 42, per_slot: int = 4) -> DataFrame:
    """qi, pj: up to n drawn pairs of each query within its country that are no positive ones. q: qi, country; p: pj, country.

    Pool records are dealt to slots of about per_slot by their hash, and a query draws slots: neither a country nor its
    pairs meet anywhere."""
    slots = p.groupBy("country").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / per_slot)).alias("slots"))
    held = p.join(slots, "country").select("pj", "country", (drawn(F.col("pj"), seed) % F.col("slots")).alias("slot"))
    wanted = q.join(slots, "country").select("qi", "country", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: drawn(F.concat_ws("-", "qi", i), seed) % F.col("slots"))).alias("slot"))
    found = wanted.distinct().join(held, ["country", "slot"]).select("qi", "pj").join(positives.select("qi", "pj"), ["qi", "pj"], "left_anti")
    w = Window.partitionBy("qi").orderBy(drawn(F.concat_ws("-", "qi", "pj"), seed), "pj")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def visible(s1: DataFrame, prio: Column) -> DataFrame:
    """Hides a slice of records from reverse search and counts, as the test data's density does."""
    return s1.withColumn("present", ~in_slice(prio, "hidden"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest hashes of the key: the same rows on every run."""
    return df.orderBy(drawn(F.col(key), seed), key).limit(n)
