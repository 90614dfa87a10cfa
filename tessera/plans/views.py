"""Roles of entity resolution over the test tables: records, vectors, scored pairs, truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries (qi) and pool (pj) with country and vec."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qi"), F.col("label").alias("country"), F.col("embedding").alias("vec"))
    p = e.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("pj"), F.col("label").alias("country"), F.col("embedding").alias("vec"))
    return q, p


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: doc_id, name (the whole text in one line), addr, country, src."""
    d = table(spark, sf_dir, "documents")
    addr = F.concat(F.col("source"), F.lit(", "), F.col("n_chars"), F.lit(" Main Road, "), F.col("n_chars") % 97)
    return d.select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("name"), addr.alias("addr"), F.col("lang").alias("country"), F.when(F.col("doc_id") % 2 == 0, "S2").otherwise("S3").alias("src"))


def named_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stated set of queries (every row whose id is divisible by 100), and all rows as the pool."""
    d = named(spark, sf_dir)
    return d.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "qi"), d.withColumnRenamed("doc_id", "pj")


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qi, pj: each document with the one that follows it, of any country."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.select(F.col("doc_id").alias("qi"), (F.col("doc_id") + 1).alias("pj")).join(d.withColumnRenamed("doc_id", "pj"), "pj", "left_semi")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records of short values: id, name, addr, country."""
    d = table(spark, sf_dir, "part")
    addr = F.concat(F.col("p_size"), F.lit(" "), F.col("p_brand"), F.lit(" Road, "), F.col("p_partkey") % 89)
    return d.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name"), addr.alias("addr"), F.when(F.col("p_size") % 2 == 0, "US").otherwise("India").alias("country"))


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qi, pj: each part with the one that follows it."""
    d = table(spark, sf_dir, "part").select("p_partkey")
    return d.select(F.col("p_partkey").alias("qi"), (F.col("p_partkey") + 1).alias("pj")).join(d.withColumnRenamed("p_partkey", "pj"), "pj", "left_semi")


def scored(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """qi, pj, p, src: orders as queries, parts as pool records, a score that depends on the keys. dealt: by pj at once, for windows over a pool record's pairs."""
    li = table(spark, sf_dir, "lineitem")
    if dealt:
        li = li.select("l_orderkey", "l_partkey", "l_linenumber").repartition("l_partkey")
    p = ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 31) % 10007).cast("double") / 10007
    s = li.groupBy(F.col("l_orderkey").alias("qi"), F.col("l_partkey").alias("pj")).agg(F.max(p).alias("p"))
    return s.withColumn("src", F.when(F.col("pj") % 2 == 0, "S2").otherwise("S3"))


def owners(pairs: DataFrame) -> DataFrame:
    return pairs.where("(qi + pj) % 3 = 0").groupBy("pj").agg(F.min("qi").alias("owner"))


def entities(spark: SparkSession, sf_dir: str, own: DataFrame) -> DataFrame:
    """qi, k, country."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qi"), F.substring("o_orderpriority", 1, 1).alias("country"))
    k = own.groupBy(F.col("owner").alias("qi")).agg(F.count(F.lit(1)).alias("k"))
    return o.join(k, "qi", "left").withColumn("k", F.coalesce("k", F.lit(0)))


def words(column):
    return F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda t: t != "")
