"""Evaluation of pairs against the truth: pairs (qi, pj), owners (pj, owner) and entities (qi, k and more)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decide import entity_f05


def hits(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """Distinct pairs with hit."""
    return pairs.select("qi", "pj").distinct().join(owners, "pj", "left").withColumn("hit", F.coalesce(F.col("owner") == F.col("qi"), F.lit(False)))


def per_entity(pairs: DataFrame, owners: DataFrame, entities: DataFrame) -> DataFrame:
    """entities with npred, tp, f05, size and ceiling (the best F0.5 that the pairs allow)."""
    n = hits(pairs, owners).groupBy("qi").agg(F.count(F.lit(1)).alias("npred"), F.count(F.when(F.col("hit"), 1)).alias("tp"))
    e = entities.join(n, "qi", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("npred", "tp")})
    e = e.withColumn("f05", entity_f05(F.col("k"), F.col("npred"), F.col("tp")))
    return e.withColumn("ceiling", F.when(F.col("k") == 0, 1.0).when(F.col("tp") == 0, 0.0).otherwise(1.25 * F.col("tp") / (0.25 * F.col("k") + F.greatest("tp", F.lit(1)))))


def macro_f05(e: DataFrame, *by: str) -> DataFrame:
    """The eight figures of a set of decisions, for each group. e: from per_entity."""
    lone = F.col("k") == 0
    return e.groupBy(*by).agg(
        F.avg("f05").alias("f05"), F.avg(F.when(lone, F.col("f05"))).alias("f05_singletons"), F.avg(F.when(~lone, F.col("f05"))).alias("f05_nonsingletons"),
        (F.sum("tp") / F.greatest(F.sum("npred"), F.lit(1))).alias("micro_precision"), (F.sum("tp") / F.greatest(F.sum("k"), F.lit(1))).alias("micro_recall"),
        F.avg("npred").alias("avg_pred"), F.avg(F.when(lone, (F.col("npred") > 0).cast("int"))).alias("false_merge_rate"), F.count(F.lit(1)).alias("n_s1"),
    )


def blocking_stats(e: DataFrame, *by: str) -> DataFrame:
    return e.groupBy(*by).agg(
        (F.sum("tp") / F.greatest(F.sum("k"), F.lit(1))).alias("pair_recall"), F.avg("ceiling").alias("ceiling_f05"), F.avg("npred").alias("cand_mean"), F.percentile("npred", 0.5).alias("cand_p50"),
        F.percentile("npred", 0.9).alias("cand_p90"), F.percentile("npred", 0.99).alias("cand_p99"), F.max("npred").alias("cand_max"), F.avg((F.col("npred") == 0).cast("int")).alias("no_cand_rate"),
        F.avg(F.when(F.col("k") > 0, (F.col("tp") == F.col("k")).cast("int"))).alias("full_recall"),
    )


def recall_at(ranked: DataFrame, owners: DataFrame, entities: DataFrame, ks: list[int], rank: str = "fwd_rank") -> DataFrame:
    """k_at, recall, candidates per query: of the first k candidates, for each k."""
    h = ranked.join(owners, "pj", "left").withColumn("hit", F.coalesce(F.col("owner") == F.col("qi"), F.lit(False)))
    one = h.agg(*(F.count(F.when((F.col(rank) < k) & F.col("hit"), 1)).alias(f"h{k}") for k in ks), *(F.count(F.when(F.col(rank) < k, 1)).alias(f"n{k}") for k in ks))
    of = entities.agg(F.sum("k").alias("of"), F.count(F.lit(1)).alias("entities"))
    points = F.array(*(F.struct(F.lit(k).alias("k_at"), (F.col(f"h{k}") / F.col("of")).alias("recall"), (F.col(f"n{k}") / F.col("entities")).alias("cands")) for k in ks))
    return one.join(F.broadcast(of)).select(F.explode(points).alias("x")).select("x.*")


def extrapolation(points: DataFrame, x: str = "pool", y: str = "recall") -> DataFrame:
    """Line of y over log10 of x."""
    lx = F.log10(x)
    return points.agg(F.regr_slope(F.col(y), lx).alias("slope"), F.regr_intercept(F.col(y), lx).alias("intercept"))


def loss_classes(e: DataFrame) -> DataFrame:
    """class, share, loss: where the F0.5 is lost, in five disjoint classes."""
    kind = (
        F.when((F.col("k") == 0) & (F.col("npred") > 0), "false merge")
        .when((F.col("k") > 0) & (F.col("npred") == 0), "nothing predicted")
        .when((F.col("k") > 0) & (F.col("tp") == 0), "all wrong")
        .when(F.col("tp") < F.col("npred"), "some wrong")
        .when(F.col("tp") < F.col("k"), "some missed")
        .otherwise("right")
    )
    n = Window.partitionBy()
    c = e.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("f05")).alias("lost"))
    every = F.sum("n").over(n)  # over the classes, not the entities
    return c.select("class", "n", (F.col("n") / every).alias("share"), (F.col("lost") / every).alias("loss"))


def missed_pairs(truth: DataFrame, blocked: DataFrame, survived: DataFrame, kept: DataFrame) -> DataFrame:
    """reason, n of the true pairs that were not kept: not blocked, filtered cheaply, or rejected by the rule."""
    t = truth.select("qi", "pj").distinct()
    for name, df in (("b", blocked), ("s", survived), ("k", kept)):
        t = t.join(df.select("qi", "pj").distinct().withColumn(name, F.lit(True)), ["qi", "pj"], "left")
    reason = F.when(F.col("k"), "kept").when(F.col("s"), "rejected").when(F.col("b"), "filtered").otherwise("not blocked")
    return t.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def roc_auc(scored: DataFrame, y: str = "y", p: str = "p", *by: str, parts: int = 64) -> DataFrame:
    """Area under the ROC curve by ranks, average precision and log loss.

    Scores are first counted per value. Distinct scores are dealt to ``parts`` ranges, inside of which windows run; what
    lies below and above a range is added from a table with a row for each."""
    c = scored.groupBy(*by, p).agg(F.sum(F.col(y)).alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("neg", F.col("n") - F.col("pos"))
    cuts = sorted(set(c.approxQuantile(p, [i / parts for i in range(1, parts)], 0.01)))
    c = c.withColumn("part", sum((F.coalesce(F.col(p) >= x, F.lit(False)).cast("int") for x in cuts), F.lit(0)))
    sums = c.groupBy(*by, "part").agg(*(F.sum(x).alias(f"{x}_in") for x in ("pos", "neg", "n")))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*by).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(x).alias(f"of_{x}") for x in (*by, "part")), F.coalesce(F.sum("neg_in").over(before), F.lit(0)).alias("neg_0"), F.coalesce(F.sum("pos_in").over(behind), F.lit(0)).alias("pos_0"), F.coalesce(F.sum("n_in").over(behind), F.lit(0)).alias("n_0"))
    same = F.lit(True)
    for x in (*by, "part"):
        same &= F.col(x).eqNullSafe(F.col(f"of_{x}"))
    c = c.join(sums, same)
    up = Window.partitionBy(*by, "part").orderBy(p).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*by, "part").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("below", F.col("neg_0") + F.sum("neg").over(up) - F.col("neg")).withColumn("tp", F.col("pos_0") + F.sum("pos").over(down)).withColumn("all", F.col("n_0") + F.sum("n").over(down))
    sure = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    return c.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"),
        F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("all")), F.sum("pos")).alias("ap"),
        (-F.sum(F.col("pos") * F.ln(sure) + F.col("neg") * F.ln(1 - sure)) / F.sum("n")).alias("log_loss"),
    )


def feature_auc(scored: DataFrame, feature: str, y: str = "y") -> DataFrame:
    """AUC of a single feature; where it is null, its median."""
    median = scored.agg(F.median(feature).alias("_m"))
    filled = scored.join(F.broadcast(median)).select(y, F.coalesce(feature, "_m").alias("p"))
    return roc_auc(filled, y, "p").select(F.lit(feature).alias("feature"), F.greatest("auc", 1 - F.col("auc")).alias("auc"))


def cheap_threshold(scored: DataFrame, grid: list[float], most_loss: float = 0.001) -> DataFrame:
    """The largest threshold of the grid that keeps all but most_loss of the recall. scored: pc, hit."""
    n = scored.agg(F.count(F.when(F.col("hit"), 1)).alias("all"), *(F.count(F.when(F.col("hit") & (F.col("pc") >= t), 1)).alias(f"h{i}") for i, t in enumerate(grid)))
    ok = F.array(*(F.when(F.col(f"h{i}") / F.col("all") >= 1 - most_loss, F.lit(t)) for i, t in enumerate(grid)))
    return n.select(F.coalesce(F.array_max(ok), F.lit(0.0)).alias("t_cheap"))


def match_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """qi, pj, change: pairs that one set has and the other has not."""
    a, b = new.select("qi", "pj").distinct(), old.select("qi", "pj").distinct()
    return a.join(b, ["qi", "pj"], "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(a, ["qi", "pj"], "left_anti").withColumn("change", F.lit("removed")))


def self_estimate(d: DataFrame, kept: DataFrame, entities: DataFrame, *by: str) -> DataFrame:
    """Figures that need no labels: share of queries with an uncertain candidate, mean kept score, low kept share, expected F0.5."""
    s = d.groupBy("qi").agg(F.sum("p").alias("mass"), F.max(F.col("p").between(0.1, 0.9).cast("int")).alias("uncertain"), F.sum(F.log1p(-F.least("p", F.lit(1 - 1e-6)))).alias("none"))
    m = kept.groupBy("qi").agg(F.sum("p").alias("kept_mass"), F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("p") < 0.7, 1)).alias("low"))
    e = entities.join(s, "qi", "left").join(m, "qi", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("mass", "uncertain", "none", "kept_mass", "m", "low")})
    ef = F.when(F.col("m") == 0, F.exp("none")).otherwise(1.25 * F.col("kept_mass") / (0.25 * F.col("mass") + F.col("m")))
    return e.groupBy(*by).agg(
        F.avg("uncertain").alias("uncertain_share"), F.avg("m").alias("kept_per_s1"), F.try_divide(F.sum("kept_mass"), F.sum("m")).alias("mean_p"), F.try_divide(F.sum("low"), F.sum("m")).alias("low_share"), F.avg(ef).alias("est_f05"),
    )
