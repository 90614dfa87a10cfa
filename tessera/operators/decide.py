"""Decision rules over scored pairs (qi, pj, p): one-to-one first, then a rule, and the search for a rule's parameters in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_to_one(d: DataFrame) -> DataFrame:
    """The best claimant of each pool record."""
    w = Window.partitionBy("pj").orderBy(F.desc("p"), "qi")
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def prepare_rules(d: DataFrame) -> DataFrame:
    """After one-to-one: rank r (from 0), best mx, running sum run, sum total, and none = ln of the chance that no candidate matches."""
    q = Window.partitionBy("qi")
    order = q.orderBy(F.desc("p"), "pj")
    sure = F.least(F.greatest("p", F.lit(0.0)), F.lit(1 - 1e-6))
    return (
        one_to_one(d)
        .withColumn("r", F.row_number().over(order) - 1)
        .withColumn("mx", F.max("p").over(q))
        .withColumn("run", F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("total", F.sum("p").over(q))
        .withColumn("none", F.sum(F.log1p(-sure)).over(q))
    )


def threshold(t: Column | float) -> Column:
    return F.col("p") >= t


def top1_plus(t1: Column | float, t2: Column | float) -> Column:
    """A lower bar for the best candidate."""
    return ((F.col("r") == 0) & (F.col("p") >= t1)) | ((F.col("r") > 0) & (F.col("p") >= t2))


def relative(t: Column | float, share: Column | float) -> Column:
    return (F.col("p") >= t) & (F.col("p") >= F.col("mx") * share)


def gated(t_entity: Column | float, t1: Column | float, t2: Column | float) -> Column:
    """top1_plus for queries whose chance of a match, e, is high enough."""
    return (F.col("e") >= t_entity) & top1_plus(t1, t2)


def any_match() -> Column:
    """The chance that any candidate of the query matches, taking candidates for independent."""
    return 1 - F.exp("none")


def expected_f(prepared: DataFrame, missed: float = 0.0) -> DataFrame:
    """Keeps the first m candidates of each query that maximise the expected F0.5, unless keeping none is as good."""
    q = Window.partitionBy("qi")
    ef = F.round(1.25 * F.col("run") / (0.25 * (F.col("total") + missed) + F.col("r") + 1), 12)
    s = prepared.withColumn("ef", ef).withColumn("best", F.max("ef").over(q))
    s = s.withColumn("m", F.min(F.when(F.col("ef") == F.col("best"), F.col("r") + 1)).over(q))
    return s.where((F.col("r") + 1 <= F.col("m")) & (F.col("best") > F.exp(F.col("none") - missed))).drop("ef", "best", "m")


def steps(lo: float, hi: float, by: float) -> list[float]:
    """lo, lo + by, ... below hi."""
    n = int((hi - lo) / by - 1e-9) + 1
    return [round(lo + i * by, 3) for i in range(n)]


# Parameters that are tried for each rule.
GRIDS = {
    "threshold": [(t,) for t in steps(0.3, 0.96, 0.025)],
    "top1_plus": [(a, b) for a in steps(0.1, 0.8, 0.1) for b in steps(0.5, 0.96, 0.05) if b >= a],
    "relative": [(t, r) for t in steps(0.3, 0.91, 0.05) for r in (0.5, 0.7, 0.8)],
    "expected_f": [(c,) for c in (0.0, 0.05, 0.1, 0.2)],
    "gated": [(e, a, b) for e in steps(0.0, 0.81, 0.1) for a in steps(0.2, 0.61, 0.1) for b in steps(0.6, 0.86, 0.05)],
}


def grid_search(prepared: DataFrame, entities: DataFrame, rule, points: list[tuple[float, ...]]) -> DataFrame:
    """point, f05 of each parameter point. prepared also has hit (boolean: a true pair); entities: qi, k.

    Each point is a fixed number of columns, so the pairs are aggregated once for all points; the grid is small and fixed.
    """
    kept = [F.struct(F.count(F.when(rule(*x), 1)).alias("n"), F.count(F.when(rule(*x) & F.col("hit"), 1)).alias("tp")).alias(f"g{i}") for i, x in enumerate(points)]
    per_query = entities.join(prepared.groupBy("qi").agg(*kept), "qi", "left")
    f = lambda i: entity_f05(F.col("k"), F.coalesce(f"g{i}.n", F.lit(0)), F.coalesce(f"g{i}.tp", F.lit(0)))
    one = per_query.agg(*(F.avg(f(i)).alias(f"f{i}") for i in range(len(points))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).alias("point"), F.lit(",".join(map(str, x))).alias("params"), F.col(f"f{i}").alias("f05")) for i, x in enumerate(points)))).alias("x")).select("x.*")


RULES = {"threshold": threshold, "top1_plus": top1_plus, "relative": relative, "gated": gated}


def tune(prepared: DataFrame, entities: DataFrame, rule: str) -> DataFrame:
    """point, params, f05 of every point of a rule's grid. prepared has hit, and e for the gated rule; entities: qi, k."""
    if rule != "expected_f":
        return grid_search(prepared, entities, RULES[rule], GRIDS[rule])
    out = None
    for i, (missed,) in enumerate(GRIDS[rule]):  # it keeps whole prefixes, so that each point is a pass of its own
        n = expected_f(prepared, missed).groupBy("qi").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("hit"), 1)).alias("tp"))
        f = entity_f05(F.col("k"), F.coalesce("n", F.lit(0)), F.coalesce("tp", F.lit(0)))
        one = entities.join(n, "qi", "left").agg(F.avg(f).alias("f05")).select(F.lit(i).alias("point"), F.lit(str(missed)).alias("params"), "f05")
        out = one if out is None else out.unionByName(one)
    return out


def choose(prepared: DataFrame, entities: DataFrame, rules: tuple[str, ...] = ("threshold", "top1_plus", "relative", "expected_f", "gated"), tuning: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """rule, params, f05_tune, f05: each rule's best point on the tuning folds, and its score on the others. entities: qi, k, fold."""
    side = F.col("fold").isin(*tuning)
    out = None
    for rule in rules:
        scores = []
        for part, e in (("f05_tune", entities.where(side)), ("f05", entities.where(~side))):
            kept = prepared.join(e.select("qi"), "qi", "left_semi")
            scores.append(tune(kept, e.select("qi", "k"), rule).select("point", "params", F.round("f05", 9).alias(part)))
        both = scores[0].join(scores[1].drop("params"), "point")
        best = both.groupBy().agg(F.max_by(F.struct("params", "f05_tune", "f05"), F.struct("f05_tune", -F.col("point"))).alias("x")).select(F.lit(rule).alias("rule"), "x.*")
        out = best if out is None else out.unionByName(best)
    return out


def apply(prepared: DataFrame, rule: str, params: tuple[float, ...]) -> DataFrame:
    return expected_f(prepared, *params) if rule == "expected_f" else prepared.where(RULES[rule](*params))


def stage(first: DataFrame, second: DataFrame) -> DataFrame:
    """The row of choose's results to decide by: the best rule of the second stage, if it tuned at least as well as the first stage's best."""
    every = first.withColumn("stage", F.lit(1)).unionByName(second.withColumn("stage", F.lit(2)))
    return every.groupBy().agg(F.max_by(F.struct("stage", "rule", "params", "f05_tune", "f05"), F.struct("f05_tune", "stage", "rule")).alias("x")).select("x.*")


def entity_f05(k: Column, n: Column, tp: Column) -> Column:
    """F0.5 of one query with k matches, n predictions and tp of them right; nothing to find and nothing predicted is 1."""
    return F.when((k == 0) & (n == 0), 1.0).when((k == 0) | (n == 0), 0.0).otherwise(1.25 * tp / (0.25 * k + F.greatest(n, F.lit(1))))
