"""The output contract: lines of result files to findings (severity, rule, n, examples)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLES = 5


def parsed(lines: DataFrame) -> DataFrame:
    """s1, ids (array) of lines ``id<TAB>id,id``. lines: value."""
    parts = F.split("value", "\t", 2)
    ids = F.filter(F.transform(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return lines.where("trim(value) <> ''").where(F.contains("value", F.lit("\t"))).select(F.trim(F.get(parts, F.lit(0))).alias("s1"), ids.alias("ids"))


def finding(rows: DataFrame, rule: str, example: Column, severity: str = "error") -> DataFrame:
    """A row with the count and the first EXAMPLES examples; rows are counted before examples are taken."""
    first = rows.select(example.cast("string").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    shown = first.orderBy("x").limit(EXAMPLES).agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("examples"))
    n = first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return n.join(F.broadcast(shown)).select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), "n", "examples")


def malformed(lines: DataFrame) -> DataFrame:
    bad = lines.where("trim(value) <> ''").where(~F.contains("value", F.lit("\t")))
    return finding(bad, "malformed row", F.col("value"))


def duplicate_rows(r: DataFrame) -> DataFrame:
    return finding(r.groupBy("s1").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate row", F.col("s1"))


def repeated_ids(r: DataFrame) -> DataFrame:
    return finding(r.where(F.size("ids") > F.size(F.array_distinct("ids"))), "repeated id", F.col("s1"))


def wrong_prefix(r: DataFrame, own: str = "S1-", allowed: tuple[str, ...] = ("S2-", "S3-")) -> DataFrame:
    fits = lambda x: ~F.exists(F.array(*map(F.lit, allowed)), lambda p: F.startswith(x, p))
    self_ = finding(r.where(F.exists("ids", lambda x: F.startswith(x, F.lit(own)))), "self match", F.col("s1"))
    other = finding(r.where(F.exists("ids", lambda x: fits(x) & ~F.startswith(x, F.lit(own)))), "wrong prefix", F.col("s1"))
    return self_.unionByName(other)


def unknown_ids(r: DataFrame, pool_ids: DataFrame) -> DataFrame:
    used = r.select(F.explode("ids").alias("id")).distinct()
    return finding(used.join(pool_ids.select("id").distinct(), "id", "left_anti"), "unknown id", F.col("id"))


def coverage(r: DataFrame, s1_ids: DataFrame) -> DataFrame:
    have, want = r.select("s1").distinct(), s1_ids.select(F.col("id").alias("s1")).distinct()
    return finding(want.join(have, "s1", "left_anti"), "missing id", F.col("s1")).unionByName(finding(have.join(want, "s1", "left_anti"), "extra id", F.col("s1")))


def outside_candidates(r: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that are no candidates: a warning."""
    pairs = lambda d: d.select("s1", F.explode("ids").alias("id")).distinct()
    return finding(pairs(r).join(pairs(candidates), ["s1", "id"], "left_anti").select("s1").distinct(), "match is no candidate", F.col("s1"), "warning")


def header(first_line: str | None, expected: str) -> str | None:
    """What is wrong with a file's first line; None if nothing."""
    if first_line is None or not first_line.strip():
        return "empty file"
    if first_line.strip() != expected:
        return "comma-separated" if "\t" not in first_line and "," in first_line else "wrong header"
    return None


def encoding_errors(files: DataFrame) -> DataFrame:
    """Files that are not UTF-8. files: path, content (as spark.read.format("binaryFile") gives them)."""
    return finding(files.where(~F.is_valid_utf8(F.col("content").cast("string"))), "not UTF-8", F.element_at(F.split("path", "/"), -1))


def validate(results: DataFrame, candidates: DataFrame, s1_ids: DataFrame, pool_ids: DataFrame | None = None) -> DataFrame:
    """All findings of two sets of lines (without header)."""
    r, c = parsed(results), parsed(candidates)
    found = [malformed(results), duplicate_rows(r), repeated_ids(r), wrong_prefix(r), coverage(r, s1_ids), outside_candidates(r, c)]
    if pool_ids is not None:
        found.append(unknown_ids(r, pool_ids))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def passed(findings: DataFrame) -> bool:
    """Warnings don't fail."""
    return findings.where("severity = 'error' and n > 0").isEmpty()
