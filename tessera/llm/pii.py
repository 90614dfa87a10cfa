"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators propose overlapping candidate spans with high recall: the four base formats, e-mail addresses written out
("name (at) host (dot) org") and every longer run of digits with separators. Boosted trees score the latter two from
format and context features that are binned, so that the whole corpus shrinks to a table of feature cells with counts
of base and other spans (pre-aggregated before the shuffle, at most the product of the bins). The trees are grown on
these counts of two thirds of the documents; on the last third a threshold is calibrated, the lowest score whose cells
and those above hold base spans to that kind's share of ``precision`` at least (what is no base span is not wrong but
unlabelled, so the share is below one). A span of the base rules always stays; candidates that pass the
threshold and overlap no base span are added, under the kind whose format they share.

Base, by kind, leftmost and not overlapping within the kind: e-mail addresses; IPv4 addresses with parts of at most
255; card numbers of 13 to 19 digits that pass Luhn's test; phone numbers of 9 to 15 digits after a plus. The patterns
below find the same matches as the plain ones of the contract in linear time: a match can start only at the head of a
run of its characters, or where the match before ended.

Null and empty texts have no spans and the hash of the empty string. Repeated rows are each searched. A tie in the
start of spans of one kind cannot occur. Other columns are ignored; an empty table gives none. Offsets are code points.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._columns import let

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Formats wider than the base ones: an address written out; a run of 7 to 24 digits.
AT, DOT = r"\x20?(?:\(at\)|\[at\]|@)\x20?", r"\x20?(?:\(dot\)|\[dot\]|\.)\x20?"
WIDE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++",
    "digits": r"(?<![0-9])(?<![0-9][\x20().-])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
}
#: Cheap tests that a text may hold a match at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
WIDE_HINTS = {"email": r"@|[(\[]at[)\]]", "digits": r"[0-9](?:[\x20().-]{0,2}[0-9]){6}"}
#: Characters of context on each side of a candidate.
CONTEXT = 24


def found(text: Column, pattern: str, hint: str) -> Column:
    """array<struct<start, stop, s, before, after>> of the matches, in order; null where the hint fails."""

    def cut_up(parts: Column, matches: Column) -> Column:
        step = lambda a, k: F.struct(
            (a["pos"] + F.length(F.get(parts, k)) + F.length(F.get(matches, k))).alias("pos"),
            F.array_append(
                a["out"],
                F.struct(
                    (a["pos"] + F.length(F.get(parts, k))).alias("start"),
                    (a["pos"] + F.length(F.get(parts, k)) + F.length(F.get(matches, k))).alias("stop"),
                    F.get(matches, k).alias("s"),
                    F.right(F.get(parts, k), F.lit(CONTEXT)).alias("before"),
                    F.left(F.get(parts, k + 1), F.lit(CONTEXT)).alias("after"),
                ),
            ).alias("out"),
        )
        zero = F.struct(F.lit(0).alias("pos"), F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit("").alias("s"), F.lit("").alias("before"), F.lit("").alias("after"))), lambda x: x["stop"] > 0).alias("out"))
        return F.when(F.size(matches) > 0, F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, step, lambda a: a["out"]))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(hint), let(F.split(text, pattern, -1), lambda p: let(matches, lambda m: cut_up(p, m))))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def luhn(d: Column) -> Column:
    def twice(k: Column) -> Column:
        x = F.substring(d, F.length(d) - k, F.lit(1)).cast("int") * (1 + k % 2)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, k: a + twice(k)) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(s, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")).between(4, 1 << 30) | (F.left(F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 3, "0"), F.lit(3)) > "255"))
    if kind == "card":
        return let(digits(s), lambda d: F.length(d).between(13, 19) & luhn(d))
    if kind == "phone":
        return F.length(digits(s)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """Of each kind: array of struct(kind, start, stop), empty where there is none."""
    none = F.filter(F.array(F.struct(F.lit("").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("stop"))), lambda x: x["stop"] > 0)

    def of(kind: str) -> Column:
        hits = F.filter(found(text, PATTERNS[kind], HINTS[kind]), lambda x: valid(kind, x["s"]))
        return F.coalesce(F.transform(hits, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))), none)

    return {kind: of(kind) for kind in KINDS}


#: Formats of which spans are added (addresses, cards, phone numbers), and the share of base spans asked for. Numbers that
#: only look like cards are common, as Luhn's test is passed by one in ten. What looks like an IP address is one by the base rule or never.
PRECISION = {0: 0.5, 2: 0.9, 3: 0.5}
#: Features: name, bins. The plus of a phone number and Luhn's test, by which the base rules decide, are not among them.
FEATURES = (("format", 4), ("digits", 6), ("groups", 4), ("brackets", 2), ("glued", 2), ("cue", 6))


def candidates(text: Column) -> Column:
    """array of struct(start, stop, features) of the wide formats."""

    def features(kind: str, x: Column) -> Column:
        d, s = F.length(digits(x["s"])), F.regexp_replace(x["s"], r"^\+", "")
        groups = F.size(F.split(s, "[^0-9A-Za-z]+"))
        form = F.lit(0) if kind == "email" else F.when(s.rlike(r"^[0-9]+(\.[0-9]+){3}$"), 1).when(d >= 13, 2).otherwise(3)
        bin_d = F.lit(0) if kind == "email" else F.when(d <= 8, 0).when(d <= 12, 1).when(d <= 15, 2).when(d == 16, 3).when(d <= 19, 4).otherwise(5)
        near = F.lower(x["before"])
        cue = F.when(near.rlike("phone|tel|call|fax|mobile|cell"), 1).when(near.rlike("card|visa|credit|account|iban"), 2).when(near.rlike(r"mail|contact|write"), 3).when(near.rlike(r"\bip\b|host|server|addr"), 4).when(near.rlike("token|key|hash|sha|uuid|serial|version|isbn"), 5).otherwise(0)
        return F.struct(
            x["start"].alias("start"), x["stop"].alias("stop"), form.alias("format"), bin_d.alias("digits"),
            (F.lit(0) if kind == "email" else F.least(groups, F.lit(4)) - 1).alias("groups"), (F.lit(0) if kind == "email" else s.rlike(r"[(\[]").cast("int")).alias("brackets"),
            (x["before"].rlike(r"[A-Za-z0-9_\"]$") | x["after"].rlike("^[A-Za-z0-9_]")).cast("int").alias("glued"), cue.alias("cue"),
        )

    def part(kind: str) -> Column:
        return F.transform(found(text, WIDE[kind], WIDE_HINTS[kind]), lambda x: features(kind, x))

    blank = F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit("0").alias("s"), F.lit("").alias("before"), F.lit("").alias("after"))
    empty = F.filter(F.array(features("digits", blank)), lambda x: x["stop"] > 0)
    return F.concat(*(F.coalesce(part(k), empty) for k in WIDE))


def overlaps(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))


class Trees:
    """Boosted stumps on pairs of binned features, on cells with counts: the log-odds of a base span."""

    def __init__(self, cells: list[tuple[tuple[int, ...], float, float]], rounds: int = 24, rate: float = 0.4):
        positive, every = sum(p for _, p, _ in cells), sum(p + n for _, p, n in cells)
        self.start = log((positive + 1) / (every - positive + 1))
        self.trees: list[tuple[int, int, int, int, tuple[float, ...]]] = []
        scores = [self.start] * len(cells)
        pairs = [(i, a, j, b) for i, (_, na) in enumerate(FEATURES) for a in range(na) for j, (_, nb) in enumerate(FEATURES) for b in range(nb) if i < j]
        for _ in range(rounds if cells else 0):
            grads = []
            for (x, p, n), s in zip(cells, scores, strict=True):
                q = 1 / (1 + exp(-s))
                grads.append((x, p - (p + n) * q, (p + n) * q * (1 - q)))
            best = None
            for i, a, j, b in pairs:
                sums = [[0.0, 1.0] for _ in range(4)]
                for x, g, h in grads:
                    leaf = sums[2 * (x[i] == a) + (x[j] == b)]
                    leaf[0] += g
                    leaf[1] += h
                gain = sum(g * g / h for g, h in sums)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, (i, a, j, b, tuple(rate * g / h for g, h in sums)))
            self.trees.append(best[1])
            scores = [self.score(x) for x, _, _ in cells]

    def score(self, x: tuple[int, ...]) -> float:
        return self.start + sum(leaves[2 * (x[i] == a) + (x[j] == b)] for i, a, j, b, leaves in self.trees)

    def column(self, x: Column) -> Column:
        out = F.lit(self.start)
        for i, a, j, b, leaves in self.trees:
            one, two = x[FEATURES[i][0]] == a, x[FEATURES[j][0]] == b
            out += F.when(one & two, leaves[3]).when(one, leaves[2]).when(two, leaves[1]).otherwise(leaves[0])
        return out


def learn(docs: DataFrame, precision: dict[int, float]) -> tuple[Trees, dict[int, float]]:
    """The trees and the calibrated threshold of each format, from the counts of feature cells over all documents."""
    text = F.coalesce("text", F.lit(""))
    hinted = docs.select("doc_id", text.alias("text")).where(text.rlike("|".join(WIDE_HINTS.values())))
    spans = base_spans(F.col("text"))
    hinted = hinted.select("doc_id", F.concat(*spans.values()).alias("base"), candidates(F.col("text")).alias("wide"))
    x = hinted.select((F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("calibrate"), "base", F.explode("wide").alias("x"))
    keys = [F.col("x")[n].alias(n) for n, _ in FEATURES]
    counted = x.groupBy("calibrate", *keys, overlaps(F.col("x"), F.col("base")).alias("is_base")).agg(F.count(F.lit(1)).alias("n")).collect()
    halves: tuple[dict, dict] = ({}, {})
    for r in counted:
        halves[r["calibrate"]].setdefault(tuple(r[n] for n, _ in FEATURES), [0, 0])[0 if r["is_base"] else 1] += r["n"]
    trees = Trees([(k, float(p), float(n)) for k, (p, n) in sorted(halves[0].items())])
    thresholds = {}
    for kind, least in precision.items():
        good = every = 0
        for s, p, n in sorted(((trees.score(k), p, n) for k, (p, n) in halves[1].items() if k[0] == kind), reverse=True):
            good, every = good + p, every + p + n
            if good >= least * every:
                thresholds[kind] = s - 1e-9
    return trees, thresholds


def find_pii(docs: DataFrame, precision: dict[int, float] = PRECISION) -> DataFrame:
    """doc_id, counts and hash of the base spans, all spans as text, n_added and n_spans (all)."""
    trees, thresholds = learn(docs, precision)
    spans = base_spans(F.col("text"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", *(c.alias(k) for k, c in spans.items()))
    passed = lambda x: F.coalesce(*(F.when(x["format"] == k, trees.column(x) >= t) for k, t in thresholds.items()), F.lit(False))
    wide = F.filter(candidates(F.col("text")), lambda x: passed(x) & ~F.exists(F.array(*KINDS), lambda b: overlaps(x, b)))
    named = lambda x: F.struct(F.when(x["format"] == 0, "email").when(x["format"] == 1, "ip").when(x["format"] == 2, "card").otherwise("phone").alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))
    docs = docs.withColumn("added", F.transform(wide, named))

    def text_of(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")

    def of(kind: str) -> Column:
        return F.array_sort(F.concat(kind, F.filter("added", lambda x: x["kind"] == kind)))

    every = F.concat(*map(of, KINDS))
    return docs.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(text_of(F.concat(*KINDS)), 256).alias("base_sha256"),
        text_of(every).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.size(every).cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, spans: DataFrame, marker: str = "[PII]") -> DataFrame:
    """docs with the text of every span of find_pii (joined on doc_id) replaced by the marker; overlapping spans as one."""
    cut = F.transform(F.filter(F.split("spans", ","), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(2)).cast("int").alias("a"), F.split_part(x, F.lit(":"), F.lit(3)).cast("int").alias("b")))
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    step = lambda a, x: F.struct(
        F.greatest(a["pos"], x["b"]).alias("pos"),
        F.when(x["a"] >= a["pos"], F.concat(a["out"], F.substring(F.col("text"), a["pos"] + 1, x["a"] - a["pos"]), F.lit(marker))).otherwise(a["out"]).alias("out"),
    )
    joined = docs.join(spans.select("doc_id", "spans"), "doc_id")
    whole = F.aggregate(F.array_sort(cut), zero, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["pos"] + 1, F.length("text"))))
    return joined.withColumn("text", F.when(F.col("spans") == "", F.col("text")).otherwise(whole)).select(*docs.columns)
