"""Pair features. Token sets are made once per record; pairs then only compare arrays. A feature that does not apply is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T


def records(df: DataFrame, key: str) -> DataFrame:
    """key, country and the arrays that the features need. df: key, name, addr, country."""
    df = df.withColumn("nname", T.normalize(F.col("name"), 4, "name")).withColumn("naddr", T.normalize(F.col("addr"), 4, "addr", F.col("country")))
    words = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    df = df.withColumn("name_words", words("nname")).withColumn("core_words", T.core_name(F.col("name_words")))
    return df.select(
        key, "country", "nname", "naddr", F.array_distinct("name_words").alias("name_tok"), F.array_distinct(words("naddr")).alias("addr_tok"), F.array_distinct("core_words").alias("core"),
        F.array_join("core_words", " ").alias("core_text"), F.array_distinct(F.transform("core_words", T.skeleton)).alias("skel"), T.numbers(F.col("addr")).alias("nums"), T.first_number(F.col("addr")).alias("first"),
        T.postcodes(F.col("addr")).alias("zips"), T.has_native(F.col("name")).cast("int").alias("native"), T.trigrams(F.col("nname")).alias("name_tri"), T.trigrams(F.col("naddr")).alias("addr_tri"),
    )


def with_weights(df: DataFrame, key: str, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds to each record its words' weights as entries (token, idf): all vocabularies are counted at once, joined once per record, and never gathered.

    columns: of each array column the name of its entries, and the least number of records a word must stand in."""
    named = lambda c, name, least: F.transform(F.col(c), lambda t: F.struct(F.lit(name).alias("kind"), F.lit(least).alias("least"), t.alias("token")))
    every = F.explode(F.flatten(F.array(*(named(c, *x) for c, x in columns.items()))))
    words = df.select(key, "country", every.alias("x")).select(key, "country", "x.*")
    n = df.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    idf = words.groupBy("country", "kind", "token").agg(F.count(F.lit(1)).alias("df"), F.first("least").alias("least")).where("df >= least").join(n, "country")
    idf = idf.select("country", "kind", "token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    found = words.drop("least").join(idf, ["country", "kind", "token"])
    lists = [F.collect_list(F.when(F.col("kind") == name, F.struct("token", "idf"))).alias(name) for name, _ in columns.values()]
    return df.join(found.groupBy(key).agg(*lists), key, "left")


def with_pair_weights(pairs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The entries of both records of a pair as one map for each name; for a token of both, q's weight."""
    none = F.array().cast("array<struct<token:string,idf:double>>")

    def merged(name: str) -> Column:
        q, c = F.coalesce(F.col(f"q.{name}"), none), F.coalesce(F.col(f"c.{name}"), none)
        own = F.transform(q, lambda x: x["token"])
        return F.map_from_entries(F.concat(q, F.filter(c, lambda x: ~F.array_contains(own, x["token"]))))

    return pairs.withColumns({n: merged(n) for n in names})


def pair_up(cands: DataFrame, q: DataFrame, p: DataFrame) -> DataFrame:
    """qi, pj and both records as structs q and c."""
    left = q.select("qi", F.struct(*(c for c in q.columns if c != "qi")).alias("q"))
    right = p.select("pj", F.struct(*(c for c in p.columns if c != "pj")).alias("c"))
    return cands.join(left, "qi").join(right, "pj")


def set_features() -> dict[str, Column]:
    q, c = (lambda n: F.col(f"q.{n}")), (lambda n: F.col(f"c.{n}"))
    tight_q, tight_c = F.replace(q("core_text"), F.lit(" "), F.lit("")), F.replace(c("core_text"), F.lit(" "), F.lit(""))
    both = (q("naddr") != "") & (c("naddr") != "")
    nums = (F.size(q("nums")) > 0) & (F.size(c("nums")) > 0)
    inter = S.shared(q("nums"), c("nums"))
    return {
        "name_tri_j": S.jaccard(q("name_tri"), c("name_tri")),
        "name_tok_j": S.jaccard(q("name_tok"), c("name_tok")),
        "core_tok_j": S.jaccard(q("core"), c("core")),
        "core_contain": S.containment(q("core"), c("core")),
        "core_exact": (q("core_text") == c("core_text")).cast("int"),
        "nospace_eq": (tight_q == tight_c).cast("int"),
        "nospace_contain": ((F.length(tight_q) >= 4) & (F.length(tight_c) >= 4) & (F.contains(tight_c, tight_q) | F.contains(tight_q, tight_c))).cast("int"),
        "skel_j": S.jaccard(q("skel"), c("skel")),
        "name_ntok_q": F.size(q("name_tok")),
        "name_ntok_c": F.size(c("name_tok")),
        "c_indic": c("native"),
        "addr_empty_c": (c("naddr") == "").cast("int"),
        "addr_ntok_q": F.size(q("addr_tok")),
        "addr_ntok_c": F.size(c("addr_tok")),
        "addr_tri_j": F.when(both, S.jaccard(q("addr_tri"), c("addr_tri"))),
        "addr_tok_j": F.when(both, S.jaccard(q("addr_tok"), c("addr_tok"))),
        "addr_contain": F.when(both, S.containment(q("addr_tok"), c("addr_tok"))),
        "num_n_q": F.size(q("nums")),
        "num_n_c": F.size(c("nums")),
        "num_j": F.when(nums, S.jaccard(q("nums"), c("nums"))),
        "num_share": F.when(nums, (inter > 0).cast("int")),
        "num_contain_c": F.when(nums, inter / F.size(c("nums"))),
        "num_conflict": F.when(nums, (inter == 0).cast("int")),
        "first_eq": F.when((q("first") != "") & (c("first") != ""), (q("first") == c("first")).cast("int")),
        "zip_eq": F.when((F.size(q("zips")) > 0) & (F.size(c("zips")) > 0), (S.shared(q("zips"), c("zips")) > 0).cast("int")),
    }


def idf_features() -> dict[str, Column]:
    """Needs the maps idf_name, idf_addr, idf_name3, idf_addr3 and the defaults idf_default, idf_default3 of q's country (10 for an unknown one)."""
    q, c = (lambda n: F.col(f"q.{n}")), (lambda n: F.col(f"c.{n}"))
    m = lambda n: F.coalesce(F.col(n), F.create_map().cast("map<string,double>"))
    d, d3 = F.coalesce("idf_default", F.lit(10.0)), F.coalesce("idf_default3", F.lit(10.0))
    both = (q("naddr") != "") & (c("naddr") != "")
    words = lambda x: F.filter(x, lambda t: ~t.rlike(r"^\d+$"))
    tq, tc = words(q("addr_tok")), words(c("addr_tok"))
    some = (F.size(tq) > 0) & (F.size(tc) > 0)
    only = F.array_except
    return {
        "core_idf_q": S.idf_overlap(q("core"), c("core"), m("idf_name"), d),
        "core_idf_c": S.idf_overlap(c("core"), q("core"), m("idf_name"), d),
        "addr_idf_q": F.when(both, S.idf_overlap(q("addr_tok"), c("addr_tok"), m("idf_addr"), d)),
        "addr_idf_c": F.when(both, S.idf_overlap(c("addr_tok"), q("addr_tok"), m("idf_addr"), d)),
        "name_tri_idfcos": S.idf_cosine(q("name_tri"), c("name_tri"), m("idf_name3"), d3),
        "name_tri_idfcont": S.idf_containment(q("name_tri"), c("name_tri"), m("idf_name3"), d3),
        "addr_tri_idfcos": F.when(both, S.idf_cosine(q("addr_tri"), c("addr_tri"), m("idf_addr3"), d3)),
        "addr_tri_idfcont": F.when(both, S.idf_containment(q("addr_tri"), c("addr_tri"), m("idf_addr3"), d3)),
        "core_info_q": S.total(S.weights_of(q("core"), m("idf_name"), d)),
        "core_info_c": S.total(S.weights_of(c("core"), m("idf_name"), d)),
        "shared_max_idf": S.max_idf(F.array_intersect(q("core"), c("core")), m("idf_name"), d),
        "unshared_max_idf_q": S.max_idf(only(q("core"), c("core")), m("idf_name"), d),
        "unshared_max_idf_c": S.max_idf(only(c("core"), q("core")), m("idf_name"), d),
        "addr_unshared_max_idf_q": F.when(some, S.max_idf(only(tq, tc), m("idf_addr"), d)),
        "addr_unshared_max_idf_c": F.when(some, S.max_idf(only(tc, tq), m("idf_addr"), d)),
    }


def string_features() -> dict[str, Column]:
    q, c = (lambda n: F.col(f"q.{n}")), (lambda n: F.col(f"c.{n}"))
    tight = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    both = (q("naddr") != "") & (c("naddr") != "")
    return {
        "name_jw": S.jaro_winkler_udf(q("core_text"), c("core_text")),
        "name_tsr": S.set_ratio_udf(q("nname"), c("nname")),
        "name_tsort": S.sort_ratio_udf(q("core_text"), c("core_text")),
        "name_partial": S.partial_ratio_udf(tight(q("core_text")), tight(c("core_text"))),
        "addr_tsr": F.when(both, S.set_ratio_udf(q("naddr"), c("naddr"))),
        "name_ratio": S.ratio_udf(q("nname"), c("nname")),
        "name_jw_full": S.jaro_winkler_udf(q("nname"), c("nname")),
    }


def number_features() -> dict[str, Column]:
    """Fuzzy agreement of numbers: the least edit distance and relative difference over all pairs, and containment."""
    q, c = (lambda n: F.col(f"q.{n}")), (lambda n: F.col(f"c.{n}"))
    cross = F.flatten(F.transform(q("nums"), lambda x: F.transform(c("nums"), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    some = F.size(cross) > 0
    near = lambda t: F.when((F.length(t["x"]) <= 9) & (F.length(t["y"]) <= 9), S.relative_difference(F.try_to_number(t["x"], F.lit("999999999")).cast("double"), F.try_to_number(t["y"], F.lit("999999999")).cast("double")))
    inside = lambda t: (t["x"] != t["y"]) & (F.length(t["x"]) >= 2) & (F.length(t["y"]) >= 2) & (F.contains(t["x"], t["y"]) | F.contains(t["y"], t["x"]))
    return {
        "num_min_edit": F.when(some, F.least(F.array_min(F.transform(cross, lambda t: F.levenshtein(t["x"], t["y"]))), F.lit(99))),
        "num_contain": F.when(some, F.exists(cross, inside).cast("int")),
        "num_min_reldiff": F.when(some, F.least(F.coalesce(F.array_min(F.transform(cross, near)), F.lit(9.0)), F.lit(9.0))),
        "first_edit": F.when((q("first") != "") & (c("first") != ""), F.levenshtein(q("first"), c("first"))),
    }


def with_features(pairs: DataFrame, *groups: dict[str, Column], keep: tuple[str, ...] = ("qi", "pj")) -> DataFrame:
    return pairs.select(*keep, *(c.alias(n) for g in groups for n, c in g.items()))


# The feature lists of the models.
CONTEXT = ["cos", "fwd_rank", "rev_rank", "gap_q", "rev_margin", "mutual", "n_cand_q", "is_s3"]
NAME = ["name_tri_j", "name_tok_j", "core_tok_j", "core_contain", "core_exact", "nospace_eq", "nospace_contain", "skel_j", "name_jw", "name_tsr", "name_tsort", "name_partial", "core_idf_q", "core_idf_c", "name_ntok_q", "name_ntok_c", "c_indic"]
ADDRESS = ["addr_tri_j", "addr_tok_j", "addr_contain", "addr_idf_q", "addr_idf_c", "addr_tsr", "addr_empty_c", "addr_ntok_q", "addr_ntok_c"]
NUMBER = ["num_n_q", "num_n_c", "num_j", "num_share", "num_contain_c", "num_conflict", "first_eq", "zip_eq"]
CHEAP = [*CONTEXT, *NUMBER, "core_tok_j", "name_tok_j", "skel_j", "core_idf_q", "addr_tok_j", "addr_contain"]
FULL = [*CONTEXT, *NAME, *ADDRESS, *NUMBER]
