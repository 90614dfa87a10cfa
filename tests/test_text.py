import time

from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.functions import text as T


def values(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column).collect()]


def test_skeleton(spark):
    assert values(spark, T.skeleton(F.col("t")), "private", "praivet", "piraivet", "aditya", "1287", "") == ["prvt", "prvt", "prvt", "adt", "1287", ""]


def test_normalize(spark):
    t = F.col("t")
    assert values(spark, T.normalize(t, 1, "addr"), "1287b 21st", "0137", "l l c", "llc llc", "Café  Ünal", "", None) == ["1287 b 21st", "137", "llc", "llc", "cafe unal", "", ""]
    assert values(spark, T.normalize(t, 1), "Acme #123 & Sons 5551234567", "https://www.acme-x.com", "O'Neil <null>") == ["acme and sons", "acme x", "oneil"]
    assert values(spark, T.normalize(t, 4), "Acme Private Limited", "Acme praivet limitd") == ["acme pvt ltd", "acme pvt ltd"]
    assert values(spark, T.normalize(t, 4, "addr", F.lit("US")), "12 North Street, New York", "Plot no 7 West Virginia Road") == ["12 n st ny", "7 wv rd"]
    assert values(spark, T.normalize(t, 4, "addr", F.lit("France")), "3 bis Rue de la Paix, Paris") == ["3 rue paix idf"]
    assert values(spark, T.normalize(t, 0), "  A​  b ") == ["a b"]


def test_numbers(spark):
    assert values(spark, T.numbers(F.col("t")), "1287-B", "674-678, 0674", "none") == [["1287"], ["674", "678"], []]
    assert values(spark, T.postcodes(F.col("t")), "560 001 x 12345 1234567") == [["560001", "12345"]]
    assert values(spark, T.trigrams(F.col("t")), "", "ab") == [[], [" ab", "ab "]]
    assert values(spark, F.array_join(T.core_name(F.split("t", " ")), " "), "acme pvt ltd", "the co") == ["acme", "the co"]


def test_trigrams_of_long_texts(spark):
    """Whole texts: in time that grows with their length, by code points."""
    text = " ".join(f"wörd{i}\n😀" for i in range(30_000))
    padded = f" {text} "
    began = time.time()
    assert set(values(spark, T.trigrams(F.lower("t")), text)[0]) == {padded[i : i + 3] for i in range(len(text))}
    assert time.time() - began < 20
    assert values(spark, T.trigrams(F.col("t")), "😀", None, "\n\n") == [[" 😀 "], [], [" \n\n", "\n\n "]]


def test_string_similarities():
    assert abs(S.winkler("martha", "marhta") - 0.961111) < 1e-5
    assert S.ratio("", "") == 1 and S.ratio("abc", "") == 0 and abs(S.ratio("abcd", "abxd") - 0.75) < 1e-9
    assert S.set_ratio("a b c", "c b a x") == 1 and S.set_ratio("", "a") == 0
    assert S.partial_ratio("abc", "xxabcxx") == 1


def test_set_similarities(spark):
    e, a, b = F.array().cast("array<string>"), F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"))
    got = spark.range(1).select(S.jaccard(e, e), S.jaccard(e, e, None), S.jaccard(a, b), S.containment(a, b), S.containment(a, e)).first()
    assert tuple(got) == (0.0, None, 0.5, 1.0, 0.0)


def test_compatibility_and_native(spark):
    t = F.col("t")
    assert values(spark, T.normalize(t, 1), "ﬁne № 5 ① ＡＢＣ", "½ x") == ["fine no 5 1 abc", "1 2 x"]
    assert values(spark, T.normalize(t, 2), "शर्मा", "क ख", "acme") == ["sharma", "ka kha", "acme"]
    assert values(spark, T.normalize(t, 1), "शर्मा") == ["शर्मा"]
    d, o = F.create_map(F.lit("शर्मा"), F.lit("verma co")), F.create_map(F.lit("खान"), F.lit("khan"))
    assert values(spark, T.normalize(t, 3, dictionary=d, other=o), "शर्मा खान क") == ["verma co khan ka"]
    assert values(spark, T.native_runs(t), "a शर्मा b क") == [["शर्मा", "क"]]
    assert values(spark, T.plain_words(t), "Café-Ünal, №1!") == ["cafe unal no1"]


def test_long_strings():
    a = "ab c" * 3000
    assert S.jaro(a, a[:-1] + "x") > 0.99 and S.jaro("", "a") == 0 and S.jaro("a", "b") == 0
