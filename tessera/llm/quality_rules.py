"""Quality rules by distribution divergence, in DataFrame functions only.

Each language gets two references, counted over all its documents: the shares of character classes, and the shares of
its common words (each at least one ``COMMON``-th of the language's words, so at most COMMON of them). A document is
compared with the references of its language by Jensen-Shannon distance (the square root of the divergence to base 2,
from 0 to 1) and rejected where a distance passes its threshold. Documents of fewer than ``min_words`` words are not
compared. A language of fewer than ``least_words`` words in all tells too little of itself: its documents, and those of
no language, are compared with references over all documents.

Words are counted once, by language; the classes of a language are those of its distinct words times their counts. A
row for each language holds its references; up to FEW_LANGS such rows are broadcast, more are joined by a shuffle.
Words are looked up by 64-bit hashes, in small maps, as a map is walked from its start.

Null and empty texts have no words: every count is 0 and ``base_failed`` is true. Repeated rows are counted each, and
each row is judged by itself, so ties cannot arise. Very long texts are judged whole. Other columns of the input are
ignored, whatever their names. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._columns import GAP, let
from ._spark import cut

#: Languages whose references (some 20 kB each) are broadcast.
FEW_LANGS = 1_000
COMMON = 500
#: Maps over which the common words of a language are dealt.
MAPS = 256
#: Character classes, counted in the words one after the other, each in what the ones before left; then symbols, and what is left at the end. White space is counted apart.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", r"[^\x00-\x7F]+", r"[.,;:'\"?()\-]+")
SYMBOLS = "[#*$%&|<>]+"
NAMES = ["c0", "c2", "c3", "c4", "c5", "c6"]
EVERY = ["c0", "c1", *NAMES[1:]]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def _class_counts(docs: DataFrame, s: Column) -> DataFrame:
    """Adds chars, c0, c2..c6 (characters of each class but white space) and n_symbols of s, a text without white space."""
    docs = docs.withColumn("_left0", s)
    for i, kind in enumerate((*CLASSES, SYMBOLS)):
        docs = docs.withColumn(f"_left{i + 1}", F.regexp_replace(f"_left{i}", kind, ""))
    n = [F.length(f"_left{i}") for i in range(len(CLASSES) + 2)]
    own = [c for c in docs.columns if not c.startswith("_left")]
    taken = [n[i] - n[i + 1] for i in range(len(CLASSES))]
    return docs.select(*own, n[0].cast("long").alias("chars"), *(c.alias(x) for c, x in zip([*taken, n[len(CLASSES)]], NAMES, strict=True)), (n[-2] - n[-1]).cast("long").alias("n_symbols"))


def _part(p: Column, q: Column) -> Column:
    """What one bin adds to twice the divergence."""
    both = p + q
    term = lambda x: F.when(x > 0, x * F.log2(2 * x / both)).otherwise(F.lit(0.0))
    return term(p) + term(q)


def _maps(entries: Column) -> Column:
    """array<map<hash, share>>: the entries (word, q) dealt to MAPS maps by the last bits of their hashes."""
    hashed = F.transform(entries, lambda x: F.struct(F.xxhash64(x["word"]).alias("h"), x["q"].alias("q")))
    return let(hashed, lambda e: F.transform(F.sequence(F.lit(0), F.lit(MAPS - 1)), lambda b: F.map_from_entries(F.filter(e, lambda x: x["h"].bitwiseAND(F.lit(MAPS - 1)) == b))))


def references(docs: DataFrame, least_words: int) -> tuple[DataFrame, bool]:
    """ref_lang, ref_classes, ref_words and ref_size (common words) of every language of docs (lang, text); whether they are few."""
    counted = cut(docs.select("lang", F.explode(_words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    chars = docs.groupBy("lang").agg(F.sum(F.length("text").cast("long")).alias("all_chars"))
    of_words = _class_counts(counted, F.col("word")).groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("words"), F.sum(F.col("n") * F.col("chars")).alias("chars"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in NAMES))
    sums = chars.join(of_words, F.col("lang").eqNullSafe(F.col("of")), "left").na.fill(0)
    sums = cut(sums.select("lang", "words", F.col("all_chars").alias("chars"), "c0", (F.col("all_chars") - F.col("chars")).alias("c1"), *NAMES[1:]))
    few = sums.count() <= FEW_LANGS
    near = F.broadcast if few else (lambda x: x)
    of = sums.select(F.col("lang").alias("of"), "words")
    common = cut(counted.join(near(of), F.col("lang").eqNullSafe(F.col("of"))).where(F.col("n") * COMMON >= F.col("words")).select("lang", "word", "n", "words"))
    # A common word of all documents is a common word of one language at least.
    pooled = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "chars", *EVERY)))
    total = pooled.collect()[0]["words"]
    pool = counted.join(common.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") * COMMON >= F.lit(total))
    own = common.where(F.col("lang").isNotNull() & (F.col("words") >= least_words)).select("lang", "word", "n").unionByName(pool.select(F.lit(None).cast("string").alias("lang"), "word", "n"))
    listed = own.groupBy(F.col("lang").alias("key")).agg(F.sum("n").alias("of_all"), F.collect_list(F.struct("word", "n")).alias("entries"))  # at most COMMON entries
    shares = F.transform("entries", lambda x: F.struct(x["word"].alias("word"), (x["n"] / F.col("of_all")).alias("q")))
    listed = listed.select("key", shares.alias("entries"))
    known = sums.where(F.col("lang").isNotNull() & (F.col("words") >= least_words)).unionByName(pooled.withColumn("lang", F.lit(None).cast("string")))
    by_key = known.join(listed, F.col("lang").eqNullSafe(F.col("key")), "left")
    none = F.filter(F.array(F.struct(F.lit("").alias("word"), F.lit(0.0).alias("q"))), lambda x: x["q"] > 0)
    entries = F.coalesce("entries", none)
    by_key = cut(by_key.select(F.col("lang").alias("key"), F.array(*(F.col(c) / F.greatest(F.col("chars"), F.lit(1)) for c in EVERY)).alias("ref_classes"), _maps(entries).alias("ref_words"), F.size(entries).alias("ref_size")))
    use = F.when(F.col("words") >= least_words, F.col("lang"))
    return cut(sums.select(F.col("lang").alias("ref_lang"), use.alias("use")).join(near(by_key), F.col("use").eqNullSafe(F.col("key"))).drop("use", "key")), few


def _repeats(hashes: Column, n: Column) -> Column:
    """Words inside five-word windows that stand twice or more in the text."""
    two = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    four = lambda h: let(two(h, F.slice(h, F.lit(2), n)), lambda p: two(p, F.slice(p, F.lit(3), n)))
    windows = F.when(n >= 5, let(hashes, lambda h: two(F.slice(four(h), F.lit(1), n - 4), F.slice(h, F.lit(5), n - 4))))

    def covered(h: Column) -> Column:
        in_order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda s: F.array_sort(F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda i: i.isNotNull()))
        span = lambda starts: F.aggregate(F.transform(starts, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(starts, k + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
        return let(let(in_order, again), span)

    return F.coalesce(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h))), F.lit(0)).cast("long")


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, lang, hashes (of the words), c0..c6 and the base columns of the contract."""
    docs = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("words", _words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.select(
        "doc_id", "lang", F.length("text").alias("length"),
        F.size("words").cast("long").alias("n_words"),
        F.array_join("words", "").alias("joined"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    docs = _class_counts(docs, F.col("joined")).drop("joined").withColumnRenamed("chars", "word_chars").withColumn("c1", F.col("length") - F.col("word_chars"))
    docs = docs.withColumn("n_repeat_words", _repeats(F.col("hashes"), F.col("n_words").cast("int")))
    return docs.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def quality_rules(docs: DataFrame, min_words: int = 30, least_words: int = 2_000, most_class: float = 0.22, most_word: float = 0.8) -> DataFrame:
    """The base columns, class_distance and word_distance (null where not compared), and kept."""
    refs, few = references(docs.select("lang", F.coalesce("text", F.lit("")).alias("text")), least_words)
    judged = base_columns(docs).join(F.broadcast(refs) if few else refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    shares = F.array(*(F.col(c) / F.greatest(F.col("length"), F.lit(1)) for c in EVERY))
    by_class = F.aggregate(F.zip_with(shares, "ref_classes", _part), F.lit(0.0), lambda a, x: a + x)
    share = lambda h: F.get(F.col("ref_words"), h.bitwiseAND(F.lit(MAPS - 1)).cast("int"))[h]

    def by_word(found: Column) -> Column:
        """found: the common words of the text, sorted. Bins that the text lacks add their share of the reference."""
        firsts = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | (F.get(found, i) != F.get(found, i - 1)))
        bins = lambda at: F.transform(at, lambda i, k: F.struct(((F.coalesce(F.get(at, k + 1), F.size(found)) - i) / F.size(found)).alias("p"), share(F.get(found, i)).alias("q")))
        total = lambda b: F.aggregate(b, F.lit(1.0), lambda a, x: a + _part(x["p"], x["q"]) - x["q"])
        return F.when(F.size(found) == 0, F.lit(2.0)).otherwise(let(let(firsts, bins), total))

    common = F.array_sort(F.filter("hashes", lambda h: share(h).isNotNull()))
    judge = F.col("n_words") >= min_words
    root = lambda x: F.sqrt(F.greatest(x / 2, F.lit(0.0)))
    judged = judged.withColumn("class_distance", F.when(judge, root(by_class))).withColumn("word_distance", F.when(judge & (F.col("ref_size") > 0), root(let(common, by_word))))
    far = (F.coalesce("class_distance", F.lit(0.0)) > most_class) | (F.coalesce("word_distance", F.lit(0.0)) > most_word)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance")
