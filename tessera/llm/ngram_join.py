"""N-gram Jaccard self join of documents by a size-aware heavy-light join.

A document's set holds the distinct k-word shingles of its text (all its words as one, if they are fewer). Two sets link
when 100 * intersection >= percent * union. Documents of equal sets form a class, named by a 64-bit signature of the
set; classes are joined, never copies.

Shingles are ordered from rare to frequent, by the counts of a sketch of a fixed size over all documents and then by
hash. Two linked sets of n and more shingles share m among the first n - ceil(percent * n / 100) + m of either. Small
(light) sets enumerate all two-element subsets of that prefix (m = 2), and two of them meet in a subset; large (heavy)
sets, and light ones that can link with heavy ones, stand in the inverted lists of the shingles of their prefix (m = 1),
which are scanned. The boundary in set size is chosen by cost: enumerating pays as long as its rows cost less than the
rows and candidates of list scanning, given the list lengths that the sketch estimates.

Buckets (subsets and lists) do not emit all their pairs. A pair becomes a row only if bounds allow a link: the sizes; the
places of the shared shingle in both sets (what stands before it is not shared, in the first bucket that both are in);
and, in buckets of more than SMALL classes, 512 bits of parity of either set, whose differing bits are at most the
shingles that only one has. Small buckets are scanned whole. In a large one every class is first held against the most
central one (that has the most company in all its buckets), then against more and more drawn ones; what was verified
joins components, only classes of different components go on, and once few comparisons are left for each class in all
buckets, they are made at once. All pairs of different components are compared in the end: no link between them is lost.
Candidates pass a longer parity bitmap and are verified on whole sets, fetched from the documents once more.

Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; shingles are compared by 64-bit hashes.
Null, empty and blank texts have empty sets, link with nothing and are components of their own. A row without a doc_id
links with nothing and has no component. Repeated rows count as copies. Rows of one doc_id with different texts are
compared each, under the same name. Ties go to the smaller doc_id. Very long texts are sets like others, worked on
whole. Other columns are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._sketch import filter_of, has_bits, merged, pack
from ._spark import cut
from ._tokens import SPACE, U, grams, mix, tokens

SLOT_BITS = 21
#: Least bits of parity of a set, which are also those that pairs of a large bucket are held against.
PARITY = 512
FOLDS = [f"f{i}" for i in range(PARITY // 64)]
#: Rows that one candidate pair costs, in enumerating or scanning.
PAIR_COST = 1
#: Buckets of more classes are worked on in rounds.
SMALL = 16
#: Comparisons inside large buckets that may be left for the last round, for each class in a bucket.
LEFT = 32

def _order(g: np.ndarray, r: np.ndarray, rows: int) -> np.ndarray:
    """What sorts by row and hash: one sort of the rows and the first bits of the hashes, which tell nearly all apart."""
    bits = U(max(1, int(rows).bit_length()))
    key = (r.astype(U) << (U(64) - bits)) | (g >> bits)
    order = np.argsort(key)
    key, g = key[order], g[order]
    if ((key[1:] == key[:-1]) & (g[1:] != g[:-1])).any():
        return order[np.lexsort((g, key))]
    return order


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, distinct shingles, their rows), sorted by row and hash."""
    for lo, hi, h, row in tokens(texts, SPACE):
        n = np.bincount(row, minlength=hi - lo)
        g, at = grams(h, row, k)
        parts, rows = [g], [row[at]]
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        for m in range(1, k):
            short = np.flatnonzero(n == m)
            if len(short):
                acc = np.zeros(len(short), U)
                for j in range(m):
                    acc = acc * U(0x9E3779B97F4A7C15) + h[first[short] + j]
                parts.append(mix(acc + U(m << 8)))
                rows.append(short)
        g, r = np.concatenate(parts), np.concatenate(rows)
        order = _order(g, r, hi - lo)
        g, r = g[order], r[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        yield lo, hi, g[new], r[new]


def _signatures(g: np.ndarray, r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and signatures of the sets."""
    size = np.bincount(r, minlength=n)
    some = np.flatnonzero(size)
    sig = np.zeros(n, U)
    if len(some):
        first = np.concatenate([[0], np.cumsum(size[some])[:-1]])
        one, two = np.add.reduceat(mix(g + U(0x51)), first), np.add.reduceat(mix(g ^ U(0xA5A5A5A5A5A5A5A5)), first)
        sig[some] = mix(one * U(0x9E3779B97F4A7C15) + two)
    return size, sig


def _slots(g: np.ndarray) -> np.ndarray:
    return (g >> U(64 - SLOT_BITS)).astype(np.int64)


def _parities(g: np.ndarray, r: np.ndarray, size: np.ndarray) -> list[bytes | None]:
    """Of each set a bitmap in which every shingle flips one bit; two to four bits a shingle, in powers of two."""
    out: list[bytes | None] = [None] * len(size)
    level = np.where(size > 0, np.frexp(np.maximum(size, PARITY // 4))[1] + 1, 0)  # 2**level bits
    of = level[r]
    for x in np.unique(level[size > 0]):
        rows = np.flatnonzero(level == x)
        place = np.zeros(len(size), np.int64)
        place[rows] = np.arange(len(rows))
        some = of == x
        # A row at a time costs much for small sets, all rows much memory for large ones.
        bit = place[r[some]] << int(x) | (mix(g[some] ^ U(0x70)) & U((1 << int(x)) - 1)).astype(np.int64)
        step = max(1, (1 << 22) >> int(x))
        for lo in range(0, len(rows), step):
            hi = min(lo + step, len(rows))
            part = bit[np.searchsorted(bit >> int(x), lo) : np.searchsorted(bit >> int(x), hi)] - (lo << int(x))
            flips = np.packbits((np.bincount(part, minlength=(hi - lo) << int(x)) & 1).astype(bool), bitorder="little").reshape(hi - lo, -1)
            for row, one in zip(rows[lo:hi], flips, strict=True):
                out[row] = one.tobytes()
    return out


def _folded(parity: bytes, bits: int) -> int:
    """A bitmap brought to fewer bits: a shingle's bit is its hash modulo their number."""
    x, n = int.from_bytes(parity, "little"), len(parity) * 8
    while n > bits:
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    return x


def _summaries(k: int):
    """Per document: doc_id, size, signature and parity; at the end of a partition: the counts of its shingles by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.uint32)
        names = ["doc_id", "n", "sig", "parity", "sketch"]
        for batch in batches:
            for lo, hi, g, r in _sets(batch.column(1), k):
                np.add.at(total, _slots(g), np.uint32(1))
                size, sig = _signatures(g, r, hi - lo)
                parity = pa.array(_parities(g, r, size), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size.astype(np.int64)), pa.array(sig.view(np.int64)), parity, pa.nulls(hi - lo, pa.binary())], names)
        if total.any():
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(1, pa.binary()), pa.array([pack(total.astype(np.int64))], pa.binary())], names)

    return run


def needed(n, percent: int):
    """Least overlap of a set of n with one that it links with: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def boundary(counts: np.ndarray, percent: int) -> int:
    """The largest size of sets that enumerate subsets."""
    every = int(counts.sum())
    slots = len(counts)
    # Mean length of a random shingle's list, less what other shingles of the same slot add.
    pairs = float((counts.astype(float) ** 2).sum())
    mean = max(0.0, (pairs - every * every / slots) * slots / (slots - 1) / max(every, 1) - 1)
    rare = min(mean, 2.0)  # the lists of a prefix are among the shortest
    size = 1
    for n in range(2, 2000):
        prefix = n - needed(n, percent)
        subsets, scanned = (prefix + 2) * (prefix + 1) // 2, (prefix + 1) * (1 + rare * PAIR_COST)
        if subsets > scanned:
            break
        size = n
    return size


def _postings(k: int, percent: int, sketch, light: int):
    """bucket, sig, n, pos (of the bucket's first shingle in the set) of the first document of each set in a batch. sketch: broadcast counts by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            seen = np.zeros(0, U)
            for lo, hi, g, r in _sets(batch.column(0), k):
                size, sig = _signatures(g, r, hi - lo)
                new = np.zeros(hi - lo, bool)
                new[np.unique(sig, return_index=True)[1]] = True
                # A set that can only link with equal ones needs no bucket.
                new &= (size > 0) & (100 * size >= percent * (size + 1)) & ~np.isin(sig, seen)
                seen = np.concatenate([seen, sig[new]])
                keep = new[r]
                g, r = g[keep], r[keep]
                if not len(g):
                    continue
                # By row and count; the hashes of a row are in order already.
                g = g[np.argsort((r.astype(U) << U(32)) | counts[_slots(g)], kind="stable")]
                size = np.where(new, size, 0)
                first = np.concatenate([[0], np.cumsum(size)[:-1]])
                place = np.arange(len(g)) - first[r]
                n, prefix = size[r], (size - needed(size, percent))[r]
                lists = (place < prefix + 1) & (100 * n > percent * light)
                buckets, rows, at = [mix(g[lists] ^ U(0x11))], [r[lists]], [place[lists]]
                chosen = (place < prefix + 2) & (n <= light)
                p, q, place = g[chosen], r[chosen], place[chosen]
                for step in range(1, int(place.max(initial=0)) + 1):
                    a = np.arange(len(p) - step)
                    a = a[q[a] == q[a + step]]
                    # Two sets may order a pair alike only: order is global.
                    buckets.append(mix(mix(p[a]) * U(3) + p[a + step]))
                    rows.append(q[a])
                    at.append(place[a])
                b, d, at_ = (np.concatenate(x) for x in (buckets, rows, at))
                yield pa.RecordBatch.from_arrays([pa.array(b.view(np.int64)), pa.array(sig[d].view(np.int64)), pa.array(size[d].astype(np.int32)), pa.array(at_.astype(np.int32))], ["bucket", "sig", "n", "pos"])

    return run


def _marked(bits):
    """The postings whose buckets are in a filter. bits: broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_bits(bits.value, mix(batch.column(0).to_numpy().view(U)))))

    return run


def _fetched(k: int, bits):
    """sig and shingles of the documents whose doc_id is in a filter. bits: broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = batch.column(1).take(pa.array(np.flatnonzero(has_bits(bits.value, mix(ids.view(U))))))
            for lo, hi, g, r in _sets(part, k):
                size, sig = _signatures(g, r, hi - lo)
                sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(g.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), sets], ["sig", "shingles"])

    return run


def _near(percent: int):
    """The pairs a, b whose whole parity bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            apart = np.zeros(len(n), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = x.as_py(), y.as_py()
                bits = 8 * min(len(x), len(y))
                apart[i] = (_folded(x, bits) ^ _folded(y, bits)).bit_count()
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * apart <= (100 - percent) * n))

    return run


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of signatures whose sets link."""

    def joined(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(of.select(F.col("sig").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
        return pairs

    whole = joined(pairs, classes, ["n", "parity"]).select("a", "b", "n_a", "n_b", "parity_a", "parity_b")
    near = cut(whole.mapInArrow(_near(percent), "a long, b long"))
    wanted = near.select(F.col("a").alias("sig")).unionByName(near.select(F.col("b").alias("sig"))).distinct()
    ids = cut(classes.join(wanted, "sig", "left_semi").select("cid"))
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(ids))
    sets = docs.mapInArrow(_fetched(k, bits), "sig long, shingles array<bigint>")
    # Copies, and documents that only look wanted, go: a set is sent once.
    sets = cut(sets.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.first("shingles").alias("shingles")))
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    links = 100 * both >= percent * (F.size("shingles_a") + F.size("shingles_b") - both)
    return cut(joined(near, sets, ["shingles"]).where(links).select("a", "b"))


def _allowed(percent: int, folds: bool) -> Column:
    """Whether two classes of a bucket (the second one's columns end in 2) may link."""
    n, n2 = F.col("n"), F.col("n2")
    most = F.least(n - F.col("pos"), n2 - F.col("pos2"))
    fits = (100 * F.least(n, n2) >= percent * F.greatest(n, n2)) & (100 * most >= percent * (n + n2 - most))
    if folds:
        apart = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"{f}2"))) for f in FOLDS), F.lit(0))
        fits &= (100 + percent) * apart <= (100 - percent) * (n + n2)
    return fits


def _second(df: DataFrame) -> DataFrame:
    return df.select("bucket", *(F.col(c).alias(f"{c}2") for c in df.columns if c != "bucket"))


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("sig", "sig2").alias("a"), F.greatest("sig", "sig2").alias("b")).distinct()


def _links(docs: DataFrame, classes: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Links (a, b) that join all classes which links join. members: bucket, sig, n, pos."""
    sized = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    sized = cut(members.join(sized, "bucket"))
    total = sized.count()
    if not total:
        return None
    small, large = sized.where(F.col("m") <= SMALL).drop("m"), sized.where(F.col("m") > SMALL)
    found = _pairs(small.join(_second(small), "bucket").where((F.col("sig") < F.col("sig2")) & _allowed(percent, False)))
    company = large.groupBy("sig").agg(F.sum("m").alias("company"))
    folds = classes.select("sig", *FOLDS)
    at = cut(large.drop("m").join(company.join(folds, "sig"), "sig").withColumn("component", F.col("sig")))
    links, turn, drawn = None, 0, 1
    while True:
        # Of the classes that have not been held against all others yet: comparisons between components.
        parts = at.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
        open_ = cut(parts.groupBy("bucket").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.count(F.lit(1)).alias("parts")).where("parts > 1"))
        left = open_.agg(F.sum((F.col("m") * F.col("m") - F.col("mm")) / 2)).collect()[0][0] or 0
        if turn and not left:
            return links
        last = left <= LEFT * total and turn
        if left:
            at = cut(at.join(open_.select("bucket"), "bucket"))
            if last:
                against = at
            else:
                best = F.max_by(F.struct(*(c for c in at.columns if c != "bucket")), F.struct("company", "sig"))
                part = F.pmod(F.xxhash64("sig", F.lit(turn)), F.lit(drawn))
                against = at.groupBy("bucket", part.alias("part")).agg(best.alias("x")).select("bucket", "x.*")
                against = cut(against)
            pairs = at.join(_second(against.drop("company")), "bucket").where(F.col("component") != F.col("component2")).where(_allowed(percent, True))
            if last:
                pairs = pairs.where(F.col("sig") < F.col("sig2"))
            pairs = _pairs(pairs)
            found = pairs if turn else found.unionByName(pairs).distinct()
        good = _verify(docs, classes, cut(found), k, percent)
        links = good if links is None else links.unionByName(good)
        if last or not left:
            return links
        met = cut(components(links)).withColumnRenamed("node", "sig")
        at = at.join(against.select("bucket", "sig"), ["bucket", "sig"], "left_anti")
        at = cut(at.drop("component").join(met, "sig", "left").withColumn("component", F.coalesce("component", "sig")))
        turn, drawn = turn + 1, drawn * 4


def joined_classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n and sig of every row; sig, root (the least signature that links reach) and component_id of every set of a row with a doc_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole, docs = docs, docs.where("doc_id is not null")
    summary = cut(whole.mapInArrow(_summaries(k), "doc_id long, n long, sig long, parity binary, sketch binary"))
    counts = merged(summary.where("sketch is not null").select("sketch"), "sum")
    counts = np.zeros(1 << SLOT_BITS, np.int64) if counts is None else counts
    every = summary.where("sketch is null").select("doc_id", "n", "sig")
    rows = summary.where("n > 0 and doc_id is not null")
    classes = rows.groupBy("sig").agg(F.min("doc_id").alias("cid"), F.first("n").cast("int").alias("n"), F.first("parity").alias("parity"))
    classes = cut(classes.mapInArrow(_with_folds, "sig long, cid long, n int, parity binary, " + ", ".join(f"{f} long" for f in FOLDS)))
    light = boundary(counts, percent)
    sketch = spark.sparkContext.broadcast(np.minimum(counts, (1 << 32) - 1).astype(np.uint32))
    postings = cut(docs.select("text").mapInArrow(_postings(k, percent, sketch, light), "bucket long, sig long, n int, pos int"))
    shared = cut(postings.groupBy("bucket").agg(F.min("sig").alias("least"), F.max("sig").alias("most")).where("least < most").select("bucket"))
    bits = spark.sparkContext.broadcast(filter_of(shared))
    members = postings.mapInArrow(_marked(bits), postings.schema).join(shared, "bucket").groupBy("bucket", "sig").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    links = _links(docs, classes, cut(members), k, percent)
    known = classes.select("sig", "cid")
    if links is None:
        return every, known.select("sig", F.col("sig").alias("root"), F.col("cid").alias("component_id"))
    met = cut(components(links)).select(F.col("node").alias("sig"), F.col("component").alias("root"))
    least = met.join(known, "sig").groupBy("root").agg(F.min("cid").alias("component_id"))
    met = met.join(least, "root")
    return every, cut(known.join(met, "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"), F.coalesce("component_id", "cid").alias("component_id")))


def _with_folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the PARITY bits of each bitmap, as FOLDS."""
    for batch in batches:
        short = b"".join(_folded(x, PARITY).to_bytes(PARITY // 8, "little") for x in batch.column(3).to_pylist())
        words = np.frombuffer(short, "<i8").reshape(-1, len(FOLDS))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(len(FOLDS)))], [*batch.schema.names, *FOLDS])


def ngram_join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    every, known = joined_classes(docs, k, percent)
    some = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    linked = every.where(some).join(known, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(every.where(~some).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each group of links: of the rows of its smallest doc_id.

    Rows without a doc_id or without a word stay. Where the smallest doc_id of a group is repeated, the row stays whose
    text has the smallest hash; of equal rows, one. A repeated doc_id whose texts are in several groups is in each.
    """
    every, known = joined_classes(docs, k, percent)
    worded = every.where("n > 0 and doc_id is not null").join(known, "sig").select("doc_id", "sig", "root", "component_id")
    blank = every.where("n = 0 and doc_id is not null").select("doc_id", "sig", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    rows = cut(worded.unionByName(blank))
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"), F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("first"))
    ids = cut(ids.where("times > 1 or first = 0").withColumnRenamed("doc_id", "of"))
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}  # their names may clash
    named = docs.select(*(F.col(c).alias(n) for c, n in own.items()), F.col("doc_id").cast("long").alias("id"))
    kept = named.join(ids, F.col("id") == F.col("of"), "left_anti").select(*own.values())
    again = ids.where("times > 1 and first = 1")
    if not again.isEmpty():
        # Rows of repeated ids find their group by the signatures of their texts.
        same = named.join(again, F.col("id") == F.col("of"), "left_semi").select("id", F.xxhash64(own["text"]).alias("h"), F.struct(*own.values()).alias("own"))
        texts = same.groupBy("id", "h").agg(F.first(f"own.{own['text']}").alias("text"))
        sigs = cut(texts.mapInArrow(_named(k), "id long, h long, n long, sig long"))
        first = sigs.where("n > 0").join(rows.where("doc_id = component_id").select(F.col("doc_id").alias("id"), "sig", "root").distinct(), ["id", "sig"]).groupBy("id", "root").agg(F.min("h").alias("h"))
        plain = [n for f, n in zip(docs.schema, own.values(), strict=True) if "map<" not in f.dataType.simpleString()]
        one = same.join(first.select("id", "h"), ["id", "h"]).groupBy("id", "h").agg(F.min_by("own", F.xxhash64(*(F.col(f"own.{n}") for n in plain))).alias("own"))
        kept = kept.unionByName(one.select("own.*")).unionByName(same.join(sigs.where("n = 0").select("id", "h"), ["id", "h"]).select("own.*"))
    return kept.select(*(F.col(n).alias(c) for c, n in own.items()))


def _named(k: int):
    """id, h, size and signature of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, g, r in _sets(batch.column(2), k):
                size, sig = _signatures(g, r, hi - lo)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(size.astype(np.int64)), pa.array(sig.view(np.int64))], ["id", "h", "n", "sig"])

    return run
