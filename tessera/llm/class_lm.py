"""Language-model scoring with Brown's class-based bigrams.

The words that make up at least one ``CLUSTERED``-th of the training tokens each (so at most CLUSTERED of them) are
assigned to classes by exchange clustering: each word in turn moves to the class that raises the likelihood of the class
bigrams most, until no move helps. Every other training word of at least ``FEWEST`` tokens is then put into the class
that is likeliest by the classes before and after its tokens; words seen once share one more class with the unseen ones.
A token's probability is that of its class after the class before (class bigrams, interpolated with class unigrams as
Witten and Bell do) times that of the word in its class (counts; in the class of the rest one added). A text starts after
an end token.

Counts are taken over all training documents. Word counts meet in one aggregation of partial counts; the words of at
least one ``HEAD``-th of the tokens (at most HEAD) are sent to all tasks, and only tokens of the others are joined with
the table of counts and classes, so that no key holds more than one HEAD-th of the training tokens. The class sequences
of the texts, a byte a token, are written between counting the class bigrams and scoring.

Tokens are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, by 64-bit hashes, then one end token. Null and empty texts are an
end token alone. Repeated rows are counted and scored each. A null doc_id is not held out. Without training documents
counts are 0 and every word is unseen. Ties in clustering go to the smaller class. Other columns are ignored; an empty
table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut
from ._tokens import SPACE, U, mix, tokens

HEAD, CLUSTERED, CLASSES = 400_000, 2_000, 48
#: Tokens of a word from which on it has a class by its neighbours.
FEWEST = 2
#: Bits of both neighbours' classes (fewer than 64 classes); the word's hash keeps the others.
SIDE, SLOT = 6, 12
END = U(0x656E64)
#: Distinct words that a task holds before it hands their counts on.
HELD = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def _counted(key_slices, batches) -> Iterator[pa.RecordBatch]:
    """Partial counts of the 64-bit keys that key_slices(texts) yields."""
    keys, counts, size = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
    names = ["h", "c"]
    for batch in batches:
        for h in key_slices(batch.column(0)):
            k, n = np.unique(h, return_counts=True)
            keys.append(k)
            counts.append(n)
            size += len(k)
            if size > HELD:
                k, n = _added(keys, counts)
                keys, counts, size = [k], [n], len(k)
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names)
                    keys, counts, size = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
    k, n = _added(keys, counts)
    if len(k):
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names)


def _words(texts: pa.Array) -> Iterator[np.ndarray]:
    for lo, hi, h, _ in tokens(texts, SPACE):
        yield h
        yield np.full(hi - lo, END, U)


def word_counts(docs: DataFrame) -> DataFrame:
    """h, c: training counts of words and the end token, by hash."""
    return docs.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(lambda b: _counted(_words, b), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def sequence(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of n texts with the end token after each, and their rows."""
    whole = np.full(len(h) + n, END, U)
    rows = np.empty(len(h) + n, np.int64)
    at = np.arange(len(h)) + row
    whole[at], rows[at] = h, row
    ends = np.cumsum(np.bincount(row, minlength=n) + 1) - 1
    rows[ends] = np.arange(n)
    return whole, rows


class Lookup:
    """From hashes to positions in a sorted table; -1 where there is none."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1)


def bigram_counts(docs: DataFrame, clustered: np.ndarray) -> np.ndarray:
    """Counts of (token, next) over the clustered words and, last, all others; a text's first token follows an end."""
    n = len(clustered) + 1
    held = docs.sparkSession.sparkContext.broadcast(Lookup(clustered))

    def keys(texts: pa.Array) -> Iterator[np.ndarray]:
        for lo, hi, h, row in tokens(texts, SPACE):
            h, row = sequence(h, row, hi - lo)
            ids = held.value(h)
            ids[ids < 0] = n - 1
            end = held.value(np.array([END]))[0]
            before = np.roll(ids, 1)
            before[np.r_[True, row[1:] != row[:-1]]] = end if end >= 0 else n - 1
            yield (before * n + ids).astype(U)

    sums = docs.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(lambda b: _counted(keys, b), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    table = np.zeros(n * n)
    for r in sums.toLocalIterator():
        table[r["h"]] = r["c"]
    return table.reshape(n, n)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """A class of each word; the last word (the rest) has the last class alone. Words are sorted from frequent to rare."""
    v = len(bigrams) - 1
    classes = max(1, min(classes, v))
    of = np.append(np.minimum(np.arange(v), np.arange(v) % classes), classes)
    member = np.zeros((v + 1, classes + 1))
    member[np.arange(v + 1), of] = 1
    g = member.T @ bigrams @ member
    # Less than this is rounding, which could move words for ever.
    least = 1e-9 + 1e-12 * _xlogx(bigrams.sum())
    moved = 1
    while moved:
        moved = 0
        for w in range(v):
            out, into, self_ = bigrams[w] @ member, bigrams[:, w] @ member, bigrams[w, w]
            a = of[w]
            # Take the word out of its class; its bigram with itself counts in both directions once.
            out[a] -= self_
            into[a] -= self_
            g[a] -= out
            g[:, a] -= into
            g[a, a] -= self_
            now = _xlogx(g)
            grown_row, grown_col = _xlogx(g + out[None, :]), _xlogx(g + into[:, None])
            gain = (grown_row - now).sum(1) + (grown_col - now).sum(0)
            d = np.diagonal(g)
            gain -= _xlogx(d + out) + _xlogx(d + into) - 2 * _xlogx(d)
            gain += _xlogx(d + out + into + self_) - _xlogx(d)
            rows, cols = g.sum(1), g.sum(0)
            rows, cols = rows + into, cols + out  # whatever class the word joins
            gain -= _xlogx(rows + out.sum() + self_) - _xlogx(rows) + _xlogx(cols + into.sum() + self_) - _xlogx(cols)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + least:
                b = a
            g[b] += out
            g[:, b] += into
            g[b, b] += self_
            moved += b != a
            of[w] = b
            member[w] = 0
            member[w, b] = 1
    return of


class Model:
    def __init__(self, heads: list[tuple[int, int]], n: int, v: int, bigrams: np.ndarray, clustered: int):
        """heads: (hash, count) from frequent to rare; the first ``clustered`` of them have classes of their own."""
        counts = np.array([c for _, c in heads], float)
        self.find = Lookup(np.array([h for h, _ in heads], np.int64).view(U))
        of = exchange(bigrams)
        k = int(of[-1])
        classes = np.full(len(heads) + 1, k)
        classes[:clustered] = of[:-1]
        member = np.zeros((len(of), k + 1))
        member[np.arange(len(of)), of] = 1
        g = member.T @ bigrams @ member
        self.k, self.clustered = k, clustered
        self.transitions(g)
        self.sizes = g.sum(0)
        self.n, self.v = n, v
        sums = np.bincount(of[:-1], counts[:clustered], k + 1)
        self.rest = n - sums.sum() + v - clustered + 1
        self.classes = classes.astype(np.int16)
        log_c = np.log10(counts + 1)
        emit = log_c - np.log10(self.rest)
        emit[:clustered] = np.log10(np.maximum(counts[:clustered], 1)) - np.log10(sums[of[:-1]])
        self.base, self.emit = np.append(log_c, 0.0), np.append(emit, -np.log10(self.rest))
        self.end = int(self.find(np.array([END]))[0])
        self.counts, self.end_class = counts, int(self.classes[self.end])

    def transitions(self, g: np.ndarray) -> None:
        """Takes the class bigrams g for the probabilities of a class after another."""
        total, kinds = g.sum(1, keepdims=True), (g > 0).sum(1, keepdims=True)
        single = (g.sum(0) + 1) / (g.sum() + len(g))
        self.step = np.log10((g + np.maximum(kinds, 1) * single) / (total + np.maximum(kinds, 1)))

    def weights(self) -> np.ndarray:
        """What a neighbour (class before, then class after) says for each class but the last."""
        before, after = self.step - np.log10(np.maximum(self.sizes, 1)), self.step.T
        return np.concatenate([before, after])[:, : self.k]

    def insert(self, classes: np.ndarray, sums: np.ndarray, kinds: np.ndarray, end_class: int) -> None:
        """classes: of all heads; sums and kinds: tokens and words of each class, of all training words."""
        k = self.k
        self.end_class = end_class
        self.classes = np.append(classes, k).astype(np.int16)
        self.rest = float(sums[k] + kinds[k] + 1)
        self.log_sums = np.append(np.log10(np.maximum(sums[:k], 1)), np.log10(self.rest))
        self.emit = np.append(self.emission(self.counts, classes), -np.log10(self.rest))

    def emission(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return np.log10(counts + (classes == self.k)) - self.log_sums[classes]


def _before(kind: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The class before each token; an end token's before the first ones of texts."""
    before = np.roll(kind, 1)
    before[first] = end
    return before


def inserted(docs: DataFrame, counts: DataFrame, model: Model, heads: list[tuple[int, int]]) -> DataFrame:
    """h, c, class of all training words but the clustered ones, by the classes of their neighbours."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    k = model.k

    def keys(texts: pa.Array) -> Iterator[np.ndarray]:
        m = held.value
        for lo, hi, h, row in tokens(texts, SPACE):
            h, row = sequence(h, row, hi - lo)
            at = m.find(h)
            kind = m.classes[at].astype(np.int64)
            first = np.r_[True, row[1:] != row[:-1]]
            after = np.roll(kind, -1)
            after[np.r_[first[1:], True]] = kind[first]  # an end token comes before the text's first
            other = (at < 0) | (at >= m.clustered)
            beside = _before(kind, first, m.end_class)[other] << SIDE | after[other]
            yield h[other] << U(SLOT) | beside.astype(U)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value.weights()
        for batch in batches:
            found, n = batch.column(1), batch.num_rows
            row = np.repeat(np.arange(n), found.value_lengths().to_numpy(zero_copy_only=False))
            flat = found.flatten()
            slot, times = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            near = sum(np.bincount(row * len(weights) + at, times, n * len(weights)) for at in (slot >> SIDE, k + 1 + (slot & ((1 << SIDE) - 1)))).reshape(n, len(weights))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.argmax(near @ weights, 1).astype(np.int32))], ["of", "class"])

    pairs = docs.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(lambda b: _counted(keys, b), "h long, c long")
    pairs = pairs.select(F.shiftright("h", SLOT).alias("of"), F.col("h").bitwiseAND((1 << SLOT) - 1).alias("slot"), "c").repartition("of")
    near = pairs.groupBy("of", "slot").agg(F.sum("c").alias("c")).groupBy("of").agg(F.collect_list(F.struct("slot", "c")).alias("near"))
    own = F.shiftright(F.shiftleft("h", SLOT), SLOT)
    core = [(h,) for h, _ in heads[: model.clustered]]
    others = counts.join(docs.sparkSession.createDataFrame(core, "h long"), "h", "left_anti") if core else counts
    joined = others.join(near.mapInArrow(choose, "of long, class int"), own == F.col("of"), "left")
    return cut(joined.select("h", "c", F.when(F.col("c") >= FEWEST, F.col("class")).otherwise(F.lit(k)).alias("class")))


OUT = "row long, h long, places array<int>, x double, y double, doc_id long, meta long, known int, kinds binary"


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(data.astype(np.uint8))])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where each row's begin and the last ones end."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.uint8).astype(np.int64), np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int64)


def _split(held):
    """Of each text: a row of sums and its classes, and a row for each of its words outside the head with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        for batch in batches:
            rows, out_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for lo, hi, h, row in tokens(batch.column(3), SPACE):
                n = hi - lo
                h, row = sequence(h, row, n)
                at = m.find(h)
                head = at >= 0
                size = np.bincount(row, minlength=n)
                x = np.bincount(row, m.base[at], n)
                y = np.bincount(row, m.emit[at], n)
                known = np.bincount(row[head], minlength=n)
                place = np.flatnonzero(~head)
                place = place[np.lexsort((h[place], row[place]))]
                tail, t_row = h[place], row[place]
                first = np.flatnonzero(np.r_[True, (tail[1:] != tail[:-1]) | (t_row[1:] != t_row[:-1])]) if len(tail) else np.zeros(0, np.int64)
                places = place - (np.cumsum(size) - size)[t_row]
                tail, t_row = tail[first], t_row[first]
                offsets = np.concatenate([np.zeros(n, np.int64), first, [len(places)]])
                own = rows[lo:hi].astype(np.int64)
                none = len(tail)
                pad = lambda a, t, none=none: pa.concat_arrays([a if isinstance(a, pa.Array) else pa.array(a, t), pa.nulls(none, t)])
                # The key of a sum's row meets no word: it only spreads these rows.
                key = mix(own.view(U) + U(0x7777)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([own, own[t_row]])), pa.array(np.concatenate([key, tail.view(np.int64)])), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(places.astype(np.int32))),
                        pad(x, pa.float64()), pad(y, pa.float64()), pad(batch.column(1).slice(lo, n).cast(pa.int64()), pa.int64()), pad(size * 2 + out_[lo:hi].astype(np.int64), pa.int64()),
                        pad(known.astype(np.int32), pa.int32()), pad(_binary(m.classes[at], size), pa.binary()),
                    ],
                    ["row", "h", "places", "x", "y", "doc_id", "meta", "known", "kinds"],
                )

    return run


WHOLE = "doc_id long, meta long, known long, x double, y double, kinds binary"


def _filled(held):
    """The words outside the head put into the sums and classes of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        for batch in batches:
            n = batch.num_rows
            known, x, y = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3, 4))
            kinds, at = _bytes(batch.column(5))
            words_ = batch.column(6)
            row = np.repeat(np.arange(n), words_.value_lengths().to_numpy(zero_copy_only=False))
            flat = words_.flatten()
            places, c, of = flat.field(0), flat.field(1).to_numpy(zero_copy_only=False), flat.field(2).to_numpy(zero_copy_only=False)
            times = places.value_lengths().to_numpy(zero_copy_only=False)
            kinds[np.repeat(at[row], times) + places.flatten().to_numpy(zero_copy_only=False)] = np.repeat(of, times)
            known += np.bincount(row, times, n)
            x = x + np.bincount(row, times * np.log10(c + 1), n)
            y = y + np.bincount(row, times * (m.emission(c, of) - m.emit[-1]), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known.astype(np.int64)), pa.array(x), pa.array(y), _binary(kinds, np.diff(at))], ["doc_id", "meta", "known", "x", "y", "kinds"])

    return run


def _stepped(held):
    """Adds to y what the classes after one another say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        for batch in batches:
            kinds, at = _bytes(batch.column(5))
            steps = np.add.reduceat(m.step[_before(kinds, at[:-1], m.end_class), kinds], at[:-1]) if len(kinds) else 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(batch.column(4).to_numpy() + steps)], ["doc_id", "meta", "known", "x", "y"])

    return run


def class_lm(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row of docs."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    counts = cut(word_counts(docs))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("h")).collect()[0]
    heads = sorted(((r["h"], r["c"]) for r in counts.where(F.col("c") * HEAD >= n).toLocalIterator()), key=lambda x: (-x[1], x[0]))
    clustered = sum(c * CLUSTERED >= n for _, c in heads)
    bigrams = bigram_counts(docs, np.array([h for h, _ in heads[:clustered]], np.int64).view(U))
    model = Model(heads, n, v, bigrams, clustered)
    words_ = inserted(docs, counts, model, heads)
    # Tokens and words of each class, and the classes of the heads.
    sums, kinds = np.zeros(model.k + 1), np.zeros(model.k + 1)
    classes = model.classes[:-1].astype(np.int64)
    np.add.at(sums, classes[:clustered], model.counts[:clustered])
    for r in words_.groupBy("class").agg(F.sum("c").alias("c"), F.count("h").alias("n")).collect():
        sums[r["class"]] += r["c"]
        kinds[r["class"]] += r["n"]
    place = {h: i for i, (h, _) in enumerate(heads)}
    for r in words_.where(F.col("c") * HEAD >= n).toLocalIterator():
        classes[place[r["h"]]] = r["class"]
    end = [r["class"] for r in words_.where(F.col("h") == int(END)).collect()]
    model.insert(classes, sums, kinds, end[0] if end else model.end_class)

    held = docs.sparkSession.sparkContext.broadcast(model)
    split = docs.select("row", "doc_id", "held", "text").mapInArrow(_split(held), OUT)
    tail = words_.where(F.col("c") * HEAD < n).select(F.col("h").alias("of"), "c", "class")
    joined = split.join(tail, split["h"] == tail["of"], "left")
    whole = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("meta").alias("meta"), F.max("known").cast("long").alias("known"), F.max("x").alias("x"), F.max("y").alias("y"),
        F.first("kinds", ignorenulls=True).alias("kinds"), F.collect_list(F.when(F.col("c").isNotNull(), F.struct("places", "c", "class"))).alias("words"),
    )
    whole = cut(whole.drop("row").mapInArrow(_filled(held), WHOLE))
    size_ = model.k + 1

    def pairs(column: pa.Array) -> Iterator[np.ndarray]:
        kinds, at = _bytes(column)
        yield (_before(kinds, at[:-1], held.value.end_class) * size_ + kinds).astype(U)

    g = np.zeros(size_ * size_)
    for r in whole.where("meta % 2 = 0").select("kinds").mapInArrow(lambda b: _counted(pairs, b), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).collect():
        g[r["h"]] = r["c"]
    model.transitions(g.reshape(size_, size_))
    held_steps = docs.sparkSession.sparkContext.broadcast(model)
    sums = whole.mapInArrow(_stepped(held_steps), "doc_id long, meta long, known long, x double, y double")
    size = F.floor(F.col("meta") / 2).cast("long")
    return sums.select(
        "doc_id", (F.col("meta") % 2 == 1).alias("held_out"), size.alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("x") - size * float(np.log10(n + v + 1))).alias("base_score"), F.col("y").alias("score"), F.pow(F.lit(10.0), -F.col("y") / size).alias("perplexity"),
    )
