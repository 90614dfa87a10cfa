"""Boosted regression trees on binned features, for two classes.

The trees are those of pyspark.ml's GBTClassifier: the first is fitted to the labels, each other one to the gradient of the
log loss, levels grow by the largest drop of variance, and a fit ends when the held-out loss drops by under 1 %. Rows are
kept as two bytes for a few features at once, dealt once to as many tasks as run at the same time, and stay there for all
rounds; tasks exchange sums of bins only, so that neither the driver nor the shuffles see a row again. All sums are of
integers: the trees do not depend on how rows are dealt.
"""

from __future__ import annotations

import secrets
import socket
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

BINS = 32
#: Rows from which thresholds are taken; all rows are trained on.
SAMPLE = 100_000
#: Bins of the features that are counted together.
PACKED = 1024
#: Rows summed at once: a count and a sum of gradients (16 bits after the point, under 4 each) fit one float exactly.
ROWS, POINT, SHIFT = 1 << 16, 16, 36
#: Most tasks of a fit (the first gets the sums of all), and most bytes of a task's array in memory; a larger one is a file of its own.
TASKS, HELD = 64, 1 << 26
#: Folds of rows without one: in no fold, but trained on.
NO_FOLD = 255


@dataclass
class Boosted:
    """features: a null becomes ``value`` and, after the features, a flag for each. thresholds: of features and flags. trees: of
    each its weight, and for the inner nodes level by level the feature and the bin up to which rows go left, and the leaves."""

    features: list[str]
    value: float
    thresholds: list[list[float]]
    trees: list[tuple[float, list[int], list[int], list[float]]]
    importances: list[float]

    def codes(self, batch: pa.RecordBatch, names: list[str] | None = None) -> np.ndarray:
        """Bins, a row for each feature or flag."""
        out = np.zeros((len(self.thresholds), batch.num_rows), np.uint8)
        for i, c in enumerate(names or self.features):
            x = batch.column(c).cast(pa.float64(), safe=False)
            null = x.is_null().to_numpy(zero_copy_only=False)
            out[i] = np.searchsorted(self.thresholds[i], x.fill_null(self.value).to_numpy(zero_copy_only=False))
            out[len(self.features) + i] = null if self.thresholds[len(self.features) + i] else 0
        return out

    def margin(self, codes: np.ndarray) -> np.ndarray:
        flat, n = np.ascontiguousarray(codes).ravel(), codes.shape[1]
        out, row = np.zeros(n), np.arange(n)
        for weight, feature, upto, leaves in self.trees:
            start, most, node = np.array(feature, np.int64) * n, np.array(upto), np.zeros(n, np.int64)
            while len(feature) and node[0] < len(feature):  # all rows are on one level
                node = 2 * node + 1 + (flat[start[node] + row] > most[node])
            out += weight * np.array(leaves)[node - len(feature)]
        return out

    def probability(self, batch: pa.RecordBatch) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * self.margin(self.codes(batch)))) if batch.num_rows else np.zeros(0)


def thresholds(x: np.ndarray) -> list[float]:
    """Midpoints between values; of many values those that part the rows about evenly."""
    v, n = np.unique(x[np.isfinite(x)], return_counts=True)
    middle = v[:-1] / 2 + v[1:] / 2
    if len(middle) >= BINS:
        ends = np.cumsum(n)[:-1]
        middle = middle[np.unique(np.minimum(np.searchsorted(ends, n.sum() * np.arange(1, BINS) / BINS), len(ends) - 1))]
    return middle.tolist()


def _binned(df: DataFrame, features: list[str], group: str, value: float) -> Boosted:
    n, x = df.count(), df.select(*(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)), F.col(group).alias("g"))
    if n > SAMPLE:
        drawn = x.where(F.pmod(F.xxhash64(*x.columns), F.lit(1 << 30)) < (1 << 30) * SAMPLE // n).toArrow()
        x = drawn if drawn.num_rows > SAMPLE // 2 else x.sample(min(1.0, SAMPLE / n), seed=42).toArrow()  # rows that are mostly alike share a few hashes
    else:
        x = x.toArrow()
    found = [thresholds(x.column(i).fill_null(value).to_numpy()) for i in range(len(features))]
    flags = [[0.5] if 0 < x.column(i).null_count < x.num_rows else [] for i in range(len(features))]
    return Boosted(features, value, found + flags, [], [0.0] * (2 * len(features)))


def _packs(sizes: list[int]) -> list[list[int]]:
    """Features in packs of at most PACKED bins together; those of one bin are in none."""
    packs: list[list[int]] = []
    for i in sorted((i for i, n in enumerate(sizes) if n > 1), key=lambda i: -sizes[i]):
        room = next((p for p in packs if np.prod([sizes[j] for j in p]) * sizes[i] <= PACKED), None)
        packs.append([i]) if room is None else room.append(i)
    return packs


def _room(n: int, kind) -> np.ndarray:
    if n * np.dtype(kind).itemsize <= HELD:
        return np.zeros(n, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))  # the file has no name and goes with the array  # noqa: SIM115


class _Meeting:
    """Sums over the tasks of a barrier stage. The first task adds them up and sends them back: Spark's own allGather waits a second each time."""

    def __init__(self, context):
        self.first, n = context.partitionId() == 0, len(context.getTaskInfos())
        door = socket.create_server(("", 0), backlog=n) if self.first else None
        port, secret = context.allGather(f"{door.getsockname()[1]} {secrets.token_hex(16)}" if door else "")[0].split()
        if door:
            self.others = []
            with door:
                while len(self.others) < n - 1:
                    other = door.accept()[0]
                    if self._got(other, 32) == secret.encode():
                        self.others.append(other)
        else:
            self.others = [socket.create_connection((context.getTaskInfos()[0].address.rpartition(":")[0], int(port)))]
            self.others[0].sendall(secret.encode())
        for other in self.others:
            other.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def _got(other: socket.socket, n: int) -> bytes:
        out = bytearray()
        while len(out) < n:
            part = other.recv(min(n - len(out), 1 << 20))
            if not part:
                raise ConnectionError("another task of the fit has ended")
            out += part
        return bytes(out)

    def __call__(self, sums: np.ndarray) -> np.ndarray:
        if not self.first:
            self.others[0].sendall(sums.tobytes())
            return np.frombuffer(self._got(self.others[0], sums.nbytes), np.int64)
        for other in self.others:
            sums = sums + np.frombuffer(self._got(other, sums.nbytes), np.int64)
        for other in self.others:
            other.sendall(sums.tobytes())
        return sums


class _Rows:
    """A task's rows: packed bins and label (1 or -1, 2 or -2 if held out), by fold; and of a fit the margin, the node, and rows and gradient in one number."""

    def __init__(self, blocks: Iterator[bytes], sizes: list[int], meet):
        self.sizes, self.packs, self.meet = sizes, _packs(sizes), meet
        self.width = [int(np.prod([sizes[i] for i in p])) for p in self.packs]
        parts = len(self.packs)
        with tempfile.TemporaryFile() as f:  # rows come once, and their number is known when all have come
            ends = [0]
            for b in blocks:
                f.write(b)
                ends.append(ends[-1] + len(b))
            n = ends[-1] // (2 * parts + 2)
            self.codes, self.y, counts = [_room(n, np.uint16) for _ in range(parts)], _room(n, np.int8), np.zeros(NO_FOLD + 1, np.int64)

            def read() -> Iterator[tuple[bytes, int, np.ndarray]]:
                f.seek(0)
                for a, b in zip(ends, ends[1:], strict=False):
                    block = f.read(b - a)
                    m = len(block) // (2 * parts + 2)
                    yield block, m, np.frombuffer(block, np.uint8, m, (2 * parts + 1) * m)

            for _, _, fold in read():
                counts += np.bincount(fold, minlength=NO_FOLD + 1)
            self.ends = np.cumsum(counts)
            at = self.ends - counts
            for block, m, fold in read():
                order, found = np.argsort(fold, kind="stable"), np.bincount(fold, minlength=NO_FOLD + 1)
                y, a = np.frombuffer(block, np.int8, m, 2 * parts * m)[order], 0
                codes = [np.frombuffer(block, np.uint16, m, 2 * k * m)[order] for k in range(parts)]
                for i in np.flatnonzero(found):
                    here, there = slice(a, a + found[i]), slice(at[i], at[i] + found[i])
                    self.y[there] = y[here]
                    for mine, own in zip(self.codes, codes, strict=True):
                        mine[there] = own[here]
                    at[i], a = at[i] + found[i], a + found[i]
        self.margin, self.node, self.w = _room(n, np.float32), _room(n, np.uint16), _room(n, np.float64)

    def blocks(self) -> Iterator[slice]:
        """The rows that are not in fold ``out``, which lie together."""
        gap = (0, 0) if self.out < 0 else (self.ends[self.out - 1] if self.out else 0, self.ends[self.out])
        for start, end in ((0, gap[0]), (gap[1], self.ends[-1])):
            for a in range(start, end, ROWS):
                yield slice(a, min(a + ROWS, end))

    def down(self, b: slice, node: np.ndarray, right: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Nodes on the next level. right: for a pack, by node and bins, whether a row goes right."""
        up = np.zeros(len(node), bool)
        for k, goes in right:
            up |= goes.take(node * self.width[k] + self.codes[k][b])
        return 2 * node + up

    def sums(self, level: int, right: list, begin=None) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """What ``begin`` sums up (held-out loss and rows, rows, gradient), and by feature, node and bin the rows and the gradients."""
        head, nodes = np.zeros(4, np.int64), 1 << level
        held = [np.zeros((2, nodes * w), np.int64) for w in self.width]
        for b in self.blocks():
            node = self.node[b].astype(np.int64)
            if right:
                node = self.down(b, node, right)
            if begin:
                head += begin(b, node)
                node[:] = 0
            self.node[b] = node
            w = self.w[b]
            for k, width in enumerate(self.width):
                both = np.bincount(node * width + self.codes[k][b] if level else self.codes[k][b], w, nodes * width).astype(np.int64)
                n = (both + (1 << SHIFT - 1)) >> SHIFT
                held[k][0] += n
                held[k][1] += both - (n << SHIFT)
        split = []
        for pack, h in zip(self.packs, held, strict=True):
            h = h.reshape(2, nodes, *(self.sizes[i] for i in pack))
            split += [h.sum(axis=tuple(x for x in range(2, h.ndim) if x != 2 + j)).ravel() for j in range(len(pack))]
        all_ = self.meet(np.concatenate([head, *split]))
        at, by = 4, []
        for i in (i for p in self.packs for i in p):
            by.append((i, all_[at : at + 2 * nodes * self.sizes[i]].reshape(2, nodes, self.sizes[i])))
            at += 2 * nodes * self.sizes[i]
        return all_[:4], sorted(by, key=lambda x: x[0])

    def goes_right(self, feature: np.ndarray, upto: np.ndarray) -> list[tuple[int, np.ndarray]]:
        out = []
        for k, pack in enumerate(self.packs):
            stride, goes = self.width[k], np.zeros((len(feature), self.width[k]), bool)
            for i in pack:
                stride //= self.sizes[i]
                goes |= (feature == i)[:, None] & (np.arange(self.width[k]) // stride % self.sizes[i] > upto[:, None])
            if goes.any():
                out.append((k, goes.ravel()))
        return out

    def fit(self, out: int, rounds: int, depth: int, rate: float, tolerance: float) -> tuple[list, np.ndarray]:
        """Trees of the rows that are not in fold ``out``, and the drop of squares by feature."""
        depth, self.out = depth if self.packs else 0, out
        self.margin[:], self.node[:] = 0, 0
        trees, gains, right, best, kept = [], [], [], np.inf, 0

        def begin(b: slice, node: np.ndarray) -> list[int]:
            y = self.y[b]
            train, y = np.abs(y) == 1, np.sign(y)
            if trees:
                self.margin[b] += trees[-1][0] * np.array(trees[-1][3])[node]
            e = np.exp(2.0 * y * self.margin[b])
            g = np.rint((4.0 * y / (1 + e) if trees else y) * 2.0**POINT)
            self.w[b] = np.where(train, g + 2.0**SHIFT, 0)
            return [int(np.rint(2 * np.log1p(1 / e[~train]) * 2.0**POINT).sum()), int((~train).sum()), int(train.sum()), int(g[train].sum())]

        for r in range(rounds + 1):
            (loss, held, n, s), by = self.sums(0, right, begin)
            if r and held:
                error = loss / 2.0**POINT / held
                if r > 1 and best - error < tolerance * max(error, 0.01):
                    break
                best, kept = (error, r) if error < best else (best, kept)
            elif r:
                kept = r
            if r == rounds or n == 0:
                break
            n, s, features, uptos, drop = np.array([n]), np.array([s]), [], [], np.zeros(len(self.sizes))
            for level in range(depth):
                by = self.sums(level, right)[1] if level else by
                feature, upto, n, s, gain = _splits(by, n, s)
                np.add.at(drop, feature, gain)
                features, uptos, right = features + feature.tolist(), uptos + upto.tolist(), self.goes_right(feature, upto)
                right = right or [(0, np.zeros(len(feature) * self.width[0], bool))]  # rows still go down a level
            trees.append((1.0 if r == 0 else rate, features, uptos, (s / np.maximum(n, 1) / 2.0**POINT).tolist()))
            gains.append(drop)
        return trees[:kept], np.sum(gains[:kept], axis=0) if kept else np.zeros(len(self.sizes))


def _splits(by: list, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each node the feature, the bin up to which rows go left, and the gain; of the nodes below the rows and gradients. A node that is not split sends all rows left."""
    whole = s.astype(float) ** 2 / np.maximum(n, 1)
    gain, feature, upto, left_n, left_s = np.zeros(len(n)), np.zeros(len(n), np.int64), np.full(len(n), 255), n.copy(), s.copy()
    for i, (rows, sums) in by:
        a, c = np.cumsum(rows, 1)[:, :-1], np.cumsum(sums, 1)[:, :-1]
        b, d = n[:, None] - a, s[:, None] - c
        parted = c.astype(float) ** 2 / np.maximum(a, 1) + d.astype(float) ** 2 / np.maximum(b, 1)
        got = np.where((a > 0) & (b > 0) & (parted - whole[:, None] > 1e-9 * parted), parted - whole[:, None], 0)
        j = got.argmax(1)
        at = np.arange(len(n)), j
        more = got[at] > gain
        gain, feature, upto = np.where(more, got[at], gain), np.where(more, i, feature), np.where(more, j, upto)
        left_n, left_s = np.where(more, a[at], left_n), np.where(more, c[at], left_s)
    return feature, upto, np.stack([left_n, n - left_n], 1).ravel(), np.stack([left_s, s - left_s], 1).ravel(), gain


def fit(df: DataFrame, features: list[str], label: str = "label", group: str = "qi", fold: str | None = None, n: int = 0, value: float = -1.0,
        maxIter: int = 30, maxDepth: int = 5, stepSize: float = 0.1, validationTol: float = 0.01) -> list[Boosted]:
    """One model of all rows, or with fold n models, each of the rows outside of one fold. Rows with group % 10 == 0 are held out.

    df should be a stored table (``stored.cut``); it is read for its number of rows, for thresholds, and for its bins."""
    ship(spark := df.sparkSession)
    if fold:
        df = df.where(F.col(fold).isNotNull())
    binned, names = _binned(df, features, group, value), [f"f{i}" for i in range(len(features))]
    sizes = [len(t) + 1 for t in binned.thresholds]
    packs, folds = _packs(sizes), list(range(n)) if fold else [-1]
    if len(folds) > NO_FOLD:
        raise ValueError(f"more than {NO_FOLD} folds")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("y").null_count:
                raise ValueError("a label is null")
            codes, parts = binned.codes(batch, names), []
            for p in packs:
                code = np.zeros(batch.num_rows, np.uint16)
                for i in p:
                    code = code * np.uint16(sizes[i]) + codes[i]
                parts.append(code.tobytes())
            parts += [batch.column("y").to_numpy().tobytes(), batch.column("fold").to_numpy().astype(np.uint8).tobytes()]
            yield pa.RecordBatch.from_pydict({"rows": pa.array([b"".join(parts)], pa.binary())})

    held = F.when(F.pmod(F.col(group), F.lit(10)) == 0, 2).otherwise(1)
    y = (F.when(F.col(label).cast("double") == 1, held).when(F.col(label).cast("double") == 0, -held)).cast("byte")
    inside = F.when(F.col(fold).between(0, n - 1), F.col(fold)).otherwise(NO_FOLD) if fold else F.lit(NO_FOLD)
    blocks = df.select(*(F.col(c).cast("double").alias(f) for c, f in zip(features, names, strict=True)), y.alias("y"), inside.cast("int").alias("fold")).mapInArrow(packed, "rows binary")

    def trained(rows) -> Iterator[list]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        mine = _Rows((bytes(r[0]) for r in rows), sizes, _Meeting(context))
        found = [mine.fit(out, maxIter, maxDepth, stepSize, validationTol) for out in folds]
        if context.partitionId() == 0:
            yield found

    sc = spark.sparkContext._jsc.sc()
    slots = sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())
    found = blocks.repartition(max(1, min(TASKS, slots))).rdd.barrier().mapPartitions(trained).collect()[0]
    return [Boosted(features, value, binned.thresholds, trees, (gains / max(gains.sum(), 1e-300)).tolist()) for trees, gains in found]


def predict(models: list[Boosted], df: DataFrame, p: str = "p", fold: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """df, or its columns ``keep``, and the probability of a match, by the only model or by that of the row's fold."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c != p and (keep is None or c in keep)]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if fold is None:
                found = models[0].probability(batch)
            else:
                found, own = np.zeros(batch.num_rows), batch.column(fold).to_numpy(zero_copy_only=False)
                for i, m in enumerate(models):
                    at = np.flatnonzero(own == i)
                    found[at] = m.probability(batch.take(pa.array(at)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found)], [*kept, p])

    if fold is not None:
        df = df.where(F.col(fold).between(0, len(models) - 1))
    needed = [c for c in df.columns if c in {*kept, *models[0].features, fold}]
    return df.select(needed).mapInArrow(scored, ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), f"`{p}` double"]))
