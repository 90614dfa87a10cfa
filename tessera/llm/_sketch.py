"""Sketches of a fixed size, whatever the input, that are built on executors and sent back to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._tokens import mix

#: Sketches that one task merges; how many the driver does; tasks that mark keys (a key is eight bytes, and marking it some nanoseconds).
FAN, LAST, MARKERS = 16, 4, 64


def _merge(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                if x.is_valid:
                    part = unpack(x.as_py(), kind)
                    total = part if total is None else (total | part if kind == "bits" else total + part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pack(total)], pa.binary())], ["sketch"])

    return run


def pack(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True) + len(x.tobytes()).to_bytes(8, "little")


def unpack(x: bytes, kind: str) -> np.ndarray:
    raw = pa.decompress(x[:-8], int.from_bytes(x[-8:], "little"), "zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8 if kind == "bits" else np.int64)


def merged(sketches: DataFrame, kind: str) -> np.ndarray | None:
    """The sum (or, of bits, the union) of a column of packed sketches, by a tree of tasks."""
    n = sketches.rdd.getNumPartitions()
    while n > LAST:
        n = -(-n // FAN)
        sketches = sketches.coalesce(n).mapInArrow(_merge(kind), "sketch binary")
    total = None
    for row in sketches.collect():
        if row[0] is not None:
            part = unpack(bytes(row[0]), kind)
            total = part.copy() if total is None else (total | part if kind == "bits" else total + part)
    return total


#: Bits of a filter: 2 to the power of LEAST at least and MOST (16 MB) at most. Beyond that more keys pass that are not in it.
LEAST, MOST = 20, 27


def set_bits(bits: np.ndarray, keys: np.ndarray) -> None:
    """Marks 64-bit keys in a filter; two places each."""
    for shift in (0, 32):
        at = (keys >> np.uint64(shift)) & np.uint64(len(bits) * 8 - 1)
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))


def has_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may have been marked: all that were, and few others."""
    found = np.ones(len(keys), bool)
    for shift in (0, 32):
        at = (keys >> np.uint64(shift)) & np.uint64(len(bits) * 8 - 1)
        found &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def filter_of(keys: DataFrame) -> np.ndarray:
    """A filter of one column of 64-bit keys, which are mixed first: has_bits(bits, mix(keys)) asks it. keys is read twice."""
    size = min(MOST, max(LEAST, (16 * keys.count()).bit_length())) - 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << size, np.uint8)
        for batch in batches:
            set_bits(bits, mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array([pack(bits)], pa.binary())], ["sketch"])

    found = merged(keys.coalesce(MARKERS).mapInArrow(run, "sketch binary"), "bits")
    return np.zeros(1 << size, np.uint8) if found is None else found
