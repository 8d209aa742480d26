"""Hashing and bounded sketches on Arrow batches, shared by the searches of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of one piece of a sketch on its way to be merged.
PIECE = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def seeds(n: int, start: int = 1) -> np.ndarray:
    """n odd multipliers, always the same."""
    return mixed(np.arange(start, start + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column of bigints end to end, and the lists' sizes."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), sizes


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def merged(rows: DataFrame, columns: list[str], size: int, dtype: type, add: Callable[[np.ndarray, pa.RecordBatch], None], join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """A sketch of ``size`` numbers over all rows: every task fills its own, pieces are joined on the workers.

    What reaches the driver is the sketch itself, whose size does not depend on the number of rows.
    """
    step = min(size, PIECE // np.dtype(dtype).itemsize)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, dtype)
        for batch in batches:
            add(own, batch)
        for n in range(0, size, step):
            piece = own[n : n + step]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([piece.tobytes()], pa.binary())], ["at", "held"])

    def joined(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype)
        for part in parts:
            for x in part.column("held"):
                piece = np.frombuffer(x.as_py(), dtype)
                total = join(total, piece) if len(total) else piece.copy()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["at", "held"])

    out = np.zeros(size, dtype)
    for r in rows.select(*columns).mapInArrow(run, "at bigint, held binary").groupBy("at").applyInArrow(joined, "at bigint, held binary").collect():
        piece = np.frombuffer(bytes(r["held"]), dtype)
        out[r["at"] : r["at"] + len(piece)] = piece
    return out


class Bits:
    """A set of 64-bit hashes that never denies one it holds; its size is bounded whatever it holds."""

    def __init__(self, bits: int, held: np.ndarray | None = None):
        self.bits = bits
        self.held = np.zeros(1 << max(0, bits - 3), np.uint8) if held is None else held

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - self.bits)
        return h >> shift, (h * np.uint64(0x9E3779B97F4A7C15)) >> shift

    def add(self, h: np.ndarray) -> None:
        for at in self.places(h):
            np.bitwise_or.at(self.held, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))

    def holds(self, h: np.ndarray) -> np.ndarray:
        first, second = self.places(h)
        out = (self.held[(first >> np.uint64(3)).astype(np.int64)] >> (first & np.uint64(7)).astype(np.uint8)) & 1
        at = np.flatnonzero(out)
        more = second[at]
        out[at] = (self.held[(more >> np.uint64(3)).astype(np.int64)] >> (more & np.uint64(7)).astype(np.uint8)) & 1
        return out.view(bool)


def bits_of(rows: DataFrame, column: str, count: int, most: int) -> Bits:
    """The hashes of a bigint column as Bits: about 24 bits for each of ``count``, at most 2 ** most in all."""
    bits = int(min(most, max(12, int(24 * count).bit_length())))

    def add(own: np.ndarray, batch: pa.RecordBatch) -> None:
        Bits(bits, own).add(unsigned(batch.column(0)))

    return Bits(bits, merged(rows, [column], 1 << (bits - 3), np.uint8, add, np.bitwise_or))
