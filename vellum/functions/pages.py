"""Pages of packed token ids: one row per page, and NumPy views of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KEY = ["book_id", "part_index", "page_id"]


def one_row_per_page(pages: DataFrame, *columns: str) -> DataFrame:
    """Each page once. Repeated rows hold the same content, so any of them stands for the page."""
    return pages.select(*KEY, *columns).dropDuplicates(KEY)


def unpack(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian u32 blobs as (all ids one after another, offsets with one more entry than rows).

    A blob that is null, empty or not a multiple of 4 bytes holds no tokens.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.binary():
        column = column.cast(pa.binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    length = np.diff(ends)
    good = (length % 4 == 0) & np.asarray(column.is_valid())
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    if not good.all():
        raw = raw[np.repeat(good, length)]
    flat = np.frombuffer(raw.tobytes(), "<u4")
    return flat, np.concatenate([[0], np.cumsum(np.where(good, length // 4, 0))]).astype(np.int64)


def unlist(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """An array<bigint> column as (values, offsets); a null array has no values, a null element becomes 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    length = np.asarray(column.value_lengths().fill_null(0), np.int64)
    return np.asarray(column.flatten().fill_null(0), np.int64), np.concatenate([[0], np.cumsum(length)]).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Odd multipliers of two independent 64-bit polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def run_hashes(x: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``length`` values, built by doubling."""
    with np.errstate(over="ignore"):
        have, power, size = mix64(x + np.uint64(1)), np.uint64(base), 1
        out, done = None, 0
        rest = length
        while rest:
            if rest & 1:
                if out is None:
                    out, done = have, size
                else:
                    m = len(x) - (done + size) + 1
                    if m <= 0:
                        return np.zeros(0, np.uint64)
                    out = out[:m] * power + have[done : done + m]
                    done += size
            rest >>= 1
            if rest:
                m = len(x) - 2 * size + 1
                if m <= 0:
                    return np.zeros(0, np.uint64)
                have = have[:m] * power + have[size : size + m]
                power, size = power * power, 2 * size
        return mix64(out)
