"""Arrow helpers shared by the corpus operators.

Every text operator here runs as one ``mapInArrow`` pass: Spark hands over record
batches, a kernel works on the raw UTF-8 buffers with NumPy, and the answers leave as
Arrow columns. Kernels see blocks of bounded size (a document longer than the bound is a
block of its own), so a worker's memory follows the block and not the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship

BLOCK_BYTES = 1 << 20

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column(name: str):
    """A column by its exact name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``len + 1`` offsets of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, at, data = col.buffers()
    if at is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def text_pass(df: DataFrame, text_col: str, kernel: Callable[[pa.Array], list[pa.Array]], added: str, keep: list[str] | None = None, limit: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns of ``df`` and those that ``kernel`` makes of its text column.

    ``added`` is DDL of the new columns. An incoming column with the name of a new one is
    replaced. Rows, their order and repeated rows stay as they are. The kernel gets slices of
    about ``limit`` bytes and its answers leave slice by slice, so a worker never holds the
    answers of a whole Arrow batch.
    """
    ship(df.sparkSession)
    new = df.sparkSession.createDataFrame([], added).schema
    taken = {f.name.lower() for f in new}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    source = df.select(*[column(c).alias(f"__k{i}") for i, c in enumerate(keep)], column(text_col).alias("__text"))
    out = StructType([*source.schema.fields[:-1], *new.fields])
    names = [f.name for f in out]

    def run(batches):
        for batch in batches:
            _, offsets = utf8_view(batch.column(batch.num_columns - 1))
            for lo, hi, _, _ in blocks(offsets[:0], offsets, limit):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *kernel(part.column(part.num_columns - 1))], names=names)

    return source.mapInArrow(run, out).toDF(*keep, *[f.name for f in new])


def word_keys(padded: np.ndarray, starts: np.ndarray, lens: np.ndarray, longest: int, mult: int) -> np.ndarray:
    """64-bit keys of slices, eight bytes at a time; slices over ``longest`` bytes get keys of their head.

    ``padded`` has eight bytes more than the text.
    """
    eight = np.ndarray((len(padded) - 7,), np.dtype("<u8"), padded, 0, (1,))
    keys = lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    m = np.uint64(mult | 1)
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    idx = None
    for at in range(0, max(longest, 1), 8):
        if idx is None:
            part = eight[starts] & masks[np.minimum(lens, 8)]
            keys = (keys ^ part) * m
            keys ^= keys >> np.uint64(29)
            idx = np.flatnonzero(lens > 8)
        else:
            idx = idx[lens[idx] > at]
            if not len(idx):
                break
            part = eight[starts[idx] + at] & masks[np.minimum(lens[idx] - at, 8)]
            k = (keys[idx] ^ part) * m
            keys[idx] = k ^ (k >> np.uint64(29))
    return keys


def same_slices(padded: np.ndarray, a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> bool:
    """Whether all slices at ``a`` equal those at ``b``, byte for byte."""
    if (len_a != len_b).any():
        return False
    eight = np.ndarray((len(padded) - 7,), np.dtype("<u8"), padded, 0, (1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    idx, at = np.flatnonzero(a != b), 0
    while len(idx):
        if (((eight[a[idx] + at] ^ eight[b[idx] + at]) & masks[np.minimum(len_a[idx] - at, 8)]) != 0).any():
            return False
        at += 8
        idx = idx[len_a[idx] > at]
    return True


def runs_of(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true bytes that do not cross a row's border."""
    n = len(flag)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin = flag.copy()
    begin[1:] &= ~flag[:-1] | first[1:n]
    end = flag.copy()
    end[:-1] &= ~flag[1:] | first[1:n]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1
