"""Shared pieces of the corpus operators: vectorised text kernels, fresh column names, tables in the cluster's shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop_stored, shared_dir, stored  # noqa: F401

#: Bytes of text that one round of the numpy kernels handles at a time; bounds a Python worker's scratch memory.
SLICE_BYTES = 1 << 20
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_POW: list[np.ndarray] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ranged(path: str, start: int, length: int) -> bytes:
    """Bytes of a file by its Spark path, through Arrow's file systems."""
    from pyarrow import fs

    if path.startswith("file:"):
        where, name = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        where, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    with where.open_input_file(name) as f:
        f.seek(start)
        return f.read(length)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that don't clash with those of ``df`` (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str):
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def in_file_order(df: DataFrame) -> DataFrame:
    """A Parquet table in the order in which its rows were written: by the number of the part, then the row in it.

    A scan alone takes files by size and in pieces. Any other DataFrame is as it is: its order is that of its partitions.
    """
    if not df._jdf.queryExecution().analyzed().children().isEmpty():  # not a bare table: its files aren't those of df
        return df
    part, path, row = fresh(df, "_part", "_path", "_row")
    try:
        at = df.metadataColumn("_metadata")
        number = F.regexp_extract(at["file_name"], "^part-([0-9]+)", 1).try_cast("long")
        placed = df.select(*[col(c) for c in df.columns], number.alias(part), at["file_path"].alias(path), at["row_index"].alias(row))
    except AnalysisException:
        return df
    return placed.orderBy(part, path, row).select(*[col(c) for c in df.columns])


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting in place."""
    x.sort()
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows first..last of a string column as (first, last, UTF-8 bytes, offsets); NULL is empty. A longer text has a slice of its own."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + most, "right")) - 1)
        last = min(last, n, first + 60_000)
        yield first, last, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The hash's base and its inverse to the powers 0..SLICE_BYTES - 1; never longer, whatever the texts are."""
    if not _POW:
        with np.errstate(over="ignore"):
            ones = np.full(SLICE_BYTES, _B, np.uint64), np.full(SLICE_BYTES, _BINV, np.uint64)
            for a in ones:
                a[0] = 1
            _POW[:] = [np.multiply.accumulate(a) for a in ones]
    return _POW[0], _POW[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash of numbers; see span_hash."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    up = _tables()[0]
    for s in range(0, len(data), SLICE_BYTES):
        x = (data[s : s + SLICE_BYTES].astype(np.uint64) + np.uint64(1)) * up[: len(data) - s]
        if s:
            x *= np.uint64(pow(int(_B), s, 1 << 64))
        np.cumsum(x, out=out[s + 1 : s + 1 + len(x)])
        if s:
            out[s + 1 : s + 1 + len(x)] += out[s]
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of the hashed numbers, by content alone."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    down = _tables()[1]
    x = (prefix[ends] - prefix[starts]) * down[starts % SLICE_BYTES]
    if len(prefix) > SLICE_BYTES:
        high = np.array([pow(int(_BINV), s, 1 << 64) for s in range(0, len(prefix), SLICE_BYTES)], np.uint64)
        x *= high[starts // SLICE_BYTES]
    return mix64(x)


_LOWER = np.zeros(256, np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalnum():
        _LOWER[_c] = ord(chr(_c).lower())
    elif _c >= 128:
        _LOWER[_c] = _c
_RAW = np.arange(256, dtype=np.uint8)
for _c in b" \t\n\r\x0b\x0c\0":
    _RAW[_c] = 0


def words(data: np.ndarray, offs: np.ndarray, folded: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, document) of the words. folded: lower case, and only letters, digits and bytes above 127; else whatever white space separates."""
    b = (_LOWER if folded else _RAW)[data]
    if folded and len(b) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        b[1:][upper] += 32
    inside = b != 0
    begins, finishes = inside.copy(), inside.copy()
    cut = np.zeros(len(b) + 1, bool)
    cut[offs] = True
    if len(b) > 1:
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        finishes[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return b, starts, ends, np.searchsorted(offs, starts, "right") - 1


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])
