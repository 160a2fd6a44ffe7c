"""Plan sizes, packed arrays and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import bucketed, new_path, shared_folder, stored

__all__ = ["Size", "bucketed", "doc_key", "free", "new_path", "of_group", "of_groups", "pack", "shared_folder", "size_of", "split_by", "stored", "unpack"]


def free() -> None:
    """Gives memory that Python, numpy and Arrow no longer use back to the system, so that idle workers are small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def of_group(f):
    """f for groupBy().applyInArrow; frees memory after each group."""

    def of(t: pa.Table) -> pa.Table:
        try:
            return f(t)
        finally:
            free()

    return of


def of_groups(f):
    """f for cogroup().applyInArrow; frees memory after each group."""

    def of(a: pa.Table, b: pa.Table) -> pa.Table:
        try:
            return f(a, b)
        finally:
            free()

    return of


@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int

    def parts(self, each: int, least: int = 4) -> int:
        """How many parts of about `each` bytes hold all texts."""
        return max(least, -(-self.bytes // each))


def size_of(docs: DataFrame, text: str = "text") -> Size:
    row = docs.select(F.octet_length(text).alias("b")).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return Size(int(row["n"]), int(row["b"] or 0))


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def unpack(column: pa.Array | pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and the row of each."""
    from .kernels import text_bytes

    data, offsets = text_bytes(column)
    each = np.dtype(dtype).itemsize
    return np.frombuffer(data.tobytes(), dtype=dtype), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) // each)


def split_by(owner: np.ndarray, *columns: np.ndarray):
    """(owner, columns...) for each owner that has values, in time that doesn't depend on how many owners there could be."""
    if not len(owner):
        return
    order = np.argsort(owner, kind="stable")
    ordered = owner[order]
    edges = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]))
    columns = tuple(c[order] for c in columns)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield (int(ordered[a]), *(c[a:b] for c in columns))


def doc_key(docs: DataFrame) -> DataFrame:
    """doc_id and text only, in the types the operators use."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
