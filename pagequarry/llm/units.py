"""Repeated-window search in three passes over units of documents.

Documents are dealt into units of about UNIT_BYTES of text, written once as a table that is
bucketed by unit. A pass handles each unit at once in arrays and exchanges packed arrays by
hash range ("fragment"): every unit sends a value once, however often it has it, so a passage
that a third of all rows share costs a fragment one value a unit.

Of every window's k-grams the smallest hash is its anchor; equal windows have equal anchors.
Only windows whose anchor occurs twice can be repeated, so the first pass finds repeated
anchors, about two in k + 1 positions, and only their windows are looked at afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import Size, bucketed, of_group, size_of, split_by, unpack

UNIT_BYTES = 2 << 20
UNITS_PER_FILE = 4
#: Files of a table at most, below the number of buckets that Spark allows; beyond it a file has more units.
MOST_FILES = 1 << 15
#: Text whose anchors or windows meet in one fragment.
FRAGMENT_BYTES = 24 << 20


def unit_table(docs: DataFrame, unit_bytes: int = UNIT_BYTES, per_file: int = UNITS_PER_FILE) -> tuple[DataFrame, Size]:
    """unit, rid (unique), doc_id, tie (orders rows of equal doc_id) and text, bucketed by unit in the shared folder."""
    size = size_of(docs)
    units = size.parts(unit_bytes)
    files = min(max(1, units // per_file), MOST_FILES)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("rid"))
    rows = rows.withColumn("unit", F.pmod(F.xxhash64("rid"), F.lit(units)).cast("int"))
    return bucketed(rows, "units", ["unit"], files), size


class Symbols:
    """Words or bytes of a unit's texts as 64-bit values, and the offsets of the texts into them."""

    def __init__(self, texts: pa.ChunkedArray, kind: str):
        self.data, self.offsets = K.text_bytes(texts)
        if kind == "bytes":
            self.values, self.at = K.byte_symbols(self.data), self.offsets
        else:
            starts, ends, self.at = K.words(self.data, self.offsets, K.BLANK_WORD)
            self.values = K.word_hashes(self.data, starts, ends)

    def anchors(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all k-grams; starts of all windows inside a text; the anchor (a place) of each."""
        grams = K.gram_hashes(self.values, gram)
        starts = np.flatnonzero(K.inside_text(self.at, length))
        if not len(starts):
            return grams, starts, starts
        return grams, starts, K.minimizers(grams, length - gram + 1)[starts]


def fragment_of(hashes: np.ndarray, fragments: int) -> np.ndarray:
    return (hashes % K.U64(fragments)).astype(np.int32)


SENT = "frag int, unit int, hashes binary, many binary"
FOUND = "unit int, hashes binary"


def table(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))


_SENT = {"frag": pa.int32(), "unit": pa.int32(), "hashes": pa.binary(), "many": pa.binary()}
_FOUND = {"unit": pa.int32(), "hashes": pa.binary()}


def send_anchors(kind: str, length: int, gram: int, fragments: int):
    """For groupBy("unit").applyInArrow: the unit's distinct anchors, and which of them it has twice."""

    def of(t: pa.Table) -> pa.Table:
        s = Symbols(t["text"], kind)
        grams, _, chosen = s.anchors(length, gram)
        hashes, counts = np.unique(grams[np.unique(chosen)], return_counts=True)
        unit = t["unit"][0].as_py()
        return table(_SENT, [(f, unit, h.tobytes(), m.tobytes()) for f, h, m in split_by(fragment_of(hashes, fragments), hashes, counts > 1)])

    return of_group(of)


def repeated(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Sorted distinct values that come twice or are marked."""
    order = np.argsort(hashes, kind="stable")
    h, m = hashes[order], many[order]
    twice = m.copy()
    twice[1:] |= h[1:] == h[:-1]
    return np.unique(h[twice])


def give_back(t: pa.Table, known: np.ndarray) -> pa.Table:
    """Of what each unit sent, the values that are known."""
    hashes, row = unpack(t["hashes"], K.U64)
    ok = K.isin_sorted(hashes, known)
    units = t["unit"].to_numpy()
    return table(_FOUND, [(int(units[r]), h.tobytes()) for r, h in split_by(row[ok], hashes[ok])])


def known_of(t: pa.Table) -> np.ndarray:
    """All hashes that were given back to one unit, sorted."""
    return np.sort(unpack(t["hashes"], K.U64)[0])
