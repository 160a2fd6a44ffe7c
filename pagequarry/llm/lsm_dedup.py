"""Substring deduplication on a log-structured fingerprint index.

The index holds sorted immutable runs of window fingerprints, each a row of packed hashes for
every hash range ("fragment"). A new batch is merge-joined with every run, range by range:
fingerprints that the batch has twice or that a run has are hits. The batch's own fingerprints
become a new run; runs of a level are compacted into one of the next when there are enough.
Nothing is ever changed in place, so any task can be run again.

A window's fingerprint is its anchor (see units), the smallest k-gram hash in it, which it
shares with its neighbours, so a run holds about two hashes in k + 1 words. Hits are candidates
only: the windows at hit anchors are compared by 96-bit hashes of their whole word sequence; of
those that occur twice, 64 bits go back to the units, which remove them wherever they occur.

Defined cases: null, empty and word-free texts have no words and keep none; texts shorter than
a window are kept, texts of any length are read whole; repeated rows are documents of their
own, so both lose what they share, and ties have no order to settle; null ids are ids like
others; an empty table gives no rows; columns other than doc_id and text are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .shared import doc_key, of_group, of_groups, split_by, stored, unpack
from .units import FOUND, FRAGMENT_BYTES, SENT, Symbols, fragment_of, give_back, known_of, repeated, send_anchors, table, unit_table

LENGTH, GRAM, BATCHES, FANOUT = 35, 18, 3, 3
_SECOND_BASE = 0xA0761D6478BD642F | 1
RUN = "frag int, hashes binary"


class FingerprintIndex:
    """Sorted runs of fingerprints in the shared folder, by level."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.runs: list[tuple[int, DataFrame]] = []

    def history(self) -> DataFrame:
        out = self.spark.createDataFrame([], RUN)
        for _, run in self.runs:
            out = out.unionByName(run)
        return out

    def append(self, batch: DataFrame) -> DataFrame:
        """Adds a batch (frag, unit, hashes, many) as a run; returns the hits (frag, hashes)."""

        def merge(new: pa.Table, old: pa.Table) -> pa.Table:
            names = {"frag": pa.int32(), "hit": pa.bool_(), "hashes": pa.binary()}
            if not new.num_rows:
                return table(names, [])
            hashes, _ = unpack(new["hashes"], K.U64)
            hits = [repeated(hashes, unpack(new["many"], bool)[0])]
            run = np.unique(hashes)
            for packed in old["hashes"]:
                hits.append(run[K.isin_sorted(run, np.frombuffer(packed.as_py(), K.U64))])
            frag = new["frag"][0].as_py()
            return table(names, [(frag, False, run.tobytes()), (frag, True, np.unique(np.concatenate(hits)).tobytes())])

        merged = batch.groupBy("frag").cogroup(self.history().groupBy("frag")).applyInArrow(of_groups(merge), "frag int, hit boolean, hashes binary")
        merged = stored(merged, "fingerprint-run")
        self.runs.append((0, merged.where("not hit").select("frag", "hashes")))
        self.compact()
        return merged.where("hit").select("frag", "hashes")

    def compact(self) -> None:
        level = 0
        while len(same := [run for at, run in self.runs if at == level]) >= self.fanout:
            merged = same[0]
            for run in same[1:]:
                merged = merged.unionByName(run)

            def join(t: pa.Table) -> pa.Table:
                return table({"frag": pa.int32(), "hashes": pa.binary()}, [(t["frag"][0].as_py(), np.unique(unpack(t["hashes"], K.U64)[0]).tobytes())])

            self.runs = [x for x in self.runs if x[0] != level] + [(level + 1, stored(merged.groupBy("frag").applyInArrow(join, RUN), "fingerprint-compacted"))]
            level += 1


def _send_windows(length: int, gram: int, fragments: int):
    def of(t: pa.Table, hits: pa.Table) -> pa.Table:
        names = {"frag": pa.int32(), "unit": pa.int32(), "hashes": pa.binary(), "rest": pa.binary(), "many": pa.binary()}
        if not t.num_rows or not hits.num_rows:
            return table(names, [])
        s = Symbols(t["text"], "words")
        grams, starts, chosen = s.anchors(length, gram)
        starts = starts[K.isin_sorted(grams[chosen], known_of(hits))]
        first = K.gram_hashes(s.values, length)[starts]
        rest = (K.gram_hashes(s.values, length, _SECOND_BASE)[starts] >> K.U64(32)).astype(np.uint32)
        order = np.lexsort((rest, first))
        first, rest = first[order], rest[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])
        at = np.flatnonzero(new)
        many = np.diff(np.append(at, len(first))) > 1
        first, rest, unit = first[at], rest[at], t["unit"][0].as_py()
        return table(names, [(f, unit, a.tobytes(), b.tobytes(), m.tobytes()) for f, a, b, m in split_by(fragment_of(first, fragments), first, rest, many)])

    return of_groups(of)


def _same_windows(t: pa.Table) -> pa.Table:
    first, _ = unpack(t["hashes"], K.U64)
    rest, many = unpack(t["rest"], np.uint32)[0], unpack(t["many"], bool)[0]
    order = np.lexsort((rest, first))
    a, b, twice = first[order], rest[order], many[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    twice[1:] |= same
    twice[:-1] |= same
    return give_back(t, np.unique(a[twice]))


def _keep(length: int):
    def of(t: pa.Table, found: pa.Table) -> pa.Table:
        names = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.binary(), "rid": pa.int64()}
        if not t.num_rows:
            return table(names, [])
        s = Symbols(t["text"], "words")
        gone = np.zeros(len(s.values), bool)
        if found.num_rows:
            starts = np.flatnonzero(K.inside_text(s.at, length))
            starts = starts[K.isin_sorted(K.gram_hashes(s.values, length)[starts], known_of(found))]
            gone = K.cover(starts, length, len(s.values))
        kept, removed = [], []
        raw = s.data.tobytes()
        for k in range(t.num_rows):
            own = gone[s.at[k] : s.at[k + 1]]
            words = raw[s.offsets[k] : s.offsets[k + 1]].split()
            removed.append(int(own.sum()))
            kept.append(b" ".join(compress(words, (~own).tolist()) if removed[-1] else words))
        return pa.table([pa.array(c, n) for c, n in zip((t["doc_id"], np.diff(s.at), removed, kept, t["rid"]), names.values(), strict=True)], names=list(names))

    return of


def _digest(inner):
    def of(t: pa.Table, found: pa.Table) -> pa.Table:
        out = inner(t, found)
        return out.set_column(3, "kept_sha256", pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in out["kept"]], pa.string()))

    return of


def without_repeats(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, the words that are kept (bytes joined by a space, or kept_sha256) and rid."""
    spark = docs.sparkSession
    gram = (length + 1) // 2
    units, size = unit_table(doc_key(docs))
    fragments = size.parts(FRAGMENT_BYTES)
    sent = stored(units.groupBy("unit").applyInArrow(send_anchors("words", length, gram, fragments), SENT), "fingerprints")
    index, hits = FingerprintIndex(spark), spark.createDataFrame([], RUN)
    for k in range(batches):
        hits = hits.unionByName(index.append(sent.where(f"unit % {batches} = {k}")))

    def of_units(t: pa.Table, h: pa.Table) -> pa.Table:
        return give_back(t, np.unique(unpack(h["hashes"], K.U64)[0]))

    hit_units = sent.groupBy("frag").cogroup(hits.groupBy("frag")).applyInArrow(of_groups(of_units), FOUND)
    windows = units.groupBy("unit").cogroup(hit_units.groupBy("unit")).applyInArrow(_send_windows(length, gram, fragments), "frag int, unit int, hashes binary, rest binary, many binary")
    found = windows.groupBy("frag").applyInArrow(of_group(_same_windows), FOUND)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, rid long" if digest else "doc_id long, n_words long, n_removed long, kept binary, rid long"
    keep = _keep(length)
    return units.groupBy("unit").cogroup(found.groupBy("unit")).applyInArrow(of_groups(_digest(keep) if digest else keep), out)
