"""Runs (maximal periodic stretches) of words in each document by Crochemore's partition refinement.

Positions whose next L words are equal form a class; classes of length L + 1 split those of
length L by the class that follows. Only the smaller parts of classes that were split are used
to split others (all parts but the largest, which follows from the rest), so a position is
touched O(log n) times. Members of a class are a linked list in text order: a member at
distance L behind its predecessor, when classes have length L, is a square with a primitive
root of L words. Gaps are looked at when a link changes, never by length, and neighbouring
squares of one period are merged into a run.

A task refines the documents of a chunk of about CHUNK_BYTES together, as arrays; classes never
span documents. No row leaves its partition, so there is no shuffle and nothing to be skewed.

Defined cases: a null, empty or word-free text has no words and no runs, its digests are those
of empty strings; a null doc_id is no number, so rewriting by doc_id leaves its words alone;
repeated rows and equal texts are judged alike, one by one; a text of any length is read whole
by one task (about 60 bytes of memory for each of its words); ties of the greatest exponent go
to the smallest start, then the smallest period; an empty table gives no rows; columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .shared import doc_key, free

LEAST_WORDS, LEAST_PERIODS = 24, 3
CHUNK_BYTES = 8 << 20
_FOUND = [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64())]
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Refinement:
    """Classes of equal factors of all documents of a chunk, refined by length; a document's words are followed by a symbol of its own."""

    def __init__(self, classes: np.ndarray, last: np.ndarray, longest: np.ndarray):
        """classes: of length 1, dense; last: which positions are end symbols; longest: the greatest period to look for at each position."""
        n = len(classes)
        self.n, self.cls, self.last, self.longest = n, classes.astype(np.int64), last, longest
        order = np.argsort(self.cls, kind="stable")
        same = self.cls[order][1:] == self.cls[order][:-1]
        self.next, self.prev = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.next[order[:-1][same]], self.prev[order[1:][same]] = order[1:][same], order[:-1][same]
        self.size = np.zeros(n + 1, np.int64)
        self.size[: int(self.cls.max()) + 1] = np.bincount(self.cls)
        self.first = np.full(n + 1, -1, np.int64)
        heads = order[np.concatenate(([True], ~same))]
        self.first[self.cls[heads]] = heads
        self.used = len(heads)
        self.since = np.ones(n, np.int64)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def _reveal(self, at: np.ndarray, to: np.ndarray, length: int) -> None:
        """Squares among links that held until classes had this length."""
        gap = to - at
        ok = (to >= 0) & (self.since[at] <= gap) & (gap <= length) & (gap <= self.longest[at])
        if ok.any():
            self.squares.append((gap[ok], at[ok]))

    def _members(self, classes: np.ndarray) -> list[np.ndarray]:
        found, at = [], self.first[classes]
        while len(at):
            found.append(at)
            at = self.next[at]
            at = at[at >= 0]
        return found

    def refine(self, small: np.ndarray, length: int) -> np.ndarray:
        """From classes of `length` to those of one more; returns the positions of the smaller parts."""
        at = np.sort(small) - 1
        at = at[at >= 0]
        at = at[~self.last[at] & (self.longest[at] > length) & (self.size[self.cls[at]] > 1)]
        if not len(at):
            return at
        key = self.cls[at] * self.n + self.cls[at + 1]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        many = np.diff(np.append(begin, len(at)))
        old = self.cls[at[begin]]
        parent = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
        of = np.repeat(np.arange(len(parent)), np.diff(np.append(parent, len(begin))))
        rest = self.size[old[parent]] - np.add.reduceat(many, parent)
        most = np.maximum.reduceat(many, parent)
        largest = many == most[of]
        rank = np.cumsum(largest)
        largest &= rank == (rank - largest)[parent][of] + 1  # one of each parent's parts
        moved = (rest[of] > 0) | ~largest
        if not moved.any():
            return at[:0]
        by_rest = (most > rest) & (rest > 0)
        small_part = moved & ~(largest & by_rest[of])
        new = np.full(len(begin), -1, np.int64)
        new[moved] = self.used + np.arange(int(moved.sum()))
        self.used += int(moved.sum())
        self._move(at[np.repeat(moved, many)], np.repeat(new[moved], many[moved]), length)
        np.subtract.at(self.size, old[moved], many[moved])
        self.size[new[moved]] = many[moved]
        return np.concatenate([at[np.repeat(small_part, many)], *self._members(old[parent][by_rest])])

    def _move(self, at: np.ndarray, new: np.ndarray, length: int) -> None:
        """Takes positions (ordered by new class and place) out of their lists into lists of their new classes."""
        old = self.cls[at]
        order = np.lexsort((at, old))
        gone, of = at[order], old[order]
        tied = np.zeros(len(gone), bool)
        tied[1:] = (self.next[gone[:-1]] == gone[1:]) & (of[1:] == of[:-1])
        head = np.flatnonzero(~tied)
        before, after = self.prev[gone[head]], self.next[gone[np.append(head[1:], len(gone)) - 1]]
        to = np.full(len(at), -1, np.int64)
        same = new[1:] == new[:-1]
        to[:-1][same] = at[1:][same]
        changed = to != self.next[at]
        left = before >= 0
        self._reveal(at[changed], self.next[at[changed]], length)
        self._reveal(before[left], self.next[before[left]], length)
        self.since[at[changed]] = length + 1
        self.since[before[left]] = length + 1
        self.next[before[left]] = after[left]
        self.first[of[head][~left]] = after[~left]
        right = after >= 0
        self.prev[after[right]] = before[right]
        self.next[at] = to
        back = np.full(len(at), -1, np.int64)
        back[1:][same] = at[:-1][same]
        self.prev[at] = back
        starts = np.concatenate(([True], ~same))
        self.first[new[starts]] = at[starts]
        self.cls[at] = new

    def runs(self, least_words: int, least_periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, length and period of every run, ordered by start and period."""
        small, length, most = np.arange(self.n), 1, int(self.longest.max(initial=0))
        while len(small) and length < most:
            small = self.refine(small, length)
            length += 1
        linked = np.flatnonzero(self.next >= 0)
        self._reveal(linked, self.next[linked], self.n)
        if not self.squares:
            return (np.zeros(0, np.int64),) * 3
        period, at = (np.concatenate(x) for x in zip(*self.squares, strict=True))
        order = np.lexsort((at, period))
        period, at = period[order], at[order]
        begin = np.flatnonzero(np.concatenate(([True], (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1))))
        many = np.diff(np.append(begin, len(at)))
        start, period = at[begin], period[begin]
        size = many - 1 + 2 * period
        ok = (size >= least_words) & (size >= least_periods * period)
        order = np.lexsort((period[ok], start[ok]))
        return start[ok][order], size[ok][order], period[ok][order]


def chunk_runs(texts: list[list[bytes]], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """Of each document's words, its runs as (start, length, period)."""
    symbols, used = [], 0
    for words in texts:
        ids: dict[bytes, int] = {}
        symbols.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)) + used)
        used += len(ids)
    sizes = np.array([len(w) for w in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1  # of the end symbols
    total = int(ends[-1]) + 1 if len(ends) else 0
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not total:
        return out
    last = np.zeros(total, bool)
    last[ends] = True
    classes = np.empty(total, np.int64)
    classes[~last] = np.concatenate(symbols)
    classes[last] = used + np.arange(len(ends))
    longest = np.where(sizes >= least_words, sizes // least_periods, 0)
    found = Refinement(classes, last, np.repeat(longest, sizes + 1)).runs(least_words, least_periods)
    doc = np.searchsorted(ends, found[0])
    starts = found[0] - (ends - sizes)[doc]
    for d, s, n, q in zip(doc.tolist(), starts.tolist(), found[1].tolist(), found[2].tolist(), strict=True):
        out[d].append((s, n, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those in a run after the run's first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for run in runs:  # by start and period, so that ties stay with the first
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, digest: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_runs, the run with the greatest exponent, and all runs with the collapsed text (or the SHA-256 of both) of each row.

    A run has at least `least_words` words and `least_periods` periods. `rewrite` gets doc_id and
    the words of a document and returns the words to look at.
    """
    rest = [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())] if digest else [("runs", pa.list_(_RUN)), ("collapsed", pa.string())]
    schema = pa.schema(_FOUND + rest)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for first, end in K.chunks(offsets, chunk_bytes):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes().split() for i in range(first, end)]
                if rewrite:
                    texts = [rewrite(ids[first + i], w) for i, w in enumerate(texts)]
                rows = []
                for i, (words, runs) in enumerate(zip(texts, chunk_runs(texts, least_words, least_periods), strict=True)):
                    best = _greatest(runs)
                    start, length, period = best or (None, None, None)
                    listed, kept = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode() if digest else [dict(start=s, length=n, period=q) for s, n, q in runs], b" ".join(collapsed(words, runs))
                    shown = [hashlib.sha256(x).hexdigest() for x in (listed, kept)] if digest else [listed, kept.decode()]
                    rows.append((ids[first + i], len(runs), start, length, period, 1000 * length // period if best else None, *shown))
                del texts
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            free()

    kinds = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    kinds += "runs_sha256 string, collapsed_sha256 string" if digest else "runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return doc_key(docs).mapInArrow(of, kinds)
