"""Benchmark decontamination by winnowing.

Texts become lower-cased alphanumeric words. Of every `window` words, the smallest hash among
their k-grams is kept as fingerprint, in documents as in benchmark items; equal windows keep
the same k-gram, so each shared span of `window` words meets in a fingerprint. A fingerprint
hit is extended to the windows around it, which are looked up among the item's windows and
compared word by word. An item shorter than a window is matched as a whole.

A benchmark of at most BROADCAST_BYTES (its size is checked) goes to all tasks, so that no
document moves. A larger one is joined by fingerprint: units of documents send their distinct
fingerprints by hash range, the benchmark its windows with theirs; each unit gets back the
windows whose fingerprints it has, and is judged by them. No text is collected then.

Defined cases: null or word-free texts have no words and no hits; texts of any length are read
whole; item ids are compared and sorted as strings, and those that are null hit words but aren't
listed; repeated document rows are judged each on its own; repeated items count once, items
with equal texts all count; an empty benchmark hits nothing, an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import free, of_group, of_groups, size_of, split_by, stored, unpack
from .units import FRAGMENT_BYTES, table, unit_table

WINDOW, GRAM = 13, 5
#: Bytes of a benchmark's ids and texts that are broadcast at most.
BROADCAST_BYTES = 8 << 20
_CHUNK = 1 << 20
_RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("hit_from", T.ArrayType(T.IntegerType())),
        T.StructField("hit_to", T.ArrayType(T.IntegerType())),
    ]
)
_FOUND = {"n_words": pa.int64(), "n_hit": pa.int64(), "item_ids": pa.list_(pa.string()), "hit_from": pa.list_(pa.int32()), "hit_to": pa.list_(pa.int32())}


@dataclass
class _Texts:
    """Words and word hashes of a batch of texts."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> _Texts:
        data = K.ASCII_LOWER[data]
        starts, ends, at = K.words(data, offsets, K.ALNUM_WORD)
        return cls(data, starts, ends, at, K.word_hashes(data, starts, ends))

    def window(self, first: int, n: int) -> bytes:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[first : first + n].tolist(), self.ends[first : first + n].tolist(), strict=True))


def fingerprints(hashes: np.ndarray, at: np.ndarray, n: int, gram: int) -> np.ndarray:
    """The fingerprint of each window of n words that lies in one text; `at` are the offsets of the texts into the words' hashes."""
    gram = min(gram, n)
    inside = np.flatnonzero(K.inside_text(at, n))
    grams = K.gram_hashes(hashes, gram)
    if not len(inside):
        return inside.astype(K.U64)
    return K.mix(grams[K.minimizers(grams, n - gram + 1)[inside]] ^ K.U64(n))


@dataclass
class Block:
    """Windows of benchmark items: by length, sorted hashes, the first word of one such window, and the items of each."""

    words: _Texts
    ids: list[str | None]
    prints: np.ndarray
    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    first: dict[int, np.ndarray] = field(default_factory=dict)
    items: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, ids: list[str | None], texts: pa.Array, window: int, gram: int) -> Block:
        t = _Texts.of(*K.text_bytes(texts))
        size = np.diff(t.at)
        length = np.minimum(size, window)
        out = cls(t, ids, np.unique(fingerprints(t.hashes, t.at, window, gram)))
        for n in np.unique(length[length > 0]).tolist():
            own = length == n
            item = np.repeat(np.flatnonzero(own), size[own] - n + 1)
            first = np.concatenate([np.arange(a, b - n + 1) for a, b in zip(t.at[:-1][own].tolist(), t.at[1:][own].tolist(), strict=True)])
            hashes = K.gram_hashes(t.hashes, n)[first]
            order = np.lexsort((item, hashes))
            hashes, item, first = hashes[order], item[order], first[order]
            edges = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1], [True])))
            out.hashes[n], out.first[n], out.items[n] = hashes[edges[:-1]], first[edges[:-1]], (edges, item)
        return out

    def of_windows(self, n: int, places: np.ndarray) -> set[str]:
        edges, item = self.items[n]
        found = {self.ids[k] for p in places.tolist() for k in item[edges[p] : edges[p + 1]].tolist()}
        return found - {None}


def _match(t: _Texts, block: Block, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hit windows: first word, length and place among the block's windows of that length."""
    firsts, lengths, places = [], [], []
    for n, known in block.hashes.items():
        first = np.flatnonzero(K.inside_text(t.at, n))
        if n == window:
            first = first[K.isin_sorted(fingerprints(t.hashes, t.at, n, gram), block.prints)]
        if not len(first):
            continue
        hashes = K.gram_hashes(t.hashes, n)[first]
        ok = K.isin_sorted(hashes, known)
        first, place = first[ok], np.searchsorted(known, hashes[ok])
        same = np.fromiter((t.window(f, n) == block.words.window(p, n) for f, p in zip(first.tolist(), block.first[n][place].tolist(), strict=True)), bool, len(first))
        firsts.append(first[same])
        places.append(place[same])
        lengths.append(np.full(int(same.sum()), n))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x).astype(np.int64) if x else none for x in (firsts, lengths, places))


def _judge(texts: pa.Array, block: Block, window: int, gram: int) -> list[pa.Array]:
    data, offsets = K.text_bytes(texts)
    n_words, n_hit, items, froms, tos = [], [], [], [], []
    for a, b in K.chunks(offsets, _CHUNK):
        t = _Texts.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        first, length, place = _match(t, block, window, gram)
        doc = np.searchsorted(t.at, first, "right") - 1
        order = np.argsort(doc, kind="stable")
        first, length, place, doc = first[order], length[order], place[order], doc[order]
        cut = np.searchsorted(doc, np.arange(b - a + 1)).tolist()
        n_words += np.diff(t.at).tolist()
        for k in range(b - a):
            i, j = cut[k], cut[k + 1]
            if i == j:
                for out, none in ((n_hit, 0), (items, []), (froms, []), (tos, [])):
                    out.append(none)
                continue
            edge = np.zeros(int(t.at[k + 1] - t.at[k]) + 1, np.int32)
            np.add.at(edge, first[i:j] - t.at[k], 1)
            np.add.at(edge, first[i:j] - t.at[k] + length[i:j], -1)
            covered = np.cumsum(edge) > 0
            turn = np.flatnonzero(np.diff(np.concatenate(([False], covered))))
            n_hit.append(int(covered.sum()))
            items.append(sorted(set().union(*(block.of_windows(n, np.unique(place[i:j][length[i:j] == n])) for n in np.unique(length[i:j]).tolist()))))
            froms.append(turn[0::2].tolist())
            tos.append(turn[1::2].tolist())
    return [pa.array(x, kind) for x, kind in zip((n_words, n_hit, items, froms, tos), _FOUND.values(), strict=True)]


def _broadcast(docs: DataFrame, bench: DataFrame, text: str, window: int, gram: int) -> DataFrame:
    rows = bench.toArrow()  # its size was checked
    held = docs.sparkSession.sparkContext.broadcast(Block.of(rows["item_id"].to_pylist(), rows["text"], window, gram))
    where = docs.columns.index(text)

    def of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *_judge(batch.column(where), held.value, window, gram)], names=[*batch.schema.names, *_FOUND])
            free()

    return docs.mapInArrow(of, T.StructType([*docs.schema, *_RESULT]))


def _joined(docs: DataFrame, bench: DataFrame, text: str, window: int, gram: int) -> DataFrame:
    numbered = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "documents-to-judge")
    units, size = unit_table(numbered.select(F.col("_row").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")))
    fragments = size_of(bench).parts(FRAGMENT_BYTES, max(4, size.parts(FRAGMENT_BYTES) // 4))
    words = F.regexp_count(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    lengths = sorted(r["n"] for r in bench.select(F.least(words, F.lit(window)).alias("n")).where("n > 0").distinct().collect())  # at most `window` numbers

    def of_unit(t: pa.Table) -> pa.Table:
        x = _Texts.of(*K.text_bytes(t["text"]))
        prints = np.unique(np.concatenate([fingerprints(x.hashes, x.at, n, gram) for n in lengths])) if lengths else np.zeros(0, K.U64)
        unit = t["unit"][0].as_py()
        return table({"frag": pa.int32(), "unit": pa.int32(), "hashes": pa.binary()}, [(f, unit, h.tobytes()) for f, h in split_by((prints % K.U64(fragments)).astype(np.int32), prints)])

    def of_items(batches):
        for batch in batches:
            ids = batch["item_id"].to_pylist()
            x = _Texts.of(*K.text_bytes(batch["text"]))
            rows = []
            for k, (a, b) in enumerate(zip(x.at[:-1].tolist(), x.at[1:].tolist(), strict=True)):
                n = min(window, b - a)
                for j, h in enumerate(fingerprints(x.hashes[a:b], np.array([0, b - a]), n, gram).tolist() if n else ()):
                    rows.append((h % fragments, np.uint64(h).tobytes(), x.window(a + j, n), ids[k]))
            yield from table({"frag": pa.int32(), "print": pa.binary(), "window": pa.binary(), "item_id": pa.string()}, rows).to_batches()

    def join(sent: pa.Table, windows: pa.Table) -> pa.Table:
        names = {"unit": pa.int32(), "window": pa.binary(), "item_id": pa.string()}
        if not sent.num_rows or not windows.num_rows:
            return table(names, [])
        prints = unpack(windows["print"], K.U64)[0]
        order = np.argsort(prints, kind="stable")
        have, at = unpack(sent["hashes"], K.U64)
        a, b = np.searchsorted(prints[order], have), np.searchsorted(prints[order], have, "right")
        many = b - a
        ends = np.cumsum(many)
        pick = order[np.repeat(a - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]
        unit = sent["unit"].to_numpy()[np.repeat(at, many)]
        return pa.table([pa.array(unit, pa.int32()), windows["window"].take(pick), windows["item_id"].take(pick)], names=list(names))

    def judge(t: pa.Table, windows: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table({"_row": pa.int64(), **_FOUND}, [])
        block = Block.of(windows["item_id"].to_pylist(), windows["window"].combine_chunks(), window, gram)
        return pa.table([t["doc_id"], *_judge(t["text"], block, window, gram)], names=["_row", *_FOUND])

    sent = units.groupBy("unit").applyInArrow(of_group(of_unit), "frag int, unit int, hashes binary")
    windows = bench.mapInArrow(of_items, "frag int, print binary, window binary, item_id string").distinct()
    met = sent.groupBy("frag").cogroup(windows.groupBy("frag")).applyInArrow(of_groups(join), "unit int, window binary, item_id string")
    found = units.groupBy("unit").cogroup(met.groupBy("unit")).applyInArrow(of_groups(judge), T.StructType([T.StructField("_row", T.LongType()), *_RESULT]))
    return numbered.join(found, "_row").drop("_row")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_words, n_hit, item_ids, hit_from and hit_to (word ranges) of benchmark windows.

    Input columns of those names are replaced.
    """
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in _FOUND))
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = bench.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("item_id"), F.lit(0)) + F.coalesce(F.octet_length("text"), F.lit(0))), F.lit(0))).first()[0]
    return _broadcast(docs, bench, text, window, gram) if size <= broadcast_bytes else _joined(docs, bench, text, window, gram)


def contaminated(n_hit, n_words):
    """The rule: at least a twentieth of the words is hit."""
    return (n_hit > 0) & (F.lit(20) * n_hit >= n_words)
