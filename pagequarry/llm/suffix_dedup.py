"""Exact byte deduplication on suffix arrays sorted by bucket-pointer refinement.

A byte goes if a `length`-byte string over it also starts earlier. Only strings whose anchor
(see units) occurs twice can do so. For each such anchor a unit sends its context, the bytes
of all strings that have it as their anchor, once, with its earliest occurrence and the others.
All contexts of an anchor meet in one fragment. Contexts that are equal as a whole are one text
there, found by their bytes: the earliest stays and all others go, without any sorting. So the
suffix array has only texts that differ.

Their suffixes are sorted by bucket-pointer refinement. Buckets of _SORTED-byte grams come
first. A pass goes through the buckets of more than one suffix in order and splits each by the
buckets that its suffixes' later offsets point to; the new buckets are written at once, so
those that the pass reaches later already use them, and the sorted depth doubles at least.
Suffixes that are alone in their bucket are never touched again. Among neighbours in the
finished order, those with equal first `length` bytes are one string, whose earliest stays.

Defined cases: a null text is empty; documents are ordered by doc_id (null first), those of
equal doc_id by a hash of the text, then in any fixed order; repeated rows are documents of
their own, of which the first keeps its bytes; texts shorter than `length` are kept, texts of
any length are read whole; matches never cross documents; an empty table gives no rows; columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .shared import doc_key, of_group, of_groups, split_by, unpack
from .units import FOUND, FRAGMENT_BYTES, SENT, Symbols, give_back, known_of, repeated, send_anchors, table, unit_table

LENGTH = 100
#: Text whose contexts meet in one fragment.
CONTEXT_BYTES = 1 << 20
#: Bytes of the first buckets' grams; parts of a pass, each of which uses the buckets that the parts before it have split.
_SORTED, _SWEEP = 7, 8
CONTEXTS = "frag int, unit int, bytes binary, sizes binary, doc binary, tie binary, rid binary, start binary, others binary, other_rid binary, other_start binary"
SPANS = "unit int, rid binary, start binary, mask binary"
_SPANS = {"unit": pa.int32(), "rid": pa.binary(), "start": pa.binary(), "mask": pa.binary()}
_NULL_ID = np.iinfo(np.int64).min


def _send_contexts(length: int, gram: int, fragments: int):
    """Of each repeated anchor of a unit, its distinct contexts with their earliest and other occurrences."""
    names = {n: pa.int32() if n in ("frag", "unit") else pa.binary() for n in (c.split()[0] for c in CONTEXTS.split(", "))}

    def of(t: pa.Table, hits: pa.Table) -> pa.Table:
        if not t.num_rows or not hits.num_rows:
            return table(names, [])
        s = Symbols(t["text"], "bytes")
        grams, starts, chosen = s.anchors(length, gram)
        ok = K.isin_sorted(grams[chosen], known_of(hits))
        starts, chosen = starts[ok], chosen[ok]
        if not len(starts):
            return table(names, [])
        new = np.ones(len(starts), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, len(starts))) + length - 1
        begin = starts[at]
        row = np.searchsorted(s.at, begin, "right") - 1
        doc, tie, rid = (t[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "tie", "rid"))
        if t["doc_id"].null_count:
            doc = t["doc_id"].fill_null(_NULL_ID).to_numpy()
        place = begin - s.at[row]
        order = np.lexsort((place, rid[row], tie[row], doc[row]))
        raw, seen, firsts, others = s.data.tobytes(), {}, [], []
        for k in order.tolist():
            b = int(begin[k])
            c = raw[b : b + int(sizes[k])]
            if (j := seen.setdefault(c, len(firsts))) == len(firsts):
                firsts.append(k)
                others.append([])
            else:
                others[j].append(k)
        first, contexts = np.array(firsts), list(seen)
        frag = (grams[chosen[at[first]]] % K.U64(fragments)).astype(np.int32)
        unit, rows = t["unit"][0].as_py(), []
        for f, j in split_by(frag, np.arange(len(first))):
            k = first[j]
            more = np.array([x for i in j.tolist() for x in others[i]], dtype=np.int64)
            count = np.array([len(others[i]) for i in j.tolist()], dtype=np.int32)
            values = (sizes[k].astype(np.int32), doc[row[k]].astype(np.int64), tie[row[k]], rid[row[k]], place[k].astype(np.int64), count, rid[row[more]], place[more].astype(np.int64))
            rows.append((f, unit, b"".join(contexts[i] for i in j.tolist()), *(v.tobytes() for v in values)))
        return table(names, rows)

    return of_groups(of)


def _sorted_by(high: np.ndarray, low: np.ndarray, top: int) -> np.ndarray:
    """Order of values by (high, low, place); both are below top."""
    n, bits = len(high), max(1, int(top - 1).bit_length())
    at = max(1, int(n - 1).bit_length())
    if 2 * bits + at <= 64:  # one word holds all three, which sorts faster than an indirect sort
        word = ((high.astype(K.U64) << K.U64(bits)) | low.astype(K.U64)) << K.U64(at) | np.arange(n, dtype=K.U64)
        word.sort()
        return (word & K.U64((1 << at) - 1)).astype(np.int64)
    return np.argsort((high.astype(K.U64) << K.U64(32)) | low.astype(K.U64), kind="stable")


def _grams(text: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each place on as a number; zeros beyond the end."""
    padded = np.concatenate((text, np.zeros(n, np.uint8)))
    out = np.zeros(len(text), dtype=K.U64)
    for k in range(n):
        out = (out << K.U64(8)) | padded[k : k + len(text)]
    return out


def refined(text: np.ndarray, ends: np.ndarray, wanted: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The wanted suffixes in suffix order, and which of them begin another string than the one before.

    text: concatenated contexts; ends: for each byte, the end of its context; wanted: starts of
    suffixes that are at least `length` long. Equal strings of `length` bytes are neighbours.

    pointer is the bucket of each suffix: the place of its first member in suffix order. A suffix
    that ends with its context's end comes first in its bucket, and alone.
    """
    n = len(text)
    # initial buckets: grams of _SORTED bytes, cut at the context's end
    room = np.minimum(ends - np.arange(n), _SORTED)
    code = _grams(text, _SORTED)
    short = np.flatnonzero(room < _SORTED)
    code[short] &= ~((K.U64(1) << (K.U64(8) * (_SORTED - room[short]).astype(K.U64))) - K.U64(1))
    known, at, size = np.unique((code << K.U64(4)) | room.astype(K.U64), return_inverse=True, return_counts=True)
    first = np.cumsum(size) - size
    pointer = first[at]
    # suffixes that share their bucket, by bucket; those that ended with their context are done
    live = np.flatnonzero((size[at] > 1) & (room == _SORTED))
    live = live[_sorted_by(pointer[live], np.zeros(len(live), np.int64), n)]
    depth = _SORTED
    while depth < length and len(live):
        edges = np.flatnonzero(np.concatenate(([True], pointer[live[1:]] != pointer[live[:-1]], [True])))
        cuts = edges[np.unique(np.searchsorted(edges, np.linspace(0, len(live), _SWEEP + 1).astype(np.int64)))]
        left = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            # buckets of this part are split by the buckets of later offsets, as they are by now
            own = live[a:b]
            bucket = pointer[own]
            later = np.where(own + depth < ends[own], pointer[np.minimum(own + depth, n - 1)] + 1, 0)
            rank = np.unique(bucket, return_inverse=True)[1] if n > 1 << 20 else bucket
            order = _sorted_by(rank, later, n + 1)
            own, bucket, later = own[order], bucket[order], later[order]
            outer = np.concatenate(([True], bucket[1:] != bucket[:-1]))
            new = outer | np.concatenate(([True], later[1:] != later[:-1]))
            place = np.arange(len(own))
            begin = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            pointer[own] = bucket + begin[group] - np.maximum.accumulate(np.where(outer, place, 0))  # written at once
            many = np.diff(np.append(begin, len(own))) > 1
            left.append(own[many[group] & (later > 0)])
        live = np.concatenate(left)
        depth *= 2
    # neighbours in suffix order are the same string if their first bytes are
    order = wanted[_sorted_by(pointer[wanted], np.zeros(len(wanted), np.int64), n)]
    new = np.ones(len(order), bool)
    same = np.arange(1, len(order))
    eight = _grams(text, 8)
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length > 8 else [])]:
        same = same[eight[order[same] + k] == eight[order[same - 1] + k]]
    if length < 8:
        same = same[(eight[order[same]] ^ eight[order[same - 1]]) >> K.U64(8 * (8 - length)) == 0]
    new[same] = False
    return order, new


def _settle(length: int):
    """Spans of windows to remove for each unit, from all contexts of a fragment's anchors."""

    def of(t: pa.Table) -> pa.Table:
        sizes, owner = unpack(t["sizes"], np.int32)
        doc, tie, rid, start = (unpack(t[c], np.int64)[0] for c in ("doc", "tie", "rid", "start"))
        count = unpack(t["others"], np.int32)[0]
        other_rid, other_start = (unpack(t[c], np.int64)[0] for c in ("other_rid", "other_start"))
        text = K.text_bytes(t["bytes"])[0]
        n, stop = len(sizes), np.cumsum(sizes.astype(np.int64))
        begin = stop - sizes
        windows = sizes - length + 1
        everything = (np.int64(1) << windows.astype(np.int64)) - 1
        rank = np.empty(n, np.int64)
        rank[np.lexsort((start, rid, tie, doc))] = np.arange(n)
        raw, known = text.tobytes(), {}
        same = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)), np.int64, n)
        order = np.lexsort((rank, same))
        lead = np.ones(n, bool)
        lead[1:] = same[order[1:]] != same[order[:-1]]
        best = order[lead]  # the earliest context of each content
        best = best[np.argsort(rank[best])]
        mask = everything.copy()
        mask[best] = 0
        # strings of different contents, numbered from the earliest on
        m = windows[best].astype(np.int64)
        which = np.repeat(np.arange(len(best)), m)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
        if len(best) > 1:
            size = sizes[best].astype(np.int64)
            top = np.cumsum(size)
            pick = np.repeat(begin[best] - (top - size), size) + np.arange(top[-1])
            wanted = np.repeat(top - size, m) + offset
            order, new = refined(text[pick], np.repeat(top, size), wanted, length)
            number, string = np.searchsorted(wanted, order), np.cumsum(new) - 1
            at = _sorted_by(string, number, len(order))
            gone = number[at[1:]][string[at[1:]] == string[at[:-1]]]  # all but the first of each string
            np.bitwise_or.at(mask, best[which[gone]], np.int64(1) << offset[gone])
        keep = np.flatnonzero(mask)
        parent = np.repeat(np.arange(n), count)
        owners = np.concatenate((owner[keep], owner[parent]))
        values = (np.concatenate((rid[keep], other_rid)), np.concatenate((start[keep], other_start)), np.concatenate((mask[keep], everything[parent])))
        units = t["unit"].to_numpy()
        return table(_SPANS, [(int(units[r]), a.tobytes(), b.tobytes(), c.tobytes()) for r, a, b, c in split_by(owners, *values)])

    return of_group(of)


def _cut(length: int, digest: bool):
    names = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
    if digest:
        names = names | {"kept": pa.string()}

    def of(t: pa.Table, spans: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table(names, [])
        data, at = K.text_bytes(t["text"])
        rid, start, mask = (unpack(spans[c], np.int64)[0] for c in ("rid", "start", "mask"))
        own = t["rid"].to_numpy()
        order = np.argsort(own)
        row = order[np.searchsorted(own[order], rid)] if len(rid) else rid
        starts = [np.zeros(0, np.int64)]
        for k in range(int(mask.max()).bit_length() if len(mask) else 0):
            bit = (mask >> np.int64(k)) & 1 == 1
            starts.append(at[row[bit]] + start[bit] + k)
        gone = K.cover(np.concatenate(starts), length, len(data))
        removed, n_spans, kept = [], [], []
        for k in range(t.num_rows):
            a, b = at[k], at[k + 1]
            off = gone[a:b]
            count = int(off.sum())
            removed.append(count)
            n_spans.append(int(off[0]) + int((off[1:] & ~off[:-1]).sum()) if count else 0)
            left = (data[a:b][~off] if count else data[a:b]).tobytes()
            kept.append(hashlib.sha256(left).hexdigest() if digest else left)
        return table(names, list(zip(t["doc_id"].to_pylist(), np.diff(at).tolist(), removed, n_spans, kept, strict=True)))

    return of_groups(of)


def without_copies(docs: DataFrame, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes (kept), or their hex SHA-256 if `digest`."""
    gram = (length + 1) // 2
    units, size = unit_table(doc_key(docs))
    anchors, contexts = size.parts(FRAGMENT_BYTES), size.parts(CONTEXT_BYTES)

    def twice(t: pa.Table) -> pa.Table:
        return give_back(t, repeated(unpack(t["hashes"], K.U64)[0], unpack(t["many"], bool)[0]))

    hits = units.groupBy("unit").applyInArrow(send_anchors("bytes", length, gram, anchors), SENT).groupBy("frag").applyInArrow(of_group(twice), FOUND)
    sent = units.groupBy("unit").cogroup(hits.groupBy("unit")).applyInArrow(_send_contexts(length, gram, contexts), CONTEXTS)
    spans = sent.groupBy("frag").applyInArrow(_settle(length), SPANS)
    kind = "string" if digest else "binary"
    return units.groupBy("unit").cogroup(spans.groupBy("unit")).applyInArrow(_cut(length, digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {kind}")
