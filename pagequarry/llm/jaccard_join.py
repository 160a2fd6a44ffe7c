"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word n-grams. The n-grams have one global order, rarest
first (document frequency up to a bound, then hash), and are cut by hash into fragments. A
document is cut the same way: a segment for each fragment. Each fragment counts frequencies,
and for pairs the partial overlap of their segments, on its own; a pair's overlap is the sum.

1. One pass makes the sets; equal sets of a batch travel once. Each fragment drops n-grams that
   only one set has, and returns what is left of the segments.
2. A set that keeps too few n-grams for any partner is out. Of the others, the prefix is the
   shortest beginning in global order that must hold a common n-gram of any two that link.
3. Every n-gram has a hub, one of the sets that have it in their prefix. A set is paired with the
   hub that it meets most often, not with all others there; verified links give components. The
   first hubs are the sets with the fewest n-grams of their own; n-grams that still hold several
   components get other hubs in further rounds.
4. N-grams that still hold several components pair the sets of the smaller ones with those of
   other components, under the length and position filters. Sets of one component need no
   further link, so no list is paired with itself.

Groups of equal sets are classes and stand in the join once. Components are exact.

Defined cases: null, empty and word-free texts have no set and link with nothing; fewer than n
words make one n-gram; a text of any length is one set; repeated rows are documents of their own
and link; ties between hubs and components go by row number; null ids don't count as smallest,
and a component without any other id has a null component_id; an empty table gives no rows;
other columns are ignored, whatever their names. N-grams are told apart
by their fragment and 52 bits of a 64-bit hash, equal sets by two sums of 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .shared import bucketed, free, of_group, of_groups, size_of, split_by, stored, unpack
from .units import MOST_FILES

N, PERCENT = 5, 75
#: Rounds of pairing sets with hubs before the pairs of different components are listed.
HUB_ROUNDS = 3
FRAGMENT_BYTES = 8 << 20
_CHUNK = 3 << 19
#: Frequencies beyond this order by hash only.
_MOST = 2047
_LOW = K.U64((1 << 52) - 1)
_SENT = {"frag": pa.int32(), **{c: pa.binary() for c in ("rid", "n", "count", "hashes", "own", "doc_id", "total", "one", "two")}}
#: Text whose sets meet in one block of documents.
BLOCK_BYTES = 6 << 20
_COUNTED = {"frag": pa.int32(), "block": pa.int32(), "rid": pa.int64(), "doc_id": pa.int64(), "n": pa.int32(), "one": pa.int64(), "two": pa.int64(), **{c: pa.binary() for c in ("rids", "sizes", "counts", "keys")}}
COUNTED = "frag int, block int, rid long, doc_id long, n int, one long, two long, rids binary, sizes binary, counts binary, keys binary"
_PREFIX = {"rid": pa.int64(), "n": pa.int32(), "left": pa.int32(), "prefix": pa.list_(pa.int64()), "frags": pa.list_(pa.int32())}
_NULL_ID = np.iinfo(np.int64).min


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    data = K.ASCII_LOWER[data]
    starts, ends, at = K.words(data, offsets, K.BLANK_WORD)
    hashes = K.word_hashes(data, starts, ends)
    grams = K.gram_hashes(hashes, n)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(grams[a : b - n + 1]) if b - a >= n else K.gram_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, K.U64))
    return out


def _send(n: int, fragments: int):
    """For mapInArrow: packed segments of a batch's distinct sets, and a row for each document, by fragment."""

    def rows_of(rid: np.ndarray, doc: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        edges = np.concatenate(([0], np.cumsum(sizes)))
        every = np.concatenate(sets) if sets else np.zeros(0, K.U64)
        total = np.concatenate((np.zeros(1, K.U64), np.cumsum(K.mix(every.copy()))))
        other = np.concatenate((np.zeros(1, K.U64), np.cumsum(K.mix(every ^ K.U64(0x5851F42D4C957F2D)))))
        one, two = total[edges[1:]] - total[edges[:-1]], other[edges[1:]] - other[edges[:-1]]
        first, lead = {}, np.zeros(len(sets), bool)
        for k, key in enumerate(zip(sizes.tolist(), one.tolist(), two.tolist(), strict=True)):
            lead[k] = first.setdefault(key, k) == k
        chosen = np.flatnonzero(lead & (sizes > 0))
        hashes = np.concatenate([sets[k] for k in chosen]) if len(chosen) else np.zeros(0, K.U64)
        owner = np.repeat(chosen, sizes[chosen])
        segments = {f: (h, o) for f, h, o in split_by((hashes % K.U64(fragments)).astype(np.int32), hashes, owner)}
        members = {f: m for f, m in split_by((K.mix(rid.astype(K.U64)) % K.U64(fragments)).astype(np.int32), np.arange(len(rid)))}
        rows, none = [], (np.zeros(0, K.U64), np.zeros(0, np.int64))
        for f in segments.keys() | members.keys():
            h, o = segments.get(f, none)
            k, count = np.unique(o, return_counts=True)
            m = members.get(f, none[1])
            values = (rid[k], sizes[k].astype(np.int32), count.astype(np.int32), h, rid[m], doc[m], sizes[m].astype(np.int32), one[m], two[m])
            rows.append((f, *(v.tobytes() for v in values)))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _SENT]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SENT.values(), strict=True)], names=list(_SENT))

    def of(batches):
        for batch in batches:
            data, offsets = K.text_bytes(batch["text"])
            rid = batch["rid"].to_numpy()
            doc = batch["doc_id"].fill_null(_NULL_ID).to_numpy()
            for a, b in K.chunks(offsets, _CHUNK):
                yield rows_of(rid[a:b], doc[a:b], gram_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n))
            free()

    return of


def _blocks_of(rid: np.ndarray, blocks: int) -> np.ndarray:
    return (K.mix(rid.astype(K.U64) + K.U64(17)) % K.U64(blocks)).astype(np.int32)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))


def _count(blocks: int):
    """What is left of a fragment's segments without the n-grams of one set only, packed by block; and its documents' rows (frag -1)."""

    def of(t: pa.Table) -> pa.Table:
        hashes, _ = unpack(t["hashes"], K.U64)
        count = unpack(t["count"], np.int32)[0]
        rid, n = unpack(t["rid"], np.int64)[0], unpack(t["n"], np.int32)[0]
        owner = np.repeat(np.arange(len(rid)), count)
        order = np.argsort(hashes)
        ordered = hashes[order]
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True]))) if len(ordered) else np.zeros(1, np.int64)
        times = np.diff(edge)
        df = np.empty(len(hashes), np.int64)
        df[order] = np.repeat(times, times)
        keep = np.flatnonzero(df > 1)
        key = ((np.minimum(df[keep], _MOST).astype(K.U64) << K.U64(52)) | (hashes[keep] & _LOW)).astype(np.int64)
        frag, rows = t["frag"][0].as_py(), []
        for block, k, own in split_by(_blocks_of(rid, blocks)[owner[keep]], key, owner[keep]):
            who, counts = np.unique(own, return_counts=True)
            rows.append((block, *(v.tobytes() for v in (rid[who], n[who], counts.astype(np.int32), k))))
        member, doc = unpack(t["own"], np.int64)[0], unpack(t["doc_id"], np.int64)[0]
        total, one, two = unpack(t["total"], np.int32)[0], unpack(t["one"], np.int64)[0], unpack(t["two"], np.int64)[0]
        s, m = len(rows), len(member)
        packed = list(zip(*rows, strict=True)) if rows else [[]] * 5
        columns = {
            "frag": [frag] * s + [-1] * m,
            "block": [*packed[0], *_blocks_of(member, blocks).tolist()],
            "rid": [None] * s + member.tolist(),
            "doc_id": [None] * s + [None if x == _NULL_ID else x for x in doc.tolist()],
            "n": [None] * s + total.tolist(),
            "one": [None] * s + one.tolist(),
            "two": [None] * s + two.tolist(),
            **{c: [*packed[k + 1], *[None] * m] for k, c in enumerate(("rids", "sizes", "counts", "keys"))},
        }
        return pa.table([pa.array(columns[c], x) for c, x in _COUNTED.items()], names=list(_COUNTED))

    return of_group(of)


def _prefixes(percent: int):
    """Of a block's sets that lead their class and keep enough n-grams: the prefix in global order and the fragments."""

    def of(t: pa.Table, leads: pa.Table) -> pa.Table:
        rid, at = unpack(t["rids"], np.int64)
        n, counts, keys = unpack(t["sizes"], np.int32)[0], unpack(t["counts"], np.int32)[0], unpack(t["keys"], np.int64)[0]
        frag = t["frag"].to_numpy()[at] if len(rid) else np.zeros(0, np.int32)
        ok = np.isin(rid, leads["rid"].to_numpy())
        keys, rid, n, counts, frag = keys[np.repeat(ok, counts)], rid[ok], n[ok], counts[ok], frag[ok]
        who, first, own = np.unique(rid, return_index=True, return_inverse=True)
        n, left = n[first].astype(np.int64), np.bincount(own, counts, len(who)).astype(np.int64)
        enough = 100 * left >= percent * n
        by_key = np.repeat(own, counts)
        order = np.lexsort((keys, by_key))
        keys, by_key = keys[order], by_key[order]
        begin = np.cumsum(left) - left
        rank = np.arange(len(keys)) - begin[by_key]
        needed = (percent * n + 99) // 100  # n-grams that any partner shares
        prefix = enough[by_key] & (rank <= (left - needed)[by_key])
        by_frag = np.lexsort((frag, own))
        used = enough[own[by_frag]]
        columns = (who[enough], n[enough].astype(np.int32), left[enough].astype(np.int32), _lists(keys[prefix], np.bincount(by_key[prefix], minlength=len(who))[enough]), _lists(frag[by_frag][used].astype(np.int32), np.bincount(own, minlength=len(who))[enough]))
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c, x) for c, x in zip(columns, _PREFIX.values(), strict=True)], names=list(_PREFIX))

    return of_groups(of)


_PAIRS = {"frag": pa.int32(), "a": pa.binary(), "b": pa.binary()}
_PARTS = {"block": pa.int32(), "a": pa.binary(), "b": pa.binary(), "part": pa.binary()}


def _deal(batches):
    """For mapInArrow: the pairs of a batch, packed for each fragment of their smaller-numbered fragment list."""
    for batch in batches:
        a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
        frags = batch["frags"].flatten().to_numpy()
        pair = np.repeat(np.arange(len(a)), batch["frags"].value_lengths().to_numpy())
        rows = [(f, a[p].tobytes(), b[p].tobytes()) for f, p in split_by(frags, pair)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, _PAIRS.values(), strict=True)], names=list(_PAIRS))


def _partial(blocks: int):
    """The overlap of the two segments of each pair in this fragment, where there is any, packed by block of the second set."""

    def of(t: pa.Table, pairs: pa.Table) -> pa.Table:
        a, b = unpack(pairs["a"], np.int64)[0], unpack(pairs["b"], np.int64)[0]
        rid, counts, keys = unpack(t["rids"], np.int64)[0], unpack(t["counts"], np.int32)[0], unpack(t["keys"], np.int64)[0]
        used = np.isin(rid, np.concatenate((a, b)))
        keys, rid, counts = keys[np.repeat(used, counts)], rid[used], counts[used]
        if not len(rid) or not len(a):
            return pa.table([pa.array([], x) for x in _PARTS.values()], names=list(_PARTS))
        order = np.argsort(rid)
        begin = (np.cumsum(counts) - counts)[order]
        rid, counts = rid[order], counts[order].astype(np.int64)
        top = np.cumsum(counts)
        start = top - counts
        code = np.unique(keys, return_inverse=True)[1].astype(np.int64)[np.repeat(begin - start, counts) + np.arange(top[-1])]
        held = np.sort((np.repeat(np.arange(len(rid)), counts) << 32) | code)
        i, j = (np.minimum(np.searchsorted(rid, x), len(rid) - 1) for x in (a, b))
        there = (rid[i] == a) & (rid[j] == b)
        a, b, i, j = a[there], b[there], i[there], j[there]
        part = np.zeros(len(a), np.int32)
        for k in range(0, len(a), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            size = counts[x]
            end = np.cumsum(size)
            found = (np.repeat(y, size) << 32) | code[np.repeat(start[x] - (end - size), size) + np.arange(end[-1])]
            place = np.minimum(np.searchsorted(held, found), len(held) - 1)
            part[k : k + (1 << 16)] = np.add.reduceat((held[place] == found).astype(np.int32), end - size)
        some = part > 0
        rows = [(block, *(v.tobytes() for v in own)) for block, *own in split_by(_blocks_of(b[some], blocks), a[some], b[some], part[some])]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table([pa.array(c, x) for c, x in zip(columns, _PARTS.values(), strict=True)], names=list(_PARTS))

    return of_groups(of)


def _sum(t: pa.Table) -> pa.Table:
    """A block's pairs with the sums of their partial overlaps."""
    a, b, part = unpack(t["a"], np.int64)[0], unpack(t["b"], np.int64)[0], unpack(t["part"], np.int32)[0]
    order = np.lexsort((b, a))
    a, b, part = a[order], b[order], part[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return pa.table([pa.array(a[new]), pa.array(b[new]), pa.array(np.add.reduceat(part, new).astype(np.int32))], names=["a", "b", "shared"])


def _linked(pairs: DataFrame, segments: DataFrame, percent: int, blocks: int) -> DataFrame:
    """Of pairs (a, b, na, nb, frags), those whose overlaps, summed over the fragments, reach the threshold."""
    dealt = pairs.select("a", "b", "frags").mapInArrow(_deal, "frag int, a binary, b binary")
    parts = segments.groupBy("frag").cogroup(dealt.groupBy("frag")).applyInArrow(_partial(blocks), "block int, a binary, b binary, part binary")
    sums = parts.groupBy("block").applyInArrow(of_group(_sum), "a long, b long, shared int")
    return sums.join(pairs.select("a", "b", "na", "nb"), ["a", "b"]).where(F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("shared")))


def _placed(tokens: DataFrame, comps: DataFrame | None) -> DataFrame:
    """tokens with the component of each set so far."""
    if comps is None:
        return tokens.withColumn("comp", F.col("rid"))
    return tokens.join(comps, tokens.rid == comps.node, "left").select(*tokens.columns, F.coalesce("comp", "rid").alias("comp"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) with the smaller number first."""
    up = F.col("a") < F.col("b")
    pick = lambda x, y, name: F.when(up, F.col(x)).otherwise(F.col(y)).alias(name)
    return pairs.select(pick("a", "b", "a"), pick("b", "a", "b"), pick("na", "nb", "na"), pick("nb", "na", "nb"))


def _near_enough(na, nb, a_left, b_left, percent: int):
    """Whether sets of these sizes that share at most so many n-grams can link."""
    return (F.lit(percent) * F.greatest(na, nb) <= F.lit(100) * F.least(na, nb)) & (F.lit(100 + percent) * F.least(a_left, b_left) >= F.lit(percent) * (na + nb))


def _main(placed: DataFrame) -> DataFrame:
    """Of each n-gram that holds several components, the one with the most sets; of equal ones the largest number, however rows arrive."""
    shares = placed.groupBy("key", "comp").agg(F.count("*").alias("times"))
    found = shares.groupBy("key").agg(F.max_by("comp", F.struct("times", "comp")).alias("main"), F.count("*").alias("comps"))
    return found.where("comps > 1").select("key", "main")


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT, row: str | None = None) -> DataFrame:
    """rid, doc_id, n_shingles, component and component_id of each row of docs.

    rid is the column that `row` names, unique and not null, else a new number.
    component is a rid of the row's component, the same for all its rows; component_id is the
    smallest doc_id reachable by links.
    """
    size = size_of(docs)
    fragments, blocks = size.parts(FRAGMENT_BYTES), size.parts(BLOCK_BYTES)
    rid = F.col(row).cast("long") if row else F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rid.alias("rid"))
    sent = rows.mapInArrow(_send(n, fragments), ", ".join(f"{c} {'int' if c == 'frag' else 'binary'}" for c in _SENT))
    # in buckets, as every round of pairs meets the segments by fragment
    counted = bucketed(sent.groupBy("frag").applyInArrow(_count(blocks), COUNTED), "segments", ["frag"], min(fragments, MOST_FILES), shuffle=False)
    documents = counted.where("frag = -1").select("rid", "block", "doc_id", "n", "one", "two")
    segments = counted.where("frag >= 0").select("frag", "block", "rids", "sizes", "counts", "keys")

    classes = documents.where("n > 0").groupBy("n", "one", "two").agg(F.min(F.struct("rid", "block")).alias("first"), F.min("doc_id").alias("least_id"))
    classes = classes.select("n", "one", "two", F.col("first.rid").alias("lead"), F.col("first.block").alias("block"), "least_id")
    leads = classes.select("block", F.col("lead").alias("rid"))
    sets = stored(segments.groupBy("block").cogroup(leads.groupBy("block")).applyInArrow(_prefixes(percent), "rid long, n int, left int, prefix array<long>, frags array<int>"), "prefixes")
    # in buckets too, as every round looks for the hubs of n-grams and meets them
    files = min(blocks, MOST_FILES)
    tokens = sets.select("rid", "n", "left", F.posexplode("prefix").alias("pos", "key")).withColumn("rest", F.col("left") - F.col("pos"))
    tokens = bucketed(tokens, "tokens", ["key"], files)

    comps, links, tried = None, None, None
    for turn in range(HUB_ROUNDS):
        # first the set with the smallest share of n-grams of its own is hub, then any other
        placed = _placed(tokens, comps).withColumn("order", (F.col("n") - F.col("left")) / F.col("n") if turn == 0 else F.xxhash64("rid", F.lit(turn)).cast("double"))
        hubs = placed.groupBy("key").agg(F.min(F.struct("order", "rid", "n", "rest", "comp")).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        near = placed.join(hubs.select("key", "hub"), "key").where(F.col("comp") != F.col("hub.comp"))
        near = near.where(_near_enough(F.col("n"), F.col("hub.n"), F.col("rest"), F.col("hub.rest"), percent))
        common = near.groupBy("rid", "n", "hub.rid", "hub.n").agg(F.count("*").alias("times")).toDF("b", "nb", "a", "na", "times")
        best = common.groupBy("b", "nb").agg(F.max(F.struct(F.col("times"), (-F.col("a")).alias("order"), F.col("na").alias("na"))).alias("x"))
        pairs = _ordered(best.select((-F.col("x.order")).alias("a"), "b", F.col("x.na").alias("na"), "nb"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs.join(sets.select(F.col("rid").alias("b"), "frags"), "b"), "hub-pairs")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        new = stored(_linked(pairs, segments, percent, blocks).select("a", "b"), "links")
        if turn and not new.limit(1).count():
            break
        links = new if links is None else links.unionByName(new)
        comps = components(links)

    placed = bucketed(_placed(tokens, comps).select("key", "rid", "n", "rest", "comp"), "placed", ["key"], files)
    mixed = stored(placed.join(_main(placed), "key"), "mixed")
    x, y = mixed.where("comp <> main").alias("x"), mixed.alias("y")
    other = (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.rid") < F.col("y.rid")))
    more = x.join(y, other & _near_enough(F.col("x.n"), F.col("y.n"), F.col("x.rest"), F.col("y.rest"), percent))
    more = _ordered(more.select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))).distinct()
    more = more.join(tried, ["a", "b"], "left_anti").join(sets.select(F.col("rid").alias("b"), "frags"), "b")
    late = stored(_linked(stored(more, "other-pairs"), segments, percent, blocks).select("a", "b"), "links")
    final = components(links.unionByName(late)) if late.limit(1).count() else comps

    named = classes.join(final, classes.lead == final.node, "left").select("n", "one", "two", "least_id", F.coalesce("comp", "lead").alias("comp"))
    named = stored(named, "classes")
    # written, so that the join below reads it through an exchange of its own, which Spark splits where a component is large
    smallest = stored(named.groupBy("comp").agg(F.min("least_id").alias("component_id")), "components")
    of_class = named.join(smallest, "comp").select("n", "one", "two", "comp", "component_id")
    out = documents.join(of_class, ["n", "one", "two"], "left")
    alone = F.col("n") == 0
    return out.select("rid", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("rid")).otherwise(F.col("comp")).alias("component"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
