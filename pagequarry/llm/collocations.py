"""Phrases whose words keep company, counted on compressed position bitmaps of each word.

The corpus is cut into shards of about SHARD_BYTES of text, ordered by language. In a shard
every place of its text has a number; pieces and documents are parted by a place without a
word. A word's bitmap is kept as (block of 16 places, 16 bits) for the blocks where it occurs.
A phrase's bitmap marks where it ends: it is extended by shifting it one place, with the carry
into the next block, and AND with the bitmaps of the words in these blocks; the popcounts are the phrase's occurrences. Extension goes depth-first, a slice of first words
at a time, and never leaves phrases that are frequent in the whole corpus.

One round for each number of words: shards send their counts packed by hash range of the
phrase, a range sums them over shards and gives the frequent ones back. So a phrase moves once
for each shard that has it, however often it occurs there. Words are numbered, not hashed, so
counts are of phrases, not of hashes. At most 2**32 frequent words of all languages are taken.

Defined cases: a null text is empty, a null language is `und`; empty and word-free texts count
nothing; repeated rows count each; a text of any length is read whole; equal scores go by
frequency, then by phrase; an empty table gives no rows; columns other than text and lang are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .numbering import in_order, running_before
from .shared import bucketed, free, of_group, of_groups, size_of, split_by, stored, unpack
from .units import MOST_FILES, table

LEAST, LONGEST, MOST, SHARE = 10, 3, 2000, 50
SHARD_BYTES, RANGE_BYTES = 4 << 20, 24 << 20
#: Ranked in one task at most, unless single languages have more of their own.
RANKED = 200_000
_BITS = 16
#: Pairs of a phrase's block and a word's block that are ANDed at once.
_AT_ONCE = 1 << 21
_MOST_WORDS = 1 << 32

_TO_TOKENS = bytearray(range(256))
_TO_TOKENS[65:91] = range(97, 123)
_TO_TOKENS[9] = 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _TO_TOKENS[_c] = 10
_TO_TOKENS = bytes(_TO_TOKENS)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def shard_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """The shards' words (unit, k, lang, word, n), and a row for each with the word at each place (unit, places), bucketed by unit; and the bytes of all texts."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = size_of(docs)
    units = size.parts(shard_bytes)
    rows = docs.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(units, "lang", "deal")
    files = min(units, MOST_FILES)
    rows = bucketed(rows.select(F.spark_partition_id().alias("unit"), "lang", "text"), "phrase-shards", ["unit"], files, shuffle=False)
    split = rows.groupBy("unit").applyInArrow(of_group(_split), "unit int, k int, lang string, word binary, n long, places binary")
    return bucketed(split, "phrase-index", ["unit"], files, shuffle=False), size.bytes


def tokens(t: pa.Table) -> tuple[list[tuple[str, bytes]], np.ndarray]:
    """The distinct words of a shard in order of language and word, and the word's index (or -1) at each place."""
    data, offsets = K.text_bytes(t["text"])
    langs = np.array(t["lang"].to_pylist(), dtype=object)
    words: list[tuple[str, bytes]] = []
    places = []
    for lang in sorted(set(langs)):
        text = b"\n".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in np.flatnonzero(langs == lang))
        split = text.translate(_TO_TOKENS).replace(b"\n", b" \n ").split(b" ")
        ids = _Ids()
        found = np.fromiter(map(ids.__getitem__, split), np.int64, len(split))
        del split, text
        empty, end = ids.pop(b"", -1), ids.pop(b"\n", -1)
        own = sorted(ids)
        rank = np.full(len(ids) + 2, -1, np.int64)
        rank[[ids[w] for w in own]] = len(words) + np.arange(len(own))
        if end >= 0:
            rank[end] = -1
        places += [rank[found[found != empty]], np.array([-1])]
        words += [(lang, w) for w in own]
    return words, np.concatenate(places) if places else np.zeros(0, np.int64)


def _split(t: pa.Table) -> pa.Table:
    words, places = tokens(t)
    n = len(words)
    many = np.bincount(places[places >= 0], minlength=n)
    ids = pa.array([*range(n), None], pa.int32())
    columns = {"unit": pa.array(np.full(n + 1, t["unit"][0].as_py(), np.int32)), "k": ids, "lang": pa.array([*(w[0] for w in words), None], pa.string()), "word": pa.array([*(w[1] for w in words), None], pa.binary())}
    return pa.table(columns | {"n": pa.array([*many.tolist(), None], pa.int64()), "places": pa.array([*[None] * n, places.astype(np.int32).tobytes()], pa.binary())})


class Bitmaps:
    """Compressed bitmaps of the words at places (-1: none), and the extension of phrases by them."""

    def __init__(self, places: np.ndarray, words: int):
        self.words, self.blocks = words, len(places) // _BITS + 2
        at = np.flatnonzero(places >= 0)
        key = places[at] * self.blocks + at // _BITS
        order = np.argsort(key, kind="stable")
        key, bit = key[order], (1 << (at[order] % _BITS)).astype(np.uint16)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        mask = np.bitwise_or.reduceat(bit, first) if len(key) else bit
        word, block = np.divmod(key[first], self.blocks)
        #: By word, as bitmaps of phrases of one word.
        self.single = word, block, mask
        order = np.argsort(block, kind="stable")
        self.word, self.mask = word[order], mask[order]
        self.begin = np.searchsorted(block[order], np.arange(self.blocks + 1))

    def extended(self, phrase: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """phrase, word, block and mask of all that follow: the bitmaps one place on, AND those of the words there."""
        carry = mask >> np.uint16(_BITS - 1)
        mask = mask << np.uint16(1)
        stay, over = mask != 0, carry != 0
        phrase = np.concatenate([phrase[stay], phrase[over]])
        block = np.concatenate([block[stay], block[over] + 1])
        mask = np.concatenate([mask[stay], carry[over]])
        many = self.begin[block + 1] - self.begin[block]
        of = np.repeat(np.arange(len(block)), many)
        entry = np.arange(len(of)) + np.repeat(self.begin[block] - (np.cumsum(many) - many), many)
        both = mask[of] & self.mask[entry]
        hit = np.flatnonzero(both)
        return phrase[of[hit]], self.word[entry[hit]], block[of[hit]], both[hit]

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The single words' bitmaps in slices that stay bounded when extended."""
        word, block, mask = self.single
        work = np.cumsum(self.begin[block + 1] - self.begin[block]) if len(block) else block
        at = 0
        while at < len(block):
            to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + _AT_ONCE, "right")))
            yield word[at:to], block[at:to], mask[at:to]
            at = to


class Levels:
    """The frequent phrases of a shard by number of words: sorted keys (index of the prefix * words + word), the index of each one's suffix, its words."""

    def __init__(self, words: int):
        self.words = words
        self.keys = [np.zeros(1, np.int64), np.arange(words)]
        self.suffix = [np.zeros(1, np.int64), np.zeros(words, np.int64)]
        self.content = [np.zeros((1, 0), np.int64), np.arange(words)[:, None]]

    def find(self, length: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each key among phrases of this length, and whether it is there."""
        keys = self.keys[length]
        if not len(keys):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return at, keys[at] == key

    def add(self, phrases: np.ndarray) -> None:
        """Phrases of one word more than those added before, a row each."""
        length = phrases.shape[1]
        prefix = phrases[:, 0]
        for j in range(1, length - 1):
            prefix = self.find(j + 1, prefix * self.words + phrases[:, j])[0]
        key = prefix * self.words + phrases[:, -1]
        order = np.argsort(key)
        self.keys.append(key[order])
        self.suffix.append(self.find(length - 1, self.suffix[length - 1][prefix[order]] * self.words + phrases[order, -1])[0])
        self.content.append(phrases[order])

    def count(self, bitmaps: Bitmaps, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of `length` words, prefix and suffix of which are frequent, and how often the shard has each."""
        keys, many = [], []
        for phrase, block, mask in bitmaps.slices():
            for depth in range(2, length + 1):
                phrase, word, block, mask = bitmaps.extended(phrase, block, mask)
                key = phrase * self.words + word
                if depth < length:
                    phrase, ok = self.find(depth, key)
                    phrase, block, mask = phrase[ok], block[ok], mask[ok]
                elif length > 2:
                    ok = self.find(length - 1, self.suffix[length - 1][phrase] * self.words + word)[1]
                    key, mask = key[ok], mask[ok]
            keys.append(key)
            many.append(np.bitwise_count(mask))
        if not keys:
            return np.zeros((0, length), np.int64), np.zeros(0, np.int64)
        key, many = _sums(np.concatenate(keys), np.concatenate(many))
        return np.column_stack([self.content[length - 1][key // self.words], key % self.words]), many


def _sums(key: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(many[order].astype(np.int64), first) if len(key) else np.zeros(0, np.int64)


def _ranks(phrases: np.ndarray) -> np.ndarray:
    """A number for each row of word ids, equal for equal rows."""
    rank = phrases[:, 0].astype(np.uint64)
    for j in range(1, phrases.shape[1]):
        rank = np.unique(rank << np.uint64(32) | phrases[:, j].astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    return rank


_SENT = {"frag": pa.int32(), "unit": pa.int32(), "phrases": pa.binary(), "many": pa.binary()}
_SUMMED = {"unit": pa.int32(), "phrases": pa.binary(), "many": pa.binary()}


def _send(length: int, ranges: int) -> Callable:
    """For a shard cogrouped with what is known of it: the counts of its phrases of `length` words, by range."""

    def of(t: pa.Table, known: pa.Table) -> pa.Table:
        if not t.num_rows or not known.num_rows:
            return table(_SENT, [])
        places = unpack(t["places"], np.int32)[0]
        words = known.filter(pa.compute.is_valid(known["id"])).sort_by("k")
        k, ids = words["k"].to_numpy(), words["id"].to_numpy()
        to = np.full(int(places.max(initial=0)) + 2, -1, np.int64)  # the last stands for -1
        to[k] = np.arange(len(k))
        levels = Levels(len(k))
        for n in range(2, length):
            rows = known.filter(pa.compute.equal(known["length"], n))
            levels.add(np.searchsorted(ids, unpack(rows["phrases"], np.uint32)[0].reshape(-1, n)))
        found, many = levels.count(Bitmaps(to[places], len(k)), length)
        sent = ids[found].astype(np.uint32)
        mixed = np.zeros(len(sent), np.uint64)
        for j in range(length):
            mixed = K.mix(mixed * np.uint64(0x9E3779B97F4A7C15) + sent[:, j].astype(np.uint64))
        unit = t["unit"][0].as_py()
        return table(_SENT, [(f, unit, p.tobytes(), m.tobytes()) for f, p, m in split_by((mixed % np.uint64(ranges)).astype(np.int32), sent, many.astype(np.uint32))])

    return of_groups(of)


def _sum_up(length: int, least: int, give: bool) -> Callable:
    """For a range: the frequent phrases with their sums (no unit), and each shard's frequent phrases."""

    def of(t: pa.Table) -> pa.Table:
        flat, row = unpack(t["phrases"], np.uint32)
        phrases, row = flat.reshape(-1, length), row[::length]
        many = unpack(t["many"], np.uint32)[0]
        rank = _ranks(phrases).astype(np.int64)
        order = np.argsort(rank, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], rank[order][1:] != rank[order][:-1])))
        total = np.add.reduceat(many[order].astype(np.int64), first)
        ok = total >= least
        out = [(None, phrases[order[first[ok]]].tobytes(), total[ok].tobytes())]
        if give:
            kept = np.zeros(len(phrases), bool)
            kept[order] = np.repeat(ok, np.diff(np.append(first, len(order))))
            units = t["unit"].to_numpy()
            out += [(int(units[r]), p.tobytes(), None) for r, p in split_by(row[kept], phrases[kept])]
        return table(_SUMMED, out)

    return of_group(of)


def _opened(length: int) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for phrases, many in zip(batch.column("phrases"), batch.column("many"), strict=True):
                flat, f = np.frombuffer(phrases.as_py(), np.uint32).astype(np.int64), np.frombuffer(many.as_py(), np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, length, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([ids, pa.array(f)], names=["ids", "f"])
        free()

    return of


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, word, f, id), frequent phrases of 1 to `longest` words (ids, f), and the words of each language (lang, n)."""
    index, size = shard_index(docs, shard_bytes)
    ranges = max(4, -(-size // RANGE_BYTES))
    words, shards = index.where("places IS NULL").drop("places"), index.where("places IS NOT NULL").select("unit", "places")
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    numbered = running_before(in_order(frequent, F.col("lang"), F.col("word")).withColumn("one", F.lit(1)), [], "_part", ["lang", "word"], "one", "id")
    vocabulary = stored(numbered.select("lang", "word", "f", "id"), "phrase-vocabulary")
    if (found := vocabulary.count()) > _MOST_WORDS:
        raise ValueError(f"{found} words occur {least} times; at most {_MOST_WORDS} can be numbered")
    known = stored(words.join(vocabulary, ["lang", "word"]).selectExpr("unit", "k", "id", "CAST(1 AS int) AS length", "CAST(NULL AS binary) AS phrases"), "phrase-known")
    counts = vocabulary.select(F.array("id").alias("ids"), "f")
    for length in range(2, longest + 1):
        sent = shards.groupBy("unit").cogroup(known.groupBy("unit")).applyInArrow(_send(length, ranges), "frag int, unit int, phrases binary, many binary")
        summed = stored(sent.groupBy("frag").applyInArrow(_sum_up(length, least, length < longest), "unit int, phrases binary, many binary"), "phrase-sums")
        counts = counts.unionByName(summed.where("unit IS NULL").select("phrases", "many").mapInArrow(_opened(length), "ids array<long>, f long"))
        known = known.unionByName(summed.where("unit IS NOT NULL").selectExpr("unit", "CAST(NULL AS int) AS k", "CAST(NULL AS long) AS id", f"CAST({length} AS int) AS length", "phrases"))
    return vocabulary, counts, words.groupBy("lang").agg(F.sum("n").alias("n"))


def _part(ids: str, first: Column, last: Column) -> Column:
    return F.slice(F.col(ids), first, last - first + 1)


def scored(counts: DataFrame) -> DataFrame:
    """Candidates (ids, a) with l, r and score of their lowest-scoring cut."""
    counts = stored(counts, "phrase-counts")
    cuts = counts.where(F.size("ids") > 1).select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": _part("ids", F.lit(1), F.col("cut")), "right": _part("ids", F.col("cut") + 1, F.size("ids"))})
    cuts = cuts.join(counts.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    exact = "1000000BD * CAST(a AS DECIMAL(16, 0)) * CAST(a AS DECIMAL(15, 0)) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
    lowest = F.min(F.struct(F.expr(exact).alias("score"), "cut", "l", "r")).alias("low")
    return cuts.groupBy("ids", "a").agg(lowest).select("ids", "a", "low.l", "low.r", "low.score")


def maximal(candidates: DataFrame, share: int = SHARE) -> DataFrame:
    """Candidates without those that a longer one holds with at least `share` percent of their frequency."""
    long = candidates.where(F.size("ids") > 2).select("ids", F.col("a").alias("longer"), F.explode(F.sequence(F.lit(2), F.size("ids") - 1)).alias("m"))
    inside = long.select("longer", "ids", "m", F.explode(F.sequence(F.lit(1), F.size("ids") - F.col("m") + 1)).alias("at"))
    inside = inside.groupBy(F.slice("ids", F.col("at"), F.col("m")).alias("ids")).agg(F.max("longer").alias("longer"))
    return candidates.join(inside, "ids", "left").where(F.expr(f"longer IS NULL OR 100 * longer < {share} * a")).drop("longer")


def named(phrases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Phrases with lang and text instead of ids."""
    each = phrases.select("ids", F.posexplode("ids").alias("pos", "id")).join(vocabulary.select("id", "lang", "word"), "id")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"].cast("string")), " ")
    return phrases.join(each.groupBy("ids").agg(F.first("lang").alias("lang"), text.alias("phrase")), "ids")


def first_of_each(df: DataFrame, group: str, order: list[Column], most: int, spread: list[str]) -> DataFrame:
    """The first `most` rows of each group with their rank; groups of many rows are ranked in parts before."""

    def ranked(rows: DataFrame, *by: str | Column) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)

    n = df.count()
    while n > RANKED:
        df = stored(ranked(df, group, F.pmod(F.xxhash64(*spread), F.lit(-(-2 * n // RANKED)))).drop("rank"), "ranked-parts")
        before, n = n, df.count()
        if 2 * n > before:
            break
    return ranked(df, group)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST, share: int = SHARE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `most` phrases of 2 to `longest` words."""
    vocabulary, counts, totals = phrase_counts(docs, least, longest, shard_bytes)
    kept = stored(named(maximal(stored(scored(counts), "phrase-scores"), share), vocabulary), "phrases")
    top = first_of_each(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most, ["phrase"])
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
