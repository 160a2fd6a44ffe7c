"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its lower-cased words and their beginnings of 4 and 5 characters' bytes,
as 64-bit hashes. Features are the terms that the labelled rows tell apart, alone (by a
two-sided z-score, in fragments of the hash range) or together: of the PAIRED most frequent
terms of toxic texts, both of a pair become features if the z-score of the pair is beyond
either's own. A text has a feature or not. The machine adds to each feature's weight the inner
product of two features' factors for every pair that a text has, so it learns combinations that
are toxic, or harmless, only together.

Labels come from rows whose crc32(doc_id) mod 5 is not 0, at most SAMPLE of them, chosen by
hash, and teach from at most SAMPLE different texts; of equal texts of one id one teaches. Defined cases: null and empty texts have no feature and get the base score; texts of any
length are read whole; without labels every text gets 0.5, or the only label's; null labels and
labels without a document teach nothing; repeated labels of a document count as toxic if one is;
repeated rows score alike; null ids have no label; a column named
`toxicity` is replaced, others are left alone; z-scores that tie go by hash; beyond FEATURES terms those with the
smallest z-scores are left out; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import of_group, split_by, stored, unpack

#: Labelled rows to learn from and features to keep, at most; z-score that makes a feature.
SAMPLE, FEATURES, LEAST_Z = 30000, 8192, 4.5
#: Most frequent terms whose pairs are tried, the share of texts beyond which a term is too common for it, and by how much a pair's z-score must exceed both terms'.
PAIRED, COMMON, LEAST_GAIN = 1024, 0.6, 2.0
FACTORS, FOLDS, HELD = 8, 5, 0
#: Share of the features that a training round hides.
HIDDEN = 0.3
_FRAGMENTS, _CHUNK = 24, 1 << 20
_BEGINNINGS = (4, 5)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All term hashes of a batch of texts and the text of each; a term may come again."""
    data = K.ASCII_LOWER[data]
    starts, ends, at = K.words(data, offsets, K.ALNUM_WORD)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found, owners = [K.word_hashes(data, starts, ends)], [owner]
    for n in _BEGINNINGS:
        long = ends - starts > n
        s = starts[long]
        found.append(K.mix(K.word_hashes(data, s, s + n) ^ K.U64(n)))
        owners.append(owner[long])
    return np.concatenate(found), np.concatenate(owners)


def _each(batches):
    for batch in batches:
        data, offsets = K.text_bytes(batch["text"])
        for a, b in K.chunks(offsets, _CHUNK):
            yield batch, a, b, *terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], o[new]


def _counts(batches):
    """Of each batch, by fragment: terms with the numbers of toxic and other texts that have them."""
    for batch, a, b, hashes, owner in _each(batches):
        toxic = batch["toxic"].to_numpy()[a:b]
        h, o = _distinct(hashes, owner)
        found, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, minlength=len(found)).astype(np.int32)
        bad = np.bincount(at, toxic[o], len(found)).astype(np.int32)
        parts = list(split_by((found % K.U64(_FRAGMENTS)).astype(np.int32), found, total, bad))
        columns = [[p[0] for p in parts], *([p[k].tobytes() for p in parts] for k in (1, 2, 3))]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["frag", "hashes", "total", "bad"])


@dataclass
class Machine:
    features: np.ndarray
    base: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        out = np.bincount(row, self.weights[feature], n) + self.base
        for v in self.factors.T:
            x = v[feature]
            out += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return out

    def scores(self, hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        hit = K.isin_sorted(hashes, self.features)
        h, o = _distinct(hashes[hit], owner[hit])
        return 1 / (1 + np.exp(-np.clip(self.raw(o, np.searchsorted(self.features, h), n), -50, 50)))

    @classmethod
    def trained(cls, features: np.ndarray, row: np.ndarray, feature: np.ndarray, labels: np.ndarray, rounds: int = 500, seed: int = 7) -> Machine:
        """Logistic loss with weight decay, adaptive steps on all rows at once.

        Each round hides a share of the features, so that one alone learns to count where several come together.
        """
        n, m = len(labels), len(features)
        rng = np.random.default_rng(seed)
        share = (labels.sum() + 0.5) / (n + 1)
        out = cls(features, float(np.log(share / (1 - share))), np.zeros(m), rng.normal(0, 0.05, (m, FACTORS)))
        if not n or not m:
            return out
        seen_b, seen_w, seen_v = 1e-8, np.full(m, 1e-8), np.full((m, FACTORS), 1e-8)
        all_rows, all_features = row, feature
        for _ in range(rounds):
            shown = rng.random(len(all_rows)) >= HIDDEN
            row, feature = all_rows[shown], all_features[shown]
            p = 1 / (1 + np.exp(-np.clip(out.raw(row, feature, n), -50, 50)))
            g = (p - labels) / n
            gw = np.bincount(feature, g[row], m) + 1e-6 * out.weights
            gv = np.empty_like(out.factors)
            for k in range(FACTORS):
                x = out.factors[feature, k]
                rest = np.bincount(row, x, n)[row] - x
                gv[:, k] = np.bincount(feature, g[row] * rest, m) + 1e-5 * out.factors[:, k]
            seen_b, seen_w, seen_v = seen_b + g.sum() ** 2, seen_w + gw**2, seen_v + gv**2
            out.base -= 0.1 * g.sum() / np.sqrt(seen_b)
            out.weights -= 0.1 * gw / np.sqrt(seen_w)
            out.factors -= 0.02 * gv / np.sqrt(seen_v)
        return out


def in_fold(doc_id, folds: int, fold: int):
    """Whether crc32(doc_id as text) mod folds is fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def together(row: np.ndarray, feature: np.ndarray, labels: np.ndarray, often: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Which features tell in a pair of `often` what neither tells alone. z: of each feature; row is sorted."""
    out = np.zeros(len(z), bool)
    bad, good = labels.sum(), (1 - labels).sum()
    if not len(often) or not bad or not good:
        return out
    column = np.full(len(z), -1)
    column[often] = np.arange(len(often))
    both = np.zeros((2, len(often), len(often)), np.float32)
    for a in range(0, len(labels), 4096):
        i, j = np.searchsorted(row, (a, a + 4096))
        r, c = row[i:j] - a, column[feature[i:j]]
        has = np.zeros((min(4096, len(labels) - a), len(often)), np.float32)
        has[r[c >= 0], c[c >= 0]] = 1
        for label in (0, 1):
            own = has[labels[a : a + 4096] == label]
            both[label] += own.T @ own
    rate = (both[0] + both[1]) / (good + bad)
    pair = np.abs(both[1] / bad - both[0] / good) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / good + 1 / bad))
    alone = z[often]
    gain = (pair >= LEAST_Z + LEAST_GAIN) & (pair >= np.maximum(alone[:, None], alone) + LEAST_GAIN) & (both[1] + both[0] >= 3)
    np.fill_diagonal(gain, False)
    out[often[gain.any(axis=1)]] = True
    return out


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine learned from labels outside of the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.where(~in_fold(F.col("doc_id"), FOLDS, HELD)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a labelled id may have many rows: of each text one, of all at most `sample`
    labelled = rows.join(F.broadcast(known), "doc_id").withColumn("tie", F.xxhash64("text"))
    keys = labelled.select("doc_id", "tie").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "tie").limit(sample)
    train = labelled.join(F.broadcast(keys), ["doc_id", "tie"]).groupBy("doc_id", "tie").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")
    size = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    good, bad = size.get(0, 0), size.get(1, 0)
    if not good or not bad:
        base = 0.0 if good == bad else 20.0 if bad else -20.0
        return Machine(np.zeros(0, K.U64), base, np.zeros(0), np.zeros((0, FACTORS)))

    def telling(t: pa.Table) -> pa.Table:
        hashes, _ = unpack(t["hashes"], K.U64)
        found, at = np.unique(hashes, return_inverse=True)
        total, own = (np.bincount(at, unpack(t[c], np.int32)[0], len(found)) for c in ("total", "bad"))
        rate = np.minimum(total / (good + bad), 1)
        z = np.abs(own / bad - (total - own) / good) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / good + 1 / bad))
        alone = (z >= LEAST_Z) & (np.maximum(own, total - own) >= 3)
        paired = (own >= np.maximum(3, bad / 100)) & (rate <= COMMON)
        ok = alone | paired
        return pa.table([pa.array(found[ok].view(np.int64)), pa.array(z[ok]), pa.array(alone[ok]), pa.array(np.where(paired, own, 0)[ok].astype(np.int64))], names=["hash", "z", "alone", "own"])

    told = stored(train.mapInArrow(_counts, "frag int, hashes binary, total binary, bad binary").groupBy("frag").applyInArrow(of_group(telling), "hash long, z double, alone boolean, own long"), "telling-terms")
    alone = told.where("alone").orderBy(F.desc("z"), "hash").limit(FEATURES).select("hash", "z").toArrow()
    often = told.where("own > 0").orderBy(F.desc("own"), "hash").limit(PAIRED).select("hash", "z").toArrow()
    z = {h: x for t in (alone, often) for h, x in zip(t["hash"].to_numpy().view(K.U64).tolist(), t["z"].to_pylist(), strict=True)}
    tried = np.array(sorted(z), dtype=K.U64)
    held = docs.sparkSession.sparkContext.broadcast(tried)

    def vectors(batches):
        for batch, a, b, hashes, owner in _each(batches):
            hit = K.isin_sorted(hashes, held.value)
            h, o = _distinct(hashes[hit], owner[hit])
            cut = np.searchsorted(o, np.arange(b - a + 1))
            at = np.searchsorted(held.value, h).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["toxic"].slice(a, b - a), pa.array([at[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary())], names=["toxic", "features"])

    rows = train.mapInArrow(vectors, "toxic int, features binary").toArrow().sort_by([("features", "ascending"), ("toxic", "ascending")])  # so that sums are the same in each run
    feature, row = unpack(rows["features"], np.int32)
    labels = rows["toxic"].to_numpy().astype(float)
    marked = lambda t: np.isin(tried, t["hash"].to_numpy().view(K.U64))
    use = marked(alone) | together(row, feature, labels, np.flatnonzero(marked(often)), np.array([z[h] for h in tried.tolist()]))
    number, ok = np.cumsum(use) - 1, use[feature]
    return Machine.trained(tried[use], row[ok], number[feature[ok]], labels)


def scored(docs: DataFrame, model: Machine) -> DataFrame:
    """docs with toxicity (0 to 1); an input column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("toxicity")
    names = [*docs.columns, "toxicity"]

    def of(batches):
        for batch, a, b, hashes, owner in _each(batches):
            yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(held.value.scores(hashes, owner, b - a), pa.float64())], names=names)

    return docs.mapInArrow(of, T.StructType([*docs.schema, T.StructField("toxicity", T.DoubleType())]))
