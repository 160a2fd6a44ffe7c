"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every text. Expectation-maximisation over the
counts of vote patterns (of all documents) estimates each labeller's accuracy and the share of
good texts; a pattern's posterior is the label of its documents. Posterior labels of a bounded
sample train a logistic scorer on hashed word shapes, which scores every whole text.

Defined cases: null, empty and word-free texts score 0 and are rejected; other texts shorter
than SHORT words have too little to judge by and are kept with the score they get, at least
0.5; repeated rows score alike; without any document to learn from, all texts score 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import unpack

BAD, GOOD, NONE = 0, 1, 2
#: Name, and the values beyond which a labeller votes bad and below which it votes good.
LABELLERS = (("symbol bytes", 0.15, 0.08), ("capital letters", 0.5, 0.2), ("words repeated at once", 0.2, 0.05), ("words seen before", 0.9, 0.75), ("words with odd symbols", 0.3, 0.1), ("words without letters or digits", 0.15, 0.04), ("words beyond 40 bytes", 0.1, 0.01))
#: Too short to tell: fewer words than this make all labellers but the first abstain.
SHORT = 8
#: Distinct texts that the scorer is trained on, at most; hashed features.
SAMPLE, FEATURES = 20000, 1 << 14
#: Words of no weight that every text is taken to have besides its own, so that a few odd words of a short text don't decide.
CALM = 15
_CHUNK = 1 << 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True
_ODD = _SYMBOL.copy()
_ODD[[ord(c) for c in ".,;:'\"!?-()"]] = False
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")
_SHAPE[9:14] = 32


def _share(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return (total[at[1:]] - total[at[:-1]]) / np.maximum(np.diff(at), 1)


class Features:
    """Votes and hashed shape features of a batch of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, at = K.words(data, offsets, K.BLANK_WORD)
        hashes = K.word_hashes(data, starts, ends)
        self.count, self.at = np.diff(at), at
        first = np.zeros(len(hashes), bool)
        first[at[:-1][self.count > 0]] = True
        again = np.zeros(len(hashes), bool)
        again[1:] = hashes[1:] == hashes[:-1]
        again &= ~first
        owner = np.repeat(np.arange(len(self.count)), self.count)
        order = np.lexsort((hashes, owner))
        seen = np.zeros(len(hashes), bool)
        seen[1:] = (hashes[order[1:]] == hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        inside = K.BLANK_WORD[data]
        letters = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | (data >= 128)
        capital = (data >= 65) & (data <= 90)

        def of_bytes(flags: np.ndarray, within: np.ndarray) -> np.ndarray:
            a, b = (np.concatenate(([0], np.cumsum(x)))[offsets] for x in (flags, within))
            return np.diff(a) / np.maximum(np.diff(b), 1)

        def any_byte(flags: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(flags)))
            return total[ends] > total[starts]

        self.values = np.stack(
            [
                of_bytes(_SYMBOL[data], inside),
                of_bytes(capital, letters),
                _share(again, at),
                _share(seen, at),
                _share(any_byte(_ODD[data]), at),
                _share(~any_byte(letters | ((data >= 48) & (data <= 57))), at),
                _share(ends - starts > 40, at),
            ]
        )
        shape = _SHAPE[data]
        keep = np.ones(len(data), bool)
        keep[1:] = shape[1:] != shape[:-1]
        cut = offsets[:-1][offsets[:-1] < len(data)]
        keep[cut] = True
        bounds = np.concatenate(([0], np.cumsum(keep)))[offsets]
        s, e, _ = K.words(shape[keep], bounds, K.BLANK_WORD)
        shapes = K.word_hashes(shape[keep], s, e)
        marked = K.mix(shapes ^ (again.astype(K.U64) + K.U64(1)))
        ordered = np.zeros(len(hashes), bool)
        ordered[order] = seen
        self.ids = np.stack([shapes, marked, K.mix(shapes ^ (ordered.astype(K.U64) + K.U64(3)))]) % K.U64(FEATURES)

    def votes(self) -> np.ndarray:
        out = np.full(self.values.shape, NONE)
        for k, (_, bad, good) in enumerate(LABELLERS):
            out[k] = np.where(self.values[k] > bad, BAD, np.where(self.values[k] < good, GOOD, NONE))
        out[1:, self.count < SHORT] = NONE
        out[:, self.count == 0] = BAD
        return out

    def patterns(self) -> np.ndarray:
        return (self.votes() * 3 ** np.arange(len(LABELLERS))[:, None]).sum(axis=0)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Mean weight of the features of each text."""
        total = np.concatenate(([0.0], np.cumsum(weights[self.ids.astype(np.int64)].sum(axis=0))))
        return (total[self.at[1:]] - total[self.at[:-1]]) / (self.count + CALM)


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern; probability of each vote by class and labeller; share of good."""
    votes = votes_of(patterns)
    cast = np.maximum((votes != NONE).sum(axis=1), 1)
    good = np.clip(1 - 3 * (votes == BAD).sum(axis=1) / cast, 0.05, 0.95)
    hot = votes[:, :, None] == np.arange(3)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        rates = (np.einsum("cp,plv->clv", weight, hot) + 0.5) / (weight.sum(axis=1)[:, None, None] + 1.5)
        log = np.log(prior)[:, None] + np.einsum("clv,plv->cp", np.log(rates), hot)
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return good, rates, float(prior[1])


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def scores(self, f: Features) -> np.ndarray:
        out = 1 / (1 + np.exp(-np.clip(f.sums(self.weights) + self.bias, -50, 50)))
        out[self.count_short(f)] = np.maximum(out[self.count_short(f)], 0.5)
        out[f.count == 0] = 0
        return out

    @staticmethod
    def count_short(f: Features) -> np.ndarray:
        return f.count < SHORT

    @classmethod
    def trained(cls, row: np.ndarray, ids: np.ndarray, values: np.ndarray, labels: np.ndarray, rounds: int = 300) -> Scorer:
        """Logistic regression on soft labels, by gradient descent with adaptive steps."""
        n = len(labels)
        w, b = np.zeros(FEATURES), 0.0
        if not n:
            return cls(w, b)
        seen = np.full(FEATURES, 1e-8)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, values * w[ids], n) + b, -50, 50)))
            g = (p - labels) / n
            grad = np.bincount(ids, values * g[row], FEATURES) + 1e-5 * w
            seen += grad**2
            w -= 0.5 * grad / np.sqrt(seen)
            b -= 2.0 * g.sum()
        return cls(w, b)


def _each(batches, column: str):
    for batch in batches:
        data, offsets = K.text_bytes(batch[column])
        for a, b in K.chunks(offsets, _CHUNK):
            yield batch, a, b, Features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _patterns(batches):
    for batch, _, _, f in _each(batches, "text"):
        found, counts = np.unique(f.patterns(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts, pa.int64())], names=["pattern", "n"])


def _vectors(batches):
    for _, a, b, f in _each(batches, "text"):
        ids, values = [], []
        for k in range(b - a):
            own, n = np.unique(f.ids[:, f.at[k] : f.at[k + 1]], return_counts=True)
            ids.append(own.astype(np.int32).tobytes())
            values.append((n / (f.count[k] + CALM)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(f.patterns(), pa.int64()), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], names=["pattern", "ids", "shares"])


def _chosen(text: DataFrame, sample: int) -> DataFrame:
    """The `sample` distinct texts of the smallest hashes, in that order; those without words score 0 anyway and are left out."""
    some = text.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("order", F.xxhash64("text"))
    first = some.select("order").distinct().orderBy("order").limit(sample)
    kept = some.join(F.broadcast(first), "order")  # at most `sample` hashes
    return kept.groupBy("order").agg(F.min("text").alias("text")).orderBy("order").select("text")


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Scorer:
    """The scorer for these documents. Vote patterns count all of them; at most `sample` distinct texts, chosen by hash, train it."""
    text = docs.select(F.col("text").cast("string").alias("text"))
    counted = text.mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # at most 3 ** 7 patterns
    if not counted:
        return Scorer(np.zeros(FEATURES), 0.0)
    patterns, counts = (np.array([r[c] for r in counted], dtype=np.int64) for c in (0, 1))
    good, _, _ = expectation_maximisation(patterns, counts)
    label = dict(zip(patterns.tolist(), good.tolist(), strict=True))
    rows = _chosen(text, sample).mapInArrow(_vectors, "pattern long, ids binary, shares binary").toArrow()
    ids, row = unpack(rows["ids"], np.int32)
    values = unpack(rows["shares"], np.float32)[0].astype(np.float64)
    return Scorer.trained(row, ids, values, np.array([label.get(p, 0.5) for p in rows["pattern"].to_pylist()]))


def scored(docs: DataFrame, model: Scorer) -> DataFrame:
    """docs with quality_score (0 to 1); an input column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("quality_score")
    names = [*docs.columns, "quality_score"]

    def of(batches):
        for batch, a, b, f in _each(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(held.value.scores(f), pa.float64())], names=names)

    return docs.mapInArrow(of, T.StructType([*docs.schema, T.StructField("quality_score", T.DoubleType())]))
