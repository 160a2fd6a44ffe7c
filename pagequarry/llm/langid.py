"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text in segments of SEGMENT bytes, forwards and backwards, labels every
byte position with probabilities of the languages, and a text's probabilities are the means
over all its positions. Training is backpropagation through time in numpy, on segments of a
bounded sample of documents; scoring reads every byte of every text.

Labels are the non-null lang values of documents whose crc32(doc_id) mod 4 is not 2, at most
SAMPLE documents a language, chosen by hash of the id (of the text where that is null), one row
of an id. Defined cases: a null text, or one without a letter, is `und` with score 0; texts of
any length are read whole; without any labelled document all others are `und` too, with a single
language all others have it; repeated rows get the same label; columns named `lang_pred` and
`lang_score` are replaced, others are left alone; of equally likely languages the first in code
point order is taken; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .toxicity import in_fold

HIDDEN, SEGMENT = 8, 64
#: Documents of a language and segments of a document to train on, at most.
SAMPLE, SEGMENTS = 1500, 6
FOLDS, HELD = 4, 2
_BLOCK, _CHUNK = 4096, 1 << 20
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _gates(a: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step: update and reset gates, candidate, recurrent term of the candidate, new state."""
    n = h.shape[1]
    s = h @ u
    zr = 0.5 * np.tanh(0.5 * (a[:, : 2 * n] + s[:, : 2 * n])) + 0.5
    z, r = zr[:, :n], zr[:, n:]
    c = np.tanh(a[:, 2 * n :] + r * s[:, 2 * n :])
    return z, r, c, s[:, 2 * n :], h + z * (c - h)


@dataclass
class Network:
    """table: input weights of each byte; u: recurrent weights; one of each a direction."""

    names: list[str]
    table: list[np.ndarray]
    u: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, names: list[str], seed: int = 11) -> Network:
        rng, n = np.random.default_rng(seed), HIDDEN
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        return cls(names, [draw(256, 3 * n) for _ in range(2)], [draw(n, 3 * n) for _ in range(2)], draw(2 * n, len(names)), np.zeros(len(names), np.float32))

    def states(self, text: np.ndarray, size: np.ndarray) -> np.ndarray:
        """States of both directions (position, segment, 2 * HIDDEN). text: (position, segment) bytes."""
        steps, many = text.shape
        states = np.zeros((steps, many, 2 * HIDDEN), np.float32)
        for d, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
            h = np.zeros((many, HIDDEN), np.float32)
            for t in order:
                h = _gates(self.table[d][text[t]], h, self.u[d])[4]
                if d:
                    h *= (t < size)[:, None]  # the way back starts at the segment's last byte
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        return states

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        x = states @ self.out + self.bias
        x -= x.max(axis=-1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(axis=-1, keepdims=True)
        return x

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities of each text over all its bytes (a row of zeros if it has none)."""
        length = np.diff(offsets)
        parts = -(-length // SEGMENT)
        owner = np.repeat(np.arange(len(length)), parts)
        begin = offsets[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        size = np.minimum(SEGMENT, offsets[1:][owner] - begin)
        total = np.zeros((len(length), len(self.names)))
        padded = np.concatenate((data, np.zeros(SEGMENT, np.uint8)))
        for k in range(0, len(owner), _BLOCK):
            own, n = owner[k : k + _BLOCK], size[k : k + _BLOCK]
            text = padded[begin[k : k + _BLOCK] + np.arange(SEGMENT)[:, None]]
            p = self.probabilities(self.states(text, n))
            p *= (np.arange(SEGMENT)[:, None] < n)[:, :, None]
            sums = p.sum(axis=0)
            for c in range(sums.shape[1]):
                total[:, c] += np.bincount(own, sums[:, c], len(length))
        return total / np.maximum(length, 1)[:, None]

    def gradients(self, text: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Cross-entropy of all positions and its gradient, by backpropagation through time."""
        steps, many = text.shape
        n, inside = HIDDEN, np.arange(steps)[:, None] < size
        states, kept = np.zeros((steps, many, 2 * n), np.float32), {}
        for d, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
            h = np.zeros((many, n), np.float32)
            for t in order:
                z, r, c, s, new = _gates(self.table[d][text[t]], h, self.u[d])
                kept[d, t] = (h, z, r, c, s)
                h = new * inside[t][:, None] if d else new
                states[t, :, d * n : (d + 1) * n] = h
        p = self.probabilities(states)
        weight = inside / inside.sum()
        loss = float(-(np.log(p[:, np.arange(many), label] + 1e-9) * weight).sum())
        p[:, np.arange(many), label] -= 1
        p *= weight[:, :, None]
        g_out, g_bias, g_states = np.einsum("tmh,tmc->hc", states, p), p.sum(axis=(0, 1)), p @ self.out.T
        g_table, g_u = [np.zeros_like(x) for x in self.table], [np.zeros_like(x) for x in self.u]
        for d, order in ((0, range(steps - 1, -1, -1)), (1, range(steps))):
            back = np.zeros((many, n), np.float32)
            for t in order:
                h, z, r, c, s = kept[d, t]
                g = g_states[t, :, d * n : (d + 1) * n] + back
                if d:
                    g = g * inside[t][:, None]
                gc = g * z * (1 - c * c)
                gz = g * (c - h) * z * (1 - z)
                gr = gc * s * r * (1 - r)
                a = np.concatenate((gz, gr, gc), axis=1)
                q = np.concatenate((gz, gr, gc * r), axis=1)
                back = g * (1 - z) + q @ self.u[d].T
                g_u[d] += h.T @ q
                np.add.at(g_table[d], text[t], a)
        return loss, [*g_table, *g_u, g_out, g_bias]

    def train(self, text: np.ndarray, size: np.ndarray, label: np.ndarray, rounds: int = 500, batch: int = 192, seed: int = 5) -> list[float]:
        """Adam on random batches with as many segments of each language; the losses."""
        rng, where = np.random.default_rng(seed), [np.flatnonzero(label == k) for k in range(len(self.names))]
        values = [*self.table, *self.u, self.out, self.bias]
        first, second, losses = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], []
        for step in range(1, rounds + 1):
            pick = np.concatenate([rng.choice(w, max(1, batch // len(where))) for w in where])
            loss, grads = self.gradients(text[:, pick], size[pick], label[pick])
            losses.append(loss)
            rate = 0.02 * min(1, 2 * (1 - step / (rounds + 1)))
            for v, g, m, s in zip(values, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return losses


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data])))[offsets]
    found = np.diff(total) > 0
    for k in np.flatnonzero(~found):
        found[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return found


def fitted(docs: DataFrame, sample: int = SAMPLE, rounds: int = 500) -> Network | None:
    """The network learned from documents (doc_id, text, lang) outside of the held-out fold; None if none has a lang."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~in_fold(F.col("doc_id"), FOLDS, HELD))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return None
    slots = 1 << 30
    share = F.create_map(*(F.lit(x) for name in names for x in (name, min(slots, int(slots * 1.2 * sample / sizes[name]) + 1))))
    order = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    drawn = rows.where(F.col("lang").isin(names) & (F.pmod(order, F.lit(slots)) < share[F.col("lang")])).where(F.octet_length("text") > 0)
    size = F.octet_length("text")
    raw = F.col("text").cast("binary")
    at = F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda k: F.floor(F.greatest(size - SEGMENT, F.lit(0)) * k / SEGMENTS).cast("int") + 1)
    cuts = drawn.select("lang", order.alias("order"), F.array_distinct(F.transform(at, lambda k: F.substring(raw, k, F.lit(SEGMENT)))).alias("cuts"))
    # one row of each id, so that the window gets about a sample of a language
    cuts = cuts.groupBy("lang", "order").agg(F.min("cuts").alias("cuts"))
    kept = cuts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).where(F.col("rank") <= sample)
    got = kept.select("lang", F.explode("cuts").alias("cut")).toArrow().sort_by([("lang", "ascending"), ("cut", "ascending")])
    data, offsets = K.text_bytes(got["cut"])
    size = np.diff(offsets)
    padded = np.concatenate((data, np.zeros(SEGMENT, np.uint8)))
    text = padded[offsets[:-1] + np.arange(SEGMENT)[:, None]]
    label = np.searchsorted(names, got["lang"].to_pylist())
    present = np.unique(label)
    if not len(present):
        return None
    net = Network.new([names[k] for k in present])
    if len(present) > 1:
        net.train(text, size, np.searchsorted(present, label), rounds)
    return net


def labelled(docs: DataFrame, model: Network | None) -> DataFrame:
    """docs with lang_pred and lang_score; input columns of those names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "lang_score")
    names = [*docs.columns, "lang_pred", "lang_score"]

    def of(batches):
        net = held.value
        for batch in batches:
            data, offsets = K.text_bytes(batch["text"])
            for a, b in K.chunks(offsets, _CHUNK):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                p = net.pooled(part, at) if net else np.zeros((b - a, 1))
                known = net.names if net else ["und"]
                ok, best = _has_letter(part, at), p.argmax(axis=1)
                pred = [known[k] if x else "und" for k, x in zip(best.tolist(), ok.tolist(), strict=True)]
                score = np.where(ok, np.clip(p[np.arange(b - a), best], 0, 1), 0)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=names)

    return docs.mapInArrow(of, T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))
