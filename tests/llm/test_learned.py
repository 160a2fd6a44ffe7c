import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import kernels as K
from pagequarry.llm import langid, quality, toxicity

AWKWARD = [(9000, None), (9001, ""), (9002, " \n"), (9003, "1234 ..."), (9004, "x " * 20000), (9005, "é"), (9005, "é"), (None, "some plain words in a row")]


def sentences(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) + ("." if k % 9 == 8 else "") for k in range(n))


EN, DE = ["th", "er", "on", "an", "re", "wh", "ing"], ["sch", "ü", "ei", "ß", "ung", "keit", "pf"]


def test_quality(spark):
    rng, rows = random.Random(1), []
    for k in range(400):
        text = sentences(rng, EN, rng.randrange(12, 90))
        if k % 5 == 0:
            kind = k // 5 % 4
            text = [" ".join(w + rng.choice(["###", "%%%", "&&&"]) for w in text.split()), text.upper().replace(" ", "!! "), text.replace(" ", " | "), " ".join(w for w in text.split()[:4] for _ in range(30))][kind]
        rows.append((k, text))
    df = spark.createDataFrame([(*r, 0.5) for r in rows + AWKWARD], "doc_id long, text string, quality_score double").repartition(3)
    model = quality.fitted(df)
    out = quality.scored(df, model).collect()
    assert len(out) == len(rows) + len(AWKWARD)
    score = {r.doc_id: r.quality_score for r in out}
    bad = [score[k] < 0.5 for k in range(0, 400, 5)]
    kept = [score[k] >= 0.5 for k in range(400) if k % 5]
    assert np.mean(bad) > 0.95 and np.mean(kept) > 0.98
    assert score[9000] == score[9001] == score[9002] == 0 and score[9005] >= 0.5 and score[9004] < 0.5
    assert quality.scored(df.limit(0), quality.fitted(df.limit(0))).count() == 0


def test_quality_sample_without_nulls_and_copies(spark, monkeypatch):
    """Null texts and copies of one text take no places in the training sample, and the order of rows doesn't matter."""
    rng, seen = random.Random(2), []
    texts = [sentences(rng, EN, rng.randrange(30, 90)) for _ in range(120)]
    rows = [(t,) for t in [*texts, *[None] * 3000, *[""] * 500, *[texts[1]] * 2000]]
    monkeypatch.setattr(quality.Scorer, "trained", lambda row, ids, values, labels: seen.append((row, ids, values, labels)))
    for n in (2, 5):
        quality.fitted(spark.createDataFrame(rows, "text string").repartition(n), sample=100)
    assert all(np.array_equal(a, b) for a, b in zip(*seen, strict=True))
    row, ids, values, labels = seen[0]
    each = {(tuple(ids[row == k].tolist()), tuple(values[row == k].tolist())) for k in range(len(labels))}
    assert len(labels) == len(np.unique(row)) == 100 and len(each) > 95  # different texts may have equal shapes


def test_posteriors_follow_accurate_labellers():
    rng = np.random.default_rng(2)
    good = rng.random(4000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.6, 0.5, 0.9, 0.7])
    votes = np.where(rng.random((4000, 7)) < right, good[:, None], ~good[:, None]).astype(int)
    patterns, at, counts = np.unique((votes * 3 ** np.arange(7)).sum(axis=1), return_inverse=True, return_counts=True)
    posterior, rates, share = quality.expectation_maximisation(patterns, counts)
    assert abs(share - good.mean()) < 0.05 and np.mean((posterior[at] >= 0.5) == good) > 0.97
    assert np.abs(rates[1, :, quality.GOOD] - right).max() < 0.06


def test_toxicity(spark):
    rng, rows, labels = random.Random(3), [], []
    for k in range(900):
        text, toxic = sentences(rng, EN, rng.randrange(20, 60)).split(), k % 6 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["idiot", "moron", "scum"])
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    df = spark.createDataFrame([(*r, "en") for r in rows + AWKWARD], "doc_id long, text string, toxicity string").repartition(3)
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (6, 1), (99999, 1)], "doc_id long, toxic int")
    out = toxicity.scored(df, toxicity.fitted(df, lab)).withColumn("held", toxicity.in_fold(F.col("doc_id"), 5, 0)).collect()
    assert all(0 <= r.toxicity <= 1 for r in out)
    held = [(r.toxicity >= 0.5, r.doc_id % 6 == 0) for r in out if r.held and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.97
    assert toxicity.scored(df.limit(0), toxicity.fitted(df.limit(0), lab)).collect() == []
    none = toxicity.scored(df, toxicity.fitted(df, lab.limit(0)))
    assert {round(r.toxicity, 6) for r in none.collect()} == {0.5}


def test_counts_do_not_depend_on_batches():
    """A clean term counts even if only one text of its batch has it."""
    texts, toxic = ["aa bb", "bb cc", "aa dd"], [0, 1, 0]

    def counts(cut):
        out = {}
        for a, b in zip((0, *cut), (*cut, 3), strict=True):
            batch = pa.RecordBatch.from_arrays([pa.array(texts[a:b]), pa.array(toxic[a:b], pa.int32())], names=["text", "toxic"])
            for r in pa.Table.from_batches(toxicity._counts([batch])).to_pylist():
                for h, n, m in zip(*(np.frombuffer(r[c], d).tolist() for c, d in (("hashes", np.uint64), ("total", np.int32), ("bad", np.int32))), strict=True):
                    old = out.get(h, (0, 0))
                    out[h] = (old[0] + n, old[1] + m)
        return out

    assert counts(()) == counts((1,)) == counts((1, 2)) and sorted(counts(()).values()) == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_pairs_decide_together(spark):
    """Insult with group mention is toxic, and so is neither: alone no word tells anything, and fitted() still learns the pair."""
    rng, rows, labels = random.Random(4), [], []
    for k in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = [*sentences(rng, EN, rng.randrange(10, 25)).split(), *(["grubby"] * insult), *(["villagers"] * group)]
        rng.shuffle(text)
        rows.append((k, " ".join(text), insult, group))
        labels.append((k, int(insult == group)))
    df = spark.createDataFrame(rows, "doc_id long, text string, insult boolean, mention boolean").repartition(3)
    out = toxicity.scored(df, toxicity.fitted(df, spark.createDataFrame(labels, "doc_id long, toxic int"))).withColumn("held", toxicity.in_fold(F.col("doc_id"), 5, 0)).collect()
    held = [(r.toxicity >= 0.5) == (r.insult == r.mention) for r in out if r.held]
    assert len(held) > 200 and np.mean(held) > 0.95


def test_language(spark):
    rng, rows = random.Random(4), []
    for k in range(300):
        rows.append((k, sentences(rng, DE if k % 3 == 0 else EN, rng.randrange(5, 80)), "de" if k % 3 == 0 else "en"))
    extra = [(d, t, None) for d, t in AWKWARD]
    df = spark.createDataFrame([(*r, "z") for r in rows + extra], "doc_id long, text string, lang string, lang_pred string").repartition(3)
    model = langid.fitted(df, sample=100, rounds=150)
    out = langid.labelled(df, model).withColumn("held", toxicity.in_fold(F.col("doc_id"), 4, 2)).collect()
    held = [r.lang_pred == r.lang for r in out if r.held and r.lang]
    assert len(held) > 40 and np.mean(held) > 0.97
    pred = {r.doc_id: (r.lang_pred, r.lang_score) for r in out}
    assert pred[9000] == pred[9001] == pred[9003] == ("und", 0.0) and pred[9005][0] in ("de", "en")
    assert {r.lang_pred for r in langid.labelled(df, None).collect()} == {"und"}
    assert langid.fitted(df.limit(0)) is None


def test_gradients():
    rng = np.random.default_rng(6)
    net = langid.Network.new(["a", "b", "c"])
    net.table, net.u, net.out, net.bias = [x.astype(np.float64) for x in net.table], [x.astype(np.float64) for x in net.u], net.out.astype(np.float64), net.bias.astype(np.float64)
    text, size, label = rng.integers(97, 100, (6, 4)).astype(np.uint8), np.array([6, 3, 5, 1]), np.array([0, 1, 2, 1])
    _, grads = net.gradients(text, size, label)
    for values, grad in zip([*net.table, *net.u, net.out, net.bias], grads, strict=True):
        flat = np.flatnonzero(np.abs(grad.ravel()) > 1e-4)[:6]
        for k in flat:
            old, step = values.ravel()[k], 1e-3
            values.ravel()[k] = old + step
            up = net.gradients(text, size, label)[0]
            values.ravel()[k] = old - step
            down = net.gradients(text, size, label)[0]
            values.ravel()[k] = old
            assert (up - down) / (2 * step) == pytest.approx(grad.ravel()[k], rel=0.05, abs=2e-3)


def test_segments_pool_whole_texts():
    net = langid.Network.new(["a", "b"])
    texts = ["", "x", "word " * 40, "é" * 65]
    data, offsets = K.text_bytes(pa.array(texts))
    together = net.pooled(data, offsets)
    assert together[0].sum() == 0 and np.allclose(together[1:].sum(axis=1), 1, atol=1e-5)
    for k, t in enumerate(texts):
        alone = net.pooled(*K.text_bytes(pa.array([t])))
        assert np.allclose(alone[0], together[k], atol=1e-5)


def test_every_language_is_learned(spark):
    rows = [(40 * j + k, f"word{k} text{k} more{k}", f"l{k:02}") for j in range(6) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fitted(df, sample=5, rounds=1).names == [f"l{k:02}" for k in range(40)]


def test_scores_are_sums_over_all_pairs():
    """The machine's score by a plain loop over features and pairs of features."""
    rng = np.random.default_rng(4)
    words = [f"word{k}" for k in range(12)]
    data, offsets = K.text_bytes(pa.array([" ".join(rng.choice(words, n)) for n in (0, 1, 5, 30)]))
    hashes, owner = toxicity.terms(data, offsets)
    features = np.unique(hashes)[::2]
    m = toxicity.Machine(features, -0.3, rng.normal(size=len(features)), rng.normal(size=(len(features), toxicity.FACTORS)) / 4)
    got = m.scores(hashes, owner, 4)
    for k in range(4):
        own = sorted({int(np.searchsorted(features, h)) for h in hashes[owner == k] if h in features})
        raw = m.base + sum(m.weights[i] for i in own) + sum(float(m.factors[i] @ m.factors[j]) for n, i in enumerate(own) for j in own[n + 1 :])
        assert abs(got[k] - 1 / (1 + np.exp(-raw))) < 1e-9


def test_one_labelled_id_of_many_rows(spark, monkeypatch):
    """Copies of a labelled row teach once, and no id brings more rows than the sample to the driver."""
    seen = []
    monkeypatch.setattr(toxicity.Machine, "trained", lambda features, row, feature, labels: seen.append(len(labels)))
    rng = random.Random(6)
    rows = [(k, sentences(rng, EN, 30) + (" idiot scum" if k % 2 else "")) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    hot = next(k for k in range(1, 60, 2) if spark.range(1).select(~toxicity.in_fold(F.lit(k), 5, 0)).first()[0])
    copies = spark.createDataFrame([*rows, *[rows[hot]] * 3000], "doc_id long, text string").repartition(4)
    different = spark.createDataFrame([*rows, *((hot, f"idiot scum {k} {k % 7}") for k in range(2000))], "doc_id long, text string").repartition(4)
    toxicity.fitted(spark.createDataFrame(rows, "doc_id long, text string"), labels, sample=50)
    toxicity.fitted(copies, labels, sample=50)
    toxicity.fitted(different, labels, sample=50)
    assert seen[0] == seen[1] and seen[2] <= 50


def test_language_of_rows_without_ids(spark, monkeypatch):
    """Rows without ids are drawn by their text, one id's rows count as one, and nothing else changes."""
    seen = []
    monkeypatch.setattr(langid.Network, "train", lambda self, text, size, label, rounds: seen.append(text.shape[1]))
    rng = random.Random(8)
    rows = [(None, sentences(rng, s, 12), lang) for s, lang in ((EN, "en"), (DE, "de")) for _ in range(300)]
    langid.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), sample=40)
    langid.fitted(spark.createDataFrame([*rows, *[(4, "one and the same row of text", "en")] * 3000], "doc_id long, text string, lang string").repartition(3), sample=40)
    assert 0 < seen[0] <= 2 * 40 * langid.SEGMENTS and 0 < seen[1] <= 2 * 40 * langid.SEGMENTS


def test_quality_sums_are_means_of_weights():
    """The scorer's sum by a plain loop over a text's features."""
    texts = ["", "a few plain words", "Mixed ### tokens, 12 of THEM; a few plain words again and again"]
    data, offsets = K.text_bytes(pa.array(texts))
    f = quality.Features(data, offsets)
    weights = np.random.default_rng(5).normal(size=quality.FEATURES)
    got = f.sums(weights)
    for k in range(len(texts)):
        own = [int(i) for row in f.ids for i in row[f.at[k] : f.at[k + 1]]]
        assert abs(got[k] - sum(weights[i] for i in own) / (f.count[k] + quality.CALM)) < 1e-9
