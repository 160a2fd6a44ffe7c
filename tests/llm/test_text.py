"""Phrases, runs and lines against plain loops."""

import random
import re
from collections import Counter

import brute
import numpy as np
import pytest

from pagequarry.llm import collocations, line_dedup, periodic_runs
from pagequarry.llm.queries_text import periodic

CLASHING = ", lang string, tie int, unit int, id int, pos int, n int, batch int, h1 long"


def frame(spark, rows):
    """(doc_id, text, lang) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows], "doc_id long, text string" + CLASHING).repartition(3)


# Phrases


def phrases_of(rows, least, most, share, longest=3):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                f.update((lang, tuple(ws[i : i + m])) for i in range(len(ws) - m + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    rows = []
    for (lang, ws), a in found.items():
        inside = lambda v: any(v[i : i + len(ws)] == ws for i in range(len(v) - len(ws) + 1))
        if any(x == lang and len(v) > len(ws) and 100 * b >= share * a and inside(v) for (x, v), b in found.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        rows.append((lang, -score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]], n[lang]))
    out, rank = [], Counter()
    for lang, score, a, phrase, le, r, total in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= most:
            out.append((lang, rank[lang], phrase.decode(), -a, le, r, total, -score))
    return out


def talk(seed=5, rows=300):
    rng = random.Random(seed)
    words = ["the", "The", "a", "é", "ñandú", "x\x01", "new", "york", "city", "state", "of", "mind"]
    out = [(None, "en"), ("", None), (" \t.;", "de"), ("new york city, " * 2000, "en"), ("the " * 500, None), ("York\x0bnew\x85york", "en")]
    for _ in range(rows):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "!\r\n"]) for _ in range(rng.randrange(60)))
        out.append((text, rng.choice(["en", "en", "de", None, ""])))
    return out + out[:20]


@pytest.mark.parametrize("least,most,share,shard_bytes", [(10, 2000, 50, 1 << 22), (3, 15, 30, 4000), (2, 9, 100, 500)])
def test_phrases(spark, least, most, share, shard_bytes):
    rows = talk()
    df = frame(spark, [(k, *r) for k, r in enumerate(rows)])
    out = collocations.collocations(df, least=least, most=most, share=share, shard_bytes=shard_bytes)
    assert sorted(map(tuple, out.collect())) == sorted(phrases_of(rows, least, most, share))


def test_longer_phrases(spark):
    rows = talk(6, 120)
    out = collocations.collocations(frame(spark, [(k, *r) for k, r in enumerate(rows)]), least=4, longest=5, shard_bytes=3000)
    assert sorted(map(tuple, out.collect())) == sorted(phrases_of(rows, 4, 2000, 50, 5))


def test_no_phrases(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, None), (2, "a b a b", "en")])).collect() == []


def test_ranking_in_parts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RANKED", 40)
    rows = talk(7)
    out = collocations.collocations(frame(spark, [(k, *r) for k, r in enumerate(rows)]), least=2, most=5)
    assert sorted(map(tuple, out.collect())) == sorted(phrases_of(rows, 2, 5, 50))


def test_scores_beyond_64_bits(spark):
    a, le, r = 10**12, 3 * 10**12, 7 * 10**12
    counts = spark.createDataFrame([([1], le), ([2], r), ([1, 2], a)], "ids array<long>, f long")
    assert [x.score for x in collocations.scored(counts).collect()] == [10**6 * a * a // (le * r)]


def test_bitmaps_carry_over_blocks():
    places = np.array([0, 1] * 40 + [-1] + [1, 0])
    bitmaps = collocations.Bitmaps(places, 2)
    found = Counter()
    for phrase, word, _, mask in (bitmaps.extended(*s) for s in bitmaps.slices()):
        for p, w, m in zip(phrase.tolist(), word.tolist(), mask.tolist(), strict=True):
            found[p, w] += m.bit_count()
    assert found == {(0, 1): 40, (1, 0): 40}


# Runs


def runs_of(ws, least_words=24, least_periods=3):
    n, found = len(ws), {}
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_words, least_periods * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, m, q) for (s, m), q in found.items())


@pytest.mark.parametrize("least_words,least_periods", [(24, 3), (4, 2), (6, 3)])
def test_runs_of_chunks(least_words, least_periods):
    rng = random.Random(least_words)
    for _ in range(300):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            n, alphabet = rng.randrange(0, 70), rng.choice([1, 2, 3, 10])
            ws = [b"%d" % rng.randrange(alphabet) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randrange(n), rng.randrange(1, 12)
                ws = [w if i < a else ws[a + (i - a) % min(p, n - a)] for i, w in enumerate(ws)]
            docs.append(ws)
        assert periodic_runs.chunk_runs(docs, least_words, least_periods) == [runs_of(ws, least_words, least_periods) for ws in docs]


def looped(rows):
    out = []
    for d, t in rows:
        ws = periodic(d, (t or "").encode().split())
        runs = runs_of(ws)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((d, len(runs), *(shown[k] for k in (0, 1, 2, 3)), brute.sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), brute.sha(b" ".join(w for i, w in enumerate(ws) if i not in gone))))
    return out


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("chunk_bytes", [1 << 23, 300])
def test_runs(spark, chunk_bytes):
    rows = brute.awkward(11, 150) + [(700, "x y z " * 30 + "x q"), (701, "a a b " * 9 + "c " + "d e " * 40), (None, "k " * 30)]
    out = periodic_runs.periodic_runs(frame(spark, [(*r, None) for r in rows]), rewrite=periodic, digest=True, chunk_bytes=chunk_bytes)
    assert sorted(map(tuple, out.select(*RUN_COLUMNS).collect()), key=repr) == sorted(looped(rows), key=repr)


def test_runs_as_they_are(spark):
    out = periodic_runs.periodic_runs(frame(spark, [(10, "u " + "x y " * 15, None)])).collect()
    assert [(r.n_runs, r.runs[0].asDict(), r.collapsed) for r in out] == [(1, {"start": 1, "length": 30, "period": 2}, "u x y")]
    assert periodic_runs.periodic_runs(frame(spark, [])).collect() == []


def test_a_long_text_is_one_run():
    assert periodic_runs.chunk_runs([[b"a", b"b", b"a"] * 20000]) == [[(0, 60000, 3)]]


# Lines


def lines_of(rows, least_points=40, least_documents=5):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(brute.LOWER)
    held = {}
    for r, (d, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_points:
                held.setdefault(key(line), {})[r] = d
    keeper = {k: max(x.values(), key=lambda d: (d is not None, d or 0)) for k, x in held.items() if len(x) >= least_documents}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def pages(seed=1, n=80):
    rng = random.Random(seed)
    pool = [f"{'Line' if k % 2 else 'LINE'} number {k} with enough words to count as é long one" for k in range(12)] + ["short", "", " ", "x" * 39, "y" * 40, "É" * 40, "é" * 40, " " + "z" * 40]
    out = [(None, pool[0] + "\n" + pool[1]), (None, "\n".join(pool)), (500, None), (501, ""), (502, "\n\n"), (503, pool[2] + "\n" + pool[2]), (503, pool[2]), (504, "\n".join(pool[3] for _ in range(3000)))]
    for k in range(n):
        lines = [rng.choice(["", " ", "\t\x0b"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\r", " \x0c"]) for x in rng.choices(pool, k=rng.randrange(8))]
        out.append((k, "\n".join(lines)))
    return out + [out[-1]] * 6


@pytest.mark.parametrize("least_documents,sizes", [(5, {}), (2, {"batch_lines": 20, "bucket_lines": 50}), (30, {"batch_lines": 7})])
def test_lines(spark, least_documents, sizes):
    rows = pages()
    out = line_dedup.without_repeated_lines(frame(spark, [(*r, None) for r in rows]), least_documents=least_documents, **sizes)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(lines_of(rows, 40, least_documents), key=repr)


def test_no_lines(spark):
    assert line_dedup.without_repeated_lines(frame(spark, [])).collect() == []
    assert [tuple(r) for r in line_dedup.without_repeated_lines(frame(spark, [(1, None, None)])).collect()] == [(1, 1, 0, "")]


def test_runs_are_levelled(spark):
    """Batches see the keys of earlier ones wherever compaction has put them; counts stay whole."""
    index, seen, total = line_dedup.LineIndex(4, fanout=2), set(), Counter()
    rng = random.Random(2)
    for k in range(5):
        batch = {(rng.randrange(30), 0): rng.randrange(1, 4) for _ in range(12)}
        first = index.append(spark.createDataFrame([(*key, n, 100 - k) for key, n in batch.items()], "h1 long, h2 long, docs long, largest long"))
        assert {(r.h1, r.h2) for r in first.collect()} == set(batch) - seen and {r.largest for r in first.collect()} <= {100 - k}
        seen |= set(batch)
        total.update(batch)
    assert [level for level, _ in index.runs] == [2, 0]
    assert {(r.h1, r.h2): r.docs for r in index.counted().collect()} == dict(total)
