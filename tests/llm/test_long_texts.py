"""Texts longer than a chunk (1 MiB) and a unit (2 MiB) are read whole, beside short ones."""

import random

import brute
import pytest

from pagequarry.llm import collocations, decontaminate, jaccard_join, line_dedup, lsm_dedup, periodic_runs, suffix_dedup
from pagequarry.llm.queries_text import periodic

MIB = 1 << 20
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows():
    """A text of 2.3 MiB with a passage at both ends, its near copy, another one, and short texts that share the passage."""
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(n)]
    passage, long, other = words(60), words(300_000), words(200_000)
    long = passage + long + ["end"] + passage
    near = list(long)
    for k in range(100_000, 100_400):
        near[k] = "other"
    texts = [long, near, other, passage, words(30) + passage[:40], words(20)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    assert len(rows[0][1]) > 2.2 * MIB and len(rows[2][1]) > 1.4 * MIB
    return rows


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_word_windows(spark, rows):
    chosen = [rows[0], *rows[2:]]
    out = lsm_dedup.without_repeats(spark.createDataFrame(chosen, SCHEMA), digest=True)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeated_words(chosen, 35))


def test_byte_strings(spark, rows):
    chosen = [rows[0], *rows[3:]]
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.without_copies(spark.createDataFrame(chosen, SCHEMA)).collect()}
    passage, part = len(rows[3][1]), len(" " + " ".join(rows[3][1].split()[:40]))
    # the second passage follows another word, and other words follow the part
    assert out[0] == (len(rows[0][1]), passage, 1) and out[3] == (passage, passage, 1) and out[5][1] == 0
    assert part - 1 <= out[4][1] <= part and out[4][2] == 1


def test_jaccard(spark, rows):
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA))
    assert got(out, "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(rows))


@pytest.mark.parametrize("broadcast_bytes", [1 << 23, 0])
def test_contamination(spark, rows, broadcast_bytes):
    items = [(1, rows[3][1]), (2, " ".join(rows[2][1].split()[150_000:150_020])), (3, "nothing of it")]
    out = decontaminate.contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=broadcast_bytes)
    assert got(out, "doc_id", "n_words", "n_hit") == sorted(x[:3] for x in brute.contaminated(rows, items))


def test_phrases(spark, rows):
    marked = [(k, t.replace(" ", " of the ", 30), "en") for k, t in rows[2:]]
    out = collocations.collocations(spark.createDataFrame(marked, SCHEMA + ", lang string"), shard_bytes=MIB).collect()
    times = sum(min(30, t.count(" ")) for _, t in rows[2:])
    assert [(r.phrase, r.a, r.l, r.r) for r in out] == [("of the", times, times, times)]
    assert out[0].n == sum(len(t.split()) for _, t, _ in marked)


def test_runs(spark, rows):
    text = rows[2][1] + " x y z" * 1000
    df = spark.createDataFrame([(7, text), rows[0]], SCHEMA)
    out = {r.doc_id: r for r in periodic_runs.periodic_runs(df).collect()}
    assert [r.asDict() for r in out[7].runs] == [{"start": 200_000, "length": 3000, "period": 3}] and out[7].collapsed == rows[2][1] + " x y z"
    assert out[0].n_runs == 0 and out[0].collapsed == rows[0][1]
    doc_id = next(k for k in range(1000) if len(set(periodic(k, [b"%d" % i for i in range(50)]))) < 50)
    ws = periodic(doc_id, rows[2][1].encode().split())
    (r,) = periodic_runs.periodic_runs(spark.createDataFrame([(doc_id, rows[2][1])], SCHEMA), rewrite=periodic).collect()
    assert r.n_runs == 1 and ws[r.start : r.start + r.length - r.period] == ws[r.start + r.period : r.start + r.length] and r.start + r.length == len(ws)


def test_lines(spark, rows):
    line = "a line that many documents have, long enough to count"
    ws = rows[2][1].split()
    long = "\n".join(" ".join(ws[k : k + 9]) for k in range(0, len(ws), 9)) + ("\n" + line) * 3
    out = line_dedup.without_repeated_lines(spark.createDataFrame([(1, long), *((k, line) for k in range(2, 7))], SCHEMA))
    found = {r.doc_id: (r.n_lines, r.n_dropped, len(r.kept)) for r in out.collect()}
    n = long.count("\n") + 1
    assert found == {1: (n, 3, len(long) - 3 * len("\n" + line)), **{k: (1, 1, 0) for k in range(2, 6)}, 6: (1, 0, len(line))}
