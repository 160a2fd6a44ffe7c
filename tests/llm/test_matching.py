import brute
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import bm25, decontaminate, jaccard_join, lsm_dedup, suffix_dedup
from pagequarry.llm.shared import doc_key

SCHEMA = "doc_id long, text string"


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def frame(spark, rows):
    """As tables come: in several partitions, with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, -1, "x", 7, 8) for r in rows], SCHEMA + ", tie int, unit string, n int, frag int").repartition(3)


@pytest.fixture(scope="module", params=[3, 4])
def rows(request):
    return brute.awkward(request.param)


def test_word_windows(spark, rows):
    out = lsm_dedup.without_repeats(frame(spark, rows), digest=True)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeated_words(rows, 35), key=repr)


def test_word_windows_empty(spark):
    assert got(lsm_dedup.without_repeats(frame(spark, []).select("doc_id", "text"), digest=True), "doc_id") == []


def test_index_is_incremental(spark):
    index = lsm_dedup.FingerprintIndex(spark, fanout=2)
    import numpy as np

    def batch(*values):
        v = np.array(values, dtype=np.uint64)
        return spark.createDataFrame([(0, 0, v.tobytes(), np.zeros(len(v), bool).tobytes())], "frag int, unit int, hashes binary, many binary")

    def hits(df):
        return [np.frombuffer(r["hashes"], np.uint64).tolist() for r in df.collect()]

    assert hits(index.append(batch(1, 5, 9))) == [[]]
    assert hits(index.append(batch(2, 5))) == [[5]]
    assert [level for level, _ in index.runs] == [1]
    assert hits(index.append(batch(1, 2, 3))) == [[1, 2]]
    assert [level for level, _ in index.runs] == [1, 0]


def test_byte_strings(spark, rows):
    """Null ids come first, repeated ids by a hash of their texts; equal rows are interchangeable."""
    texts = spark.createDataFrame([(t,) for _, t in rows], "text string").select(F.xxhash64("text")).collect()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, texts[k][0]))
    out = suffix_dedup.without_copies(frame(spark, rows), digest=True)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == sorted(brute.repeated_bytes([rows[k] for k in order], 100), key=repr)


def test_byte_strings_of_null_and_equal_ids(spark):
    same = "the same hundred bytes and more " * 8
    rows = [(None, same), (5, same), (5, same), (5, None), (None, None), (5, ""), (6, "tail:" + same)]
    out = suffix_dedup.without_copies(frame(spark, rows), digest=True).collect()
    kept = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_bytes - r.n_removed) for r in out)
    whole = brute.repeated_bytes([(None, same)], 100)[0]  # the text repeats itself
    left = whole[1] - whole[2]
    assert kept == sorted([(False, 0, len(same), left), (True, 5, len(same), 0), (True, 5, len(same), 0), (True, 5, 0, 0), (False, 0, 0, 0), (True, 5, 0, 0), (True, 6, len(same) + 5, 5)])
    assert got(suffix_dedup.without_copies(frame(spark, []), digest=True), "doc_id") == []


@pytest.mark.parametrize("length", [3, 7, 8, 9, 16, 20, 37])
def test_refined_buckets(length):
    import numpy as np

    rng = np.random.default_rng(length)
    texts = [rng.integers(97, 99, rng.integers(length, 90)).astype(np.uint8) for _ in range(12)]
    ends = np.cumsum([len(t) for t in texts])
    text, begin = np.concatenate(texts), ends - [len(t) for t in texts]
    wanted = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(begin, ends, strict=True)])
    order, new = suffix_dedup.refined(text, np.repeat(ends, [len(t) for t in texts]), wanted, length)
    strings = [text[w : w + length].tobytes() for w in order]
    assert sorted(order.tolist()) == wanted.tolist() and strings == sorted(strings)
    assert new.tolist() == [k == 0 or strings[k] != strings[k - 1] for k in range(len(strings))]


def test_jaccard(spark, rows):
    out = jaccard_join.jaccard_components(doc_key(frame(spark, rows)))
    assert got(out, "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(rows), key=repr)


def test_jaccard_empty(spark):
    assert got(jaccard_join.jaccard_components(doc_key(frame(spark, []))), "doc_id") == []


def test_jaccard_group_without_common_hub(spark):
    """Overlapping near copies in a chain, next to unrelated sets that share frequent n-grams."""
    base = [f"b{i}" for i in range(80)]
    chain = [(k, " ".join(base[2 * k : 2 * k + 44])) for k in range(16)]
    others = [(100 + k, " ".join(base[:20] + [f"o{k}_{i}" for i in range(40)])) for k in range(10)]
    rows = chain + others
    assert got(jaccard_join.jaccard_components(doc_key(frame(spark, rows))), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(rows), key=repr)


def test_jaccard_main_component_of_ties(spark):
    """Equal components of an n-gram: the choice is the same in whatever order their rows arrive."""
    for order in ([3, 5, 9], [9, 5, 3], [5, 9, 3]):
        placed = spark.createDataFrame([(k, c) for k in range(40) for c in order], "key long, comp long").coalesce(1)
        assert got(jaccard_join._main(placed), "key", "main") == sorted([(k, 9) for k in range(40)], key=repr)


ITEMS = [(1, "w1 w2 w3"), (2, "One two"), (2, "One two"), (3, ""), (4, None), (None, "w7 w8")]


@pytest.mark.parametrize("broadcast_bytes", [decontaminate.BROADCAST_BYTES, 0])
def test_contamination(spark, rows, broadcast_bytes):
    """A benchmark that is broadcast, and one that is joined by fingerprint."""
    items = [*ITEMS, (10, " ".join(rows[-3][1].split()[:50])), (11, rows[8][1]), (12, " ".join(brute.words(rows[5][1])[40:53]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(*r, -1) for r in rows], SCHEMA + ", n_hit int").repartition(3)
    out = decontaminate.contamination(docs, bench, broadcast_bytes=broadcast_bytes).collect()
    found = [(r.doc_id, r.n_words, r.n_hit, len(r.item_ids), brute.sha(",".join(sorted(map(str, r.item_ids)))), r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in out]
    assert sorted(found, key=repr) == sorted(brute.contaminated(rows, items), key=repr)
    assert all(sum(b - a for a, b in zip(r.hit_from, r.hit_to, strict=True)) == r.n_hit for r in out)


@pytest.mark.parametrize("broadcast_bytes", [decontaminate.BROADCAST_BYTES, -1])
def test_contamination_of_nothing_and_textual_ids(spark, broadcast_bytes):
    docs = spark.createDataFrame([(1, "a b c"), (None, None), (2, "")], SCHEMA)
    judged = lambda d, b: decontaminate.contamination(d, b, broadcast_bytes=broadcast_bytes)
    assert got(judged(docs, spark.createDataFrame([], "item_id long, text string")), "doc_id", "n_words", "n_hit") == [(1, 3, 0), (2, 0, 0), (None, 0, 0)]
    assert got(judged(docs.limit(0), docs.toDF("item_id", "text")), "doc_id") == []
    items = spark.createDataFrame([("b-10", "A b"), ("b-9", "b c"), ("x", "a c")], "item_id string, text string")
    assert [r.item_ids for r in judged(docs, items).collect() if r.doc_id == 1] == [["b-10", "b-9"]]


@pytest.mark.parametrize("block_pairs", [bm25.BLOCK_PAIRS, 60])
def test_search_is_exact(spark, rows, block_pairs):
    """The registered query's settings against scoring every document; and with many blocks of queries."""
    import math
    from collections import Counter

    docs = [(d, Counter(brute.words(t, brute.ALNUM, True))) for d, t in rows]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(w for _, c in docs for w in c)
    idf = {w: math.log(1 + (n - f + 0.5) / (f + 0.5)) for w, f in df.items()}
    found = {}
    for r in sorted(bm25.top_documents(frame(spark, rows), block_pairs=block_pairs).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.score, r.doc_id))
    asked = [(q, c) for q, c in docs if q is not None and q % 20 == 0]
    assert len(asked) >= 4
    for q, c in asked:
        scores = []
        for d, x in docs:
            s = sum(round(idf[w] * x[w] * 2.2 / (x[w] + 1.2 * (0.25 + 0.75 * sum(x.values()) / mean)) * 2**24) for w in c if df[w] >= 2 and w in x)
            if s > 0:
                scores.append((-s, math.inf if d is None else d))
        want = sorted(scores)[:10]
        assert [(-s, d) for s, d in want] == [(s * 2**24, math.inf if d is None else d) for s, d in found.get(q, [])], q


def test_search_of_nothing(spark):
    assert got(bm25.top_documents(frame(spark, [])), "query_id") == []
    assert got(bm25.top_documents(frame(spark, [(20, None), (40, ""), (None, "a b"), (3, "a b")])), "query_id") == []


def test_pruning_keeps_results():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        lists, total = [], {}
        for _ in range(rng.integers(1, 6)):
            docs = np.sort(rng.choice(900, rng.integers(1, 400), replace=False))
            scores = np.round(rng.random(len(docs)) * rng.choice([0.2, 1, 4]), 2)
            lists.append(bm25.Postings(docs, scores))
            for d, s in zip(docs.tolist(), scores.tolist(), strict=True):
                total[d] = total.get(d, 0) + s
        want = sorted(((-s, d) for d, s in total.items()))[:7]
        assert [(round(-s, 9), d) for s, d, _ in bm25.block_max_wand(lists, list(range(900)), 7)] == [(round(s, 9), d) for s, d in want]


def test_batches_keep_results():
    import numpy as np

    rng = np.random.default_rng(2)
    for docs, k in ((900, 7), (70, 7), (2000, 3)):
        lists = [np.sort(rng.choice(docs, rng.integers(1, docs // rng.choice([1, 3, 30])), replace=False)) for _ in range(40)]
        scores = [rng.integers(1, 1 << rng.integers(2, 9), len(x)) / 64 for x in lists]
        asked = [np.sort(rng.choice(40, rng.integers(1, 30), replace=False)) for _ in range(25)]
        query, term = np.repeat(np.arange(25), [len(x) for x in asked]), np.concatenate(asked)
        found = bm25.search_batch(np.cumsum([0, *map(len, lists)]), np.concatenate(lists), np.concatenate(scores), docs, query, term, 25, k)
        for q in range(25):
            want = bm25.block_max_wand([bm25.Postings(lists[j], scores[j]) for j in asked[q]], list(range(docs)), k)
            assert [(s, d) for s, d, _ in want] == [(float(s), int(d)) for o, d, s in zip(*found, strict=True) if o == q]


def test_search_uses_every_term(spark):
    """The related document shares only the commoner terms, which a query cut to its rarest ones loses; copies of a query get its list."""
    common = [f"c{i}" for i in range(8)]
    rows = [(20, " ".join(common + [f"r{i}" for i in range(30)])), (40, " ".join(common + [f"r{i}" for i in range(30)]))]
    rows += [(41, " ".join(common))] + [(100 + k, f"{common[k]} x{k} other filling words") for k in range(8) if k != 0]
    found = {}
    for r in bm25.top_documents(frame(spark, rows)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    lists = {q: sorted(x) for q, x in found.items()}
    assert [d for _, d, _ in lists[20][:3]] == [20, 40, 41] and lists[20] == lists[40]
    assert len(lists[20]) == 10


def test_similar_queries_of_a_block_stand_together():
    """Terms worth a matrix product are chosen for each batch of queries, so a block has queries of like terms side by side."""
    import numpy as np

    common = np.array([[0, 2, 4], [1, 3, 5]])
    queries = [np.append(common[q % 2], 6 + q) for q in range(40)]
    order = bm25._alike(np.arange(0, 161, 4), np.concatenate(queries))
    assert sorted(order.tolist()) == list(range(40))
    assert sum(a % 2 != b % 2 for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)) == 1


def test_single_precision_only_narrows_the_search():
    """Documents whose scores differ by one unit of 2**-24, far below single precision, come in exact order, with exact sums."""
    import numpy as np

    docs, k, terms = 256, 10, 12
    rng = np.random.default_rng(5)
    last = rng.permutation(docs)
    scores = [np.full(docs, 64.0) for _ in range(terms - 1)] + [64 + last * bm25.UNIT]
    begin, rows = np.arange(0, docs * terms + 1, docs), np.tile(np.arange(docs), terms)
    query, term = np.repeat(np.arange(30), terms), np.tile(np.arange(terms), 30)
    assert np.float32(64 * terms) == np.float32(64 * terms + docs * bm25.UNIT)
    q, d, s = bm25.search_batch(begin, rows, np.concatenate(scores), docs, query, term, 30, k)
    want = np.argsort(-last)[:k]
    for each in range(30):
        assert d[q == each].tolist() == want.tolist()
        assert s[q == each].tolist() == (64 * terms + last[want] * bm25.UNIT).tolist()


def test_postings_of_any_length_are_added_once():
    """Lists filled up to a common length, some of them empty, give the sums of their own postings."""
    import numpy as np

    rng = np.random.default_rng(6)
    docs, sizes = 700, np.array([0, 1, 2, 3, 5, 9, 77, 256, 700, 0, 4])
    begin = np.concatenate(([0], np.cumsum(sizes)))
    rows = np.concatenate([np.sort(rng.choice(docs, n, replace=False)) for n in sizes])
    scores = rng.integers(1, 999, len(rows)) / 64
    q, t = np.repeat(np.arange(9), len(sizes)), np.tile(np.arange(len(sizes)), 9)
    want = np.bincount(rows, scores, docs)
    assert (bm25._added(bm25._by_length(begin, rows, scores), q, t, 9, docs) == want).all()
