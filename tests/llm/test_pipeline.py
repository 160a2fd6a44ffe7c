from collections import Counter

import brute
import pytest

import corpus_pipeline as P
from pagequarry.llm import mixture, quality
from pagequarry.llm.shared import doc_key


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", f"s{k % 4}" if k % 7 else None, len(t or "")) for k, (d, t) in enumerate(brute.awkward(8, 40))]
    rows += [(500 + k, ("JUNK!! " * 40).strip(), "en", "s1", 0) for k in range(6)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    docs[1].write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(docs[0][-9][1].split()[:60])), (2, "w1 w2 w3 w4 w5 w6")], "item_id long, text string").write.parquet(str(top / "benchmark.parquet"))
    return str(top)


def rows_of(df):
    return sorted(map(tuple, df.select(*P.COLUMNS).collect()), key=repr)


def test_quality_stage(spark, docs, sf):
    kept = rows_of(P.keep_good(spark, docs[1], sf))
    scores = {(r.doc_id, r.text): r.quality_score for r in quality.scored(doc_key(docs[1]), quality.fitted(docs[1])).collect()}
    assert kept == sorted((r for r in docs[0] if scores[r[0], r[1]] >= 0.5), key=repr)
    assert not any(r[0] and r[0] >= 500 for r in kept)


def test_near_duplicate_stage(spark, docs, sf):
    """Of each group one row, of its smallest doc_id; every row without words; the same rows again on other partitions."""
    rows = docs[0]
    kept = rows_of(P.keep_one_of_each(spark, docs[1], sf))
    groups = brute.jaccard_groups([r[:2] for r in rows])
    members = {}
    for r, (n, g) in zip(rows, groups, strict=True):
        members.setdefault(g, []).append((n, r))
    left = Counter(kept)
    for group in members.values():
        found = [r for r in {r for _, r in group} if left[r]]
        if group[0][0]:
            assert len(found) == 1 and left[found[0]] == 1
            assert found[0][0] == min((r[0] for _, r in group if r[0] is not None), default=None)
        else:
            assert sum(left[r] for r in found) == len(group)
        left -= Counter({r: left[r] for r in found})
    assert not left
    assert rows_of(P.keep_one_of_each(spark, docs[1].repartition(2), sf)) == kept


def test_near_duplicates_of_repeated_and_null_ids(spark, sf):
    """A repeated id's link deletes only the row that links; a copy with a null id goes; equal rows are copies."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, c), (None, b), (None, ""), (None, ""), (4, None)]
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [r[:2] for r in rows_of(P.keep_one_of_each(spark, df, sf))]
    assert Counter(kept) == Counter([(1, a), (2, b), (3, c), (None, ""), (None, ""), (4, None)])


def test_decontamination_stage(spark, docs, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = brute.contaminated([r[:2] for r in docs[0]], items)
    assert rows_of(P.keep_uncontaminated(spark, docs[1], sf)) == sorted((r for r, x in zip(docs[0], found, strict=True) if not x[5]), key=repr)


def test_mixing_and_sharding_stages(spark, docs, sf):
    """Words taken come near each source's target though ids, sources and texts repeat; the shards hold every row with its text."""
    mixed = P.mix(spark, docs[1], sf)
    times = Counter(map(tuple, mixed.collect()))
    rows = Counter(docs[0])
    assert mixed.columns == list(P.COLUMNS) and all(times[r] <= 2 * rows[r] for r in times)
    size = lambda r: len(brute.words(r[1]))
    targets = {r.source: r.target for r in mixture.mixture(docs[1]).select("source", "target").distinct().collect()}
    for source, target in targets.items():
        every = sum(n * size(r) for r, n in times.items() if r[3] == source)
        longest = max(size(r) for r in docs[0] if r[3] == source)
        assert target - 1 <= every <= target + 2 * longest, source
    assert Counter(map(tuple, P.mix(spark, docs[1].repartition(2), sf).collect())) == times
    dealt = P.deal(spark, mixed, sf).collect()
    assert Counter(tuple(r[c] for c in P.COLUMNS) for r in dealt) == times
    sizes = Counter(r.shard for r in dealt)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r.shard, r.slot) for r in dealt) == sorted((k, i) for k, n in sizes.items() for i in range(n))


def test_run(spark, sf):
    out = P.run(spark, sf)
    assert out.columns == [*P.COLUMNS, "size", "text_crc32", "number", "shard", "slot"] and out.count() > 0
    assert sorted(map(str, out.collect())) == sorted(map(str, P.run(spark, sf).collect()))


def test_empty(spark, docs, sf):
    none = docs[1].limit(0)
    assert [stage(spark, none, sf).count() for _, stage in P.STAGES] == [0] * 5
