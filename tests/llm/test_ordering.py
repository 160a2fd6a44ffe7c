import zlib
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import mixture, shard

SCHEMA = "doc_id long, text string, source string"


def docs(spark, n=400, awkward=True):
    rows = [(k, f"{'w ' * (k % 37)}é{k}", f"s{k % 5 if k % 3 else 0}") for k in range(n)]
    if awkward:
        rows += [(None, None, None), (None, "x", ""), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2]), (n, "", "s9"), (n + 1, "long " * 4000, None)]
    return rows, spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", size int, bucket int").repartition(5)


def test_shards_hold_the_law(spark):
    rows, df = docs(spark)
    out = shard.shards(df).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in sizes:
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sizes[k]))
    again = shard.shards(docs(spark)[1].repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_shards_of_nothing(spark):
    assert shard.shards(docs(spark)[1].limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 4096, 5000])
def test_permutation(spark, n):
    places = [r.p for r in spark.range(n).select(shard.permuted(F.col("id"), n).alias("p")).collect()]
    assert sorted(places) == list(range(n))


def level(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        w = sum(weight[s] for s in open_)
        give = {s: left * weight[s] / w for s in open_}
        left = 0.0
        for s, x in give.items():
            target[s] += x
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mixture(spark):
    rows, df = docs(spark)
    out = mixture.mixture(df).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    want = level(sizes)
    assert Counter((r.doc_id, r.source, r["size"]) for r in out) == Counter((d, s, len(brute.words(t))) for d, t, s in rows)
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"] and (r.position is not None) == (r.taken > 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    at = [r.position for r in out if r.position is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert sorted(map(str, mixture.mixture(docs(spark)[1].repartition(2)).collect())) == sorted(map(str, out))


def test_mixture_of_nothing(spark):
    assert mixture.mixture(docs(spark)[1].limit(0)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], SCHEMA)
    assert [(r.taken, r.target) for r in mixture.mixture(blank).collect()] == [(0, 0.0), (0, 0.0)]


@pytest.mark.parametrize("schedule", mixture.SCHEDULES)
def test_time_inverts_the_integral(spark, schedule):
    def integral(t):
        total = 0.0
        for (t0, t1), (g0, g1) in zip(zip(mixture.TIMES, mixture.TIMES[1:]), zip(schedule, schedule[1:])):
            x = min(max(t - t0, 0), t1 - t0)
            total += g0 * x + (g1 - g0) / (t1 - t0) * x * x / 2
        return total

    assert abs(integral(1) - 1) < 1e-12
    for r in spark.range(101).select((F.col("id") / 100).alias("u"), F.expr(mixture.time_sql("(id / 100D)", schedule)).alias("t")).collect():
        assert abs(integral(r.t) - r.u) < 1e-12
