import math
import random

import pytest

from faultlens.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score long, block int, rank int"


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in {i: q for i, q in reversed(ok) if i % every == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(q, x)), i) for i, x in ok if i != qi)[:k]
        out += [(qi, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def f32(x):
    import numpy as np

    return float(np.float32(x))


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [f32(rng.gauss(0, 1) * (1 + 3 * (i % 11 == 0)) / (1 + j)) for j in range(12)], 1, 1, 1) for i in range(700)]
    rows += [(1000 + i, rows[3][1], 1, 1, 1) for i in range(60)]  # ties
    rows += [(2000, None, 1, 1, 1), (2050, [1.0, None], 1, 1, 1), (2100, [float("nan")] * 12, 1, 1, 1), (2150, [float("inf")] * 12, 1, 1, 1), (None, [1.0] * 12, 1, 1, 1), (2200, [2.0, 3.0], 1, 1, 1), (2250, [], 1, 1, 1), (701, rows[1][1], 1, 1, 1), (701, rows[1][1], 1, 1, 1)]
    out = topk.exact_topk(spark.createDataFrame(rows, SCHEMA), block=64, query_block=8)
    assert sorted(tuple(r) for r in out.collect()) == brute(rows)


def test_small_and_empty(spark):
    rows = [(0, [1.0], 1, 1, 1), (50, [-1.0], 1, 1, 1), (7, [0.5], 1, 1, 1)]
    assert sorted(tuple(r) for r in topk.exact_topk(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)
    assert topk.exact_topk(spark.createDataFrame([], SCHEMA)).count() == 0
    assert topk.exact_topk(spark.createDataFrame([(0, [], 1, 1, 1), (1, [], 1, 1, 1)], SCHEMA)).count() == 1


def test_large_components(spark):
    rows = [(0, [5000.0], 1, 1, 1), (1, [5000.0], 1, 1, 1), (2, [9000.0], 1, 1, 1), (3, [-4097.0], 1, 1, 1)]
    assert sorted(tuple(r) for r in topk.exact_topk(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)
    rng = random.Random(8)
    rows = [(i, [f32(rng.gauss(0, 1) * 10 ** rng.choice([0, 0, 3, 5])) for _ in range(6)], 1, 1, 1) for i in range(1, 400)]
    assert sorted(tuple(r) for r in topk.exact_topk(spark.createDataFrame(rows, SCHEMA), block=64, query_block=8).collect()) == brute(rows)


def test_pairs_beyond_64_bits(spark):
    rng = random.Random(9)
    big = f32(2.0**36 + 3 * 2**13)
    rows = [(0, [big, -big, 1.5], 1, 1, 1), (100, [1.0, 2.0, 3.0], 1, 1, 1)]
    rows += [(201 + i, [big, big, -10.0 - i], 1, 1, 1) for i in range(4)]  # terms beyond 64 bits cancel
    rows += [(301 + i, [-(2.0**44), 0.0, 0.0], 1, 1, 1) for i in range(9)]  # beyond 64 bits, a multiple of 2^64
    rows += [(501 + i, [0.0, 0.0, -5.0 - rng.random() * 100], 1, 1, 1) for i in range(90)]
    for size in (16, 2048):
        got = topk.exact_topk(spark.createDataFrame(rows, SCHEMA), every=100, block=size)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, every=100)
    for value in (2.0**40, 2.0**60):  # a result, a component
        with pytest.raises(Exception, match="64 bits"):
            topk.exact_topk(spark.createDataFrame([(0, [value], 1, 1, 1), (1, [value], 1, 1, 1)], SCHEMA)).collect()
