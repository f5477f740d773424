import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hailbook.llm import hard_negatives as H


def brute(rows, every=100, positives=5, negatives=10):
    least = {}
    for key, vector, label, *_ in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * x) for x in vector]
        if any(abs(x) >= H.LARGEST for x in whole):
            continue
        least.setdefault(key, []).append((label, whole))
    table = {k: v[0] for k, v in least.items()}
    out = []
    for a, (label, x) in table.items():
        if a % every:
            continue
        score = {k: sum(p * q for p, q in zip(x, v, strict=False)) for k, (_, v) in table.items()}
        order = sorted((k for k in table if k != a), key=lambda k: (-score[k], k))
        for p in [k for k in order if table[k][0] == label][:positives]:
            fit = [k for k in order if table[k][0] != label and 30 * score[p] <= 100 * score[k] <= 90 * score[p]]
            out += [(a, p, n, k, score[p], score[k]) for n, k in enumerate(fit[:negatives], 1)]
    return sorted(out)


def table(seed, rows=300, dims=11, step=0.25):
    r = random.Random(seed)
    return [(10 * n, [r.randint(-8, 8) * step for _ in range(dims)], r.randint(0, 3)) for n in range(rows)]


def frame(spark, rows):
    rows = [(*r, 1, 2, "b") for r in rows]
    schema = "vec_id long, embedding array<float>, label int, i int, wanted int, bits string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize(("seed", "blocks"), [(1, 8192), (2, 7)])
def test_equals_brute_force(spark, monkeypatch, seed, blocks):
    monkeypatch.setattr(H, "BLOCK", blocks)
    monkeypatch.setattr(H, "ANCHOR_BLOCK", blocks)
    monkeypatch.setattr(H, "AT_ONCE", 3)
    rows = table(seed)  # few values, so many ties
    assert sorted(map(tuple, H.hard_negatives(frame(spark, rows)).collect())) == brute(rows)


def test_odd_rows(spark):
    rows = table(3, 200)
    rows += [(None, [1.0] * 11, 1), (5, None, 1), (15, [1.0] * 10 + [None], 1), (25, [float("nan")] * 11, 2), (35, [1.0] * 11, None),
             (45, [float("inf")] * 11, 1), (55, [1e30] * 11, 2), (65, [], 1), (75, [2.0] * 3, 2), (85, [100.0] * 20, 3), (100, [9.0] * 11, 3)]
    rows += [rows[0], rows[7], rows[7]]
    rows = [r for r in rows if r[0] != 100 or r[1] != [9.0] * 11]
    got = H.hard_negatives(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_of_rows_with_one_key_the_least_counts(spark):
    a = spark.createDataFrame([(0, [1.0], 1), (0, [1.0], 0), (1, [1.0], 0), (2, [0.5], 1)], "vec_id long, embedding array<double>, label int")
    got = H.hard_negatives(a).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 32768)]


def test_empty_and_positive_less_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert H.hard_negatives(spark.createDataFrame([], schema)).collect() == []
    assert H.hard_negatives(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], schema)).collect() == []


def test_own_anchors_and_bounds(spark):
    rows = table(4, 120)
    got = H.hard_negatives(frame(spark, rows), anchors=F.col("vec_id") % 50 == 0, positives=2, negatives=3).collect()
    assert sorted(map(tuple, got)) == brute(rows, 50, 2, 3)


@pytest.mark.parametrize("largest", [3, 200, 40_000, H.LARGEST - 1])
def test_scores_by_tables_are_inner_products(largest):
    rng = np.random.default_rng(largest)
    values = rng.integers(-largest, largest + 1, (50, 19))
    values[0], values[1], values[2] = 0, -largest, largest
    found = [b for row in values for b in H.packed(row[None, :])]
    planes = H.plane_table(np.array([p for p, _ in found]), pa.array([b for _, b in found], pa.binary()))
    back = H.integers(planes)
    assert (back[:, :19] == values).all() and not back[:, 19:].any()
    assert (H.scores(back[:9], planes) == values[:9] @ values.T).all()
