import random
from collections import Counter

import pytest

from hailbook.llm.line_dedup import LineRuns, line_dedup, line_sets
from hailbook.session import shared_folder

STRIP = " \t\n\v\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def brute(docs, threshold):
    lines = [(t or "").split("\n") for _, t in docs]
    count = Counter(k for own in lines for k in {key(x) for x in own} if k)
    out = []
    for (doc_id, _), own in zip(docs, lines, strict=True):
        kept = [x for x in own if count[key(x)] < threshold]
        out.append((doc_id, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def corpus(seed, rows=80):
    r = random.Random(seed)
    pool = ["Home", "home ", "\tHOME", "É", "é", "a b", "A  b", " ", "", "x\x0b", "\x85", " wide", "end\r"]
    pool += [f"line {n}" for n in range(30)]
    docs = [(n, "\n".join(r.choice(pool) for _ in range(r.randint(0, 12)))) for n in range(rows)]
    docs += [(None, None), (None, "Home\nalone"), (3, "Home"), (3, "Home"), (5, ""), (6, "\n" * 5000 + "Home\n" + "z" * 100_000)]
    return docs


def frame(spark, docs):
    rows = [(k, t, "x", 1, 2, "r") for k, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, line string, n int, batch int, text_id string").repartition(3)


@pytest.mark.parametrize(("seed", "threshold", "batches", "fanout"), [(1, 10, 4, 4), (2, 3, 5, 2), (3, 1, 3, 2), (4, 6, 1, 2)])
def test_equals_brute_force(spark, seed, threshold, batches, fanout):
    docs = corpus(seed)
    got = line_dedup(frame(spark, docs), threshold=threshold, batches=batches, fanout=fanout).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, threshold)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup(none).collect() == []


def test_runs_are_levelled_and_batches_count_once(spark):
    folder = shared_folder(spark, "runs")
    store = LineRuns(spark, folder, threshold=4, fanout=2, buckets=3)
    for n in range(5):
        store.add(f"b{n}", line_sets(spark.createDataFrame([("often\nonce %d" % n,), ("often",)], "text string")))
    assert sorted(level for level, _ in store.runs) == [0, 2]
    again = LineRuns.load(spark, folder, threshold=4, fanout=2)
    assert (sorted(again.runs), again.names, again.buckets) == (sorted(store.runs), store.names, 3)
    again.add("b3", line_sets(spark.createDataFrame([("once 1\nonce 2",)] * 5, "text string")))
    assert again.common().count() == 1
    again.add("b5", line_sets(spark.createDataFrame([("once 1",)] * 3, "text string")))
    assert again.common().count() == 2


def test_common_lines_are_not_counted_again(spark):
    store = LineRuns(spark, shared_folder(spark, "runs"), threshold=2, fanout=9, buckets=2)
    sets = line_sets(spark.createDataFrame([("a\nb",), ("a",)], "text string"))
    store.add("1", sets)
    assert [r.n for r in store.fresh(sets).collect()] == [1]  # b; a is common already


def test_runs_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = LineRuns(spark, shared_folder(spark, "runs"), threshold=2, fanout=9)
        sets = line_sets(spark.createDataFrame([("a\nb",), ("a",)], "text string"))
        for n in range(3):
            store.add(str(n), sets)
        plan = store.common()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") == 3
        plan = store.fresh(sets)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
