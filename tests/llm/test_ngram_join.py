import random
import re

import pytest

from hailbook.llm import ngram_join as N
from hailbook.llm.components import components


def brute(docs, percent=75):
    sets = []
    for _, text in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = {k: k for k, _ in docs}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, _) in enumerate(docs):
        for j in range(i):
            b, both = docs[j][0], len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((k, len(s), root(k)) for (k, _), s in zip(docs, sets, strict=True))


def corpus(seed, bases=6, copies=12):
    r = random.Random(seed)
    line = " ".join(f"L{i}" for i in range(12))
    out = []
    for b in range(bases):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.randint(5, 120))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"x{r.randint(0, 50)}"
            out.append(" ".join(w) + (" " + line if b % 2 else ""))
    out += ["", None, "a b", "A  b", "a b c d e", " \n", out[0], out[0], out[0].upper()]
    keys = r.sample(range(10_000), len(out))
    return list(zip(keys, out, strict=True))


@pytest.mark.parametrize(("seed", "chunk"), [(1, 256), (2, 4), (3, 3)])
def test_components_equal_brute_force(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(N, "CHUNK", chunk)
    docs = corpus(seed)
    frame = spark.createDataFrame([(k, t, "x", 3) for k, t in docs], "doc_id long, text string, signature string, n int")
    got = N.ngram_join(frame).collect()
    assert sorted(map(tuple, got)) == brute(docs)


def test_no_rows_and_null_keys(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert N.ngram_join(none).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, "z")], "doc_id long, text string")
    got = sorted(map(str, N.ngram_join(docs).collect()))
    assert [("component_id=5" in g) for g in got] == [True, True, True]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43


def template_pages(seed, pages, own=(28, 28), line=120):
    r = random.Random(seed)
    frame = [f"t{i}" for i in range(line)]
    return [(n, " ".join(frame + [f"p{n}_{i}" for i in range(r.randint(*own))])) for n in range(pages)]


@pytest.mark.parametrize("own", [(28, 28), (10, 40), (0, 24)])
def test_pages_of_one_template_equal_brute_force(spark, own):
    docs = template_pages(5, 70, own)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, N.ngram_join(frame).collect())) == brute(docs)


def test_near_misses_of_one_template_are_no_candidates(spark):
    frame = spark.createDataFrame(template_pages(6, 60), "doc_id long, text string")
    sets = N.described_sets(frame).selectExpr("*", "octet_length(tokens) div 8 as left_over")
    assert sets.filter("posted is not null").count() == 60 and N.live_posts(sets).count() == 0
