import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hailbook.llm import spelling_variants as S


def words_of(docs):
    out = Counter()
    for key, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs):
    n = words_of(docs)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        if top is not None and n[top] >= 2 * n[w]:
            form[w] = top
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root))
    return sorted(out)


def corpus(seed, rows=120):
    r = random.Random(seed)
    base = ["".join(r.choice("abéÿo") for _ in range(r.randint(4, 9))) for _ in range(12)] + ["WORDY", "wordy", "Élan ÉLANS élans"]

    def vary(word):
        at = r.randint(0, len(word))
        return r.choice([word, word, word, word[:at] + word[at + 1 :], word[:at] + r.choice("abéX×") + word[at:], word.upper()])

    docs = [(n, r.choice([" ", "-", "\n"]).join(vary(r.choice(base)) for _ in range(r.randint(0, 60)))) for n in range(rows)]
    docs += [(None, None), (None, "wordy wordyy"), (4, ""), (4, "wordy"), (4, "wordy"), (-3, "1 2 _ ,"), (8, ("x" * 70 + " ") * 4 + "é" * 200_000)]
    return docs


def frame(spark, docs):
    rows = [(k, t, "w", 5, "f") for k, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, n int, form string").repartition(3)


@pytest.mark.parametrize(("seed", "most"), [(1, 512), (2, 4), (3, 1)])
def test_equals_brute_force(spark, seed, most):
    docs = corpus(seed)
    got = S.spelling_variants(frame(spark, docs), most=most).collect()
    assert sorted(map(tuple, got)) == brute(docs)


def test_roots_follow_chains_of_forms(spark):
    chain = ["a" * (9 - n) + "b" * n for n in range(7)]
    docs = [(n, " ".join(w for i, w in enumerate(chain) for _ in range(4 * 3**i))) for n in range(2)]
    got = S.spelling_variants(frame(spark, docs)).collect()
    assert sorted(map(tuple, got)) == brute(docs)
    assert [r.root for r in got if r.word == chain[0]] == [chain[-1]]


def test_empty_table(spark):
    assert S.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_and_misspellings_of_many_documents(spark):
    r = random.Random(5)
    docs = [(n, " ".join(r.choice(["Straße", "naïveté", "ordinary", "words", "fünfzig"]) for _ in range(40))) for n in range(300)]
    got = {row.word: row.n for row in S.word_counts(frame(spark, docs)).collect()}
    assert got == words_of(docs) and len(got) > 5


def test_every_near_pair_is_in_one_tile(spark):
    r = random.Random(6)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(5, 9))) for _ in range(250)})
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    want = Counter()
    for a in words:
        for b in words:
            want[a] += one_edit(a, b)
    for most in (512, 16):
        tiles = S.tiles_of(table, most)
        sizes = tiles.groupBy("tile").count().agg({"count": "max"}).first()[0]
        assert sizes <= max(most, 16)
        met = S.compare_tiles(tiles.toArrow(), most)
        got = Counter()
        for word, count in zip(met["word"].to_pylist(), met["near"].to_pylist(), strict=True):
            got[word] += count
        assert +got == +want


def test_near_is_one_edit():
    r = random.Random(7)
    long = ["".join(r.choice("abc") for _ in range(6)) for _ in range(60)]
    other = ["".join(r.choice("abc") for _ in range(r.randint(5, 6))) for _ in range(60)]
    sizes = [np.array([len(w) for w in x]) for x in (long, other)]
    got = S.near(*(S.code_points([w.encode() for w in x], 6) for x in (long, other)), *sizes, 0, 0, 7)
    assert (got == np.array([[one_edit(a, b) for b in other] for a in long])).all()
