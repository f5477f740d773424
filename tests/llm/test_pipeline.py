import hashlib
import random
import re

import public_tokenizers
import tiktoken

import corpus_pipeline as P
from hailbook.llm.byte_bpe import RANKS, read_ranks
from hailbook.llm.common import staged


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(docs, items):
    docs = [(k, t) for k, t in docs if t and re.search(r"[^\W\d_]", t)]
    last = {}
    for k, t in docs:
        last[t] = max(last.get(t, k), k)
    docs = sorted({(k, t) for k, t in docs if last[t] == k})
    parent = {k: k for k, _ in docs}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, t) in enumerate(docs):
        for b, u in docs[:i]:
            x, y = shingles(t), shingles(u)
            if x & y and len(x & y) >= 0.75 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    docs = [(k, t) for k, t in docs if root(k) == k]
    docs = [(k, t) for k, t in docs if not any(i in t for i in items)]
    ranks = {t: n for n, t in enumerate(read_ranks(public_tokenizers.path(RANKS)))}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for k, t in docs:
        ids = bpe.encode_ordinary(t)
        out.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_stages_equal_brute_force(spark, tmp_path):
    r = random.Random(3)
    words = {"en": ["the", "and", "of", "river", "stone", "water"], "de": ["und", "der", "über", "straße", "nicht", "haus"]}

    def prose(lang, n):
        return " ".join(r.choice(words[lang]) + r.choice(["", "a", "en", "ly"]) + str(r.randint(0, 99)) for _ in range(n))

    items = [" ".join(f"question{r.randint(0, 10**6)}" for _ in range(20)) for _ in range(3)]
    docs = [(n, prose(("en", "de")[n % 2], r.randint(3, 90)), ("en", "de")[n % 2]) for n in range(60)]
    docs += [(100, docs[0][1], "en"), (101, docs[1][1] + " end", "de"), (102, docs[3][1] + " ende", "de"),
             (103, "123 456", "en"), (104, None, None), (105, "", "de"), (106, docs[7][1] + " " + items[0], "de"),
             (107, items[1], None), (108, docs[9][1], None), (108, docs[9][1], None)]
    rows = [(k, t, lang, "src", len(t or ""), 1.0) for k, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(row)[:4] for row in P.run(spark, str(tmp_path)).collect())
    assert got == brute([(k, t) for k, t, _ in docs], items)


def test_empty_documents(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_columns_and_null_keys(spark, tmp_path):
    text = " ".join(f"word{n}" for n in range(30))
    docs = spark.createDataFrame([(None, text, "en", None, 3, "kept"), (None, "short text here", "en", "s", 4, "x")],
                                 "doc_id long, text string, lang string, source string, n_chars long, kept string")
    spark.createDataFrame([(1, "nothing of that is in any text at all here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = staged(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
    assert docs.count() >= 1


def test_exact_stage_judges_rows_of_one_key_apart(spark):
    rows = [(5, "only here"), (5, "shared"), (9, "shared"), (9, "shared"), (None, "alone"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(str, (tuple(r) for r in P.exact(spark, docs, "").collect())))
    assert got == sorted(map(str, [(5, "only here"), (9, "shared"), (None, "alone")]))


def test_near_stage_judges_rows_of_one_key_apart(spark):
    r = random.Random(4)
    a, b, c, d, e = (" ".join(f"w{r.randint(0, 10**6)}" for _ in range(60)) for _ in range(5))
    rows = [(1, a), (None, a + " end"), (None, b), (None, c), (None, c + " end"),  # a null-key row near a keyed one
            (5, d), (5, e), (3, e + " end"), (7, ""), (None, "")]  # a row of a repeated key near another key
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(str, (tuple(x) for x in P.near(spark, docs, "").collect())))
    assert len([x for x in got if c in x]) == 1  # near copies among null-key rows: one stays
    assert [x for x in got if c not in x] == sorted(map(str, [(1, a), (None, b), (5, d), (3, e + " end"), (7, ""), (None, "")]))


def test_decontamination_judges_rows_of_one_key_apart(spark, tmp_path):
    item = " ".join(f"question{n}" for n in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "before " + item), (None, "clean one"), (None, None), (5, item + " after"), (5, "clean two"), (6, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = P.decontaminate(spark, docs, str(tmp_path))
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(None, "clean one"), (None, None), (5, "clean two"), (6, "clean")]))
