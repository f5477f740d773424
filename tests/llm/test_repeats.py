import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hailbook.llm import common
from hailbook.llm import repeats as R
from hailbook.llm.common import in_blocks
from hailbook.llm import suffix_dedup as X
from hailbook.llm.arrays import mix, word_hashes
from hailbook.llm.decontamination import leaks
from hailbook.llm.ngram_join import ngram_join
from hailbook.llm.repeats import plain_order
from hailbook.llm.substring_dedup import substring_dedup
from hailbook.llm.suffix_dedup import Suffixes, suffix_dedup, suffix_order
from tests.llm import brute


def corpus(seed, rows=60):
    r = random.Random(seed)
    vocabulary = ["a", "bb", "é", "ccc", "dé", "the", "x" * 30]
    passages = [" ".join(r.choice(vocabulary) for _ in range(r.randint(8, 40))) for _ in range(6)]
    docs = []
    for _ in range(rows):
        parts = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            if r.random() < 0.4:
                cut = r.randint(0, len(p))
                p = p[cut:] if r.random() < 0.5 else p[:cut]
            parts.append(p)
            parts.append(r.choice(["\n", " ", "\t", " zz ", ""]) * r.randint(1, 3))
            parts.append(" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 30))))
        docs.append("".join(parts))
    docs += ["the " * 200, "the " * 70, "", None, docs[0], docs[0], "tiny"]
    keys = list(range(len(docs)))
    r.shuffle(keys)
    return list(zip(keys, docs, strict=True))


def frame(spark, docs):
    rows = [(k, t, 1, "c", "d") for k, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, kept string, data string")
    return df.repartition(3)


@pytest.mark.parametrize(("seed", "hot"), [(1, 50_000), (2, 3), (3, 0)])
def test_substring_dedup_equals_brute_force(spark, seed, hot):
    docs = corpus(seed)
    got = substring_dedup(frame(spark, docs), hot=hot).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got)) == brute.substring(docs)


@pytest.mark.parametrize(("seed", "hot"), [(4, 50_000), (5, 3), (6, 0)])
def test_suffix_dedup_equals_brute_force(spark, seed, hot):
    docs = corpus(seed)
    got = suffix_dedup(frame(spark, docs), hot=hot).collect()
    assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == brute.suffix(docs)


def test_null_keys_come_last_and_copies_of_a_key_stay(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, text)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.n_removed) for r in substring_dedup(docs).collect()))
    assert got == [(False, 0), (False, 0), (True, 40), (True, 40)]
    assert {r.n_removed for r in suffix_dedup(docs).filter("doc_id is null").collect()} == {len(text)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(none).collect() == []
    assert suffix_dedup(none).collect() == []


def test_one_very_long_text(spark):
    r = random.Random(9)
    text = " ".join(str(r.randint(0, 10**9)) for _ in range(300_000))
    docs = spark.createDataFrame([(1, text), (2, text[1000:50_000])], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup(docs).select("doc_id", "n_removed").collect()}
    assert (got[1].n_removed, got[2].n_removed) == (0, 49_000)


def test_packed_keys_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert (R.unpack_sorted(R.pack_sorted(keys)) == keys).all()


def test_mergesort_gives_the_order_of_the_bytes():
    rng = np.random.default_rng(2)
    units = rng.integers(97, 99, 3000).astype(np.uint8)
    start = rng.integers(0, 2900, 400)
    key = rng.integers(0, 3, 400).astype(np.uint64)
    s = Suffixes(units, key, start, start + 60, 50)
    data = units.tobytes()
    want = sorted(range(400), key=lambda i: (key[i], data[start[i] : start[i] + 50], i))
    assert s.sort().tolist() == want
    order, depth = plain_order(units.astype(np.uint64), key, start, start + 60, 13)
    rows = [(key[i], data[start[i] : start[i] + 13]) for i in order]
    assert rows == sorted(rows) and depth[0] == -1


def test_blocks_reuse_one_exchange_of_the_texts(spark):
    docs = frame(spark, corpus(7)).select("doc_id", "text")
    out = substring_dedup(docs).agg(F.sum("n_removed"))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 3


def test_rows_of_one_key_spread_over_blocks(spark):
    rows = [(None, f"text {n} " + "x" * 90) for n in range(400)] + [(7, f"text {n} " + "y" * 90) for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for part in (docs.filter("doc_id is null"), docs.filter("doc_id = 7"), docs):
        blocked, total = in_blocks(part, "doc_id", "text", 2000)
        sizes = [r["count"] for r in blocked.groupBy("block").count().collect()]
        assert total == part.agg(F.sum(F.octet_length("text"))).first()[0]
        assert len(sizes) >= 15 and max(sizes) <= 60 and sum(sizes) == part.count()


def test_equal_rows_spread_over_blocks_too(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text)] * 300 + [(None, None)] * 300 + [(3, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes = [r["count"] for r in in_blocks(docs, "doc_id", "text", 2000)[0].groupBy("block").count().collect()]
    assert max(sizes) <= 60 and sum(sizes) == len(rows)


@pytest.mark.parametrize("own", [True, False])
def test_results_with_many_rows_of_one_key(spark, monkeypatch, own):
    monkeypatch.setattr(common, "ROW_BYTES", 64 if own else 1 << 22)  # False: equal rows are numbered
    docs = [(None if n % 3 == 0 else k, t) for n, (k, t) in enumerate(corpus(7))] + [(900, "the a bb é ccc " * 9)] * 4
    got = substring_dedup(frame(spark, docs)).select("doc_id", "n_words", "n_removed", "kept").collect()
    want = brute.substring([(10**9 if k is None else k, t) for k, t in docs])
    assert sorted((10**9 if r[0] is None else r[0], *r[1:]) for r in got) == want
    got = suffix_dedup(frame(spark, docs)).collect()
    want = brute.suffix([(10**9 if k is None else k, t) for k, t in docs])
    assert sorted((10**9 if r[0] is None else r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == want


def thue_morse(size=1024):
    """Two words that any polynomial modulo a power of two makes equal."""
    bits = [bin(n).count("1") & 1 for n in range(size)]
    return ("".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits))


def test_colliding_words_are_told_apart(spark):
    a, b = thue_morse()
    front, back = (" ".join(f"{c}{n}" for n in range(20)) for c in "xy")
    docs = spark.createDataFrame([(1, f"{front} {a} {back}"), (2, f"{front} {b} {back}")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(docs).collect()}
    assert got[1][:2] == (41, 0) and got[2] == (41, 40, b)
    words = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join(words).collect()) == [(1, 1), (2, 2)]
    items = spark.createDataFrame([(7, a), (8, f"{front} {a}")], "item_id long, text string")
    assert leaks(words.filter("doc_id = 2"), items).collect() == []
    assert [(r.doc_id, r.item_id) for r in leaks(words.filter("doc_id = 1"), items).collect()] == [(1, 7)]


def test_word_hashes_follow_the_bytes():
    r = random.Random(8)
    words = [bytes(r.randrange(97, 99) for _ in range(r.choice([0, 1, 7, 8, 14, 55, 56, 57, 200]))) for _ in range(400)]
    ends = np.cumsum([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    starts = ends - [len(w) for w in words]
    for secret in (r.getrandbits(128), r.getrandbits(128), (1 << 128) - 1):
        found = word_hashes(data, starts, ends, secret).tolist()
        assert len(set(zip(words, found, strict=True))) == len(set(words)) == len(set(found))
    point = 0x1234567890ABCDE % ((1 << 61) - 3) + 1
    want = (3 * point + int.from_bytes(b"abc", "little")) % ((1 << 61) - 1)
    got = word_hashes(np.frombuffer(b"abc", np.uint8), np.array([0]), np.array([3]), 0x1234567890ABCDE)
    assert got[0] == mix(np.array([want], np.uint64))[0]


def test_a_sort_misled_by_hashes_is_done_again(monkeypatch):
    rng = np.random.default_rng(3)
    units = rng.integers(97, 99, 2000).astype(np.uint8)
    start = rng.integers(0, 1900, 300)
    key = rng.integers(0, 9, 300).astype(np.uint64)
    want = [x.tolist() for x in plain_order(units, key, start, start + 60, 50)]
    assert [x.tolist() for x in suffix_order(units, key, start, start + 60)] == want
    monkeypatch.setattr(X, "span_hash", lambda sums, a, b: (sums[b] - sums[a]) * np.uint64(0))  # all spans collide
    assert [x.tolist() for x in suffix_order(units, key, start, start + 60)] == want


def test_spans_of_one_hash_are_told_apart(monkeypatch):
    """Hashes of the parts before the anchors all collide: only bytes tell windows apart."""
    docs = corpus(11, 25)
    rule = R.Rule(5, 3, X.byte_units, lambda u, k, s, e: plain_order(u, k, s, e, 5))
    texts = [(k, (t or "").encode()[:60]) for k, t in docs]
    table = pa.table({"doc_id": [k for k, _ in texts], "text": [t.decode(errors="replace") for _, t in texts]})
    monkeypatch.setattr(R, "span_hash", lambda sums, a, b: (sums[b] - sums[a]) * np.uint64(0))
    block = R.Block(rule, table)

    def told(asked, answer):
        return [r for r in R.received(R.messages(answer(R.messages(asked))), asked[0][2] if asked else 0)]

    block.learn_seen(told(block.ask_seen(0), lambda t: R.answer_seen(rule, t)))
    block.learn_entries(told(block.ask_entries(0), R.answer_entries))
    gone = block.covered(told(block.ask_deep(0), lambda t: R.answer_deep(rule, t)))
    units = [(k, table["text"][n].as_py().encode()) for n, (k, _) in enumerate(texts)]
    want = brute.covered(units, 5)
    got = [set(np.flatnonzero(gone[block.offsets[n] : block.offsets[n + 1]]).tolist()) for n in range(len(units))]
    assert got == want
