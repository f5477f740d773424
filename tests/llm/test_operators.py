import hashlib
import math
import random
import re
import time
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from hailbook.llm import byte_bpe as B
from hailbook.llm import decontamination as D
from hailbook.llm import exact_dedup as E
from hailbook.llm import language_id as L
from hailbook.llm import licence_scan as S
from hailbook.llm import licence_texts
from hailbook.llm import quality as Q
from hailbook.llm.perfect_hash import PerfectHash
from hailbook.llm import token_counts as T
from hailbook.llm.token_counts import Rollup, maintain

TEXTS = "doc_id long, text string"


# decontamination ---------------------------------------------------------------


def leaks_brute(docs, items):
    """Every shift of every item over every text, by the overlap rule written out."""
    def tok(t):
        return re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())

    out = set()
    for k, text in docs:
        x = tok(text)
        for i, item in items:
            y = tok(item)
            if len(y) < D.LEAST_TOKENS:
                continue
            for shift in range(-len(y), len(x)):
                same = [x[shift + j] == y[j] for j in range(len(y)) if 0 <= shift + j < len(x)]
                if sum(same) >= D.SHARE * len(y):
                    out.add((k, i))
                for a in range(len(same)):
                    score = 0
                    for b in range(a, len(same)):
                        score += 1 if same[b] else -D.MISMATCH
                        if b - a + 1 >= D.LONG and score >= D.SCORE:
                            out.add((k, i))
    return out


def test_a_long_text_of_one_item_sends_each_token_few_times(spark):
    """4 MB of one repeated item, and the same item once behind many others; time in proportion."""
    item = " ".join(f"wo{n}rd" for n in range(30))
    text = " ".join([item] * ((4 << 20) // len(item)))
    docs = spark.createDataFrame([(1, text), (2, "x " * 5000 + item), (3, "x " * 50_000), (None, item)], TEXTS).repartition(2)
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    begin = time.monotonic()
    got = sorted(map(str, map(tuple, D.leaks(docs, items).collect())))
    assert time.monotonic() - begin < 40  # about 24 s on eight cores
    assert got == sorted(map(str, [(1, 7, 30, 30, 0), (2, 7, 30, 30, 5000), (None, 7, 30, 30, 0)]))


def test_leaks_survive_substitutions_and_spare_clean_texts(spark):
    r = random.Random(5)
    word = lambda: f"w{r.randint(0, 400)}"
    items = [(n, " ".join(word() for _ in range(m))) for n, m in enumerate([30, 24, 60, 8, 7, 3])]
    docs = []
    for n in range(40):
        body = [word() for _ in range(r.randint(0, 60))]
        if n % 2:
            piece = items[r.randrange(6)][1].split()
            for _ in range(len(piece) // 15):
                piece[r.randrange(len(piece))] = "zzz"
            at = r.randint(0, len(body))
            body[at:at] = piece
        docs.append((n, r.choice([" ", "\n", ", "]).join(body).replace("w1", "W1")))
    docs += [(90, None), (91, ""), (92, items[0][1]), (92, items[0][1])]
    got = D.leaks(spark.createDataFrame(docs, TEXTS), spark.createDataFrame(items + [(7, None)], "item_id long, text string"))
    found = [(row.doc_id, row.item_id) for row in got.collect()]
    assert set(found) == leaks_brute(docs, items)
    assert len(found) == len(set(found)) + 1  # the repeated row


def test_every_pattern_that_counts_has_a_seed():
    for n in range(D.LEAST_TOKENS, 21):
        placed = [np.array(D.places(m)) + at for m in D.masks_for(n) for at in range(n - len(m) + 1)]
        for gone in combinations(range(n), n - math.ceil(D.SHARE * n)):
            assert any(not np.isin(p, gone).any() for p in placed), (n, gone)


def test_leaks_of_short_items_equal_brute_force(spark):
    r = random.Random(11)
    items = [(n, " ".join(f"q{n}x{j}" for j in range(n))) for n in range(1, 21)]
    docs = [(n, t) for n, t in items] + [(100 + n, "before " + t + " after") for n, t in items]
    for k in range(400):
        n, text = items[r.randrange(20)]
        piece = text.split()
        for _ in range(r.randint(0, n // 5 + 1)):
            piece[r.randrange(n)] = "zzz"
        cut = r.choice([0, 0, 1])
        docs.append((1000 + k, " ".join(["x"] * (r.randint(0, 3) * (1 - cut)) + piece[cut:] + ["y"] * r.randint(0, 3))))
    found = D.leaks(spark.createDataFrame(docs, TEXTS), spark.createDataFrame(items, "item_id long, text string"))
    got = {(row.doc_id, row.item_id) for row in found.collect()}
    whole = {(k, i) for k, t in docs for i, item in items[: D.LEAST_TOKENS - 1] if t == item}
    assert got == leaks_brute(docs, items) | whole and len(whole) >= 3


def test_leaks_in_scripts_without_spaces(spark):
    items = [(1, "水の沸点は何度ですか。"), (2, "ประเทศไทยมีกี่จังหวัด"), (3, "𠀀𠀁𠀂𠀃𠀄")]
    docs = [(1, "前文、水の沸点は何度ですか?後文"), (2, "ก่อนประเทศไทยมีกี่จังหวัดหลัง"), (3, "水の沸騰は何度ですか"),
            (4, "天気は良い。何度も"), (5, "abc𠀀𠀁𠀂𠀃𠀄def"), (6, None), (7, "水")]
    got = D.leaks(spark.createDataFrame(docs, TEXTS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == [(1, 1), (2, 2), (3, 1), (5, 3)]
    data = np.frombuffer("Ab水c。é 中".encode(), np.uint8)
    assert len(D.tokens(data, np.array([0, len(data)]), 1)[0]) == 5


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f g")], TEXTS), spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert D.leaks(docs.limit(0), items).collect() == []
    assert D.leaks(docs, items.limit(0)).collect() == []
    assert D.leaks(docs, items).count() == 1


def test_a_fuller_filter_changes_nothing():
    h = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert all((p < (1 << 10)).all() for p in D.probes(h, 10))


# byte-level BPE ----------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    tokens = B.read_ranks(public_tokenizers.path(B.RANKS))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: n for n, t in enumerate(tokens)}, special_tokens={})
    return B.Encoder(tokens, public_tokenizers.PATTERN, PerfectHash.build(tokens)), known


def test_perfect_hash_is_minimal_and_exact(bpe):
    table, tokens = bpe[0].table, bpe[0].tokens
    assert sorted(table.key_at.tolist()) == list(range(len(tokens)))
    assert (table.find(tokens) == np.arange(len(tokens))).all()
    assert table.find([b"", b"qqqqzzzzqq"]).tolist() == [-1, -1]


def test_ids_equal_the_library_and_decode_back(bpe):
    own, known = bpe
    r = random.Random(6)
    texts = ["", " ", "'s don't I'LL", "<|endoftext|>", "a" * 3000, "\x1c  x", "ab" * 700]
    texts += ["".join(r.choice("abcdethrs  \n'S.,12é中😀\t ́") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    texts += [f"a{chr(c)}1 {chr(c)}{chr(c)}!" for c in [*range(0x3000), *range(0xE000, 0x20000, 17)] if not 0xD800 <= c < 0xE000]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == known.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_encode_documents(spark, bpe):
    docs = [(1, "Hello  world"), (1, "Hello  world"), (None, None), (3, ""), (4, "long " * 40_000)]
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], TEXTS + ", ids int, decoded string")
    got = B.digests(B.encode_documents(frame, public_tokenizers.path(B.RANKS))).collect()
    want = []
    for k, t in docs:
        ids = bpe[1].encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert B.encode_documents(frame.limit(0), public_tokenizers.path(B.RANKS)).collect() == []


# language ID -------------------------------------------------------------------


def labelled_texts(seed, rows):
    r = random.Random(seed)
    parts = {"en": ["th", "ing", "and", "er", "ly"], "de": ["sch", "ung", "ß", "ver", "ö"], "es": ["ción", "ll", "ñ", "os", "el"]}
    out = []
    for n in range(rows):
        lang = r.choice(list(parts))
        out.append((n, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 150))), lang))
    return out


def test_language_is_learnt_and_held_out_rows_are_found(spark):
    rows = labelled_texts(1, 500) + [(900, None, "en"), (901, "12 ...", "de"), (902, "", None)]
    docs = spark.createDataFrame(rows, TEXTS + ", lang string").repartition(4)
    found = L.identify(docs, L.learn(docs)).join(docs.withColumn("out", L.held_out(F.col("doc_id"))), "doc_id").collect()
    out = [r for r in found if r.out and r.doc_id < 900]
    assert len(out) > 80 and sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert {(r.lang_pred, r.score) for r in found if r.doc_id >= 900} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in found)


def test_held_out_labels_do_not_matter(spark):
    rows = labelled_texts(2, 200)
    docs = spark.createDataFrame(rows, TEXTS + ", lang string")
    other = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, L.identify(d, L.learn(d)).collect())) for d in (docs, other))
    assert a == b


def test_filters_equal_a_plain_convolution():
    r = np.random.default_rng(3)
    pieces = [bytes(r.integers(97, 123, 300).tolist()), b"1234 " * 60, b"ab" * 200]
    net = L.train(pieces, ["x", "y", "z"], epochs=1)
    x, _ = L.windows(np.frombuffer(b"".join(pieces) + b"short", np.uint8), np.cumsum([0, *map(len, pieces), 5]))
    want = []
    for row in x.tolist():
        out = []
        for w, table in net.tables.items():
            for f in range(L.FILTERS):
                out.append(max(sum(float(table[j, row[at + j], f]) for j in range(w)) for at in range(L.WINDOW - w + 1)))
        want.append([max(v + float(b), 0.0) for v, b in zip(out, net.bias, strict=True)])
    assert np.allclose(net.pooled(x), want, atol=1e-4)


def test_language_sample_is_one_whatever_the_order_of_rows(spark):
    """Null and repeated keys, equal rows, clashing columns and a long text."""
    r = random.Random(4)
    word = lambda letters: "".join(r.choice(letters) for _ in range(5))
    rows = [(None if n % 3 else n % 6, " ".join(word("abc" if n % 2 else "xyz") for _ in range(40)), "de" if n % 2 else "en") for n in range(200)]
    rows += rows[:40] + [(5, "abc " * 500_000, "de"), (6, None, "en"), (8, "", "en")]
    schema = TEXTS + ", lang string, lang_pred int, score string, c0 int, letters int"
    full = [(*row, 1, "s", 2, 3) for row in rows]
    once, again = spark.createDataFrame(full, schema).repartition(7), spark.createDataFrame(full[::-1], schema).coalesce(1)
    a, b = (sorted(map(tuple, L.labelled_sample(d, "doc_id", "text", "lang", 16))) for d in (once, again))
    assert a == b and sum(row[0] == "de" for row in a) > 10 and sum(row[0] == "en" for row in a) > 10
    net = L.learn(once)
    got = L.identify(again, net)
    assert got.count() == len(rows) and got.filter("score < 0 or score > 1").isEmpty()
    assert got.filter("lang_pred = 'und'").count() == 2
    assert L.accepted(again, net).columns == again.columns


def test_language_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None)], TEXTS + ", lang string")
    assert L.learn(docs) is None
    assert [tuple(r) for r in L.identify(docs, None).collect()] == [(1, "und", 0.0)]
    assert L.accepted(docs, None).count() == 1
    assert L.identify(docs.limit(0), None).collect() == []


def test_windows_cover_whole_texts():
    data = np.arange(1, 11, dtype=np.uint8)
    x, first = L.windows(data, np.array([0, 0, 7, 10]), 4)
    assert first.tolist() == [0, 0, 2, 3]
    assert x.tolist() == [[1, 2, 3, 4], [5, 6, 7, 0], [8, 9, 10, 0]]


# quality -----------------------------------------------------------------------


def test_quality_by_co_training(spark):
    r = random.Random(7)
    rows, labels = [], []
    for n in range(600):
        good = r.random() < 0.6
        text = " ".join(r.choice(["river", "stone", "went", "over", "the", "a"]) if good else r.choice(["x&&&", "y%%%", "Z!!"]) for _ in range(r.randint(5, 60)))
        rows.append((n, text, ("good" if good == (r.random() < 0.9) else "bad"), "en", len(text), "x"))
        if n % 3 == 0:
            labels.append((n, int(good), 0))
    rows += [(1000, None, None, None, None, None), (1001, "", "good", "en", 0, "x")]
    docs = spark.createDataFrame(rows, TEXTS + ", source string, lang string, n_chars long, score string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in Q.classify(docs, known).collect()}
    assert len(got) == len(rows)
    right = [got[n].kept == ("river" in t or "stone" in t or "went" in t or "over" in t or "the" in t) for n, t, *_ in rows[:600]]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.score for x in Q.classify(docs, known.limit(0)).collect()} == {0.5}
    assert Q.classify(docs.limit(0), known).collect() == []


def test_each_view_teaches_the_other():
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.5).astype(float)
    views = [np.stack([y * 4 + rng.normal(size=400), rng.normal(size=400)], axis=1) for _ in range(2)]
    label = np.where(np.arange(400) < 40, y, -1).astype(int)
    model = Q.CoTrained(lambda measure: measure(*views, label, np.arange(400) % 4 == 3), (2, 2))
    assert min(model.added) > 0
    p = model.scores(views[0][40:], views[1][40:])
    assert ((p[:, 2] > 0.5) == (y[40:] > 0.5)).mean() > 0.95


def test_moments_give_the_discriminant_of_the_rows():
    rng = np.random.default_rng(4)
    y = (np.arange(300) % 3 == 0).astype(int)
    x = rng.normal(size=(300, 3)) + y[:, None] * [2, 0, -1]
    parts = sum(Q.moments(x[i : i + 77], y[i : i + 77]) for i in range(0, 300, 77))
    model = Q.Discriminant(parts, 3)
    mean = np.array([x[y == c].mean(0) for c in (0, 1)])
    rest = x - mean[y]
    within = rest.T @ rest / 300
    scale = np.sqrt(np.diag(within) + Q.FLOOR**2)
    w = np.linalg.solve(within + Q.RIDGE * np.diag(scale**2), mean[1] - mean[0])
    assert np.allclose(model.w, w) and np.isclose(model.b, np.log(100 / 200) - w @ mean.sum(0) / 2)
    none = Q.CoTrained(lambda measure: measure(x, x, np.zeros(300, int), y == 1), (3, 3))
    assert not none.labelled


def test_quality_of_null_keys_repeated_rows_and_long_texts(spark):
    r = random.Random(8)
    good = ["river", "stone", "went", "over"]
    rows = [(n % 40, " ".join(r.choice(good if n % 2 else ["x&&&", "y%%%"]) for _ in range(30)), "s", "en", 100, "x", 1) for n in range(200)]
    rows += [(None, "river stone went over " * 7, "s", "en", 150, "x", 1)] * 50 + [(500, "river " * 300_000, None, "en", 10**9, "x", 2)]
    docs = spark.createDataFrame(rows, TEXTS + ", source string, lang string, n_chars long, content string, label int")
    known = spark.createDataFrame([(n, n % 2) for n in range(32)] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    once = sorted(map(str, Q.classify(docs, known).select("doc_id", "kept").collect()))
    again = sorted(map(str, Q.classify(docs.repartition(9), known).select("doc_id", "kept").collect()))
    assert once == again and len(once) == len(rows)
    assert sum("doc_id=None, kept=True" in x for x in once) == 50


# exact dedup, licences, token counts -------------------------------------------


def exact_brute(docs):
    groups = {}
    for k, t in docs:
        groups.setdefault(t or "", []).append(k)
    out = []
    for k, t in docs:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((k, keep, len(own), k == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_equals_brute_force_whatever_the_hash(spark, weak):
    r = random.Random(8)
    long = ". ".join(f"sentence {r.randint(0, 99)} of a long text" for _ in range(2000))
    texts = [long, long + "x", "x" * 9000, "x" * 9001, "", None, "a", "a ", "a\n", long[:5000], "é" * 600 + ".", "😀" * 5000]
    docs = [(n if n != 7 else None, r.choice(texts)) for n in range(60)] + [(3, "a"), (3, "a"), (None, None), (None, None)]
    frame = spark.createDataFrame([(k, t, 1) for k, t in docs], TEXTS + ", kept int").repartition(3)
    identifier = (lambda c: F.pmod(F.xxhash64(c), F.lit(2))) if weak else F.xxhash64
    got = E.exact_dedup(frame, chunk_id=identifier).drop("n_chunks").collect()
    assert sorted(map(str, map(tuple, got))) == exact_brute(docs)
    assert E.exact_dedup(frame.limit(0)).collect() == []


def test_chunks_are_the_text(spark):
    texts = ["", "ab", "x. " * 3000, "y" * 10_000, "é\n" * 700]
    rows = spark.createDataFrame(list(enumerate(texts)), TEXTS)
    for row in rows.select("text", E.chunks(F.col("text")).alias("c")).collect():
        assert "".join(row.c) == row.text and all(len(c) <= E.MAX_CHUNK for c in row.c)


def test_licences(spark):
    mit = licence_texts.MIT
    docs = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", "") + "\n"),
        (2, "prose\nReleased under the MIT Licence\nmore\n  licensed under CC BY-NC 4.0!\nReleased under the MIT License."),
        (3, "It was Released under the MIT License. And more."), (4, None), (5, ""), (6, "copyright 2020 me"),
        (7, "Released under the MIT License."), (7, "Released under the MIT License."),
    ]
    frame = spark.createDataFrame([(k, t, "z") for k, t in docs], TEXTS + ", license string")
    got = S.licence_scan(frame, S.catalogue(spark)).collect()
    assert sorted((r.doc_id, r.text_license, r.line_licenses, r.n_license_lines) for r in got if r.doc_id not in (4, 5, 6)) == [
        (1, "MIT", "", 0), (2, None, "CC-BY-NC-4.0,MIT", 3), (3, None, "", 0), (7, "MIT", "MIT", 1), (7, "MIT", "MIT", 1)]
    assert {(r.text_license, r.line_licenses) for r in got if r.doc_id in (4, 5, 6)} == {(None, "")}
    assert S.licence_scan(frame.limit(0), S.catalogue(spark)).collect() == []


def test_licence_files(spark):
    line = "\n\nCopyright (c) 2020 Someone\n\n"
    docs = [("MIT", "MIT License" + line + licence_texts.MIT), ("MIT", "The MIT License (MIT)" + line + licence_texts.MIT),
            ("ISC", "ISC License" + line + licence_texts.ISC), ("Zlib", "zlib License" + line + licence_texts.ZLIB)]
    docs += [(name, "\n\n" + text.replace("\n", "\r\n")) for name, text in licence_texts.FILES]
    docs += [(name, text[: text.index(licence_texts.END)]) for name, text in licence_texts.FILES if licence_texts.END in text]
    assert {name for name, _ in docs} >= {"Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"}
    frame = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(docs)] + [(99, "MIT License"), (98, docs[-1][1] + " more")], TEXTS)
    got = {r.doc_id: r.text_license for r in S.licence_scan(frame, S.catalogue(spark)).collect()}
    assert got == dict(enumerate(name for name, _ in docs)) | {99: None, 98: None}


def test_licences_behind_comment_marks_many_copies_and_long_texts(spark):
    marked = "".join(f"# {part}\n" for part in ["Copyright (c) 2020 Someone", *licence_texts.MIT.split("\n")])
    block = "/*\n * (c) 2021 A\n * " + licence_texts.ISC.replace("\n", "\n * ") + "\n */"
    three = "BSD 3-Clause License\n\nCopyright (c) 2020, A\nAll rights reserved.\n\n" + licence_texts.bsd(3, True)
    bullets = "// Copyright 2019 B\n" + licence_texts.bsd(2, False)
    line = "Released under the MIT License."
    long = (line + "\n") * 3 + "prose without end " * 200_000
    texts = [(1, marked), (2, block), (3, three), (4, bullets), (5, long), (6, "Mr Copyright said")]
    frame = spark.createDataFrame([(k, t, 1) for k, t in texts], TEXTS + ", digest int")
    many = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("digest"))
    same = spark.range(3_000).select(F.lit(9).cast("long").alias("doc_id"), F.lit(line).alias("text"), F.lit(1).alias("digest"))
    got = S.licence_scan(frame.union(many).union(same), S.catalogue(spark))
    counts = got.groupBy("doc_id", "text_license", "line_licenses", "n_license_lines").count().collect()
    assert {tuple(r) for r in counts} == {
        (1, "MIT", "", 0, 1), (2, "ISC", "", 0, 1), (3, "BSD-3-Clause", "", 0, 1), (4, "BSD-2-Clause", "", 0, 1), (5, None, "MIT", 3, 1),
        (6, None, "", 0, 1), (None, None, "", 0, 30_000), (9, "MIT", "MIT", 1, 3_000)}


def test_rollup_batches_count_once(spark, tmp_path):
    columns = "source string, lang string, tokenizer string, event string, tokens long, old_tokens long"
    rollup = Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().collect() == []
    first = spark.createDataFrame([("a", "en", "v1", "insert", 10, None), ("a", "en", "v1", "insert", 5, None),
                                   (None, "en", "v1", "insert", None, None), ("b", "de", "v1", "insert", 7, None), ("b", "de", "v1", "odd", 7, 1)], columns)
    then = spark.createDataFrame([("a", "en", "v1", "delete", 5, None), ("a", "en", "v1", "revise", 12, 10), ("b", "de", "v1", "delete", 7, None)], columns)
    assert [rollup.commit("one", first), rollup.commit("two", then), rollup.commit("one", first), rollup.commit("two", then)] == [True, True, False, False]
    assert sorted(map(str, map(tuple, rollup.totals().collect()))) == sorted(map(str, [("a", "en", "v1", 1, 12), (None, "en", "v1", 1, 0)]))
    with pytest.raises(ValueError):
        rollup.commit("../x", first)


def test_a_batch_that_broke_off_is_written_anew(spark, tmp_path):
    columns = "source string, lang string, tokenizer string, event string, tokens long, old_tokens long"
    rollup = Rollup(spark, str(tmp_path / "rollup"))
    (tmp_path / "rollup" / "batch=one" / "_temporary").mkdir(parents=True)
    rows = spark.createDataFrame([("a", "en", "v1", "insert", 10, None)], columns)
    assert rollup.commit("one", rows) and not rollup.commit("one", rows)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 1, 10)]


def test_token_counts_over_documents(spark, tmp_path):
    rows = [(1, "a b", "s", "en", 3), (2, "a b", "s", "en", 3), (3, None, "s", None, None), (4, "x1,y", "t", "de", 4)]
    docs = spark.createDataFrame(rows, TEXTS + ", source string, lang string, n_chars long")
    got = maintain(docs, Rollup(spark, str(tmp_path / "rollup"))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        ("s", "en", "words-1", 1, 2), ("s", None, "words-1", 1, 0), ("t", "de", "words-1", 1, 1),
        ("s", "en", "words-2", 2, 4), ("s", None, "words-2", 1, 0), ("t", "de", "words-2", 1, 4)]))


def test_token_counts_drop_copies_by_row(spark, tmp_path):
    """A key with one dropped and one kept text, repeated rows, and null keys; beside the SQL of the query."""
    import duckdb

    rows = [(1, "a", "s", "en", 1), (1, "b c", "s", "en", 3), (2, "a", "s", "en", 1), (None, "z z", "s", "en", 3),
            (None, "z z", "s", "en", 3), (None, "a", "s", "en", 1), (4, "q", None, "en", 1), (4, "q", None, "en", 1)]
    docs = spark.createDataFrame(rows, TEXTS + ", source string, lang string, n_chars long")
    got = sorted(map(str, map(tuple, maintain(docs, Rollup(spark, str(tmp_path / "rollup"))).collect())))
    assert str(("s", "en", "words-1", 4, 7)) in got and str((None, "en", "words-1", 2, 2)) in got
    documents = docs.toPandas()  # noqa: F841  duckdb reads it by name
    assert got == sorted(map(str, duckdb.sql(T.SQL).fetchall()))
    empty = maintain(docs.limit(0), Rollup(spark, str(tmp_path / "empty")))
    assert empty.collect() == []


def test_a_batch_counts_only_once_it_is_named(spark, tmp_path):
    columns = "source string, lang string, tokenizer string, event string, tokens long, old_tokens long"
    rows = spark.createDataFrame([("a", "en", "v1", "insert", 10, None)], columns)
    rollup = Rollup(spark, str(tmp_path / "rollup"))
    rollup.commit("one", rows)
    T.deltas(rows).write.parquet(rollup._batch("two"))  # files are there, the marker is not
    assert rollup.batches() == ["one"] and [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 1, 10)]
    assert rollup.commit("two", rows) and not rollup.commit("two", rows)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 2, 20)]


def test_many_groups_are_stored_without_a_single_task(spark, tmp_path):
    rows = spark.range(100_000).select(
        F.concat(F.lit("s"), "id").alias("source"), F.lit("en").alias("lang"), F.lit("v1").alias("tokenizer"),
        F.lit("insert").alias("event"), F.lit(2).cast("long").alias("tokens"), F.lit(None).cast("long").alias("old_tokens"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rollup = Rollup(spark, str(tmp_path / "rollup"))
        rollup.commit("one", rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "rollup" / "batch=one").glob("*.parquet"))) > 1
    assert rollup.totals().agg(F.count("*"), F.sum("n_tokens")).first() == (100_000, 200_000)


def test_tokens_of_a_bpe_vocabulary(spark, tmp_path):
    path = public_tokenizers.path(B.RANKS)
    texts = ["Hello world, 12345!", None, "", "naïve 日本 text" * 30, "x" * 3000]
    docs = spark.createDataFrame([(n % 3, t, f"s{n % 2}", "en") for n, t in enumerate(texts)], TEXTS + ", source string, lang string")
    real = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: n for n, t in enumerate(B.read_ranks(path))}, special_tokens={})
    rollup = Rollup(spark, str(tmp_path / "rollup"))
    rollup.commit("bpe", T.bpe_counts(docs, path, "byte_bpe_50k"))
    want = [(f"s{s}", "en", "byte_bpe_50k", len(texts[s::2]), sum(len(real.encode(t or "")) for t in texts[s::2])) for s in (0, 1)]
    assert sorted(map(tuple, rollup.totals().collect())) == want
