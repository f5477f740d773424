"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some of a run of tokens and ignore the others, so a run still
hits after a substitution at an ignored place. Seeds of the test items are
joined with seeds of the training texts; around each hit the two token
sequences are laid over one another and compared token by token.

Training seeds pass a Bloom filter of the test seeds first. It has a fixed size
(``FILTER_BITS``); a fuller one lets more seeds through to the exact join and
changes nothing else.

Four masks are long and rare in other texts; ``COVER`` and ``SHORT`` complete
them, so that no pattern of substitutions that counts is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hailbook.llm.arrays import BASE, blocks, lower, mix, new_secret, release, word_hashes
from hailbook.llm.common import documents, join_groups, staged

MASKS = ("1101010011", "11001000111", "1010011011", "1111001001")
FILTER_BITS = 23
PROBES = 3
AROUND = 64  # tokens kept on each side of a hit
HITS = 1 << 16  # hits in one row
LEAST_TOKENS = 4  # items with fewer tokens leak only as the whole text
#: With one of these, every item of ten tokens or more hits whichever fifth of its tokens is replaced or cut off.
COVER = ("111111", "11110011", "11001111", "1111000011", "1100110011", "1100001111", "111110000011111")
#: The same for shorter items, by length.
SHORT = {
    5: ("1111", "11011", "10111", "11101"), 6: ("1111", "11011"), 7: ("1111", "11011"),
    8: ("11111", "11100111"), 9: ("111111", "111000111"),
}
LONG, MISMATCH, SCORE, SHARE = 13, 4, 8, 0.8
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
ALONE, APART = 1, 2  # a character that is a token; one that is in none
_KIND = np.zeros(1 << 16, np.uint8)
for _a, _b in ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3040, 0x312F),
               (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F)):
    _KIND[_a : _b + 1] = ALONE  # Thai, Lao, Tibetan, Burmese, Khmer, Han, Kana, Bopomofo
for _a, _b in ((0x3000, 0x303F), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)):
    _KIND[_a : _b + 1] = APART
_KIND[0x3005:0x3008] = ALONE


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and kind of the characters of scripts without spaces and of their punctuation."""
    lead = np.flatnonzero(data >= 0xE0)
    wide = data[lead] >= 0xF0
    a, b = (data[np.minimum(lead + n, len(data) - 1)].astype(np.int64) & 0x3F for n in (1, 2))
    first = data[lead].astype(np.int64)
    kind = np.where(wide, np.where((first == 0xF0) & (a >= 0x20), ALONE, 0), _KIND[(first & 0xF) << 12 | a << 6 | b])
    some = kind > 0
    return lead[some], (lead + np.where(wide, 4, 3))[some], kind[some]


def tokens(data: np.ndarray, offsets: np.ndarray, secret: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens, texts' first tokens.

    Tokens are runs of ASCII letters in lower case, digits and bytes of other
    characters; in scripts without spaces each character is one.
    """
    data = lower(data)
    inside = _TOKEN[data]
    lead, after, kind = unspaced(data)
    for n in range(3):
        inside[lead[kind == APART] + n] = False
    begins, finish = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    begins[edges[edges < len(data)]] = inside[edges[edges < len(data)]]
    finish[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
    lead, after = lead[kind == ALONE], after[kind == ALONE]
    next_, last = after[after < len(data)], lead[lead > 0] - 1
    begins[lead], finish[after - 1] = True, True
    begins[next_], finish[last] = inside[next_], inside[last]
    starts = np.flatnonzero(begins)
    return word_hashes(data, starts, np.flatnonzero(finish) + 1, secret), np.searchsorted(starts, offsets)


def places(mask: str) -> list[int]:
    return [n for n, mark in enumerate(mask) if mark == "1"]


def seeds(units: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the selected tokens of every run as long as the mask."""
    count = max(0, len(units) - len(mask) + 1)
    out = np.full(count, hash_of(mask), np.uint64)
    for n in places(mask):
        out = out * np.uint64(BASE) + units[n : n + count]
    return mix(out)


def hash_of(mask: str) -> np.uint64:
    return np.uint64(int("1" + mask, 2) * 0x9E3779B1)


def masks_for(length: int) -> tuple[str, ...]:
    """Masks one of which hits every overlap ``SHARE`` allows; items of up to ``LEAST_TOKENS`` are looked up as a whole."""
    if length <= LEAST_TOKENS:
        return ("1" * length,) if length else ()
    return SHORT.get(length) or tuple(m for m in MASKS + COVER if len(m) <= length)


def item_tables(items: DataFrame, secret: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, tokens array<long>, seeds array<struct<hash, place>>)."""
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column(1)):
                units, begin = tokens(data, offsets, secret)
                rows: list[dict] = []
                for n in range(last - first):
                    own = units[begin[n] : begin[n + 1]]
                    found = [
                        {"hash": h, "place": p}
                        for mask in masks_for(len(own))
                        for p, h in enumerate(seeds(own, mask).view(np.int64).tolist())
                    ]
                    rows.append({"tokens": own.view(np.int64).tolist(), "seeds": found})
                kinds = pa.struct([("hash", pa.int64()), ("place", pa.int32())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first),
                     pa.array([r["tokens"] for r in rows], pa.list_(pa.int64())),
                     pa.array([r["seeds"] for r in rows], pa.list_(kinds))],
                    ["item_id", "tokens", "seeds"],
                )

    rows = items.select(F.col(key).alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"item_id {kind}, tokens array<long>, seeds array<struct<hash:long,place:int>>")


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h >> np.uint64(n * 20)) & np.uint64((1 << bits) - 1) for n in range(PROBES)]


def seed_filter(test: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bloom filter of the test seeds; at most 2**bits / 64 rows reach the driver, as many as it has words."""
    places_ = F.array(*[F.shiftright(F.col("hash"), n * 20).bitwiseAND((1 << bits) - 1) for n in range(PROBES)])
    words = (
        test.select(F.explode(places_).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        .collect()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    for row in words:
        out[row["word"]] = row["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def hit_segments(docs: DataFrame, secret: int, passing: np.ndarray, masks: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, start, tokens, hits): stretches of whole texts around seeds that pass the filter.

    A stretch has one row with its tokens (``hits`` null) and rows of up to
    ``HITS`` hits each (``tokens`` null), so that no row grows with the square of a text.
    """
    kind = docs.schema[key].dataType.simpleString()
    packed = np.packbits(passing)
    bits = len(passing).bit_length() - 1
    reach = max(map(len, masks), default=0)
    pair = pa.struct([("hash", pa.int64()), ("place", pa.int32())])
    names = ["row", "doc_id", "start", "tokens", "hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.unpackbits(packed).astype(bool)
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column(2)):
                units, begin = tokens(data, offsets, secret)
                at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for mask in masks:
                    h = seeds(units, mask)
                    ok = np.arange(len(h))
                    for probe in probes(h, bits) if len(h) else []:
                        ok = ok[filled[probe[ok]]]
                    text_of = np.searchsorted(begin, ok, "right") - 1
                    ok = ok[ok + len(mask) <= begin[text_of + 1]]
                    if len(mask) < LEAST_TOKENS:  # a whole text or nothing
                        text_of = np.searchsorted(begin, ok, "right") - 1
                        ok = ok[begin[text_of + 1] - begin[text_of] == len(mask)]
                    at.append(ok)
                    hashes.append(h[ok])
                place, h = np.concatenate(at), np.concatenate(hashes)
                if not len(place):
                    continue
                order = np.argsort(place, kind="stable")
                place, h = place[order], h[order]
                of = np.searchsorted(begin, place, "right") - 1
                new = np.ones(len(place), bool)
                new[1:] = (of[1:] != of[:-1]) | (place[1:] - place[:-1] > 2 * AROUND)
                cuts = np.append(np.flatnonzero(new), len(place))
                stretch = np.cumsum(new) - 1
                n = of[cuts[:-1]]
                low = np.maximum(begin[n], place[cuts[:-1]] - AROUND)
                high = np.minimum(begin[n + 1], place[cuts[1:] - 1] + reach + AROUND)
                keys, numbers = batch.column(1).slice(first, last - first), batch.column(0).slice(first, last - first)
                starts, take = low - begin[n], pa.array(n, pa.int64())
                bodies = pa.array([units[a:b].view(np.int64) for a, b in zip(low, high, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [numbers.take(take), keys.take(take), pa.array(starts, pa.int64()), bodies, pa.nulls(len(n), pa.list_(pair))], names
                )
                found = pa.StructArray.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(place - low[stretch], pa.int32())], fields=list(pair)
                )
                for a in range(0, len(place), HITS):
                    b = min(a + HITS, len(place))
                    edges = np.unique(np.concatenate([[a, b], cuts[(cuts > a) & (cuts < b)]]))
                    which = stretch[edges[:-1]]
                    take = pa.array(n[which], pa.int64())
                    lists = pa.ListArray.from_arrays(pa.array(edges - a, pa.int32()), found.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays(
                        [numbers.take(take), keys.take(take), pa.array(starts[which], pa.int64()),
                         pa.nulls(len(which), pa.list_(pa.int64())), lists], names
                    )
        release()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(
        run, f"row long, doc_id {kind}, start long, tokens array<long>, hits array<struct<hash:long,place:int>>"
    )


def overlap(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
    """(matches, aligned tokens, place in text, score) if the item laid at ``shift`` overlaps, else None.

    Either the whole item with ``SHARE`` of its tokens equal, or the stretch of
    best score (1 for a match, -MISMATCH for another token) if it has ``LONG``
    tokens and ``SCORE``.
    """
    low, high = max(0, shift), min(len(text), shift + len(item))
    same = text[low:high] == item[low - shift : high - shift]
    matches = int(same.sum())
    if matches >= SHARE * len(item):
        return matches, len(item), low, matches
    if len(same) < LONG:
        return None
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH))])
    gain = total[LONG:] - np.minimum.accumulate(total)[: len(total) - LONG]  # of stretches of LONG tokens or more
    end = int(gain.argmax()) + LONG
    begin = int(total[: end - LONG + 1].argmin())
    score = int(total[end] - total[begin])
    if score < SCORE:
        return None
    return int(same[begin:end].sum()), end - begin, low + begin, score


def verified(pairs: DataFrame) -> DataFrame:
    """(row, doc_id, item_id, matches, aligned, place, score) of the candidate pairs that overlap."""
    kinds = [pairs.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")]
    names = ["row", "doc_id", "item_id", "matches", "aligned", "place", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, values = [], []
            text, item = batch.column(3), batch.column(4)
            for n, (shift, start) in enumerate(zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)):
                found = overlap(text[n].values.to_numpy(), item[n].values.to_numpy(), shift)
                if found:
                    keep.append(n)
                    values.append((found[0], found[1], found[2] + start, found[3]))
            take = pa.array(keep, pa.int64())
            out = [batch.column(n).take(take) for n in range(3)]
            out += [pa.array([v[n] for v in values], pa.int64()) for n in range(4)]
            yield pa.RecordBatch.from_arrays(out, names)

    columns = pairs.select("row", "doc_id", "item_id", "text_tokens", "item_tokens", "shift", "start")
    schema = f"row long, doc_id {kinds[0]}, item_id {kinds[1]}, matches long, aligned long, place long, score long"
    return columns.mapInArrow(run, schema)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
          item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row and test item it holds: doc_id, item_id, n_matched, n_aligned, token_at.

    Of several overlaps the one of best score, then the first. Null and empty
    texts and items leak nothing; an item of fewer than ``LEAST_TOKENS`` tokens
    leaks only if it is the whole text. Items of one key with the same text are one item; rows that repeat
    a document key are looked at each.
    """
    secret = new_secret()
    own = item_tables(items, secret, item_key, item_text).dropDuplicates(["item_id", "tokens"])
    known = staged(own.withColumn("item", F.monotonically_increasing_id()), "items")
    test = known.select("item", F.explode("seeds").alias("seed")).select(
        "item", F.col("seed.hash").alias("hash"), F.col("seed.place").alias("item_place")
    )
    longest = max(map(len, MASKS + COVER))
    lengths = known.select(F.least(F.size("tokens"), F.lit(longest)).alias("n")).distinct().collect()
    masks = sorted({mask for row in lengths for mask in masks_for(row["n"])})
    segments = staged(hit_segments(docs, secret, seed_filter(test), masks, key, text), "hits")
    hits = segments.select("row", "start", F.explode("hits").alias("hit")).select(
        "row", "start", F.col("hit.hash").alias("hash"), F.col("hit.place").alias("place")
    )
    laid = hits.join(test, "hash").select("row", "start", "item", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    bodies = segments.filter("tokens is not null").select("row", "start", "doc_id", F.col("tokens").alias("text_tokens"))
    item_bodies = known.select("item", "item_id", F.col("tokens").alias("item_tokens"))
    # of a stretch only the tokens that the item lies over go on
    low = F.greatest("shift", F.lit(0))
    high = F.least(F.size("text_tokens"), F.col("shift") + F.size("item_tokens"))
    pairs = join_groups(laid, item_bodies, "item", F.xxhash64("item")).join(bodies, ["row", "start"]).select(
        "row", "doc_id", "item_id", F.slice("text_tokens", low + 1, F.greatest(high - low, F.lit(0))).alias("text_tokens"),
        "item_tokens", (F.col("shift") - low).alias("shift"), (F.col("start") + low).alias("start"),
    )
    best = F.max(F.struct("score", (-F.col("place")).alias("back"), "matches", "aligned")).alias("best")
    return (
        verified(pairs)
        .groupBy("row", "doc_id", "item_id")
        .agg(best)
        .select(
            "doc_id", "item_id", F.col("best.matches").alias("n_matched"),
            F.col("best.aligned").alias("n_aligned"), (-F.col("best.back")).alias("token_at"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
