"""Spelling variants: words one edit apart, by dense prefix-suffix tiling.

Two words differ by one inserted, deleted or replaced code point if the lengths
of their common prefix and common suffix add up to the longer length minus one.
So they share at least half a word at one of the ends. Words that do so form a
tile; its words are padded code-point matrices that are compared block by block:
all prefix and suffix lengths of a pair of blocks come out of one pass over the
columns.

Every pair is found in one tile only. A tile is named by the longer length, by
known lengths of prefix and suffix and by a bound that the prefix must stay
below. A tile with too many words is halved: either the prefix is longer than
known, or, if not, the suffix has to be. That ends where prefix and suffix leave
one place open, and such a tile has no more words than there are letters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hailbook.llm.arrays import blocks, release
from hailbook.llm.common import documents, join_groups, staged

LETTERS, TIMES = 5, 3  # of a word, at least
MISSPELL = 97
RATIO = 2  # times a word's count that its form has
TILE = 512  # words of a tile, and rows of a block that is compared at once
BUCKET = 40_000  # rows of tiles in a bucket, about
LEAST_BUCKETS = 16
LONG = 64  # bytes of a run above which its checksum is not worked out with others
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), 0xC3]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _crc_table() -> np.ndarray:
    """What one byte does to a CRC-32."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ np.where(out & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


_CRC = _crc_table()


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` within the texts.

    U+00C0 to U+00FF are the byte C3 and any one byte after it.
    """
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    begins, finish = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    first, last = edges[edges < len(data)], edges[edges > 0] - 1
    begins[first], finish[last] = inside[first], inside[last]
    return np.flatnonzero(begins), np.flatnonzero(finish) + 1


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """CRC-32 of each run, going on from ``seeds``."""
    length = ends - starts
    out = seeds.copy()
    for n in np.flatnonzero(length > LONG):
        out[n] = zlib.crc32(data[starts[n] : ends[n]].tobytes(), int(seeds[n]))
    short = np.flatnonzero(length <= LONG)
    order = short[np.argsort(-length[short], kind="stable")]
    crc, at, size = ~out[order], starts[order], length[order]
    for n in range(int(size.max(initial=0))):
        own = int(np.searchsorted(-size, -n, "left"))  # runs longer than n
        crc[:own] = _CRC[(crc[:own] ^ data[at[:own] + n]) & np.uint32(0xFF)] ^ (crc[:own] >> np.uint32(8))
    out[order] = ~crc
    return out


def spelled(data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, least: int = LETTERS, misspell: int = MISSPELL) -> pa.Array:
    """The words of the texts with at least ``least`` letters, misspellings made: strings, with repeats."""
    data = _LOWER[data]
    starts, ends = letter_runs(data, offsets)
    lead = np.concatenate([[0], np.cumsum(data == 0xC3)])
    letters = ends - starts - (lead[ends] - lead[starts])
    keep = letters >= least
    starts, ends, letters = starts[keep], ends[keep], letters[keep]
    crc = checksums(data, starts, ends, seeds[np.searchsorted(offsets, starts, "right") - 1])
    take = np.zeros(len(data) + 1, np.int8)  # bytes that stay
    take[starts] += 1
    np.add.at(take, ends, -1)
    stay = np.cumsum(take[:-1]) > 0
    for n in np.flatnonzero(crc % np.uint32(misspell) == 0).tolist():
        run = data[starts[n] : ends[n]]
        heads = np.flatnonzero((run < 0x80) | (run == 0xC3))
        at = starts[n] + heads[int(crc[n]) % letters[n]]
        stay[at : at + 1 + int(data[at] == 0xC3)] = False
        letters[n] -= 1
    sums = np.concatenate([[0], np.cumsum(stay)])
    length = sums[ends] - sums[starts]
    words = pa.Array.from_buffers(
        pa.large_string(), len(starts),
        [None, pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int64)), pa.py_buffer(data[stay])],
    )
    return words.filter(pa.array(letters >= least))


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = TIMES) -> DataFrame:
    """(word, n) of the words with at least ``times`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in batch.column(0).to_pylist()], np.uint32)
            for first, last, data, offsets in blocks(batch.column(1), 4 << 20):
                counted = pc.value_counts(spelled(data, offsets, seeds[first:last]))
                words, n = counted.flatten()
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), n], ["word", "n"])
        release()

    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= times)


def _tile(longest: Column, prefix: Column, suffix: Column, below: Column) -> Column:
    """Tile name: hash of what is known and of the letters known. Two tiles of one name only share a comparison."""
    word = F.col("word")
    return F.xxhash64(longest, prefix, suffix, below, F.substring(word, F.lit(1), prefix), F.right(word, suffix))


def _with_tiles(rows: DataFrame, kinds: list[Column]) -> DataFrame:
    """A row for each word and each (longest, prefix, suffix, below) it falls under."""
    out = rows.withColumn("kind", F.explode(F.array(*kinds))).select("word", "n", "kind.*")
    out = out.filter("prefix < below and prefix + suffix <= longest - 1")
    return out.withColumn("tile", _tile(F.col("longest"), F.col("prefix"), F.col("suffix"), F.col("below")))


def _kind(longest: Column, prefix: Column, suffix: Column, below: Column) -> Column:
    named = zip((longest, prefix, suffix, below), ("longest", "prefix", "suffix", "below"), strict=True)
    return F.struct(*[c.cast("int").alias(name) for c, name in named])


def first_tiles(words: DataFrame) -> DataFrame:
    """(word, n, longest, prefix, suffix, below, tile): each word as the longer and as the shorter one of a pair.

    Either the prefix has half the common letters or more, or it has fewer and the suffix has the rest.
    """
    kinds = []
    for extra in (0, 1):
        longest = F.length("word") + extra
        half = F.floor(longest / 2)
        kinds += [_kind(longest, half, F.lit(0), longest + 1), _kind(longest, F.lit(0), longest - half, half)]
    return _with_tiles(words, kinds)


def halved(tiles: DataFrame) -> DataFrame:
    """The rows of tiles that leave more than one place open, in the two halves of their tile."""
    longest, prefix, suffix, below = (F.col(c) for c in ("longest", "prefix", "suffix", "below"))
    most = F.least(below - 1, longest - 1 - suffix)  # that the common prefix can matter
    cut = F.floor((prefix + most + 1) / 2)
    longer = _kind(longest, cut, suffix, below)
    shorter = _kind(longest, prefix, F.greatest(suffix, longest - cut), F.least(below, cut))
    return _with_tiles(tiles.select("word", "n", longest, prefix, suffix, below), [longer, shorter])


def tiles_of(words: DataFrame, most: int = TILE) -> DataFrame:
    """Tiles of two to ``most`` words, or of one open place, that hold every pair of near words once."""
    rows, ready = first_tiles(words), None
    while True:
        rows = staged(rows, "tiles")
        sizes = rows.groupBy("tile").agg(F.count("*").alias("size")).filter("size > 1")
        rows = staged(join_groups(rows, sizes, "tile", F.xxhash64("tile")), "tiles-sized")
        open_ = (F.col("size") > most) & (F.col("prefix") + F.col("suffix") < F.col("longest") - 1)
        done = rows.filter(~open_).drop("size")
        ready = done if ready is None else ready.union(done)
        rows = rows.filter(open_)
        if rows.isEmpty():
            return ready
        rows = halved(rows)


def code_points(words: list[bytes], width: int) -> np.ndarray:
    """Matrix of Latin-1 code points, a row for each word, padded with 0."""
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def near(left: np.ndarray, right: np.ndarray, left_size: np.ndarray, right_size: np.ndarray, prefix: int, suffix: int, below: int) -> np.ndarray:
    """Whether words differ by one edit and share at least ``prefix``, at least ``suffix`` letters, the prefix below ``below``.

    ``left`` and ``right`` are padded matrices. Words of ``left`` fill theirs, so
    nothing in common reaches the padding of the others, as 0 is no letter;
    suffixes are compared from each word's own end.
    """
    longest = left.shape[1]
    shape = (len(left), len(right))
    kind = np.uint8 if longest < 128 else np.int32

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        same, out = np.ones(shape, bool), np.zeros(shape, kind)
        for n in range(longest):
            same &= a[n][:, None] == b[n][None, :]
            if not same.any():
                break
            out += same
        return out

    def from_end(table: np.ndarray, size: np.ndarray) -> np.ndarray:
        place = size[:, None] - 1 - np.arange(longest)[None, :]
        return np.where(place >= 0, np.take_along_axis(table, np.maximum(place, 0), axis=1), 0).astype(np.uint8)

    front, back = common(left, right), common(from_end(left, left_size), from_end(right, right_size))
    differ = ~((front == longest) & (right_size[None, :] == left_size[:, None]))
    return differ & (front + back >= longest - 1) & (front >= prefix) & (front < below) & (back >= suffix)


def compare_tiles(table: pa.Table, most: int = TILE) -> pa.Table:
    """(word, near, form_n, form) for words of a task's tiles: near words there, and the best of them.

    Neighbouring tiles of one kind share a comparison: words of two of them
    have no common prefix and suffix of the kind's lengths, so no pair arises.
    """
    table = table.sort_by([(c, "ascending") for c in ("longest", "prefix", "suffix", "below", "tile", "word")])
    text = [w.encode("latin-1") for w in table["word"].to_pylist()]
    n = np.asarray(table["n"])
    size = np.array([len(w) for w in text])
    longest, prefix, suffix, below, tile = (np.asarray(table[c]) for c in ("longest", "prefix", "suffix", "below", "tile"))
    number = np.empty(len(text), np.int64)  # by word
    number[sorted(range(len(text)), key=text.__getitem__)] = np.arange(len(text))
    count, best = np.zeros(len(text), np.int64), np.full(len(text), -1)

    def better(rows: np.ndarray, other: np.ndarray) -> None:
        """``other`` is the new best of ``rows`` where it is more frequent, or as frequent and smaller."""
        have = best[rows]
        wins = (have < 0) | (n[other] > n[have]) | ((n[other] == n[have]) & (number[other] < number[have]))
        best[rows[wins]] = other[wins]

    def meet(a: np.ndarray, b: np.ndarray) -> None:
        """Compare the words a, of full length, with b."""
        width, at = int(longest[a[0]]), a[0]
        found = near(code_points([text[i] for i in a], width), code_points([text[i] for i in b], width), size[a], size[b],
                     int(prefix[at]), int(suffix[at]), int(below[at]))
        x, y = np.nonzero(found)
        shorter = size[b[y]] < width  # these pairs come once; those of one length from both sides
        for rows, other in ((a[x], b[y]), (b[y[shorter]], a[x[shorter]])):
            np.add.at(count, rows, 1)
            order = np.lexsort((number[other], -n[other], rows))
            lead = order[np.append(True, rows[order][1:] != rows[order][:-1])] if len(rows) else order
            better(rows[lead], other[lead])

    def changes(*columns: np.ndarray) -> np.ndarray:
        new = np.ones(len(text), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        return np.append(np.flatnonzero(new), len(text))

    kinds = changes(longest, prefix, suffix, below)
    tiles = changes(longest, prefix, suffix, below, tile)
    for low, high in zip(kinds[:-1], kinds[1:], strict=True):
        cuts = tiles[(tiles >= low) & (tiles <= high)]
        at = 0
        while at < len(cuts) - 1:
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + most, "right")) - 1)
            rows = np.arange(cuts[at], cuts[to])
            full = rows[size[rows] == longest[rows[0]]]
            step = max(1, min(most, (8 << 20) // int(longest[rows[0]])))
            for i in range(0, len(full), step):
                for j in range(0, len(rows), step):
                    meet(full[i : i + step], rows[j : j + step])
            at = to
    own = pa.array(np.flatnonzero(count))
    form = pa.array(best[count > 0])
    return pa.table({"word": table["word"].take(own), "near": pa.array(count[count > 0]), "form_n": table["n"].take(form),
                     "form": table["word"].take(form)})


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that is reached from each ``word`` by ``form``; each round doubles the steps taken."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = join_groups(now, after, "root", F.xxhash64("root"), "left")
        step = staged(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.filter("moved").isEmpty():
            return now
        now = step.drop("moved")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = TIMES, most: int = TILE) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]`` in whole texts with A-Z in lower
    case. A run whose unsigned CRC-32 of "<key>:<run>" is divisible by 97 loses
    the code point at that number modulo its length; a null key counts as no
    characters there. Words with fewer than 5 code points or ``times``
    occurrences are left out. ``form`` is the near word of largest n, ties to the
    smaller in code-point order, if that has ``RATIO`` times the word's n.
    Null and empty texts have no words; every row counts, repeated ones too.
    """
    words = staged(word_counts(docs, key, text, times), "words")
    tiles = staged(tiles_of(words, most), "tiles-ready")
    count = max(LEAST_BUCKETS, -(-tiles.count() // BUCKET))
    bucket = F.pmod(F.xxhash64("tile", F.lit(1)), F.lit(count)).cast("int")
    met = tiles.withColumn("bucket", bucket).repartition(count, "bucket").groupBy("bucket").applyInArrow(
        lambda t: compare_tiles(t, most), "word string, near long, form_n long, form string"
    )
    first = F.min(F.struct((-F.col("form_n")).alias("back"), "form"))
    met = met.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("best"))
    met = met.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.back")).alias("form_n"))
    known = words.join(met, "word", "left").withColumn("good", F.col("form_n") >= RATIO * F.col("n"))
    known = staged(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("good"), F.col("form")).alias("form"), F.when(F.col("good"), F.col("form_n")).alias("form_n"),
    ), "forms")
    last = roots(known.filter("form is not null"))
    return known.join(last, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))
