"""Language ID with a byte convolutional network.

Filters of several widths run over one-hot bytes of fixed-length windows; max
pooling, ReLU and softmax follow. The network is trained in numpy on the driver
on a bounded sample of labelled text (``SLOTS`` pieces of ``PIECE`` characters
per language) and applied to all windows of every whole text. Over one-hot bytes
a filter is a table, and two tables make one over byte pairs, so a window costs
a few table reads per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from hailbook.llm.arrays import blocks, release
from hailbook.llm.common import documents

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
SLOTS = 192  # labelled pieces per language, at most
PIECE = 1024  # characters of a piece
UNKNOWN = "und"


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of each text, the last one filled up with zeros, and each text's first window number."""
    lengths = np.diff(offsets)
    counts = -(-lengths // size)
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(first[-1] * size, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * size - offsets[:-1], lengths)] = data
    return out.reshape(-1, size), first


@dataclass
class Network:
    """``tables[w][j, byte, filter]``: weight of a byte at place j of a filter of width w."""

    langs: list[str]
    tables: dict[int, np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def pairs(self) -> None:
        """Tables over byte pairs, for use."""
        self.pair = {
            (w, j): (t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1)
            for w, t in self.tables.items()
            for j in range(0, w - 1, 2)
        }

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """ReLU of the largest response of each filter in each window."""
        if not hasattr(self, "pair"):
            self.pairs()
        pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        out = []
        for w, t in self.tables.items():
            span = x.shape[1] - w + 1
            total = None
            for j in range(0, w - 1, 2):
                part = self.pair[w, j].take(pair[:, j : j + span], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            if w % 2:
                total += t[w - 1].take(x[:, w - 1 : w - 1 + span], axis=0)
            out.append(total.max(axis=1))
        return np.maximum(np.concatenate(out, axis=1) + self.bias, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.pooled(x) @ self.weights + self.offset)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(pieces: list[bytes], labels: list[str], epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network | None:
    """Adam on the cross entropy of windows; None if there is nothing to learn from."""
    langs = sorted(set(labels))
    ends = np.cumsum([0, *map(len, pieces)])
    x, first = windows(np.frombuffer(b"".join(pieces), np.uint8), ends)
    if not len(x):
        return None
    y = np.repeat([langs.index(label) for label in labels], np.diff(first))
    rng = np.random.default_rng(seed)
    total = len(WIDTHS) * FILTERS
    net = Network(
        langs,
        {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(total, np.float32),
        rng.normal(0, 0.3, (total, len(langs))).astype(np.float32),
        np.zeros(len(langs), np.float32),
    )
    values = [*net.tables.values(), net.bias, net.weights, net.offset]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            xb, best, peak = x[own], [], []
            for w, t in net.tables.items():
                span = WINDOW - w + 1
                response = sum(t[j].take(xb[:, j : j + span], axis=0) for j in range(w))
                place = response.argmax(axis=1)
                best.append(place)
                peak.append(np.take_along_axis(response, place[:, None, :], 1)[:, 0])
            before = np.concatenate(peak, axis=1) + net.bias
            hidden = np.maximum(before, 0)
            slope = softmax(hidden @ net.weights + net.offset)
            slope[np.arange(len(own)), y[own]] -= 1
            slope /= len(own)
            back = (slope @ net.weights.T) * (before > 0)
            gradients = []
            rows, filters = np.indices((len(own), FILTERS))
            for n, (w, t) in enumerate(net.tables.items()):
                g = np.zeros_like(t)
                for j in range(w):
                    np.add.at(g[j], (xb[rows, best[n] + j], filters), back[:, n * FILTERS : (n + 1) * FILTERS])
                gradients.append(g)
            gradients += [back.sum(0), hidden.T @ slope, slope.sum(0)]
            step += 1
            for value, g, (m, v) in zip(values, gradients, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def labelled_sample(docs: DataFrame, key: str, text: str, lang: str, slots: int = SLOTS) -> list:
    """At most ``slots`` pieces per language, out of rows that are not held out.

    Each slot takes the row with the least hash among its rows, combined before
    the shuffle; the piece starts at a hashed place. Key and text are hashed
    together, so rows of one key or of none spread over the slots, rows equal in
    both give one piece, and of equal hashes the least piece counts: the sample
    is the same however the rows are spread.
    """
    pick = F.xxhash64(F.col(key), F.col(text), F.lit("sample"))
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~F.coalesce(held_out(F.col(key)), F.lit(False)))
    # of a frequent language only as many rows go on as fill the slots some 50 times over
    counts = rows.groupBy(F.col(lang).alias("lang")).count().filter(F.col("count") > 50 * slots).collect()
    if counts:
        share = F.create_map(*[F.lit(v) for row in counts for v in (row["lang"], 50 * slots / row["count"])])
        draw = F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit("draw")), F.lit(1 << 30)) / (1 << 30)
        rows = rows.filter(draw < F.coalesce(F.element_at(share, F.col(lang)), F.lit(1.0)))
    start = F.pmod(pick, F.greatest(F.length(text) - PIECE, F.lit(0)) + 1).cast("int") + 1
    chosen = rows.select(
        F.col(lang).alias("lang"), pick.alias("pick"), F.pmod(pick, F.lit(slots)).alias("slot"),
        F.substring(F.col(text), start, F.lit(PIECE)).alias("piece"),
    )
    least = chosen.groupBy("lang", "slot").agg(F.min(F.struct("pick", "piece")).alias("least"))
    return least.select("lang", "slot", "least.piece").orderBy("lang", "slot").collect()


def _identified(rows: DataFrame, net: Network | None) -> DataFrame:
    """Adds lang_pred and score to rows whose last two columns are text and letters, and takes these two away."""
    carried = rows.columns[:-2]
    schema = StructType([*rows.schema.fields[:-2], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, letter = batch.column(len(carried)), batch.column(len(carried) + 1)
            for begin, end, data, offsets in blocks(texts, 1 << 20):
                x, first = windows(data, offsets)
                mean = np.zeros((end - begin, len(net.langs) if net else 1))
                some = np.flatnonzero(np.diff(first))
                if net and len(some):
                    p = np.concatenate([net.probabilities(x[at : at + 256]) for at in range(0, len(x), 256)])
                    mean[some] = np.add.reduceat(p, first[some], axis=0, dtype=np.float64) / np.diff(first)[some, None]
                letters = letter.slice(begin, end - begin).to_numpy(zero_copy_only=False).astype(bool)
                sure = letters & (mean.max(axis=1) > 0)
                names = np.array(net.langs if net else [UNKNOWN], dtype=object)[mean.argmax(axis=1)]
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[: len(carried)],
                        pa.array(np.where(sure, names, UNKNOWN), pa.string()),
                        pa.array(np.where(sure, np.minimum(mean.max(axis=1), 1.0), 0.0), pa.float64()),
                    ],
                    [*carried, "lang_pred", "score"],
                )
        release()

    return rows.mapInArrow(run, schema)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score.

    The text alone decides. Null, empty and letterless texts are ``und`` with
    score 0, and so is every text if nothing was learnt. The score is the mean
    probability of the predicted language over the windows of the whole text.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), has_letter(F.col(text)).alias("letters"))
    return _identified(rows, net)


def accepted(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Rows and columns of ``docs`` whose text has a language; without a network, whose text has a letter."""
    if net is None:
        return docs.filter(has_letter(F.col(text)))
    carried = [F.col(f"`{name}`").alias(f"c{n}") for n, name in enumerate(docs.columns)]
    rows = docs.select(*carried, F.col(text).alias("text"), has_letter(F.col(text)).alias("letters"))
    found = _identified(rows, net).filter(F.col("lang_pred") != UNKNOWN)
    return found.select(*[F.col(f"c{n}").alias(name) for n, name in enumerate(docs.columns)])


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    rows = labelled_sample(docs, key, text, lang)
    return train([row["piece"].encode() for row in rows], [row["lang"] for row in rows])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
