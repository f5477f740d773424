"""Quality classifier by co-training of a text view and a metadata view.

Every document gets content features once. Each view has a linear discriminant,
made of counts, sums and products of its rows' features by class. These add up,
so all labelled and all unlabelled rows take part, whatever their number, and
only the totals reach the driver. In each round each view labels the unlabelled
rows that it is sure of, for the other view. The views are then calibrated on
labelled rows kept apart, by counts per step of log odds, and their log odds are
added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hailbook.llm.arrays import blocks, release, word_hashes, words
from hailbook.llm.common import documents, join_groups, staged

ROUNDS = 4
SURE = 0.97  # confidence of a pseudo-label
LARGEST = 4.0  # features are cut there; rates and logarithms of lengths are below
RIDGE = 0.05  # added to the correlations of features
FLOOR = 0.02  # least standard deviation of a feature
STEPS = 601  # of log odds from -30 to 30, for calibration
SECRET = 0x9E3779B97F4A7C15F39CC0605CEDC835  # for hashes that are only compared within a text
BUCKETS = 24  # of source, and of language, in the metadata view

_CLASSES = np.zeros((8, 256), bool)
_CLASSES[0, ord("a") : ord("z") + 1] = True
_CLASSES[1, ord("A") : ord("Z") + 1] = True
_CLASSES[2, ord("0") : ord("9") + 1] = True
_CLASSES[3, [0x20, 0x09]] = True
_CLASSES[4, 0x0A] = True
_CLASSES[5, list(b".,;:'-()")] = True
_CLASSES[6, list(b"!\"#$%&*+/<=>?@[\\]^_`{|}~")] = True
_CLASSES[7, 0x80:] = True
FEATURES = 18


def content_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) of rates and lengths; an empty text has zeros."""
    rows = len(offsets) - 1
    out = np.zeros((rows, FEATURES))
    size = np.maximum(np.diff(offsets), 1)

    def per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[ends])

    for n, marks in enumerate(_CLASSES):
        out[:, n] = per_text(marks[data], offsets) / size
    starts, ends, first = words(data, offsets)
    if len(starts):
        count = np.maximum(np.diff(first), 1)
        length = (ends - starts).astype(np.float64)
        of = np.repeat(np.arange(rows), np.diff(first))
        h = word_hashes(data, starts, ends, SECRET)
        out[:, 8] = per_text(length, first) / count / 10
        out[:, 9] = np.sqrt(np.maximum(per_text(length**2, first) / count - (per_text(length, first) / count) ** 2, 0)) / 10
        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        out[:, 10] = per_text(again, first) / count
        keyed = np.sort(h ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.lexsort((h, of)) if len(np.unique(keyed)) < len(keyed) else None
        if order is None:
            out[:, 11] = np.diff(first) / count
        else:
            new = np.ones(len(h))
            new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
            out[:, 11] = per_text(new, first) / count
        last, begin = data[ends - 1], data[starts]
        out[:, 12] = per_text(_CLASSES[6][last], first) / count
        out[:, 13] = per_text(_CLASSES[5][last], first) / count
        out[:, 14] = per_text(_CLASSES[1][begin] & _CLASSES[1][last], first) / count
        out[:, 15] = per_text(length == 1, first) / count
        out[:, 16] = per_text(length > 20, first) / count
        out[:, 17] = np.log1p(np.diff(first)) / 10
    return out


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
             lang: str = "lang", n_chars: str = "n_chars") -> DataFrame:
    """(doc_id, source, lang, n_chars, content array<double>) of every whole text; null is empty."""
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"),
        F.col(n_chars).cast("double").alias("n_chars"), F.col(text).alias("text"),
    )
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column(4), 1 << 20):
                found = content_features(data, offsets)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(found) + 1) * FEATURES, pa.int32()), pa.array(found.ravel())
                )
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], lists], ["doc_id", "source", "lang", "n_chars", "content"]
                )
        release()

    return rows.mapInArrow(run, f"doc_id {kind}, source string, lang string, n_chars double, content array<double>")


def with_views(rows: DataFrame) -> DataFrame:
    """Adds ``meta array<double>``: one-hot source and language buckets, length and length squared (log), nulls."""
    def hot(name: str):
        bucket = F.pmod(F.xxhash64(name), F.lit(BUCKETS))
        return F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: (i == bucket).cast("double"))

    size = F.log1p(F.greatest(F.coalesce(F.col("n_chars"), F.lit(0.0)), F.lit(0.0))) / 10
    return rows.withColumn("meta", F.concat(hot("source"), hot("lang"), F.array(size, size * size, F.col("n_chars").isNull().cast("double"))))


class Discriminant:
    """Linear discriminant of two classes from ``moments``: rows of (count, sums, products) by class."""

    def __init__(self, moments: np.ndarray, width: int):
        count, total = moments[:, 0], moments[:, 1 : 1 + width]
        mean = total / count[:, None]
        products = moments[:, 1 + width :].sum(0).reshape(width, width)
        within = (products - (mean * count[:, None]).T @ mean) / count.sum()
        scale = np.sqrt(np.maximum(np.diag(within), 0) + FLOOR**2)
        inner = within / np.outer(scale, scale) + RIDGE * np.eye(width)
        self.w = np.linalg.solve(inner, (mean[1] - mean[0]) / scale) / scale
        self.b = np.log(count[1] / count[0]) - self.w @ mean.sum(0) / 2

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.w + self.b, -30, 30)


def moments(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(2, 1 + width + width * width): count, sums and products of the rows of label 0 and of label 1."""
    out = []
    for c in (0, 1):
        own = x[label == c]
        out.append(np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()]))
    return np.array(out)


class Calibration:
    """Logistic regression on log odds from ``counts`` (2, STEPS), by Newton steps; a ridge holds the slope near 0."""

    def __init__(self, counts: np.ndarray, ridge: float = 0.1):
        at = np.linspace(-30, 30, STEPS)
        z, total = np.stack([at, np.ones(STEPS)], axis=1), counts.sum(0)
        self.slope, self.shift = 0.0, 0.0
        penalty = np.array([ridge, 1e-3])
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (total * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, z.T @ (total * p - counts[1]) + penalty * w)
            w = w - step * min(1.0, 1 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        self.slope, self.shift = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x * self.slope + self.shift, -30, 30)


#: (content, meta, label, apart) of some rows -> numbers that add up over rows. Label -1: none.
Measure = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class CoTrained:
    """Two calibrated views.

    ``summed`` gives the sum of a measure over all rows. ``labelled``: whether
    both classes have labels; without them there is no model. ``added``: rows
    that each view labelled for the other in the last round. Pseudo-labels of a
    class weigh as much as its labels, at most, however many they are.
    """

    def __init__(self, summed: Callable[[Measure], np.ndarray], widths: tuple[int, int]):
        self.added = [0, 0]
        sizes = [2 * (1 + w + w * w) for w in widths]

        def own_moments(content, meta, label, apart):
            parts = [moments(x, np.where(apart == side, label, -1)) for x in (content, meta) for side in (False, True)]
            return np.concatenate([m.ravel() for m in parts])

        found = np.split(summed(own_moments), np.cumsum([sizes[0], sizes[0], sizes[1]]))
        both = [[m.reshape(2, -1) for m in found[:2]], [m.reshape(2, -1) for m in found[2:]]]
        count = [m[:, 0] for m in both[0]]
        self.labelled = bool(np.all(count[0] + count[1] > 0))
        if not self.labelled:
            return
        split = bool(np.all(count[0] > 0) and np.all(count[1] > 0))  # else all labels serve both ends
        known = [m[0] if split else m[0] + m[1] for m in both]
        self.views = [Discriminant(m, w) for m, w in zip(known, widths, strict=True)]
        for _ in range(ROUNDS):
            teachers = self.views

            def sure(content, meta, label, apart, teachers=teachers):
                views, out = (content, meta), []
                for student in (0, 1):
                    p = 1 / (1 + np.exp(-teachers[1 - student].logit(views[1 - student])))
                    given = np.where(p >= SURE, 1, np.where(p <= 1 - SURE, 0, -1))
                    out.append(moments(views[student], np.where(label < 0, given, -1)).ravel())
                return np.concatenate(out)

            taught = [m.reshape(2, -1) for m in np.split(summed(sure), [sizes[0]])]
            self.added = [int(taught[1][:, 0].sum()), int(taught[0][:, 0].sum())]
            self.views = [
                Discriminant(k + t * np.minimum(1, k[:, 0] / np.maximum(t[:, 0], 1))[:, None], w)
                for k, t, w in zip(known, taught, widths, strict=True)
            ]
        views = self.views

        def steps(content, meta, label, apart):
            out = np.zeros((2, 2, STEPS))
            held = (label >= 0) & (apart if split else True)
            for v, x in enumerate((content, meta)):
                step = np.rint((views[v].logit(x[held]) + 30) * ((STEPS - 1) / 60)).astype(np.int64)
                np.add.at(out[v], (label[held], step), 1)
            return out.ravel()

        counts = summed(steps).reshape(2, 2, STEPS)
        self.calibrations = [Calibration(c) for c in counts]
        total = count[0] + count[1]
        self.prior = float(np.log(total[1] / total[0]))

    def scores(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """(rows, 3): content view, metadata view, both; each a calibrated probability."""
        odds = [
            c.logit(m.logit(v))
            for c, m, v in zip(self.calibrations, self.views, (content, meta), strict=True)
        ]
        return 1 / (1 + np.exp(-np.clip(np.stack([*odds, odds[0] + odds[1] - self.prior], axis=1), -30, 30)))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.clip(np.asarray(column.flatten()).reshape(rows, -1), 0, LARGEST)


def with_labels(table: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``table`` with ``label``: 1 or 0, or -1 where there is none; the largest if a key has several.

    Null labels and keys are left out; rows without a key keep away from the join.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(
        F.max(F.col(label) > 0).cast("int").alias("label")
    )
    keyed = join_groups(table.filter("doc_id is not null"), known, "doc_id", F.xxhash64("doc_id"), "left")
    return keyed.withColumn("label", F.coalesce("label", F.lit(-1))).unionByName(
        table.filter("doc_id is null").withColumn("label", F.lit(-1))
    )


def fit(table: DataFrame) -> CoTrained | None:
    """Co-train on all rows of ``with_labels``; None without labels of both classes.

    Every fourth label, by key hash, is kept apart for calibration. Each pass
    brings the totals of every task together by cell; their number depends on
    the widths of the views alone.
    """
    rows = table.select("content", "meta", "label", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3).alias("apart"))
    widths = FEATURES, 2 * BUCKETS + 3

    def summed(measure: Measure) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    content, meta = (_matrix(batch.column(n), batch.num_rows) for n in (0, 1))
                    own = measure(content, meta, np.asarray(batch.column(2)), batch.column(3).to_numpy(zero_copy_only=False))
                    total = own if total is None else total + own
            if total is not None:
                cells = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "value"])

        cells = rows.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        none = np.zeros((0, widths[0])), np.zeros((0, widths[1])), np.zeros(0, np.int64), np.zeros(0, bool)
        out = np.zeros(len(measure(*none)))
        for cell, value in cells:
            out[cell] = value
        return out

    model = CoTrained(summed, widths)
    return model if model.labelled else None


def score(table: DataFrame, model: CoTrained | None) -> DataFrame:
    """One row per row of ``table``: doc_id, content_score, metadata_score, score (0 to 1), kept (score >= 0.5).

    Without a model (no labels of both classes) every score is 0.5.
    """
    kind = table.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            content, meta = (_matrix(batch.column(n), rows) for n in (1, 2))
            out = model.scores(content, meta) if model else np.full((rows, 3), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(out[:, n]) for n in range(3)), pa.array(out[:, 2] >= 0.5)],
                ["doc_id", "content_score", "metadata_score", "score", "kept"],
            )

    columns = f"doc_id {kind}, content_score double, metadata_score double, score double, kept boolean"
    return table.select("doc_id", "content", "meta").mapInArrow(run, columns)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents (see ``score``); labels: (doc_id, quality 0/1). Rows that repeat a key are scored each."""
    table = with_views(staged(with_labels(staged(features(docs), "quality-features"), labels), "quality-labelled"))
    return score(table, fit(table))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
