"""Hard-negative mining with exact integer scores by the method of the Four Russians.

Components become integers. A row's integers are cut into bit planes, and eight
dimensions of one plane into one byte. For each anchor and each group of eight
dimensions a table holds the sums of all 256 subsets of the anchor's components.
The inner product is then a sum of looked-up, shifted table entries, one for
each group and plane; the highest plane counts negative (two's complement).

Anchors and candidates meet in blocks: a task scores one block of anchors
against one block of rows and gives back a few rows for each anchor. All rows
are scored twice, first for the positives, then, when the bands are known, for
the negatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hailbook.llm.common import staged

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score that a negative may have
SCALE = 256
LARGEST = 1 << 27  # integers stay below, so that scores fit 64 bits
ANCHOR_BLOCK, BLOCK = 4096, 8192  # rows of a side of a task
LEAST = 16  # blocks of rows, at least
AT_ONCE = 128  # anchors whose tables are held at once
MOST_TASKS = 20_000  # of one step; more blocks share tasks
BODY = "vec_id long, label long, planes int, bits binary"


def packed(values: np.ndarray) -> list[tuple[int, bytes]]:
    """(planes, bytes by plane and group) of each row of integers; as few planes as the row needs."""
    rows, dims = values.shape
    groups = -(-dims // 8)
    padded = np.zeros((rows, groups * 8), np.int64)
    padded[:, :dims] = values
    spread = np.max(np.where(padded < 0, ~padded, padded), axis=1, initial=0)
    count = [int(s).bit_length() + 1 for s in spread]
    out = []
    for row, planes in zip(padded, count, strict=True):
        bits = (row[None, :] >> np.arange(planes)[:, None]) & 1
        out.append((planes, np.packbits(bits.astype(np.uint8).reshape(planes, groups, 8), axis=2, bitorder="little").tobytes()))
    return out


def vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, planes, bits) of the rows that take part; see ``hard_negatives``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            whole = lists.flatten()
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))
            flat = np.floor(SCALE * np.asarray(whole.fill_null(np.nan), np.float64))
            fits = np.abs(flat) < LARGEST  # false for nan and infinity
            keep, found = [], []
            for n, (a, b) in enumerate(zip(np.append(0, ends[:-1])[: len(ends)], ends, strict=True)):
                if fits[a:b].all():
                    keep.append(n)
                    found.append(packed(flat[a:b].astype(np.int64)[None, :])[0])
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take),
                 pa.array([p for p, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())],
                ["vec_id", "label", "planes", "bits"],
            )

    columns = [F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")]
    whole = rows.select(*columns).na.drop()
    first = F.min(F.struct("label", "planes", "bits")).alias("row")
    return whole.mapInArrow(run, BODY).groupBy("vec_id").agg(first).select("vec_id", "row.*")


def plane_table(planes: np.ndarray, bits: pa.Array) -> np.ndarray:
    """uint8 (plane, row, group); rows with fewer planes repeat their sign, those with fewer groups end in zeros."""
    sizes = np.array([len(b.as_buffer()) for b in bits], np.int64)
    groups = np.where(planes > 0, sizes // np.maximum(planes, 1), 0)
    out = np.zeros((planes.max(initial=1), len(planes), groups.max(initial=0)), np.uint8)
    for p, g in sorted(set(zip(planes.tolist(), groups.tolist(), strict=True))):
        own = np.flatnonzero((planes == p) & (groups == g))
        raw = np.frombuffer(b"".join(bits[int(n)].as_py() for n in own), np.uint8).reshape(len(own), p, g)
        out[:p, own, :g] = raw.transpose(1, 0, 2)
        out[p:, own, :g] = raw[:, -1]
    return out


def integers(table: np.ndarray) -> np.ndarray:
    """int64 (row, dimension) of a plane table."""
    planes, rows, groups = table.shape
    out = np.zeros((rows, groups * 8), np.int64)
    for p in range(planes):
        bits = np.unpackbits(table[p], axis=1, bitorder="little").astype(np.int64)
        out += -(bits << p) if p == planes - 1 else bits << p
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(group, subset of its eight dimensions, anchor): the sum of the anchor's components in the subset."""
    count, dims = anchors.shape
    parts = anchors.reshape(count, dims // 8, 8)
    out = np.zeros((dims // 8, 256, count), np.int64)
    for j in range(8):
        out[:, 1 << j : 2 << j] = out[:, : 1 << j] + parts[:, :, j].T[:, None, :]
    return out


def scores(anchors: np.ndarray, table: np.ndarray) -> np.ndarray:
    """int64 (anchor, row): inner products of integer ``anchors`` with the rows of a plane table, by shift and add."""
    planes, rows, groups = table.shape
    sums = subset_sums(anchors)
    total = np.abs(anchors).sum(axis=1).max(initial=0)
    kind = np.int32 if int(total) << planes < 1 << 31 else np.int64
    sums = sums.astype(kind)
    out = np.zeros((rows, len(anchors)), kind)
    for g in range(min(groups, len(sums))):
        for p in range(planes):
            part = sums[g][table[p, :, g]]
            part <<= p
            if p == planes - 1:
                out -= part
            else:
                out += part
    return np.ascontiguousarray(out.T).astype(np.int64)


class Side:
    """The anchors (side 0) or the rows (side 1) of a task, by key."""

    def __init__(self, task: pa.Table, side: int):
        own = task.filter(pc.equal(task["side"], side)).sort_by("vec_id").combine_chunks()
        self.keys, self.labels = (np.asarray(own[c]).astype(np.int64) for c in ("vec_id", "label"))
        bits = own["bits"].combine_chunks() if own.num_rows else pa.array([], pa.binary())
        self.table = plane_table(np.asarray(own["planes"]).astype(np.int64), bits)
        self.wanted = own["wanted"].to_pylist()


def scored(task: pa.Table) -> Iterator[tuple[int, int, list | None, np.ndarray, Side]]:
    """(key, label, wanted, scores of all rows, rows) for each anchor of a task."""
    anchors, rows = Side(task, 0), Side(task, 1)
    if not len(anchors.keys) or not len(rows.keys):
        return
    for at in range(0, len(anchors.keys), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        found = scores(integers(anchors.table[:, part]), rows.table)
        for n, score in enumerate(found, at):
            yield int(anchors.keys[n]), int(anchors.labels[n]), anchors.wanted[n], score, rows


def best(score: np.ndarray, among: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` of the rows ``among``, in key order, by descending score, then key."""
    if len(among) > 4 * count:  # all that are at least as good as the last one wanted
        least = np.partition(score[among], len(among) - count)[len(among) - count]
        among = among[score[among] >= least]
    return among[np.argsort(-score[among], kind="stable")][:count]


def task_positives(task: pa.Table, count: int) -> pa.Table:
    """The ``count`` best rows of each anchor's label."""
    out: list[tuple[int, int, int]] = []
    places: dict[int, np.ndarray] = {}
    for key, label, _, score, rows in scored(task):
        if label not in places:
            places[label] = np.flatnonzero(rows.labels == label)
        own = places[label]
        own = best(score, own[rows.keys[own] != key], count)
        out += [(key, k, s) for k, s in zip(rows.keys[own].tolist(), score[own].tolist(), strict=True)]
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "positive_id", "positive_score"])


def task_negatives(task: pa.Table, count: int, low: int, high: int) -> pa.Table:
    """The ``count`` best rows of other labels in the band of each anchor and positive."""
    out: list[tuple[int, ...]] = []
    for key, label, wanted, score, rows in scored(task):
        bands = [(w["positive_id"], w["positive_score"]) for w in wanted]
        ends = [p for _, p in bands]
        maybe = np.flatnonzero((rows.labels != label) & (100 * score >= low * min(ends)) & (100 * score <= high * max(ends)))
        order = maybe[np.argsort(-score[maybe], kind="stable")]
        down = -100 * score[order]  # ascending
        for positive, worth in bands:
            a, b = np.searchsorted(down, -high * worth, "left"), np.searchsorted(down, -low * worth, "right")
            own = order[a : min(b, a + count)] if a < b else order[:0]
            out += [(key, positive, worth, k, s) for k, s in zip(rows.keys[own].tolist(), score[own].tolist(), strict=True)]
    columns = list(zip(*out, strict=True)) or [()] * 5
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


def _blocks(key: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def in_tasks(anchors: DataFrame, rows: DataFrame, anchor_blocks: int, row_blocks: int,
             step: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``step`` over every block of anchors (with ``wanted``) met by every block of rows."""
    body = ["vec_id", "label", "planes", "bits"]
    every = F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))
    left = anchors.select(_blocks(F.col("vec_id"), anchor_blocks).alias("i"), every.alias("j"), F.lit(0).alias("side"), *body, "wanted")
    every = F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1)))
    none = F.lit(None).cast(anchors.schema["wanted"].dataType).alias("wanted")
    right = rows.select(every.alias("i"), _blocks(F.col("vec_id"), row_blocks).alias("j"), F.lit(1).alias("side"), *body, none)
    tasks = min(anchor_blocks * row_blocks, MOST_TASKS)  # named, or they would be merged by their few bytes
    return left.union(right).repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(step, schema)


def hard_negatives(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                   anchors: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Each component x becomes floor(256 x). Rows without key, label or vector, with a
    null or non-finite component, or with an integer of 2**27 or more take no
    part. Of rows with one key the least by label and vector counts. Vectors
    of different lengths are filled up with zeros; an empty one scores 0.
    ``anchors``: a condition over vec_id and label; by default keys divisible by
    100. Positives are the ``positives`` rows of the anchor's label with the
    highest scores, negatives the first ``negatives`` of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score; ties
    go to the smaller key. Anchors without a positive, and positives without a
    negative, give no row.
    """
    rows = staged(vectors(rows, key, vector, label), "vectors")
    chosen = rows.filter(F.col("vec_id") % 100 == 0 if anchors is None else anchors)
    row_blocks = max(LEAST, -(-rows.count() // BLOCK))
    anchor_blocks = max(1, -(-chosen.count() // ANCHOR_BLOCK))
    kind = "array<struct<positive_id:long,positive_score:long>>"
    bare = chosen.withColumn("wanted", F.lit(None).cast(kind))
    schema = "anchor_id long, positive_id long, positive_score long"
    found = in_tasks(bare, rows, anchor_blocks, row_blocks, lambda t: task_positives(t, positives), schema)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    wanted = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("wanted"))
    wanted = staged(wanted, "positives")
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = in_tasks(chosen.join(wanted, "vec_id"), rows, anchor_blocks, row_blocks, lambda t: task_negatives(t, negatives, low, high), schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(rows: DataFrame) -> DataFrame:
    """Every seventh key with the next label: rows whose label is noise."""
    label = F.col("label").cast("long")
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


SQL = f"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor({SCALE} * x::double)) as e
  from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
    list_inner_product(a.e, b.e)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= {POSITIVES})
select p.anchor_id, positive_id, row_number() over best as rank, other_id as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and not same
  and {LOW} * positive_score <= 100 * score and 100 * score <= {HIGH} * positive_score
window best as (partition by p.anchor_id, positive_id order by score desc, other_id)
qualify row_number() over best <= {NEGATIVES}
"""
