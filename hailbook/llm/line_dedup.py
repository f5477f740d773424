"""Line dedup by levelled sorted runs of line hashes.

A run is a table (line, n), bucketed and sorted by the 128-bit hash of a line's
key: in how many documents of its batches the line is. Each new batch of
documents counts its lines, merge-anti-joins what the runs already know to be
common and adds the rest as a run of level 0. ``fanout`` runs of a level are
merged into one of the next, so there are only logarithmically many, and each
count is rewritten once a level. Runs share their buckets, so merges and joins
move none of their rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hailbook.bucketed import default_buckets, read_bucketed, write_bucketed
from hailbook.llm.common import documents, join_groups, staged
from hailbook.session import shared_folder

THRESHOLD = 10  # documents that make a line common
FANOUT = 4  # runs of a level that are merged into one
BATCHES = 4  # of one table
RUN = "line binary, n bigint"


def line_key(line: bytes) -> bytes:
    """Without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case."""
    return line.strip().lower()  # of bytes: ASCII only


def line_hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class LineRuns:
    """The runs below ``folder``. One writer at a time; a batch name counts once, also after a restart.

    ``state/v=N`` names the runs there are after N steps, and is the only thing
    that makes a run count: a run whose step broke off is never read.
    """

    def __init__(self, spark: SparkSession, folder: str, threshold: int = THRESHOLD, fanout: int = FANOUT,
                 buckets: int | None = None):
        self.spark, self.folder, self.threshold, self.fanout = spark, folder, threshold, fanout
        self.buckets = buckets or default_buckets(spark)
        self.version, self.runs, self.names = 0, [], set()

    @classmethod
    def load(cls, spark: SparkSession, folder: str, threshold: int = THRESHOLD, fanout: int = FANOUT) -> LineRuns:
        """The store as the last whole step left it."""
        states = spark.read.parquet(f"{folder}/state").collect()  # a few rows a step
        out = cls(spark, folder, threshold, fanout, states[0]["buckets"])
        out.version = max(s["v"] for s in states)
        out.names = {s["batch"] for s in states if s["batch"] is not None}
        out.runs = [(s["level"], s["run"]) for s in states if s["v"] == out.version and s["run"] is not None]
        return out

    def _commit(self, runs: list[tuple[int, str]], batch: str | None) -> None:
        rows = [(level, run, None, self.buckets) for level, run in runs] + [(None, None, batch, self.buckets)]
        state = self.spark.createDataFrame(rows, "level int, run string, batch string, buckets int")
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state/v={self.version + 1}")
        self.version, self.runs = self.version + 1, runs
        if batch is not None:
            self.names.add(batch)

    def _read(self, run: str) -> DataFrame:
        return read_bucketed(self.spark, run, RUN, "line", self.buckets)

    def _write(self, counts: DataFrame) -> str:
        run = f"{self.folder}/run-{self.version + 1}-{uuid.uuid4().hex}"  # a step that broke off may have left files
        write_bucketed(counts, run, "line", self.buckets)
        return run

    def fresh(self, sets: DataFrame) -> DataFrame:
        """(line, n) of the lines of ``sets`` that no run holds as common: a merge with each run, largest first."""
        counts = sets.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count("*").alias("n"))
        for _, run in sorted(self.runs, reverse=True):
            known = self._read(run).filter(F.col("n") >= self.threshold).select("line")
            counts = counts.join(known.hint("merge"), "line", "left_anti")
        return counts

    def add(self, batch: str, sets: DataFrame) -> None:
        """Take in a batch of documents, ``sets`` (lines array<binary>) with a row and distinct lines for each."""
        if batch in self.names:
            return
        self._commit([*self.runs, (0, self._write(self.fresh(sets)))], batch)
        self.compact()

    def compact(self) -> None:
        level = 0
        while any(at >= level for at, _ in self.runs):
            own = [run for at, run in self.runs if at == level]
            if len(own) >= self.fanout:
                rest = [r for r in self.runs if r[0] != level]
                self._commit([*rest, (level + 1, self._write(self.merged(own)))], None)
            level += 1

    def merged(self, runs: list[str]) -> DataFrame:
        """(line, n) over several runs. They are bucketed alike, so their union is grouped where it lies.

        A union of bare bucketed scans is read by columns and then loses the
        buckets it claims to have (seen with Spark 4.1.2: keys stay apart). The
        filter, true of every row, makes each side rows, which keeps them.
        """
        out = self._read(runs[0]).filter("n > 0")
        for run in runs[1:]:
            out = out.union(self._read(run).filter("n > 0"))
        return out.groupBy("line").agg(F.sum("n").alias("n"))

    def common(self) -> DataFrame:
        """(line) of at least ``threshold`` documents of all batches."""
        if not self.runs:
            return self.spark.createDataFrame([], "line binary")
        return self.merged([run for _, run in self.runs]).filter(F.col("n") >= self.threshold).select("line")


def line_sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text_id binary, lines array<binary>): per row the digest of its text and the distinct hashes of its line keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for value in batch.column(1):
                keys = {line_key(line) for line in value.as_buffer().to_pybytes().split(b"\n")}
                lines.append([line_hash(k) for k in sorted(keys) if k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.list_(pa.binary()))], ["text_id", "lines"])

    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(text_id(whole).alias("text_id"), whole.alias("text"))
    return rows.mapInArrow(run, "text_id binary, lines array<binary>")


def text_id(whole):
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def dropped_lines(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept. ``found``: (text_id, common array<binary>)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, gone, kept = [], [], []
            for value, common in zip(batch.column(1), batch.column(2), strict=True):
                lines = value.as_buffer().to_pybytes().split(b"\n")
                common = set(common.as_py() or ())
                stay = lines
                if common:
                    stay = [line for line in lines if not (k := line_key(line)) or line_hash(k) not in common]
                count.append(len(lines))
                gone.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept"],
            )

    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("doc_id"), whole.alias("text"), text_id(whole).alias("text_id"))
    joined = join_groups(rows, found, "text_id", F.xxhash64("text_id"), "left")
    return joined.select("doc_id", "text", "common").mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept string")


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD,
               batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept.

    Lines whose key (see ``line_key``) is not empty and is in at least
    ``threshold`` documents go from every document. Each row is a document of
    its own, whatever its key; null and empty texts are one empty line. The
    table goes through the runs in ``batches`` parts, by a hash of the row.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "line-sets")
    part = F.pmod(F.xxhash64("text_id", F.monotonically_increasing_id()), F.lit(batches)).cast("int")
    line_sets(docs, text).withColumn("batch", part).write.partitionBy("batch").parquet(folder)
    sets = spark.read.schema("text_id binary, lines array<binary>, batch int").parquet(folder)
    runs = LineRuns(spark, shared_folder(spark, "line-runs"), threshold, fanout)
    for n in range(batches):
        runs.add(f"part {n}", sets.filter(F.col("batch") == n))
    common = staged(runs.common(), "common-lines")
    texts = sets.dropDuplicates(["text_id"]).select("text_id", F.explode("lines").alias("line"))
    hits = join_groups(texts, common, "line", F.xxhash64("line"), "left_semi")
    found = staged(hits.groupBy("text_id").agg(F.collect_list("line").alias("common")), "texts-with-common-lines")
    return dropped_lines(docs, found, key, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


SQL = f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
u as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  '{ascii_uppercase}', '{ascii_lowercase}') as key from u),
common as (select key from k where key <> '' group by key having count(distinct doc_id) >= {THRESHOLD})
select doc_id, count(*)::bigint as n_lines, count(c.key)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where c.key is null), '')) as kept_sha256
from k left join common c on k.key = c.key group by doc_id
"""
