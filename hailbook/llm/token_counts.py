"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas:
an insert adds a document and its tokens, a delete takes them away, a revision
adds the difference of two counts. A batch of events is added up before it is
stored, and counts once a marker names it: a batch that is named already is not
stored again, so it may be sent as often as needed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hailbook.llm.byte_bpe import encode_documents
from hailbook.llm.common import documents, staged
from hailbook.llm.exact_dedup import exact_dedup
from hailbook.session import shared_folder

GROUP = ["source", "lang", "tokenizer"]
MARKERS = "_batches"
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"
#: Pattern of a token, by tokenizer version.
VERSIONS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "words-2": r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9\x{80}-\x{10FFFF}]",
}


def count_tokens(text: Column, version: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(VERSIONS[version])).cast("long")


def bpe_counts(docs: DataFrame, ranks_path: str, version: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Insert events (see ``deltas``) of documents counted by the BPE of a vocabulary file, each text encoded once.

    docs: key, text, source, lang. A null text has no tokens; rows that repeat a key count each.
    """
    rows = docs.select(F.struct(F.col(key).alias("key"), "source", "lang").alias("row"), F.col(text).alias("text"))
    return encode_documents(rows, ranks_path, key="row").select(
        "doc_id.source", "doc_id.lang", F.lit(version).alias("tokenizer"), F.lit("insert").alias("event"),
        F.size("ids").cast("long").alias("tokens"), F.lit(None).cast("long").alias("old_tokens"),
    )


def deltas(events: DataFrame) -> DataFrame:
    """Totals of signed events (source, lang, tokenizer, event, tokens, old_tokens).

    ``event``: insert, delete or revise; any other or a null one changes
    nothing. Null counts are 0, null sources and languages are groups.
    """
    new, old = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("tokens", "old_tokens"))
    kind = F.col("event")
    sign = F.when(kind == "insert", 1).when(kind == "delete", -1).otherwise(0)
    change = F.when(kind == "revise", new - old).otherwise(sign * new)
    return (
        events.select(*GROUP, sign.alias("sign"), change.alias("change"))
        .groupBy(*GROUP)
        .agg(F.sum("sign").cast("long").alias("docs"), F.sum("change").cast("long").alias("tokens"))
    )


class Rollup:
    """Totals kept in a folder that all machines share, one subfolder per batch.

    A batch counts from the moment that one file in ``_batches`` names it, which
    appears as a whole; folders of batches that broke off are not read. Batch
    names are metadata like file names, and come to the driver as these do.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batch(self, name: str) -> str:
        if not name or not all(c.isalnum() or c in "-_" for c in name):
            raise ValueError(f"not a batch name: {name!r}")
        return f"{self.path}/batch={name}"

    def batches(self) -> list[str]:
        """Names of the batches that count."""
        try:
            names = self.spark.read.text(f"{self.path}/{MARKERS}").distinct().collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(row["value"] for row in names)

    def commit(self, name: str, events: DataFrame) -> bool:
        """Store a batch; False if it was stored before. One that broke off is written anew."""
        place = self._batch(name)
        if name in self.batches():
            return False
        deltas(events).write.mode("overwrite").parquet(place)
        marker = self.spark.createDataFrame([(name,)], "value string")
        marker.coalesce(1).write.mode("append").text(f"{self.path}/{MARKERS}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups whose documents and tokens are all gone are left out."""
        places = [self._batch(name) for name in self.batches()]
        stored = self.spark.createDataFrame([], TOTALS)
        if places:
            stored = self.spark.read.schema(TOTALS).parquet(*places)
        return (
            stored.groupBy(*GROUP)
            .agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
            .filter("n_docs != 0 or n_tokens != 0")
        )


def maintain(docs: DataFrame, rollup: Rollup) -> DataFrame:
    """Totals after four batches over ``docs`` (doc_id, text, source, lang, n_chars), the first one sent twice.

    All documents come in under words-1; copies that exact dedup drops go out
    again, row by row (rows that repeat a kept key and text all stay, as all
    null keys of a text do if it has no other); all come in under words-2 with
    a guess from ``n_chars``; the guesses are revised to counts.
    """
    base = docs.select("doc_id", "source", "lang", F.col("text"), "n_chars")
    text_digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)

    def events(rows: DataFrame, version: str, event: str, tokens: Column, old: Column | None = None) -> DataFrame:
        return rows.select(
            "source", "lang", F.lit(version).alias("tokenizer"), F.lit(event).alias("event"),
            tokens.alias("tokens"), (F.lit(None).cast("long") if old is None else old).alias("old_tokens"),
        )

    one, two = count_tokens(F.col("text"), "words-1"), count_tokens(F.col("text"), "words-2")
    guess = F.floor(F.coalesce("n_chars", F.lit(0)) / 5).cast("long")
    dropped = exact_dedup(docs).filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_text"))
    dropped = staged(dropped.distinct(), "dropped")
    counted = base.select("doc_id", "source", "lang", one.alias("tokens"), text_digest.alias("digest"))
    copies = counted.join(
        dropped, counted.doc_id.eqNullSafe(dropped.gone_id) & (counted.digest == dropped.gone_text), "left_semi"
    )
    rollup.commit("insert", events(base, "words-1", "insert", one))
    rollup.commit("copies", events(copies, "words-1", "delete", F.col("tokens")))
    rollup.commit("guess", events(base, "words-2", "insert", guess))
    rollup.commit("revise", events(base, "words-2", "revise", two, guess))
    rollup.commit("insert", events(base, "words-1", "insert", one))
    return rollup.totals()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain(documents(spark, sf_dir), Rollup(spark, shared_folder(spark, "token-counts")))


SQL = rf"""
with d as (select *, doc_id is not distinct from max(doc_id) over (partition by coalesce(text, '')) as kept from documents)
select source, lang, 'words-1' as tokenizer, count(*)::bigint as n_docs,
  sum(len(regexp_extract_all(coalesce(text, ''), '{VERSIONS["words-1"]}')))::bigint as n_tokens
from d where kept group by source, lang
union all
select source, lang, 'words-2', count(*)::bigint,
  sum(len(regexp_extract_all(coalesce(text, ''), '{VERSIONS["words-2"]}')))::bigint
from d group by source, lang
"""
