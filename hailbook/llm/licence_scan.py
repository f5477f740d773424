"""Licence scan by canonical digest lookup.

The whole text of a document, and each whole line of it, is brought to a
canonical form (case, punctuation, spacing, copyright lines, equivalent
spellings), digested, and hash-joined to the digests of known licence texts.
Copyright lines count as such behind comment marks too. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hailbook.llm.common import documents, join_groups, staged
from hailbook.llm.licence_texts import SPELLINGS, TEXTS

COPYRIGHT = r"(^|\n)[ \t#*/;%!<>|-]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*"
PUNCTUATION = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """Canonical lines of a text, with one line end between them and no blank ones around."""
    out = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    out = F.regexp_replace(out, COPYRIGHT, "$1")
    out = F.regexp_replace(out, PUNCTUATION, " ")
    for spelling, same in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(same))
    return F.regexp_replace(out, r" *(?:\n *)+", "\n")


def whole(lines: Column) -> Column:
    """The canonical lines as one line."""
    return F.btrim(F.translate(lines, "\n", " "))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def catalogue(spark: SparkSession, texts: Sequence[tuple[str, str]] = TEXTS) -> DataFrame:
    """(digest, license) of known texts; of texts with one canonical form the least licence counts."""
    known = spark.createDataFrame(list(texts), "license string, text string")
    return known.groupBy(digest(whole(canonical(F.col("text")))).alias("digest")).agg(
        F.min("license").alias("license")
    )


def licence_scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_digest, text_license, line_licenses, n_license_lines.

    ``text_license``: the licence that the whole text is, or null.
    ``line_licenses``: distinct licences that whole lines name, in order,
    joined by a comma ('' for none). A null text is empty, and an empty
    canonical text is no licence. Rows that repeat a key each get the findings
    of their own text. ``known``: (digest, license), one row per digest.
    """
    base = docs.select(F.col(key).alias("doc_id"), canonical(F.col(text)).alias("lines"))
    filled = F.filter(F.split("lines", "\n"), lambda x: F.btrim(x) != "")
    rows = staged(
        base.select(
            "doc_id",
            digest(whole(F.col("lines"))).alias("text_digest"),
            digest(F.col("lines")).alias("lines_digest"),
            F.transform(filled, lambda x: F.unhex(digest(F.btrim(x)))).alias("line_digests"),
        ),
        "licence-digests",
    )
    named = known.select(F.col("digest").alias("text_digest"), F.col("license").alias("text_license"))
    # equal texts have equal findings: they are kept once, and the rows look them up
    hits = (
        rows.select("lines_digest", F.explode("line_digests").alias("line"))
        .join(known.select(F.unhex("digest").alias("line"), "license"), "line")
        .groupBy("lines_digest")
        .agg(
            F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"),
            F.count("*").alias("line_hits"),
        )
    )
    copies = rows.groupBy("lines_digest").agg(F.count("*").alias("copies"))
    found = hits.join(copies, "lines_digest").select(
        "lines_digest", "line_licenses", (F.col("line_hits") / F.col("copies")).cast("long").alias("n_license_lines")
    )
    slim = rows.select("doc_id", "text_digest", "lines_digest")
    return (
        join_groups(slim, found, "lines_digest", F.xxhash64("lines_digest"), "left")
        .join(named, "text_digest", "left")
        .select(
            "doc_id",
            "text_digest",
            "text_license",
            F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
            F.coalesce("n_license_lines", F.lit(0)).alias("n_license_lines"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(documents(spark, sf_dir), catalogue(spark))


def _sql_canonical(text: str) -> str:
    out = f"translate(coalesce({text}, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
    out = rf"regexp_replace({out}, '{COPYRIGHT}', '\1', 'g')"
    out = f"regexp_replace({out}, '{PUNCTUATION}', ' ', 'g')"
    for spelling, same in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{same}')"
    return rf"regexp_replace({out}, ' *(?:\n *)+', chr(10), 'g')"


_KNOWN = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEXTS)
SQL = f"""
with known as (
  select sha256(trim(translate({_sql_canonical('text')}, chr(10), ' '))) as digest, min(license) as license
  from (values {_KNOWN}) v(license, text) group by 1),
canon as (select doc_id, {_sql_canonical('text')} as lines from documents),
hits as (
  select doc_id, string_agg(distinct license, ',' order by license) as names, count(*) as n
  from (select doc_id, unnest(string_split(lines, chr(10))) as line from canon) l
  join known on digest = sha256(trim(line)) where trim(line) <> '' group by doc_id)
select doc_id, sha256(trim(translate(lines, chr(10), ' '))) as text_digest, license as text_license,
  coalesce(names, '') as line_licenses, coalesce(n, 0) as n_license_lines
from canon left join hits using (doc_id)
left join known on digest = sha256(trim(translate(lines, chr(10), ' ')))
"""
