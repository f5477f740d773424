"""Substring dedup over words by prefix-partitioned suffix trees.

Suffixes are split by a shared prefix: the gram at their anchor, or, for grams
too frequent for one task, the whole window (see ``repeats``). Within a group
the suffixes are sorted and their common lengths give the suffix tree: a run of
suffixes with common length of at least d hangs below one internal node of depth
d or more. Nodes deep enough for a window are the repeats.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hailbook.llm.arrays import new_secret, word_hashes, words
from hailbook.llm.common import documents
from hailbook.llm.repeats import HOT, Block, Rule, plain_order, repeats

WINDOW, GRAM = 13, 5


def word_units(data: np.ndarray, offsets: np.ndarray, secret: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, texts' first words, the words with one space after each, and where each word starts there."""
    starts, ends, first = words(data, offsets)
    length = ends - starts
    edge = np.concatenate([[0], np.cumsum(length + 1)])
    spaced = np.full(edge[-1], ord(" "), np.uint8)
    take = np.zeros(len(data) + 1, np.int8)
    take[starts] += 1
    np.add.at(take, ends, -1)
    place = np.ones(edge[-1], bool)
    place[edge[1:] - 1] = False
    spaced[place] = data[np.cumsum(take[:-1]) > 0]
    return word_hashes(data, starts, ends, secret), first, spaced, edge


def removed_words(block: Block | None, covered: np.ndarray | None) -> pa.Table:
    """doc_id, n_words, n_removed, n_spans, kept (words joined by one space)."""
    columns: list[list] = [[], [], [], [], []]
    if block is not None:
        starts, ends, first = words(block.data, block.offsets)
        text = block.data.tobytes()
        for n, key in enumerate(block.keys.tolist()):
            own = slice(first[n], first[n + 1])
            gone = covered[own]
            kept = b" ".join([text[a:b] for a, b in zip(starts[own][~gone].tolist(), ends[own][~gone].tolist(), strict=True)])
            runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
            for column, value in zip(columns, (key, len(gone), int(gone.sum()), runs, kept), strict=True):
                column.append(value)
    return pa.table({
        "doc_id": pa.array([None if k == np.iinfo(np.int64).max else k for k in columns[0]], pa.int64()),
        "n_words": pa.array(columns[1], pa.int64()), "n_removed": pa.array(columns[2], pa.int64()),
        "n_spans": pa.array(columns[3], pa.int64()), "kept": pa.array(columns[4], pa.binary()).cast(pa.string()),
    })


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
                    hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, n_spans, kept.

    A word goes if a run of ``window`` words that covers it also starts in a
    document with a smaller key; runs are judged on the input. Null and empty
    texts have no words; a null key counts as larger than all others, and rows
    of one key do not repeat each other. Keys are integers.
    """
    secret = new_secret()
    rule = Rule(window, gram, lambda d, o: word_units(d, o, secret), lambda u, k, s, e: plain_order(u, k, s, e, window), hot=hot)
    schema = "doc_id long, n_words long, n_removed long, n_spans long, kept string"
    return repeats(docs, rule, removed_words, schema, key, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


SQL = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
u as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from d),
win as (
  select doc_id, i, w, case when count(*) over ahead = {WINDOW} then string_agg(w, ' ') over ahead end as k
  from u window ahead as (partition by doc_id order by i rows between current row and {WINDOW - 1} following)),
least as (select k, min(doc_id) as first_doc from win where k is not null group by k),
cov as (
  select doc_id, i, w, coalesce(max(case when first_doc < doc_id then i end)
    over (partition by doc_id order by i) > i - {WINDOW}, false) as gone
  from win left join least using (k))
select d.doc_id, any_value(len(ws))::bigint as n_words, count_if(gone)::bigint as n_removed,
  sha256(coalesce(string_agg(w, ' ' order by i) filter (where not gone), '')) as kept_sha256
from d left join cov on d.doc_id = cov.doc_id group by d.doc_id
"""
