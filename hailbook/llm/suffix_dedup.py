"""Suffix dedup over bytes by a hash-compared suffix sort.

Suffixes are compared by prefix polynomial hashes: a binary search over lengths
finds their common extension, the next byte decides. A mergesort over that
comparison orders the suffixes of a group, the common extensions of neighbours
are its LCP array, and the bytes behind equal hashes are compared in the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hailbook.llm.arrays import prefix_sums, span_hash
from hailbook.llm.common import documents
from hailbook.llm.repeats import HOT, NO_KEY, Block, Rule, group_ends, new_groups, plain_order, repeats

WINDOW, GRAM = 50, 24


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return data, offsets, data, np.arange(len(data) + 1)


class Suffixes:
    """Suffixes of ``units`` in [start, end), at most ``most`` units of each, grouped by ``key``."""

    def __init__(self, units: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray, most: int):
        self.units, self.key, self.start = units, key, start
        self.length = np.minimum(end - start, most)
        self.sums, self.most = prefix_sums(units), most

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, by binary search over prefix hashes."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.length[a], self.length[b])
        left, right = self.start[a], self.start[b]
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = span_hash(self.sums, left, left + middle) == span_hash(self.sums, right, right + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b of its group; the shorter of two prefixes first, then the lower number."""
        shared = self.common(a, b)
        inside = (shared < self.length[a]) & (shared < self.length[b])
        last = len(self.units) - 1
        x = self.units[np.minimum(self.start[a] + shared, last)]
        y = self.units[np.minimum(self.start[b] + shared, last)]
        ended = (self.length[a] < self.length[b]) | ((self.length[a] == self.length[b]) & (a < b))
        return np.where(inside, x < y, ended)

    def sort(self) -> np.ndarray:
        """Bottom-up mergesort within the groups; all merges of a level go at once, each row by binary search in the other run.

        A group takes part in as many levels as its own size asks for.
        """
        order = np.argsort(self.key, kind="stable")
        heads = np.flatnonzero(new_groups(self.key[order]))
        sizes = group_ends(heads, len(order)) - heads
        active, run = np.arange(len(order)), 1
        head, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
        while True:
            larger = size > run
            active, head, size = active[larger], head[larger], size[larger]
            if not len(active):
                return order
            base = head + (active - head) // (2 * run) * (2 * run)
            middle = np.minimum(base + run, head + size)
            left = active < middle
            low = np.where(left, middle, base)
            high = np.where(left, np.minimum(base + 2 * run, head + size), middle)
            first = low.copy()
            open_ = np.flatnonzero(low < high)
            while len(open_):
                probe = (low[open_] + high[open_]) >> 1
                smaller = self.before(order[probe], order[active[open_]])
                low[open_] = np.where(smaller, probe + 1, low[open_])
                high[open_] = np.where(smaller, high[open_], probe)
                open_ = open_[low[open_] < high[open_]]
            target = np.where(left, active, active - middle + base) + low - first
            merged = order.copy()
            merged[target] = order[active]
            order, run = merged, 2 * run


def in_order(units: np.ndarray, key: np.ndarray, start: np.ndarray, length: np.ndarray, order: np.ndarray, common: np.ndarray) -> bool:
    """Whether neighbours of a group share just ``common`` units and ascend after them: then no hash has misled the sort."""
    a, b = order[:-1], order[1:]
    own = key[a] == key[b]
    a, b, shared = a[own], b[own], common[1:][own]
    last = len(units) - 1
    for at in range(0, len(a), 50_000):
        x, y, size = a[at : at + 50_000], b[at : at + 50_000], shared[at : at + 50_000]
        span = np.arange(int(size.max(initial=0)))[None, :]
        same = units[np.minimum(start[x][:, None] + span, last)] == units[np.minimum(start[y][:, None] + span, last)]
        if not (same | (span >= size[:, None])).all():
            return False
        more = (size < length[x]) & (size < length[y])
        rising = units[np.minimum(start[x] + size, last)] < units[np.minimum(start[y] + size, last)]
        if not np.where(more, rising, (size == length[x]) & (length[x] <= length[y])).all():
            return False
    return True


def suffix_order(units: np.ndarray, key: np.ndarray, suffix: np.ndarray, end: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of the groups and the LCP array: common length with the one before, -1 between groups.

    Where a look at the units shows that two spans share a hash, they are sorted by the units themselves.
    """
    suffixes = Suffixes(units, key, suffix, end, size)
    order = suffixes.sort()
    common = np.full(len(order), -1)
    if len(order) > 1:
        common[1:] = np.where(new_groups(key[order])[1:], -1, suffixes.common(order[1:], order[:-1]))
    if not in_order(units, key, suffix, suffixes.length, order, common):
        return plain_order(units, key, suffix, end, size)
    return order, common


def removed_bytes(block: Block | None, covered: np.ndarray | None) -> pa.Table:
    """doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes)."""
    columns: list[list] = [[], [], [], [], []]
    if block is not None:
        for n, key in enumerate(block.keys.tolist()):
            own = slice(block.offsets[n], block.offsets[n + 1])
            gone = covered[own]
            runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
            kept = block.data[own][~gone].tobytes()
            for column, value in zip(columns, (key, len(gone), int(gone.sum()), runs, kept), strict=True):
                column.append(value)
    return pa.table({
        "doc_id": pa.array([None if k == NO_KEY else k for k in columns[0]], pa.int64()),
        "n_bytes": pa.array(columns[1], pa.int64()), "n_removed": pa.array(columns[2], pa.int64()),
        "n_spans": pa.array(columns[3], pa.int64()), "kept": pa.array(columns[4], pa.binary()),
    })


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
                 hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept binary.

    A byte of the UTF-8 text goes if a string of ``window`` bytes that covers it
    also starts in a document with a smaller key; strings are judged on the
    input and do not cross documents. Null texts are empty; a null key counts
    as larger than all others, and rows of one key do not repeat each other.
    Keys are integers.
    """
    rule = Rule(window, gram, byte_units, lambda u, k, s, e: suffix_order(u, k, s, e, window), hot=hot)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return repeats(docs, rule, removed_bytes, schema, key, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


SQL = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
u as (
  select doc_id, unnest(bs) as s1, generate_subscripts(bs, 1) as i from (
    select doc_id, regexp_extract_all(h, '..') as bs from d) l),
{", ".join(f"u{2 * n} as (select *, s{n} || lead(s{n}, {n}) over (partition by doc_id order by i) as s{2 * n} from u{n if n > 1 else ''})" for n in (1, 2, 4, 8, 16))},
win as (
  select doc_id, i, s32 || lead(s16, 32) over own || lead(s2, 48) over own as k
  from u32 window own as (partition by doc_id order by i)),
least as (select k, min(doc_id) as first_doc from win where k is not null group by k having min(doc_id) < max(doc_id)),
cov as (
  select doc_id, i, coalesce(max(case when first_doc < doc_id then i end)
    over (partition by doc_id order by i) > i - {WINDOW}, false) as gone
  from win left join least using (k)),
edges as (
  select doc_id, i, gone from (
    select *, lag(gone) over (partition by doc_id order by i) as before from cov) c
  where before is null or before <> gone),
runs as (
  select e.doc_id, i, gone, coalesce(lead(i) over (partition by e.doc_id order by i), len(h) // 2 + 1) as stop, h
  from edges e join d on e.doc_id = d.doc_id)
select d.doc_id, any_value(len(d.h) // 2)::bigint as n_bytes,
  coalesce(sum(stop - i) filter (where gone), 0)::bigint as n_removed, count_if(gone)::bigint as n_spans,
  sha256(unhex(coalesce(string_agg(substr(runs.h, 2 * i - 1, 2 * (stop - i)), '' order by i) filter (where not gone), ''))) as kept_sha256
from d left join runs on d.doc_id = runs.doc_id group by d.doc_id
"""
