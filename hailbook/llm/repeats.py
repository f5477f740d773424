"""Which windows of a text also start in a document with a smaller key, over all documents.

The shared plan of the two substring operators. Texts are spread over blocks and
each step is one shuffle of short messages between blocks and buckets of keys:

1. Every window has an anchor, a short gram inside it that equal windows share.
   Blocks ask which anchor grams occur in a second document (short keys, one per
   block and gram).
2. For those, blocks send each distinct context (all windows of the anchor) once
   with its least document key, named by a 128-bit digest of its bytes. Equal
   contexts are settled here.
3. Contexts that are equal in part only are sent byte by byte to the group of
   their gram, where the operator's own suffix structure finds the common parts;
   what it finds is compared byte by byte.
   A gram with over ``hot`` occurrences is no group: its windows go to groups of
   their own, so the shared prefix of a group is as long as its size demands.

A block sends a key once however many of its documents hold it, so a passage
that a third of all rows share costs one entry per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailbook.llm.arrays import anchored, blocks, flat, mix, prefix_sums, release, span_hash
from hailbook.llm.common import in_blocks

BLOCK = 2 << 20  # bytes of text in a block
LEAST = 64  # blocks and buckets, at least
HOT = 50_000  # occurrences of a gram that make a group too large for one task
NO_KEY = np.iinfo(np.int64).max  # stands for a null key: after all others
MESSAGE = "bucket int, block int, kind int, data binary"
SEEN, ENTRIES, DEEP = 1, 2, 3


@dataclass(frozen=True)
class Rule:
    """What repeats are looked for.

    ``units``: bytes and offsets of texts to unit values, texts' first units, the
    bytes that count, and where each unit starts in them (and the end of the last).
    """

    size: int
    gram: int
    units: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    order: Callable[..., tuple[np.ndarray, np.ndarray]]
    bits: int = 40
    buckets: int = LEAST
    hot: int = HOT


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as the first one and differences of as few bytes as the largest needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    raw = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + raw.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(raw) + 1, 8), np.uint8)
    steps[1:, :width] = raw
    out = steps.reshape(-1).view("<u8").astype(np.uint64)
    out[0] = int.from_bytes(data[1:9], "little")
    return np.cumsum(out, dtype=np.uint64)


def join_parts(*parts: bytes) -> bytes:
    sizes = np.array([len(parts), *map(len, parts)], "<u4").tobytes()
    return sizes + b"".join(parts)


def split_parts(data: bytes) -> list[bytes]:
    count = int.from_bytes(data[:4], "little")
    ends = np.cumsum(np.frombuffer(data, "<u4", count, 4), dtype=np.int64) + 4 * (count + 1)
    return [data[a:b] for a, b in zip([4 * (count + 1), *ends[:-1]], ends, strict=True)]


def bits_of(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_of(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool)


def bucket_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Ranges of the top 32 of ``bits`` bits, in key order."""
    return (((keys >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def new_groups(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def group_ends(starts: np.ndarray, count: int) -> np.ndarray:
    return np.append(starts[1:], count).astype(np.int64)[: len(starts)]


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    bucket, block, kind, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({
        "bucket": pa.array(bucket, pa.int32()), "block": pa.array(block, pa.int32()),
        "kind": pa.array(kind, pa.int32()), "data": pa.array(data, pa.binary()),
    })


def received(table: pa.Table, kind: int) -> list[tuple[int, int, bytes]]:
    """(bucket, block, data) of one kind, by bucket and block."""
    rows = zip(*(table[c].to_pylist() for c in ("kind", "bucket", "block", "data")), strict=True)
    return sorted(r[1:] for r in rows if r[0] == kind)


class Block:
    """A block's texts and what it has been told of them; the same whatever the order of its rows."""

    def __init__(self, rule: Rule, table: pa.Table):
        self.rule = rule
        self.data, self.offsets = flat(table["text"])
        self.keys = np.asarray(table["doc_id"].fill_null(NO_KEY)).astype(np.int64)
        parts = []
        done, first, found = 0, [np.zeros(1, np.int64)], []
        spelled, edges = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)]
        for _, _, data, offsets in blocks(table["text"]):  # little at a time: hashes take many times the text
            units, begins, body, edge = rule.units(data, offsets)
            edges.append(edge[1:] + edges[-1][-1])
            spelled.append(body)
            own = anchored(units, begins, rule.size, rule.gram)
            for place in ("at", "low", "high"):
                own[place] = own[place] + done
            own["text"] = own["text"] + sum(map(len, first)) - 1
            parts.append(units)
            first.append(begins[1:] + done)
            found.append(own)
            done += len(units)
        none = anchored(np.zeros(0, np.uint8), np.zeros(1, np.int64), rule.size, rule.gram)
        found = found or [none]
        self.units = np.concatenate(parts) if parts else rule.units(self.data, self.offsets)[0]
        self.body, self.edge = np.concatenate(spelled), np.concatenate(edges)
        self.first = np.concatenate(first)
        self.found = {c: np.concatenate([f[c] for f in found]) for c in none}
        self.doc = self.keys[self.found["text"]]
        self.short = self.found["key"] >> np.uint64(64 - rule.bits)
        self.order = np.lexsort((self.doc, self.short))
        new = new_groups(self.short[self.order])
        self.starts = np.flatnonzero(new)
        self.distinct = self.short[self.order][self.starts]
        self.of = np.empty(len(self.order), np.int64)
        self.of[self.order] = np.cumsum(new) - 1

    def ranges(self, buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
        cuts = np.searchsorted(buckets, np.arange(self.rule.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            yield int(b), slice(cuts[b], cuts[b + 1])

    def ask_seen(self, block: int) -> list[tuple]:
        doc, ends = self.doc[self.order], group_ends(self.starts, len(self.order))
        several = doc[self.starts] != doc[ends - 1]
        counts = np.minimum(ends - self.starts, 65535).astype("<u2")
        where = bucket_of(self.distinct, self.rule.bits, self.rule.buckets)
        return [
            (b, block, SEEN, join_parts(pack_sorted(self.distinct[r]), bits_of(several[r]), counts[r].tobytes()))
            for b, r in self.ranges(where)
        ]

    def learn_seen(self, answers: list[tuple]) -> None:
        where = bucket_of(self.distinct, self.rule.bits, self.rule.buckets)
        told = {b: split_parts(data) for b, _, data in answers}
        self.seen = np.zeros(len(self.distinct), bool)
        self.heated = np.zeros(len(self.distinct), bool)
        for b, r in self.ranges(where):
            seen, heated = told[b]
            self.seen[r] = flags_of(seen, r.stop - r.start)
            self.heated[r] = flags_of(heated, r.stop - r.start)
        self.entries()

    def seen_state(self) -> bytes:
        return join_parts(bits_of(self.seen), bits_of(self.heated))

    def load_seen(self, data: bytes) -> None:
        seen, heated = split_parts(data)
        self.seen = flags_of(seen, len(self.distinct))
        self.heated = flags_of(heated, len(self.distinct))
        self.entries()

    def digests(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit digests of the bytes of the units in [low, high), as two numbers."""
        body, begin, end = self.body.tobytes(), self.edge[low].tolist(), self.edge[high].tolist()
        found = b"".join([blake2b(body[a:b], digest_size=16).digest() for a, b in zip(begin, end, strict=True)])
        both = np.frombuffer(found, np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def entries(self) -> None:
        """Distinct (gram, context) of the anchors seen elsewhere, with their least key, in bucket order.

        A context is the digest of its bytes and the place of the anchor in it.
        """
        rule, found = self.rule, self.found
        own = np.flatnonzero(self.seen[self.of])
        key, doc = found["key"][own], self.doc[own]
        context, more = self.digests(found["low"][own], found["high"][own] + rule.size)
        context = context ^ mix((found["at"][own] - found["low"][own]).astype(np.uint64))
        hot = self.heated[self.of[own]]
        where = bucket_of(np.where(hot, mix(key ^ context), key), 64, rule.buckets)
        order = np.lexsort((found["at"][own], doc, more, context, key, where))
        self.own = own[order]
        key, context, more, where = key[order], context[order], more[order], where[order]
        new = new_groups(key, context, more)
        lead = np.flatnonzero(new)
        self.entry_of = np.cumsum(new) - 1
        self.entry = {"key": key[lead], "context": context[lead], "more": more[lead], "bucket": where[lead], "hot": hot[order][lead],
                      "doc": doc[order][lead], "anchor": self.own[lead]}

    def ask_entries(self, block: int) -> list[tuple]:
        e = self.entry
        return [
            (b, block, ENTRIES, join_parts(
                e["key"][r].tobytes(), e["context"][r].tobytes(), e["more"][r].tobytes(), e["doc"][r].tobytes(), bits_of(e["hot"][r])))
            for b, r in self.ranges(e["bucket"])
        ]

    def learn_entries(self, answers: list[tuple]) -> None:
        told = {b: split_parts(data) for b, _, data in answers}
        count = len(self.entry["key"])
        self.elsewhere, self.open = np.zeros(count, bool), np.zeros(count, bool)
        for b, r in self.ranges(self.entry["bucket"]):
            for flags, data in zip((self.elsewhere, self.open), told[b], strict=True):
                flags[r] = flags_of(data, r.stop - r.start)
        self.contexts()

    def entries_state(self) -> bytes:
        return join_parts(self.seen_state(), bits_of(self.elsewhere), bits_of(self.open))

    def load_entries(self, data: bytes) -> None:
        seen, elsewhere, still = split_parts(data)
        self.load_seen(seen)
        count = len(self.entry["key"])
        self.elsewhere, self.open = flags_of(elsewhere, count), flags_of(still, count)
        self.contexts()

    def contexts(self) -> None:
        """What goes to the groups: whole contexts, or single windows of hot grams, once each."""
        found, size = self.found, self.rule.size
        still = np.flatnonzero(self.open & ~self.entry["hot"])
        whole = self.entry["anchor"][still]
        # a document may hold a context more than once: what is found out holds for all its places
        mine = self.open[self.entry_of] & (self.doc[self.own] == self.entry["doc"][self.entry_of])
        hot = self.entry["hot"][self.entry_of]
        burst = self.own[mine & hot]
        self.places = self.own[mine & ~hot]
        self.place_of = np.searchsorted(still, self.entry_of[mine & ~hot])
        parts = [{
            "key": found["key"][whole], "at": found["at"][whole], "low": found["low"][whole],
            "high": found["high"][whole], "doc": self.doc[whole],
        }]
        counts = found["high"][burst] - found["low"][burst] + 1
        window = np.repeat(found["low"][burst], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.burst = {"window": window, "doc": np.repeat(self.doc[burst], counts)}
        name, more = self.digests(window, window + size)
        order = np.lexsort((window, self.burst["doc"], more, name))
        new = new_groups(name[order], more[order])
        lead = order[new]
        self.burst["of"] = np.empty(len(window), np.int64)
        self.burst["of"][order] = np.cumsum(new) - 1
        self.burst["least"] = self.burst["doc"][lead]
        parts.append({"key": mix(name[lead]), "at": np.repeat(found["at"][burst], counts)[lead], "low": window[lead],
                      "high": window[lead], "doc": self.burst["doc"][lead]})
        joined = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        where = bucket_of(joined["key"], 64, self.rule.buckets)
        self.sent_order = np.argsort(where, kind="stable")
        self.whole = len(whole)
        self.sent = {c: v[self.sent_order] for c, v in joined.items()} | {"bucket": where[self.sent_order]}

    def ask_deep(self, block: int) -> list[tuple]:
        s, rows = self.sent, []
        begin = self.edge[s["low"]]
        length = self.edge[s["high"] + self.rule.size] - begin
        for b, r in self.ranges(s["bucket"]):
            n = length[r]
            take = np.repeat(begin[r] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows.append((b, block, DEEP, join_parts(
                s["key"][r].tobytes(), s["doc"][r].tobytes(), (s["at"][r] - s["low"][r]).astype("<u2").tobytes(),
                (s["high"][r] - s["low"][r] + 1).astype("<u2").tobytes(), n.astype("<u4").tobytes(), self.body[take].tobytes())))
        return rows

    def covered(self, answers: list[tuple]) -> np.ndarray:
        """Whether each unit is covered by a window that also starts in a document with a smaller key."""
        told = {b: data for b, _, data in answers}
        found, e = self.found, self.entry
        edge = np.zeros(len(self.units) + 1, np.int64)

        def cover(low: np.ndarray, high: np.ndarray) -> None:
            np.add.at(edge, low, 1)
            np.add.at(edge, high + self.rule.size, -1)

        gone = self.elsewhere[self.entry_of] | (self.doc[self.own] > e["doc"][self.entry_of])
        cover(found["low"][self.own[gone]], found["high"][self.own[gone]])
        s = self.sent
        windows = s["high"] - s["low"] + 1
        hit = [np.zeros(0, bool)]
        for b, r in self.ranges(s["bucket"]):
            hit.append(flags_of(told[b], int(windows[r].sum())))
        hit = np.concatenate(hit)
        start = np.empty(len(windows), np.int64)
        start[self.sent_order] = np.cumsum(windows) - windows  # by number before the sort by bucket
        wide = found["high"][self.places] - found["low"][self.places] + 1
        within = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        at = (np.repeat(found["low"][self.places], wide) + within)[hit[np.repeat(start[self.place_of], wide) + within]]
        cover(at, at)
        alone = hit[start[self.whole :]]
        out = alone[self.burst["of"]] | (self.burst["doc"] > self.burst["least"][self.burst["of"]])
        cover(self.burst["window"][out], self.burst["window"][out])
        return np.cumsum(edge[:-1]) > 0


def _in_bucket(rows: list[tuple], columns: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of all messages of a bucket, and the number of the message of each row."""
    parts = [split_parts(data) for _, _, data in rows]
    out = [[read(p) for p in parts] for read in columns]
    sizes = np.array([len(x) for x in out[0]], np.int64)
    return [np.concatenate(x) if x else np.zeros(0) for x in out], np.repeat(np.arange(len(rows)), sizes)


def _per_message(values: np.ndarray, order: np.ndarray, message: np.ndarray, count: int) -> list[np.ndarray]:
    """Values in sorted order, back in the order of the messages."""
    back = np.empty(len(values), values.dtype)
    back[order] = values
    return np.split(back, np.searchsorted(message, np.arange(1, count)))


def answer_seen(rule: Rule, table: pa.Table) -> list[tuple]:
    rows = received(table, SEEN)
    if not rows:
        return []
    (key, several, counts), message = _in_bucket(rows, [
        lambda p: unpack_sorted(p[0]), lambda p: flags_of(p[1], len(p[2]) // 2), lambda p: np.frombuffer(p[2], "<u2")])
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(new_groups(key[order]))
    size = group_ends(starts, len(order)) - starts
    seen = (size > 1) | np.logical_or.reduceat(several[order], starts)
    heated = np.add.reduceat(counts[order].astype(np.int64), starts) > rule.hot
    answers = [_per_message(np.repeat(x, size), order, message, len(rows)) for x in (seen, heated)]
    return [
        (b, block, SEEN, join_parts(bits_of(answers[0][n]), bits_of(answers[1][n])))
        for n, (b, block, _) in enumerate(rows)
    ]


def answer_entries(table: pa.Table) -> list[tuple]:
    rows = received(table, ENTRIES)
    if not rows:
        return []
    (key, context, more, doc, hot), message = _in_bucket(rows, [
        lambda p: np.frombuffer(p[0], np.uint64), lambda p: np.frombuffer(p[1], np.uint64),
        lambda p: np.frombuffer(p[2], np.uint64), lambda p: np.frombuffer(p[3], np.int64),
        lambda p: flags_of(p[4], len(p[0]) // 8)])
    order = np.lexsort((doc, more, context, key))
    key, context, more, doc, hot = key[order], context[order], more[order], doc[order], hot[order]
    new = new_groups(key, context, more)
    starts = np.flatnonzero(new)
    least = np.repeat(doc[starts], group_ends(starts, len(doc)) - starts)
    of_key = np.cumsum(new_groups(key)) - 1
    contexts = np.bincount(of_key, new)[of_key]
    elsewhere = least < doc
    still = ~elsewhere & (hot | (contexts > 1))
    answers = [_per_message(x, order, message, len(rows)) for x in (elsewhere, still)]
    return [
        (b, block, ENTRIES, join_parts(bits_of(answers[0][n]), bits_of(answers[1][n])))
        for n, (b, block, _) in enumerate(rows)
    ]


def plain_order(units: np.ndarray, key: np.ndarray, suffix: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the groups in order, and the units each shares with the one before; -1 between groups.

    These are the leaves of the groups' suffix trees and the depths of the nodes
    that join neighbours. Suffixes are read to ``size`` units at most.
    """
    length = np.minimum(end - suffix, size)
    column = np.arange(size)[None, :]
    inside = column < length[:, None]
    table = np.where(inside, units[np.minimum(suffix[:, None] + column, len(units) - 1)], units.dtype.type(0))
    order = np.lexsort((np.arange(len(length)), length, *table.T[::-1], key))
    table, length, key = table[order], length[order], key[order]
    depth = np.full(len(order), -1)
    if len(order) > 1:
        same = table[1:] == table[:-1]
        equal = np.where(same.all(axis=1), size, same.argmin(axis=1))
        equal = np.minimum(equal, np.minimum(length[1:], length[:-1]))
        depth[1:] = np.where(new_groups(key)[1:], -1, equal)
    return order, depth


def answer_deep(rule: Rule, table: pa.Table) -> list[tuple]:
    """Windows of each context that also start in a document with a smaller key, as bits."""
    rows = received(table, DEEP)
    if not rows:
        return []
    (key, doc, off, count, length), message = _in_bucket(rows, [
        lambda p: np.frombuffer(p[0], np.uint64), lambda p: np.frombuffer(p[1], np.int64),
        lambda p: np.frombuffer(p[2], "<u2"), lambda p: np.frombuffer(p[3], "<u2"), lambda p: np.frombuffer(p[4], "<u4")])
    data = np.frombuffer(b"".join([split_parts(data)[5] for _, _, data in rows]), np.uint8)
    units, first, body, edge = rule.units(data, np.concatenate([[0], np.cumsum(length.astype(np.int64))]))
    body = body.tobytes()
    off, count = off.astype(np.int64), count.astype(np.int64)
    begin = first[:-1].astype(np.int64)
    hit = np.zeros(int(count.sum()), bool)
    bit = np.cumsum(count) - count
    suffix = begin + off
    # suffixes that start at the anchors, sorted within their gram; common: units shared with the one before
    order, common = rule.order(units, key, suffix, begin + count - 1 + rule.size)
    sums = prefix_sums(units)
    bare = len(body) == len(units)  # units are the bytes themselves
    for o in range(rule.size - rule.gram + 1):  # windows whose anchor stands at offset o
        run = np.cumsum(common < rule.size - o)
        mine = (off[order] >= o) & (off[order] - count[order] + 1 <= o)
        own, run = order[mine], run[mine]
        if not len(own):
            continue
        left = span_hash(sums, suffix[own] - o, suffix[own])
        by = np.lexsort((doc[own], left, run))
        own, run, left = own[by], run[by], left[by]
        starts = np.flatnonzero(new_groups(run, left))
        size = group_ends(starts, len(own)) - starts
        group = np.repeat(np.arange(len(starts)), size)
        lead = own[starts][group]
        equal = np.ones(len(own), bool)  # to the first of the group, in its bytes
        for at in range(0, len(own), 50_000) if bare else ():
            a, b = suffix[own[at : at + 50_000]] - o, suffix[lead[at : at + 50_000]] - o
            span = np.arange(rule.size)[None, :]
            equal[at : at + 50_000] = (units[a[:, None] + span] == units[b[:, None] + span]).all(axis=1)
        if not bare:
            low, high = edge[suffix[own] - o].tolist(), edge[suffix[own] - o + rule.size].tolist()
            bytes_ = [body[a:b] for a, b in zip(low, high, strict=True)]
            heads = starts[group].tolist()
            equal = np.array([own_ == bytes_[h] for own_, h in zip(bytes_, heads, strict=True)], bool)
        later = doc[own] > doc[lead]
        for g in np.unique(group[~equal]).tolist():  # spans that share a hash: told apart by their bytes
            least: dict[bytes, int] = {}
            for n in range(starts[g], starts[g] + size[g]):
                place = suffix[own[n]] - o
                least.setdefault(body[edge[place] : edge[place + rule.size]], doc[own[n]])  # in order of doc
                later[n] = doc[own[n]] > least[body[edge[place] : edge[place + rule.size]]]
        own = own[later]
        hit[bit[own] + off[own] - o] = True
    ends = np.append(bit, len(hit))
    last = np.searchsorted(message, np.arange(len(rows) + 1))
    return [
        (b, block, DEEP, bits_of(hit[ends[last[n]] : ends[last[n + 1]]]))
        for n, (b, block, _) in enumerate(rows)
    ]


STATE = 10  # added to the kind of what a block tells itself for the next step


def echo(table: pa.Table) -> list[tuple]:
    rows = zip(*(table[c].to_pylist() for c in ("bucket", "block", "kind", "data")), strict=True)
    return [r for r in rows if r[2] > STATE]


def repeats(docs: DataFrame, rule: Rule, finish: Callable[[Block, np.ndarray], pa.Table], schema: str,
            key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """``finish(block, covered units)`` of every block of ``docs``; rows: see ``finish``.

    Null keys come after all others and null texts are empty. Copies of a key
    do not repeat each other.
    """
    blocked, total = in_blocks(docs.withColumn(key, F.col(key).cast("long")), key, text, block_bytes, LEAST)
    bits = max(40, min(60, int(total).bit_length() + 8))
    rule = Rule(rule.size, rule.gram, rule.units, rule.order, bits, max(LEAST, -(-total // block_bytes)), rule.hot)
    texts = blocked.groupBy("block")

    def number(table: pa.Table) -> int:
        return table["block"][0].as_py()

    def first(table: pa.Table) -> pa.Table:
        try:
            return messages(Block(rule, table).ask_seen(number(table)))
        finally:
            release()

    def second(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return messages([])
        block, n = Block(rule, table), number(table)
        block.learn_seen(received(told, SEEN))
        return messages([*block.ask_entries(n), (n % rule.buckets, n, STATE + SEEN, block.seen_state())])

    def third(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return messages([])
        block, n = Block(rule, table), number(table)
        block.load_seen(received(told, STATE + SEEN)[0][2])
        block.learn_entries(received(told, ENTRIES))
        return messages([*block.ask_deep(n), (n % rule.buckets, n, STATE + ENTRIES, block.entries_state())])

    def fourth(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return finish(None, None)
        block = Block(rule, table)
        block.load_entries(received(told, STATE + ENTRIES)[0][2])
        return finish(block, block.covered(received(told, DEEP)))

    def with_texts(told: DataFrame, step: Callable, out: str) -> DataFrame:
        def run(table: pa.Table, heard: pa.Table) -> pa.Table:
            try:
                return step(table, heard)
            finally:
                release()

        return texts.cogroup(told.groupBy("block")).applyInArrow(run, out)

    def by_bucket(asked: DataFrame, answer: Callable) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            try:
                return messages([*answer(table), *echo(table)])
            finally:
                release()

        # as many tasks as named: buckets have few bytes and would be merged, but take work
        return asked.repartition(2 * rule.buckets, "bucket").groupBy("bucket").applyInArrow(run, MESSAGE)

    told = by_bucket(texts.applyInArrow(first, MESSAGE), lambda t: answer_seen(rule, t))
    told = by_bucket(with_texts(told, second, MESSAGE), answer_entries)
    told = by_bucket(with_texts(told, third, MESSAGE), lambda t: answer_deep(rule, t))
    return with_texts(told, fourth, schema)
