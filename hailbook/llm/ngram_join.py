"""Jaccard join of word n-gram sets by filtering under several global token orders.

Sets that overlap enough share a token of their prefixes under every global
order. The first order is by rarity, and is used to find candidates: tokens that
no other document has come first and cannot be shared, so most documents have
no prefix left and go. The other orders are hash orders: a candidate must pass
all of them before its sets are compared.

Where a token stands in a set bounds the size of the partners it may lead to.
Tokens whose sets cannot reach each other's sizes are left out, so pages of one
template with contents of their own are no candidates of each other.

Candidates of a token are not all paired. Sets that are equal become one. Each
set belongs to the cluster of the least hub of its prefix tokens,
and is compared with that hub first; only those that are not linked to it are
compared with the rest of the cluster, in blocks, and sets that share a prefix
token over the borders of clusters are compared in pairs. That is exact: links
within what is linked already change no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hailbook.llm.arrays import (
    blocks, inside_text, lower, mix, new_secret, release, window_hashes, word_hashes, words,
)
from hailbook.llm.common import documents, in_blocks, join_groups, staged
from hailbook.llm.components import components
from hailbook.llm.repeats import (
    LEAST, MESSAGE, NO_KEY, bits_of, bucket_of, flags_of, group_ends, join_parts, messages,
    new_groups, pack_sorted, received, split_parts, unpack_sorted,
)

WORDS = 5
PERCENT = 75  # similarity at which two sets link
ORDERS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)  # seeds of the hash orders
BLOCK = 4 << 20
CHUNK = 256  # sets of a cluster that one task compares with as many others


def shingle_sets(data: np.ndarray, offsets: np.ndarray, secret: int, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and each text's first one."""
    data = lower(data)
    starts, ends, first = words(data, offsets)
    units = word_hashes(data, starts, ends, secret)
    found = window_hashes(units, size)
    inside = np.flatnonzero(inside_text(first, size, len(found)))
    text = np.searchsorted(first, inside, "right") - 1
    tokens = found[inside]
    count = np.diff(first)
    few = np.flatnonzero((count > 0) & (count < size))
    whole = np.array([mix(np.bitwise_xor.reduce(mix(units[first[n] : first[n + 1]] + np.arange(count[n], dtype=np.uint64)), keepdims=True) + count[n].astype(np.uint64))[0] for n in few], np.uint64)
    tokens, text = np.concatenate([tokens, whole]), np.concatenate([text, few])
    order = np.lexsort((tokens, text))
    tokens, text = tokens[order], text[order]
    new = new_groups(text, tokens)
    tokens, text = tokens[new], text[new]
    return tokens, np.searchsorted(text, np.arange(len(offsets)))


def needed(count: np.ndarray | int, percent: int = PERCENT):
    """Least intersection with any partner."""
    return -(-percent * count // 100)


class Sets:
    """The sets of a block of texts."""

    def __init__(self, table: pa.Table, bits: int, secret: int):
        self.keys = np.asarray(table["doc_id"].fill_null(NO_KEY)).astype(np.int64)
        parts, firsts, done = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
        for _, _, data, offsets in blocks(table["text"]):
            tokens, first = shingle_sets(data, offsets, secret)
            parts.append(tokens)
            firsts.append(first[1:] + done)
            done += len(tokens)
        self.tokens, self.first = np.concatenate(parts), np.concatenate(firsts)
        short = self.tokens >> np.uint64(64 - bits)
        self.distinct, self.of, self.counts = np.unique(short, return_inverse=True, return_counts=True)


def answer_counts(table: pa.Table) -> list[tuple]:
    """How many documents have each key, as a number of bits; 1 means one document."""
    rows = received(table, 1)
    if not rows:
        return []
    parts = [split_parts(data) for _, _, data in rows]
    keys = [unpack_sorted(p[0]) for p in parts]
    counts = np.concatenate([np.frombuffer(p[1], "<u2") for p in parts]).astype(np.int64)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(new_groups(key[order]))
    total = np.add.reduceat(counts[order], starts)
    level = np.zeros(len(key), np.uint8)
    level[order] = np.repeat(np.ceil(np.log2(total)) + 1, group_ends(starts, len(key)) - starts)
    out, at = [], 0
    for (b, block, _), k in zip(rows, keys, strict=True):
        own = level[at : at + len(k)]
        at += len(k)
        shared = own > 1
        out.append((b, block, 1, join_parts(bits_of(shared), own[shared].tobytes())))
    return out


SETS = "doc_id long, n long, signature binary, posted array<long>, tokens binary, limits array<long>"


def described(sets: Sets, levels: np.ndarray, percent: int) -> pa.Table:
    """A row per document; ``posted``, ``tokens`` and ``limits`` only where a partner is possible.

    ``tokens``: those that other documents may have, rarest first. ``posted``:
    the shared part of the prefix under that order. ``limits``: the last hash of
    the prefix under each hash order.
    """
    rows: list[list] = [[], [], [], [], [], []]
    for n, key in enumerate(sets.keys.tolist()):
        own = sets.tokens[sets.first[n] : sets.first[n + 1]]
        level = levels[sets.first[n] : sets.first[n + 1]]
        count, need = len(own), int(needed(len(own), percent))
        shared = own[level > 1]
        posted = tokens = limits = None
        if count and len(shared) >= need:
            order = np.lexsort((shared, level[level > 1]))
            tokens = shared[order]
            posted = tokens[: len(shared) - need + 1].view(np.int64).tolist()
            tokens = tokens.tobytes()
            limits = [int(np.partition(mix(own ^ np.uint64(s)), count - need)[count - need].view(np.int64)) for s in ORDERS]
        hashed = mix(own)
        signature = hashed.sum(dtype=np.uint64).tobytes() + (mix(hashed ^ np.uint64(ORDERS[0])).sum(dtype=np.uint64)).tobytes()
        for column, value in zip(rows, (key, count, signature, posted, tokens, limits), strict=True):
            column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
    names = ("doc_id", "n", "signature", "posted", "tokens", "limits")
    return pa.table([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=list(names))


def described_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """See ``described``. Token counts are exact up to keys that share their first bits, which costs only candidates."""
    blocked, total = in_blocks(docs.withColumn(key, F.col(key).cast("long")), key, text, BLOCK, LEAST)
    secret = new_secret()
    bits = max(36, min(60, int(total).bit_length() + 6))
    buckets = max(LEAST, -(-total // BLOCK))
    texts = blocked.groupBy("block")

    def ranges(sets: Sets) -> Iterator[tuple[int, slice]]:
        cuts = np.searchsorted(bucket_of(sets.distinct, bits, buckets), np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            yield int(b), slice(cuts[b], cuts[b + 1])

    def ask(table: pa.Table) -> pa.Table:
        sets, block = Sets(table, bits, secret), table["block"][0].as_py()
        counts = np.minimum(sets.counts, 65535).astype("<u2")
        return messages([(b, block, 1, join_parts(pack_sorted(sets.distinct[r]), counts[r].tobytes())) for b, r in ranges(sets)])

    def learn(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return described_none()
        sets = Sets(table, bits, secret)
        answers = {b: split_parts(data) for b, _, data in received(told, 1)}
        level = np.ones(len(sets.distinct), np.uint8)
        for b, r in ranges(sets):
            shared = flags_of(answers[b][0], r.stop - r.start)
            level[r][shared] = np.frombuffer(answers[b][1], np.uint8)
        out = described(sets, level[sets.of], percent)
        release()
        return out

    def described_none() -> pa.Table:
        none = pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
        return described(Sets(none, bits, secret), np.zeros(0, np.uint8), percent)

    asked = texts.applyInArrow(ask, MESSAGE)
    told = asked.groupBy("bucket").applyInArrow(lambda t: messages(answer_counts(t)), MESSAGE)
    return texts.cogroup(told.groupBy("block")).applyInArrow(learn, SETS)


def linked(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int, limits_x: list[int], limits_y: list[int], percent: int = PERCENT) -> bool:
    """Whether two sets link: by size, then by prefixes under each hash order, then by their intersection."""
    if 100 * min(n_x, n_y) < percent * max(n_x, n_y):
        return False
    for seed, a, b in zip(ORDERS, limits_x, limits_y, strict=True):
        hx, hy = mix(x ^ np.uint64(seed)), mix(y ^ np.uint64(seed))
        least = hx[hx <= np.int64(a).view(np.uint64)], hy[hy <= np.int64(b).view(np.uint64)]
        if not len(np.intersect1d(*least, assume_unique=True)):
            return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (n_x + n_y - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (x, y) whose sets link."""
    a, b = (
        sets.select(*[F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "n", "tokens", "limits")]) for side in "xy"
    )
    rows = pairs.join(a, pairs.x == a.doc_id_x).join(b, pairs.y == b.doc_id_y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n) for n in range(8)]
            keep = []
            for n in range(batch.num_rows):
                x, y = (np.frombuffer(columns[i][n].as_buffer(), np.uint64) for i in (4, 5))
                if linked(x, y, columns[2][n].as_py(), columns[3][n].as_py(), columns[6][n].as_py(), columns[7][n].as_py(), percent):
                    keep.append(n)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([columns[0].take(take), columns[1].take(take)], ["x", "y"])

    names = ["x", "y", "n_x", "n_y", "tokens_x", "tokens_y", "limits_x", "limits_y"]
    return rows.select(*names).mapInArrow(run, "x long, y long")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], slice_: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets."""
    out = np.zeros((len(left), len(right)), np.float32)
    every = np.concatenate([*left, *right]) if left or right else np.zeros(0, np.uint64)
    values, of = np.unique(every, return_inverse=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    both = np.isin(np.arange(len(values)), of[rows < len(left)]) & np.isin(np.arange(len(values)), of[rows >= len(left)])
    number = np.cumsum(both) - 1
    keep = both[of]
    rows, of = rows[keep], number[of[keep]]
    order = np.argsort(of, kind="stable")
    rows, of = rows[order], of[order]
    for begin in range(0, int(both.sum()), slice_):
        own = slice(*np.searchsorted(of, [begin, begin + slice_]))
        table = np.zeros((len(left) + len(right), slice_), np.float32)
        table[rows[own], of[own] - begin] = 1
        out += table[: len(left)] @ table[len(left) :].T
    return out


def block_links(table: pa.Table, percent: int = PERCENT) -> pa.Table:
    """Links between the two sides of a task, as few as connect what they connect."""
    side = np.asarray(table["side"])
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    keys, n = np.asarray(table["doc_id"]), np.asarray(table["n"])
    sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table["tokens"]]
    limits = np.array(table["limits"].to_pylist(), np.int64).view(np.uint64).reshape(len(keys), len(ORDERS))
    out = []
    if len(x) and len(y):
        small, large = np.minimum.outer(n[x], n[y]), np.maximum.outer(n[x], n[y])
        maybe = 100 * small >= percent * large
        for o, seed in enumerate(ORDERS):
            if not maybe.any():
                break
            prefix = [s[mix(s ^ np.uint64(seed)) <= limits[i, o]] for i, s in enumerate(sets)]
            maybe &= shared_counts([prefix[i] for i in x], [prefix[i] for i in y]) > 0
        if maybe.any():
            rows, columns = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
            both = shared_counts([sets[i] for i in x[rows]], [sets[i] for i in y[columns]])
            total = n[x[rows]][:, None] + n[y[columns]][None, :] - both
            good = maybe[np.ix_(rows, columns)] & (100 * both >= percent * total)
            parent = {int(k): int(k) for k in keys}

            def root(k: int) -> int:
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            for r, c in np.argwhere(good).tolist():
                a, b = int(keys[x[rows[r]]]), int(keys[y[columns[c]]])
                if (ra := root(a)) != (rb := root(b)):
                    parent[max(ra, rb)] = min(ra, rb)
                    out.append((a, b))
    return pa.table({"x": pa.array([a for a, _ in out], pa.int64()), "y": pa.array([b for _, b in out], pa.int64())})


def live_posts(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, token, reach, hub) of the prefix tokens by which a set may have a partner.

    sets: (doc_id, n, posted, left_over), the latter being the number of tokens
    that other documents have. If the rarest token of a common part is number
    ``p`` of a set of ``n``, the common part has at most ``n - p`` tokens, so no
    partner is larger than ``reach``. The smaller set of a pair reaches the
    larger one, hence a size of at least its own: a token no set of which does
    that brings nobody together, and sets that reach none of the others' sizes
    leave it too. ``hub`` is the least set that reaches its own size.
    """
    posts = sets.select("doc_id", "n", "left_over", F.posexplode("posted").alias("place", "token"))
    reach = F.expr(f"{100 + percent} * (left_over - place) div {percent}") - F.col("n")
    posts = posts.select("doc_id", "n", "token", reach.alias("reach"))
    small = F.col("reach") >= F.col("n")
    hubs = posts.groupBy("token").agg(
        F.min(F.when(small, F.col("doc_id"))).alias("hub"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
        F.min(F.when(small, F.col("n"))).alias("least"), F.max(F.when(small, F.col("n"))).alias("most"),
    )
    hubs = hubs.filter("hub is not null and first < last").drop("first", "last")
    shared = join_groups(posts, hubs, "token", F.xxhash64("token"))
    return shared.filter(f"least <= reach and 100 * most >= {percent} * n").drop("least", "most")


def within_clusters(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links of the members that are not linked to their hub with any other member of the cluster.

    members: (doc_id, label, n, tokens, limits, settled). Both sides come in
    chunks of about ``CHUNK`` sets; a task compares one chunk with another.
    """
    sizes = members.groupBy("label").agg(
        F.count("*").alias("members"), F.count_if(~F.col("settled")).alias("rest")
    )
    sizes = sizes.filter("rest > 0").select(
        "label",
        F.ceil(F.col("members") / CHUNK).cast("int").alias("parts"),
        F.ceil(F.col("rest") / CHUNK).cast("int").alias("rest_parts"),
    )
    rows = join_groups(members, sizes, "label", F.xxhash64("label"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    own_rest = F.pmod(F.xxhash64("doc_id"), F.col("rest_parts")).cast("int")
    body = ["doc_id", "n", "tokens", "limits"]
    left = rows.filter("not settled").select(
        "label", own_rest.alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(0).alias("side"), *body
    )
    right = rows.select(
        "label", F.explode(F.sequence(F.lit(0), F.col("rest_parts") - 1)).alias("i"), own.alias("j"), F.lit(1).alias("side"), *body
    )
    return left.union(right).groupBy("label", "i", "j").applyInArrow(lambda t: block_links(t, percent), "x long, y long")


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents link if percent * union <= 100 * intersection of their sets.
    Null, empty and wordless texts have an empty set and link with nothing; a
    text with fewer than ``WORDS`` words has its whole sequence as one shingle.
    ``component_id`` is the least key reachable by links, the own one included.
    Rows that repeat a key are one document: what one of them links to, all do.
    Null keys are one document, larger than all others, with a null component
    if nothing else is in it. Keys are integers.
    """
    table = staged(described_sets(docs, key, text, percent), "sets")
    classes = table.filter("n > 0").groupBy("signature", "n").agg(F.min("doc_id").alias("rep"))
    classes = staged(classes, "classes")
    heads = table.filter("posted is not null").join(
        classes.select("signature", "n", F.col("rep").alias("doc_id")), ["signature", "n", "doc_id"], "left_semi"
    )
    left_over = (F.octet_length("tokens") / 8).cast("long").alias("left_over")
    sets = staged(
        heads.dropDuplicates(["doc_id", "signature"]).select("doc_id", "n", "posted", "tokens", "limits", left_over), "heads"
    )
    shared = live_posts(sets, percent)
    labels = staged(shared.groupBy("doc_id").agg(F.min("hub").alias("label")), "labels")
    labelled = staged(shared.select("doc_id", "n", "token", "reach").join(labels, "doc_id"), "labelled")
    borders = labelled.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("token")
    across = labelled.join(borders, "token", "left_semi")
    left, right = (
        across.select("token", F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("label", "n", "reach")])
        for side in "xy"
    )
    pairs = left.join(right, "token").filter("label_x < label_y and n_x <= reach_y and n_y <= reach_x").select("x", "y")
    to_hub = labels.filter("doc_id != label").select(F.col("doc_id").alias("x"), F.col("label").alias("y"))
    active = sets.join(labels, "doc_id").drop("posted")
    active = staged(active, "active")
    direct = staged(verified(pairs.union(to_hub).distinct(), active, percent), "direct-links")
    settled = direct.select(F.col("x").alias("doc_id"), F.col("y").alias("label"), F.lit(True).alias("linked")).distinct()
    members = active.join(settled, ["doc_id", "label"], "left").withColumn(
        "settled", F.coalesce("linked", F.lit(False)) | (F.col("doc_id") == F.col("label"))
    )
    inner = within_clusters(members, percent)
    copies = table.filter("n > 0").select("signature", "n", "doc_id")
    links = direct.union(inner).select(F.col("x").alias("u"), F.col("y").alias("v"))
    repeated = copies.groupBy("doc_id").agg(F.count_distinct("signature", "n").alias("texts")).filter("texts > 1")
    same_key = copies.join(repeated, "doc_id", "left_semi").join(classes, ["signature", "n"]).select(
        F.col("doc_id").alias("u"), F.col("rep").alias("v")
    )
    found = staged(components(links.union(same_key)), "components")
    reached = classes.join(found, classes.rep == found.node, "left").select(
        "signature", "n", F.coalesce("component", "rep").alias("component")
    )
    rows = table.select("signature", "n", "doc_id").withColumn("tag", F.xxhash64("signature", "n"))
    out = rows.join(reached.withColumn("tag", F.xxhash64("signature", "n")), ["signature", "n", "tag"], "left")

    def real(column: Column) -> Column:
        return F.when(column != NO_KEY, column)

    return out.select(
        real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"),
        real(F.coalesce("component", "doc_id")).alias("component_id"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


SQL = rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'),
    '[^\x20\x09-\x0D]+') as ws from documents),
u as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from d),
grams as (
  select doc_id, {" || ' ' || ".join(f"lead(w, {n}) over own" for n in range(WORDS))} as k
  from u window own as (partition by doc_id order by i)),
sets as (
  select distinct doc_id, k from grams where k is not null
  union all select doc_id, array_to_string(ws, ' ') from d where len(ws) between 1 and {WORDS - 1}),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as shared from sets a join sets b using (k)
  where a.doc_id < b.doc_id group by 1, 2),
links as (
  select x, y from pairs join sizes a on x = a.doc_id join sizes b on y = b.doc_id
  where 100 * shared >= {PERCENT} * (a.n + b.n - shared)),
edges as (select x, y from links union select y, x from links),
reach(doc_id, other) as (
  select doc_id, doc_id from documents
  union select r.doc_id, y from reach r join edges on other = x)
select r.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(other) as component_id
from reach r left join sizes s on r.doc_id = s.doc_id group by r.doc_id
"""
