"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split by the vocabulary's pattern. Pre-tokens that are whole tokens
are resolved together by a minimal perfect hash over the vocabulary; the others
are merged with a heap over linked bytes. Each distinct pre-token of a block of
texts is resolved once, and a worker keeps a bounded memo of them.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hailbook.llm.arrays import blocks, release
from hailbook.llm.common import documents
from hailbook.llm.perfect_hash import PerfectHash

RANKS = "byte_bpe_50k.tiktoken"
MEMO = 300_000  # pre-tokens a worker remembers; it forgets all of them beyond that
TEXT_BYTES = 1 << 20  # of texts that are encoded together


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str, table: PerfectHash):
        self.tokens, self.table = tokens, table
        self.split = regex.compile(pattern).findall
        self.ranks = {token: rank for rank, token in enumerate(tokens)}
        self.memo: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Merge the neighbours of least rank, leftmost first, until none is a token."""
        ranks, size = self.ranks, len(piece)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [
            (rank, at, at + 2)
            for at in range(size - 1)
            if (rank := ranks.get(piece[at : at + 2])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            _, at, end = heapq.heappop(heap)
            middle = after[at]
            if middle == 0 or middle >= size or after[middle] != end:
                continue  # one of the two has been merged meanwhile
            after[at], after[middle] = end, 0
            if end < size:
                before[end] = at
                far = after[end]
                if (rank := ranks.get(piece[at:far])) is not None:
                    heapq.heappush(heap, (rank, at, far))
            if (left := before[at]) >= 0 and (rank := ranks.get(piece[left:end])) is not None:
                heapq.heappush(heap, (rank, left, end))
        out, at = [], 0
        while at < size:
            out.append(ranks[piece[at : after[at]]])
            at = after[at]
        return out

    def learn(self, pieces: list[str]) -> None:
        raw = [piece.encode() for piece in pieces]
        whole = self.table.find(raw)
        ids = whole.astype("<i4").tobytes()
        for n, (piece, rank) in enumerate(zip(pieces, whole.tolist(), strict=True)):
            self.memo[piece] = (
                ids[4 * n : 4 * n + 4] if rank >= 0 else np.array(self.merged(raw[n]), "<i4").tobytes()
            )

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        split = [self.split(text) for text in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        unknown = set().union(*split).difference(self.memo)
        self.learn(list(unknown))
        known = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(known, pieces)), "<i4") for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_READY: dict[tuple, Encoder] = {}


def encoder(tokens: list[bytes], pattern: str, table: PerfectHash) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    name = (pattern, len(tokens), hash(b"\0".join(tokens)))
    if name not in _READY:
        _READY.clear()
        _READY[name] = Encoder(tokens, pattern, table)
    return _READY[name]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN,
                     key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids array<int>, decoded binary (the bytes the ids stand for).

    A null or empty text has no ids and no bytes. Texts are encoded whole, without special
    tokens. Rows that repeat a key are encoded each. The vocabulary is read by the driver and
    sent with the tasks; its size is that of the file.
    """
    tokens = read_ranks(ranks_path)
    table = PerfectHash.build(tokens)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokens, pattern, table)
        for batch in batches:
            for first, last, _, _ in blocks(batch.column(1), TEXT_BYTES):
                part = batch.slice(first, last - first)
                ids = bpe.encode(part.column(1).fill_null("").to_pylist())
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32())
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, pa.array(map(bpe.decode, ids), pa.binary())],
                    ["doc_id", "ids", "decoded"],
                )
        release()

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 and ``more`` columns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(documents(spark, sf_dir), public_tokenizers.path(RANKS)))
