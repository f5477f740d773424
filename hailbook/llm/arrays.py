"""Texts of an Arrow batch as flat numpy arrays: words, hashes, windows, anchors.

Every function here is a small helper for one batch inside one task. A batch is
cut into blocks of about ``BLOCK`` bytes, so memory does not follow batch size;
one text longer than that is a block of its own, never cut.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
#: An odd multiplier has an inverse modulo 2**64, so a prefix sum gives the hash of any span.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets between them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):  # combined to no chunk
        texts = pa.array([], pa.large_binary())
    texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about ``size`` bytes."""
    data, offsets = flat(texts)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_POWERS: dict[int, np.ndarray] = {}


def powers(count: int, base: int = BASE) -> np.ndarray:
    """base**0 to base**(count - 1) modulo 2**64; the longest table asked for is kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < count:
        have = np.full(((count >> 17) + 1) << 17, base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:count]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of byte or integer ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the values in [start, end), the same wherever the span stands."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), _INVERSE)[starts])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits; one to one."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def release() -> None:
    """Give back memory that a finished task no longer needs: later tasks run in the same worker."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes unchanged."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and each text's first word number."""
    inside = ~_SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    edges = edges[edges > 0]
    finish[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets)


_PRIME = np.uint64((1 << 61) - 1)
_PIECE = 7  # bytes of a word that are one coefficient
_SHORT = 8 * _PIECE  # longer words are hashed one by one


def new_secret() -> int:
    """A key for word hashes. The driver draws it once a run, so that no text can be made to collide."""
    return secrets.randbits(128)


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo 2**61 - 1, for a and b below it."""
    low, high = np.uint64(b & 0xFFFFFFFF), np.uint64(b >> 32)
    a_low, a_high = a & np.uint64(0xFFFFFFFF), a >> np.uint64(32)
    middle = a_low * high + a_high * low  # below 2**62
    top = a_high * high  # counts 2**64, which is 8
    whole = a_low * low
    out = (whole & _PRIME) + (whole >> np.uint64(61)) + (top << np.uint64(3))
    out += ((middle << np.uint64(32)) & _PRIME) + (middle >> np.uint64(29))
    out = (out & _PRIME) + (out >> np.uint64(61))
    return np.where(out >= _PRIME, out - _PRIME, out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, secret: int) -> np.ndarray:
    """64-bit hashes of words: polynomials modulo 2**61 - 1 at a secret point, long words by a keyed digest.

    Whoever does not know ``secret`` can't name two words that collide with more
    than a chance of 2**-57; a modulus of 2**64 would have such words for every point.
    """
    point = secret % (int(_PRIME) - 2) + 1
    length = ends - starts
    out = np.empty(len(starts), np.uint64)
    for n in np.flatnonzero(length > _SHORT).tolist():
        digest = hashlib.blake2b(data[starts[n] : ends[n]].tobytes(), digest_size=8, key=secret.to_bytes(16, "little"))
        out[n] = int.from_bytes(digest.digest(), "little")
    short = np.flatnonzero(length <= _SHORT)
    order = short[np.argsort(-length[short], kind="stable")]
    at, size = starts[order], length[order]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from every place
    masks = np.array([(1 << (8 * n)) - 1 for n in range(_PIECE + 1)], np.uint64)
    found = size.astype(np.uint64)
    for n in range(0, int(size.max(initial=0)), _PIECE):
        own = int(np.searchsorted(-size, -n, "left"))  # words longer than n
        piece = view[at[:own] + n] & masks[np.minimum(size[:own] - n, _PIECE)]
        total = _times(found[:own], point) + piece
        found[:own] = np.where(total >= _PRIME, total - _PRIME, total)
    out[order] = mix(found ^ np.uint64((secret >> 64) & ((1 << 64) - 1)))
    return out


def window_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``units[i : i + size]`` for every i; the caller masks windows over text ends."""
    count = max(0, len(units) - size + 1)
    sums = prefix_sums(units)
    return mix((sums[size : size + count] - sums[:count]) * powers(count, _INVERSE))


def inside_text(first: np.ndarray, size: int, count: int) -> np.ndarray:
    """For each of ``count`` window starts, whether the window stays in one text; ``first``: texts' first units."""
    steps = np.zeros(count + 1, np.int32)
    np.add.at(steps, np.clip(first[1:-1] - size + 1, 0, count), 1)
    np.add.at(steps, np.clip(first[1:-1], 0, count), -1)
    return np.cumsum(steps)[:count] == 0


def sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over ``values[i : i + size]`` for every i, in log2(size) passes."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


_PLACE = np.uint64((1 << 36) - 1)  # low bits for a position, the rest for the hash


def anchored(units: np.ndarray, first: np.ndarray, size: int, gram: int) -> dict[str, np.ndarray]:
    """Anchors of all windows of ``size`` units that stay in one text.

    A window's anchor is the leftmost of its ``gram``-unit grams with the least
    hash, so equal windows have equal anchors at equal offsets. Windows of one
    anchor are neighbours. Returned, by anchor: ``at`` (its place), ``low`` and
    ``high`` (its first and last window), ``key`` (hash of the gram), ``context``
    (hash of all units its windows cover, and of the anchor's place in them),
    ``text`` (number of the text).
    """
    count = len(units) - size + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return {"at": none, "low": none, "high": none, "key": none.astype(np.uint64), "context": none.astype(np.uint64), "text": none}
    sums = prefix_sums(units)
    grams = len(units) - gram + 1
    hashes = mix((sums[gram:] - sums[:grams]) * powers(grams, _INVERSE))
    packed = (hashes & ~_PLACE) | np.arange(grams, dtype=np.uint64)
    owner = (sliding(packed, size - gram + 1, np.minimum) & _PLACE).astype(np.int64)
    valid = inside_text(first, size, count)
    change = np.ones(count, bool)
    change[1:] = (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    low = np.flatnonzero(change)
    high = np.append(low[1:], count) - 1
    keep = valid[low]
    low, high = low[keep], high[keep]
    at = owner[low]
    key = hashes[at]
    shape = (at - low).astype(np.uint64) << np.uint64(32) | (high - low).astype(np.uint64)
    context = span_hash(sums, low, high + size) ^ mix(shape)
    return {"at": at, "low": low, "high": high, "key": key, "context": context,
            "text": np.searchsorted(first, low, "right") - 1}
