"""Vectorised word hashing over Arrow string buffers: no Python object per word.

Normal form: A-Z and the Latin-1 capitals are lower-cased; ASCII white space, controls and punctuation separate words;
every other byte belongs to a word. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; a text may be longer, its blocks are cut at word ends.
BLOCK = 1 << 18
_SEPARATORS = bytes(range(0x21)) + bytes(i for i in range(0x21, 0x80) if not chr(i).isalnum())


def _mix_int(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_IS_SEPARATOR = np.zeros(256, dtype=bool)
_IS_SEPARATOR[list(_SEPARATORS)] = True
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_VALUE = np.array([_mix_int(i) | 1 for i in range(256)], dtype=np.uint64)
_P = _mix_int(1001) | 1
_P_INV = pow(_P, -1, 2**64)
_Q = _mix_int(2002) | 1
_Q_INV = pow(_Q, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, BLOCK + 65536), base, dtype=np.uint64)
        x[0] = 1
        have = _powers[base] = np.multiply.accumulate(x)
    return have[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and n+1 offsets."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def normal_bytes(raw: np.ndarray) -> np.ndarray:
    low = _LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) + 1
    if len(lead):
        tail = raw[lead]
        capital = lead[(tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)]
        low[capital] += 0x20
    return low


def words(column: pa.Array, white_space_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, the n+1 word offsets of the texts, and each word's first byte and end in the column's bytes.

    With ``white_space_only`` words are what ASCII white space separates, and A-Z alone are lower-cased.
    """
    raw, offsets = text_buffer(column)
    low = _LOWER[raw] if white_space_only else normal_bytes(raw) if len(raw) else raw
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = spans((_IS_WHITE if white_space_only else _IS_SEPARATOR)[low], offsets)
    return span_hashes(low, start, end), np.searchsorted(start, offsets), start, end


def spans(sep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each run of bytes that are no separators; no run crosses the texts' offsets."""
    n = len(sep)
    edge = np.empty(n, bool)  # a word may begin here
    edge[0] = True
    edge[1:] = sep[:-1]
    edge[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(edge & ~sep)
    edge[:-1] = sep[1:]  # a word may end here
    edge[-1] = True
    edge[offsets[1:][offsets[1:] > 0] - 1] = True
    return start, np.flatnonzero(edge & ~sep) + 1


def span_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each of the rising spans."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # blocks that end between words
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, side="right")))
        lo, hi = int(start[i]), int(end[j - 1])
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_VALUE[low[lo:hi]] * powers(_P, hi - lo), out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (total[e] - total[s]) * powers(_P_INV, hi - lo + 1)[s]
        i = j
    return mix(out)


def word_strings(column: pa.Array, row: int) -> list[bytes]:
    """The normal words of one text, for tests and messages."""
    raw, offsets = text_buffer(column)
    _, at, start, end = words(column)
    low = normal_bytes(raw) if len(raw) else raw
    return [low[s:e].tobytes() for s, e in zip(start[at[row] : at[row + 1]], end[at[row] : at[row + 1]])]


def ngrams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether all n lie in the same text."""
    m = len(hashes)
    if m < n:
        return np.zeros(m, np.uint64), np.zeros(m, bool)
    if n <= 8:
        out = np.zeros(m - n + 1, np.uint64)
        for j in range(n):
            out *= np.uint64(_Q)
            out += hashes[j : m - n + 1 + j]
    else:
        total = np.empty(m + 1, np.uint64)
        total[0] = 0
        np.cumsum(hashes * powers(_Q, m), out=total[1:])
        out = (total[n:] - total[:-n]) * powers(_Q_INV, m + 1)[: m - n + 1]
    out = mix(out)
    full = np.zeros(m, np.uint64)
    full[: m - n + 1] = out
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(m)
    return full, room >= n


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-word shingle hashes of each text with repeats, and their offsets; a text of 1 to n-1 words has one shingle, of all its words."""
    grams, whole = ngrams(hashes, offsets, n)
    count = np.diff(offsets)
    short = np.flatnonzero((count > 0) & (count < n))
    for i in short:  # at most one for each short text
        own = hashes[offsets[i] : offsets[i + 1]]
        h = np.uint64(len(own))
        with np.errstate(over="ignore"):
            for x in own:
                h = h * np.uint64(_Q) + x
        grams[offsets[i]] = mix(np.array([h]))[0]
        whole[offsets[i]] = True
    kept = np.maximum(count - n + 1, np.minimum(count, 1))
    return grams[whole], np.concatenate(([0], np.cumsum(kept)))


def distinct_counts(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, how often each occurs, and the offsets of the texts."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = values.copy()
    for i in range(len(offsets) - 1):
        out[offsets[i] : offsets[i + 1]].sort()
    if not len(out):
        return out, np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return out[first], np.diff(np.append(first, len(out))), np.searchsorted(first, offsets)


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes, at least a row each. ``text``: the texts or their lengths."""
    size = batch.column(text)
    size = size if pa.types.is_integer(size.type) else pc.binary_length(size)
    size = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        done = size[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(i, j - i)
        i = j
