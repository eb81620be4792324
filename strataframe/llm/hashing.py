"""Word and byte-string hashes over whole Arrow batches of text, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; a longer text is handled alone, in pieces of about this size.
SLICE = 1 << 20
_rng = np.random.RandomState(20_240_601)
TABLE = _rng.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(U) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
STEP = U(0xD6E8FEB86659FD93)

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Separators of words [^\x20\x09-\x0D]+, as bytes of UTF-8.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Separators of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
NOT_ALNUM = np.array([c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def inverse(x: int) -> np.uint64:
    return U(pow(int(x), -1, 1 << 64))


#: Bytes of a word beyond which it is hashed by itself.
_LONG = 1024


def word_hashes(piece: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes a step. Each step mixes: no pattern of bytes cancels out, as in sums of powers."""
    padded = np.concatenate([piece, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(piece) + 1,), "<u8", padded, 0, (1,))
    size = end - begin
    h = mix(size.astype(U) * BASE)
    live = np.flatnonzero(size <= _LONG)
    at = begin[live]
    left = size[live]
    while len(live):
        bits = np.minimum(left, 8).astype(U) * U(8)
        chunk = eight[at].astype(U) & (~U(0) >> (U(64) - bits))
        h[live] = mix((h[live] ^ chunk) * STEP)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(piece[begin[i] : end[i]].tobytes(), digest_size=8, key=b"word").digest()
        h[i] = U(int.from_bytes(digest, "little"))
    return h


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def slices(rows: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE bytes each."""
    begin = size = 0
    for i, x in enumerate(rows):
        if size and size + len(x) > SLICE:
            yield begin, i
            begin, size = i, 0
        size += len(x) + 1
    if begin < len(rows):
        yield begin, len(rows)


def _pieces(buf: np.ndarray, blank: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most SLICE bytes that end at a separator, or of one longer word."""
    at = 0
    while at < len(buf):
        end = min(at + SLICE, len(buf))
        if end < len(buf):
            stops = np.flatnonzero(blank[buf[at:end]])
            if len(stops):
                end = at + int(stops[-1]) + 1
            else:
                more = np.flatnonzero(blank[buf[end:]])
                end = end + int(more[0]) + 1 if len(more) else len(buf)
        yield at, end
        at = end


def words(rows: list[bytes], blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of rows: 64-bit hash, row, and byte range in the rows joined by one blank."""
    buf = np.frombuffer(b" ".join(rows), np.uint8)
    offsets = np.cumsum([0] + [len(x) + 1 for x in rows])
    hashes, begins, ends = [], [], []
    for lo, hi in _pieces(buf, blank):
        piece = buf[lo:hi]
        inside = np.zeros(len(piece) + 2, np.int8)
        inside[1:-1] = ~blank[piece]
        edge = np.diff(inside)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(s):
            continue
        hashes.append(word_hashes(piece, s, e))
        begins.append(s + lo)
        ends.append(e + lo)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, none
    s = np.concatenate(begins)
    return np.concatenate(hashes), np.searchsorted(offsets, s, "right") - 1, s, np.concatenate(ends)


def shingles(rows: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Distinct hashed word shingles of each row, sorted; a row of fewer words has its whole sequence."""
    h, row, _, _ = words([x.translate(LOWER) for x in rows], BLANK)
    bounds = np.searchsorted(row, np.arange(len(rows) + 1))
    code = np.zeros(max(0, len(h) - size + 1), U)
    for j in range(size):
        code = code * STEP + h[j : j + len(code)]
    code = mix(code + U(size))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(code[a : b - size + 1]))
        elif b > a:
            one = np.zeros(1, U)
            for w in h[a:b]:
                one = one * STEP + w
            out.append(mix(one + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out
