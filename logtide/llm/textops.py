"""Vectorised helpers over Arrow string batches: byte blocks, words, rolling hashes.

All work is done block by block (half a megabyte of text), so memory depends neither on
the number of rows of an Arrow batch nor on its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters between words: blank, and tab to carriage return.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BLOCK_BYTES = 1 << 19

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True

_U = np.uint64


def byte_table(seed: int) -> np.ndarray:
    """A 64-bit value for each byte, white space included (never 0)."""
    return np.random.default_rng(seed).integers(1, 2**64 - 1, 256, dtype=np.uint64) | _U(1)


def odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1 << 60, 2**63 - 1)) * 2 + 1


def power(base: int, exponent: int) -> np.uint64:
    return _U(pow(base, exponent, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class PrefixHash:
    """Hash of any slice of a sequence of 64-bit values from one running sum.

    value(s, e) = sum of v[j] * B**(j - s): equal slices have equal values
    wherever they stand."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self._inv = self._tables(base, n)[1]
        self._sums = np.empty(n + 1, dtype=np.uint64)
        self._sums[0] = 0
        np.cumsum(values * self._tables(base, n)[0][:n], out=self._sums[1:])

    @classmethod
    def _tables(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(base)
        if have is None or len(have[0]) <= n:
            size = max(n + 1, 1 << 16)
            inverse = pow(base, -1, 1 << 64)
            have = tuple(
                np.concatenate([[_U(1)], np.multiply.accumulate(np.full(size, _U(b), dtype=np.uint64))])
                for b in (base, inverse)
            )
            cls._powers[base] = have if size <= 4 * BLOCK_BYTES else cls._powers.get(base, have)
        return have

    def value(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self._sums[ends] - self._sums[starts]) * self._inv[starts]


def windows_hash(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of every k consecutive values (doubling; len(h) - k + 1 results)."""
    n = len(h)
    if n < k:
        return h[:0]
    done, done_len, step, step_len, left = None, 0, h, 1, k
    while left:
        if left & 1:
            if done is None:
                done, done_len = step, step_len
            else:
                m = len(step) - done_len
                done = done[:m] * power(base, step_len) + step[done_len : done_len + m]
                done_len += step_len
        left >>= 1
        if left:
            step = step[:-step_len] * power(base, step_len) + step[step_len:]
            step_len *= 2
    return done[: n - k + 1]


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    m = len(a) - width + 1
    if m <= 0:
        return a[:0]
    x = np.concatenate([a, np.full((-len(a)) % width, _U(2**64 - 1), dtype=np.uint64)]).reshape(-1, width)
    after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(x, axis=1).ravel()
    return np.minimum(after[:m], before[width - 1 : width - 1 + m])


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about `limit` bytes and at most `most` rows each (one row at least)."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and (size + len(t) > limit or i - a >= most):
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of `rows`: a task holds Python copies of so many texts only."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


class Words:
    """Word bounds and hashes of some texts laid end to end.

    hashes: 64-bit hash of each word; doc: the text each word belongs to."""

    TABLE = byte_table(11)
    BASE = odd(12)

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts)
        self.buffer = joined.lower() if lower else joined
        self.n_texts = len(texts)
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        text_at = np.concatenate([[0], np.cumsum(sizes + 1)])
        starts, ends, hashes = [], [], []
        for at, part in _cut(self.buffer):
            raw = np.frombuffer(part, dtype=np.uint8)
            inside = np.zeros(len(raw) + 2, dtype=np.int8)
            inside[1:-1] = ~IS_SPACE[raw]
            edge = np.diff(inside)
            s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            hashes.append(mix(PrefixHash(self.TABLE[raw], self.BASE).value(s, e)))
            starts.append(s + at)
            ends.append(e + at)
        cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        self.starts, self.ends, self.hashes = cat(starts, np.int64), cat(ends, np.int64), cat(hashes, np.uint64)
        self.first = np.searchsorted(self.starts, text_at)  # first word of each text, and the end
        self.first[-1] = len(self.starts)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_texts), self.counts)


def _cut(buffer: bytes, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, bytes]]:
    """(place, part): parts of about `limit` bytes that end at white space."""
    at, n = 0, len(buffer)
    while at < n:
        end = min(n, at + limit)
        while end < n and not IS_SPACE[buffer[end]]:
            end += 1
        yield at, buffer[at:end] if (at, end) != (0, n) else buffer
        at = end


def shingles(words: Words, k: int, base: int = odd(13)) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every k-word shingle; a text of 1 to k-1 words is one shingle."""
    full = windows_hash(words.hashes, k, base)
    keep = words.doc[: len(full)] == words.doc[k - 1 :][: len(full)]
    doc, h = words.doc[: len(full)][keep], mix(full[keep])
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        whole = mix(PrefixHash(words.hashes, base).value(words.first[short], words.first[short + 1]) + _U(k))
        doc, h = np.concatenate([doc, short]), np.concatenate([h, whole])
    return doc, h


def window_runs(h: np.ndarray, first: np.ndarray, k: int, gram: int, base: int, segment: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """All windows of k values of each sequence, in runs that share an anchor.

    first: places where the sequences in `h` begin, and the end.  A window's anchor is
    the leftmost of its grams of `gram` values with the least hash, so that equal
    windows have equal anchors at equal distances, wherever they stand.
    Returns (start, count, anchor place, anchor hash), a run of `count` windows each."""
    ends = np.repeat(first[1:], np.diff(first))
    out = []
    for a in range(0, max(0, len(h) - k + 1), segment):
        part = h[a : a + segment + k - 1]
        grams = mix(windows_hash(part, gram, base))
        key = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        at = (sliding_min(key, k - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
        place = np.arange(a, a + len(at))
        ok = ends[a : a + len(at)] - place >= k
        at, place = at[ok], place[ok]
        if not len(at):
            continue
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1)])
        begin = np.flatnonzero(new)
        out.append((place[begin], np.diff(np.append(begin, len(at))), at[begin] + a, grams[at[begin]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
