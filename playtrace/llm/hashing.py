"""Words and rolling hashes of whole batches of texts, in numpy.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D`` of the UTF-8 text. Its hash is a
Rabin-Karp polynomial modulo 2**64 over a random value per byte, taken from one
running sum: with ``P[i] = sum(T[c_j] * B**j for j < i)`` the word ``[s, e)`` has the hash
``(P[e] - P[s]) * B**-s``. Windows of words use the same sum over the word hashes.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 19
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def random_values(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudorandom 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

BYTES = random_values(256, 11)
#: The same with A-Z as a-z.
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse up to ``n`` at least."""
    have = _cache.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n, CHUNK + 4096)
        have = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
        if size < 8 * CHUNK:
            _cache[base] = have
    return have


def _pieces(buf: np.ndarray):
    """Parts of about ``CHUNK`` bytes that end at white space."""
    at, n = 0, len(buf)
    while at < n:
        end = min(n, at + CHUNK)
        while end < n:
            stop = np.flatnonzero(SPACE[buf[end : end + 4096]])
            if len(stop):
                end += int(stop[0])
                break
            end = min(n, end + 4096)
        yield at, buf[at:end]
        at = end


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, piece in _pieces(buf):
        first, last = _one_pass(piece)
        starts.append(first + at)
        ends.append(last + at)
    return np.concatenate(starts), np.concatenate(ends)


def word_hashes(buf: np.ndarray, values: np.ndarray = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of ``buf``."""
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, piece in _pieces(buf):
        first, last = _one_pass(piece)
        power, inverse = _tables(_BASE, len(piece))
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(values[piece] * power[: len(piece)], out=sums[1:])
        word = (sums[last] - sums[first]) * inverse[first]
        hashes.append(mix(word + (last - first).astype(np.uint64)))
        starts.append(first + at)
    return np.concatenate(hashes), np.concatenate(starts)


def _one_pass(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = np.ones(len(piece) + 2, dtype=np.int8)
    gap[1:-1] = SPACE[piece]
    step = np.diff(gap)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of ``words[i:i + size]`` for every ``i``; empty when there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if salt:
        words = mix(words + np.uint64(salt))
    out = np.empty(n, np.uint64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + size - 1]
        power, inverse = _tables(_WORD_BASE, len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        m = len(part) - size + 1
        out[at : at + m] = (sums[size : size + m] - sums[:m]) * inverse[:m]
    return mix(out)


class Batch:
    """Texts joined by line breaks; ``first[i]`` to ``first[i + 1]`` are the words of text i."""

    def __init__(self, texts: list[bytes | None], values: np.ndarray = BYTES, hashed=True):
        parts = [t or b"" for t in texts]
        self.buf = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
        if hashed:
            self.words, starts = word_hashes(self.buf, values)
        else:
            self.words, (starts, _) = None, word_spans(self.buf)
        self.first = np.concatenate(([0], np.searchsorted(starts, ends))).astype(np.int64)

    def window_starts(self, size: int) -> np.ndarray:
        """Positions at which ``size`` words of one text begin."""
        total = int(self.first[-1])
        ok = np.zeros(total + 1, dtype=np.int32)
        length = np.diff(self.first)
        long = length >= size
        np.add.at(ok, self.first[:-1][long], 1)
        np.add.at(ok, self.first[1:][long] - size + 1, -1)
        return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def in_pieces(texts: list, weight: int = CHUNK):
    """Index ranges of consecutive texts with about ``weight`` bytes each."""
    begin, total = 0, 0
    for i, text in enumerate(texts):
        total += len(text or b"") + 64
        if total >= weight:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def utf8(column) -> list[bytes | None]:
    """The values of an Arrow string column as bytes."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
