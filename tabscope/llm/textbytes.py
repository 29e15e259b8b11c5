"""NumPy views of a text's UTF-8 bytes: words, rolling hashes and hashed n-gram profiles."""

from __future__ import annotations

import numpy as np

#: A-Z to a-z, all other bytes as they are; for ``bytes.translate``.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: White space that separates words.
SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(length: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``length`` of each."""
    if len(_powers[0]) < length:
        size = max(length, 2 * len(_powers[0]), 1 << 12)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


class Rolling:
    """64-bit hashes of any byte spans of one text; equal bytes have equal hashes wherever they stand."""

    def __init__(self, raw: np.ndarray) -> None:
        power, self.inverse = _power(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64, out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + lengths)

    def plain_grams(self, size: int) -> np.ndarray:
        """As ``grams``, but not spread over all bits; there must be a gram."""
        count = len(self.sums) - size
        return (self.sums[size:] - self.sums[:count]) * self.inverse[:count]

    def grams(self, size: int) -> np.ndarray:
        """The hash of the ``size`` bytes from each position on."""
        count = len(self.sums) - size
        if count <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[size:] - self.sums[:count]) * self.inverse[:count])


def byte_array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.zeros(len(inside) + 2, np.int8)
    edges[1:-1] = inside
    steps = np.diff(edges)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``."""
    return runs(~SPACE[raw])


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive word hashes; fewer words are one shingle, none are none."""
    if len(hashes) == 0:
        return hashes
    size = min(size, len(hashes))
    count = len(hashes) - size + 1
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total = mixed(total + hashes[k : k + count] + np.uint64(k + 1))
    return total


def profile(text: bytes, grams: tuple[int, ...], word_grams: tuple[int, ...], bits: int) -> np.ndarray:
    """Hashed n-gram profile: for the byte n-grams and for the word n-grams, the roots of their shares in
    ``2**bits`` buckets, so each half has length 1 (0 if the text has no such n-gram).
    """
    raw = byte_array(text)
    shift, size = np.uint64(64 - bits), 1 << bits
    rolling = Rolling(raw)
    parts = [[rolling.grams(n) for n in grams]]
    if word_grams:
        starts, ends = words(raw)
        hashes = rolling.spans(starts, ends)
        parts.append([shingles(hashes, n) + np.uint64(n) for n in word_grams if len(hashes) >= n])
    halves = []
    for part in parts:
        counts = np.zeros(size)
        for values in part:
            counts += np.bincount((values >> shift).astype(np.int64), minlength=size)
        halves.append(np.sqrt(counts / max(1.0, counts.sum())))
    return np.concatenate(halves).astype(np.float32)


def packed(vector: np.ndarray) -> bytes:
    """A sparse vector as bytes: indices, then values."""
    at = np.flatnonzero(vector)
    return at.astype(np.uint32).tobytes() + vector[at].astype(np.float32).tobytes()


def unpacked(rows: list[bytes], size: int) -> np.ndarray:
    """Packed vectors as the rows of a matrix."""
    matrix = np.zeros((len(rows), size), np.float32)
    for i, row in enumerate(rows):
        half = len(row) // 2
        matrix[i, np.frombuffer(row[:half], np.uint32)] = np.frombuffer(row[half:], np.float32)
    return matrix
