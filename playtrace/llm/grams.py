"""Hashed character n-grams of whole texts, as unit vectors."""

from __future__ import annotations

import numpy as np

#: Characters looked at in one step, so that memory does not grow with the text.
_STEP = 1 << 18
#: Odd factors of the n-gram hash, one per position.
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def _steps(text: str, overlap: int):
    yield text[:_STEP]
    for at in range(_STEP, len(text), _STEP):
        yield text[at - overlap : at + _STEP]


def gram_counts(text: str, orders: tuple[int, ...], bits: int, fold_case: bool) -> np.ndarray:
    """Number of n-grams of each order in each of ``2**bits`` cells."""
    total = np.zeros(1 << bits, dtype=np.int64)
    for order in orders:
        for part in _steps(text, order - 1):
            part = part.lower() if fold_case else part
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            n = len(points) - order + 1
            if n <= 0:
                continue
            mixed = np.full(n, order * 0x165667B1 & 0xFFFFFFFF, dtype=np.uint32)
            for p in range(order):
                mixed += points[p : p + n] * _FACTORS[p]
                mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            total += np.bincount(mixed >> np.uint32(32 - bits), minlength=1 << bits)
    return total


def gram_vector(text: str, orders: tuple[int, ...], bits: int, fold_case: bool) -> np.ndarray:
    """Square roots of the shares of the cells: a vector of length 1, or 0 for no n-gram."""
    counts = gram_counts(text, orders, bits, fold_case).astype(np.float32)
    return np.sqrt(counts / max(1.0, float(counts.sum())))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)
