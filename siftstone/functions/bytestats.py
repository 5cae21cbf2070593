"""Numpy kernels over the bytes of a file, in pieces, so that memory does not grow with the file."""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def entropy(counts: np.ndarray) -> np.ndarray:
    """Bits a byte from counts of the 256 values, in the last axis."""
    n = counts.sum(axis=-1)
    return np.log2(np.maximum(n, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(axis=-1) / np.maximum(n, 1)


def statistics(data: bytes) -> dict:
    """Entropy, length, entropies of the eight bit planes, share of set lowest bits and share of changes between neighbours."""
    a, counts, changes = np.frombuffer(data, np.uint8), np.zeros(256, np.int64), 0
    for at in range(0, a.size, PIECE):
        piece = a[at : at + PIECE + 1]
        counts += np.bincount(piece[:PIECE], minlength=256)
        low = piece & 1
        changes += int(np.count_nonzero(low[1:] != low[:-1]))
    ones = counts @ _BITS
    p = ones / max(1, a.size)
    inside = np.clip(p, 1e-300, 1 - 1e-16)
    planes = np.where((p <= 0) | (p >= 1), 0.0, -inside * np.log2(inside) - (1 - inside) * np.log2(1 - inside))
    return {"n_bytes": a.size, "entropy": float(entropy(counts)), "planes": planes.tolist(), "one_ratio": float(p[0]), "transition_rate": changes / (a.size - 1) if a.size > 1 else 0.0}


def block_entropies(data: bytes, size: int):
    """Arrays (block, entropy, n_bytes) of a file's blocks, some thousands at a time."""
    a = np.frombuffer(data, np.uint8)
    step = max(1, PIECE // size)
    for first in range(0, -(-a.size // size), step):
        part = a[first * size : (first + step) * size]
        blocks = -(-part.size // size)
        counts = np.bincount(np.arange(part.size) // size * 256 + part, minlength=blocks * 256).reshape(blocks, 256)
        yield np.arange(first, first + blocks), entropy(counts), counts.sum(axis=1)
