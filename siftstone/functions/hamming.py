"""Pairs of 64-bit values that differ in few bits, by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Values compared at once, and of these in a row: their differences stay in a core's cache.
TILE, WIDE = 1 << 14, 1 << 12
#: Nanoseconds for a pair compared, a candidate gathered, a group of equal keys begun and a key tried for it; only their ratios matter.
PAIR_NS, GATHER_NS, GROUP_NS, KEY_NS = 2.5, 5, 60_000, 15
FLUSH = 1 << 16


def bands(count: int) -> list[tuple[int, int]]:
    """(shift, mask) of ``count`` bands that cover 64 bits."""
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]


def _ball(mask: int, far: int) -> np.ndarray:
    """All values up to ``mask`` of at most ``far`` bits."""
    values = np.arange(mask + 1, dtype=np.int64)
    return values[np.bitwise_count(values) <= far]


def plan(n_a: int, n_b: int, most: int) -> list[tuple[int, int, int]]:
    """(shift, mask, far) of the bands by which ``close_pairs`` looks for pairs, or none where comparing all with all costs less.

    If every one of k bands differed in more than its ``far`` bits, and these add up to most - k + 1, more than ``most`` bits
    would differ in all; so each pair has a band that differs in at most its ``far`` bits."""
    best, least = [], PAIR_NS * n_a * n_b
    for count in (4, 5, 6, 8):
        spare = most - count + 1
        if spare >= 0:
            chosen = [(s, m, min(spare // count + (i >= count - spare % count), m.bit_length())) for i, (s, m) in enumerate(bands(count))]
            cost = 0.0
            for _, mask, far in chosen:
                size, groups = len(_ball(mask, far)), min(n_a, mask + 1)
                cost += PAIR_NS * n_a * n_b * size / (mask + 1) + groups * (GROUP_NS + KEY_NS * size + GATHER_NS * n_b * size / (mask + 1))
            if cost < least:
                best, least = chosen, cost
    return best


def _within(a: np.ndarray, b: np.ndarray, most: int, room: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs of ``a`` and ``b`` that differ in at most ``most`` bits, in pieces."""
    for j in range(0, len(b), WIDE):
        part = b[j : j + WIDE]
        wide = len(part)
        high = TILE // wide
        for i in range(0, len(a), high):
            some = a[i : i + high, None]
            n = len(some) * wide
            x, bits = room[0][:n].reshape(-1, wide), room[1][:n]
            np.bitwise_xor(some, part, out=x)
            np.bitwise_count(room[0][:n], out=bits)
            hit = np.flatnonzero(bits <= most)
            if len(hit):
                yield i + hit // wide, j + hit % wide


def _gathered(pieces: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same in larger pieces."""
    kept, n = [], 0
    for piece in pieces:
        kept.append(piece)
        n += len(piece[0])
        if n >= FLUSH:
            yield np.concatenate([i for i, _ in kept]), np.concatenate([j for _, j in kept])
            kept, n = [], 0
    if n:
        yield np.concatenate([i for i, _ in kept]), np.concatenate([j for _, j in kept])


def _all(a: np.ndarray, b: np.ndarray, most: int, same: bool, room: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = 1024 if same else max(1, len(a))
    for at in range(0, len(a), step):
        past = at if same else 0
        for i, j in _within(a[at : at + step], b[past:], most, room):
            yield i + at, j + past


def _by_key(sorted_a: np.ndarray, key_a: np.ndarray, sorted_b: np.ndarray, key_b: np.ndarray, band: tuple[int, int, int], most: int, same: bool, room: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of values sorted by their keys, those pairs whose keys are near; with ``same`` in the order of keys."""
    _, mask, far = band
    start = np.concatenate([[0], np.cumsum(np.bincount(key_b, minlength=mask + 1))])
    values, low = np.unique(key_a, return_index=True)
    ball = _ball(mask, far)
    for u, lo, hi in zip(values.tolist(), low.tolist(), [*low[1:].tolist(), len(key_a)]):
        near = ball ^ u
        if same:
            near = near[near >= u]
        begin = start[near]
        n = start[near + 1] - begin
        ends = np.cumsum(n)
        if ends[-1]:
            at = np.repeat(begin - ends + n, n) + np.arange(ends[-1])
            for i, j in _within(sorted_a[lo:hi], sorted_b[at], most, room):
                yield i + lo, at[j]


def close_pairs(a: np.ndarray, b: np.ndarray, most: int, same: bool = False, by: list[tuple[int, int, int]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of each pair of ``a`` and ``b`` (unsigned 64-bit) that differs in at most ``most`` bits, once, in pieces.
    With ``same``, ``a`` and ``b`` are one array, and two of its positions are one pair."""
    room = np.empty(TILE, np.uint64), np.empty(TILE, np.uint8)
    by = plan(len(a), len(b), most) if by is None else by
    if not by:
        for i, j in _gathered(_all(a, b, most, same, room)):
            keep = i < j if same else slice(None)
            yield i[keep], j[keep]
    for number, band in enumerate(by):
        keys = [((v >> np.uint64(band[0])) & np.uint64(band[1])).astype(np.int64) for v in (a, b)]
        orders = [np.argsort(k, kind="stable") for k in keys]
        (sorted_a, key_a), (sorted_b, key_b) = ((v[o], k[o]) for v, k, o in zip((a, b), keys, orders))
        for i, j in _gathered(_by_key(sorted_a, key_a, sorted_b, key_b, band, most, same, room)):
            x = sorted_a[i] ^ sorted_b[j]
            keep = (i < j) if same else np.ones(len(i), bool)  # in the order of keys
            for shift, mask, far in by[:number]:  # met there already
                keep &= np.bitwise_count((x >> np.uint64(shift)) & np.uint64(mask)) > far
            yield orders[0][i[keep]], orders[1][j[keep]]
