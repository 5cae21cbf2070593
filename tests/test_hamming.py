"""Pairs of hashes that differ in more bits than bands can serve, against brute force."""

import random

import numpy as np
import pytest

from siftstone.functions import hamming
from siftstone.operators import duplicates


def clustered(n: int, seed: int) -> list[int]:
    rng = random.Random(seed)
    base, out = [rng.getrandbits(64) for _ in range(n // 20)], []
    for _ in range(n):
        h = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, 12)):
            h ^= 1 << b
        out.append(h)
    return out


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("most", [0, 4, 7, 16, 40, 64])
def test_close_pairs_by_every_choice_of_bands(most):
    a, b = (np.array(clustered(n, n), np.uint64) for n in (300, 260))
    b[:40] = a[:40]
    close = lambda x, y: {(i, j) for i, j in zip(*(k.tolist() for k in np.nonzero(np.bitwise_count(x[:, None] ^ y) <= most)))}
    for count in (0, 4, 5, 8):
        spare = most - count + 1
        if count and spare < 0:
            continue
        by = [(s, m, min(spare // count + (i >= count - spare % count), m.bit_length())) for i, (s, m) in enumerate(hamming.bands(count))] if count else []
        found = [(i, j) for x, y in hamming.close_pairs(a, b, most, by=by) for i, j in zip(x.tolist(), y.tolist())]
        assert len(found) == len(set(found)) and set(found) == close(a, b)
        found = [(min(i, j), max(i, j)) for x, y in hamming.close_pairs(a, a, most, same=True, by=by) for i, j in zip(x.tolist(), y.tolist())]
        assert len(found) == len(set(found)) and set(found) == {(i, j) for i, j in close(a, a) if i < j}


def test_chosen_bands_lose_no_pair_and_save_work():
    assert hamming.plan(1000, 1000, 16) == []
    for n in (50_000, 1_000_000):
        by = hamming.plan(n, n, 16)
        assert sum(far + 1 for _, _, far in by) == 17 and sum(m.bit_length() for _, m, _ in by) == 64


@pytest.mark.parametrize("kind", ["long", "string"])
def test_similar_pairs_of_far_hashes_meet_in_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(duplicates, "BLOCK", (50, 1 << 20))
    hashes = clustered(400, 5)
    hashes[7] = hashes[3]
    order = (lambda i: i) if kind == "long" else (lambda i: f"k{i:04d}")
    frame = spark.createDataFrame([(order(i), signed(h)) for i, h in enumerate(hashes)] + [(order(900), None), (None, 5)], f"ord {kind}, p_hash long")
    out = duplicates.similar_pairs(frame, least=0.75)
    assert "Join" not in out._jdf.queryExecution().toString()
    first = {h: i for i, h in reversed(list(enumerate(hashes)))}
    want = sorted((order(i), order(j), 1 - (g ^ h).bit_count() / 64) for g, i in first.items() for h, j in first.items() if i < j and (g ^ h).bit_count() <= 16)
    assert sorted(map(tuple, out.collect())) == want and len(want) > 500
    assert duplicates.similar_pairs(frame.limit(0), least=0.75).count() == 0


def test_near_duplicates_of_far_hashes_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK", (50, 1 << 20))
    hashes = clustered(400, 6)
    hashes[7], hashes[300] = hashes[3], hashes[3]
    copies = {i for i in range(400) if i % 9 == 4}  # found by later rows, but looking for none
    rows = [(i, f"n{i}", signed(h), "x" if i in copies else None) for i, h in enumerate(hashes)]
    frame = spark.createDataFrame([*rows, (900, "none", None, None), (None, "lost", signed(hashes[3]), None)], "ord int, name string, p_hash long, duplicate_of string")
    out = duplicates.near_duplicates(frame, least=0.75)
    assert "band" not in out._jdf.queryExecution().toString()
    want = {None: (None, None), 900: (None, None)}
    for i, h in enumerate(hashes):
        d, j = min((((g ^ h).bit_count(), j) for j, g in enumerate(hashes[:i])), default=(64, None))
        want[i] = (f"n{j}", 1 - d / 64) if d <= 16 and i not in copies else (None, None)
    got = out.collect()
    assert len(got) == len(want) and {r["ord"]: (r["near_duplicate_of"], r["similarity"]) for r in got} == want
    assert duplicates.near_duplicates(frame.limit(0), least=0.75).count() == 0


def test_hashes_of_one_order_give_the_nearest_of_both(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK", (1, 1 << 20))
    rows = [(0, "b", 0), (0, "a", 3 << 40), (1, "c", 1 << 40), (1, "d", 0x7F), (2, "e", -1)]
    out = duplicates.near_duplicates(spark.createDataFrame(rows, "ord long, name string, p_hash long"), least=0.75).collect()
    assert {(r["name"], r["near_duplicate_of"], r["similarity"]) for r in out} == {("b", None, None), ("a", None, None), ("c", "a", 1 - 1 / 64), ("d", "a", 1 - 1 / 64), ("e", None, None)}
