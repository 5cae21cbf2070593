"""Window entropies, features and comparisons against plain versions; neighbours across ranges of ids."""

import hashlib
import math
import random
from collections import Counter

import numpy as np

from siftstone.llm.rare_digest import FILTER_BYTES, LAST_RANK, NEIGHBOURS, POINTS, STEPS, WEAK, WINDOW, Print, chain, compare_with_next, decode, encode, entropies, fingerprints, learn_ranks, likeness, rarity_ranks, select


def plain_entropies(data):
    out = []
    for i in range(len(data) - WINDOW + 1):
        h = -sum(n / WINDOW * math.log2(n / WINDOW) for n in Counter(data[i : i + WINDOW]).values())
        out.append(min(STEPS, max(0, round(h * STEPS / math.log2(WINDOW) - 1e-6))))
    return out


def plain_select(ranks):
    points = Counter()
    width = min(NEIGHBOURS, len(ranks)) or 1
    for i in range(len(ranks) - width + 1):
        points[min(range(i, i + width), key=lambda j: (ranks[j], j))] += 1
    if not points:
        return []
    chosen = sorted(p for p, n in points.items() if n >= min(POINTS, max(points.values())))
    return [p for p in chosen if ranks[p] < LAST_RANK] or chosen


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéfgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    return [None, "", "a", "short text", "x" * 500, *(" ".join(rng.choice(words) for _ in range(n)) for n in (9, 12, 40, 200, 1500)), "ab" * 4000]


def test_entropies_and_features():
    ranks = rarity_ranks(np.arange(STEPS + 1)[::-1].copy())
    assert (ranks[:WEAK] == LAST_RANK).all() and ranks[STEPS] == 0
    for t in texts():
        data = (t or "").encode()
        got = entropies(np.frombuffer(data, np.uint8)).tolist()
        assert got == plain_entropies(data)
        assert select(ranks[got] if got else np.zeros(0, int)).tolist() == plain_select(ranks[got].tolist() if got else [])


def test_likeness():
    ranks = rarity_ranks(np.arange(STEPS + 1)[::-1].copy())
    chains = [chain((t or "").encode(), ranks[entropies(np.frombuffer((t or "").encode(), np.uint8))]) for t in texts()]
    for c in chains:
        assert likeness(c, c) == 1.0 and (decode(encode(c)) == c).all() and c.shape[1] == FILTER_BYTES
        assert all(0 <= likeness(c, d) <= 1 and likeness(c, d) == likeness(d, c) for d in chains if len(c) != len(d))
    assert likeness(chains[0], chains[1]) == 1.0 and likeness(chains[0], chains[5]) == 0.0 and len(chains[8]) >= 1


def test_documents_and_their_next(spark):
    some = texts()
    rows = [(i * 3 - 7, t) for i, t in enumerate(some * 3)] + [(None, "no id " * 40)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, place string")
    ranks = learn_ranks(frame)
    counts = Counter(h for _, t in rows for h in plain_entropies((t or "").encode()))
    assert (ranks == rarity_ranks(np.array([counts[i] for i in range(STEPS + 1)]))).all()
    order = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    want = {}
    for i, (k, t) in enumerate(order):
        own, other = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(own) // 2
        made = own[: len(own) - half] + other[:half]
        a, e, n = (Print(x, ranks).filters for x in (own, made, other))
        want[k] = (len(own), hashlib.sha256(made.encode()).hexdigest(), encode(a), encode(e), likeness(a, e), likeness(a, n))
    got = {r["doc_id"]: tuple(r)[1:] for r in compare_with_next(frame, ranks).collect()}
    assert got == want
    assert {r["doc_id"]: r["fingerprint"] for r in fingerprints(frame, ranks).collect()} == {k: v[2] for k, v in want.items()}
    one = compare_with_next(frame.where("doc_id = -7"), ranks).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert compare_with_next(frame.limit(0), ranks).count() == 0
    twice = frame.where("doc_id in (2, 5)").union(frame.where("doc_id = 5"))
    assert compare_with_next(twice, ranks).count() == 3
