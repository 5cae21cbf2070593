"""Byte-position SimHash links against brute force over all pairs."""

import random
import re
from itertools import combinations

import xxhash

from siftstone.llm.components import components
from siftstone.llm.simhash_dedup import fingerprint, keep_first, link, near_duplicates, position_sets


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in combinations(values, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


TEXTS = ["", None, "one", "ONE", "one two three four", "One\ttwo\x0bthree  four five", "é É ß", "a b c d " * 900, "\x1c x y", "x" * 30000]


def test_fingerprints():
    for text in TEXTS:
        assert int.from_bytes(fingerprint(text), "big") == plain_fingerprint(text), text


def test_position_sets_meet_any_four():
    for size, n in ((3, 20), (4, 70)):
        sets = position_sets(size)
        assert len(sets) == n and all(any(set(s) <= set(four) for s in sets) for four in combinations(range(8), 4))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1050)] + [(7, 7), (None, 3)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 1000 for i in range(1001, 1050)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_equal_brute_force_however_buckets_are_joined(spark):
    rng = random.Random(8)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            v = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                v ^= 1 << b
            values.add(v - (1 << 64) if v >= 1 << 63 else v)
    values |= {rng.getrandbits(63) for _ in range(100)}
    want = plain_components(sorted(values))
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    for how in ({}, {"pairs_up_to": 2}, {"set_size": 4}):
        assert {r[0]: r[1] for r in link(frame, **how).collect()} == want, how


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(9, base), (3, base.replace("w7 ", "v7 ")), (3, base), (5, "unlike any of the others here"), (None, base), (8, ""), (2, None), *((20 + i, t) for i, t in enumerate(TEXTS))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = near_duplicates(docs).collect()
    prints = [(k, plain_fingerprint(t)) for k, t in rows]
    group = plain_components(sorted({f for _, f in prints}))
    least = {}
    for k, f in prints:
        if k is not None:
            least[group[f]] = min(k, least.get(group[f], k))
    want = sorted(((k, f"{f:016x}", least.get(group[f])) for k, f in prints), key=str)
    assert sorted(map(tuple, got), key=str) == want
    kept = keep_first(docs).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted({c for k, _, c in want if k == c} | {None}, key=str)
    assert kept[0].asDict().keys() == {"doc_id", "text", "fp"}
    assert near_duplicates(docs.limit(0)).count() == 0 and keep_first(docs.limit(0)).count() == 0
