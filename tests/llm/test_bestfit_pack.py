"""Packing against one-at-a-time best fit, and the query's invariants against the tokenizer itself."""

import bisect
import itertools
import json
import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from siftstone.llm.bestfit_pack import CapacityTree, WordCoder, pack, pack_histogram

FILE = public_tokenizers.path("word_bpe_49k.json")


def one_at_a_time(lengths, capacity):
    """Number of bins that best-fit decreasing takes."""
    open_, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(open_, n)
        if i == len(open_):
            bins += 1
            left = capacity
        else:
            left = open_.pop(i)
        bisect.insort(open_, left - n)
    return bins


def test_histogram_packing_equals_one_at_a_time():
    rng = random.Random(2)
    for capacity in (1, 7, 50, 2048):
        for _ in range(25):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 400))] + [rng.choice((1, capacity))] * rng.randint(0, 30)
            plan, bins = pack_histogram(Counter(lengths), capacity)
            assert bins == one_at_a_time(lengths, capacity)
            ranks, used = defaultdict(int), defaultdict(list)
            for length, rank, n, first, each, offset in sorted(plan.tolist()):
                assert rank == ranks[length]
                ranks[length] += n
                for k in range(n):
                    used[first + k // each].append((offset + k % each * length, length))
            assert ranks == Counter(lengths) and len(used) == bins
            for spans in used.values():
                at = 0
                for offset, length in sorted(spans):
                    assert offset == at
                    at += length
                assert at <= capacity


def test_tree_finds_the_tightest():
    tree, there = CapacityTree(20), set()
    rng = random.Random(4)
    for _ in range(500):
        c = rng.randint(0, 20)
        there ^= {c}
        tree.set(c, c in there)
        n = rng.randint(1, 20)
        assert tree.tightest(n) == min((x for x in there if x >= n), default=None)


def test_pieces_and_places(spark):
    rng = random.Random(6)
    words = "The quick brown fox isn't here 2024 naïve ÉTÉ 漢字 á <|endoftext|> \x1c odd space I'LL don't --- İstanbul ﬁ".split(" ")
    texts = [None, "", " \n", "x", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 900))) for _ in range(60)), " ".join(rng.choice(words) for _ in range(9000))]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, "x", "clash"), (None, "y", None)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, sequence_id string"), FILE).collect()
    t = Tokenizer.from_file(FILE)
    want = Counter()
    for k, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for p, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[k, p, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) == one_at_a_time([r["length"] for r in got], 2048)
    assert pack(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0


def test_ids_equal_the_library_on_nasty_strings():
    """All strings of up to three of these, among them what normalising joins, splits or changes, and special tokens."""
    own, t = WordCoder(FILE), Tokenizer.from_file(FILE)
    alphabet = [*"a.Zé'İ\x1c!ß1\u0301\x85\xa0ǅΣς|<\0", "I'll", "<|endoftext|>", "ﬁ", "漢", "À", " "]
    texts = ["".join(p) for k in (1, 2, 3) for p in itertools.product(alphabet, repeat=k)]
    for text, got, want in zip(texts, own.encode(texts), t.encode_batch(texts, add_special_tokens=False)):
        assert got == struct.pack(f"<{len(want.ids)}I", *want.ids), repr(text)
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinrstlodéüñß") for _ in range(rng.randint(1, 40))) for _ in range(20_000)]
    assert own.encode(words) == [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in t.encode_batch(words, add_special_tokens=False)]


def test_every_entry_merges_to_itself():
    """By the list of merges, applied as it stands. Then merging by rank of the joined bytes is the same for every text."""
    with open(FILE, encoding="utf-8") as f:
        model = json.load(f)["model"]
    rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
    for token in model["vocab"]:
        if token.startswith("<|"):
            continue
        body = token.removesuffix("</w>")
        parts = list(body) if body == token else [*body[:-1], body[-1] + "</w>"]
        while len(parts) > 1:
            best, at = min(((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert parts == [token], token
