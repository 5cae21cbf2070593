"""Tree encoding against a plain quadratic merge and against the library; decoding as an exact round trip."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftstone.llm.bpe_tree import TreeBPE, decode_documents, encode_documents, round_trip

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
SMALL = TreeBPE(FILE, public_tokenizers.PATTERN, leaf_chars=5, leaf_bytes=3)
LARGE = TreeBPE(FILE, public_tokenizers.PATTERN)


def brute(text):
    out = []
    for m in SMALL.split.finditer(text):
        parts = [bytes([b]) for b in m.group().encode()]
        while len(parts) > 1:
            rank, i = min((SMALL.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [SMALL.ranks[p] for p in parts]
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcthein'lsrevd  \n\t019éß漢😀.,!? ", max_size=160))
def test_small_trees_equal_brute_force(text):
    assert list(SMALL.encode(text)) == list(LARGE.encode(text)) == brute(text)
    assert SMALL.decode(SMALL.encode(text)) == text.encode()


def test_long_matches_and_long_spaces():
    rng = random.Random(5)
    for text in ("a" * 5000, "".join(rng.choice("thaeinor") for _ in range(4000)), "x" + " " * 3000 + "y", "漢" * 2000, "!?" * 1500 + " end"):
        want = LARGE.library.encode_ordinary(text)
        assert list(SMALL.encode(text)) == list(LARGE.encode(text)) == want
        assert [i for m in SMALL.split.finditer(text) for i in SMALL.match_ids(m.group().encode())] == want


ROWS = [(1, "Hello world, it's 2024."), (2, None), (3, ""), (4, "naïve café " * 5000), (1, "Hello world, it's 2024."), (None, "x")]


def test_queries_over_rows(spark):
    docs = spark.createDataFrame([(*r, "z") for r in ROWS], "doc_id long, text string, ids string")
    got = sorted(map(tuple, round_trip(docs, FILE, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for k, text in ROWS:
        ids = LARGE.library.encode_ordinary(text or "")
        want.append((k, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = decode_documents(encode_documents(docs, FILE, public_tokenizers.PATTERN), FILE, public_tokenizers.PATTERN)
    assert sorted(((r[0], bytes(r[1]).decode()) for r in back.collect()), key=str) == sorted(((k, t or "") for k, t in ROWS), key=str)
    assert round_trip(docs.limit(0), FILE, public_tokenizers.PATTERN).count() == 0


def test_a_missing_file_is_an_error():
    with pytest.raises(FileNotFoundError):
        TreeBPE("/nowhere/ranks", public_tokenizers.PATTERN)
