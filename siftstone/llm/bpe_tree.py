"""Byte-level BPE by monoid tree reduction.

A node of the tree is a span of a text with the ids of that span encoded on its own. Halves are encoded
recursively down to small leaves. Two neighbours join by encoding again a window around their boundary, which
grows until the tokens outside it provably stay. Decoding concatenates bytes up the same tree.

Two kinds of windows are needed, since matches of the splitting pattern never share tokens:

* Within one match (bytes), a sequence of tokens is the encoding of its bytes exactly if each pair of
  neighbours is: merges are applied by rank, so whether two adjacent tokens are kept apart depends on those two
  alone. A window of k tokens on either side of the boundary is encoded again; when the pairs at both edges of
  the window are encodings of themselves, everything outside is final. Otherwise k doubles.
* Between matches (characters), no match goes on from a letter or an ASCII digit to a space or newline, as no
  alternative of the pattern takes white space after anything else. Such a place is a boundary whatever stands
  before and after it. The window grows on either side until it reaches one, or the end of the span.

Null text is empty text, and empty text has no ids. Texts of any length take O(n log n) time.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spans up to this many characters, and matches up to this many bytes, are leaves; so are this many ids in decoding.
LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 512, 32, 128
#: Matches longer than this are encoded by halves of their own.
LONG_MATCH = 256


class TreeBPE:
    """Encoder and decoder for a file of ranks and a splitting pattern."""

    def __init__(self, rank_file: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        import regex
        import tiktoken

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.leaf_chars, self.leaf_bytes = max(2, leaf_chars), max(2, leaf_bytes)
        self.kept_apart: dict[tuple[int, int], bool] = {}

    # within one match

    def merge(self, data: bytes) -> list[int]:
        """Ids of a leaf or window of one match: merges by rank, the lowest first and of equals the leftmost."""
        return self.library._encode_single_piece(data)

    def stays(self, a: int, b: int) -> bool:
        """Whether the bytes of two neighbouring tokens encode to just these two."""
        if (known := self.kept_apart.get((a, b))) is None:
            if len(self.kept_apart) > 200_000:
                self.kept_apart.clear()
            known = self.kept_apart[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def match_ids(self, data: bytes) -> list[int]:
        """Ids of one match, by halves."""
        if len(data) <= self.leaf_bytes:
            return self.merge(data) if data else []
        mid = len(data) // 2
        return self.join_ids(self.match_ids(data[:mid]), self.match_ids(data[mid:]))

    def join_ids(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stays(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = self.merge(b"".join(self.bytes_of[t] for t in left[i:] + right[:j]))
            if (i == 0 or self.stays(left[i - 1], window[0])) and (j == len(right) or self.stays(window[-1], right[j])):
                return left[:i] + window + right[j:]
            k *= 2

    # between matches

    def flat(self, text: str) -> list[int]:
        """Ids of a leaf or window."""
        if len(text) <= LONG_MATCH or max(map(len, text.split()), default=0) <= LONG_MATCH and not self.long_space(text):
            return self.library.encode_ordinary(text)
        out: list[int] = []
        for m in self.split.finditer(text):
            piece = m.group().encode()
            out += self.match_ids(piece)
        return out

    def long_space(self, text: str) -> bool:
        return " " * 64 in text or "\n" * 64 in text or "\t" * 64 in text or "\r" * 64 in text

    @staticmethod
    def hard(text: str, i: int) -> bool:
        """Whether a match must end before character i."""
        return text[i] in " \n" and (text[i - 1].isalpha() or "0" <= text[i - 1] <= "9")

    def encode(self, text: str | None) -> array:
        """Ids as unsigned 32-bit integers."""
        text = text or ""
        return array("I", self.span(text, 0, len(text)))

    def span(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars or not any(self.hard(text, i) for i in range(lo + 1, hi)):
            return self.flat(text[lo:hi])
        mid = (lo + hi) // 2
        left, right = self.span(text, lo, mid), self.span(text, mid, hi)
        b, c = mid, mid
        while b > lo and not (lo < b < mid and self.hard(text, b)):
            b -= 1
        while c < hi and not (mid < c and self.hard(text, c)):
            c += 1
        old_left, old_right, window = self.flat(text[b:mid]), self.flat(text[mid:c]), self.flat(text[b:c])
        if old_left:
            del left[-len(old_left) :]
        return left + window + right[len(old_right) :]

    def decode(self, ids) -> bytes:
        """Bytes of ids, concatenated up a tree."""
        if len(ids) <= LEAF_IDS:
            return self.library.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_ENCODERS: dict[tuple, TreeBPE] = {}


def encoder(rank_file: str, pattern: str) -> TreeBPE:
    """One encoder for each worker and vocabulary."""
    if (rank_file, pattern) not in _ENCODERS:
        _ENCODERS[rank_file, pattern] = TreeBPE(rank_file, pattern)
    return _ENCODERS[rank_file, pattern]


def little_endian(ids: array) -> bytes:
    import sys

    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) for each row; ids is an array of longs. Null text has no ids; repeated rows stay repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [list(bpe.encode(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int64()))], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<bigint>").withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, data) for each row: the bytes of the ids. Null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [bpe.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], ["key", "data"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, data binary").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for each row: encode, then decode those ids, in one pass over
    the texts and without moving ids or bytes between executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_file, pattern)
        for batch in batches:
            n, ids_hash, decoded_hash = [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py())
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(little_endian(ids)).hexdigest())
                decoded_hash.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
