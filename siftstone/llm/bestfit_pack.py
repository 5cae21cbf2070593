"""Best-fit decreasing packing of tokenised documents into sequences of fixed capacity.

Lengths are whole numbers up to the capacity, so equal lengths can be placed together and the packing of any
number of documents follows from their histogram: at most ``capacity`` numbers, whatever the input. The driver
packs the histogram: lengths in decreasing order go to the open bin of least sufficient remaining capacity, which
a segment tree over remaining capacities finds in logarithmic time, or to a new bin. Bins with the same history are
kept as runs, and what is placed is noted as ranges of ranks: "pieces a to b of length L go into bins x to y". That
plan is exactly what placing one piece at a time would give.

Executors number the pieces of each length without gaps: each task counts its own, the counts of tasks are summed
before it, and the plan tells where each number goes. No piece, bin or length is gathered in one place.

A document is its ids and the end id; longer ones are cut to pieces of the capacity. Null text is empty text, whose
only id is the end id. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_tree import little_endian
from .common import cut

CAPACITY = 2048
_KEPT_WORDS = 400_000
_CODERS: dict[str, "WordCoder"] = {}


class WordCoder:
    """Ids of whole texts by a tokenizer file whose matches never span ASCII white space. So runs without it
    are encoded once and kept as bytes, up to a bound: the words of the last generation that are met again move to
    the present one, the rest are forgotten with it.

    A run of letters with nothing but ASCII punctuation behind it is two matches, whatever the letters are. Where the letters
    are such that normalising only lower-cases them (``LETTERS``), the first of these is merged directly by the ranks of
    the file's merges, very many runs at a time: the end of a word is a byte of its own that joins its last byte before
    all else. That is the same as applying the list of merges if every entry of the vocabulary merges to itself, which
    a test verifies for the file in use. Everything else goes to the library as it is."""

    #: Letters that normalise to their small form alone, each to one character.
    LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
    PUNCTUATION = r"!-/:-@\[-`{-~"
    PARTS = re.compile(rf"([{LETTERS}]+)([{PUNCTUATION}]*)(?= |\Z)|([^ ]+)")
    END = "\0"

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.ranks, self.ends = merge_ranks(model, self.END.encode())
        self.merges = tiktoken.Encoding("words", pat_str=rf"[^{self.END}]+{self.END}", mergeable_ranks=self.ranks, special_tokens={})
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def ids(self, text: str) -> bytes:
        return little_endian(array("I", self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids))

    def cores(self, words: list[str]) -> dict[str, bytes]:
        """Ids of different words of small ``LETTERS``."""
        out: dict[str, bytes] = {}
        for at in range(0, len(words), 8192):
            part = words[at : at + 8192]
            ids = self.merges.encode_to_numpy(self.END.join(part) + self.END)
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            data = ids.astype("<u4").tobytes()
            out.update(zip(part, [data[a:b] for a, b in zip([0, *stops], stops)]))
        return out

    def learn(self, words: list[bytes]) -> None:
        """Make all of ``words`` known."""
        known, old = self.known, self.before.get
        new = []
        for w in words:
            if (ids := old(w)) is not None:
                known[w] = ids
            else:
                new.append(w)
        if not new:
            return
        parts = self.PARTS.findall(b" ".join(new).decode())
        small = [core.lower() for core, _, _ in parts]
        cores, tails = self.cores(list({c for c in small if c})), self.tails
        if len(tails) > _KEPT_WORDS:
            tails.clear()
        for w, core, (_, tail, other) in zip(new, small, parts):
            if core:
                if (end := tails.get(tail)) is None:
                    end = tails[tail] = self.ids(tail) if tail else b""
                known[w] = cores[core] + end
            else:
                known[w] = self.ids(other)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > _KEPT_WORDS:
            self.before, self.known = self.known, {}
        collected = gc.isenabled()
        gc.disable()  # millions of small objects and no cycles among them
        try:
            runs = [(t or "").encode().split() for t in texts]
            self.learn(list(set(chain.from_iterable(runs)).difference(self.known)))
            of = self.known.__getitem__
            return [b"".join(map(of, run)) for run in runs]
        finally:
            if collected:
                gc.enable()


def merge_ranks(model: dict, end: bytes) -> tuple[dict[bytes, int], np.ndarray]:
    """Ranks of byte strings for a vocabulary of byte-level BPE with word ends, ``end`` standing for these; and which ids end
    a word. Ids must be in the order of merging: the bytes, the bytes that end a word, and then the merges."""
    # Fixed rule of byte-level vocabularies: printable bytes are their own character, the others follow from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    suffix, ranks = model["end_of_word_suffix"], {}
    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    for token, i in model["vocab"].items():
        last = token.endswith(suffix)
        body = token[: len(token) - len(suffix)] if last else token
        if any(c not in byte_of for c in body) or token.startswith("<|"):
            continue
        ranks[bytes(byte_of[c] for c in body) + end * last] = i
        ends[i] = last
    for i, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        if model["vocab"][a + b] != 512 + i:
            raise ValueError("the ids of this vocabulary are not in the order of its merges")
    return ranks, ends


def coder(tokenizer_file: str) -> WordCoder:
    if tokenizer_file not in _CODERS:
        _CODERS[tokenizer_file] = WordCoder(tokenizer_file)
    return _CODERS[tokenizer_file]


class CapacityTree:
    """Which remaining capacities have open bins; finds the least one that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, capacity: int, there: bool) -> None:
        i = capacity + self.size
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        i = length + self.size
        if self.any[i]:
            return length
        while i > 1 and not (i % 2 == 0 and self.any[i + 1]):
            i //= 2
        if i <= 1:
            return None
        i += 1
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """The plan for ``counts`` pieces of each length, and the number of bins. Rows of the plan: length, first rank,
    ranks, first bin, pieces in each bin, offset of the first piece in a bin."""
    tree, runs, plan, bins = CapacityTree(capacity), {}, [], 0

    def put(left: int, first: int, n: int) -> None:
        if n:
            if not runs.setdefault(left, []):
                tree.set(left, True)
            runs[left].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} does not fit a capacity of {capacity}")
        rank, rest = 0, counts[length]
        while rest:
            left = tree.tightest(length)
            if left is None:
                left, each = capacity, capacity // length
                first, n = bins, -(-rest // each)
                bins += n
            else:
                first, n = runs[left].pop()
                each = left // length
                if not runs[left]:
                    tree.set(left, False)
            full = min(n, rest // each)
            if full:
                plan.append((length, rank, full * each, first, each, capacity - left))
                put(left - each * length, first, full)
                rank, rest = rank + full * each, rest - full * each
            if rest and full < n:
                plan.append((length, rank, rest, first + full, rest, capacity - left))
                put(left - rest * length, first + full, 1)
                rank, rest, full = rank + rest, 0, full + 1
            put(left, first + full, n - full)
    return np.array(plan, np.int64).reshape(-1, 6), bins


def pieces(docs: DataFrame, tokenizer_file: str, key: str, text: str, capacity: int, end_id: int) -> DataFrame:
    """(key, piece, start, length, ids_crc32, task, nth): nth numbers the pieces of a length in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, nth, end = coder(tokenizer_file), TaskContext.get().partitionId(), {}, end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows, index = [], []
                for i, ids in enumerate(own.encode(part.column(1).to_pylist())):
                    data = memoryview(ids + end)
                    total = len(data) // 4
                    for p, start in enumerate(range(0, total, capacity)):
                        n = min(capacity, total - start)
                        nth[n] = k = nth.get(n, -1) + 1
                        rows.append((p, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), task, k))
                        index.append(i)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index, pa.int64())), *(pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds))], ["key", "piece", "start", "length", "ids_crc32", "task", "nth"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for each piece."""
    cut_up = cut(pieces(docs, tokenizer_file, key, text, capacity, end_id))
    by_task = cut(cut_up.groupBy("task", "length").agg(F.count("*").alias("n")))
    plan, _ = pack_histogram({r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut_up.join(base, ["task", "length"]).select("key", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = plan[:, 0] * (1 << 48) + plan[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            row = plan[np.searchsorted(where, length * (1 << 48) + rank, side="right") - 1]
            k = rank - row[:, 1]
            sequence, offset = row[:, 3] + k // row[:, 4], row[:, 5] + k % row[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*batch.schema.names[:5], "sequence_id", "offset"])

    schema = T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema).withColumnRenamed("key", key)
