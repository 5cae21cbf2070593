"""Document fingerprints from improbable byte features in chained Bloom filters.

Every window of 64 bytes has an entropy; in 1,000 steps over all documents these have a frequency, and a window ranks
by how rare its entropy is. Of each 64 neighbouring windows the rarest (the leftmost of equals) gains a point, and
windows with at least 16 points are the features of a text. A feature sets 5 of the 2,048 bits of a Bloom filter; after
160 features the chain goes on with a new filter. Two chains are compared by the overlap of their bits, normalised
between what chance gives (0) and the most there can be (1): each filter of the chain with fewer filters is held
against the best of the other, weighted by its bits.

Windows of entropy below 1 bit (runs of one byte) are features only where a text has no others. A text of fewer than 64
bytes is one feature as a whole, an empty or null text has none: two such are alike by 1, one of them and any
other by 0. Equal texts have equal fingerprints; fingerprints may be compared if they were made with the same ranks.

A document's *next* is the one with the next lower id, the last one's is the first. Documents are dealt out by ranges
of ids and sorted there, and the first document of a range is dealt to the range before it as well, so whole texts
are moved once. There is a range for each ``RANGE_BYTES`` of text, so what a task holds does not grow with the input. Rows
with equal ids are ordered by a hash of their text and stay in one range; null ids come last. Ids must be whole numbers.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, STEPS, NEIGHBOURS, POINTS = 64, 1000, 64, 16
FILTER_BYTES, PER_FILTER, BITS_SET = 256, 160, 5
WEAK = int(STEPS / np.log2(WINDOW))
LAST_RANK = 65_535
#: Documents are dealt out in ranges of about this many bytes of text.
RANGE_BYTES = 64 << 20
_N = np.arange(WINDOW + 1, dtype=np.float64)
_PLOGP = _N * np.log2(np.maximum(_N, 1))
#: What one more of a byte that the window has c times adds to the sum of c log c.
_GAIN = np.diff(_PLOGP)


def entropies(data: np.ndarray) -> np.ndarray:
    """Steps of the entropy of every window of ``data`` (uint8)."""
    n = data.size
    if n < WINDOW:
        return np.zeros(0, np.int64)
    order = np.argsort(data, kind="stable")
    places = data[order].astype(np.int64) * (n + WINDOW) + order
    index = np.arange(n)
    before, after = np.empty(n, np.int64), np.empty(n, np.int64)
    before[order] = index - np.searchsorted(places, places - (WINDOW - 1), side="left")
    after[order] = np.searchsorted(places, places + (WINDOW - 1), side="right") - 1 - index
    gain_in, gain_out = _GAIN[before], _GAIN[after]
    change = np.empty(n - WINDOW + 1)
    change[0] = gain_in[:WINDOW].sum()
    change[1:] = gain_in[WINDOW:] - gain_out[: n - WINDOW]
    bits = np.log2(WINDOW) - np.cumsum(change) / WINDOW
    return np.clip(np.rint(bits * (STEPS / np.log2(WINDOW)) - 1e-6), 0, STEPS).astype(np.int64)


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank by entropy step, the rarest first; weak steps come last."""
    ranks = np.empty(STEPS + 1, np.int64)
    ranks[np.lexsort((np.arange(STEPS + 1), counts))] = np.arange(STEPS + 1)
    ranks[:WEAK] = LAST_RANK
    return ranks


def select(ranks: np.ndarray) -> np.ndarray:
    """Where the features of a text start, from the ranks of its windows."""
    if ranks.size == 0:
        return np.zeros(0, np.int64)
    best = (ranks << 40) | np.arange(ranks.size)
    width = min(NEIGHBOURS, ranks.size)
    have = 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    won = best & ((1 << 40) - 1)
    points = np.bincount(won)
    chosen = np.flatnonzero(points >= min(POINTS, points.max()))
    strong = chosen[ranks[chosen] < LAST_RANK]
    return strong if strong.size else chosen


def chain(data: bytes, ranks: np.ndarray) -> np.ndarray:
    """Bloom filters (uint8, one row each) of a text's features."""
    if not data:
        return np.zeros((0, FILTER_BYTES), np.uint8)
    if len(data) < WINDOW:
        hashes = [xxhash.xxh64_intdigest(data)]
    else:
        hashes = list(dict.fromkeys([xxhash.xxh64_intdigest(data[i : i + WINDOW]) for i in select(ranks).tolist()]))
    h = np.array(hashes, np.uint64)
    filters = -(-h.size // PER_FILTER)
    bits = np.zeros(filters * FILTER_BYTES * 8, np.uint8)
    base = np.arange(h.size) // PER_FILTER * (FILTER_BYTES * 8)
    for k in range(BITS_SET):
        bits[base + ((h >> np.uint64(11 * k)) & np.uint64(2047)).astype(np.int64)] = 1
    return np.packbits(bits).reshape(filters, FILTER_BYTES)


def encode(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def decode(digest: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(digest), np.uint8).reshape(-1, FILTER_BYTES)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    size_a, size_b = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total = 0.0
    for row, n in zip(a, size_a):
        both = np.bitwise_count(b & row).sum(axis=1, dtype=np.int64)
        most, chance = np.minimum(size_b, n), size_b * n / (FILTER_BYTES * 8)
        total += n * float(np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return min(1.0, total / float(size_a.sum()))


def learn_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks of the entropy steps by their frequency over all windows of all documents. Each task sums its own; what
    comes to the driver has at most ``STEPS`` + 1 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            for x in batch.column(0):
                data = np.frombuffer((x.as_py() or "").encode(), np.uint8)
                counts += np.bincount(entropies(data), minlength=STEPS + 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["step", "n"])

    counts = np.zeros(STEPS + 1, np.int64)
    for r in docs.select(text).mapInArrow(run, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():
        counts[r["step"]] = r["n"]
    return rarity_ranks(counts)


class Print:
    """A text with its bytes, ranks and filters."""

    def __init__(self, text: str | None, ranks: np.ndarray):
        self.text = text or ""
        self.data = self.text.encode()
        self.ranks = ranks[entropies(np.frombuffer(self.data, np.uint8))]
        self.filters = chain(self.data, self.ranks)


def edited(own: Print, other: Print, ranks: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes and filters of ``own`` with the last half of its characters replaced by as many of ``other``'s first. Ranks of
    windows that lie in one of the two are taken over."""
    half = len(own.text) // 2
    head, tail = own.text[: len(own.text) - half].encode(), other.text[:half].encode()
    data, k = head + tail, WINDOW - 1
    if len(head) <= WINDOW or len(tail) <= WINDOW:
        return data, chain(data, ranks[entropies(np.frombuffer(data, np.uint8))])
    seam = ranks[entropies(np.frombuffer(head[-k:] + tail[:k], np.uint8))]
    return data, chain(data, np.concatenate((own.ranks[: len(head) - k], seam, other.ranks[: len(tail) - k])))


def fingerprints(docs: DataFrame, ranks: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(Print(x.as_py(), ranks).filters) for x in batch.column(1)], pa.string())], ["key", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fingerprint string").withColumnRenamed("key", key)


def _dealt(docs: DataFrame, key: str, text: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(place, guest, key, text): rows by ranges of keys, and the first row of each range as guest of the one before."""
    spark = docs.sparkSession
    low = -(1 << 63)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(low)).alias("k"))
    size = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))))).first()[0] or 0
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    bounds = rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).first()[0] or []
    splits = [-math.inf, *sorted({float(b) for b in bounds}), math.inf]
    rows = Bucketizer(splits=splits, inputCol="at", outputCol="bucket").transform(rows.withColumn("at", F.col("k").cast("double")))
    rows = rows.select("key", "text", "k", F.col("bucket").cast("int").alias("place"))
    heads = sorted(((r["place"], r["k"]) for r in rows.groupBy("place").agg(F.max("k").alias("k")).collect()), reverse=True)
    before = [(heads[i - 1][0], k) for i, (_, k) in enumerate(heads)]
    guests = F.broadcast(spark.createDataFrame(before, "guest_of int, k long"))
    targets = F.when(F.col("guest_of").isNull(), F.array(F.struct(F.col("place"), F.lit(0).alias("guest")))).otherwise(F.array(F.struct(F.col("place"), F.lit(0).alias("guest")), F.struct(F.col("guest_of").alias("place"), F.lit(1).alias("guest"))))
    spread = rows.join(guests, "k", "left").select("key", "k", "text", F.explode(targets).alias("t"))
    return spread.select("t.place", "t.guest", "key", "k", "text").repartition(max(len(heads), int(spark.conf.get("spark.sql.shuffle.partitions"))), "place").sortWithinPartitions("place", "guest", F.desc("k"), F.xxhash64(F.coalesce("text", F.lit(""))))


def compare_with_next(docs: DataFrame, ranks: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row."""
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for batch in batches:
            for place, guest, k, value in zip(*(batch.column(c) for c in (0, 1, 2, 4))):
                place, guest, k = place.as_py(), guest.as_py(), k.as_py()
                if guest and (held is None or held[0] != place):
                    continue
                now = Print(value.as_py(), ranks)
                if held is not None:
                    own = held[2]
                    data, filters = edited(own, now, ranks)
                    out.append((held[1], len(own.text), hashlib.sha256(data).hexdigest(), encode(own.filters), encode(filters), likeness(own.filters, filters), likeness(own.filters, now.filters)))
                held = None if guest else (place, k, now)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be a column of whole numbers")
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()))])
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    return _dealt(docs, key, text).mapInArrow(run, schema).withColumnRenamed("key", key)
