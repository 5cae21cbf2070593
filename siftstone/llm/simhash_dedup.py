"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A fingerprint has 64 bits: bit i is 1 if it is set in more than half of the XXH64 values (seed 42) of the text's
shingles. Two fingerprints are linked if they differ in at most 4 bits. Then at most 4 of the 8 bytes differ, so a
linked pair has at least 4 bytes in common at the same positions: that is the guaranteed number of matches.

Postings of a single byte would hold 1/256 of all fingerprints each, so the index is keyed by the bytes at
several positions at once. A family of position sets is chosen such that any 4 of the 8 positions contain a set
of it, hence each linked pair meets under at least one key:

* up to 2**24 distinct fingerprints: 20 sets of 3 positions (Turan's construction, the fewest possible);
* above that: all 70 sets of 4 positions, for which a bucket holds few unrelated fingerprints even at 2**35.

Pairs that meet have their shared positional bytes tallied, are kept at 4 or more, and verified by bits.

Groups of near copies put thousands of different fingerprints under one key, and no bucket may cost the square
of its size. So (1) each member is first held against its bucket's least fingerprint only, and components are
taken; (2) a bucket whose members are by then in one component has nothing more to tell and is left; (3) in the
rest only pairs from different components are verified if the bucket has at most ``PAIRS_UP_TO`` members; (4) the
members of larger ones are joined exactly without pairs: two fingerprints differ in at most 4 bits exactly if some
64-bit value differs from each in at most 2, so each is listed under the 2,081 values around it and all those under
one value are linked. A value has at most 2,081 fingerprints around it. No link is lost in any of the steps.

Null text has no words, like empty text: fingerprint zero, linked like any other. Texts under four words have
one shingle, the whole sequence. Rows with equal ids are rows of one document with several fingerprints: each
row gets its own. A component with null ids only has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spare
from .components import components

WORDS, SEED, MAX_BITS, MIN_BYTES = 4, 42, 4, 4
PAIRS_UP_TO = 1024
#: A component's rows are spread over this many keys where they meet its least id.
SALTS = 16


def fingerprint(text: str | None) -> bytes:
    """Eight bytes, the most significant first."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    joined, hashed = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= WORDS:
        return hashed(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    digests = b"".join([hashed(joined[a:b], SEED) for a, b in zip(starts[: 1 - WORDS].tolist(), ends[WORDS - 1 :].tolist())])
    n = len(digests) // 8
    bits, counts = np.frombuffer(digests, np.uint8).reshape(n, 8), np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        counts += np.unpackbits(bits[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) for each row, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [int.from_bytes(fingerprint(x.as_py()), "big", signed=True) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


def position_sets(size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` byte positions (3 or 4) of which any four positions contain one."""
    if size == 4:
        return list(combinations(range(8), 4))
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    return [s for s in combinations(range(8), 3) if len({group[p] for p in s}) == 1 or any(sorted(group[p] for p in s) == sorted((g, g, (g + 1) % 3)) for g in range(3))]


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(255 << (8 * p) for p in positions)
    return value - (1 << 64) if value >= 1 << 63 else value


def _index(fps: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """``fps`` under each of its keys: (set_id, bytes)."""
    masked = F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(s))) for s in sets])
    return fps.select("*", F.posexplode(masked).alias("set_id", "bytes"))


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positions hold the same byte."""
    x = a.bitwiseXOR(b)
    return sum((F.when(x.bitwiseAND(F.lit(_mask((p,)))) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))


def _around() -> list[int]:
    """All 64-bit values of at most two bits."""
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    return [0, *(signed(1 << i) for i in range(64)), *(signed(1 << i | 1 << j) for i, j in combinations(range(64), 2))]


def _linked(a: Column, b: Column) -> Column:
    return (shared_bytes(a, b) >= MIN_BYTES) & (bits_apart(a, b) <= MAX_BITS)


def _labelled(fps: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``fps`` with its column of nodes replaced by their labels."""
    found = labels.select(F.col("node").alias(column), "label")
    return fps.join(found, column, "left").withColumn(column, F.coalesce("label", column)).drop("label")


def link(fps: DataFrame, pairs_up_to: int = PAIRS_UP_TO, set_size: int | None = None) -> DataFrame:
    """(fp, comp) for distinct fingerprints ``fps`` (fp): comp is the least fingerprint of the component."""
    if set_size is None:
        set_size = 3 if fps.count() <= 1 << 24 else 4
    sets = position_sets(set_size)
    index = _index(fps.select("fp"), sets)
    least = index.groupBy("set_id", "bytes").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").drop("high")
    near = index.join(least, ["set_id", "bytes"]).where((F.col("fp") != F.col("low")) & _linked(F.col("fp"), F.col("low"))).select("fp", "low")
    state = cut(_labelled(fps.select("fp", F.col("fp").alias("comp")), components(near), "comp"))

    index = _index(state, sets)
    open_ = index.groupBy("set_id", "bytes").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members")).where("low < high").select("set_id", "bytes", "members")
    members = cut(index.join(open_, ["set_id", "bytes"]))
    small = members.where(F.col("members") <= pairs_up_to)
    a, b = small.alias("a"), small.alias("b")
    met = (F.col("a.set_id") == F.col("b.set_id")) & (F.col("a.bytes") == F.col("b.bytes"))
    pairs = a.join(b, met & (F.col("a.comp") < F.col("b.comp")) & _linked(F.col("a.fp"), F.col("b.fp"))).select(F.col("a.comp").alias("u"), F.col("b.comp").alias("v"))
    large = members.where(F.col("members") > pairs_up_to).select("fp", "comp").distinct()
    if not large.isEmpty():
        values = large.select("comp", F.explode(F.transform(F.array(*map(F.lit, _around())), lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))
        met = values.groupBy("value").agg(F.collect_set("comp").alias("comps")).where(F.size("comps") > 1)
        pairs = pairs.union(met.select(F.explode("comps").alias("u"), F.array_min("comps").alias("v")))
    return _labelled(state, components(pairs), "comp").select("fp", "comp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(key, fingerprint, component_id) for each row: 16 hex digits, and the least key of the component."""
    prints = cut(fingerprints(docs, key, text).withColumnRenamed(key, "key"))
    own = prints.groupBy("fp").agg(F.min("key").alias("first"))
    linked = cut(link(own, **how).join(own, "fp"))
    # A fingerprint alone is its own component. Those of larger ones find the least key of theirs by one of SALTS copies.
    many = linked.groupBy("comp").agg(F.min("first").alias("least"), F.count("*").alias("members")).where("members > 1")
    copies = many.select("comp", "least", F.lit(True).alias("found"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    of = salted.join(copies, ["comp", "salt"], "left").select("fp", F.when(F.col("found"), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(of, "fp").select(F.col("key").alias(key), hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component: of each the row with the least key, and one only if
    several rows have that key. Rows without a key are kept, as no key can name them."""
    from pyspark.sql import Window

    found = near_duplicates(docs, key, text)
    kept = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    order, row = Window.partitionBy(key).orderBy(F.col(text).asc_nulls_last()), spare(docs.columns, "row")
    first = docs.join(kept, key, "left_semi").select(*docs.columns, F.row_number().over(order).alias(row)).where(F.col(row) == 1).drop(row)
    return first.unionByName(docs.where(F.col(key).isNull()))
