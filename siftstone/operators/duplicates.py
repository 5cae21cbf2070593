"""Exact and near duplicates among ordered rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytesops import hash_similarity
from ..functions.hamming import bands, close_pairs
from ..functions.shipping import ship

#: Above so many differing bits, bands would be of fewer than 16 bits and each hold too many hashes to be joined on.
BANDED = 3
#: Hashes of a block: at least, unless there are fewer, and at most.
BLOCK = 1 << 12, 1 << 20


def exact_duplicates(rows: DataFrame, digest: str = "sha256", name: str = "name", order: str = "ord") -> DataFrame:
    """``rows`` with ``duplicate_of``: the name of the first row, in input order, that has the same digest; null for that
    row itself, and where there is no digest. Digests are compared without regard to case.

    The first row of each digest is found by a minimum that combines before the shuffle, and joined back only for digests
    that occur more than once, so neither a hot digest nor the unique majority gathers in one task."""
    low = F.when(F.col(digest) != "", F.lower(F.col(digest)))
    first = rows.select(low.alias("__digest"), F.struct(order, name).alias("__row")).where("__digest is not null").groupBy("__digest").agg(F.min("__row").alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    joined = rows.withColumn("__digest", low).join(first, "__digest", "left")
    later = F.when(F.col("__first").isNotNull() & (F.col(order) > F.col(f"__first.{order}")), F.col(f"__first.{name}"))
    return joined.withColumn("duplicate_of", later).select(*rows.columns, "duplicate_of")


def first_of_hash(rows: DataFrame, hash_: str = "p_hash", order: str = "ord") -> DataFrame:
    """(order, first) of each row that has a hash: the first row with the same one, which stands for all of them in pairs."""
    usable = rows.where(F.col(hash_).isNotNull()).select(order, F.col(hash_).alias("h"))
    return usable.join(usable.groupBy("h").agg(F.min(order).alias("first")), "h").select(order, "first")


def _block_count(n: int, cores: int) -> int:
    """Blocks for ``n`` hashes: as few as make two pairs of blocks for each core, and none of them too large."""
    least, most = BLOCK
    return max(1, min(ceil(n / least), ceil((sqrt(1 + 16 * cores) - 1) / 2)), ceil(n / most))


def _met(values: DataFrame, n: int, kernel: Callable, schema: str) -> DataFrame:
    """Rows that ``kernel(h_a, o_a, h_b, o_b, same)`` yields for each pair of blocks of the distinct hashes ``values`` (h, o), of
    which there are ``n`` at most. Hashes go to blocks by a hash of their own, so that near ones do not gather in one; every two
    blocks meet in a task of their own, and a block meets itself, so a task holds two blocks, however large the whole is."""
    spark = ship(values.sparkSession)
    count = _block_count(n, spark.sparkContext.defaultParallelism)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    spread = values.withColumn("block", F.pmod(F.xxhash64("h"), F.lit(count)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    # ``pair`` numbers two blocks, and the later one of them is the first side: a block with itself has that side only.
    keyed = spread.select((high * (high + 1) / 2 + low).cast("int").alias("pair"), (F.col("block") < F.col("other")).alias("second"), (F.col("block") == F.col("other")).alias("same"), "h", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(got) if (got := list(batches)) else None
        pairs, second, same = ([np.asarray(c) for c in (table["pair"], table["second"], table["same"])]) if table else [np.empty(0)] * 3
        for pair in np.unique(pairs):
            sides = [table.filter(pa.array((pairs == pair) & (second == side))).combine_chunks() for side in (False, True)]
            own = bool(same[pairs == pair].any())
            h = [np.asarray(t["h"]).astype(np.int64).view(np.uint64) for t in sides]
            o = [t["o"].combine_chunks() for t in sides]
            yield from kernel(h[0], o[0], h[0] if own else h[1], o[0] if own else o[1], own)

    return keyed.repartitionById(count * (count + 1) // 2, F.col("pair")).mapInArrow(run, schema)


def _ranks(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values of both in their common order."""
    ranks = np.asarray(pc.rank(pa.concat_arrays([a, b]), tiebreaker="dense")).astype(np.int64)
    return ranks[: len(a)], ranks[len(a) :]


def _all_pairs(most: int) -> Callable:
    """Kernel of (order_a, order_b, apart) for each pair, the earlier one first."""

    def run(h_a, o_a, h_b, o_b, same) -> Iterator[pa.RecordBatch]:
        rank_a, rank_b = _ranks(o_a, o_b)
        both = pa.concat_arrays([o_a, o_b])
        for i, j in close_pairs(h_a, h_b, most, same):
            apart = np.bitwise_count(h_a[i] ^ h_b[j]).astype(np.int32)
            ordered = rank_a[i] != rank_b[j]
            i, j, apart = i[ordered], j[ordered], apart[ordered]
            swap, k = rank_a[i] > rank_b[j], j + len(h_a)
            yield pa.RecordBatch.from_arrays([both.take(pa.array(np.where(swap, k, i))), both.take(pa.array(np.where(swap, i, k))), pa.array(apart)], ["order_a", "order_b", "apart"])

    return run


def _best_earlier(most: int) -> Callable:
    """Kernel of (h, apart, o) for each hash that has an earlier one near it: how far and where the nearest is, of equals the earliest."""

    def run(h_a, o_a, h_b, o_b, same) -> Iterator[pa.RecordBatch]:
        rank_a, rank_b = _ranks(o_a, o_b)
        h, rank, none = np.concatenate([h_a, h_b]), np.concatenate([rank_a, rank_b]), np.iinfo(np.int64).max
        best = np.full(len(h), none)
        for i, j in close_pairs(h_a, h_b, most, same):
            k = j + (0 if same else len(h_a))
            apart = np.bitwise_count(h[i] ^ h[k]).astype(np.int64) << 48
            for early, late in ((i, k), (k, i)):
                earlier = rank[early] < rank[late]
                np.minimum.at(best, late[earlier], apart[earlier] | rank[early[earlier]])
        found = np.flatnonzero(best != none)
        first = np.empty(int(rank.max(initial=0)) + 1, np.int64)
        first[rank] = np.arange(len(rank))
        both = pa.concat_arrays([o_a, o_b])
        for at in range(0, len(found), 1 << 16):
            some = found[at : at + (1 << 16)]
            of = first[best[some] & ((1 << 48) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array((best[some] >> 48).astype(np.int32)), both.take(pa.array(of))], ["h", "apart", "o"])

    return run


def similar_pairs(rows: DataFrame, hash_: str = "p_hash", order: str = "ord", least: float = 0.95) -> DataFrame:
    """(order_a, order_b, similarity) for each pair, a before b, of rows that stand for their hash (``first_of_hash``), whose 64-bit
    hashes are alike by ``least`` or more. Copies of a hash are not expanded to pairs.

    At most d = floor(64 * (1 - least)) bits differ. Up to ``BANDED`` bits, of d + 1 bands one is equal (pigeonhole), and rows
    are joined on bands. Beyond, bands would be short and nearly all would meet several times: there each two blocks of hashes
    meet once, and in them those that are near in some band (``functions.hamming``); ``rows`` are counted for that."""
    most = int((1 - least) * 64 + 1e-9)
    values = rows.where(F.col(hash_).isNotNull() & F.col(order).isNotNull()).groupBy(F.col(hash_).alias("h")).agg(F.min(order).alias("o"))
    if most > BANDED:
        kind = rows.schema[order].dataType.simpleString()
        met = _met(values, rows.count(), _all_pairs(most), f"order_a {kind}, order_b {kind}, apart int")
        return met.select("order_a", "order_b", (1 - F.col("apart") / F.lit(64.0)).alias("similarity"))
    key = [F.shiftrightunsigned("h", shift).bitwiseAND(F.lit(mask)) for shift, mask in bands(most + 1)]
    banded = values.select("h", "o", F.posexplode(F.array(*key)).alias("band", "value"))
    a, b = banded.alias("a"), banded.alias("b")
    near = F.bit_count(F.col("a.h").bitwiseXOR(F.col("b.h"))) <= most
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.o") < F.col("b.o")) & near)
    found = met.select(F.col("a.o").alias("order_a"), F.col("b.o").alias("order_b"), hash_similarity(F.col("a.h"), F.col("b.h")).alias("similarity"))
    return found.dropDuplicates(["order_a", "order_b"])


def text_hash(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, h): a hash of the whole text of each row that has a word, whose bits are nearer the more alike the texts are. Bit k is
    set if it is set in more than half of the hashes (60 bits of MD5) of the text's runs of three words, or of all its words
    if there are fewer. Sums of bits combine before the shuffle."""
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    runs = F.when(F.size("w") < 4, F.array(F.array_join("w", " "))).otherwise(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " ")))
    each = rows.select(F.col(key).alias("key"), words.alias("w")).where(F.size("w") > 0).select("key", F.explode(runs).alias("r"))
    hashed = each.select("key", F.conv(F.substring(F.md5("r"), 1, 15), 16, 10).cast("long").alias("v"))
    sums = hashed.groupBy("key").agg(F.count("*").alias("n"), *[F.sum(F.shiftright("v", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(60)])
    bits = F.lit(0).cast("long")
    for k in range(60):
        bits = bits + F.when(2 * F.col(f"b{k}") > F.col("n"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return sums.select(F.col("key").alias(key), bits.alias("h"))


def _best_by_bands(first: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """(ow, b): the nearest of ``first`` (h, f) ahead of each of ``wanted`` (hw, ow), among those that have a band in common."""
    key = [F.shiftrightunsigned("h", shift).bitwiseAND(F.lit(mask)) for shift, mask in bands(most + 1)]
    candidates = first.select("h", F.col("f.o").alias("o"), F.col("f.n").alias("n"), F.posexplode(F.array(*key)).alias("band", "value"))
    w = wanted.select("hw", "ow", F.posexplode(F.array(*[F.shiftrightunsigned("hw", s).bitwiseAND(F.lit(m)) for s, m in bands(most + 1)])).alias("band", "value"))
    apart = F.bit_count(F.col("h").bitwiseXOR(F.col("hw")))
    return w.join(candidates, ["band", "value"]).where((F.col("o") < F.col("ow")) & (apart <= most)).groupBy("ow").agg(F.min(F.struct(apart.alias("d"), "o", "n")).alias("b"))


def near_duplicates(rows: DataFrame, hash_: str = "p_hash", name: str = "name", order: str = "ord", least: float = 0.95) -> DataFrame:
    """``rows`` with ``near_duplicate_of`` and ``similarity``: the most similar earlier row, the earliest of equals. Rows with a
    ``duplicate_of`` look for none, yet later rows may find them.

    Only the first row of each hash value can be the answer for others (it is the earliest of equals), so one row for
    each value takes part as a candidate and copies are never paired with each other. A later row of a hash has that
    first row for its answer, so above ``BANDED`` differing bits the first rows only are searched for, by blocks of hashes as in
    ``similar_pairs``, and each block gives one answer for a hash; ``rows`` are counted for that."""
    most = int((1 - least) * 64 + 1e-9)
    usable = rows.where(F.col(hash_).isNotNull() & F.col(order).isNotNull())
    first = usable.groupBy(F.col(hash_).alias("h")).agg(F.min(F.struct(F.col(order).alias("o"), F.col(name).alias("n"))).alias("f"))
    seeking = usable.where(F.col("duplicate_of").isNull()) if "duplicate_of" in rows.columns else usable
    wanted = seeking.groupBy(F.col(hash_).alias("hw"), F.col(order).alias("ow")).agg(F.lit(1).alias("one")).select("hw", "ow")
    apart = F.bit_count(F.col("h").bitwiseXOR(F.col("hw")))
    if most > BANDED:
        met = _met(first.select("h", F.col("f.o").alias("o")), rows.count(), _best_earlier(most), f"h long, apart int, o {rows.schema[order].dataType.simpleString()}")
        nearest = met.groupBy(F.col("h").alias("hw")).agg(F.min(F.struct("apart", "o")).alias("m"))
        named = nearest.join(first, (F.col("m.o") == F.col("f.o")) & (apart == F.col("m.apart"))).groupBy("hw").agg(F.min(F.struct(F.col("m.apart").alias("d"), F.col("f.o").alias("o"), F.col("f.n").alias("n"))).alias("other"))
        own = F.struct(F.lit(0).alias("d"), F.col("f.o").alias("o"), F.col("f.n").alias("n"))
        each = wanted.join(first.withColumnRenamed("h", "hw"), "hw").join(named, "hw", "left").select("ow", F.when(F.col("ow") > F.col("f.o"), own).otherwise(F.col("other")).alias("b"))
        best = each.where("b is not null").groupBy("ow").agg(F.min("b").alias("b"))
    else:
        best = _best_by_bands(first, wanted, most)
    out = rows.join(best, rows[order] == best["ow"], "left")
    return out.select(*[rows[c] for c in rows.columns], F.col("b.n").alias("near_duplicate_of"), (1 - F.col("b.d") / F.lit(64.0)).alias("similarity"))
