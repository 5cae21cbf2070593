"""Language identification by rank-order profiles.

A profile lists the most frequent n-grams of letters (lengths 1 to 3, words padded by one space) of a language
by rank. A document's own profile is compared to each: every n-gram of the document adds the difference of its
two ranks, or the most that is possible where the language's profile lacks it. The least sum wins; ties go to
the language that sorts first.

Profiles are fitted on a bounded sample: about ``docs_per_lang`` labelled documents of each language, chosen by
a hash of the id, so the sample does not grow with the input. Every document is predicted from its whole text.

Null text and text without a letter are ``und`` with score 0. With no labelled row at all every document is
``und``. score is 1 - d1 / d2 for the sums of the best and second-best language, or 1 - d1 / most if there is
one language only: 0 for a tie, larger the clearer. Repeated rows are predicted alike; null ids count as empty
text where they choose folds and samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROFILE = 300
DOCS_PER_LANG = 400
#: Code points below this have a class by table; those above share classes by remainder.
TABLE = 0x3000
#: n-grams are packed in 63 bits: three code points of 21 bits.
BITS = 21


def _fold_table() -> np.ndarray:
    """Lower-cased code point for each letter below TABLE, and 32 for everything else."""
    out = np.full(TABLE, 32, np.int64)
    for c in range(TABLE):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


FOLD = _fold_table()


def fold(text: str) -> np.ndarray:
    """Letters in lower case, any run of other characters as one space, and a space at either end. Empty if
    there is no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if points.size == 0:
        return np.zeros(0, np.int64)
    folded = FOLD[np.minimum(points, TABLE - 1)]
    if points.max() >= TABLE:
        for i in np.flatnonzero(points >= TABLE):
            c = chr(points[i])
            folded[i] = ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32
    folded = np.concatenate(([32], folded, [32]))
    keep = np.ones(folded.size, bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    folded = folded[keep]
    return folded if folded.size > 1 else np.zeros(0, np.int64)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of lengths 1 to 3 with their counts. A gram that has a space inside spans two words and
    is left out, as is the lone space."""
    a = fold(text)
    if a.size < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = a != 32
    two = (a[:-1] << BITS) | a[1:]
    three = (two[:-1] << BITS) | a[2:]
    return np.unique(np.concatenate((a[letter], two, three[letter[1:-1]])), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    if codes.size > most:
        least = np.partition(counts, codes.size - most)[codes.size - most]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:most]]


def learn(labelled: DataFrame, text: str, lang: str, key: str, docs_per_lang: int = DOCS_PER_LANG, most: int = PROFILE) -> dict[str, list[int]]:
    """Profile by language from rows whose ``lang`` is not null. Two passes: rows are counted by language, then
    a share of each language's rows is read. What comes to the driver is bounded by languages and ``most``."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, docs_per_lang / n))])
    place = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("profiles")), F.lit(1_000_000)) / 1_000_000.0
    sample = rows.where(place < F.element_at(share, F.col(lang))).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[int, int]] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sums.setdefault(name, {})
                for c, n in zip(*(x.tolist() for x in grams(value))):
                    own[c] = own.get(c, 0) + n
        for name, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])

    from pyspark.sql import Window

    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    profiles: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", most: int = PROFILE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, which replace columns of those names."""
    names = sorted(profiles)
    table = {g: i for i, g in enumerate(sorted({g for p in profiles.values() for g in p}))}
    known = np.array(sorted(table), np.int64)
    ranks = np.full((len(known) + 1, max(1, len(names))), -1, np.int64)
    for k, name in enumerate(names):
        for r, g in enumerate(profiles[name]):
            ranks[table[g], k] = r

    def judge(value: str | None) -> tuple[str, float]:
        codes = ranked(*grams(value), most) if value else ()
        if not names or len(codes) == 0:
            return "und", 0.0
        at = np.searchsorted(known, codes)
        at[at == len(known)] = 0
        at[known[at] != codes] = len(known)
        theirs = ranks[at]
        sums = np.where(theirs < 0, most, np.abs(theirs - np.arange(len(codes))[:, None])).sum(axis=0)
        order = np.lexsort((np.arange(len(names)), sums))
        least = float(sums[order[0]])
        second = float(sums[order[1]]) if len(names) > 1 else float(most * len(codes))
        return names[order[0]], max(0.0, 1.0 - least / second) if second else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [judge(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[extra:], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], [*batch.schema.names[extra:], "lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    extra = int(text not in kept)
    at = 0 if extra else kept.index(text)
    fields = [docs.schema[c] for c in kept]
    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*[F.col(text).alias("__whole_text")] * extra, *kept).mapInArrow(run, schema)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train: Column | None = None) -> DataFrame:
    """Learn from the rows where ``train`` holds (all, if not given) and predict every row from its text alone.
    Only the key and the predictions are returned, with the columns that ``docs`` has besides text and lang."""
    labelled = docs if train is None else docs.where(train)
    profiles = learn(labelled, text, lang, key)
    return predict(docs, profiles, text)
