"""Quality rules by cross-document line frequency.

Lines are normalised (lower case, white space to single spaces) and hashed. For each host the distinct documents
that have a line are counted; exact copies of a text count as one document. A line is above the limit when it
stands in more than ``least`` documents of the host and in more than ``root`` times the square root of their number, so
the limit falls as a share of a host as the host grows (4 % of 500 documents, 0.01 % of 100 million), while chance
repetitions, which grow with a host as well, stay below it. Such lines are removed, and a document that is left with less than ``left`` of its words is depleted and rejected. Documents that fail the base rules are
rejected in any case: fewer than 50 words, or more than half of the words in repeated 3-word windows.

Words are runs other than space and \\x09-\\x0D. Null text has none. A line without a word is neither counted nor
removed. Null hosts are one host. Repeated rows (equal id, text and host) count once and are judged alike; rows
with equal ids but other texts are judged on their own. The counts cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, spare

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
LEAST, ROOT, LEFT = 10, 1.0, 0.30
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += bool(line.strip(SPACES))
        else:
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated(words)


def repeated(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    a = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    v = len(number)
    if v < 2_000_000:
        window = (a[:-2] * v + a[1:-1]) * v + a[2:]
    else:
        pair = np.unique(a[:-1] * v + a[1:], return_inverse=True)[1]
        window = pair[:-1] * v + a[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[k : n - 2 + k] |= twice
    return int(marked.sum())


def line_hash(line: str) -> int | None:
    """Signed 64-bit hash of the normalised line; null if it has no word."""
    words = line.lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return None
    h = xxhash.xxh64_intdigest(b" ".join(words))
    return h - (1 << 64) if h >= 1 << 63 else h


def line_words(text: str | None) -> dict[int, int]:
    """Words under each line hash of a text."""
    out: dict[int, int] = {}
    for line in (text or "").split("\n"):
        h = line_hash(line)
        if h is not None:
            out[h] = out.get(h, 0) + len(line.encode("utf-8", "surrogatepass").split())
    return out


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, host, content, base counts, lines) for each row; lines are (h, words), content is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = pa.struct([("h", pa.int64()), ("words", pa.int32())])
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, lines = [], []
                for x in part.column(3):
                    value = x.as_py()
                    counts.append(base_counts(value))
                    lines.append([{"h": h, "words": n} for h, n in line_words(value).items()])
                columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(BASE))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns, pa.array(lines, pa.list_(line))], ["key", "host", "content", *BASE, "lines"])

    source = docs.select(F.col(key).alias("key"), F.col(host).cast("string").alias("host"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("content"), F.col(text).alias("text"))
    line = T.StructType([T.StructField("h", T.LongType()), T.StructField("words", T.IntegerType())])
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("host", T.StringType()), T.StructField("content", T.LongType()), *(T.StructField(b, T.LongType()) for b in BASE), T.StructField("lines", T.ArrayType(line))])
    return source.mapInArrow(run, schema)


def frequent_lines(measured: DataFrame, least: int = LEAST, root: float = ROOT) -> DataFrame:
    """(host, h) of the lines above the limit."""
    each = measured.select("host", "content", F.explode("lines.h").alias("h")).distinct()
    counted = each.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > least)
    sizes = measured.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("n_host"))
    same = F.col("a.host").eqNullSafe(F.col("b.host"))
    return counted.alias("a").join(sizes.alias("b"), same).where(F.col("n") > root * F.sqrt("n_host")).select("a.host", "h")


def removed_lines(measured: DataFrame, least: int = LEAST, root: float = ROOT) -> DataFrame:
    """(key, content, host, removed, hashes) for the documents that have lines above the limit."""
    each = measured.select("key", "content", "host", F.explode("lines").alias("l")).select("key", "content", "host", F.col("l.h").alias("h"), F.col("l.words").alias("words"))
    lines = frequent_lines(measured, least, root)
    met = each.alias("a").join(lines.alias("b"), (F.col("a.h") == F.col("b.h")) & F.col("a.host").eqNullSafe(F.col("b.host"))).select("a.*").distinct()
    return met.groupBy("key", "content", "host").agg(F.sum("words").alias("removed"), F.collect_set("h").alias("hashes"))


def _same(columns: tuple[str, ...]):
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return out


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", least: int = LEAST, root: float = ROOT, left: float = LEFT) -> DataFrame:
    """(key, host, content, base counts, removed, hashes, base_failed, kept) for each row."""
    measured = cut(measure(docs, key, text, host))
    gone = removed_lines(measured, least, root)
    both = measured.drop("lines").alias("a").join(gone.alias("b"), _same(("key", "content", "host")), "left").select("a.*", F.coalesce("b.removed", F.lit(0)).cast("long").alias("removed"), "b.hashes")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("removed")) < left * F.col("n_words")
    return both.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def without_lines(text: str | None, hashes) -> str | None:
    """``text`` without the lines of these hashes."""
    if not text or not hashes:
        return text
    gone = set(hashes)
    return "\n".join(line for line in text.split("\n") if line_hash(line) not in gone)


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The kept rows of ``docs``, with all their columns, without the lines above the limit."""
    verdict = judge(docs, key, text, host).where("kept").select("key", "host", "content", "hashes").dropDuplicates(["key", "host", "content"])
    names = docs.columns
    own_key, own_host, own_content, gone = (spare(names, x) for x in ("key", "host", "content", "hashes"))
    tagged = docs.select("*", F.col(key).alias(own_key), F.col(host).cast("string").alias(own_host), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(own_content))
    same = F.col(f"d.{own_key}").eqNullSafe(F.col("v.key")) & F.col(f"d.{own_host}").eqNullSafe(F.col("v.host")) & (F.col(f"d.{own_content}") == F.col("v.content"))
    kept = tagged.alias("d").join(verdict.alias("v"), same).select(*[F.col(f"d.`{c}`") for c in names], F.col("v.hashes").alias(gone))
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([without_lines(t.as_py(), h.as_py()) for t, h in zip(batch.column(at), batch.column(len(names)))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 : len(names)]], names)

    return kept.mapInArrow(run, docs.schema)
