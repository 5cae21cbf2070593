"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly.

A word (a run of letters, lower-cased; of a long run each of its overlapping pieces) has features: itself and its n-grams of 3 to 5 characters with marks for
start and end, hashed to ``BUCKETS`` rows of an embedding. A word's vector is the mean of its features' rows, a
document's the mean of its different words' vectors and ``PADDING`` zero vectors, so that neither much repeated words
nor very short texts decide by chance. A linear layer with softmax turns that into two probabilities.
Both the rows and the layer are learned by Adagrad on the same loss, with steps that get smaller and an average over the
later half of the epochs, so that little depends on the order of documents; and a misspelling that was never seen has
the vectors of those n-grams that it shares with known words.

The layer is linear, so after training each feature counts by a single number; scoring adds these up over the
whole text, however long.

Training reads a bounded sample: about ``DOCS_PER_LABEL`` documents of each label, chosen by a hash of the id, of at
most about ``SAMPLE_BYTES`` together, with all their different words. Scoring reads whole texts of all documents. Without a training row of either label every score is 0.5. Null text and text without a letter get the
score of the bias alone. Rows with null labels or ids are not learned from; of several labels for one id the
largest counts. Repeated rows are scored alike.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

BUCKETS, DIM, SHORTEST, LONGEST = 1 << 17, 8, 3, 5
DOCS_PER_LABEL, SAMPLE_BYTES = 2500, 256 << 20
EPOCHS, BATCH, RATE, START, GAIN, PADDING, DECAY = 16, 64, 0.3, 1e-8, 8.0, 30, 1e-3
#: Share of a document's words that each epoch leaves out at random, so that rare words can't stand for a document.
DROP = 0.7
#: A feature of n training documents counts by n / (n + DOUBT): what was met rarely is trusted less, but never left out.
DOUBT = 16.0
#: How far the rarer label counts as much as the other: 0 not at all, 1 wholly.
BALANCE = 0.75
#: Longer runs of letters count as consecutive pieces of this length, which overlap so that every n-gram is in one.
WORD_CHARS = 64
_WORD = re.compile(r"[^\W\d_]+")
_KEPT_WORDS = 250_000


def features(word: str) -> list[int]:
    """Rows of the embedding for a word: the whole word and its n-grams."""
    marked = f"<{word}>"
    parts = [marked, *(marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1) if n < len(marked))]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def pieces(run: str) -> list[str]:
    """A run of letters, or the pieces of a long one."""
    if len(run) <= WORD_CHARS:
        return [run]
    shared = LONGEST - 1
    return [run[at : at + WORD_CHARS] for at in range(0, len(run) - shared, WORD_CHARS - shared)]


def words(text: str | None) -> list[str]:
    return [p for run in _WORD.findall(text.lower()) for p in pieces(run)] if text else []


class Model:
    """What scoring needs: a number for each feature, and the bias."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def scorer(self):
        """A function from texts to scores that keeps the numbers of words it has seen, up to a bound."""
        weight, bias, known = self.weight, self.bias, {}

        def word(w: str) -> float:
            rows = features(w)
            return float(weight[rows].sum()) / len(rows)

        def score(text: str | None) -> float:
            nonlocal known
            found = set(words(text))
            if len(known) > _KEPT_WORDS:
                known = {}
            total = 0.0
            for w in found:
                x = known.get(w)
                if x is None:
                    x = known[w] = word(w)
                total += x
            z = bias + total / (len(found) + PADDING)
            return 1.0 / (1.0 + exp(-z)) if z >= 0 else exp(z) / (1.0 + exp(z))

        return score


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Train on the driver; texts are few and bounded."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    vocabulary: dict[str, int] = {}
    bags = []
    for t in texts:
        bag = dict.fromkeys(words(t))
        bags.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in bag), np.int64, len(bag)))
    held, ends_at = array("i"), array("q", [0])
    for w in vocabulary:
        held.extend(features(w))
        ends_at.append(len(held))
    flat, starts = np.frombuffer(held, np.int32), np.frombuffer(ends_at, np.int64)
    sizes = np.diff(starts)
    spread = np.zeros(BUCKETS, np.int64)
    for ids in bags:
        spread[np.unique(np.concatenate([np.zeros(0, np.int64), *[flat[starts[i] : starts[i + 1]] for i in ids]]))] += 1
    trust = (spread / (spread + DOUBT))[:, None]
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = rng.uniform(-0.5, 0.5, (DIM, 2)), np.zeros(2)
    seen_table, seen_layer, seen_bias = np.full(BUCKETS, START), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    y = np.asarray(labels)
    balance = (len(y) / (2.0 * np.bincount(y, minlength=2)[:2])) ** BALANCE
    per_row = lambda at, values, n: np.stack([np.bincount(at, weights=values[:, d], minlength=n) for d in range(values.shape[1])], axis=1)
    total, offset, taken = np.zeros(BUCKETS), 0.0, 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(y))
        kept = [b[rng.random(len(b)) >= DROP] for b in bags]
        for at in range(0, len(y), BATCH):
            batch = [b for b in order[at : at + BATCH] if len(kept[b])]
            if not batch:
                continue
            doc = np.repeat(np.arange(len(batch)), [len(kept[b]) for b in batch])
            share = np.concatenate([np.full(len(kept[b]), 1.0 / (len(kept[b]) + PADDING)) for b in batch])
            own, inverse = np.unique(np.concatenate([kept[b] for b in batch]), return_inverse=True)
            n = sizes[own]
            ends = np.cumsum(n)
            place = np.arange(ends[-1]) + np.repeat(starts[own] - (ends - n), n)
            used, slot = np.unique(flat[place], return_inverse=True)
            own_trust = trust[used]
            vectors = np.add.reduceat((table[used] * own_trust)[slot], ends - n, axis=0) / n[:, None]
            mean = per_row(doc, vectors[inverse] * share[:, None], len(batch))
            logits = GAIN * mean @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p *= balance[y[batch]][:, None] / len(batch)
            to_layer, to_bias, to_mean = GAIN * mean.T @ p, p.sum(axis=0), GAIN * p @ layer.T
            to_vectors = per_row(inverse, to_mean[doc] * share[:, None], len(own)) / n[:, None]
            to_table = per_row(slot, np.repeat(to_vectors, n, axis=0), len(used)) * own_trust
            seen_table[used] += (to_table**2).mean(axis=1)
            table[used] -= rate * (to_table / np.sqrt(seen_table[used])[:, None] + DECAY * table[used])
            seen_layer += to_layer**2
            layer -= rate * to_layer / np.sqrt(seen_layer)
            seen_bias += to_bias**2
            bias -= rate * to_bias / np.sqrt(seen_bias)
        if 2 * epoch >= EPOCHS:
            total += GAIN * (trust * table) @ (layer[:, 1] - layer[:, 0])
            offset, taken = offset + float(bias[1] - bias[0]), taken + 1
    return Model((total / taken).astype(np.float32), offset / taken)


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_label: int = DOCS_PER_LABEL, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels of about ``per_label`` documents of each label. Ids are chosen among the labels first, so only
    the chosen ids meet the documents. Their number is bounded in expectation; they are broadcast if it is so in fact, and
    joined by shuffle otherwise. Where their texts have more than ``most_bytes``, the share is lessened in proportion."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).cast("int").alias("label"))
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return [], []
    place = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000.0
    share = F.when(F.col("label") == 1, per_label / sizes[1]).otherwise(per_label / sizes[0])
    chosen = cut(known.withColumn("part", place / share).where("part < 1"))
    if chosen.count() <= 4 * per_label:
        chosen = F.broadcast(chosen)
    found = cut(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key").select("key", "text", "label", "part"))
    total = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = found.where(F.col("part") < min(1.0, most_bytes / max(1, total))).select("key", "text", "label").collect()
    rows.sort(key=lambda r: (r["key"], r["text"] or ""))
    return [r["text"] or "" for r in rows], [r["label"] for r in rows]


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``score`` and ``predicted``, which replace columns of those names."""
    kept = [c for c in docs.columns if c not in (text, "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            out = [score(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32())], [*batch.schema.names[1:], "score", "predicted"])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(F.col(text).alias("__whole_text"), *kept).mapInArrow(run, schema)
