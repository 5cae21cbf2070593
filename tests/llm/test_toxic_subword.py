"""Toxicity: what is learned, what misspellings get, and held-out accuracy on the synthetic documents."""

import random

from pyspark.sql import functions as F

from siftstone.llm import queries
from siftstone.llm.toxic_subword import BUCKETS, LONGEST, WORD_CHARS, features, fit, pieces, sample, score_documents, words

DATA = "/root/testdata/sf0.1"


def test_features():
    rows = features("idiot")
    assert len(rows) == 1 + 5 + 4 + 3 and all(0 <= r < BUCKETS for r in rows)
    assert set(features("idiot")) & set(features("idioot")) and features("a") and all(len(features(p)) < 200 for p in pieces("x" * 9999))
    assert words(None) == words("") == words("12 --") == [] and words("A b’c_D9é") == ["a", "b", "c", "d", "é"]


def made(rng, n, bad):
    clean = ["table", "river", "garden", "window", "people", "morning", "letter", "simple", "number", "yellow"]
    out = [rng.choice(clean) for _ in range(n)]
    for _ in range(bad):
        out[rng.randrange(n)] = rng.choice(["worthless", "disgusting", "pathetic"])
    return " ".join(out)


def test_misspellings_and_edges(spark):
    rng = random.Random(1)
    texts = [made(rng, 80, 4 * (i % 2)) for i in range(300)]
    model = fit(texts, [i % 2 for i in range(300)])
    score = model.scorer()
    assert score(made(rng, 60, 3)) > 0.5 > score(made(rng, 60, 0))
    assert score("table river worthles people morning disgustingg number pathetik window") > 0.5
    assert score(None) == score("") == score("123") and 0 <= score("") <= 1
    assert fit([], []).scorer()("anything") == 0.5 and fit(["a"], [1]).scorer()("a") == 0.5
    docs = spark.createDataFrame([(1, texts[0], "x"), (1, texts[0], "x"), (2, None, "x"), (3, "worthless " * 30000, "x")], "doc_id long, text string, score string")
    got = score_documents(docs, model).collect()
    assert len(got) == 4 and got[0]["score"] == got[1]["score"] and all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert score_documents(docs.limit(0), model).count() == 0


def test_long_runs_are_scored_whole():
    rng = random.Random(2)
    for n in (1, 63, 64, 65, 68, 69, 124, 125, 5000):
        run = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
        parts = pieces(run)
        assert all(len(p) <= WORD_CHARS for p in parts) and words(run) == parts and (n > WORD_CHARS or parts == [run])
        assert {run[i : i + LONGEST] for i in range(n - LONGEST + 1)} <= {p[i : i + LONGEST] for p in parts for i in range(len(p))}
        assert parts[0][:1] == run[:1] and parts[-1][-1:] == run[-1:]
    texts = [made(rng, 80, 4 * (i % 2)) for i in range(300)]
    score = fit(texts, [i % 2 for i in range(300)]).scorer()
    glued = "tablerivergardenwindowpeople" * 3
    assert score(glued + "worthlessdisgustingpathetic" * 40) > score(glued + "tableriversimplenumber" * 40)


def test_sample_is_bounded_and_takes_the_largest_label(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic")).union(spark.createDataFrame([(0, 1), (4, None), (None, 1)], "doc_id long, toxic int"))
    texts, ys = sample(docs, labels, "doc_id", "text", "toxic", per_label=100)
    assert 120 < len(texts) < 280 and all(y == int(t[1:]) % 2 or t == "t0" for t, y in zip(texts, ys))
    some, _ = sample(docs, labels, "doc_id", "text", "toxic", per_label=100, most_bytes=200)
    assert 20 < len(some) < 80
    assert sample(docs, labels.where("toxic = 1"), "doc_id", "text", "toxic") == ([], [])


def test_held_out_accuracy(spark):
    """With the some 350 toxic documents that this table has to learn from; more of them give more."""
    out = queries.QUERIES["op10_toxic_subwords"](spark, DATA)
    rows = out.where("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").select("toxic", "score").collect()
    bad, good = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    ranked = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert ranked > 0.9
    assert sum(b >= 0.5 for b in bad) / len(bad) > 0.7 and sum(g >= 0.5 for g in good) / len(good) < 0.05
