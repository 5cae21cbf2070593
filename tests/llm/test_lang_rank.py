"""Rank-order language profiles against a plain version, and held-out accuracy on the synthetic documents."""

from collections import Counter

from pyspark.sql import functions as F

from siftstone.llm import queries
from siftstone.llm.lang_rank import BITS, grams, identify, learn, predict, ranked

DATA = "/root/testdata/sf0.01"


def plain(text):
    letters = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else " " for c in text).split()
    out = Counter()
    for w in letters:
        w = f" {w} "
        for n in (1, 2, 3):
            out.update(w[i : i + n] for i in range(len(w) - n + 1) if w[i : i + n] != " ")
    return out


def unpack(code):
    out = ""
    while code:
        out, code = chr(code & ((1 << BITS) - 1)) + out, code >> BITS
    return out


def test_grams_equal_a_plain_count():
    for text in ("Hello, World! It's me.", "ÉTÉ été naïve", "a", "", "123 --", "Привет мир", "漢字かな 漢", "x" * 500, " one  two\tthree\n"):
        codes, counts = grams(text)
        assert {unpack(c): n for c, n in zip(codes.tolist(), counts.tolist())} == plain(text), text
        order = [unpack(c) for c in ranked(codes, counts, 5).tolist()]
        assert [plain(text)[g] for g in order] == sorted(plain(text).values(), reverse=True)[:5]


def out_of_place(text, profiles, most):
    codes = ranked(*grams(text), most).tolist()
    return {k: sum(abs(p.index(c) - i) if c in p else most for i, c in enumerate(codes)) for k, p in profiles.items()}


def test_prediction_equals_plain_distances(spark):
    rows = [(1, "the cat sat on the mat and the dog", "en"), (2, "le chat est sur la table avec le chien", "fr"), (3, "der hund ist auf dem tisch und die katze", "de"), (4, None, None), (5, "", "en"), (6, "123 456", None), (7, "the dog " * 3000, None), (7, "the dog " * 3000, None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string")
    profiles = learn(docs, "text", "lang", "doc_id")
    got = predict(docs, profiles).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["text"]
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        sums = sorted((d, k) for k, d in out_of_place(text, profiles, 300).items())
        assert r["lang_pred"] == sums[0][1]
        assert abs(r["score"] - (1 - sums[0][0] / sums[1][0] if sums[1][0] else 0)) < 1e-12
    assert identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r["lang_pred"] for r in identify(docs, train=F.col("lang") == "en").collect()} == {"und", "en"}


def test_held_out_accuracy(spark):
    out = queries.QUERIES["op9_language_ranks"](spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    both = out.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*"), F.min("score"), F.max("score")).first()
    assert both[0] > 0.98 and both[1] > 150 and 0 <= both[2] <= both[3] <= 1
