"""The five stages on a small corpus, each against a plain version of its own; and the registered queries."""

import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from siftstone.llm import queries

from .test_line_quality import plain_judge
from .test_simhash_dedup import plain_components, plain_fingerprint

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def corpus():
    rng = random.Random(11)
    words = {"en": "the of and in to house river people water morning garden letter".split(), "de": "der die und das haus fluss leute wasser morgen garten brief nicht".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "", "s", "er", "en"]) + str(rng.choice("abcdefgh")) for _ in range(n))
    rows = [(i, text("en" if i % 3 else "de", 120) + "\n" + text("en", 40), "en" if i % 3 else "de", f"s{i % 2}") for i in range(40)]
    base = rows[1][1]
    rows += [(100 + i, base, "en", "s0") for i in range(4)] + [(200, base.replace("the", "tha", 1), None, "s1"), (201, "12 34 --", "en", "s0"), (202, None, None, None), (203, "", "en", "s0"), (204, "too short", "en", "s0"), (205, "same words here " * 60, "en", "s0"), (206, text("en", 60) + " mail to jane.doe7@mail3.example.com or 10.20.30.40 now", "en", "s1")]
    return [(k, t, lang, s, None if t is None else len(t), "clash") for k, t, lang, s in rows]


def test_stages(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    first = dict(corpus_pipeline.STAGES)
    assert list(first) == ["language_id", "quality_rules", "near_dedup", "pii", "packing"] and corpus_pipeline.ORACLE_SQL is None

    known = first["language_id"](spark, docs, "")
    assert known.columns == docs.columns
    assert {r["doc_id"] for r in known.collect()} == {r[0] for r in corpus()} - {201, 202, 203}
    assert all(r["lang"] for r in known.collect())

    rows = [(r["doc_id"], r["text"], r["source"]) for r in known.collect()]
    good = first["quality_rules"](spark, known, "")
    want = {w[0]: w[-1] for w in plain_judge(rows, 10, 0.10, 0.30) if w[-3]}
    assert good.columns == docs.columns and {r["doc_id"]: r["text"] for r in good.collect()} == want and not {204, 205} & set(want)
    assert all(r["n_chars"] == len(r["text"]) for r in good.collect())

    single = first["near_dedup"](spark, good, "")
    group = plain_components(sorted({plain_fingerprint(t) for t in want.values()}))
    least = {}
    for k, t in want.items():
        g = group[plain_fingerprint(t)]
        least[g] = min(k, least.get(g, k))
    assert {r["doc_id"] for r in single.collect()} == set(least.values()) and not {100, 200} & set(least.values())

    safe = {r["doc_id"]: r["text"] for r in first["pii"](spark, single, "").collect()}
    assert "jane.doe7" not in safe[206] and "10.20.30.40" not in safe[206] and re.search(r"\S+@\S+\.com or \d+\.\d+\.\d+\.\d+ now", safe[206])
    assert all(safe[k] == want[k] for k in safe if k != 206)

    packed = first["packing"](spark, first["pii"](spark, single, ""), "").collect()
    t = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: t.encode(x, add_special_tokens=False).ids + [0] for k, x in safe.items()}
    assert {(r["doc_id"], r["length"], r["ids_crc32"]) for r in packed} == {(k, len(v), zlib.crc32(struct.pack(f"<{len(v)}I", *v))) for k, v in ids.items()}


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0


def test_run_over_the_table(spark):
    out = queries.QUERIES["pipeline"](spark, DATA).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    kept = {r["doc_id"] for r in out}
    assert kept <= docs and 0.5 * len(docs) < len(kept) < len(docs)
    fill = Counter()
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    out = queries.QUERIES[name](spark, DATA)
    columns = sorted(out.columns)
    want = c.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    place = [names.index(x) for x in columns]
    assert sorted(repr(tuple(r)) for r in out.select(columns).collect()) == sorted(repr(tuple(r[i] for i in place)) for r in want.fetchall())


def test_a_query_for_each_operator():
    assert [f"op{n}_" for n in range(1, 11)] == sorted({re.match(r"op\d+_", q).group() for q in queries.QUERIES if q.startswith("op")}, key=lambda x: int(x[2:-1]))
