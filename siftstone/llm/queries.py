"""The operators' queries over the synthetic tables: one for each, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op3_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_tree import round_trip
    from .common import table

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op9_language_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .common import id_remainder, table
    from .lang_rank import learn, predict

    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 4) == 2
    profiles = learn(docs.where(~held_out), "text", "lang", "doc_id")
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


@query
def op4_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table
    from .simhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_toxic_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import id_remainder, table
    from .toxic_subword import fit, sample, score_documents

    docs, held_out = table(spark, sf_dir, "documents"), id_remainder("doc_id", 5) == 0
    texts, labels = sample(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out), "doc_id", "text", "toxic")
    return score_documents(docs.select("doc_id", held_out.alias("held_out"), "text"), fit(texts, labels))


@query
def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table
    from .line_quality import BASE, judge

    return judge(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id").select("doc_id", *BASE, "base_failed", "kept", "removed")


@query
def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bestfit_pack import pack
    from .common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table
    from .warc_zstd import read_archives, stored, write_archives

    archives = stored(write_archives(table(spark, sf_dir, "pages")))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_rare_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table
    from .rare_digest import compare_with_next, learn_ranks

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compare_with_next(docs, learn_ranks(docs))


#: The rules that the contract of op1 names.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query
def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table
    from .url_trust import judge

    return judge(table(spark, sf_dir, "pages"), RULES).drop("trust", "distrust")


@query
def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table
    from .pii_surrogate import replace

    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_replaced")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_URL_PARTS = r"""u as (select page_id, coalesce(html, '') as html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
 n as (select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from u)"""
_RULE_ROWS = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)

ORACLES["op1_url_trust"] = rf"""with recursive {_URL_PARTS}, rules(verdict, rule, rhost, rpath) as (values {_RULE_ROWS}),
 j as (select n.*, (select max({{'k': length(rule), 'rule': rule, 'verdict': verdict}}) from rules where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)) as r from n),
 l as (select distinct page_id, html, host as src, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s"''<>]+)', 1)) as raw from n),
 e as (select src, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst, count(distinct page_id) as n from l group by 1, 2 having src <> dst and src <> ''),
 w as (select src as h, dst as t, 0 as kind, 0.85 * n / sum(n) over (partition by src) as part from e union all select dst, src, 1, 0.85 * n / sum(n) over (partition by dst) from e),
 s as (select host, kind, 0.15 * avg((coalesce(r.verdict, '') = (case kind when 0 then 'allow' else 'block' end))::int) as score from j, (values (0), (1)) k(kind) group by 1, 2),
 p as (select host, kind, score, 0 as step from s where score > 0 union all select w.t, w.kind, sum(p.score * w.part), any_value(p.step) + 1 from p join w on w.h = p.host and w.kind = p.kind where p.step < 300 group by w.t, w.kind),
 g as (select host, sum(score) filter (kind = 1) as bad, sum(score) filter (kind = 0) as good from p group by 1)
 select page_id, j.host, path, r.rule as rule, coalesce(r.verdict, case when coalesce(bad, 0) - coalesce(good, 0) > 1e-6 then 'block' else 'allow' end) as verdict from j left join g on g.host = j.host"""

ORACLES["op7_warc_zstd"] = """with p as (select page_id, encode(coalesce(html, '')) as b from pages), f as (select *, min(page_id) over (partition by b) as first from p),
 d as (select *, array_to_string(list_transform(string_split(sha1(b), ''), lambda c: lpad(bin(('0x' || c)::int), 4, '0')), '') as bits from f)
 select page_id, octet_length(b)::bigint as payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ('0b' || substr(bits, i * 5 + 1, 5))::int + 1, 1)), '') as payload_digest,
 case when first = page_id then 'response' else 'revisit' end as record_type, nullif(first, page_id) as refers_to from d"""

_WORD = r"[^\x20\x09-\x0D]+"
ORACLES["op6_line_frequency"] = rf"""with t as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
 x as (select doc_id, i, w[i:i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from t)),
 twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from x) where n > 1),
 marked as (select doc_id, count(distinct i + k) as n from twice, range(0, 3) r(k) group by 1),
 lines as (select doc_id, source, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from t),
 dup as (select doc_id, count(*) as n from (select doc_id, line, row_number() over (partition by doc_id, line order by pos) as k from lines) where k > 1 and regexp_matches(line, '{_WORD}') group by 1),
 normal as (select doc_id, source, text, array_to_string(regexp_extract_all(lower(line), '{_WORD}'), ' ') as line, len(regexp_extract_all(line, '{_WORD}')) as words from lines where regexp_matches(line, '{_WORD}')),
 hosts as (select source, count(distinct text) as n from t group by 1), often as (select l.source, line from normal l join hosts h on h.source is not distinct from l.source group by l.source, line, h.n having count(distinct text) > 10 and count(distinct text) > sqrt(h.n)),
 gone as (select doc_id, sum(words)::bigint as n from normal l join often o on o.source is not distinct from l.source and o.line = l.line group by 1),
 c as (select t.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda z: length(z))), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(marked.n, 0)::bigint as n_repeat_words, coalesce(gone.n, 0)::bigint as removed
 from t left join marked using (doc_id) left join dup using (doc_id) left join gone using (doc_id)), b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not (n_words - removed < 0.30 * n_words) as kept, removed from b"""
