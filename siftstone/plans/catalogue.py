"""Registered queries of the inspection engine, each with the DuckDB SQL that gives the same rows.

``files`` is the table ``documents`` with its text as content; ``embeddings`` are rasters of 8 x 8 values; metadata fields come
from events and from customers and suppliers. Every query runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytesops as B
from ..functions.shipping import ship
from ..operators import batch, duplicates, entities, identity, logs, metadata, raster, rules
from ..sources import files as S
from ..sources import hidden

QUERIES: dict = {}
ORACLES: dict = {}

#: Prefixes that give the documents different signatures, by doc_id modulo their number.
PREFIXES = ["", "FFD8FFE0", "89504E470D0A1A0A", "474946383961", "52494646000000005745425000", "424D", "49492A00", "000000186674797061766966", "000000186674797068656963", "000000186674797069736F6D"]
SUFFIXES = [".jpg", ".png", ".gif", ".txt", "", ".webp", ".heic"]


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("doc_id").alias("ord"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))


def signed(spark: SparkSession, d: str) -> DataFrame:
    """Documents behind the prefixes of known file types, with names that often do not fit."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.pmod("doc_id", F.lit(n)) + 1).cast("int"))
    return read(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("f"), "doc_id", pick(SUFFIXES, len(SUFFIXES))).alias("name"), F.concat(F.unhex(pick(PREFIXES, len(PREFIXES))), F.encode("text", "UTF-8")).alias("content"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("p"))


HEX_BYTES = "regexp_extract_all(hex(encode(text)), '[0-9A-F]{2}')"


@query("select doc_id as file_id, sha256(text) as sha256, sha1(text) as sha1, md5(text) as md5 from documents")
def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    return identity.identity(files(spark, d), entropy=False).select("file_id", "sha256", "sha1", "md5")


@query()
def file_crc32(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("file_id", B.crc32_hex(F.col("content")).alias("crc32"))


@query(f"select b as byte, count(*) as n from (select unnest({HEX_BYTES}) as b from documents) group by 1")
def byte_histogram(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select(F.explode(B.byte_pairs(F.col("content"))).alias("byte")).groupBy("byte").agg(F.count("*").alias("n"))


@query(f"select doc_id as file_id, round(entropy(b), 6) as entropy, count(*) as n_bytes from (select doc_id, unnest({HEX_BYTES}) as b from documents) group by 1")
def byte_entropy(spark: SparkSession, d: str) -> DataFrame:
    return identity.entropy_table(files(spark, d)).select("file_id", F.round("entropy", 6).alias("entropy"), "n_bytes")


@query(f"with b as (select doc_id, unnest({HEX_BYTES}) as b, generate_subscripts({HEX_BYTES}, 1) as i from documents) select doc_id as file_id, (i - 1) // 1024 as block, round(entropy(b), 6) as entropy, count(*) as n_bytes from b group by 1, 2")
def block_entropy(spark: SparkSession, d: str) -> DataFrame:
    return identity.entropy_table(files(spark, d), block=1024).select("file_id", "block", F.round("entropy", 6).alias("entropy"), "n_bytes")


_SIGNED = f"""with f as (select doc_id as file_id, 'f' || doc_id || ({SUFFIXES!r})[(doc_id % {len(SUFFIXES)} + 1)::int] as name,
 ({PREFIXES!r})[(doc_id % {len(PREFIXES)} + 1)::int] || hex(encode(text)) as h from documents), t as (select file_id, name, regexp_extract(name, '\\.[^.]*$') as extension,
 case when h like 'FFD8FF%' then 'JPEG' when h like '89504E470D0A1A0A%' then 'PNG' when h like '474946383761%' or h like '474946383961%' then 'GIF'
 when h like '52494646%' and h[17:24] = '57454250' then 'WebP' when h like '424D%' then 'BMP' when h like '49492A00%' or h like '4D4D002A%' then 'TIFF'
 when h[9:16] = '66747970' and length(h) >= 24 then case h[17:24] when '61766966' then 'AVIF' when '61766973' then 'AVIF' when '68656963' then 'HEIF/HEIC' else 'ISO-BMFF' end else 'Unknown' end as detected_type from f)"""


@query(_SIGNED + " select file_id, detected_type, extension from t")
def magic_classify(spark: SparkSession, d: str) -> DataFrame:
    return identity.identity(signed(spark, d), entropy=False).select("file_id", "detected_type", "extension")


@query(
    _SIGNED
    + """ select file_id, case detected_type when 'JPEG' then extension not in ('.jpg', '.jpeg') when 'PNG' then extension <> '.png' when 'GIF' then extension <> '.gif' when 'WebP' then extension <> '.webp'
 when 'BMP' then extension <> '.bmp' when 'TIFF' then extension not in ('.tif', '.tiff', '.dng') when 'AVIF' then extension <> '.avif' when 'HEIF/HEIC' then extension not in ('.heic', '.heif', '.hif') else false end as extension_mismatch,
 case extension when '.jpg' then 'image/jpeg' when '.png' then 'image/png' when '.gif' then 'image/gif' when '.webp' then 'image/webp' when '.heic' then 'image/heif' else 'application/octet-stream' end as declared_mime from t"""
)
def extension_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return identity.identity(signed(spark, d), entropy=False).select("file_id", "extension_mismatch", "declared_mime")


@query("select doc_id as file_id, nullif(first_value('doc_' || doc_id || '.txt') over (partition by sha256(text) order by doc_id), 'doc_' || doc_id || '.txt') as duplicate_of from documents")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d).select("file_id", "ord", "name", F.sha2("content", 256).alias("sha256"))
    return duplicates.exact_duplicates(rows).select("file_id", "duplicate_of")


_CELLS = "c as (select vec_id, i - 1 as i, (i - 1) % 8 as x, (i - 1) // 8 as y, embedding[i]::double as v from embeddings, range(1, 65) r(i))"
_BIT = "case when i = 63 then -9223372036854775808 else (1::bigint << i::int) end"
_AHASH = f"{_CELLS}, m as (select vec_id, sum(v order by i) / 64 as mu from c group by 1), ah as (select vec_id, bit_or(case when v >= mu then {_BIT} else 0::bigint end) as h from c join m using (vec_id) group by 1)"


def hashes(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("vec_id", raster.average_hash(F.col("p")).alias("h"))


@query(f"with {_AHASH} select vec_id, h as a_hash, lpad(lower(printf('%x', h)), 16, '0') as a_hash_hex from ah")
def ahash(spark: SparkSession, d: str) -> DataFrame:
    return hashes(spark, d).select("vec_id", F.col("h").alias("a_hash"), B.hash_to_hex(F.col("h")).alias("a_hash_hex"))


@query(f"with {_CELLS} select a.vec_id, bit_or(case when a.v > b.v then 1::bigint << (a.y * 7 + a.x)::int else 0::bigint end) as d_hash from c a join c b on a.vec_id = b.vec_id and a.y = b.y and b.x = a.x + 1 group by 1")
def dhash_cells(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("vec_id", raster.difference_hash(F.col("p"), 8, 8).alias("d_hash"))


@query(f"with {_AHASH}, f as (select h, min(vec_id) as o from ah group by 1) select a.o as vec_a, b.o as vec_b, 1 - bit_count(xor(a.h, b.h)) / 64.0::double as similarity from f a join f b on a.o < b.o and bit_count(xor(a.h, b.h)) <= 16")
def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.similar_pairs(hashes(spark, d), "h", "vec_id", 0.75).select(F.col("order_a").alias("vec_a"), F.col("order_b").alias("vec_b"), "similarity")


_TOP1 = f"""with {_AHASH}, p as (select b.vec_id, a.vec_id as other, bit_count(xor(a.h, b.h)) as dist from ah a join ah b on a.vec_id < b.vec_id and bit_count(xor(a.h, b.h)) <= 16),
 t as (select *, row_number() over (partition by vec_id order by dist, other) as rn from p) select e.vec_id, 'v' || t.other as near_duplicate_of, 1 - t.dist / 64.0::double as similarity from embeddings e left join t on t.vec_id = e.vec_id and rn = 1"""


@query(_TOP1)
def near_duplicates_top1(spark: SparkSession, d: str) -> DataFrame:
    rows = hashes(spark, d).withColumn("name", F.concat(F.lit("v"), "vec_id"))
    return duplicates.near_duplicates(rows, "h", "name", "vec_id", 0.75).select("vec_id", "near_duplicate_of", "similarity")


_BITS = ", ".join(f"(2 * sum((v >> {k}) & 1) > count(*))::bigint << {k} as b{k}" for k in range(60))
_TEXT_HASH = f"""hw as (select doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from documents), hr as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as r from hw),
 hv as (select doc_id, ('0x' || substr(md5(r), 1, 15))::bigint as v from hr), hb as (select doc_id, {_BITS} from hv group by 1), h as (select doc_id, {" + ".join(f"b{k}" for k in range(60))} as h from hb)"""


@query(f"with {_TEXT_HASH}, f as (select h, min(doc_id) as o from h group by 1) select o as order_a, doc_id as order_b, 1.0::double as similarity from h join f using (h) where doc_id > o union all select a.o, b.o, 1 - bit_count(xor(a.h, b.h)) / 64.0::double from f a join f b on a.o < b.o and bit_count(xor(a.h, b.h)) <= 3")
def near_duplicates_banded(spark: SparkSession, d: str) -> DataFrame:
    """Each copy of a hash with the row that stands for it, and the pairs among these."""
    rows = duplicates.text_hash(read(spark, d, "documents"), "doc_id").select(F.col("doc_id").alias("ord"), F.col("h").alias("p_hash"))
    copies = duplicates.first_of_hash(rows).where("first < ord").select(F.col("first").alias("order_a"), F.col("ord").alias("order_b"), F.lit(1.0).alias("similarity"))
    return copies.unionByName(duplicates.similar_pairs(rows))


@query(
    f"""with {_CELLS}, t as (select vec_id, (y // 4) * 2 + x // 4 as tile, sum(v order by i) / 16 as mu, var_pop(v) as var from c group by 1, 2), b as (select c.vec_id, (y // 4) * 2 + x // 4 as tile, bit_or(case when v >= mu then 1::bigint << ((y % 4) * 4 + x % 4)::int else 0::bigint end) as bits
 from c join t on t.vec_id = c.vec_id and t.tile = (y // 4) * 2 + x // 4 group by 1, 2) select p.vec_id, p.tile as tile_a, q.tile as tile_b, bit_count(xor(p.bits, q.bits))::int as distance, round(least(tp.var, tq.var) / greatest(tp.var, tq.var), 6) as variance_ratio
 from b p join b q on p.vec_id = q.vec_id and p.tile < q.tile join t tp on tp.vec_id = p.vec_id and tp.tile = p.tile join t tq on tq.vec_id = q.vec_id and tq.tile = q.tile
 where bit_count(xor(p.bits, q.bits)) <= 5 and least(tp.var, tq.var) / greatest(tp.var, tq.var) > 0.5"""
)
def tile_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of one raster that are alike; four tiles of 4 x 4, so at most six pairs of each raster."""
    p = F.col("p")
    tiles = [F.array(*[raster.at(p, 8, tx * 4 + x, ty * 4 + y) for y in range(4) for x in range(4)]) for ty in range(2) for tx in range(2)]
    one = lambda k, t: raster.let(raster.mean(t), lambda m: F.struct(F.lit(k).alias("tile"), raster.hash_bits([F.get(t, F.lit(i)) >= m for i in range(16)]).alias("bits"), F.pow(raster.deviation(t), 2.0).alias("var")))
    rows = pixels(spark, d).select("vec_id", F.array(*[one(k, t) for k, t in enumerate(tiles)]).alias("t"))
    pairs = F.array(*[F.struct(F.col("t")[i].alias("a"), F.col("t")[j].alias("b")) for i in range(4) for j in range(i + 1, 4)])
    met = rows.select("vec_id", F.explode(pairs).alias("p")).select("vec_id", F.col("p.a.tile").cast("long").alias("tile_a"), F.col("p.b.tile").cast("long").alias("tile_b"), F.bit_count(F.col("p.a.bits").bitwiseXOR(F.col("p.b.bits"))).alias("distance"), (F.least("p.a.var", "p.b.var") / F.greatest("p.a.var", "p.b.var")).alias("r"))
    return met.where("distance <= 5 and r > 0.5").select("vec_id", "tile_a", "tile_b", "distance", F.round("r", 6).alias("variance_ratio"))


@query(f"with {_CELLS} select vec_id, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as deviation, round(avg((v <= -0.1)::int), 6) as dark, round(avg((v >= 0.1)::int), 6) as bright from c group by 1")
def luma_stats(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    return pixels(spark, d).select("vec_id", F.round(raster.mean(p), 6).alias("mean"), F.round(raster.deviation(p), 6).alias("deviation"), F.round(raster.fraction(p, lambda v: v <= -0.1), 6).alias("dark"), F.round(raster.fraction(p, lambda v: v >= 0.1), 6).alias("bright"))


_STEPS = f"{_CELLS}, s as (select a.vec_id, a.x, a.y, abs(a.v - b.v) as dx from c a join c b on a.vec_id = b.vec_id and a.y = b.y and b.x = a.x - 1)"


@query(f"with {_STEPS}, t as (select a.vec_id, avg(abs(a.v - b.v)) as dy from c a join c b on a.vec_id = b.vec_id and a.x = b.x and b.y = a.y - 1 group by 1) select vec_id, round(avg(dx), 6) as edge_x, round(any_value(dy), 6) as edge_y from s join t using (vec_id) group by 1")
def edge_means(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    return pixels(spark, d).select("vec_id", F.round(raster.edge_x(p, 8, 8), 6).alias("edge_x"), F.round(raster.edge_y(p, 8, 8), 6).alias("edge_y"))


@query(f"with {_STEPS} select vec_id, round(avg(dx) filter (x % 4 = 0) / avg(dx) filter (x % 4 <> 0), 6) as ratio from s group by 1")
def block_boundary_ratio(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("vec_id", F.round(raster.boundary_ratio(F.col("p"), 8, 8, 4), 6).alias("ratio"))


@query(f"with {_STEPS}, g as (select vec_id, x % 4 as k, avg(dx) as e from s group by 1, 2) select vec_id, round(max(e) / avg(e), 6) as dominance from g group by 1")
def phase_dominance(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("vec_id", F.round(raster.phase_dominance(F.col("p"), 8, 8, 4), 6).alias("dominance"))


@query(
    f"""with {_CELLS}, s as (select b.vec_id, b.x, abs(a.v - 2 * b.v + n.v) as d2 from c b join c a on a.vec_id = b.vec_id and a.y = b.y and a.x = b.x - 1 join c n on n.vec_id = b.vec_id and n.y = b.y and n.x = b.x + 1 where b.x % 2 = 1),
 k as (select vec_id, n, k, coalesce((select avg(d2) from s where s.vec_id = e.vec_id and s.x % n = k), 0) as m from (select vec_id from embeddings) e, range(2, 5) r(n), range(0, 5) q(k) where k < n), v as (select vec_id, n, stddev_pop(m) / avg(m) as cv from k group by 1, 2) select vec_id, round(max(cv), 6) as periodicity from v group by 1"""
)
def periodicity(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("vec_id", F.round(raster.periodicity(F.col("p"), 8, 8, 4), 6).alias("periodicity"))


@query(
    f"""with {_CELLS}, g as (select a.vec_id, a.x, a.y, abs(4 * a.v - sum(b.v)) as hp from c a join c b on a.vec_id = b.vec_id and abs(a.x - b.x) + abs(a.y - b.y) = 1 where a.x between 1 and 6 and a.y between 1 and 6 group by a.vec_id, a.x, a.y, a.v),
 r as (select vec_id, x // 4 as rx, y // 4 as ry, avg(hp) as m from g group by 1, 2, 3) select vec_id, round(stddev_pop(m) / abs(avg(m)), 6) as variation from r group by 1"""
)
def regional_cv(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("vec_id", F.round(raster.region_variation(F.col("p"), 8, 8, 2), 6).alias("variation"))


@query(f"with {_CELLS}, b as (select vec_id, least(15, greatest(0, floor((v + 1) / 2 * 16)))::int as k, count(*) as n from c group by 1, 2) select vec_id, round(max(n) / 4.0, 6)::double as peakiness from b group by 1")
def histogram_peakiness(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("vec_id", F.round(raster.peakiness(F.col("p"), 16, -1.0, 1.0), 6).alias("peakiness"))


@query(f"with {_CELLS} select a.vec_id, round(avg((abs(a.v - l.v) + abs(a.v - u.v) > 0.25)::int), 6) as density from c a join c l on l.vec_id = a.vec_id and l.y = a.y and l.x = a.x - 1 join c u on u.vec_id = a.vec_id and u.x = a.x and u.y = a.y - 1 group by 1")
def edge_density(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("vec_id", F.round(raster.edge_density(F.col("p"), 8, 8, 0.25), 6).alias("density"))


_BYTES = f"b as (select doc_id, generate_subscripts({HEX_BYTES}, 1) - 1 as i, ('0x' || unnest({HEX_BYTES}))::int as v from documents)"


@query(f"with {_BYTES}, o as (select doc_id, k, avg((v >> k::int) & 1) as p from b, range(0, 8) r(k) group by 1, 2) select doc_id as file_id, k as plane, round(case when p <= 0 or p >= 1 then 0 else -p * log2(p) - (1 - p) * log2(1 - p) end, 6) as entropy from o")
def bit_plane_entropy(spark: SparkSession, d: str) -> DataFrame:
    found = identity.byte_statistics(files(spark, d)).select("file_id", F.posexplode("planes").alias("plane", "e"))
    return found.select("file_id", F.col("plane").cast("long").alias("plane"), F.round("e", 6).alias("entropy"))


@query(f"with {_BYTES}, l as (select doc_id, v & 1 as bit, lag(v & 1) over (partition by doc_id order by i) as before from b) select doc_id as file_id, round(avg(bit), 6) as one_ratio, round(coalesce(avg((bit <> before)::int), 0), 6) as transition_rate from l group by 1")
def lsb_transitions(spark: SparkSession, d: str) -> DataFrame:
    return identity.byte_statistics(files(spark, d)).select("file_id", F.round("one_ratio", 6).alias("one_ratio"), F.round("transition_rate", 6).alias("transition_rate"))


_PAIRS = "select a.vec_id, a.vec_id as vec_a, b.vec_id as vec_b, a.embedding as ea, b.embedding as eb from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"


@query(f"with p as ({_PAIRS}), x as (select vec_a, vec_b, unnest(ea)::double - unnest(eb)::double as d from p) select vec_a, vec_b, round(avg(abs(d)), 6) as mae, round(sqrt(avg(d * d)), 6) as rmse, round(20 * log10(1 / sqrt(avg(d * d))), 5) as psnr from x group by 1, 2")
def pair_mae_rmse_psnr(spark: SparkSession, d: str) -> DataFrame:
    p = pixels(spark, d)
    pairs = p.select(F.col("vec_id").alias("vec_a"), (F.col("vec_id") + 1).alias("vec_b"), F.col("p").alias("a")).join(p.select(F.col("vec_id").alias("vec_b"), F.col("p").alias("b")), "vec_b")
    mae, rmse = raster.pair_error(F.col("a"), F.col("b"))
    psnr = F.when(rmse > 1e-7, 20 * F.log10(1 / rmse))
    return pairs.select("vec_a", "vec_b", F.round(mae, 6).alias("mae"), F.round(rmse, 6).alias("rmse"), F.round(psnr, 5).alias("psnr"))


@query("select vec_id, list_sort(embedding)[33]::double as upper_median from embeddings")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("vec_id", raster.upper_median(F.col("p")).alias("upper_median"))


@query(f"with {_CELLS} select vec_id, u, v0 as v, round(sum(v * cos((2 * x + 1) * u * pi() / 16) * cos((2 * y + 1) * v0 * pi() / 16)), 5) as coefficient from c, range(0, 4) r(u), range(0, 4) s(v0) group by 1, 2, 3")
def dct_lowband(spark: SparkSession, d: str) -> DataFrame:
    rows = pixels(spark, d).select("vec_id", F.posexplode(raster.dct_low(F.col("p"), 8, 8, 4)).alias("k", "c"))
    return rows.select("vec_id", (F.col("k") % 4).cast("long").alias("u"), F.floor(F.col("k") / 4).cast("long").alias("v"), F.round("c", 5).alias("coefficient"))


_ATTRS = r"select page_id as file_id, unnest(regexp_extract_all(html, '[a-z]+=\"[^\"]*\"')) as a, generate_subscripts(regexp_extract_all(html, '[a-z]+=\"[^\"]*\"'), 1) - 1 as ord from pages"


@query(rf"with t as ({_ATTRS}) select file_id, ord::int as ord, 'HTML' as directory, split_part(a, '=', 1) as tag, regexp_extract(a, '\"(.*)\"', 1) as raw from t")
def metadata_fields(spark: SparkSession, d: str) -> DataFrame:
    return page_fields(spark, d).select("file_id", "ord", "directory", "tag", "raw")


def page_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.posexplode(F.regexp_extract_all("html", F.lit('[a-z]+="[^"]*"'), F.lit(0))).alias("ord", "a"))
    return rows.select("file_id", "ord", F.lit("HTML").alias("directory"), F.substring_index("a", "=", 1).alias("tag"), F.regexp_extract("a", '"(.*)"', 1).alias("raw"), F.lit(None).cast("string").alias("parsed"))


# Fields of made-up files from events: one file for each user, tags by event type.
_TAGS = {"view": "Make", "click": "Model", "error": "Software", "purchase": "Body Serial Number", "signup": "Lens Model"}
_EVENT_FIELDS = f"""f as (select user_id as file_id, (row_number() over (partition by user_id order by event_id) - 1)::int as ord, case when event_id % 7 = 0 then 'GPS' when event_id % 11 = 0 then 'XMP' when event_id % 13 = 0 then 'ICC Profile' else 'Exif IFD0' end as directory,
 case event_type {' '.join(f"when '{k}' then '{v}'" for k, v in _TAGS.items())} end as tag, 'Value ' || (event_id % 3) as raw, case when event_id % 5 = 0 then null when event_id % 5 = 1 then ' ' else 'VALUE ' || (event_id % 3) end as parsed, ts from events)"""


def event_fields(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    n = F.col("event_id")
    directory = F.when(n % 7 == 0, "GPS").when(n % 11 == 0, "XMP").when(n % 13 == 0, "ICC Profile").otherwise("Exif IFD0")
    tag = F.element_at(F.create_map(*[F.lit(x) for p in _TAGS.items() for x in p]), F.col("event_type"))
    third = (n % 3).cast("string")
    rows = e.select(F.col("user_id").alias("file_id"), n.alias("event_id"), directory.alias("directory"), tag.alias("tag"), F.concat(F.lit("Value "), third).alias("raw"), F.when(n % 5 == 0, None).when(n % 5 == 1, " ").otherwise(F.concat(F.lit("VALUE "), third)).alias("parsed"), "ts")
    return metadata.numbered(rows, ["file_id"], ["event_id"]).drop("event_id")


_HALVES = f"""with {_EVENT_FIELDS}, k as (select file_id, directory, tag, arg_min(coalesce(parsed, raw), ord) filter (ts < timestamp '2024-01-15') as l, arg_min(coalesce(parsed, raw), ord) filter (ts >= timestamp '2024-01-15') as r from f group by 1, 2, 3)"""


def halves(spark: SparkSession, d: str) -> DataFrame:
    f = event_fields(spark, d)
    cut = F.lit("2024-01-15").cast("timestamp")
    return metadata.difference(f.where(F.col("ts") < cut), f.where(F.col("ts") >= cut), ["file_id"])


@query(_HALVES + " select file_id, directory, tag, l as left_value, r as right_value from k where l is distinct from r")
def metadata_diff(spark: SparkSession, d: str) -> DataFrame:
    return halves(spark, d)


@query(_HALVES + " select file_id, directory, tag, l as left_value, r as right_value from k where l is distinct from r and upper(directory) like '%ICC%'")
def icc_diff(spark: SparkSession, d: str) -> DataFrame:
    return metadata.icc_difference(halves(spark, d))


_MEANING = " ".join(f"when '{t.lower()}' then '{metadata.MEANINGS[t]}'" for t in _TAGS.values())


@query(f"with {_EVENT_FIELDS} select file_id, ord, tag, case lower(tag) {_MEANING} else '{metadata.NO_MEANING}' end as meaning from f")
def meaning_lookup(spark: SparkSession, d: str) -> DataFrame:
    return metadata.with_meaning(event_fields(spark, d)).select("file_id", "ord", "tag", "meaning")


_FILLED = "case when trim(parsed) <> '' then parsed else raw end"


@query(f"with {_EVENT_FIELDS}, v as (select file_id, tag, lower({_FILLED}) as low, min(ord) as o, arg_min({_FILLED}, ord) as v from f where directory <> 'GPS' group by 1, 2, 3) select file_id, tag, count(*)::int as n, string_agg(v, ' | ' order by o) as shown from v group by 1, 2 having count(*) > 1")
def conflicting_values(spark: SparkSession, d: str) -> DataFrame:
    values = metadata.distinct_values(event_fields(spark, d), F.col("directory") != "GPS", ["file_id", "tag"])
    return values.where(F.size("values") > 1).select("file_id", "tag", F.size("values").alias("n"), F.array_join("values", " | ").alias("shown"))


@query(f"with {_EVENT_FIELDS} select file_id, directory, tag, min({_FILLED}) as shown from f where trim({_FILLED}) <> '' group by 1, 2, 3 having count(distinct lower({_FILLED})) = 1")
def single_value_present(spark: SparkSession, d: str) -> DataFrame:
    f = event_fields(spark, d)
    values = metadata.distinct_values(f, F.lit(True), ["file_id", "directory", "tag"])
    spelled = f.select("file_id", "directory", "tag", metadata.filled(F.col("parsed"), F.col("raw")).alias("v")).groupBy("file_id", "directory", "tag").agg(F.min("v").alias("shown"))
    return values.where(F.size("values") == 1).join(spelled, ["file_id", "directory", "tag"]).select("file_id", "directory", "tag", "shown")


@query(
    """select o_orderkey as file_id, count(*) as lines, count(*) filter (l_shipdate < o_orderdate) as before_original, min(l_shipdate) < min(o_orderdate) as first_before from lineitem join orders on l_orderkey = o_orderkey group by 1"""
)
def time_order_rules(spark: SparkSession, d: str) -> DataFrame:
    both = read(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy(F.col("o_orderkey").alias("file_id")).agg(F.count("*").alias("lines"), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("before_original"), (F.min("l_shipdate") < F.min("o_orderdate")).alias("first_before"))


_RULES = """with t as (select p_partkey as file_id, p_size as width, (p_partkey % 40 + 1)::int as height, case when p_partkey % 3 = 0 then p_size + 1 else p_size end as ew, (p_partkey % 40 + 1)::int as eh from part)"""


@query(
    _RULES
    + """ select file_id, 'metadata.dimension_mismatch' as code, 2 as confidence from t where ew > 0 and eh > 0 and (ew <> width or eh <> height) union all select file_id, 'image.extreme_small_dimension', 3 from t where width <= 2 or height <= 2
 union all select file_id, 'image.extreme_aspect_ratio', 3 from t where width / height > 20 or width / height < 0.05"""
)
def dimension_rules(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.col("p_size").alias("width"), (F.col("p_partkey") % 40 + 1).cast("int").alias("height"))
    exif = F.when(F.col("file_id") % 3 == 0, F.col("width") + 1).otherwise(F.col("width"))
    none = F.lit(None).cast("string")
    fields = part.select("file_id", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.lit("Exif Image Width").alias("tag"), F.concat(exif.cast("string"), F.lit(" pixels")).alias("raw")), F.struct(F.lit(1).alias("ord"), F.lit("Exif Image Height").alias("tag"), F.col("height").cast("string").alias("raw")))).alias("f")).select("file_id", "f.*", F.lit("Exif SubIFD").alias("directory"), none.alias("parsed"))
    ident = part.select("file_id", F.lit(False).alias("extension_mismatch"), F.lit("JPEG").alias("detected_type"), F.lit(".jpg").alias("extension"))
    cont = part.select("file_id", F.lit(0).cast("long").alias("trailing_bytes"), F.array().cast("array<string>").alias("warnings"))
    return rules.consistency(ident, part.withColumn("orientation", none), fields, cont).select("file_id", "code", "confidence")


_RISKS = f"""{_EVENT_FIELDS}, r as (select file_id, 'privacy.gps' as code from f where directory = 'GPS' union all select file_id, 'privacy.device_model' from f where tag in ('Make', 'Model') union all select file_id, 'privacy.serial' from f where tag like '%Serial%'
 union all select file_id, 'privacy.software' from f where tag = 'Software' union all select file_id, 'privacy.xmp' from f where directory = 'XMP'), n as (select file_id, code, count(*) as fields from r group by 1, 2)"""


def risks(spark: SparkSession, d: str) -> DataFrame:
    return rules.privacy_risks(event_fields(spark, d))


@query(f"with {_RISKS} select file_id, code, fields from n")
def privacy_risks(spark: SparkSession, d: str) -> DataFrame:
    return risks(spark, d).select("file_id", "code", "fields")


@query(f"with {_RISKS} select file_id, count(*)::int as privacy_risk_count, true as has_sensitive_data from n group by 1")
def privacy_summary(spark: SparkSession, d: str) -> DataFrame:
    return rules.privacy_summary(risks(spark, d)).select("file_id", "privacy_risk_count", "has_sensitive_data")


@query(f"with {_RISKS} select file_id, code from n where code in ('privacy.gps', 'privacy.serial')")
def semi_sensitive(spark: SparkSession, d: str) -> DataFrame:
    return rules.sensitive(risks(spark, d), ("privacy.gps", "privacy.serial")).select("file_id", "code")


@query(f"with {_RISKS} select file_id, string_agg(code, ', ' order by code) as codes from n group by 1")
def sorted_codes(spark: SparkSession, d: str) -> DataFrame:
    return rules.privacy_summary(risks(spark, d)).select("file_id", F.array_join("codes", ", ").alias("codes"))


@query(
    f"with {_RISKS} select file_id, 0 as stage, code from n union all select file_id, 1, 'metadata.' || lower(split_part(tag, ' ', 1)) from (select file_id, tag, count(distinct lower({_FILLED})) as k from f where tag in ('Make', 'Model') group by 1, 2) where k > 1"
)
def indicators_union(spark: SparkSession, d: str) -> DataFrame:
    f = event_fields(spark, d)
    conflicts = metadata.distinct_values(f, F.col("tag").isin("Make", "Model"), ["file_id", "tag"]).where(F.size("values") > 1)
    return risks(spark, d).select("file_id", F.lit(0).alias("stage"), "code").unionByName(conflicts.select("file_id", F.lit(1).alias("stage"), F.concat(F.lit("metadata."), F.lower(F.substring_index("tag", " ", 1))).alias("code")))


_TEXTS = "t as (select 'documents' as source, doc_id as file_id, text from documents union all select 'conversations', conv_id * 1000 + turn, text from conversations)"


def texts(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("file_id"), "text")
    return docs.unionByName(read(spark, d, "conversations").select(F.lit("conversations").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("file_id"), "text"))


@query(rf"with {_TEXTS} select distinct file_id, source, lower(unnest(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b'))) as value from t")
def text_entities_email(spark: SparkSession, d: str) -> DataFrame:
    found = entities.text_entities(texts(spark, d)).where("kind = 'Email'")
    return found.select("file_id", "source", F.lower("value").alias("value"))


@query()
def text_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities.text_entities(texts(spark, d))


@query("select 'URL' as kind, page_id as file_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || case when regexp_extract(url, '^[a-z]+://[^/?#]+(.*)$', 1) like '/%' then '' else '/' end || regexp_extract(url, '^[a-z]+://[^/?#]+(.*)$', 1) as value from pages")
def entity_urls(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.concat(F.lit("see "), "url", F.lit(" .")).alias("text"), F.lit("pages").alias("source"))
    return entities.text_entities(rows).where("kind = 'URL'").select("kind", "file_id", "value")


@query(r"select doc_id as file_id, count(*) as runs, max(least(length(r), 160))::int as longest, sum(least(length(r), 160))::bigint as stored from (select doc_id, unnest(regexp_extract_all(text, '[\x20-\x7E]{20,}')) as r from documents) group by 1")
def printable_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = read(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.explode(F.regexp_extract_all("text", F.lit(r"[\x20-\x7E]{20,}"), F.lit(0))).alias("r"))
    kept = runs.select("file_id", F.left("r", F.lit(160)).alias("r"))
    return kept.groupBy("file_id").agg(F.count("*").alias("runs"), F.max(F.length("r")).alias("longest"), F.sum(F.length("r").cast("long")).alias("stored"))


_MAGIC = [(kind, magic.hex().upper()) for kind, magic in hidden.SIGNATURES]
_MAGIC_ROWS = ", ".join(f"('{k}', '{' '.join(h[i : i + 2] for i in range(0, len(h), 2))} ')" for k, h in _MAGIC)


@query(
    f"""with m(kind, magic) as (values {_MAGIC_ROWS}), f as (select doc_id, hex(encode(text)) || ({[h for _, h in _MAGIC]!r})[(doc_id % {len(_MAGIC)} + 1)::int] || hex(encode(text)) || ({[h for _, h in _MAGIC]!r})[(doc_id * 3 % {len(_MAGIC)} + 1)::int] as h from documents),
 w as (select doc_id, regexp_replace(substr(h, 3), '(..)', '\\1 ', 'g') as w from f) select doc_id as file_id, kind, (length(w) - length(replace(w, magic, ''))) // length(magic) as hits from w join m on contains(w, magic)"""
)
def signature_hits(spark: SparkSession, d: str) -> DataFrame:
    """All signatures inside files that hold two of them, by the operator that looks for embedded content."""
    magic = F.array(*[F.unhex(F.lit(h)) for _, h in _MAGIC])
    text, of = F.encode("text", "UTF-8"), lambda k: F.element_at(magic, (F.col("doc_id") * k % len(_MAGIC) + 1).cast("int"))
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.concat(text, of(1), text, of(3)).alias("content"))
    found = S.children(S.inspect(rows, ("hidden",)), "hidden").where(F.col("kind").isin([k for k, _ in _MAGIC]))
    return found.groupBy("file_id", "kind").agg(F.count("*").alias("hits"))


def _hex_number(c, digits: int):
    return F.lpad(F.hex(c.cast("long")), digits, "0")


def _low_first(c, digits: int):
    """Hex digits of a number, the lowest byte first."""
    return F.array_join(F.reverse(F.regexp_extract_all(_hex_number(c, digits), F.lit("(..)"), F.lit(1))), "")


_PART_KINDS = [0, 2, 3, 4, 6]


def png_files(spark: SparkSession, d: str) -> DataFrame:
    """A PNG for each part: its size from p_size and p_partkey, a text chunk with its name, up to three bytes behind the end."""
    k = F.col("p_partkey")
    chunk = lambda name, body: F.concat(_hex_number(F.length(body) / 2, 8), F.lit(name.encode().hex().upper()), body, _hex_number(F.crc32(F.unhex(F.concat(F.lit(name.encode().hex()), body))), 8))
    kind = F.element_at(F.array(*[F.lit(f"{x:02X}") for x in _PART_KINDS]), (k % 5 + 1).cast("int"))
    head = F.concat(_hex_number(F.col("p_size") * 7 + 1, 8), _hex_number(k % 300 + 1, 8), F.lit("08"), kind, F.lit("000000"))
    text = F.concat(F.hex(F.encode(F.lit("Comment"), "UTF-8")), F.lit("00"), F.hex(F.encode("p_name", "UTF-8")))
    whole = F.concat(F.lit("89504E470D0A1A0A"), chunk("IHDR", head), chunk("tEXt", text), chunk("IEND", F.lit("")), F.repeat(F.lit("AB"), (k % 4).cast("int")))
    return read(spark, d, "part").select(k.alias("file_id"), F.unhex(whole).alias("content"))


def jpeg_files(spark: SparkSession, d: str) -> DataFrame:
    """A JPEG for each customer: EXIF with maker (c_mktsegment), model (c_name) and orientation, a frame header, no picture data."""
    k = F.col("c_custkey")
    make, model = (F.concat(F.hex(F.encode(c, "UTF-8")), F.lit("00")) for c in ("c_mktsegment", "c_name"))
    size = lambda h: F.length(h) / 2
    entry = lambda tag, kind, n, value: F.concat(_low_first(F.lit(tag), 4), _low_first(F.lit(kind), 4), _low_first(n, 8), value)
    start = F.lit(8 + 2 + 3 * 12 + 4)
    entries = F.concat(entry(0x10F, 2, size(make), _low_first(start, 8)), entry(0x110, 2, size(model), _low_first(start + size(make), 8)), entry(0x112, 3, F.lit(1), F.concat(_low_first(k % 8 + 1, 4), F.lit("0000"))))
    tiff = F.concat(F.lit("49492A0008000000"), _low_first(F.lit(3), 4), entries, F.lit("00000000"), make, model)
    part = lambda marker, body: F.concat(F.lit(marker), _hex_number(size(body) + 2, 4), body)
    frame = F.concat(F.lit("08"), _hex_number(k % 1000 + 16, 4), _hex_number(k % 700 + 16, 4), F.lit("03012200021101031101"))
    whole = F.concat(F.lit("FFD8"), part("FFE1", F.concat(F.lit("457869660000"), tiff)), part("FFC0", frame), F.lit("FFD9"), F.repeat(F.lit("00"), (k % 3).cast("int")))
    return read(spark, d, "customer").select(k.alias("file_id"), F.unhex(whole).alias("content"))


_PNG = "p as (select p_partkey as k, p_name, p_size * 7 + 1 as w, p_partkey % 300 + 1 as h, [0, 2, 3, 4, 6][p_partkey % 5 + 1] as kind, 20 + length(p_name) as n from part)"


@query(f"with {_PNG} select k as file_id, w::int as width, h::int as height, ([1, 3, 3, 2, 4])[k % 5 + 1]::int as channels, kind in (4, 6) as has_alpha, 8::int as bit_depth, (k % 4)::bigint as trailing_bytes, w / h::double as aspect_ratio from p")
def png_facts(spark: SparkSession, d: str) -> DataFrame:
    seen = S.inspect(png_files(spark, d), ("technical", "container"))
    return seen.select("file_id", *[F.col(f"technical.{c}").alias(c) for c in ("width", "height", "channels", "has_alpha", "bit_depth", "aspect_ratio")], "container.trailing_bytes")


@query(f"with {_PNG} select k as file_id, unnest([0, 1, 2])::int as ord, unnest([8, 33, 33 + n])::bigint as \"offset\", unnest([25, n, 12])::bigint as length, unnest(['IHDR', 'tEXt', 'IEND']) as type from p")
def png_segments(spark: SparkSession, d: str) -> DataFrame:
    return S.children(S.inspect(png_files(spark, d), ("container",)), "container", "segments").select("file_id", "ord", "offset", "length", "type")


@query(f"with {_PNG} select k as file_id, unnest([0, 1, 2, 3, 4])::int as ord, unnest(['Image Width', 'Image Height', 'Bits Per Sample', 'Color Type', 'Textual Data']) as tag, unnest([w::text, h::text, '8', kind::text, 'Comment: ' || p_name]) as raw from p")
def png_metadata(spark: SparkSession, d: str) -> DataFrame:
    return S.children(S.inspect(png_files(spark, d), ("metadata",)), "metadata", "fields").select("file_id", "ord", "tag", "raw")


@query(f"with {_PNG} select k as file_id, 45 + n as \"offset\", (k % 4) || ' byte(s) follow the end of the picture.' as evidence, 3::int as confidence from p where k % 4 > 0")
def trailing_payloads(spark: SparkSession, d: str) -> DataFrame:
    found = S.children(S.inspect(png_files(spark, d), ("hidden",)), "hidden").where("kind = 'Trailing payload region'")
    return found.select("file_id", "offset", "evidence", "confidence")


_ORIENTED = ["TopLeft", "TopRight", "BottomRight", "BottomLeft", "LeftTop", "RightTop", "RightBottom", "LeftBottom"]


@query(f"select c_custkey as file_id, (c_custkey % 700 + 16)::int as width, (c_custkey % 1000 + 16)::int as height, ({_ORIENTED!r})[c_custkey % 8 + 1] as orientation, '4:2:0' as chroma, (c_custkey % 3)::bigint as trailing_bytes from customer")
def jpeg_facts(spark: SparkSession, d: str) -> DataFrame:
    seen = S.inspect(jpeg_files(spark, d), ("technical", "container", "pixels"))
    return seen.select("file_id", *[F.col(f"technical.{c}").alias(c) for c in ("width", "height", "orientation")], "pixels.chroma", "container.trailing_bytes")


@query("select c_custkey as file_id, unnest(['Make', 'Model', 'Orientation', 'Image Height', 'Image Width']) as tag, unnest([c_mktsegment, c_name, (c_custkey % 8 + 1)::text, (c_custkey % 1000 + 16)::text, (c_custkey % 700 + 16)::text]) as raw from customer")
def exif_fields(spark: SparkSession, d: str) -> DataFrame:
    fields = S.children(S.inspect(jpeg_files(spark, d), ("metadata",)), "metadata", "fields")
    return fields.where(F.col("tag").isin("Make", "Model", "Orientation", "Image Height", "Image Width")).select("file_id", "tag", "raw")


#: Fields of made-up files, one for each order: directory, tag, value, and for which keys they are there.
_FACTS = [
    ("Exif IFD0", "Make", "Maker A", "true"), ("Exif IFD1", "Make", "Maker B", "k % 7 = 0"), ("Exif IFD0", "Model", "M1", "true"), ("Exif IFD1", "Model", "m1", "k % 3 = 0"), ("Exif IFD1", "Model", "M2", "k % 11 = 0"),
    ("Exif SubIFD", "Lens Model", "L1", "k % 2 = 0"), ("Maker", "Lens Model", "L2", "k % 13 = 0"), ("Exif IFD0", "Software", "Tool 1", "k % 5 = 0"), ("XMP", "Software", "Tool 2", "k % 10 = 0"),
    ("Exif SubIFD", "Body Serial Number", "S1", "k % 17 < 2"), ("Maker", "Lens Serial Number", "S2", "k % 17 = 1"), ("Exif IFD0", "Orientation", "Right side, top (Rotate 90 CW)", "k % 8 = 5"), ("Exif IFD0", "Orientation", "1", "k % 8 = 6"),
    ("Exif SubIFD", "Exif Image Width", "100 pixels", "k % 6 = 0"), ("Exif SubIFD", "Exif Image Height", "80 pixels", "k % 6 = 0"),
    ("Exif SubIFD", "Date/Time Original", "2024:01:10 10:00:00", "k % 2 = 1"), ("XMP", "DateTimeOriginal", "2024-01-10T10:00:00Z", "k % 19 = 1"), ("Exif SubIFD", "Date/Time Digitized", "2024:01:09 10:00:00", "k % 4 = 1"), ("Exif IFD0", "Date/Time", "2023-12-31 00:00:00", "k % 9 = 1"),
    ("Exif Thumbnail", "Thumbnail Image Width", "160 pixels", "k % 3 = 1"), ("Exif Thumbnail", "Thumbnail Image Height", "120 pixels", "k % 3 = 1"),
    ("GPS", "GPS Latitude", "1 deg", "k % 31 = 0"), ("Exif IFD0", "Artist", "someone", "k % 37 = 0"), ("IPTC", "Headline", "x", "k % 41 = 0"), ("JPEG Comment", "JPEG Comment", "c", "k % 43 = 0"),
]


def order_fields(spark: SparkSession, d: str) -> DataFrame:
    each = F.filter(F.array(*[F.when(F.expr(when), F.struct(F.lit(i).alias("ord"), F.lit(a).alias("directory"), F.lit(b).alias("tag"), F.lit(v).alias("raw"))) for i, (a, b, v, when) in enumerate(_FACTS)]), lambda x: x.isNotNull())
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("k")).select(F.col("k").alias("file_id"), F.explode(each).alias("x"))
    return rows.select("file_id", "x.*", F.lit(None).cast("string").alias("parsed"))


def order_boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(k.alias("file_id"), (k % 3).cast("long").alias("trailing_bytes"), F.when(k % 8 == 0, F.array(F.lit("cut off"))).otherwise(F.array().cast("array<string>")).alias("warnings"))


_K = "k as (select o_orderkey as k, o_orderkey % 50 + 1 as w, o_orderkey % 40 + 1 as h, ['TopLeft', 'RightTop'][o_orderkey % 2 + 1] as o from orders)"
_CODES = [
    ("file.extension_mismatch", 3, "k % 6 = 1"), ("container.trailing_bytes", 3, "k % 3 > 0"), ("container.structure_warning", 2, "k % 8 = 0"), ("metadata.make_conflict", 2, "k % 7 = 0"), ("metadata.model_conflict", 2, "k % 11 = 0"),
    ("metadata.lens_conflict", 2, "k % 26 = 0"), ("metadata.software_conflict", 2, "k % 10 = 0"), ("metadata.software_present", 3, "k % 10 = 5"), ("metadata.serial_conflict", 1, "k % 17 = 1"),
    ("metadata.orientation_mismatch", 2, "(k % 8 = 5 and o <> 'RightTop') or (k % 8 = 6 and o <> 'TopLeft')"), ("metadata.dimension_mismatch", 2, "k % 6 = 0 and (w <> 100 or h <> 80)"), ("image.extreme_small_dimension", 3, "w <= 2 or h <= 2"),
    ("image.extreme_aspect_ratio", 3, "w / h::double > 20 or w / h::double < 0.05"), ("metadata.time_digitized_before_original", 1, "k % 4 = 1"), ("metadata.time_modified_before_original", 1, "k % 9 = 1 and (k % 2 = 1 or k % 19 = 1)"),
    ("metadata.original_time_conflict", 1, "k % 2 = 1 and k % 19 = 1"), ("metadata.thumbnail_aspect_mismatch", 1, "k % 3 = 1 and abs(160 / 120::double - w / h::double) / greatest(0.0001, w / h::double) > 0.15"),
]


def order_findings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = read(spark, d, "orders")
    ident = orders.select(k.alias("file_id"), (k % 6 == 1).alias("extension_mismatch"), F.lit("PNG").alias("detected_type"), F.lit(".jpg").alias("extension"))
    heads = orders.select(k.alias("file_id"), (k % 50 + 1).cast("int").alias("width"), (k % 40 + 1).cast("int").alias("height"), F.when(k % 2 == 0, "TopLeft").otherwise("RightTop").alias("orientation"))
    return rules.consistency(ident, heads, order_fields(spark, d), order_boxes(spark, d))


@query(f"with {_K} " + " union all ".join(f"select k as file_id, '{code}' as code, {n}::int as confidence from k where {when}" for code, n, when in _CODES))
def consistency_rules(spark: SparkSession, d: str) -> DataFrame:
    """All seventeen codes."""
    return order_findings(spark, d).select("file_id", "code", "confidence")


@query(f"with {_K} " + " union all ".join(f"select k as file_id, '{code}' as code from k where {when}" for code, n, when in _CODES if n == rules.CONFIRMED))
def confirmed_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.confirmed(order_findings(spark, d)).select("file_id", "code")


@query(f"with {_K} " + " union all ".join(f"select k as file_id, {i} as ord, '{tag}' as tag, '{v}' as raw from k where {when}" for i, (_, tag, v, when) in enumerate(_FACTS) if tag in ("Make", "Model", "Software") or "Lens" in tag or "Serial" in tag))
def camera_fields(spark: SparkSession, d: str) -> DataFrame:
    return metadata.camera_fields(order_fields(spark, d)).select("file_id", "ord", "tag", "raw")


@query(f"with {_K} select k as file_id, 'order.tool' as code, 1::bigint + (k % 10 = 0)::int as fields, 'order.tool' as title from k where k % 5 = 0")
def injected_rule(spark: SparkSession, d: str) -> DataFrame:
    """A condition of the caller's own beside the built-in ones."""
    found = rules.privacy_risks(order_fields(spark, d), more={"order.tool": metadata.has(F.col("raw"), "tool")})
    return found.where("code = 'order.tool'").select("file_id", "code", "fields", "title")


_RISKS = [
    ("privacy.gps", "k % 31 = 0", "1"), ("privacy.device_model", "true", "2 + (k % 7 = 0)::int + (k % 3 = 0)::int + (k % 11 = 0)::int"), ("privacy.serial", "k % 17 < 2", "1 + (k % 17 = 1)::int"), ("privacy.owner", "k % 37 = 0", "1"),
    ("privacy.timestamp", "k % 2 = 1 or k % 4 = 1 or k % 9 = 1", "(k % 2 = 1)::int + (k % 4 = 1)::int + (k % 9 = 1)::int"), ("privacy.software", "k % 5 = 0", "1 + (k % 10 = 0)::int"), ("privacy.thumbnail", "k % 3 = 1", "2"),
    ("privacy.xmp", "k % 10 = 0 or k % 19 = 1 or k % 23 = 0", "(k % 10 = 0)::int + (k % 19 = 1)::int"), ("privacy.iptc", "k % 41 = 0", "1"), ("privacy.comments", "k % 43 = 0 or k % 29 = 0", "(k % 43 = 0)::int"), ("privacy.trailing", "k % 3 > 0", "0"),
]


@query(f"with {_K} " + " union all ".join(f"select k as file_id, '{code}' as code, ({n})::bigint as fields from k where {when}" for code, when, n in _RISKS))
def privacy_rules(spark: SparkSession, d: str) -> DataFrame:
    """All eleven codes."""
    k = F.col("o_orderkey")
    kinds = F.filter(F.array(F.when(k % 23 == 0, "XMP "), F.when(k % 29 == 0, "tEXt")), lambda x: x.isNotNull())
    segments = read(spark, d, "orders").select(k.alias("file_id"), F.explode(kinds).alias("type"), F.lit("").alias("description"))
    return rules.privacy_risks(order_fields(spark, d), segments, order_boxes(spark, d)).select("file_id", "code", "fields")


_BATCH = f"""with {_TEXT_HASH}, e as (select doc_id, len(regexp_extract_all(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}\\b'))::int as n from documents), g as (select d.doc_id, 'doc_' || d.doc_id || '.txt' as file_name, sha256(text) as sha256, octet_length(encode(text)) as size_bytes,
 source in ('src1', 'src2') as has_gps, e.n as privacy_risk_count, h.h as p_hash, case when length(text) < 300 then 'too short' end as error from documents d join e using (doc_id) left join h using (doc_id)),
 x as (select *, case when error is null then nullif(first_value(file_name) over (partition by error is null, sha256 order by doc_id), file_name) end as duplicate_of from g),
 p as (select b.doc_id, a.file_name as other, row_number() over (partition by b.doc_id order by bit_count(xor(a.p_hash, b.p_hash)), a.doc_id) as rn from x a join x b on a.doc_id < b.doc_id and a.error is null and b.error is null and b.duplicate_of is null and bit_count(xor(a.p_hash, b.p_hash)) <= 3),
 r as (select x.doc_id as ord, file_name, sha256, size_bytes, has_gps, privacy_risk_count, p_hash, error, duplicate_of, p.other as near_duplicate_of from x left join p on p.doc_id = x.doc_id and rn = 1)"""
_BATCH_COLUMNS = "ord, file_name, sha256, size_bytes, has_gps, privacy_risk_count, p_hash, error, duplicate_of, near_duplicate_of"


def batch_table(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    docs = docs.join(duplicates.text_hash(docs, "doc_id"), "doc_id", "left")
    h = F.col("h")
    emails = F.size(F.filter(entities.found_in(F.col("text")), lambda e: e["kind"] == "Email"))
    rows = docs.select(F.col("doc_id").alias("ord"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("file_name"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("source").isin("src1", "src2").alias("has_gps"), emails.alias("privacy_risk_count"), h.alias("p_hash"), F.when(F.length("text") < 300, "too short").alias("error"))
    return batch.batch_rows(rows)


@query(_BATCH + f" select {_BATCH_COLUMNS} from r")
def batch_rows(spark: SparkSession, d: str) -> DataFrame:
    return batch_table(spark, d)


for _name, _sql in {"gps": "has_gps", "privacy": "privacy_risk_count > 0", "exact": "duplicate_of is not null", "near": "near_duplicate_of is not null", "error": "error is not null"}.items():

    def _view(spark: SparkSession, d: str, name: str = {"error": "errors"}.get(_name, _name)) -> DataFrame:
        return batch.view(batch_table(spark, d), name).select("ord", "file_name")

    QUERIES[f"batch_filter_{_name}"] = _view
    ORACLES[f"batch_filter_{_name}"] = _BATCH + f" select ord, file_name from r where {_sql}"


@query(_BATCH + """ select ord, '"' || file_name || '","' || sha256 || '",' || size_bytes || ',' || case when has_gps then 'True' else 'False' end || ',' || privacy_risk_count || ',"' || p_hash || '","' || coalesce(duplicate_of, '') || '","' || coalesce(near_duplicate_of, '') || '","' || coalesce(error, '') || '"' as line from r""")
def batch_csv_line(spark: SparkSession, d: str) -> DataFrame:
    rows = batch_table(spark, d)
    return rows.select("ord", batch.csv_line(rows).alias("line"))


@query()
def report_json(spark: SparkSession, d: str) -> DataFrame:
    return batch.to_json(batch_table(spark, d))


@query(f"with {_EVENT_FIELDS} select file_id, ord, directory, tag, raw from f where lower(directory || '~' || tag || '~' || raw || '~' || coalesce(parsed, '')) like '%serial%'")
def metadata_search(spark: SparkSession, d: str) -> DataFrame:
    return metadata.search(event_fields(spark, d), "SERIAL", None).select("file_id", "ord", "directory", "tag", "raw")


@query(f"with {_EVENT_FIELDS} select file_id, min(ord) as ord, arg_min(directory, ord) as directory, arg_min(raw, ord) as raw from f where lower(tag) like '%lens%' group by 1")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    return metadata.first_match(event_fields(spark, d).drop("ts"), "lens").select("file_id", "ord", "directory", "raw")


@query("select event_id, user_id, event_type from events order by ts desc, event_id limit 200")
def history_recent(spark: SparkSession, d: str) -> DataFrame:
    return metadata.latest(read(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), "ts", 500).select("event_id", "user_id", "event_type")


@query("select event_id, regexp_replace(event_type || ' #' || event_id || '/x', '[^A-Za-z0-9._-]', '', 'g') as event, case when event_id % 4 = 0 then null else (event_id % 100)::varchar end as k, user_id::varchar as user from events")
def log_sanitize(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    key = F.when(n % 4 == 0, F.lit("gpsValue")).otherwise(F.lit("k"))
    data = F.map_from_arrays(F.array(key, F.lit("user"), F.lit("FilePath")), F.array((n % 100).cast("string"), F.col("user_id").cast("string"), F.lit("/x")))
    rows = logs.sanitize(read(spark, d, "events").select("event_id", F.concat("event_type", F.lit(" #"), "event_id", F.lit("/x")).alias("event"), data.alias("data")))
    return rows.select("event_id", "event", F.try_element_at("data", F.lit("k")).alias("k"), F.try_element_at("data", F.lit("user")).alias("user"))


@query("select doc_id as file_id, 'https://www.virustotal.com/gui/search/' || sha256(text) as url from documents")
def hash_lookup_url(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("file_id", B.lookup_url(F.sha2("content", 256)).alias("url"))


@query("select case when p_size % 2 = 0 then 'even' else 'odd' end as kind, count(*) as n, sum(s.n)::bigint as lines from part p join (select l_partkey, count(*) as n from lineitem group by 1) s on s.l_partkey = p.p_partkey group by 1")
def count_rollup(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd").alias("kind"))
    counted = batch.with_counts(part, "p_partkey", lines=read(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))).where("lines > 0")
    return counted.groupBy("kind").agg(F.count("*").alias("n"), F.sum("lines").alias("lines"))


@query("select event_id, strftime(ts, '%Y%m%d%H%M%S') as stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0' as round_trip from events")
def date_formats(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", metadata.stamp(F.col("ts")).alias("stamp"), F.left(metadata.round_trip(F.col("ts")), F.lit(27)).alias("round_trip"))


@query("select p_partkey, (p_size || '.' || p_partkey % 10)::double as aperture, p_size as whole from part")
def first_numbers(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("f/"), "p_size", F.lit(","), (F.col("p_partkey") % 10).cast("string"), F.lit(" of 9.5"))
    return read(spark, d, "part").select("p_partkey", metadata.first_decimal(text).alias("aperture"), metadata.first_number(text).alias("whole"))


@query("select doc_id as file_id, doc_id % 4 < 2 or regexp_matches(text, '[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]') as right_to_left from documents")
def right_to_left(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a letter of the Arabic blocks; one is added to half of them, and one of another block to the rest."""
    mark = F.element_at(F.array(*map(F.lit, "\u0627\uFB50\u05D0\u0905")), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, d, "documents").select(F.col("doc_id").alias("file_id"), B.has_arabic(F.concat("text", mark)).alias("right_to_left"))


@query("select doc_id as file_id, 'SHA-256, SHA-1, MD5, CRC-32, Shannon entropy' as algorithms from documents")
def algorithms(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import reports

    ident = identity.identity(files(spark, d))
    return ident.select("file_id", F.array_join(reports.algorithms(ident), ", ").alias("algorithms"))
