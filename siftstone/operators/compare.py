"""Comparison of pairs of files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bytesops as B
from ..functions import pixels
from ..sources import files as S
from . import metadata
from .identity import identity

PAIR = "struct<mae:double,rmse:double,psnr:double,rgb_similarity:double,crop_similarity:double>"


def pair_pixels(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(left_id, right_id, pixels): measures of each pair (left_id, right_id); null where one side can't be decoded."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kind = _parse_datatype_string(PAIR)
    arrow = to_arrow_type(kind)
    content = files.select("file_id", "content")
    both = pairs.select("left_id", "right_id").join(content.withColumnsRenamed({"file_id": "left_id", "content": "a"}), "left_id").join(content.withColumnsRenamed({"file_id": "right_id", "content": "b"}), "right_id")

    def one(a: bytes | None, b: bytes | None):
        try:
            return pixels.pair_metrics(pixels.decode(a or b""), pixels.decode(b or b""))
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                part = batch.slice(at, 8)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([one(a.as_py(), b.as_py()) for a, b in zip(part.column(2), part.column(3))], arrow)], ["left_id", "right_id", "pixels"])

    schema = StructType([*(StructField(n, files.schema["file_id"].dataType) for n in ("left_id", "right_id")), StructField("pixels", kind)])
    return both.select("left_id", "right_id", "a", "b").mapInArrow(run, schema)


def relation(exact: Column, same_size: Column, same_aspect: Column, uniform: Column, crop: Column) -> Column:
    """How two pictures are related, by the first condition that holds."""
    return F.when(exact, "Identical files").when(uniform, "Uniform resize candidate").when(crop, "Center crop candidate").when(same_size, "Same dimensions").when(same_aspect, "Same aspect ratio").otherwise("Different dimensions")


def compare(pairs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each pair with similarities, relation and indicators, and the table of metadata differences."""
    wanted = pairs.select(F.explode(F.array("left_id", "right_id")).alias("file_id")).distinct()
    used = files.join(wanted, "file_id", "left_semi")
    seen = S.inspect(used, ("technical", "metadata", "pixels")).persist()
    facts = identity(used, entropy=False).select("file_id", "sha256").join(seen.select("file_id", "technical", "pixels"), "file_id")
    side = lambda s: facts.select(F.col("file_id").alias(f"{s}_id"), F.struct("sha256", "technical", "pixels").alias(s))
    both = pairs.select("left_id", "right_id").join(side("left"), "left_id").join(side("right"), "right_id").join(pair_pixels(pairs, used), ["left_id", "right_id"], "left")
    fields = S.children(seen, "metadata", "fields")
    mine = lambda s: pairs.select("left_id", "right_id", F.col(f"{s}_id").alias("file_id")).join(fields, "file_id").drop("file_id")
    diff = metadata.difference(mine("left"), mine("right"), ["left_id", "right_id"])
    counts = diff.groupBy("left_id", "right_id").agg(F.count("*").alias("metadata_differences"), F.count_if(metadata.has(F.col("directory"), "ICC")).alias("icc_differences"))
    c = F.col
    like = {h: B.hash_similarity(B.hash_from_hex(c(f"left.pixels.{h}")), B.hash_from_hex(c(f"right.pixels.{h}"))) for h in ("a_hash", "d_hash", "p_hash")}
    lw, lh, rw, rh = (c(f"{s}.technical.{d}").cast("double") for s in ("left", "right") for d in ("width", "height"))
    la, ra = lw / lh, rw / rh
    rows = both.join(counts, ["left_id", "right_id"], "left").select(
        "left_id", "right_id", "pixels", "left", "right",
        F.coalesce("metadata_differences", F.lit(0)).alias("metadata_differences"), F.coalesce("icc_differences", F.lit(0)).alias("icc_differences"),
        (c("left.sha256") == c("right.sha256")).alias("exact"),
        *[v.alias(f"{k}_similarity") for k, v in like.items()],
        ((lw == rw) & (lh == rh)).alias("same_size"),
        (F.abs(la - ra) <= F.greatest(F.lit(0.005), 0.005 * F.least(la, ra))).alias("same_aspect"),
        F.abs(rw / lw - rh / lh).alias("scale_gap"),
    )
    rgb, crop = F.coalesce("pixels.rgb_similarity", F.lit(0.0)), F.coalesce("pixels.crop_similarity", F.lit(0.0))
    uniform = ~c("same_size") & c("same_aspect") & (c("scale_gap") <= 0.02) & (c("p_hash_similarity") >= 0.84) & (rgb >= 0.82)
    cropped = ~c("same_aspect") & (crop >= 0.84) & (F.greatest("p_hash_similarity", "d_hash_similarity") >= 0.72)
    quality = F.abs(c("left.pixels.jpeg_quality") - c("right.pixels.jpeg_quality")) >= 8
    chroma = c("left.pixels.chroma") != c("right.pixels.chroma")
    rules = [("compare.exact_hash", 3, c("exact")), ("compare.uniform_resize_candidate", 1, uniform), ("compare.center_crop_candidate", 1, cropped), ("compare.compression_change", 1, F.coalesce(quality, F.lit(False)) | F.coalesce(chroma, F.lit(False))), ("compare.icc_difference", 3, c("icc_differences") > 0), ("compare.metadata_difference", 3, c("metadata_differences") > 0)]
    found = F.filter(F.array(*[F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(conf).alias("confidence"))) for code, conf, cond in rules]), lambda x: x.isNotNull())
    out = rows.select("*", relation(c("exact"), c("same_size"), c("same_aspect"), uniform, cropped).alias("relation"), found.alias("indicators"))
    return out.drop("left", "right", "scale_gap"), diff
