"""Tables from files: bytes by Spark's binaryFile source, parsers and kernels in Arrow batches.

Everything that needs the bytes of a file is done in one pass: ``inspect`` runs all parsers and, where a decoder is there, all pixel
kernels on one decoded picture, and gives a row of nested results; child tables are exploded from it. Arrow batches are small, as a
row may hold a whole file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pixels
from ..functions.shipping import ship
from . import containers, hidden, technical, tiff

#: Largest file, and largest pictures for hashes, hidden-bit statistics and heuristics.
MAX_BYTES, HASH_PIXELS, STEGO_PIXELS, HEURISTIC_PIXELS = 512 << 20, 24_000_000, 40_000_000, 60_000_000

SEGMENT = "struct<ord:int,offset:long,length:long,type:string,description:string,suspicious:boolean>"
FIELD = "struct<ord:int,directory:string,tag:string,raw:string,parsed:string>"
FINDING = "struct<ord:int,offset:long,kind:string,evidence:string,confidence:int,limitation:string>"
CONTAINER = f"struct<format:string,trailing_bytes:long,warnings:array<string>,error:string,segments:array<{SEGMENT}>>"
TECHNICAL = "struct<width:int,height:int,aspect_ratio:double,format:string,channels:int,has_alpha:boolean,frames:int,orientation:string,bits_per_pixel:int,bit_depth:int,dpi_x:double,dpi_y:double,palette_entries:int,palette_info:string,compression:string,error:string>"
GPS = "struct<latitude:double,longitude:double,altitude:double,speed:double,direction:double,timestamp:string>"
METADATA = f"struct<fields:array<{FIELD}>,gps:{GPS},errors:array<string>>"
CODE = "array<struct<code:string,confidence:int>>"
PIXELS = f"""struct<error:string,a_hash:string,d_hash:string,p_hash:string,
luma:struct<mean:double,deviation:double,dark:double,bright:double,edge_x:double,edge_y:double,boundary_ratio:double,boundary_finding:boolean>,
stego:struct<red_ones:double,green_ones:double,blue_ones:double,transition_rate:double,plane_entropies:array<double>>,
heuristics:struct<boundary_ratio:double,phase_dominance:double,noise_variation:double,ela_mean:double,ela_variation:double,periodicity:double,copied_tiles:int,peakiness:double,edge_density:double>,
jpeg_quality:double,quantization_mean:double,chroma:string,indicators:{CODE}>"""
STAGES = ("technical", "metadata", "container", "hidden", "pixels")
TYPES = {"technical": TECHNICAL, "metadata": METADATA, "container": CONTAINER, "hidden": f"array<{FINDING}>", "pixels": PIXELS.replace("\n", "")}


def read(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(file_id, ord, name, size_bytes, content) of the files below ``path``; content is null above the cap. The size is a filter that
    the source takes, so larger files are not read. file_id is the path, ord its place among all."""
    source = ship(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = source.where(F.col("length") <= max_bytes).select("path", "length", "content")
    large = source.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
    rows = small.unionByName(large)
    return rows.select(F.col("path").alias("file_id"), F.col("path").alias("ord"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"), "content")


def decoded_by_spark(spark: SparkSession, path: str, most_pixels: int = HASH_PIXELS) -> DataFrame:
    """(file_id, width, height, channels, data) of JPEG, GIF, PNG and BMP files by Spark's image source, after their headers have been
    checked: only files whose header is within the cap are decoded."""
    heads = inspect(read(spark, path), ("technical",)).where((F.col("technical.error").isNull()) & (F.col("technical.width").cast("long") * F.col("technical.height") <= most_pixels))
    pictures = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    pictures = pictures.withColumn("origin", F.regexp_replace("origin", "^file:///", "file:/"))
    return pictures.join(heads.select(F.col("file_id").alias("origin")), "origin", "left_semi").select(F.col("origin").alias("file_id"), "width", "height", F.col("nChannels").alias("channels"), "data")


def _numbered(rows) -> list[dict]:
    return [{"ord": i, **asdict(r)} for i, r in enumerate(rows)]


def run_technical(data: bytes) -> dict:
    t = technical.inspect(data)
    return asdict(t) | {"aspect_ratio": t.aspect, "bits_per_pixel": t.bits_per_pixel}


def run_metadata(data: bytes) -> dict:
    fields, gps, errors = tiff.inspect(data)
    return {"fields": _numbered(fields), "gps": asdict(gps) if gps else None, "errors": errors}


def run_container(data: bytes) -> dict:
    c = containers.walk(data)
    return {"format": c.format, "trailing_bytes": c.trailing, "warnings": c.warnings, "error": c.error, "segments": _numbered(c.segments)}


def run_hidden(data: bytes) -> list[dict]:
    return _numbered(hidden.inspect(data))


def measure(p) -> dict:
    """The kernels on one decoded picture, each up to its own number of pixels; null above it."""
    n = p.shape[0] * p.shape[1]
    a, d, h = pixels.perceptual_hashes(p) if n <= HASH_PIXELS else (None, None, None)
    stego = pixels.stego_metrics(p) if n <= STEGO_PIXELS else None
    return {"a_hash": a, "d_hash": d, "p_hash": h, "luma": pixels.luma_metrics(p) if n <= HASH_PIXELS else None, "stego": stego, "heuristics": pixels.heuristics(p) if n <= HEURISTIC_PIXELS else None}


def run_pixels(data: bytes) -> dict:
    """Measures of a picture that can be decoded here; for others an error and what the JPEG tables tell."""
    jpeg = data.startswith(b"\xff\xd8")
    quality, mean, chroma = pixels.jpeg_tables(data) if jpeg else (None, None, None)
    out = {"jpeg_quality": quality, "quantization_mean": mean, "chroma": chroma, "error": None, "indicators": []}
    head, skipped = technical.inspect(data), {"code": "stego.skipped", "confidence": 0}
    try:
        if head.error is None and head.width * head.height > HEURISTIC_PIXELS:
            raise ValueError("The picture has more pixels than the limit.")
        out |= measure(pixels.decode(data, HEURISTIC_PIXELS))
        found = (pixels.stego_findings(out["stego"]) if out["stego"] else [("stego.skipped", 0)]) + pixels.heuristic_findings(out["heuristics"], jpeg) + ([("pixel.jpeg_block_boundary", 1)] if out["luma"] and out["luma"]["boundary_finding"] else [])
        out["indicators"] = [{"code": c, "confidence": k} for c, k in found]
    except ValueError as e:
        out |= {"error": str(e), "indicators": [skipped, {"code": "pixels.skipped", "confidence": 0}]}
    return out


RUN = {"technical": run_technical, "metadata": run_metadata, "container": run_container, "hidden": run_hidden, "pixels": run_pixels}


def inspect(files: DataFrame, stages: tuple[str, ...] = STAGES, key: str = "file_id") -> DataFrame:
    """(key, one column for each stage). Rows without content, and empty ones, have nulls."""
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([T.StructField(key, files.schema[key].dataType), *(T.StructField(s, T._parse_datatype_string(TYPES[s])) for s in stages)])
    arrow = [to_arrow_type(f.dataType) for f in schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                rows = [None if not x.as_py() else {s: RUN[s](x.as_py()) for s in stages} for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([None if r is None else r[s] for r in rows], t) for s, t in zip(stages, arrow))], [key, *stages])

    return files.select(key, "content").mapInArrow(run, schema)


def measure_decoded(pictures: DataFrame) -> DataFrame:
    """(file_id, a_hash, d_hash, p_hash, luma, stego, heuristics) of rows of ``decoded_by_spark``, whose data is BGR(A) or gray."""
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_type

    names = ("a_hash", "d_hash", "p_hash", "luma", "stego", "heuristics")
    whole = T._parse_datatype_string(TYPES["pixels"])
    schema = T.StructType([T.StructField("file_id", pictures.schema["file_id"].dataType), *(whole[n] for n in names)])
    arrow = [to_arrow_type(whole[n].dataType) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, w, h, n, data = (c[i].as_py() for c in batch.columns)
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)
                rgb = np.repeat(a, 3, axis=-1) if n == 1 else a[..., 2::-1]
                full = a[..., 3:] if n == 4 else np.full((h, w, 1), 255, np.uint8)
                row = measure(np.concatenate([rgb, full], axis=-1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([row[k]], t) for k, t in zip(names, arrow))], ["file_id", *names])

    return pictures.select("file_id", "width", "height", "channels", "data").mapInArrow(run, schema)


def children(inspected: DataFrame, stage: str, part: str | None = None, key: str = "file_id") -> DataFrame:
    """A child table: the rows of an array of one stage."""
    array = F.col(stage) if part is None else F.col(f"{stage}.{part}")
    return inspected.select(key, F.explode(array).alias("x")).select(key, "x.*")
