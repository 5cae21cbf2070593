"""Renderings of pictures and pairs as PNG bytes, and clean copies without metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels
from ..sources import technical
from ..sources import files as S
from . import rules
from .identity import identity

ONE: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "ela": lambda p: pixels.ela_image(pixels.preview(p, 1024)),
    "bit_plane": lambda p: pixels.bit_plane(pixels.preview(p, 1024), 0),
    "red": lambda p: pixels.channel(pixels.preview(p, 1024), 0),
    "green": lambda p: pixels.channel(pixels.preview(p, 1024), 1),
    "blue": lambda p: pixels.channel(pixels.preview(p, 1024), 2),
    "alpha": lambda p: pixels.channel(pixels.preview(p, 1024), 3),
    "entropy_map": lambda p: pixels.entropy_map(pixels.preview(p, 1024)),
    "histogram": lambda p: pixels.histogram_image(pixels.preview(p, 1024)),
    "diagnostic_ela": lambda p: pixels.ela_image(p, 90, 12),
}
ONE |= {f"plane_{c}_{b}": (lambda p, i=i, b=b: pixels.bit_plane(p, b, i)) for i, c in enumerate("rgba") for b in range(8)}
TWO: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "difference": pixels.difference_image,
    "overlay": pixels.overlay_image,
    "heatmap": pixels.heat_image,
    "contact_sheet": pixels.contact_sheet,
    "diagnostic_difference": lambda a, b: pixels.difference_image(a, pixels.resize(b, a.shape[1], a.shape[0]), None, 4),
}


def _png(f, *contents: bytes | None) -> bytes | None:
    try:
        return pixels.write_png(f(*[pixels.decode(c or b"") for c in contents]))
    except ValueError:
        return None


def visualize(files: DataFrame, kind: str) -> DataFrame:
    """(file_id, png): null for pictures that can't be decoded."""
    f = ONE[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([_png(f, batch.column(1)[i].as_py())], pa.binary())], ["file_id", "png"])

    return files.select("file_id", "content").mapInArrow(run, f"file_id {files.schema['file_id'].dataType.simpleString()}, png binary")


def visualize_pair(pairs: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """(left_id, right_id, png) for each pair."""
    f, content = TWO[kind], files.select("file_id", "content")
    both = pairs.select("left_id", "right_id").join(content.withColumnsRenamed({"file_id": "left_id", "content": "a"}), "left_id").join(content.withColumnsRenamed({"file_id": "right_id", "content": "b"}), "right_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([_png(f, batch.column(2)[i].as_py(), batch.column(3)[i].as_py())], pa.binary())], ["left_id", "right_id", "png"])

    kind_ = files.schema["file_id"].dataType.simpleString()
    return both.select("left_id", "right_id", "a", "b").mapInArrow(run, f"left_id {kind_}, right_id {kind_}, png binary")


def _clean(data: bytes | None) -> tuple[bytes | None, str | None]:
    head = technical.inspect(data or b"")
    if head.error:
        return None, head.error
    if head.frames > 1:
        return None, "Pictures of several frames are not copied."
    try:
        p = pixels.decode(data)
    except ValueError as e:
        return None, str(e)
    turn = technical.ORIENTATIONS.index(head.orientation) + 1
    p = pixels.oriented(p, turn)
    return pixels.write_png(p if (p[..., 3] < 255).any() else p[..., :3]), None


def clean_copies(files: DataFrame) -> DataFrame:
    """(file_id, clean_name, content, error, notes, passed): a PNG of the pixels alone for each picture that can be decoded, checked by the same
    parsers: the source unchanged, no GPS, no sensitive code left, nothing after the end, upright, of the expected size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made, error = _clean(batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([made], pa.binary()), pa.array([error], pa.string())], ["file_id", "content", "error"])

    kind = files.schema["file_id"].dataType.simpleString()
    made = files.select("file_id", "content").mapInArrow(run, f"file_id {kind}, content binary, error string").persist()
    good = made.where(F.col("content").isNotNull()).withColumn("name", F.lit("clean.png"))
    seen = S.inspect(good, ("technical", "metadata", "container")).persist()
    segments, boxes = S.children(seen, "container", "segments"), seen.select("file_id", "container.trailing_bytes")
    left = rules.sensitive(rules.privacy_risks(S.children(seen, "metadata", "fields"), segments, boxes)).groupBy("file_id").agg(F.collect_set("code").alias("left"))
    before = S.inspect(files, ("technical",)).select("file_id", F.col("technical").alias("was"))
    turned = F.col("was.orientation").isin("LeftTop", "RightTop", "RightBottom", "LeftBottom")
    width, height = F.when(turned, F.col("was.height")).otherwise(F.col("was.width")), F.when(turned, F.col("was.width")).otherwise(F.col("was.height"))
    rows = made.join(seen.select("file_id", "technical", "metadata.gps", "container.trailing_bytes"), "file_id", "left").join(left, "file_id", "left").join(before, "file_id", "left")
    notes = F.filter(F.array(F.when(F.col("gps").isNotNull(), "GPS is still there."), F.when(F.size("left") > 0, F.concat(F.lit("Left: "), F.array_join("left", ", "))), F.when(F.col("trailing_bytes") > 0, "There are bytes after the end."), F.when(F.col("technical.orientation") != "TopLeft", "The picture is not upright."), F.when((F.col("technical.width") != width) | (F.col("technical.height") != height), "The size is not as expected.")), lambda x: x.isNotNull())
    stem = F.left(F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), r"[^\p{L}\p{Nd}._-]", "_"), F.lit(80))
    names = files.select("file_id", F.concat(stem, F.lit("-clean.png")).alias("clean_name"))
    out = rows.select("file_id", "content", "error", notes.alias("notes")).join(names, "file_id")
    return out.select("file_id", "clean_name", "content", "error", "notes", (F.col("content").isNotNull() & (F.size("notes") == 0)).alias("passed"))


def manifest(files: DataFrame) -> DataFrame:
    """(value): a line of hash and name for each file."""
    return identity(files, entropy=False).select(F.concat_ws("  ", "sha256", "name").alias("value"))
