"""File identity: one row of hashes, type and consistency for each file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bytesops as B
from ..functions import bytestats
from ..functions.shipping import ship

MAX_BYTES = 512 << 20


def _measured(files: DataFrame, key: str, names: list[str], schema: str, rows) -> DataFrame:
    """A table of ``rows`` (arrays of columns, from a file's bytes) for each file that has any. Each file is one row of an Arrow batch
    and is neither copied nor shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_buffer()
                if content is None or content.size == 0:
                    continue
                for columns in rows(content):
                    n = len(columns[0])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * n)), *columns], [key, *names])

    kind = files.schema[key].dataType.simpleString()
    ship(files.sparkSession)
    return files.select(key, "content").mapInArrow(run, f"{key} {kind}, {schema}")


def byte_statistics(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, entropy, n_bytes, planes, one_ratio, transition_rate) of each file: Shannon entropy of the bytes and of the eight bit
    planes, the share of set lowest bits and of changes between neighbouring ones. Empty and missing contents have no row."""

    def one(content):
        s = bytestats.statistics(content)
        yield pa.array([s["entropy"]]), pa.array([s["n_bytes"]], pa.int64()), pa.array([s["planes"]], pa.list_(pa.float64())), pa.array([s["one_ratio"]]), pa.array([s["transition_rate"]])

    return _measured(files, key, ["entropy", "n_bytes", "planes", "one_ratio", "transition_rate"], "entropy double, n_bytes long, planes array<double>, one_ratio double, transition_rate double", one)


def entropy_table(files: DataFrame, key: str = "file_id", block: int | None = None) -> DataFrame:
    """(key, [block,] entropy, n_bytes): Shannon entropy of the bytes of each file, or of each block of ``block`` bytes."""
    if block is None:
        return byte_statistics(files, key).select(key, "entropy", "n_bytes")

    def blocks(content):
        for number, bits, n in bytestats.block_entropies(content, block):
            yield pa.array(number, pa.int64()), pa.array(bits), pa.array(n, pa.int64())

    return _measured(files, key, ["block", "entropy", "n_bytes"], "block long, entropy double, n_bytes long", blocks)


def identity(files: DataFrame, entropy: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A row for each of ``files`` (file_id, name, content; declared_mime and size_bytes if there are any).

    Empty files and those above ``max_bytes`` are rows with ``error`` and no results, instead of an exception. Where the
    source gives a size, that counts: content it has left out as too large is not an empty file."""
    held = F.octet_length("content").cast("long")
    n = F.coalesce(F.col("size_bytes").cast("long"), held, F.lit(0)) if "size_bytes" in files.columns else F.coalesce(held, F.lit(0).cast("long"))
    error = F.when(n == 0, "The file is empty.").when((n > max_bytes) | held.isNull(), "The file is larger than the limit.")
    good = error.isNull()
    declared = F.trim(F.lower(F.col("declared_mime"))) if "declared_mime" in files.columns else F.lit(None).cast("string")
    given = [c for c in ("file_id", "name", "content", "declared_mime") if c in files.columns]
    rows = files.select(*given, n.alias("size_bytes"), error.alias("error"), F.when(good, B.detect_type(F.col("content"))).alias("detected_type"), B.extension_of(F.col("name")).alias("extension"))
    only = lambda c: F.when(F.col("error").isNull(), c)
    kind, content = F.col("detected_type"), F.col("content")
    out = rows.select(
        "file_id",
        "name",
        "size_bytes",
        "extension",
        kind,
        only(B.mime_of_type(kind)).alias("detected_mime"),
        F.coalesce(F.when(declared != "", declared), B.mime_of_extension(F.col("extension"))).alias("declared_mime"),
        only(B.extension_mismatch(kind, F.col("extension"))).alias("extension_mismatch"),
        only(F.hex(F.substring(content, 1, 16))).alias("signature_hex"),
        only(F.sha2(content, 256)).alias("sha256"),
        only(F.sha1(content)).alias("sha1"),
        only(F.md5(content)).alias("md5"),
        only(B.crc32_hex(content)).alias("crc32"),
        "error",
    )
    if not entropy:
        return out
    return out.join(entropy_table(files.where(F.octet_length("content") <= max_bytes)).select("file_id", "entropy"), "file_id", "left")
