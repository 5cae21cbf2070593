"""Scans of files: quick (identity and header), deep (everything), and the batch table."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytesops as B
from ..sources import files as S
from . import batch, entities, rules
from .identity import identity

QUICK = ("technical",)


#: Seconds that a scan may take.
TIMEOUT = 120.0


def within(spark: SparkSession, action: Callable, seconds: float = TIMEOUT):
    """What ``action()`` gives. Spark jobs that it still runs after ``seconds`` are cancelled, and TimeoutError is raised."""
    sc, group, late = spark.sparkContext, f"scan-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    before = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    sc.setJobGroup(group, "scan", interruptOnCancel=True)
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"the scan took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        for k, v in before.items():
            sc.setLocalProperty(k, v)


def quick_scan(files: DataFrame) -> DataFrame:
    """Identity and header facts of each file; no other parser runs."""
    return identity(files, entropy=False).join(S.inspect(files, QUICK), "file_id", "left")


def deep_scan(files: DataFrame, texts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of a full scan: report (one row each), fields, segments, hidden, indicators, risks, entities.

    ``texts`` (file_id, text, source) is what an OCR or barcode engine has read, if there is one. The parsers run once, and their rows are
    kept in memory or on disk for the tables made of them."""
    seen = S.inspect(files).persist()
    ident = identity(files)
    fields, segments = S.children(seen, "metadata", "fields"), S.children(seen, "container", "segments")
    boxes = seen.select("file_id", "container.trailing_bytes", "container.warnings", "container.error")
    heads = seen.select("file_id", *[F.when(F.col("technical.error").isNull(), F.col(f"technical.{c}")).alias(c) for c in ("width", "height", "orientation")])
    found = rules.consistency(ident, heads, fields, boxes).select("file_id", F.lit(0).alias("stage"), "ord", "code", "confidence")
    pixel = seen.select("file_id", F.posexplode("pixels.indicators").alias("ord", "x")).select("file_id", F.lit(1).alias("stage"), "ord", "x.code", "x.confidence")
    risks = rules.privacy_risks(fields, segments, boxes)
    indicators = found.unionByName(pixel)
    tables = {"fields": fields, "segments": segments, "hidden": S.children(seen, "hidden"), "indicators": indicators, "risks": risks}
    if texts is not None:
        tables["entities"] = entities.text_entities(texts)
    report = ident.join(seen.drop("hidden").withColumnRenamed("pixels", "measures"), "file_id", "left")
    tables["report"] = batch.with_counts(report, "file_id", indicator_count=indicators, privacy_risk_count=risks, hidden_count=tables["hidden"])
    return tables


def batch_scan(files: DataFrame, texts: DataFrame | None = None, least: float = 0.95) -> DataFrame:
    """The flat fact table of a batch, in input order by ``ord``. A file that is empty, too large or whose structure breaks off within a segment
    is an error row."""
    tables = deep_scan(files, texts)
    report = tables["report"]
    if texts is not None:
        read = texts.groupBy("file_id").agg(F.sum(F.length("text")).cast("int").alias("ocr_character_count"))
        report = report.join(read, "file_id", "left")
    else:
        report = report.withColumn("ocr_character_count", F.lit(0))
    error = F.coalesce(F.col("error"), F.col("container.error"))
    rows = report.join(files.select("file_id", "ord"), "file_id").select(
        "ord",
        F.col("name").alias("file_name"),
        F.when(error.isNull(), F.col("sha256")).alias("sha256"),
        F.col("detected_type"),
        "size_bytes",
        F.coalesce("technical.width", F.lit(0)).alias("width"),
        F.coalesce("technical.height", F.lit(0)).alias("height"),
        F.coalesce("technical.aspect_ratio", F.lit(0.0)).alias("aspect_ratio"),
        F.col("metadata.gps").isNotNull().alias("has_gps"),
        "privacy_risk_count",
        "indicator_count",
        F.lit(0).alias("barcode_count"),
        F.coalesce("ocr_character_count", F.lit(0)).alias("ocr_character_count"),
        *[B.hash_from_hex(F.col(f"measures.{h}")).alias(h) for h in ("a_hash", "d_hash", "p_hash")],
        error.alias("error"),
    )
    return batch.batch_rows(rows, "ord", least)


def barcodes(files: DataFrame) -> DataFrame:
    """(file_id, format, text): no barcode engine comes with this package, so there are no hits."""
    return files.select("file_id", F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("text")).limit(0)


def ocr(files: DataFrame, engine=None) -> DataFrame:
    """(file_id, text, confidence, succeeded, error). ``engine`` is a function from (file_id, content) rows to such a table; without one each
    file has the row of a failed reading."""
    if engine is not None:
        return engine(files.select("file_id", "content"))
    return files.select("file_id", F.lit("").alias("text"), F.lit(0.0).cast("float").alias("confidence"), F.lit(False).alias("succeeded"), F.lit("No OCR engine is set.").alias("error"))


#: What each section of a report shows, from the tables of a deep scan.
SECTIONS = {
    "Overview": lambda t: t["report"].select("file_id", "name", "size_bytes", "detected_type", "sha256", "technical.width", "technical.height", "indicator_count", "privacy_risk_count"),
    "Metadata": lambda t: t["fields"].select("file_id", "ord", "directory", "tag", "raw", "parsed"),
    "GPS": lambda t: t["report"].where("metadata.gps is not null").select("file_id", "metadata.gps.*"),
    "Structure": lambda t: t["segments"].select("file_id", "ord", "offset", "length", "type", "description", "suspicious"),
    "Forensics": lambda t: t["indicators"].select("file_id", "stage", "ord", "code", "confidence"),
    "OCR": lambda t: t["entities"].select("file_id", "ord", "kind", "value", "source") if "entities" in t else t["report"].select("file_id").limit(0),
    "Privacy": lambda t: t["risks"].select("file_id", "code", "title", "fields", "examples", "confidence"),
    "Raw": lambda t: t["report"],
}


def section(tables: dict[str, DataFrame], name: str, most: int | None = 500) -> DataFrame:
    """One of the sections of a scan as a view of at most ``most`` rows; None lifts the limit."""
    view = SECTIONS[name](tables)
    return view if most is None else view.limit(most)


def scan_key(mode: str, mime: str | None = None):
    """What a scan depends on, for rows with file_id, size_bytes and modified."""
    return F.concat_ws("|", F.lit(mode), "file_id", F.col("size_bytes").cast("string"), F.col("modified").cast("string"), F.lit(mime or ""))


def unseen(files: DataFrame, done: DataFrame, mode: str = "deep") -> DataFrame:
    """``files`` (with size_bytes and modified) whose key is not among the keys ``done`` (key): what an incremental run has left to do."""
    return files.withColumn("__key", scan_key(mode)).join(done.select(F.col("key").alias("__key")), "__key", "left_anti").drop("__key")
