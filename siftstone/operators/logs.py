"""Privacy-safe log events and the scan history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A key that has one of these parts is dropped.
BLOCKED = ["path", "filename", "gps", "latitude", "longitude", "ocr", "text", "image", "bytes", "content", "payload"]
ENTRIES, KEY_CHARS, VALUE_CHARS, EVENT_CHARS = 32, 64, 128, 80


def event_name(c: Column) -> Column:
    """Letters, digits, dot, underscore and hyphen only, at most 80; "event" if none remain."""
    kept = F.left(F.regexp_replace(c, r"[^\p{L}\p{Nd}._-]", ""), F.lit(EVENT_CHARS))
    return F.when(F.coalesce(kept, F.lit("")) == "", F.lit("event")).otherwise(kept)


def safe_data(data: Column) -> Column:
    """A map<string,string> without blocked keys, with at most 32 of its first entries and cut keys and values."""
    entries = F.slice(F.map_entries(data), 1, ENTRIES)
    blocked = lambda k: F.exists(F.array(*map(F.lit, BLOCKED)), lambda b: F.contains(F.lower(k), b))
    kept = F.filter(entries, lambda e: (F.trim(e["key"]) != "") & ~blocked(e["key"]))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(F.left(e["key"], F.lit(KEY_CHARS)).alias("key"), F.left(e["value"], F.lit(VALUE_CHARS)).alias("value"))))


def sanitize(events: DataFrame, event: str = "event", data: str = "data") -> DataFrame:
    """``events`` with a safe name and safe data."""
    return events.withColumn(event, event_name(F.col(event))).withColumn(data, safe_data(F.col(data)))


def write_log(events: DataFrame, path: str) -> None:
    """Append sanitised events as JSON lines."""
    sanitize(events).write.mode("append").json(path)


class History:
    """The latest scans below a path, newest first, at most 200 by insertion. ``private`` keeps nothing."""

    KEEP = 200
    SCHEMA = "seq long, scanned_at timestamp, file_name string, detected_type string, size_bytes long, sha256 string, deep boolean, indicator_count int, privacy_risk_count int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except Exception as e:  # a folder that is not there yet is an empty history
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def add(self, rows: DataFrame, private: bool = False) -> None:
        """Append rows in their order of ``scanned_at`` and ``file_name``."""
        if private:
            return
        last = self._all().agg(F.max("seq")).first()[0] or 0
        newest = rows.orderBy(F.desc("scanned_at"), F.desc("file_name")).limit(self.KEEP)
        from pyspark.sql import Window

        numbered = newest.withColumn("seq", F.row_number().over(Window.orderBy("scanned_at", "file_name")).cast("long") + F.lit(last))
        numbered.select([c.split()[0] for c in self.SCHEMA.split(", ")]).coalesce(1).write.mode("append").parquet(self.path)

    def recent(self, limit: int = 50) -> DataFrame:
        n = min(max(limit, 1), self.KEEP)
        return self._all().orderBy(F.desc("seq")).limit(n)

    def compact(self) -> None:
        """Rewrite what ``recent`` can still show."""
        rows = self._all().orderBy(F.desc("seq")).limit(self.KEEP).collect()
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(self.path)

    def clear(self) -> None:
        self.spark.createDataFrame([], self.SCHEMA).write.mode("overwrite").parquet(self.path)
