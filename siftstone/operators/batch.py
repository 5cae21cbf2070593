"""The flat fact table of a batch, its views and its CSV and JSON forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .duplicates import exact_duplicates, near_duplicates

#: Columns in order, and whether the CSV quotes them.
COLUMNS = {"file_name": True, "sha256": True, "detected_type": True, "size_bytes": False, "width": False, "height": False, "aspect_ratio": False, "has_gps": False, "privacy_risk_count": False, "indicator_count": False, "barcode_count": False, "ocr_character_count": False, "a_hash": True, "d_hash": True, "p_hash": True, "duplicate_of": True, "near_duplicate_of": True, "error": True}
HEADERS = "FileName,SHA256,DetectedType,SizeBytes,Width,Height,AspectRatio,HasGps,PrivacyRiskCount,IndicatorCount,BarcodeCount,OcrCharacterCount,AverageHash,DifferenceHash,PerceptualHash,ExactDuplicateOf,NearDuplicateOf,Error"


def with_counts(rows: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """``rows`` with a column of row counts by key for each named table, 0 where it has none."""
    for name, part in parts.items():
        n = part.groupBy(key).agg(F.count("*").cast("int").alias(name))
        rows = rows.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows


def batch_rows(rows: DataFrame, order: str = "ord", least: float = 0.95) -> DataFrame:
    """Rows with ``duplicate_of`` and ``near_duplicate_of``. ``rows`` has the columns of the fact table but these, hashes as
    signed longs in ``p_hash``, and an ordinal; rows with an error take no part in comparisons."""
    good, bad = rows.where(F.col("error").isNull()), rows.where(F.col("error").isNotNull())
    exact = exact_duplicates(good, "sha256", "file_name", order)
    near = near_duplicates(exact, "p_hash", "file_name", order, least).drop("similarity")
    none = F.lit(None).cast("string")
    return near.unionByName(bad.select(*rows.columns, none.alias("duplicate_of"), none.alias("near_duplicate_of")))


VIEWS = {
    "all": None,
    "gps": "has_gps",
    "privacy": "privacy_risk_count > 0",
    "exact": "duplicate_of is not null",
    "near": "near_duplicate_of is not null",
    "errors": "error is not null and trim(error) <> ''",
}


def view(rows: DataFrame, name: str) -> DataFrame:
    """One of the named views: all, gps, privacy, exact, near, errors."""
    condition = VIEWS[name]
    return rows if condition is None else rows.where(condition)


def _field(name: str, quoted: bool) -> Column:
    c = F.col(name)
    if quoted:
        return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    if name == "aspect_ratio":
        return F.format_string("%.6f", F.coalesce(c, F.lit(0.0)))
    if name == "has_gps":
        return F.when(c, "True").otherwise("False")
    return F.coalesce(c.cast("string"), F.lit(""))


def csv_line(rows: DataFrame) -> Column:
    """A line of the CSV: text columns always quoted, quotes doubled, numbers bare."""
    return F.concat_ws(",", *[_field(n, q) for n, q in COLUMNS.items() if n in rows.columns])


def write_csv(rows: DataFrame, path: str, order: str = "ord") -> None:
    """Lines in input order, each part file with the header."""
    lines = rows.orderBy(order).select(csv_line(rows).alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\n").text(path)


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*[c for c in COLUMNS if c in rows.columns]), {"ignoreNullFields": "false"}).alias("value"))
