"""Metadata as ordered (directory, tag, raw, parsed) rows: lookup, search, difference, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a tag means.
MEANINGS = {
    "Make": "Camera/device manufacturer",
    "Model": "Camera/device model",
    "Lens Model": "Lens model",
    "Lens Serial Number": "Lens serial number when recorded",
    "Body Serial Number": "Camera/device body serial number when recorded",
    "Serial Number": "Device or component serial number when recorded",
    "Software": "Software recorded as processing or writing metadata",
    "Artist": "Author/artist field",
    "Copyright": "Copyright field",
    "Date/Time Original": "Original capture timestamp",
    "Date/Time Digitized": "Digitization timestamp",
    "Date/Time": "Metadata modification timestamp",
    "Offset Time": "Timezone offset associated with a metadata timestamp",
    "Offset Time Original": "Timezone offset for original capture time",
    "Offset Time Digitized": "Timezone offset for digitization time",
    "GPS Latitude": "Recorded latitude",
    "GPS Longitude": "Recorded longitude",
    "GPS Altitude": "Recorded altitude",
    "GPS Speed": "Recorded movement speed",
    "GPS Img Direction": "Recorded camera/image direction",
    "GPS Track": "Recorded movement direction",
    "GPS Time-Stamp": "Recorded GPS time",
    "GPS Date Stamp": "Recorded GPS date",
    "Exposure Time": "Camera exposure time",
    "F-Number": "Aperture value",
    "Aperture Value": "Aperture value",
    "ISO Speed Ratings": "Sensor ISO setting",
    "Photographic Sensitivity": "Sensor ISO/sensitivity setting",
    "Focal Length": "Lens focal length",
    "Flash": "Flash state",
    "White Balance Mode": "Recorded white-balance mode",
    "White Balance": "Recorded white-balance value",
    "Metering Mode": "Camera metering mode",
    "Orientation": "Stored display/camera orientation",
    "Digital Zoom Ratio": "Recorded digital zoom ratio",
    "Camera Temperature": "Camera/device temperature if the maker recorded it",
    "User Comment": "User or device comment field",
    "Image Description": "Image description/caption",
    "XP Title": "Windows XP title metadata",
    "XP Comment": "Windows XP comment metadata",
    "XP Keywords": "Windows XP keywords metadata",
    "XP Subject": "Windows XP subject metadata",
    "XP Author": "Windows XP author metadata",
}
NO_MEANING = "No description for this tag"


def is_tag(tag: Column, *names: str) -> Column:
    """Equality without regard to case."""
    return F.lower(tag).isin([n.lower() for n in names])


def has(c: Column, *parts: str) -> Column:
    """Whether one of the parts is contained, without regard to case."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(F.lower(c), F.lit(p.lower()))
    return out


def shown(parsed: Column, raw: Column) -> Column:
    """The parsed value, or the raw one where that is null."""
    return F.coalesce(parsed, raw)


def filled(parsed: Column, raw: Column) -> Column:
    """The parsed value, or the raw one where that is null or blank."""
    return F.when(F.trim(parsed) != "", parsed).otherwise(raw)


def first_number(text: Column) -> Column:
    """The first whole number in a text; null if there is none or it does not fit 32 bits."""
    return F.regexp_extract(text, "[-+]?[0-9]+", 0).try_cast("int")


def first_decimal(text: Column) -> Column:
    """The first decimal number in a text, with a point or comma."""
    return F.replace(F.regexp_extract(text, r"[-+]?\d+(?:[.,]\d+)?", 0), F.lit(","), F.lit(".")).try_cast("double")


def stamp(time: Column) -> Column:
    """Fourteen digits for names of files."""
    return F.date_format(time, "yyyyMMddHHmmss")


def round_trip(time: Column) -> Column:
    """ISO 8601 with seven decimals and the session's offset."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSxxx")


def camera_fields(fields: DataFrame) -> DataFrame:
    """Fields that name a device, its parts or its program."""
    tag = F.col("tag")
    return fields.where(is_tag(tag, "Make", "Model", "Software") | has(tag, "Lens", "Serial"))


def with_meaning(fields: DataFrame) -> DataFrame:
    """``fields`` with ``meaning`` by tag. The table of meanings is a constant of this module, so it is broadcast."""
    known = fields.sparkSession.createDataFrame([(k.lower(), v) for k, v in MEANINGS.items()], "__tag string, __meaning string")
    joined = fields.join(F.broadcast(known), F.lower(fields["tag"]) == known["__tag"], "left")
    return joined.select(*[fields[c] for c in fields.columns if c != "meaning"], F.coalesce("__meaning", F.lit(NO_MEANING)).alias("meaning"))


def search(fields: DataFrame, text: str, limit: int | None = 250) -> DataFrame:
    """Fields whose directory, tag, raw or parsed value contains ``text`` without regard to case; all for blank text. The
    limit is that of a view; None lifts it."""
    found = fields if not text.strip() else fields.where(has(F.coalesce("directory", F.lit("")), text) | has(F.coalesce("tag", F.lit("")), text) | has(F.coalesce("raw", F.lit("")), text) | has(F.coalesce("parsed", F.lit("")), text))
    return found if limit is None else found.orderBy("file_id", "ord").limit(limit)


def first_match(fields: DataFrame, text: str) -> DataFrame:
    """The first matching field of each file; for blank text the first of all."""
    found = search(fields, text, None)
    names = [c for c in fields.columns if c != "file_id"]
    packed = F.min(F.struct("ord", *[c for c in names if c != "ord"])).alias("f")
    return found.groupBy("file_id").agg(packed).select("file_id", *[f"f.{c}" for c in names])


def first_per_key(fields: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, directory, tag, value): the first field of each (directory, tag)."""
    value = F.struct("ord", shown(F.col("parsed"), F.col("raw")).alias("value"))
    return fields.groupBy(*keys, "directory", "tag").agg(F.min(value).alias("f")).select(*keys, "directory", "tag", F.col("f.value").alias("value"))


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, directory, tag, left_value, right_value) of the fields that differ; a field of one side has null on the other.
    Both sides are reduced to the first field of each key before the full outer join."""
    a = first_per_key(left, keys).withColumnRenamed("value", "left_value")
    b = first_per_key(right, keys).withColumnRenamed("value", "right_value")
    return a.join(b, [*keys, "directory", "tag"], "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def icc_difference(diff: DataFrame) -> DataFrame:
    return diff.where(has(F.col("directory"), "ICC"))


def distinct_values(fields: DataFrame, condition: Column, keys: list[str]) -> DataFrame:
    """(keys, values): distinct non-blank values without regard to case, in the first spelling and in order."""
    v = fields.where(condition).select(*keys, "ord", filled(F.col("parsed"), F.col("raw")).alias("v")).where(F.trim("v") != "")
    one = v.groupBy(*keys, F.lower("v").alias("low")).agg(F.min(F.struct("ord", "v")).alias("f"))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["v"]).alias("values"))


def latest(rows: DataFrame, time: str, limit: int = 50, most: int = 200) -> DataFrame:
    """The newest rows, between 1 and ``most`` of them; ties in the order of all columns."""
    n = min(max(limit, 1), most)
    return rows.orderBy(F.desc(time), *[c for c in rows.columns if c != time]).limit(n)


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "ord") -> DataFrame:
    """``rows`` with an ordinal from 0 within ``keys``."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
