"""Consistency and privacy rules over metadata, container and technical tables.

Rules are (code, confidence, condition) triples over conditional aggregates: one aggregation per file yields all that the rules
look at, then each rule is an expression of that row. Findings never say whether a picture is genuine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metadata import filled, first_number, has, is_tag, shown

UNKNOWN, POSSIBLE, LIKELY, CONFIRMED = range(4)
CONFIDENCE = ["Unknown", "Possible", "Likely", "Confirmed"]

# Tags that the privacy rules look for.
OWNER_TAGS = ("Artist", "Copyright", "XP Author", "Owner Name", "Author")
TIME_TAGS = ("Date/Time Original", "Date/Time Digitized", "Date/Time", "Create Date", "Modify Date", "Metadata Date", "GPS Date Stamp", "GPS Time-Stamp")
COMMENT_SEGMENTS = ("tEXt", "zTXt", "iTXt", "PLAIN-TEXT")
PRIVACY_TITLES = {
    "privacy.gps": "GPS metadata",
    "privacy.device_model": "Device/camera model",
    "privacy.serial": "Serial number",
    "privacy.owner": "Owner/artist/author metadata",
    "privacy.timestamp": "Capture/edit timestamp metadata",
    "privacy.software": "Software/history metadata",
    "privacy.thumbnail": "Embedded thumbnail/preview metadata",
    "privacy.xmp": "XMP metadata",
    "privacy.iptc": "IPTC metadata",
    "privacy.comments": "Comments/descriptions/keywords",
    "privacy.trailing": "Hidden/appended data",
}
#: Codes that may not remain in a cleaned copy.
SENSITIVE = tuple(PRIVACY_TITLES)


def privacy_conditions(directory: Column, tag: Column, value: Column) -> dict[str, Column]:
    """Condition of each rule on one field."""
    dated = is_tag(tag, *TIME_TAGS) | F.startswith(F.lower(tag), F.lit("offset time"))
    number = F.regexp_extract(value, r"\d+", 0).try_cast("int")
    there = (F.trim(value) != "") & ~F.trim(value).isin("0", "0 px", "0 pixels")
    thumbnail = has(directory, "Thumbnail") | (has(tag, "Thumbnail Offset", "Thumbnail Length", "Thumbnail Data", "Preview Image") & there) | (is_tag(tag, "Thumbnail Width", "Thumbnail Height") & (number > 0))
    return {
        "privacy.gps": has(directory, "GPS") | F.startswith(F.lower(tag), F.lit("gps ")),
        "privacy.device_model": is_tag(tag, "Model", "Make"),
        "privacy.serial": has(tag, "Serial"),
        "privacy.owner": is_tag(tag, *OWNER_TAGS) | has(tag, "Creator", "By-line"),
        "privacy.timestamp": dated,
        "privacy.software": is_tag(tag, "Software") | has(tag, "Processing Software", "Creator Tool", "History", "Host Computer"),
        "privacy.thumbnail": F.coalesce(thumbnail, F.lit(False)),
        "privacy.xmp": has(directory, "XMP"),
        "privacy.iptc": has(directory, "IPTC"),
        "privacy.comments": has(tag, "Comment", "Description", "Caption", "Keyword") | is_tag(tag, "XP Title", "XP Subject"),
    }


def privacy_risks(fields: DataFrame, segments: DataFrame | None = None, containers: DataFrame | None = None, key: str = "file_id", more: dict[str, Column] | None = None) -> DataFrame:
    """(key, code, title, fields, examples, confidence): one row for each file and code.

    ``fields``: key, ord, directory, tag, raw, parsed. ``segments``: key, type, description. ``containers``: key, trailing_bytes.
    ``more`` has conditions on fields by code; they replace those of known codes, and a new code is its own title.
    ``fields`` counts the matching fields, ``examples`` has up to four distinct ones in order. Each field is matched against all
    rules at once and only its hits are shuffled."""
    value = shown(F.col("parsed"), F.col("raw"))
    hit = F.filter(F.array(*[F.when(c, F.lit(code)) for code, c in (privacy_conditions(F.col("directory"), F.col("tag"), value) | (more or {})).items()]), lambda x: x.isNotNull())
    label = F.concat(F.lit("["), "directory", F.lit("] "), "tag")
    hits = fields.select(key, "ord", label.alias("label"), F.explode(hit).alias("code"))
    one = hits.groupBy(key, "code", F.lower("label").alias("low")).agg(F.count("*").alias("n"), F.min(F.struct("ord", "label")).alias("f"))
    found = one.groupBy(key, "code").agg(F.sum("n").alias("fields"), F.slice(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["label"]), 1, 4).alias("examples"))
    none = F.array().cast("array<string>")
    if segments is not None:
        xmp = (F.lower("type") == "xmp ") | has(F.col("description"), "XMP")
        note = is_tag(F.col("type"), "COM", "COMMENT") | F.col("type").isin(*COMMENT_SEGMENTS)
        kinds = F.filter(F.array(F.when(xmp, F.lit("privacy.xmp")), F.when(note, F.lit("privacy.comments"))), lambda x: x.isNotNull())
        found = found.unionByName(segments.select(key, F.explode(kinds).alias("code")).distinct().select(key, "code", F.lit(0).cast("long").alias("fields"), none.alias("examples")))
    if containers is not None:
        found = found.unionByName(containers.where("trailing_bytes > 0").select(key, F.lit("privacy.trailing").alias("code"), F.lit(0).cast("long").alias("fields"), none.alias("examples")))
    merged = found.groupBy(key, "code").agg(F.max("fields").alias("fields"), F.max_by("examples", "fields").alias("examples"))
    title = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PRIVACY_TITLES.items() for x in pair]), F.col("code")), F.col("code"))
    return merged.select(key, "code", title.alias("title"), "fields", "examples", F.lit(CONFIRMED).alias("confidence"))


def privacy_summary(risks: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, privacy_risk_count, has_sensitive_data, codes) with codes sorted without regard to case."""
    return risks.groupBy(key).agg(F.countDistinct("code").cast("int").alias("privacy_risk_count"), F.array_sort(F.collect_set(F.lower("code"))).alias("codes")).withColumn("has_sensitive_data", F.col("privacy_risk_count") > 0)


def sensitive(risks: DataFrame, codes: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """Risks whose code is one of a given set."""
    return risks.where(F.lower("code").isin([c.lower() for c in codes]))


def confirmed(indicators: DataFrame) -> DataFrame:
    """Indicators that were directly observed."""
    return indicators.where(F.col("confidence") == CONFIRMED)


def metadata_time(text: Column) -> Column:
    """A timestamp in one of the usual formats; null if it is none. Times without a zone are in the session's."""
    t = F.trim(text)
    formats = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy:MM:dd HH:mm:ssXXX")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats], t.try_cast("timestamp"))


def normal_orientation(text: Column) -> Column:
    """One of eight names, tested in this order; null for anything else."""
    v = F.lower(F.regexp_replace(text, "[ ,-]", ""))
    # Parts of the text for each orientation, in order of tests.
    parts = [("TopLeft", ("topleft", "horizontal/normal", "normal")), ("TopRight", ("topright", "mirrorhorizontal")), ("BottomRight", ("bottomright", "rotate180")), ("BottomLeft", ("bottomleft", "mirrorvertical")), ("LeftTop", ("lefttop", "mirrorhorizontalandrotate270")), ("RightTop", ("righttop", "rotate90cw")), ("RightBottom", ("rightbottom", "mirrorhorizontalandrotate90")), ("LeftBottom", ("leftbottom", "rotate270cw", "rotate90ccw"))]
    out = F.when(F.trim(text) == "", F.lit(None).cast("string"))
    for name, texts in parts:
        out = out.when(has(v, *texts), name)
    for i, (name, _) in enumerate(parts, 1):
        out = out.when(text == str(i), name)
    return out


def _first(condition: Column, value: Column, order: str = "ord") -> Column:
    """Value of the first field that fits."""
    return F.min(F.when(condition, F.struct(F.col(order), value.alias("v")))).getField("v")


def _distinct(condition: Column, value: Column) -> Column:
    """Distinct non-blank values without regard to case, sorted by first appearance."""
    return F.collect_set(F.when(condition & (F.trim(value) != ""), F.lower(value)))


def consistency(identity: DataFrame, technical: DataFrame, fields: DataFrame, containers: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, ord, code, confidence, confidence_name, evidence): findings of the consistency rules.

    ``identity``: key, extension_mismatch, detected_type, extension. ``technical``: key, width, height, orientation. ``fields``: key, ord,
    directory, tag, raw, parsed. ``containers``: key, trailing_bytes, warnings. Fields are aggregated once per file."""
    tag, directory, value = F.col("tag"), F.col("directory"), filled(F.col("parsed"), F.col("raw"))
    number = first_number(value)
    original, thumb = is_tag(tag, "Date/Time Original", "DateTimeOriginal"), has(directory, "Thumbnail")
    facts = fields.groupBy(key).agg(
        *[_distinct(is_tag(tag, t), value).alias(n) for t, n in (("Make", "makes"), ("Model", "models"), ("Lens Model", "lenses"), ("Software", "programs"))],
        _distinct(has(tag, "Serial"), value).alias("serials"),
        _distinct(original, value).alias("originals"),
        _first(is_tag(tag, "Orientation"), value).alias("stored"),
        F.coalesce(_first(is_tag(tag, "Exif Image Width"), number), _first(is_tag(tag, "Pixel X Dimension"), number)).alias("exif_w"),
        F.coalesce(_first(is_tag(tag, "Exif Image Height"), number), _first(is_tag(tag, "Pixel Y Dimension"), number)).alias("exif_h"),
        F.coalesce(_first(is_tag(tag, "Date/Time Original"), value), _first(is_tag(tag, "DateTimeOriginal"), value)).alias("t_original"),
        F.coalesce(_first(is_tag(tag, "Date/Time Digitized"), value), _first(is_tag(tag, "DateTimeDigitized"), value)).alias("t_digitized"),
        F.coalesce(_first(is_tag(tag, "Date/Time"), value), _first(is_tag(tag, "Modify Date"), value), _first(is_tag(tag, "ModifyDate"), value)).alias("t_modified"),
        _first(thumb & has(tag, "Width") & (number > 0), number).alias("thumb_w"),
        _first(thumb & has(tag, "Height") & (number > 0), number).alias("thumb_h"),
    )
    row = identity.select(key, "extension_mismatch", "detected_type", "extension").join(technical.select(key, "width", "height", "orientation"), key, "left").join(containers.select(key, "trailing_bytes", "warnings"), key, "left").join(facts, key, "left")
    c = F.col
    ratio = F.when(c("height") > 0, c("width") / c("height"))
    time = metadata_time
    stored, decoded = normal_orientation(c("stored")), normal_orientation(c("orientation"))
    values = lambda n: F.array_join(F.array_sort(c(n)), " | ")
    size = F.concat(c("width").cast("string"), F.lit("x"), c("height").cast("string"))
    thumb_off = F.abs(c("thumb_w") / c("thumb_h") - ratio) / F.greatest(F.lit(0.0001), ratio)
    rules = [
        ("file.extension_mismatch", CONFIRMED, c("extension_mismatch"), F.concat_ws(" ", c("extension"), F.lit("is"), c("detected_type"))),
        ("container.trailing_bytes", CONFIRMED, c("trailing_bytes") > 0, c("trailing_bytes").cast("string")),
        ("container.structure_warning", LIKELY, F.size("warnings") > 0, F.array_join(F.slice("warnings", 1, 5), " | ")),
        ("metadata.make_conflict", LIKELY, F.size("makes") > 1, values("makes")),
        ("metadata.model_conflict", LIKELY, F.size("models") > 1, values("models")),
        ("metadata.lens_conflict", LIKELY, F.size("lenses") > 1, values("lenses")),
        ("metadata.software_conflict", LIKELY, F.size("programs") > 1, values("programs")),
        ("metadata.software_present", CONFIRMED, F.size("programs") == 1, values("programs")),
        ("metadata.serial_conflict", POSSIBLE, F.size("serials") > 1, values("serials")),
        ("metadata.orientation_mismatch", LIKELY, stored != decoded, F.concat_ws(" / ", stored, decoded)),
        ("metadata.dimension_mismatch", LIKELY, (c("exif_w") > 0) & (c("exif_h") > 0) & ((c("exif_w") != c("width")) | (c("exif_h") != c("height"))), F.concat_ws(" ", c("exif_w"), c("exif_h"), F.lit("against"), size)),
        ("image.extreme_small_dimension", CONFIRMED, (c("width") <= 2) | (c("height") <= 2), size),
        ("image.extreme_aspect_ratio", CONFIRMED, (ratio > 20) | (ratio < 0.05), size),
        ("metadata.time_digitized_before_original", POSSIBLE, time(c("t_digitized")) < time(c("t_original")), F.concat_ws(" < ", "t_digitized", "t_original")),
        ("metadata.time_modified_before_original", POSSIBLE, time(c("t_modified")) < time(c("t_original")), F.concat_ws(" < ", "t_modified", "t_original")),
        ("metadata.original_time_conflict", POSSIBLE, F.size("originals") > 1, values("originals")),
        ("metadata.thumbnail_aspect_mismatch", POSSIBLE, thumb_off > 0.15, F.concat_ws("x", "thumb_w", "thumb_h")),
    ]
    found = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(i).alias("ord"), F.lit(code).alias("code"), F.lit(conf).alias("confidence"), F.lit(CONFIDENCE[conf]).alias("confidence_name"), text.alias("evidence"))) for i, (code, conf, cond, text) in enumerate(rules)])
    return row.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select(key, "f.*")
