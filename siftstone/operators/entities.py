"""URLs, e-mail addresses and telephone numbers in texts and barcodes, in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the three kinds; Unicode classes as in the original definition.
URL = r"(?iU)\b(?:https?://|www\.)[^\s<>\"']+"
EMAIL = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?U)(?<![\p{L}\p{N}])\+?\d[\d\s().-]{5,}\d(?![\p{L}\p{N}])"
TRAILING = ".,;:!?)]}،؛"


def normal_url(raw: Column) -> Column:
    """An absolute http(s) URL with lower-case scheme and host, or null."""
    text = F.trim(raw)
    text = F.when(F.startswith(F.lower(text), F.lit("www.")), F.concat(F.lit("https://"), text)).otherwise(text)
    whole = r"(?i)^(https?)://([^/?#\s]+)([^\s]*)$"
    scheme, host, rest = (F.regexp_extract(text, whole, i) for i in (1, 2, 3))
    path = F.when((rest == "") | F.startswith(rest, F.lit("?")) | F.startswith(rest, F.lit("#")), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(F.regexp_like(text, F.lit(whole)), F.concat(F.lower(scheme), F.lit("://"), F.lower(host), path))


def found_in(text: Column) -> Column:
    """Array of (kind, value) in a text: URLs, then e-mail addresses, then telephone numbers."""
    of = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    urls = F.filter(F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda v: normal_url(F.rtrim(v, F.lit(TRAILING)))), lambda v: v.isNotNull())
    digits = lambda v: F.length(F.regexp_replace(v, r"(?U)\D", ""))
    phones = F.filter(F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), lambda v: F.trim(v)), lambda v: (digits(v) >= 7) & (digits(v) <= 18))
    return F.concat(of("URL", urls), of("Email", F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))), of("Phone", phones))


def text_entities(texts: DataFrame, key: str = "file_id", text: str = "text", source: str = "source", barcode_format: str | None = None) -> DataFrame:
    """(key, ord, kind, value, source): distinct without regard to case, first spelling, in order of appearance.

    If a column with barcode formats is named, a QR code whose whole text is a URL gives a "QR URL" as well. Distinctness is
    per row set of one key, which a hash aggregate settles before anything is sorted."""
    rows = texts.where(F.trim(text) != "")
    value = F.col(text)
    each = found_in(value)
    if barcode_format:
        whole = F.when(F.contains(F.lower(F.col(barcode_format)), F.lit("qr")), normal_url(value))
        qr = F.when(whole.isNotNull(), F.array(F.struct(F.lit("QR URL").alias("kind"), whole.alias("value")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
        each = F.concat(qr, each)
    out = rows.select(key, F.col(source).alias("source"), F.posexplode(each).alias("ord", "e")).select(key, "ord", F.col("e.kind").alias("kind"), F.col("e.value").alias("value"), "source")
    first = out.groupBy(key, "kind", "source", F.lower("value").alias("low")).agg(F.min(F.struct("ord", "value")).alias("f"))
    return first.select(key, F.col("f.ord").alias("ord"), "kind", F.col("f.value").alias("value"), "source")
