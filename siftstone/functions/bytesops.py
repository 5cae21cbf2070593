"""Expressions over binary content: hashes, entropy, signatures, names of types. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type, MIME type and extensions of each signature; brands of ISO files; MIME types of extensions.
HEIF_BRANDS = ["heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs", "mif1", "msf1"]
AVIF_BRANDS = ["avif", "avis"]
TYPES = {
    "JPEG": ("image/jpeg", [".jpg", ".jpeg"]),
    "PNG": ("image/png", [".png"]),
    "GIF": ("image/gif", [".gif"]),
    "WebP": ("image/webp", [".webp"]),
    "BMP": ("image/bmp", [".bmp"]),
    "TIFF": ("image/tiff", [".tif", ".tiff", ".dng"]),
    "AVIF": ("image/avif", [".avif"]),
    "HEIF/HEIC": ("image/heif", [".heic", ".heif", ".hif"]),
    "ISO-BMFF": ("application/octet-stream", []),
    "Unknown": ("application/octet-stream", []),
}
MIME_BY_EXTENSION = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".webp": "image/webp",
    ".bmp": "image/bmp",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".heic": "image/heif",
    ".heif": "image/heif",
    ".avif": "image/avif",
}
OCTETS = "application/octet-stream"


def hex_lower(c: Column) -> Column:
    return F.lower(F.hex(c))


def crc32_hex(content: Column) -> Column:
    """CRC-32 as eight hex digits."""
    return F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0")


def byte_pairs(content: Column) -> Column:
    """Array of two-digit hex strings, one for each byte."""
    return F.regexp_extract_all(F.hex(content), F.lit("[0-9A-F]{2}"), F.lit(0))


def detect_type(content: Column) -> Column:
    """Type by the first bytes; the first signature that fits decides."""
    head = F.hex(F.substring(content, 1, 32))
    brand = F.decode(F.unhex(F.substring(head, 17, 8)), "ISO-8859-1")
    at = lambda text: text.encode().hex().upper()
    return (
        F.when(F.startswith(head, F.lit("FFD8FF")), "JPEG")
        .when(F.startswith(head, F.lit("89504E470D0A1A0A")), "PNG")
        .when(F.startswith(head, F.lit(at("GIF87a"))) | F.startswith(head, F.lit(at("GIF89a"))), "GIF")
        .when(F.startswith(head, F.lit(at("RIFF"))) & (F.substring(head, 17, 8) == at("WEBP")), "WebP")
        .when(F.startswith(head, F.lit(at("BM"))), "BMP")
        .when(F.startswith(head, F.lit("49492A00")) | F.startswith(head, F.lit("4D4D002A")), "TIFF")
        .when((F.substring(head, 9, 8) == at("ftyp")) & (F.length(head) >= 24), F.when(brand.isin(AVIF_BRANDS), "AVIF").when(brand.isin(HEIF_BRANDS), "HEIF/HEIC").otherwise("ISO-BMFF"))
        .otherwise("Unknown")
    )


def _by_type(kind: Column, values: dict, default: Column) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out.otherwise(default)


def mime_of_type(kind: Column) -> Column:
    return _by_type(kind, {k: v[0] for k, v in TYPES.items()}, F.lit(OCTETS))


def extensions_of_type(kind: Column) -> Column:
    empty = F.array().cast("array<string>")
    return _by_type(kind, {k: F.array(*map(F.lit, v[1])) for k, v in TYPES.items() if v[1]}, empty)


def extension_of(name: Column) -> Column:
    """The last dot and what follows it, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))


def mime_of_extension(extension: Column) -> Column:
    return _by_type(extension, MIME_BY_EXTENSION, F.lit(OCTETS))


def extension_mismatch(kind: Column, extension: Column) -> Column:
    known = extensions_of_type(kind)
    return (F.size(known) > 0) & ~F.array_contains(known, extension)


def entropy_of_counts(counts: Column) -> Column:
    """Bits for each symbol of an array of counts."""
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x)
    return F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: F.when(x > 0, a - (x / total) * F.log2(x / total)).otherwise(a))


def binary_entropy(p: Column) -> Column:
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def hash_similarity(a: Column, b: Column) -> Column:
    """1 - Hamming distance / 64 of two signed 64-bit hashes; 0 where one is missing."""
    return F.coalesce(1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0), F.lit(0.0))


def hash_from_hex(text: Column) -> Column:
    """Signed 64-bit value of 16 hex digits; null if it is none."""
    return F.when(F.regexp_like(text, F.lit("^[0-9a-fA-F]{1,16}$")), F.conv(text, 16, -10).cast("long"))


def hash_to_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def has_arabic(text: Column) -> Column:
    """Whether a letter of the Arabic blocks occurs."""
    return F.regexp_like(text, F.lit(r"[\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF]"))


def lookup_url(sha256: Column, base: str = "https://www.virustotal.com/gui/search/") -> Column:
    """Where a SHA-256 can be looked up by hand; null if it is not one. Nothing is fetched."""
    return F.when(F.regexp_like(sha256, F.lit("^[0-9a-fA-F]{64}$")), F.concat(F.lit(base), F.lower(sha256)))
