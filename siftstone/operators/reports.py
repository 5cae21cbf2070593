"""Scan and comparison reports as JSON, text and PDF."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION, REPORT_TYPE = "1.0", "scan"
CONFIDENCE_SCALE = {"Confirmed": "Directly observed or parsed from this file; says nothing on authenticity or intent.", "Likely": "Strong evidence that other explanations could still account for.", "Possible": "A heuristic sign that needs support from elsewhere.", "Unknown": "Descriptive; what it means can't be told from this check alone."}
LIMITATIONS = ["Heuristic signs are no proof of authenticity, manipulation, source, person or place.", "Ordinary software adds, removes and rewrites metadata.", "Missing metadata does not tell which program handled the file.", "Error levels, resampling, noise and bit statistics need support from elsewhere.", "A place is reported only if the file records it."]
#: Algorithm by the part of a report that shows it was used.
ALGORITHMS = [("sha256", ["SHA-256", "SHA-1", "MD5", "CRC-32"]), ("entropy", ["Shannon entropy"]), ("technical", ["Header parser"]), ("metadata", ["Metadata parser"]), ("container", ["Container walker"]), ("measures", ["aHash", "dHash", "pHash (DCT)", "Error level analysis", "Bit-plane statistics"])]


def algorithms(report: DataFrame) -> Column:
    """Names of what produced the parts that are there, without repeats."""
    parts = [F.when(F.col(c).isNotNull(), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for c, names in ALGORITHMS if c in report.columns]
    return F.array_distinct(F.concat(*parts))


def envelope(report: DataFrame) -> DataFrame:
    """(file_id, json): a versioned document for each file."""
    scale = F.create_map(*[F.lit(x) for p in CONFIDENCE_SCALE.items() for x in p])
    doc = F.struct(F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(REPORT_TYPE).alias("reportType"), algorithms(report).alias("algorithms"), scale.alias("confidenceScale"), F.array(*map(F.lit, LIMITATIONS)).alias("globalLimitations"), F.struct(*report.columns).alias("report"))
    return report.select("file_id", F.to_json(doc, {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def _lines(rows: DataFrame, shown: Column, name: str, most: int | None = None) -> DataFrame:
    """(file_id, name): one line for each row of a child table, in order, at most ``most``."""
    packed = F.array_sort(F.collect_list(F.struct("ord", shown.alias("line"))))
    packed = F.slice(packed, 1, most) if most else packed
    return rows.groupBy("file_id").agg(F.array_join(F.transform(packed, lambda x: x["line"]), "\n").alias(name))


def to_text(tables: dict[str, DataFrame]) -> DataFrame:
    """(file_id, text): twelve sections in fixed order, from the tables of a deep scan."""
    r = tables["report"]
    parts = {
        "t_fields": _lines(tables["fields"], F.concat(F.lit("["), "directory", F.lit("] "), "tag", F.lit(": "), F.coalesce("parsed", "raw", F.lit(""))), "t_fields"),
        "t_segments": _lines(tables["segments"], F.concat_ws(" ", F.col("offset").cast("string"), F.col("length").cast("string"), "type", "description"), "t_segments"),
        "t_hidden": _lines(tables["hidden"], F.concat_ws(" ", F.col("offset").cast("string"), "kind"), "t_hidden", 100),
        "t_signs": _lines(tables["indicators"].withColumn("ord", F.col("stage") * 1000 + F.col("ord")), F.concat_ws(" ", "code", F.col("confidence").cast("string")), "t_signs"),
        "t_risks": _lines(tables["risks"].withColumn("ord", F.col("code")), F.concat_ws(": ", "code", "title"), "t_risks"),
    }
    if "entities" in tables:
        parts["t_entities"] = _lines(tables["entities"], F.concat_ws(" ", "kind", "value", "source"), "t_entities")
    for name, part in parts.items():
        r = r.join(part, "file_id", "left")
    fact = lambda *names: F.concat_ws("\n", *[F.concat(F.lit(f"{n.split('.')[-1]}: "), F.coalesce(F.col(n).cast("string"), F.lit("-"))) for n in names])
    field = lambda n: F.coalesce(F.col(n), F.lit("-")) if n in r.columns else F.lit("-")
    sections = [
        ("1. Overview", fact("name", "size_bytes", "detected_type")),
        ("2. Hashes", fact("sha256", "sha1", "md5", "crc32", "entropy")),
        ("3. Picture", fact("technical.width", "technical.height", "technical.orientation", "technical.compression")),
        ("4. Metadata", field("t_fields")),
        ("5. Place", fact("metadata.gps.latitude", "metadata.gps.longitude", "metadata.gps.timestamp")),
        ("6. Structure", field("t_segments")),
        ("7. Hidden data", field("t_hidden")),
        ("8. Perceptual hashes", fact("measures.a_hash", "measures.d_hash", "measures.p_hash")),
        ("9. Indicators", field("t_signs")),
        ("10. Text and codes", field("t_entities")),
        ("11. Privacy", field("t_risks")),
        ("12. Limitations", F.lit("\n".join(LIMITATIONS))),
    ]
    text = F.concat_ws("\n\n", *[F.concat(F.lit(title + "\n"), body) for title, body in sections])
    return r.select("file_id", text.alias("text"))


def comparison_json(compared: DataFrame, diff: DataFrame) -> DataFrame:
    """(left_id, right_id, json) with the differences of metadata."""
    rows = diff.groupBy("left_id", "right_id").agg(F.array_sort(F.collect_list(F.struct("directory", "tag", "left_value", "right_value"))).alias("metadata_difference_rows"))
    both = compared.join(rows, ["left_id", "right_id"], "left")
    return both.select("left_id", "right_id", F.to_json(F.struct(*both.columns), {"pretty": "true"}).alias("json"))


def comparison_text(compared: DataFrame, diff: DataFrame, most: int = 250) -> DataFrame:
    """(left_id, right_id, text), with at most ``most`` differences of metadata shown."""
    row = F.concat(F.lit("["), "directory", F.lit("] "), "tag", F.lit(": "), F.coalesce("left_value", F.lit("-")), F.lit(" | "), F.coalesce("right_value", F.lit("-")))
    lines = diff.groupBy("left_id", "right_id").agg(F.array_join(F.slice(F.array_sort(F.collect_list(row)), 1, most), "\n").alias("lines"))
    both = compared.join(lines, ["left_id", "right_id"], "left")
    codes = F.array_join(F.transform("indicators", lambda i: i["code"]), "\n")
    text = F.concat_ws("\n\n", F.concat(F.lit("Relation: "), "relation"), F.concat(F.lit("pHash similarity: "), F.format_number("p_hash_similarity", 4)), F.concat(F.lit("Indicators\n"), codes), F.concat(F.lit("Metadata\n"), F.coalesce("lines", F.lit("-"))))
    return both.select("left_id", "right_id", text.alias("text"))


def search_report(text: str, query: str) -> list[str]:
    """Lines of a report that contain a query, without regard to case; all for a blank one."""
    return [x for x in text.split("\n") if query.strip().lower() in x.lower()]


def pdf(text: str, width: int = 595, height: int = 842, margin: int = 36, size: int = 9) -> bytes:
    """A4 pages of a text in a standard font. Only Latin-1 letters can be shown: others need a font with a shaper, which is not part of
    this package, and appear as question marks."""
    per_line, per_page = int((width - 2 * margin) / (size * 0.6)), int((height - 2 * margin) / (size * 1.3))
    lines = [part for line in text.split("\n") for part in ([line[i : i + per_line] for i in range(0, len(line), per_line)] or [""])]
    pages = [lines[i : i + per_page] for i in range(0, len(lines), per_page)] or [[""]]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages))), len(pages)), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    for i, page in enumerate(pages):
        shown = b"".join(b"(%s) '\n" % line.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for line in page)
        body = zlib.compress(b"BT /F1 %d Tf %.1f TL %d %d Td\n%sET" % (size, size * 1.3, margin, height - margin, shown))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (width, height, 5 + 2 * i))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out) + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)


def to_pdf(texts: DataFrame) -> DataFrame:
    """(file_id, pdf) for (file_id, text)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pdf(x.as_py() or "") for x in batch.column(1)], pa.binary())], ["file_id", "pdf"])

    return texts.select("file_id", "text").mapInArrow(run, f"file_id {texts.schema['file_id'].dataType.simpleString()}, pdf binary")
