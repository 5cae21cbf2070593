"""Scans, rules, comparison, reports, copies, history and the inbox on made-up files."""

import json

import pytest
from pyspark.sql import functions as F

from siftstone.functions import bytesops as B
from siftstone.functions import pixels
from siftstone.operators import batch, compare, duplicates, entities, identity, logs, metadata, reports, rules, scan, visual
from siftstone.sources import files as S
from siftstone.streaming import inbox

from . import pictures as P


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("pictures")
    whole = P.pattern(160, 120)
    made = {"a.png": P.png(whole), "b.png": P.png(whole), "c.png": P.png(pixels.resize(whole, 80, 60)), "d.png": P.png(P.pattern(90, 90, 5), b"hello"), "e.jpg": P.jpeg(tiff=P.exif(thumbnail=True), appended=b"PK\x03\x04\xde\xad\xbe\xef"), "f.jpg": P.png(P.pattern(40, 40, 9)), "g.png": P.huge_header(), "h.jpg": bytes.fromhex("ffd8ffe100204578696600004949"), "i.png": b""}
    for name, data in made.items():
        (d / name).write_bytes(data)
    return str(d)


def test_identity_vectors(spark):
    rows = [(1, "x.bin", b"123456789"), (2, "p.jpg", b"\x89PNG\r\n\x1a\n\1\2\3\4"), (3, "v.heic", b"\0\0\0\x18ftypisom"), (4, "empty.png", b""), (5, "h.HEIC", b"\0\0\0\x18ftypheic"), (6, "none", None)]
    out = {r["file_id"]: r for r in identity.identity(spark.createDataFrame(rows, "file_id int, name string, content binary")).collect()}
    assert out[1]["crc32"] == "cbf43926" and abs(out[1]["entropy"] - 3.169925) < 1e-6
    assert (out[2]["detected_type"], out[2]["extension_mismatch"], len(out[2]["sha256"])) == ("PNG", True, 64)
    assert (out[3]["detected_type"], out[3]["detected_mime"], out[3]["extension_mismatch"]) == ("ISO-BMFF", "application/octet-stream", False)
    assert out[4]["error"] and out[4]["sha256"] is None and out[6]["error"]
    assert (out[5]["detected_type"], out[5]["extension_mismatch"]) == ("HEIF/HEIC", False)


def test_deep_and_batch_scan(spark, folder):
    files = S.read(spark, folder)
    tables = scan.deep_scan(files)
    report = {r["name"]: r for r in tables["report"].collect()}
    assert len(report) == 8  # the binaryFile source leaves out empty files
    assert report["e.jpg"]["metadata"]["gps"]["latitude"] > 32.88 and report["e.jpg"]["container"]["trailing_bytes"] == 8
    assert report["g.png"]["technical"]["width"] == 100_000 and report["g.png"]["measures"]["error"]
    codes = {(r["file_id"].split("/")[-1], r["code"]) for r in tables["risks"].collect()}
    assert {("e.jpg", "privacy.gps"), ("e.jpg", "privacy.trailing"), ("e.jpg", "privacy.thumbnail"), ("d.png", "privacy.comments")} <= codes
    signs = {(r["file_id"].split("/")[-1], r["code"]) for r in tables["indicators"].collect()}
    assert {("f.jpg", "file.extension_mismatch"), ("e.jpg", "container.trailing_bytes"), ("e.jpg", "pixels.skipped")} <= signs
    rows = {r["file_name"]: r for r in scan.batch_scan(files).collect()}
    assert rows["b.png"]["duplicate_of"] == "a.png" and rows["a.png"]["duplicate_of"] is None
    assert rows["h.jpg"]["error"] and rows["c.png"]["aspect_ratio"] == pytest.approx(4 / 3)
    texts = {r["file_id"].split("/")[-1]: r["text"] for r in reports.to_text(tables).collect()}
    assert all(f"{i}. " in texts["e.jpg"] for i in range(1, 13)) and "TestCam" in texts["e.jpg"]
    doc = json.loads(reports.envelope(tables["report"]).where(F.col("file_id").endswith("e.jpg")).first()["json"])
    assert doc["schemaVersion"] == "1.0" and doc["report"]["name"] == "e.jpg" and "SHA-256" in doc["algorithms"]
    made = reports.to_pdf(reports.to_text(tables)).first()["pdf"]
    assert bytes(made).startswith(b"%PDF") and b"%%EOF" in bytes(made)[-8:]
    assert scan.quick_scan(files).where("name = 'a.png'").first()["technical"]["width"] == 160
    assert {n: scan.section(tables, n).count() > 0 for n in scan.SECTIONS} == {n: n != "OCR" for n in scan.SECTIONS}
    assert scan.section(tables, "Structure", 3).count() == 3
    assert scan.barcodes(files).count() == 0 and not scan.ocr(files).first()["succeeded"]


def test_pictures_that_spark_decodes(spark, folder):
    rows = {r["file_id"].split("/")[-1]: r for r in S.measure_decoded(S.decoded_by_spark(spark, folder)).collect()}
    own = pixels.perceptual_hashes(P.pattern(160, 120))
    assert (rows["a.png"]["a_hash"], rows["a.png"]["d_hash"], rows["a.png"]["p_hash"]) == own and "g.png" not in rows


def test_compare(spark, folder):
    files = S.read(spark, folder)
    names = {r["name"]: r["file_id"] for r in files.select("name", "file_id").collect()}
    pairs = spark.createDataFrame([(names["a.png"], names["b.png"]), (names["a.png"], names["c.png"]), (names["a.png"], names["d.png"])], "left_id string, right_id string")
    out, diff = compare.compare(pairs, files)
    by = {r["right_id"].split("/")[-1]: r for r in out.collect()}
    codes = lambda n: {i["code"] for i in by[n]["indicators"]}
    assert by["b.png"]["exact"] and by["b.png"]["p_hash_similarity"] == 1 and by["b.png"]["pixels"]["rgb_similarity"] == 1
    assert by["b.png"]["relation"] == "Identical files" and "compare.exact_hash" in codes("b.png")
    assert not by["c.png"]["exact"] and "compare.uniform_resize_candidate" in codes("c.png")
    assert "compare.metadata_difference" in codes("d.png") and diff.count() > 0
    assert "relation" in reports.comparison_json(out, diff).first()["json"] and "Relation" in reports.comparison_text(out, diff).first()["text"]
    for kind in visual.TWO:
        assert bytes(visual.visualize_pair(pairs.limit(1), files, kind).first()["png"]).startswith(b"\x89PNG")


def test_renderings_and_clean_copies(spark, folder):
    files = S.read(spark, folder)
    for kind in ("ela", "bit_plane", "red", "entropy_map", "histogram", "plane_g_3", "diagnostic_ela"):
        png = visual.visualize(files.where("name = 'a.png'"), kind).first()["png"]
        assert bytes(png).startswith(b"\x89PNG") and pixels.read_png(bytes(png)).size
    out = {r["clean_name"]: r for r in visual.clean_copies(files).collect()}
    assert out["d-clean.png"]["passed"] and b"tEXt" not in bytes(out["d-clean.png"]["content"])
    assert (pixels.read_png(bytes(out["a-clean.png"]["content"])) == P.pattern(160, 120)).all()
    assert out["e-clean.png"]["error"] and not out["e-clean.png"]["passed"]
    assert visual.manifest(files.where("name = 'a.png'")).first()["value"].endswith("  a.png")


FIELDS = "file_id int, ord int, directory string, tag string, raw string, parsed string"


def privacy(spark, fields, segments=(), trailing=0):
    seg = spark.createDataFrame(list(segments), "file_id int, type string, description string")
    box = spark.createDataFrame([(1, trailing)], "file_id int, trailing_bytes long")
    return {r["code"] for r in rules.privacy_risks(spark.createDataFrame(fields, FIELDS), seg, box).collect()}


def test_privacy_rules(spark):
    rows = [("GPS", "GPS Latitude"), ("Exif IFD0", "Model"), ("Exif SubIFD", "Body Serial Number"), ("Exif IFD0", "Artist"), ("Exif SubIFD", "Date/Time Original"), ("Exif IFD0", "Software"), ("Exif Thumbnail", "Thumbnail Offset"), ("XMP", "Creator Tool"), ("IPTC", "Object Name"), ("Exif SubIFD", "Exposure Time")]
    fields = [(1, i, d, t, "42", None) for i, (d, t) in enumerate(rows)]
    assert privacy(spark, fields, [(1, "COM", "Comment")], 42) == set(rules.SENSITIVE)
    assert privacy(spark, [(1, 0, "Exif", "Exposure Time", "1/60", None)]) == set()
    assert privacy(spark, [(1, 0, "JFIF", "Thumbnail Width", "0", None)]) == set()
    assert privacy(spark, [(1, 0, "Exif", "GPS Latitude Ref", "N", None)]) == {"privacy.gps"}
    assert privacy(spark, []) == set()


def test_consistency_rules(spark):
    def codes(fields, width=100, height=100, mismatch=False, trailing=0, warnings=()):
        ident = spark.createDataFrame([(1, mismatch, "PNG", ".jpg")], "file_id int, extension_mismatch boolean, detected_type string, extension string")
        tech = spark.createDataFrame([(1, width, height, "TopLeft")], "file_id int, width int, height int, orientation string")
        box = spark.createDataFrame([(1, trailing, list(warnings))], "file_id int, trailing_bytes long, warnings array<string>")
        rows = spark.createDataFrame([(1, i, *f, None) for i, f in enumerate(fields)], FIELDS)
        return {r["code"]: r["confidence_name"] for r in rules.consistency(ident, tech, rows, box).collect()}

    assert codes([("A", "Make", "Canon"), ("B", "Make", "Nikon")]) == {"metadata.make_conflict": "Likely"}
    assert codes([("A", "Make", "Canon"), ("B", "make", "CANON")]) == {}
    assert codes([("A", "Exif Image Width", "4000 pixels"), ("A", "Exif Image Height", "3000")], 2000, 1500) == {"metadata.dimension_mismatch": "Likely"}
    assert codes([("A", "Date/Time Original", "2024:05:02 10:00:00"), ("A", "Date/Time", "2024:05:01 10:00:00")]) == {"metadata.time_modified_before_original": "Possible"}
    assert codes([], 10000, 100) == {"image.extreme_aspect_ratio": "Confirmed"}
    assert codes([], 2, 2, True, 3, ["w"]) == {"file.extension_mismatch": "Confirmed", "container.trailing_bytes": "Confirmed", "container.structure_warning": "Likely", "image.extreme_small_dimension": "Confirmed"}
    assert codes([("A", "Orientation", "Right side, top (Rotate 90 CW)")]) == {"metadata.orientation_mismatch": "Likely"}
    assert codes([("Exif Thumbnail", "Thumbnail Width", "160"), ("Exif Thumbnail", "Thumbnail Height", "90"), ("A", "Software", "x")]) == {"metadata.thumbnail_aspect_mismatch": "Possible", "metadata.software_present": "Confirmed"}


def test_entities(spark):
    def found(text, fmt=None):
        rows = spark.createDataFrame([(1, text, "Barcode" if fmt else "OCR", fmt)], "file_id int, text string, source string, format string")
        return {(r["kind"], r["value"]) for r in entities.text_entities(rows, barcode_format="format").collect()}

    assert found("See https://example.org/a?b=1, mail me@example.org or +218 91 234 5678.") == {("URL", "https://example.org/a?b=1"), ("Email", "me@example.org"), ("Phone", "+218 91 234 5678")}
    assert ("QR URL", "https://example.org/") in found("https://example.org", "QR_CODE")
    assert not any(k.endswith("URL") for k, _ in found("WIFI:S:home;T:WPA;P:secret;;", "QR_CODE"))
    assert found("12345") == set() and found("www.Example.org/x)") == {("URL", "https://www.example.org/x") if False else ("URL", "https://www.example.org/x")}
    assert found("ME@example.org me@EXAMPLE.org") == {("Email", "ME@example.org")}


def test_near_duplicates_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(25)]
    rows = []
    for i in range(200):
        h = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, 4)):
            h ^= 1 << b
        rows.append((i, f"n{i}", h - (1 << 64) if h >> 63 else h))
    want = {}
    for i, _, h in rows:
        best = min(((((h ^ g) & (2**64 - 1)).bit_count(), j) for j, _, g in rows[:i] if ((h ^ g) & (2**64 - 1)).bit_count() <= 3), default=None)
        want[i] = f"n{best[1]}" if best else None
    frame = spark.createDataFrame(rows, "ord int, name string, p_hash long")
    assert {r["ord"]: r["near_duplicate_of"] for r in duplicates.near_duplicates(frame).collect()} == want
    linked = {(r["order_a"], r["order_b"]) for r in duplicates.similar_pairs(frame).collect()}
    first = {r["ord"]: r["first"] for r in duplicates.first_of_hash(frame).collect()}
    assert set(first) == set(range(200)) and all(a < b and first[a] == a and first[b] == b for a, b in linked)
    pairs = {(i, j) for i in first for j in first if i < j and (first[i] == first[j] or (min(first[i], first[j]), max(first[i], first[j])) in linked)}
    assert pairs == {(i, j) for i, _, h in rows for j, _, g in rows if i < j and ((h ^ g) & (2**64 - 1)).bit_count() <= 3}


def test_small_expressions(spark):
    row = spark.range(1).select(B.hash_similarity(F.lit(0), F.lit(0)).alias("a"), B.hash_similarity(F.lit(0), F.lit(-1)).alias("b"), B.lookup_url(F.lit("zz")).alias("c"), B.lookup_url(F.lit("A" * 64)).alias("d"), B.hash_from_hex(F.lit("f" * 16)).alias("e"), B.hash_to_hex(F.lit(-1).cast("long")).alias("f"), metadata.first_decimal(F.lit("about -3,5 m")).alias("g")).first()
    assert row["a"] == 1 and row["b"] == 0 and row["c"] is None and row["d"].endswith("a" * 64) and row["e"] == -1 and row["f"] == "f" * 16 and row["g"] == -3.5


def test_csv_and_views(spark):
    rows = spark.createDataFrame([(0, 'a "q",b.png', "x", 1.5, True, None), (1, "b", None, 2.0, False, "bad")], "ord int, file_name string, sha256 string, aspect_ratio double, has_gps boolean, error string")
    assert [r[0] for r in rows.orderBy("ord").select(batch.csv_line(rows)).collect()] == ['"a ""q"",b.png","x",1.500000,True,""', '"b","",2.000000,False,"bad"']
    assert batch.view(rows, "errors").count() == 1 and batch.view(rows, "gps").count() == 1 and batch.view(rows, "all").count() == 2


def test_log_and_history(spark, tmp_path):
    events = spark.createDataFrame([("scan.completed unsafe/name", {"FilePath": "/x", "gps": "1", "count": "3", "": "z"}), ("///", {})], "event string, data map<string,string>")
    out = logs.sanitize(events).collect()
    assert out[0]["event"] == "scan.completedunsafename" and out[0]["data"] == {"count": "3"} and out[1]["event"] == "event"
    logs.write_log(events, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2
    h = logs.History(spark, str(tmp_path / "history"))
    row = lambda i: spark.sql(f"select timestamp_seconds({i}) scanned_at, 'f{i}' file_name, 'PNG' detected_type, 1L size_bytes, 'x' sha256, true deep, 0 indicator_count, 0 privacy_risk_count")
    assert h.recent().count() == 0
    h.add(row(2))
    h.add(row(1))
    h.add(row(3), private=True)
    assert [r["file_name"] for r in h.recent().collect()] == ["f1", "f2"] and h.recent(0).count() == 1
    h.compact()
    assert h.recent().count() == 2
    h.clear()
    assert h.recent().count() == 0


def test_inbox(spark, folder, tmp_path):
    stream = inbox.first_seen(inbox.incoming(spark, folder).where("error is null"))
    inbox.start(stream, str(tmp_path / "out"), str(tmp_path / "mark"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("sha256").distinct().count() == 7


def test_incremental(spark):
    files = spark.createDataFrame([("a", 1, "2024"), ("b", 2, "2024")], "file_id string, size_bytes long, modified string")
    done = files.where("file_id = 'a'").select(scan.scan_key("deep").alias("key"))
    assert [r["file_id"] for r in scan.unseen(files, done).collect()] == ["b"]
    assert scan.unseen(files, done, "quick").count() == 2


def test_queries_and_oracles_have_the_same_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "exact_duplicates" in e.queries()


def test_files_that_were_left_out_are_not_empty(spark):
    rows = spark.createDataFrame([("a", "a.png", 10, bytearray(b"x" * 10)), ("b", "b.png", 99, None), ("c", "c.png", 0, None), ("d", "d.png", 0, bytearray())], "file_id string, name string, size_bytes long, content binary")
    got = {r["file_id"]: (r["size_bytes"], r["error"]) for r in identity.identity(rows, max_bytes=50).collect()}
    assert got == {"a": (10, None), "b": (99, "The file is larger than the limit."), "c": (0, "The file is empty."), "d": (0, "The file is empty.")}


def test_byte_statistics_equal_plain_counts(spark):
    import math
    import random
    from collections import Counter

    from siftstone.functions import bytestats

    rng, old = random.Random(4), bytestats.PIECE
    h = lambda counts, n: -sum(c / n * math.log2(c / n) for c in counts if c)
    try:
        for piece in (old, 7):
            bytestats.PIECE = piece
            for n in (1, 2, 6, 7, 8, 100, 1000):
                data = bytes(rng.choice(b"abc\xff\x00") for _ in range(n))
                s = bytestats.statistics(data)
                assert abs(s["entropy"] - h(Counter(data).values(), n)) < 1e-9 and s["n_bytes"] == n
                assert all(abs(s["planes"][k] - h([sum(b >> k & 1 for b in data), sum(1 - (b >> k & 1) for b in data)], n)) < 1e-9 for k in range(8))
                assert s["transition_rate"] == (sum((a ^ b) & 1 for a, b in zip(data, data[1:])) / (n - 1) if n > 1 else 0.0)
                blocks = [(b, e, m) for part in bytestats.block_entropies(data, 3) for b, e, m in zip(*part)]
                assert [(b, m) for b, _, m in blocks] == [(i // 3, len(data[i : i + 3])) for i in range(0, n, 3)]
                assert all(abs(e - h(Counter(data[3 * b : 3 * b + 3]).values(), m)) < 1e-9 for b, e, m in blocks)
    finally:
        bytestats.PIECE = old


def test_scans_end_in_time(spark):
    assert scan.within(spark, lambda: spark.range(5).count(), 60) == 5
    sleepy = spark.range(0, 4, 1, 4).mapInArrow(_slow, "id long")
    with pytest.raises(TimeoutError):
        scan.within(spark, sleepy.count, 1)
    with pytest.raises(ZeroDivisionError):
        scan.within(spark, lambda: 1 / 0, 60)
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None and spark.range(3).count() == 3


def _slow(batches):
    import time

    for batch in batches:
        time.sleep(20)
        yield batch
