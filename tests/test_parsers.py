"""Readers of containers, headers, metadata and embedded content on hand-built bytes."""

import random

import numpy as np
import pytest

from siftstone.functions import pixels
from siftstone.sources import containers, hidden, technical, tiff

from . import pictures as P


def kinds(c):
    return [s.type for s in c.segments]


def test_jpeg_trailing_and_signature():
    c = containers.walk(b"\xff\xd8\xff\xd9abcd")
    assert (c.format, c.trailing, kinds(c)) == ("JPEG", 4, ["SOI", "EOI"])
    assert "ZIP" in containers.walk(b"\xff\xd8\xff\xd9PK\x03\x04").warnings[0]
    c = containers.walk(P.jpeg(appended=b"PK\x03\x04\xde\xad\xbe\xef"))
    assert c.trailing == 8 and kinds(c) == ["SOI", "APP0", "DQT", "SOF0", "SOS", "SCAN-DATA", "EOI"]


def test_jpeg_that_breaks_off():
    assert containers.walk(bytes.fromhex("ffd8ffe100204578696600004949")).error
    assert containers.walk(b"\xff\xd8\xff\xe0\x00\x01").warnings
    assert containers.walk(b"\xff\xd8").warnings


def test_png_webp_gif():
    c = containers.walk(P.png(text=b"hello"))
    assert kinds(c) == ["IHDR", "IDAT", "tEXt", "IEND"] and c.trailing == 0 and not any(s.suspicious for s in c.segments)
    assert kinds(containers.walk(b"\x89PNG\r\n\x1a\n" + P.chunk(b"IEND", b""))) == ["IEND"]
    assert containers.walk(b"\x89PNG\r\n\x1a\n" + P.chunk(b"ABCD", b"x") + P.chunk(b"IEND", b"")).segments[0].suspicious
    c = containers.walk(b"RIFF\x10\0\0\0WEBPXMP \x04\0\0\0abcd")
    assert kinds(c) == ["RIFF/WEBP", "XMP "] and c.trailing == 0
    head = b"GIF89a\x01\0\x01\0\0\0\0"
    assert kinds(containers.walk(head + b";")) == ["GIF-HEADER", "LSD", "TRAILER"]
    loop = b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"
    c = containers.walk(head + loop + b"\x2c" + b"\0" * 4 + b"\x01\0\x01\0\0" + b"\x02\x02\x4c\x01\0" + b"\x21\xfe\x03abc\0;zz")
    assert kinds(c) == ["GIF-HEADER", "LSD", "APPLICATION", "FRAME", "COMMENT", "TRAILER"] and c.trailing == 2 and any("infinite" in w for w in c.warnings)
    assert containers.walk(head + b"\x21\xfe\x09abc").error and containers.walk(b"nothing").format == "Unknown"


def test_hidden():
    found = hidden.inspect(b"hello" + b"PK\x03\x04")
    assert [(f.offset, f.kind) for f in found] == [(5, "ZIP archive")]
    run = b"This is a readable run of forty-five letters."
    assert len(run) == 45
    found = hidden.inspect(b"\0\1\2" + run + b"\0\3\4")
    assert [(f.kind, f.confidence, f.offset) for f in found] == [("Printable string", 0, 3)]
    found = hidden.inspect(b"\xff\xd8\xff\xd9" + b"\1\2\3\4\5\6")
    assert [(f.kind, f.offset, f.confidence) for f in found] == [("Trailing payload region", 4, 3)]
    rng = random.Random(42)
    found = hidden.inspect(bytes(rng.randrange(256) for _ in range(128 << 10)))
    assert sum(f.kind == "High entropy region" for f in found) == 1
    assert not any(f.kind == "JPEG image" for f in hidden.inspect(b"\xff\xd8\xff\xff\xd9"))
    assert len(hidden.inspect(b"x" + b"MZ" * 5000)) == 200
    assert len([f for f in hidden.inspect(b"\0" + (b"a" * 30 + b"\0") * 100)]) == 32


def test_technical():
    t = technical.inspect(P.jpeg(320, 200))
    assert (t.width, t.height, t.bit_depth, t.dpi_x, t.channels) == (320, 200, 8, 72.0, 3)
    t = technical.inspect(P.png(P.pattern(36, 64)))
    assert (t.width, t.height, t.format, t.bit_depth) == (36, 64, "PNG", 8)
    assert technical.inspect(P.huge_header()).width == 100_000
    assert technical.inspect(b"GIF89a\x02\0\x03\0\x81\0\0" + b"\0" * 12 + b";").palette_entries == 4
    assert technical.inspect(b"xx").error


def test_metadata():
    fields, gps, errors = tiff.inspect(P.jpeg(tiff=P.exif(thumbnail=True)))
    by = {(f.directory, f.tag): f.parsed for f in fields}
    assert by["Exif IFD0", "Make"] == "TestCam" and by["Exif IFD0", "Model"] == "Model1" and not errors
    assert 32.88 < gps.latitude < 32.89 and 13.18 < gps.longitude < 13.19
    assert ("Exif Thumbnail", "Thumbnail Offset") in by
    fields, _, _ = tiff.inspect(P.png(text=b"hello"))
    assert any(f.directory == "PNG-tEXt" and "hello" in f.parsed for f in fields)
    assert tiff.inspect(bytes.fromhex("ffd8ffe100204578696600004949"))[0] == []
    assert tiff.inspect(b"plain text")[2]


def test_no_parser_raises_on_noise():
    rng = random.Random(7)
    whole = [P.jpeg(tiff=P.exif(thumbnail=True)), P.png(text=b"x"), b"RIFF\x10\0\0\0WEBPXMP \x04\0\0\0abcd", b"GIF89a\x01\0\x01\0\x80\0\0" + b"\0" * 6 + b"\x21\xfe\x03abc\0;"]
    for _ in range(400):
        data = bytearray(rng.choice(whole))
        for _ in range(rng.randint(1, 8)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        data = bytes(data[: rng.randint(0, len(data))])
        containers.walk(data), hidden.inspect(data), technical.inspect(data), tiff.inspect(data)


def test_png_round_trip_and_caps():
    p = P.pattern(37, 23)
    assert (pixels.read_png(P.png(p)) == p).all()
    gray = np.arange(60, dtype=np.uint8).reshape(6, 10)
    assert (pixels.read_png(pixels.write_png(gray))[..., 1] == gray).all()
    assert (pixels.read_png(pixels.write_png(p)) == p).all()
    for bad in (P.huge_header(), b"\x89PNG\r\n\x1a\n", P.png()[:200]):
        with pytest.raises(ValueError):
            pixels.read_png(bad)
    a = P.pattern(16, 8)
    rows = a[..., :3].reshape(8, -1)
    up = np.concatenate([np.full((8, 1), 2, np.uint8), np.diff(np.vstack([np.zeros(48, np.uint8), rows]).astype(int), axis=0).astype(np.uint8)], axis=1)
    import struct
    import zlib

    data = b"\x89PNG\r\n\x1a\n" + P.chunk(b"IHDR", struct.pack(">IIBBBBB", 16, 8, 8, 2, 0, 0, 0)) + P.chunk(b"IDAT", zlib.compress(up.tobytes())) + P.chunk(b"IEND", b"")
    assert (pixels.read_png(data) == a).all()


def test_kernels():
    p = P.pattern(200, 150)
    assert pixels.perceptual_hashes(p) == pixels.perceptual_hashes(p.copy())
    half = pixels.resize(p, 100, 75)
    a, b = (int(pixels.perceptual_hashes(x)[2], 16) for x in (p, half))
    assert 1 - (a ^ b).bit_count() / 64 >= 0.84
    flat = np.full((64, 64, 4), 77, np.uint8)
    m = pixels.luma_metrics(flat)
    assert m["deviation"] < 1e-9 and m["edge_x"] == 0 and m["boundary_ratio"] == 1.0
    assert pixels.stego_metrics(flat)["plane_entropies"] == [0.0] * 8
    noise = np.random.default_rng(1).integers(0, 256, (128, 128, 4), dtype=np.uint8)
    s = pixels.stego_metrics(noise)
    assert abs(s["red_ones"] - 0.5) < 0.03 and s["plane_entropies"][0] > 0.99 and 0.45 < s["transition_rate"] < 0.55
    h = pixels.heuristics(p)
    assert h["periodicity"] >= 1.0 and 0 <= h["ela_mean"] < 0.1
    assert pixels.heuristics(p, phase_step=1)["periodicity"] < h["periodicity"] + 1e-9
    same = pixels.pair_metrics(p, p)
    assert same["mae"] == 0 and same["psnr"] is None and same["rgb_similarity"] == 1
    other = pixels.pair_metrics(p, noise)
    assert other["mae"] > 0 and 0 <= other["rgb_similarity"] <= 1
    assert pixels.jpeg_tables(P.jpeg(quality_table=bytes(pixels.LUMA_TABLE)))[0::2] == (50.0, "4:2:0")
    tile = P.pattern(64, 64, 3)
    tiled = np.concatenate([np.concatenate([tile] * 4, axis=1)] * 4)
    assert pixels.copied_tiles(pixels.luma(tiled)) > 0 and pixels.copied_tiles(pixels.luma(flat)) == 0
    for k in range(1, 9):
        assert pixels.oriented(p, k).shape[:2] == ((150, 200) if k < 5 else (200, 150))
    for name in ("ela_image", "entropy_map", "histogram_image"):
        assert getattr(pixels, name)(p).dtype == np.uint8
    assert pixels.contact_sheet(p, half).shape == (720, 1456, 3) and pixels.heat_image(p, half).max() <= 255
