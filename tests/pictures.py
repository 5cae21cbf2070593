"""Pictures and files made for the tests; none is kept in the repository."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from siftstone.functions.pixels import write_png


def chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def pattern(w: int = 160, h: int = 120, seed: int = 0) -> np.ndarray:
    """A smooth picture with squares, RGBA."""
    y, x = np.mgrid[:h, :w]
    rng = np.random.default_rng(seed)
    waves = 60 * np.sin(6.0 * x / w + seed) * np.cos(4.0 * y / h) + 40 * np.sin(9.0 * y / h + x / w)
    a = np.stack([x * 120 // w + 60 + waves, y * 90 // h + 70 + waves, ((x // 16 + y // 16) % 2) * 40 + 80 + waves], axis=-1) + rng.integers(0, 3, (h, w, 3))
    return np.concatenate([np.clip(a, 0, 255), np.full((h, w, 1), 255)], axis=-1).astype(np.uint8)


def png(p: np.ndarray | None = None, text: bytes | None = None) -> bytes:
    data = write_png((pattern() if p is None else p)[..., :3])
    if text is not None:
        data = data[:-12] + chunk(b"tEXt", b"Comment\0" + text) + data[-12:]
    return data


def huge_header() -> bytes:
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 100_000, 100_000, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")


def _ifd(entries: list[tuple], at: int, following: int = 0) -> tuple[bytes, int]:
    """A little-endian directory at ``at``; entries are (tag, type, count, bytes)."""
    head, tail, place = struct.pack("<H", len(entries)), b"", at + 2 + 12 * len(entries) + 4
    for tag, kind, count, raw in entries:
        if len(raw) <= 4:
            head += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
        else:
            head += struct.pack("<HHII", tag, kind, count, place + len(tail))
            tail += raw + b"\0" * (len(raw) % 2)
    return head + struct.pack("<I", following) + tail, place + len(tail)


def exif(make: str = "TestCam", model: str = "Model1", gps: bool = True, thumbnail: bool = False, extra: list[tuple] = ()) -> bytes:
    """A TIFF block with a camera, a GPS place and a thumbnail directory."""
    text = lambda tag, s: (tag, 2, len(s) + 1, s.encode() + b"\0")
    rational = lambda tag, *v: (tag, 5, len(v), b"".join(struct.pack("<II", a, 1) for a in v))
    first = [text(0x010F, make), text(0x0110, model), *extra]
    probe, after = _ifd([*first, (0x8825, 4, 1, b"\0" * 4)] if gps else first, 8)
    place, thumb = after, 0
    gps_block = b""
    if gps:
        gps_block, place = _ifd([text(1, "N"), rational(2, 32, 53, 0), text(3, "E"), rational(4, 13, 11, 0)], after)
        first = [*first, (0x8825, 4, 1, struct.pack("<I", after))]
    thumb_block = b""
    if thumbnail:
        thumb = place
        thumb_block, place = _ifd([(0x0201, 4, 1, struct.pack("<I", 100)), (0x0202, 4, 1, struct.pack("<I", 50))], thumb)
    block, _ = _ifd(first, 8, thumb)
    return b"II*\0" + struct.pack("<I", 8) + block + gps_block + thumb_block


def jpeg(w: int = 160, h: int = 120, tiff: bytes | None = None, appended: bytes = b"", quality_table: bytes | None = None) -> bytes:
    """The segments of a JPEG; its scan is made up, so it can be parsed but not decoded."""
    segment = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\x01" + struct.pack(">HH", 72, 72) + b"\0\0")
    if tiff:
        out += segment(0xE1, b"Exif\0\0" + tiff)
    out += segment(0xDB, b"\0" + (quality_table or bytes(range(1, 65))))
    out += segment(0xC0, b"\x08" + struct.pack(">HH", h, w) + b"\x03\x01\x22\0\x02\x11\x01\x03\x11\x01")
    out += segment(0xDA, b"\x03\x01\0\x02\x11\x03\x11\0\x3f\0") + b"\x12\x34\xff\x00\x56" * 20 + b"\xff\xd9"
    return out + appended
