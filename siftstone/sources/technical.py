"""Size, depth, resolution and palette of a picture from its header, without decoding pixels."""

from __future__ import annotations

from dataclasses import dataclass

from .containers import PNG_MAGIC, color_table, jpeg_markers, sub_blocks
from .tiff import orientation_of


@dataclass
class Technical:
    width: int = 0
    height: int = 0
    format: str = "Unknown"
    channels: int = 0
    has_alpha: bool = False
    frames: int = 1
    orientation: str = "TopLeft"
    bit_depth: int | None = None
    dpi_x: float | None = None
    dpi_y: float | None = None
    palette_entries: int | None = None
    palette_info: str | None = None
    compression: str = "Unknown"
    error: str | None = None

    @property
    def aspect(self) -> float:
        return self.width / self.height if self.height else 0.0

    @property
    def bits_per_pixel(self) -> int:
        return 32 if self.channels != 1 else 8


# Compression by type.
COMPRESSION = {"JPEG": "DCT (lossy JPEG)", "PNG": "DEFLATE (lossless)", "GIF": "LZW (lossless)", "WebP": "VP8/VP8L (lossy or lossless)", "BMP": "None or RLE"}
ORIENTATIONS = ["TopLeft", "TopRight", "BottomRight", "BottomLeft", "LeftTop", "RightTop", "RightBottom", "LeftBottom"]


def _u16(d: bytes, at: int, order: str = "little") -> int:
    return int.from_bytes(d[at : at + 2], order)


def _u32(d: bytes, at: int, order: str = "little") -> int:
    return int.from_bytes(d[at : at + 4], order)


def _jpeg(d: bytes) -> Technical:
    t = Technical(format="JPEG")
    for _, marker, body in jpeg_markers(d):
        if body is None:
            continue
        if marker == 0xE0 and body[:5] == b"JFIF\x00" and len(body) >= 12:
            unit, x, y = body[7], _u16(body, 8, "big"), _u16(body, 10, "big")
            if unit in (1, 2) and x and y:
                scale = 2.54 if unit == 2 else 1.0
                t.dpi_x, t.dpi_y = x * scale, y * scale
        elif marker == 0xE1 and body[:6] == b"Exif\x00\x00":
            o = orientation_of(body[6:])
            if 1 <= o <= 8:
                t.orientation = ORIENTATIONS[o - 1]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 6:
            t.bit_depth, t.height, t.width, t.channels = body[0], _u16(body, 1, "big"), _u16(body, 3, "big"), body[5]
    return t


def _png(d: bytes) -> Technical:
    t, at, frames = Technical(format="PNG"), 8, 1
    while at + 8 <= len(d):
        size, name, body = _u32(d, at, "big"), d[at + 4 : at + 8], d[at + 8 : at + 8 + min(_u32(d, at, "big"), 1 << 16)]
        if name == b"IHDR" and len(body) >= 13:
            t.width, t.height, t.bit_depth = _u32(body, 0, "big"), _u32(body, 4, "big"), body[8]
            t.channels = {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}.get(body[9], 0)
            t.has_alpha = body[9] in (4, 6)
        elif name == b"pHYs" and len(body) >= 9 and body[8] == 1:
            t.dpi_x, t.dpi_y = _u32(body, 0, "big") * 0.0254, _u32(body, 4, "big") * 0.0254
        elif name == b"PLTE":
            t.palette_entries = size // 3
        elif name == b"tRNS":
            t.has_alpha = True
        elif name == b"acTL" and len(body) >= 4:
            frames = max(1, _u32(body, 0, "big"))
        elif name == b"IEND":
            break
        at += 12 + size
    t.frames = frames
    return t


def _gif(d: bytes) -> Technical:
    t = Technical(format="GIF", width=_u16(d, 6), height=_u16(d, 8), channels=3, bit_depth=8)
    packed = d[10] if len(d) > 10 else 0
    if packed & 0x80:
        t.palette_entries = 2 << (packed & 7)
    else:
        t.palette_info = "No global color table"
    at, frames = 13 + color_table(packed), 0
    try:
        while at < len(d) and d[at] != 0x3B:
            if d[at] == 0x2C:
                frames += 1
                at, _, _ = sub_blocks(d, at + 11 + color_table(d[at + 9]))
            elif d[at] == 0x21:
                t.has_alpha |= d[at + 1] == 0xF9 and bool(d[at + 3] & 1)
                at, _, _ = sub_blocks(d, at + 2)
            else:
                break
    except (EOFError, IndexError):
        pass
    t.frames = max(1, frames)
    return t


def _bmp(d: bytes) -> Technical:
    t = Technical(format="BMP", width=_u32(d, 18), height=abs(int.from_bytes(d[22:26], "little", signed=True)), bit_depth=_u16(d, 28))
    x, y = _u32(d, 38), _u32(d, 42)
    if x and y:
        t.dpi_x, t.dpi_y = x * 0.0254, y * 0.0254
    t.channels, t.has_alpha = (4, True) if t.bit_depth == 32 else (3, False)
    if 0 < t.bit_depth <= 8:
        t.palette_entries = 1 << t.bit_depth
    return t


def _webp(d: bytes) -> Technical:
    t = Technical(format="WebP", bit_depth=8, channels=3)
    at = 12
    while at + 8 <= len(d):
        name, size, body = d[at : at + 4], _u32(d, at + 4), d[at + 8 : at + 24]
        if name == b"VP8X" and len(body) >= 10:
            t.has_alpha = bool(body[0] & 0x10)
            t.width, t.height = 1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little")
        elif name == b"VP8 " and len(body) >= 10 and not t.width:
            t.width, t.height = _u16(body, 6) & 0x3FFF, _u16(body, 8) & 0x3FFF
        elif name == b"VP8L" and len(body) >= 5 and not t.width:
            bits = _u32(body, 1)
            t.width, t.height, t.has_alpha = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), bool(bits >> 28 & 1)
        elif name == b"ANMF":
            t.frames += 1
        at += 8 + size + size % 2
    t.frames = max(1, t.frames - 1) if t.frames > 1 else 1
    t.channels = 4 if t.has_alpha else 3
    return t


def inspect(d: bytes) -> Technical:
    """The header's facts; ``error`` where there is no picture of a known type or no size in it."""
    if d.startswith(b"\xff\xd8"):
        t = _jpeg(d)
    elif d.startswith(PNG_MAGIC):
        t = _png(d)
    elif d[:6] in (b"GIF87a", b"GIF89a"):
        t = _gif(d)
    elif d[:2] == b"BM" and len(d) >= 54:
        t = _bmp(d)
    elif d[:4] == b"RIFF" and d[8:12] == b"WEBP":
        t = _webp(d)
    else:
        return Technical(error="This type of picture has no header reader.")
    t.compression = COMPRESSION.get(t.format, "Unknown")
    if t.width <= 0 or t.height <= 0:
        t.error = "The header has no size."
    return t
