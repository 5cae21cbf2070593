"""Structure of JPEG, PNG, WebP and GIF files: segments, what follows the end, warnings.

Plain functions over bytes, to be run inside Arrow batches; see ``siftstone.sources.files``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

# Names of markers and chunks.
JPEG_NAMES = {0xD8: "SOI", 0xD9: "EOI", 0xDA: "SOS", 0xDB: "DQT", 0xC4: "DHT", 0xFE: "COM", 0xC0: "SOF0", 0xC1: "SOF1", 0xC2: "SOF2"}
JPEG_TEXTS = {0xDA: "Start Of Scan", 0xDB: "Define Quantization Table", 0xC4: "Define Huffman Table", 0xFE: "Comment", 0xC0: "Start Of Frame", 0xC1: "Start Of Frame", 0xC2: "Start Of Frame"}
PNG_TEXTS = {"IHDR": "Image header", "IDAT": "Image data", "IEND": "Image end", "PLTE": "Palette", "pHYs": "Physical pixel dimensions / pixel density", "tEXt": "Text metadata", "zTXt": "Compressed text metadata", "iTXt": "International text metadata", "eXIf": "EXIF metadata", "iCCP": "ICC color profile"}
PNG_KNOWN = {"IHDR", "PLTE", "IDAT", "IEND", "tEXt", "zTXt", "iTXt", "eXIf", "iCCP", "pHYs", "gAMA", "cHRM", "sRGB", "bKGD", "tIME", "sBIT", "hIST", "tRNS", "sPLT"}
WEBP_TEXTS = {"VP8 ": "Lossy VP8 image payload", "VP8L": "Lossless VP8L image payload", "VP8X": "Extended WebP header", "ALPH": "Alpha data", "ANIM": "Animation parameters", "ANMF": "Animation frame", "EXIF": "EXIF metadata", "XMP ": "XMP metadata", "ICCP": "ICC color profile"}
GIF_EXTENSIONS = {0xF9: ("GRAPHIC-CONTROL", "Graphic Control Extension"), 0xFE: ("COMMENT", "Comment Extension"), 0xFF: ("APPLICATION", "Application Extension"), 0x01: ("PLAIN-TEXT", "Plain Text Extension")}
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
TRAILING_KINDS = [("JPEG", b"\xff\xd8\xff"), ("PNG", PNG_MAGIC), ("ZIP", b"PK\x03\x04"), ("PDF", b"%PDF"), ("GIF", b"GIF87a"), ("GIF", b"GIF89a")]
SEGMENT_CAP = 128 << 20


@dataclass
class Segment:
    offset: int
    length: int
    type: str
    description: str
    suspicious: bool = False


@dataclass
class Container:
    format: str
    segments: list[Segment] = field(default_factory=list)
    trailing: int = 0
    warnings: list[str] = field(default_factory=list)
    error: str | None = None

    def add(self, *row) -> None:
        self.segments.append(Segment(*row))

    def finish(self, data: bytes, end: int, what: str) -> "Container":
        """Note what stands after ``end``."""
        self.trailing = max(0, len(data) - end)
        if self.trailing:
            kind = next((k for k, magic in TRAILING_KINDS if data.startswith(magic, end)), None)
            self.warnings.append(f"{self.trailing} byte(s) after {what}" + (f"; they begin like a {kind} file." if kind else "."))
        return self


def jpeg_name(marker: int) -> str:
    if 0xE0 <= marker <= 0xEF:
        return f"APP{marker - 0xE0}"
    if 0xD0 <= marker <= 0xD7:
        return f"RST{marker - 0xD0}"
    return JPEG_NAMES.get(marker, f"FF{marker:02X}")


def jpeg_markers(data: bytes, at: int = 2) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, marker, payload) up to the start of the first scan; payload is None for markers without one. A payload
    shorter than its length says is given as far as it goes."""
    while at + 1 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        start = at
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            return
        marker, at = data[at], at + 1
        if marker == 0:
            continue
        if marker == 0xD9 or marker in (0x01, 0xD8) or 0xD0 <= marker <= 0xD7:
            yield at - 2 if at - start > 2 else start, marker, None
            if marker == 0xD9:
                return
            continue
        size = int.from_bytes(data[at : at + 2], "big")
        yield at - 2 if at - start > 2 else start, marker, data[at + 2 : at + max(2, size)]
        if size < 2 or marker == 0xDA:
            return
        at += size


def walk_jpeg(data: bytes) -> Container:
    out = Container("JPEG")
    out.add(0, 2, "SOI", "Start Of Image")
    end = 2
    for at, marker, payload in jpeg_markers(data):
        if marker == 0xD9:
            out.add(at, 2, "EOI", "End Of Image")
            return out.finish(data, at + 2, "JPEG EOI")
        if payload is None:
            out.add(at, 2, jpeg_name(marker), "Standalone JPEG marker")
            end = at + 2
            continue
        if len(data) < at + 4:
            out.warnings.append(f"The length of a JPEG segment at offset {at} is cut off.")
            return out
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2:
            out.warnings.append(f"A JPEG segment at offset {at} has the impossible length {size}.")
            return out
        out.add(at, size + 2, jpeg_name(marker), "Application-specific segment" if 0xE0 <= marker <= 0xEF else JPEG_TEXTS.get(marker, "JPEG segment"))
        end = at + 2 + size
        if end > len(data):
            out.error = "A JPEG segment goes on beyond the end of the file."
            return out
        if marker == 0xDA:
            eoi = data.find(b"\xff\xd9", end)
            if eoi < 0:
                out.warnings.append("JPEG scan reached EOF without an EOI marker.")
                return out
            out.add(end, eoi - end, "SCAN-DATA", "Entropy-coded image data")
            out.add(eoi, 2, "EOI", "End Of Image")
            return out.finish(data, eoi + 2, "JPEG EOI")
    out.warnings.append("JPEG ended without an EOI marker.")
    return out


def fourcc(raw: bytes) -> tuple[str, bool]:
    """Text and whether it is four printable ASCII characters."""
    return raw.decode("latin-1"), len(raw) == 4 and all(0x20 <= b <= 0x7E for b in raw)


def walk_png(data: bytes) -> Container:
    out, at = Container("PNG"), 8
    while at < len(data):
        if at + 8 > len(data):
            out.warnings.append(f"A PNG chunk header at offset {at} is cut off.")
            return out
        size = int.from_bytes(data[at : at + 4], "big")
        name, valid = fourcc(data[at + 4 : at + 8])
        if size > SEGMENT_CAP:
            out.warnings.append(f"The PNG chunk {name} at offset {at} is larger than the limit.")
            return out
        if at + 12 + size > len(data):
            out.warnings.append(f"The PNG chunk {name} at offset {at} is cut off.")
            return out
        out.add(at, 12 + size, name, PNG_TEXTS.get(name, "PNG chunk"), not valid or (name[:1].isupper() and name not in PNG_KNOWN))
        at += 12 + size
        if name == "IEND":
            return out.finish(data, at, "PNG IEND")
    out.warnings.append("PNG ended without an IEND chunk.")
    return out


def walk_webp(data: bytes) -> Container:
    out = Container("WebP")
    declared = 8 + int.from_bytes(data[4:8], "little")
    out.add(0, 12, "RIFF/WEBP", f"RIFF WebP header; declared size={declared}")
    end, at = min(len(data), max(12, declared)), 12
    while at + 8 <= end:
        name, valid = fourcc(data[at : at + 4])
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        padded = size + size % 2
        if size > SEGMENT_CAP:
            out.warnings.append(f"The WebP chunk {name} at offset {at} is larger than the limit.")
            break
        if at + 8 + padded > end:
            out.warnings.append(f"The WebP chunk {name} at offset {at} is cut off.")
            break
        out.add(at, 8 + padded, name, WEBP_TEXTS.get(name, "WebP RIFF chunk"), not valid)
        at += 8 + padded
    if declared > len(data):
        out.warnings.append("WebP declares more bytes than the file has.")
    return out.finish(data, min(len(data), declared), "the declared WebP size")


def sub_blocks(data: bytes, at: int, keep: int = 0) -> tuple[int, int, bytes]:
    """Where the sub-blocks from ``at`` end, how many bytes they hold, and the first ``keep`` of these."""
    total, held = 0, bytearray()
    while True:
        if at >= len(data):
            raise EOFError("GIF sub-blocks go on beyond the end of the file.")
        n = data[at]
        if n == 0:
            return at + 1, total, bytes(held[:keep])
        if at + 1 + n > len(data):
            raise EOFError("GIF sub-blocks go on beyond the end of the file.")
        if len(held) < keep:
            held += data[at + 1 : at + 1 + n]
        total, at = total + n, at + 1 + n


def color_table(packed: int) -> int:
    """Bytes of a colour table, 0 if there is none."""
    return 3 << (packed & 7) + 1 if packed & 0x80 else 0


def walk_gif(data: bytes) -> Container:
    out = Container("GIF")
    if len(data) < 13:
        out.error = "The GIF header is cut off."
        return out
    out.add(0, 6, "GIF-HEADER", data[:6].decode("latin-1"))
    out.add(6, 7, "LSD", "Logical Screen Descriptor")
    at, frames, loop, table = 13, 0, None, color_table(data[10])
    if at + table > len(data):
        out.warnings.append("GIF global color table is truncated.")
        return out
    if table:
        out.add(at, table, "GCT", f"Global Color Table ({table // 3} entries)")
        at += table
    try:
        while at < len(data):
            start, kind, at = at, data[at], at + 1
            if kind == 0x3B:
                out.add(start, 1, "TRAILER", "GIF trailer")
                out.finish(data, at, "GIF trailer")
                if loop is not None:
                    out.warnings.append("GIF loop metadata: " + ("infinite loop." if loop == 0 else f"{loop} repetition(s)."))
                return out
            if kind == 0x2C:
                if at + 9 > len(data):
                    out.warnings.append(f"Truncated GIF image descriptor at offset {start}.")
                    break
                table, at = color_table(data[at + 8]), at + 9
                if at + table > len(data):
                    out.warnings.append(f"Truncated GIF local color table for frame {frames + 1}.")
                    break
                at += table
                if at >= len(data):
                    out.warnings.append(f"Missing GIF LZW minimum code size for frame {frames + 1}.")
                    break
                at, total, _ = sub_blocks(data, at + 1)
                frames += 1
                out.add(start, at - start, "FRAME", f"GIF image frame {frames}; data bytes={total}")
            elif kind == 0x21:
                if at >= len(data):
                    out.warnings.append(f"Truncated GIF extension at offset {start}.")
                    break
                label = data[at]
                at, _, held = sub_blocks(data, at + 1, 16 << 10)
                name, text = GIF_EXTENSIONS.get(label, (f"EXT-{label:02X}", "GIF extension"))
                if label == 0xFF and len(held) >= 14 and held[:11] in (b"NETSCAPE2.0", b"ANIMEXTS1.0") and held[11] == 1:
                    loop = int.from_bytes(held[12:14], "little")
                    text += "; loop=" + ("infinite" if loop == 0 else str(loop))
                out.add(start, at - start, name, text, label not in GIF_EXTENSIONS)
            else:
                out.warnings.append(f"Unknown GIF block introducer 0x{kind:02X} at offset {start}.")
                break
    except EOFError as e:
        out.error = str(e)
        return out
    out.warnings.append("GIF ended without a trailer.")
    return out


def walk(data: bytes) -> Container:
    """The container of a file, by its first bytes."""
    if data.startswith(b"\xff\xd8"):
        return walk_jpeg(data)
    if data.startswith(PNG_MAGIC):
        return walk_png(data)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return walk_webp(data)
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return walk_gif(data)
    return Container("Unknown", warnings=["No structure is known for this type of file."])


def primary_end(data: bytes) -> int | None:
    """Where the picture itself ends, by a walker that knows stuffed bytes, restarts and several scans; None if unknown."""
    if data.startswith(b"\xff\xd8"):
        at = 2
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                return None
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
            elif marker == 0xD9:
                return at + 2
            elif marker in (0x00, 0x01, 0xD8) or 0xD0 <= marker <= 0xD7:
                at += 2
            else:
                size = int.from_bytes(data[at + 2 : at + 4], "big")
                if len(data) < at + 4 or size < 2 or at + 2 + size > len(data):
                    return None
                at += 2 + size
    if data.startswith(PNG_MAGIC):
        at = 8
        while at + 12 <= len(data):
            size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            at += 12 + size
            if at > len(data):
                return None
            if name == b"IEND":
                return at
        return None
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        end = 8 + int.from_bytes(data[4:8], "little")
        return end if end <= len(data) else None
    return None
