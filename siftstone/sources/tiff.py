"""Metadata of pictures as ordered fields: EXIF, GPS and thumbnail directories, JFIF, PNG text, XMP, IPTC, ICC, comments."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from .containers import PNG_MAGIC, jpeg_markers

# Names of tags by number, as metadata readers commonly show them.
IFD_TAGS = {
    0x0100: "Image Width", 0x0101: "Image Height", 0x0102: "Bits Per Sample", 0x0103: "Compression", 0x010E: "Image Description", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation",
    0x011A: "X Resolution", 0x011B: "Y Resolution", 0x0128: "Resolution Unit", 0x0131: "Software", 0x0132: "Date/Time", 0x013B: "Artist", 0x013C: "Host Computer", 0x0201: "Thumbnail Offset", 0x0202: "Thumbnail Length",
    0x0213: "YCbCr Positioning", 0x8298: "Copyright", 0x829A: "Exposure Time", 0x829D: "F-Number", 0x8822: "Exposure Program", 0x8827: "ISO Speed Ratings", 0x8830: "Sensitivity Type",
    0x9000: "Exif Version", 0x9003: "Date/Time Original", 0x9004: "Date/Time Digitized", 0x9010: "Offset Time", 0x9011: "Offset Time Original", 0x9012: "Offset Time Digitized",
    0x9201: "Shutter Speed Value", 0x9202: "Aperture Value", 0x9204: "Exposure Bias Value", 0x9205: "Max Aperture Value", 0x9207: "Metering Mode", 0x9208: "White Balance", 0x9209: "Flash", 0x920A: "Focal Length",
    0x927C: "Makernote", 0x9286: "User Comment", 0x9400: "Camera Temperature", 0x9C9B: "XP Title", 0x9C9C: "XP Comment", 0x9C9D: "XP Author", 0x9C9E: "XP Keywords", 0x9C9F: "XP Subject",
    0xA001: "Color Space", 0xA002: "Exif Image Width", 0xA003: "Exif Image Height", 0xA402: "Exposure Mode", 0xA403: "White Balance Mode", 0xA404: "Digital Zoom Ratio", 0xA405: "Focal Length 35",
    0xA430: "Owner Name", 0xA431: "Body Serial Number", 0xA432: "Lens Specification", 0xA433: "Lens Make", 0xA434: "Lens Model", 0xA435: "Lens Serial Number",
}
GPS_TAGS = {
    0: "GPS Version ID", 1: "GPS Latitude Ref", 2: "GPS Latitude", 3: "GPS Longitude Ref", 4: "GPS Longitude", 5: "GPS Altitude Ref", 6: "GPS Altitude", 7: "GPS Time-Stamp", 12: "GPS Speed Ref", 13: "GPS Speed",
    14: "GPS Track Ref", 15: "GPS Track", 16: "GPS Img Direction Ref", 17: "GPS Img Direction", 18: "GPS Map Datum", 23: "GPS Dest Bearing Ref", 24: "GPS Dest Bearing", 29: "GPS Date Stamp",
}
IPTC_TAGS = {(2, 5): "Object Name", (2, 25): "Keywords", (2, 55): "Date Created", (2, 80): "By-line", (2, 90): "City", (2, 101): "Country/Primary Location Name", (2, 105): "Headline", (2, 116): "Copyright Notice", (2, 120): "Caption/Abstract"}
ORIENTATION_TEXTS = ["Top, left side (Horizontal / normal)", "Top, right side (Mirror horizontal)", "Bottom, right side (Rotate 180)", "Bottom, left side (Mirror vertical)", "Left side, top (Mirror horizontal and rotate 270 CW)", "Right side, top (Rotate 90 CW)", "Right side, bottom (Mirror horizontal and rotate 90 CW)", "Left side, bottom (Rotate 270 CW)"]
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
DIRECTORIES = {0x8769: "Exif SubIFD", 0x8825: "GPS", 0xA005: "Interoperability"}
MOST_FIELDS, MOST_CHARS = 5000, 4096


@dataclass
class Field:
    directory: str
    tag: str
    raw: str | None
    parsed: str | None


@dataclass
class Gps:
    latitude: float
    longitude: float
    altitude: float | None = None
    speed: float | None = None
    direction: float | None = None
    timestamp: str | None = None


class Tiff:
    """A TIFF block: byte order and bounds-checked reads."""

    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if self.order is None or len(data) < 8 or struct.unpack_from(self.order + "H", data, 2)[0] != 42:
            raise ValueError("This is no TIFF block.")
        self.first = struct.unpack_from(self.order + "I", data, 4)[0]

    def entries(self, at: int):
        """((tag, kind, count, where) of a directory, offset of the next directory)."""
        if at <= 0 or at + 2 > len(self.data):
            return [], 0
        n = struct.unpack_from(self.order + "H", self.data, at)[0]
        out = []
        for i in range(n):
            p = at + 2 + 12 * i
            if p + 12 > len(self.data):
                return out, 0
            tag, kind, count = struct.unpack_from(self.order + "HHI", self.data, p)
            size = SIZES.get(kind, 0) * count
            where = p + 8 if size <= 4 else struct.unpack_from(self.order + "I", self.data, p + 8)[0]
            if size and where + size <= len(self.data):
                out.append((tag, kind, count, where))
        p = at + 2 + 12 * n
        return out, struct.unpack_from(self.order + "I", self.data, p)[0] if p + 4 <= len(self.data) else 0

    def value(self, kind: int, count: int, at: int):
        """Text, bytes, or a list of numbers (rationals as pairs)."""
        raw = self.data[at : at + SIZES[kind] * count]
        if kind == 2:
            return raw.split(b"\0")[0].decode("utf-8", "replace").strip()
        if kind in (1, 6, 7) and count > 4:
            return raw
        code = {1: "B", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}[kind]
        flat = struct.unpack(self.order + code * min(count, 256), raw[: SIZES[kind] * min(count, 256)])
        return list(zip(flat[::2], flat[1::2])) if kind in (5, 10) else list(flat)


def number(x) -> float:
    if isinstance(x, tuple):
        return x[0] / x[1] if x[1] else 0.0
    return float(x)


def _plain(x) -> str:
    if isinstance(x, tuple):
        return f"{x[0]}/{x[1]}"
    return str(x)


def _short(x: float) -> str:
    return f"{x:.6f}".rstrip("0").rstrip(".")


def degrees(parts) -> float:
    d = [number(x) for x in parts] + [0.0, 0.0]
    return d[0] + d[1] / 60 + d[2] / 3600


def describe(name: str, value) -> str:
    """How a value is shown."""
    if isinstance(value, str):
        return value
    if isinstance(value, bytes):
        if name.startswith("XP "):
            return value.decode("utf-16-le", "replace").rstrip("\0")
        if name == "User Comment":
            return value[8:].decode("utf-8", "replace").strip("\0 ") if value[:5] in (b"ASCII", b"UNICO", b"\0\0\0\0\0") else value.decode("latin-1").strip("\0 ")
        return f"[{len(value)} values]"
    if name == "Orientation" and value and 1 <= value[0] <= 8:
        return ORIENTATION_TEXTS[value[0] - 1]
    if name in ("GPS Latitude", "GPS Longitude") and len(value) >= 3:
        d, m, s = (number(x) for x in value[:3])
        return f"{_short(d)}° {_short(m)}' {_short(s)}\""
    if name == "GPS Time-Stamp" and len(value) >= 3:
        h, m, s = (number(x) for x in value[:3])
        return f"{int(h):02d}:{int(m):02d}:{s:06.3f} UTC"
    if name == "Exif Image Width" or name == "Exif Image Height":
        return f"{value[0]} pixels"
    return " ".join(_short(number(x)) for x in value)


def read_tiff(data: bytes) -> tuple[list[Field], dict]:
    """Fields of all directories, and the GPS values by tag number."""
    t = Tiff(data)
    fields, gps, seen, queue = [], {}, set(), [(t.first, "Exif IFD0")]
    while queue and len(fields) < MOST_FIELDS:
        at, name = queue.pop(0)
        if at in seen:
            continue
        seen.add(at)
        entries, following = t.entries(at)
        inner = []
        for tag, kind, count, where in entries:
            value = t.value(kind, count, where)
            if tag in DIRECTORIES and isinstance(value, list):
                inner.append((int(value[0]), DIRECTORIES[tag]))
                continue
            names = GPS_TAGS if name == "GPS" else IFD_TAGS
            label = names.get(tag, f"Unknown tag (0x{tag:04x})")
            raw = value if isinstance(value, str) else value[:64].hex() if isinstance(value, bytes) else " ".join(map(_plain, value))
            fields.append(Field(name, label, raw[:MOST_CHARS], describe(label, value)[:MOST_CHARS]))
            if name == "GPS":
                gps[tag] = value
        queue = inner + queue
        if following and name == "Exif IFD0":
            queue.append((following, "Exif Thumbnail"))
    return fields, gps


def orientation_of(data: bytes) -> int:
    """1 to 8, or 0 if it isn't recorded."""
    try:
        t = Tiff(data)
        for tag, kind, count, where in t.entries(t.first)[0]:
            if tag == 0x0112 and isinstance(v := t.value(kind, count, where), list):
                return int(v[0])
    except (ValueError, struct.error):
        pass
    return 0


def read_iptc(data: bytes) -> list[Field]:
    """Datasets of an IPTC block or of a Photoshop resource block that has one."""
    at, out = data.find(b"\x1c\x01") if b"\x1c\x02" not in data else min(i for i in (data.find(b"\x1c\x02"), data.find(b"\x1c\x01")) if i >= 0), []
    while 0 <= at and at + 5 <= len(data) and data[at] == 0x1C and len(out) < MOST_FIELDS:
        record, number_, size = data[at + 1], data[at + 2], int.from_bytes(data[at + 3 : at + 5], "big")
        if size > 0x7FFF or at + 5 + size > len(data):
            break
        text = data[at + 5 : at + 5 + size].decode("utf-8", "replace")[:MOST_CHARS]
        out.append(Field("IPTC", IPTC_TAGS.get((record, number_), f"Unknown tag ({record}:{number_})"), text, text))
        at += 5 + size
    return out


def read_icc(data: bytes) -> list[Field]:
    if len(data) < 128:
        return []
    rows = [("Profile Size", str(int.from_bytes(data[:4], "big"))), ("CMM Type", data[4:8].decode("latin-1").strip("\0 ")), ("Version", f"{data[8]}.{data[9] >> 4}.{data[9] & 15}"), ("Class", data[12:16].decode("latin-1")), ("Color space", data[16:20].decode("latin-1")), ("Profile Connection Space", data[20:24].decode("latin-1"))]
    return [Field("ICC Profile", k, v, v) for k, v in rows]


def _xmp(data: bytes) -> list[Field]:
    import re

    text = data.decode("utf-8", "replace")
    out = [Field("XMP", "XMP Value Count", str(len(re.findall(r"[\w:]+=\"", text))), None)]
    for name in ("CreatorTool", "CreateDate", "ModifyDate", "MetadataDate"):
        if m := re.search(rf"xmp:{name}(?:=\"([^\"]*)\"|>([^<]*)<)", text):
            shown = m.group(1) or m.group(2)
            out.append(Field("XMP", {"CreatorTool": "Creator Tool", "CreateDate": "Create Date", "ModifyDate": "Modify Date", "MetadataDate": "Metadata Date"}[name], shown, shown))
    return out


def _png_fields(data: bytes) -> tuple[list[Field], dict]:
    fields, gps, at = [], {}, 8
    while at + 8 <= len(data):
        size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR" and len(body) >= 13:
            w, h = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            fields += [Field("PNG-IHDR", "Image Width", str(w), str(w)), Field("PNG-IHDR", "Image Height", str(h), str(h)), Field("PNG-IHDR", "Bits Per Sample", str(body[8]), str(body[8])), Field("PNG-IHDR", "Color Type", str(body[9]), str(body[9]))]
        elif name == b"tEXt" and b"\0" in body:
            k, v = body.split(b"\0", 1)
            text = f"{k.decode('latin-1')}: {v.decode('latin-1')}"[:MOST_CHARS]
            fields.append(Field("PNG-tEXt", "Textual Data", text, text))
        elif name in (b"zTXt", b"iTXt") and b"\0" in body:
            k, v = body.split(b"\0", 1)
            try:
                if name == b"zTXt":
                    shown = zlib.decompressobj().decompress(v[1:], MOST_CHARS).decode("latin-1")
                else:
                    packed, rest = v[0], v[2:].split(b"\0", 2)[-1]
                    shown = (zlib.decompressobj().decompress(rest, MOST_CHARS) if packed else rest).decode("utf-8", "replace")
            except (zlib.error, IndexError):
                shown = ""
            if k == b"XML:com.adobe.xmp":
                fields += _xmp(shown.encode())
            text = f"{k.decode('latin-1')}: {shown}"[:MOST_CHARS]
            fields.append(Field(f"PNG-{name.decode()}", "Textual Data", text, text))
        elif name == b"eXIf":
            more, gps = read_tiff(body)
            fields += more
        elif name == b"iCCP" and b"\0" in body:
            try:
                fields += read_icc(zlib.decompressobj().decompress(body.split(b"\0", 1)[1][1:], 1 << 20))
            except zlib.error:
                pass
        elif name == b"IEND":
            break
        at += 12 + size
    return fields, gps


def _jpeg_fields(data: bytes) -> tuple[list[Field], dict]:
    fields, gps = [], {}
    for _, marker, body in jpeg_markers(data):
        if body is None:
            continue
        if marker == 0xE0 and body[:5] == b"JFIF\0" and len(body) >= 14:
            rows = [("Version", f"{body[5]}.{body[6]}"), ("Resolution Units", str(body[7])), ("X Resolution", str(int.from_bytes(body[8:10], "big"))), ("Y Resolution", str(int.from_bytes(body[10:12], "big"))), ("Thumbnail Width Pixels", str(body[12])), ("Thumbnail Height Pixels", str(body[13]))]
            fields += [Field("JFIF", k, v, v) for k, v in rows]
        elif marker == 0xE1 and body[:6] == b"Exif\0\0":
            more, found = read_tiff(body[6:])
            fields, gps = fields + more, gps or found
        elif marker == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/"):
            fields += _xmp(body.split(b"\0", 1)[-1])
        elif marker == 0xE2 and body[:12] == b"ICC_PROFILE\0" and len(body) > 14 and body[12] == 1:
            fields += read_icc(body[14:])
        elif marker == 0xED and body.startswith(b"Photoshop 3.0"):
            fields += read_iptc(body)
        elif marker == 0xFE:
            text = body.decode("utf-8", "replace")[:MOST_CHARS]
            fields.append(Field("JpegComment", "JPEG Comment", text, text))
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 6:
            rows = [("Data Precision", f"{body[0]} bits"), ("Image Height", f"{int.from_bytes(body[1:3], 'big')} pixels"), ("Image Width", f"{int.from_bytes(body[3:5], 'big')} pixels"), ("Number of Components", str(body[5]))]
            fields += [Field("JPEG", k, v.split()[0], v) for k, v in rows]
    return fields, gps


def _webp_fields(data: bytes) -> tuple[list[Field], dict]:
    fields, gps, at = [], {}, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if name == b"EXIF":
            more, gps = read_tiff(body[6:] if body[:6] == b"Exif\0\0" else body)
            fields += more
        elif name == b"XMP ":
            fields += _xmp(body)
        elif name == b"ICCP":
            fields += read_icc(body)
        at += 8 + size + size % 2
    return fields, gps


def _gps(values: dict, fields: list[Field]) -> Gps | None:
    import re

    try:
        lat, lon = degrees(values[2]), degrees(values[4])
    except (KeyError, TypeError):
        return None
    lat = -lat if str(values.get(1, "N")).upper().startswith("S") else lat
    lon = -lon if str(values.get(3, "E")).upper().startswith("W") else lon
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):
        return None

    def find(*tags: str) -> str | None:
        low = [t.lower() for t in tags]
        f = next((f for f in fields if f.tag.lower() in low), None)
        return None if f is None else f.raw if f.parsed is None else f.parsed

    def decimal(*tags: str) -> float | None:
        m = re.search(r"[-+]?\d+(?:[.,]\d+)?", find(*tags) or "")
        return float(m.group().replace(",", ".")) if m else None

    when = " ".join(t for t in (find("GPS Date Stamp"), find("GPS Time-Stamp")) if t and t.strip())
    return Gps(lat, lon, decimal("GPS Altitude"), decimal("GPS Speed"), decimal("GPS Img Direction", "GPS Track", "GPS Dest Bearing"), when or None)


def inspect(data: bytes) -> tuple[list[Field], Gps | None, list[str]]:
    """Fields in order, GPS if it is complete and in range, and errors. What can't be read gives no fields and one error."""
    try:
        if data.startswith(b"\xff\xd8"):
            fields, gps = _jpeg_fields(data)
        elif data.startswith(PNG_MAGIC):
            fields, gps = _png_fields(data)
        elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            fields, gps = _webp_fields(data)
        elif data[:2] in (b"II", b"MM"):
            fields, gps = read_tiff(data)
        else:
            return [], None, ["No metadata reader for this type of file."]
    except (ValueError, struct.error, IndexError, KeyError) as e:
        return [], None, [f"Metadata can't be read: {e}"]
    return fields, _gps(gps, fields), []
