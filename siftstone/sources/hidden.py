"""Locators inside a file: embedded signatures, printable runs, dense regions, and what follows the picture.

Findings are places to look at, never proof. Their order and caps follow blocks of 128 KiB: in each block signatures by
kind and place, then WebP headers, then printable runs that end there, then a dense block. After a block with the cap reached
nothing more is looked for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

from .containers import primary_end

# Kinds of embedded content by their first bytes.
SIGNATURES = [
    ("ZIP archive", b"PK\x03\x04"),
    ("ZIP empty archive", b"PK\x05\x06"),
    ("7-Zip archive", b"7z\xbc\xaf\x27\x1c"),
    ("RAR archive", b"Rar!\x1a\x07"),
    ("PDF document", b"%PDF-"),
    ("Windows PE/MZ", b"MZ"),
    ("ELF executable", b"\x7fELF"),
    ("GZip stream", b"\x1f\x8b\x08"),
    ("SQLite database", b"SQLite format 3\x00"),
    ("OLE/CFB compound file", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"),
    ("PNG image", b"\x89PNG\r\n\x1a\n"),
    ("JPEG image", b"\xff\xd8\xff"),
    ("GIF image", b"GIF8"),
    ("WebP RIFF", b"RIFF"),
]
BLOCK, CAP, RUNS_CAP, DENSE_CAP = 128 << 10, 200, 32, 16
RUN_LEAST, RUN_STORED, DENSE_BYTES, DENSE_BITS = 20, 160, 4096, 7.90
UNKNOWN, POSSIBLE, CONFIRMED = 0, 1, 3
_RUN = re.compile(rb"[\x20-\x7e]{%d,}" % RUN_LEAST)


@dataclass
class Finding:
    offset: int
    kind: str
    evidence: str
    confidence: int
    limitation: str


def entropy(data: bytes) -> float:
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    p = counts[counts > 0] / max(1, len(data))
    return float(-(p * np.log2(p)).sum())


def _places(data: bytes, magic: bytes):
    at = data.find(magic, 1)
    while at >= 0:
        yield at
        at = data.find(magic, at + 1)


def inspect(data: bytes) -> list[Finding]:
    """Findings of one file, at most ``CAP``."""
    last = max(0, (len(data) - 1) // BLOCK)
    by_block: list[list[tuple]] = [[] for _ in range(last + 1)]
    for rank, (kind, magic) in enumerate(SIGNATURES):
        for at in _places(data, magic):
            by_block[(at + len(magic) - 1) // BLOCK].append((0, rank, at, kind, None))
    for at in _places(data, b"RIFF"):
        if data[at + 8 : at + 12] == b"WEBP":
            by_block[(at + 11) // BLOCK].append((1, 0, at, "WebP image", None))
    for m in _RUN.finditer(data):
        by_block[min(last, m.end() // BLOCK)].append((2, 0, m.start(), "Printable string", m))
    out: list[Finding] = []
    runs = dense = 0
    for b in range(last + 1):
        for step, _, at, kind, run in sorted(by_block[b], key=lambda x: x[:3]):
            if len(out) >= CAP:
                break
            if step < 2:
                out.append(Finding(at, kind, f"The bytes at offset {at} begin like a {kind}.", POSSIBLE, "Such bytes also occur by chance inside compressed data; nothing is extracted or run."))
            elif runs < RUNS_CAP:
                runs += 1
                out.append(Finding(at, kind, run.group()[:RUN_STORED].decode("ascii"), UNKNOWN, "Readable text is normal in metadata and many formats."))
        block = data[b * BLOCK : (b + 1) * BLOCK]
        if len(block) >= DENSE_BYTES and dense < DENSE_CAP and len(out) < CAP and (h := entropy(block)) >= DENSE_BITS:
            dense += 1
            out.append(Finding(b * BLOCK, "High entropy region", f"{len(block)} bytes at offset {b * BLOCK} have {h:.4f} bits a byte.", UNKNOWN, "Compressed pictures are dense by nature; this is a place to look at."))
        if len(out) >= CAP:
            break
    end = primary_end(data)
    if end is not None and end < len(data) and len(out) < CAP:
        out.append(Finding(end, "Trailing payload region", f"{len(data) - end} byte(s) follow the end of the picture.", CONFIRMED, "They may be harmless; what they are for is not known."))
    return out[:CAP]
