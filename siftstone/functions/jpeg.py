"""A decoder for sequential JPEG pictures (8 bits, Huffman coding, gray or three components, any sampling, restarts).

Entropy decoding walks the bits once; everything after it (scaling, inverse transform, upsampling, colours) is numpy over all blocks.
Progressive, lossless, arithmetic and four-component files raise ValueError, as do files that are cut off.
"""

from __future__ import annotations

import math
from array import array
from dataclasses import dataclass, field

import numpy as np


def _zigzag() -> np.ndarray:
    """Natural place of each coefficient in the order of coding: along the anti-diagonals, turning at every edge."""
    cells = sorted(((x + y, (y if (x + y) % 2 else x), y * 8 + x) for y in range(8) for x in range(8)))
    return np.array([place for _, _, place in cells])


ZIGZAG = _zigzag()
_BASIS = np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * math.pi / 16) * np.where(np.arange(8) == 0, math.sqrt(1 / 8), 0.5)[:, None]


@dataclass
class Part:
    """One component of the frame."""

    number: int
    across: int
    down: int
    table: int
    wide: int = 0
    high: int = 0
    stride: int = 0
    values: array = field(default_factory=lambda: array("h"))


def _lookup(lengths: bytes, symbols: bytes) -> list[int]:
    """For every 16 bits: length of the code they start with times 256, and its symbol; 0 where there is none."""
    out, code, at = [0] * 65536, 0, 0
    for n in range(1, 17):
        for _ in range(lengths[n - 1]):
            first = code << (16 - n)
            if at >= len(symbols) or first + (1 << (16 - n)) > 65536:
                raise ValueError("A Huffman table of the JPEG is not valid.")
            out[first : first + (1 << (16 - n))] = [n << 8 | symbols[at]] * (1 << (16 - n))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _scan(data: bytes, at: int, parts: list[Part], tables: list[tuple], whole: tuple[int, int], interval: int) -> int:
    """Decode one scan into the values of its parts; where the next marker is."""
    alone = len(parts) == 1
    across, down = (parts[0].wide, parts[0].high) if alone else whole
    plan = [(p, dc, ac, 1 if alone else p.across, 1 if alone else p.down) for p, (dc, ac) in zip(parts, tables)]
    bits = held = 0
    last, left, size, spare = [0] * len(parts), interval, len(data), 0
    for unit in range(across * down):
        if interval and left == 0:
            bits = held = spare = 0
            while at + 1 < size and not (data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7):
                at += 1
            at, left, last = at + 2, interval, [0] * len(parts)
        left -= 1
        ux, uy = unit % across, unit // across
        for n, (p, dc, ac, h, v) in enumerate(plan):
            values, stride = p.values, p.stride
            for j in range(v):
                for i in range(h):
                    base = ((uy * v + j) * stride + ux * h + i) * 64
                    k, table = 0, dc
                    while k < 64:
                        while held < 32:
                            if at < size:
                                byte = data[at]
                                if byte == 0xFF:
                                    if at + 1 < size and data[at + 1] == 0:
                                        at += 2
                                    else:
                                        byte = 0  # at a marker: zeros behind the last code
                                        spare += 1
                                        if spare > 16:
                                            raise ValueError("The JPEG is cut off.")
                                else:
                                    at += 1
                            else:
                                raise ValueError("The JPEG is cut off.")
                            bits, held = (bits << 8 | byte) & 0xFFFFFFFFFF, held + 8
                        found = table[bits >> (held - 16) & 0xFFFF]
                        if not found:
                            raise ValueError("The JPEG has a code that its tables lack.")
                        held -= found >> 8
                        symbol = found & 255
                        if k:
                            k += symbol >> 4
                            symbol &= 15
                            if not symbol:
                                if found & 255 == 0xF0:
                                    k += 1
                                    continue
                                break
                        if symbol:
                            held -= symbol
                            value = bits >> held & ((1 << symbol) - 1)
                            if value < 1 << (symbol - 1):
                                value -= (1 << symbol) - 1
                        else:
                            value = 0
                        if k == 0:
                            last[n] = value = last[n] + value
                            table = ac
                        if k > 63:
                            raise ValueError("The JPEG has too many values in a block.")
                        values[base + k] = max(-32768, min(32767, value))
                        k += 1
    while at + 1 < size and not (data[at] == 0xFF and data[at + 1] not in (0, 0xFF) and not 0xD0 <= data[at + 1] <= 0xD7):
        at += 1
    return at


def read_jpeg(data: bytes, most_pixels: int = 60_000_000) -> np.ndarray:
    """RGBA of a sequential JPEG. The size is checked before anything is decoded."""
    at, quant, huffman, parts, interval, plain, done = 2, {}, {}, [], 0, False, 0
    width = height = 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("The JPEG is cut off or broken.")
        marker = data[at + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD8 or marker == 1:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        n = data[at + 2] << 8 | data[at + 3]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if len(body) < n - 2:
            raise ValueError("The JPEG is cut off.")
        try:
            if marker == 0xDB:
                while body:
                    wide = 1 + (body[0] >> 4)
                    quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide == 2 else np.uint8, 64, 1).astype(np.float64)
                    body = body[1 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    count = sum(body[1:17])
                    huffman[body[0]] = _lookup(body[1:17], body[17 : 17 + count])
                    body = body[17 + count :]
            elif marker == 0xDD:
                interval = body[0] << 8 | body[1]
            elif marker == 0xEE and body[:5] == b"Adobe":
                plain = body[11] == 0
            elif marker in (0xC0, 0xC1):
                height, width, count = body[1] << 8 | body[2], body[3] << 8 | body[4], body[5]
                if body[0] != 8 or count not in (1, 3) or not width or not height:
                    raise ValueError("This kind of JPEG has no decoder here.")
                if width * height > most_pixels:
                    raise ValueError("The picture has more pixels than the limit.")
                parts = [Part(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
                if any(not 1 <= x <= 4 for p in parts for x in (p.across, p.down)):
                    raise ValueError("The JPEG's sampling is not valid.")
                most_h, most_v = max(p.across for p in parts), max(p.down for p in parts)
                whole = -(-width // (8 * most_h)), -(-height // (8 * most_v))
                for p in parts:
                    p.wide, p.high = -(-width * p.across // (8 * most_h)), -(-height * p.down // (8 * most_v))
                    p.stride = whole[0] * p.across
                    p.values = array("h", bytes(128 * p.stride * whole[1] * p.down))
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("This kind of JPEG has no decoder here.")
            elif marker == 0xDA:
                by, chosen, tables = {p.number: p for p in parts}, [], []
                for i in range(body[0]):
                    chosen.append(by[body[1 + 2 * i]])
                    tables.append((huffman[body[2 + 2 * i] >> 4], huffman[16 | body[2 + 2 * i] & 15]))
                at = _scan(data, at, chosen, tables, whole, interval)
                done += len(chosen)
        except (IndexError, KeyError) as e:
            raise ValueError("The JPEG is broken.") from e
    if not parts or done < len(parts):
        raise ValueError("The JPEG has no pixels.")
    planes = []
    for p in parts:
        if p.table not in quant:
            raise ValueError("The JPEG lacks a quantisation table.")
        coded = np.frombuffer(p.values, np.int16).reshape(-1, 64)
        blocks = np.empty(coded.shape)
        blocks[:, ZIGZAG] = coded * quant[p.table]
        shown = np.clip(np.rint(_BASIS.T @ blocks.reshape(-1, 8, 8) @ _BASIS + 128), 0, 255)
        plane = shown.reshape(-1, p.stride, 8, 8).swapaxes(1, 2).reshape(-1, p.stride * 8)
        planes.append(np.repeat(np.repeat(plane, most_v // p.down, axis=0), most_h // p.across, axis=1)[:height, :width])
    if any(x.shape != (height, width) for x in planes):
        raise ValueError("This kind of JPEG has no decoder here.")
    if len(planes) == 1:
        rgb = np.repeat(planes[0][..., None], 3, axis=-1)
    elif plain:
        rgb = np.stack(planes, axis=-1)
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        rgb = np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)), 0, 255)
    return np.concatenate([rgb.astype(np.uint8), np.full((height, width, 1), 255, np.uint8)], axis=-1)
