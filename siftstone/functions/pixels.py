"""Numpy kernels over decoded pictures: hashes, statistics, heuristics, pair measures, renderings and a PNG codec.

A picture is an array (height, width, 4) of uint8 in RGBA order. Kernels are pure functions, run inside Arrow batches.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

from .jpeg import read_jpeg

WEIGHTS = np.array([0.2126, 0.7152, 0.0722])
# The standard luminance quantisation table, and the chrominance one, in natural order.
LUMA_TABLE = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
CHROMA_TABLE = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32


def luma(p: np.ndarray) -> np.ndarray:
    return p[..., :3].astype(np.float64) @ WEIGHTS


def preview(p: np.ndarray, side: int) -> np.ndarray:
    """Nearest-neighbour reduction to at most ``side`` pixels on the longer side."""
    h, w = p.shape[:2]
    if max(h, w) <= side:
        return p
    k = side / max(h, w)
    return resize(p, max(1, round(w * k)), max(1, round(h * k)))


def resize(p: np.ndarray, w: int, h: int) -> np.ndarray:
    """Nearest neighbour at cell centres."""
    ys = np.clip(((np.arange(h) + 0.5) * p.shape[0] / h).astype(int), 0, p.shape[0] - 1)
    xs = np.clip(((np.arange(w) + 0.5) * p.shape[1] / w).astype(int), 0, p.shape[1] - 1)
    return p[ys][:, xs]


def _bits(flags: np.ndarray) -> int:
    return int(sum(1 << i for i, b in enumerate(flags.ravel().tolist()) if b))


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos((2 * k[None, :] + 1) * k[:, None] * math.pi / (2 * n))


def perceptual_hashes(p: np.ndarray) -> tuple[str, str, str]:
    """Average, difference and DCT hash as 16 hex digits each, lowest bit first in row-major order."""
    p = preview(p, 512)
    small = luma(resize(p, 8, 8))
    a = small >= small.mean()
    wide = luma(resize(p, 9, 8))
    d = wide[:, :-1] > wide[:, 1:]
    basis = _dct(32)[:8]
    low = (basis @ luma(resize(p, 32, 32)) @ basis.T).ravel()[1:]
    return tuple(f"{_bits(x):016x}" for x in (a, d, low >= np.sort(low)[31]))


def variation(values) -> float:
    v = np.asarray(values, float)
    return 0.0 if v.size == 0 or abs(v.mean()) <= 1e-6 else float(v.std() / abs(v.mean()))


def luma_metrics(p: np.ndarray) -> dict:
    """Mean, deviation, dark and bright shares, mean steps and the ratio of steps at 8-pixel boundaries."""
    h, w = p.shape[:2]
    s = max(1, int(math.sqrt(h * w / 1.2e6)))
    y = luma(p[::s, ::s])
    dx = np.abs(np.diff(y, axis=1))
    dy = np.abs(np.diff(y, axis=0))
    columns = np.arange(1, y.shape[1]) * s
    edge, inside = dx[:, columns % 8 == 0], dx[:, columns % 8 != 0]
    ratio = float(edge.mean() / inside.mean()) if edge.size and inside.size and inside.mean() > 1e-9 else 1.0
    m = lambda a: float(a.mean()) if a.size else 0.0
    return {"mean": m(y), "deviation": float(y.std()), "dark": m(y <= 8), "bright": m(y >= 247), "edge_x": m(dx), "edge_y": m(dy), "boundary_ratio": ratio, "boundary_finding": ratio >= 1.55 and w >= 64 and h >= 64}


def binary_entropy(q: float) -> float:
    return 0.0 if q <= 0 or q >= 1 else -q * math.log2(q) - (1 - q) * math.log2(1 - q)


def stego_metrics(p: np.ndarray) -> dict:
    """Lowest-bit shares of the channels, the rate of changes along the sample, entropies of the eight bit planes."""
    h, w = p.shape[:2]
    s = max(1, math.ceil(math.sqrt(h * w / 1.5e6)))
    rgb = p[::s, ::s, :3].reshape(-1, 3)
    ones = [float((rgb[:, c] & 1).mean()) for c in range(3)]
    low = (rgb & 1).sum(axis=1) >= 2
    rate = float((low[1:] != low[:-1]).mean()) if len(low) > 1 else 0.0
    planes = [binary_entropy(float((rgb >> b & 1).mean())) for b in range(8)]
    return {"red_ones": ones[0], "green_ones": ones[1], "blue_ones": ones[2], "transition_rate": rate, "plane_entropies": planes}


def stego_findings(m: dict) -> list[tuple[str, int]]:
    """(code, confidence) of the indicators."""
    ones, e, out = [m["red_ones"], m["green_ones"], m["blue_ones"]], m["plane_entropies"], []
    if e[0] >= 0.9995 and max(abs(x - 0.5) for x in ones) <= 0.0125 and 0.47 <= m["transition_rate"] <= 0.53:
        out.append(("stego.lsb_near_random", 1))
    if max(ones) - min(ones) > 0.12:
        out.append(("stego.lsb_channel_imbalance", 0))
    if e[0] > 0.998 and e[1] < e[0] - 0.08:
        out.append(("stego.low_plane_entropy_contrast", 1))
    return out


def _blocks(a: np.ndarray) -> np.ndarray:
    h, w = a.shape
    a = np.pad(a, ((0, -h % 8), (0, -w % 8)), mode="edge")
    return a.reshape(a.shape[0] // 8, 8, a.shape[1] // 8, 8).swapaxes(1, 2)


def _unblocks(b: np.ndarray, h: int, w: int) -> np.ndarray:
    return b.swapaxes(1, 2).reshape(b.shape[0] * 8, b.shape[1] * 8)[:h, :w]


_ORTHO = _dct(8) * np.where(np.arange(8) == 0, math.sqrt(1 / 8), math.sqrt(2 / 8))[:, None]


def scaled_table(table: list[int], quality: int) -> np.ndarray:
    k = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table).reshape(8, 8) * k + 50) // 100, 1, 255).astype(float)


def recompress(p: np.ndarray, quality: int) -> np.ndarray:
    """RGB after a JPEG round trip of this quality: colour transform, 4:2:0, 8 x 8 DCT, quantisation and back. Entropy
    coding loses nothing and is left out."""
    rgb = p[..., :3].astype(float)
    h, w = rgb.shape[:2]
    y = rgb @ [0.299, 0.587, 0.114]
    cb = 128 + rgb @ [-0.168736, -0.331264, 0.5]
    cr = 128 + rgb @ [0.5, -0.418688, -0.081312]
    out = []
    for k, plane in enumerate((y, cb, cr)):
        table = scaled_table(CHROMA_TABLE if k else LUMA_TABLE, quality)
        if k:
            even = np.pad(plane, ((0, h % 2), (0, w % 2)), mode="edge")
            plane = (even[::2, ::2] + even[1::2, ::2] + even[::2, 1::2] + even[1::2, 1::2]) / 4
        b = _ORTHO @ (_blocks(plane) - 128) @ _ORTHO.T
        plane = _unblocks(_ORTHO.T @ (np.rint(b / table) * table) @ _ORTHO + 128, *plane.shape)
        out.append(np.repeat(np.repeat(plane, 2, 0), 2, 1)[:h, :w] if k else plane)
    y, cb, cr = out[0], out[1] - 128, out[2] - 128
    return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)), 0, 255).astype(np.uint8)


def _regions(values: np.ndarray, n: int = 4) -> list[float]:
    h, w = values.shape
    ys, xs = np.minimum(n - 1, np.arange(h) * n // h), np.minimum(n - 1, np.arange(w) * n // w)
    return [float(values[np.ix_(ys == j, xs == i)].mean()) for j in range(n) for i in range(n) if (ys == j).any() and (xs == i).any()]


def periodicity(y: np.ndarray, step: int = 2) -> float:
    """See ``siftstone.operators.raster.periodicity``: periods 2 to 8; step 1 takes all columns."""
    rows = y[1:-1:max(1, y.shape[0] // 256)]
    xs = np.arange(1, y.shape[1] - 1, step)
    if xs.size == 0 or rows.size == 0:
        return 0.0
    second = np.abs(rows[:, xs - 1] - 2 * rows[:, xs] + rows[:, xs + 1]).mean(axis=0)
    return max(variation([second[xs % n == k].mean() if (xs % n == k).any() else 0.0 for k in range(n)]) for n in range(2, 9))


def copied_tiles(y: np.ndarray) -> int:
    """Pairs of tiles of an 8 x 8 grid, not neighbours, whose 8 x 8 samples have all but equal hashes and variances."""
    h, w = y.shape
    if h < 64 or w < 64:
        return 0
    found = []
    for j in range(8):
        for i in range(8):
            tile = y[j * h // 8 : (j + 1) * h // 8, i * w // 8 : (i + 1) * w // 8]
            ys, xs = ((np.arange(8) + 0.5) * tile.shape[0] / 8).astype(int), ((np.arange(8) + 0.5) * tile.shape[1] / 8).astype(int)
            s = tile[np.ix_(ys, xs)]
            if s.var() >= 18:
                found.append((i, j, _bits(s >= s.mean()), float(s.var())))
    return sum(1 for k, a in enumerate(found) for b in found[k + 1 :] if max(abs(a[0] - b[0]), abs(a[1] - b[1])) > 1 and (a[2] ^ b[2]).bit_count() <= 2 and min(a[3], b[3]) / max(a[3], b[3]) > 0.70)


def heuristics(p: np.ndarray, phase_step: int = 2) -> dict:
    """Block steps, phases, noise, error levels, resampling, tiles and histogram of a preview of at most 1,024 pixels."""
    p = preview(p, 1024)
    y = luma(p)
    h, w = y.shape
    inner = y[1:-1, 1:-1]
    zero = {"boundary_ratio": 1.0, "phase_dominance": 0.0, "noise_variation": 0.0, "ela_mean": 0.0, "ela_variation": 0.0, "periodicity": 0.0, "copied_tiles": 0, "peakiness": 0.0, "edge_density": 0.0}
    if inner.size == 0:
        return zero
    dx, dy = np.abs(inner - y[1:-1, :-2]), np.abs(inner - y[:-2, 1:-1])
    x = np.arange(1, w - 1)
    edge, inside = dx[:, x % 8 == 0], dx[:, x % 8 != 0]
    phases = [float(dx[:, x % 8 == k].mean()) for k in range(8) if (x % 8 == k).any()]
    high = np.abs(4 * inner - y[1:-1, :-2] - y[1:-1, 2:] - y[:-2, 1:-1] - y[2:, 1:-1])
    s = max(1, w // 512)
    error = np.abs(p[..., :3].astype(int) - recompress(p, 90))[::s, ::s].sum(axis=-1) / (3 * 255.0)
    hist = np.bincount(np.clip(np.rint(y).astype(int), 0, 255).ravel(), minlength=256)
    return {
        "boundary_ratio": float(edge.mean() / inside.mean()) if edge.size and inside.size and inside.mean() > 1e-9 else 1.0,
        "phase_dominance": float(max(phases) / np.mean(phases)) if np.mean(phases) > 1e-9 else 0.0,
        "noise_variation": variation(_regions(high)),
        "ela_mean": float(error.mean()),
        "ela_variation": variation(_regions(error)),
        "periodicity": periodicity(y, phase_step),
        "copied_tiles": copied_tiles(y),
        "peakiness": float(hist.max() / (hist.sum() / 256)),
        "edge_density": float((dx + dy > 48).mean()),
    }


def heuristic_findings(m: dict, jpeg: bool) -> list[tuple[str, int]]:
    """(code, confidence) of the indicators, in a fixed order."""
    rules = [
        ("jpeg.block_boundaries", 1, m["boundary_ratio"] > 1.45),
        ("jpeg.double_compression_grid", 1, jpeg and m["boundary_ratio"] > 1.35 and m["phase_dominance"] > 1.30),
        ("noise.inconsistency", 1, m["noise_variation"] > 0.55),
        ("ela.elevated", 1, m["ela_mean"] > 0.10),
        ("ela.regional_variation", 1, m["ela_variation"] > 0.80 and m["ela_mean"] > 0.015),
        ("resampling.periodicity", 1, m["periodicity"] > 0.48),
        ("compression.regional_inconsistency", 1, m["ela_variation"] > 1.00 and m["noise_variation"] > 0.65),
        ("copy_move.tile_candidates", 1, m["copied_tiles"] > 0),
        ("histogram.peakiness", 0, m["peakiness"] > 18),
    ]
    return [(code, confidence) for code, confidence, found in rules if found]


def jpeg_tables(data: bytes) -> tuple[float | None, float | None, str | None]:
    """Estimated quality, mean of all 8-bit quantisation values, and the chroma label of a JPEG. Table bytes are compared to
    the standard table in the order in which the file has them."""
    from ..sources.containers import jpeg_markers

    tables, label = [], None
    for _, marker, body in jpeg_markers(data):
        at = 0
        while marker == 0xDB and body is not None and at < len(body):
            size = 64 if body[at] >> 4 == 0 else 128
            if size == 64 and at + 65 <= len(body):
                tables.append((body[at] & 15, list(body[at + 1 : at + 65])))
            at += 1 + size
        if marker in (0xC0, 0xC1, 0xC2) and body is not None and len(body) >= 15 and body[5] >= 3:
            (yh, yv), (bh, bv), (rh, rv) = ((body[i] >> 4, body[i] & 15) for i in (7, 10, 13))
            if (bh, bv, rh, rv) != (1, 1, 1, 1):
                label = f"Y {yh}x{yv}; Cb {bh}x{bv}; Cr {rh}x{rv}"
            else:
                label = {(2, 2): "4:2:0", (2, 1): "4:2:2", (1, 1): "4:4:4"}.get((yh, yv), f"Y {yh}x{yv}; C 1x1")
    if not tables:
        return None, None, label
    first = next((t for k, t in tables if k == 0), tables[0][1])
    scale = sorted(a * 100.0 / b for a, b in zip(first, LUMA_TABLE))[32]
    quality = (200 - scale) / 2 if scale <= 100 else 5000 / max(scale, 1)
    return min(100.0, max(1.0, quality)), float(np.mean([x for _, t in tables for x in t])), label


def pair_metrics(a: np.ndarray, b: np.ndarray, side: int = 256) -> dict:
    """Errors over RGB of two pictures brought to one size, and the best similarity of one with the other's centre."""
    sa, sb = (resize(preview(x, 1024), side, side)[..., :3].astype(float) for x in (a, b))

    def similarity(x, y) -> tuple[float, float, float]:
        d = x - y
        mae, rmse = float(np.abs(d).mean()), float(math.sqrt((d * d).mean()))
        return mae, rmse, 1 - mae / 255

    def centre(x: np.ndarray, like: np.ndarray) -> np.ndarray:
        h, w = x.shape[:2]
        ratio = like.shape[1] / like.shape[0]
        cw, ch = (round(h * ratio), h) if w / h > ratio else (w, round(w / ratio))
        cw, ch = max(1, min(w, cw)), max(1, min(h, ch))
        return resize(x[(h - ch) // 2 : (h - ch) // 2 + ch, (w - cw) // 2 : (w - cw) // 2 + cw], side, side)[..., :3].astype(float)

    mae, rmse, same = similarity(sa, sb)
    crop = max(similarity(centre(a, b), sb)[2], similarity(sa, centre(b, a))[2])
    return {"mae": mae, "rmse": rmse, "psnr": 20 * math.log10(255 / rmse) if rmse > 1e-7 else None, "rgb_similarity": same, "crop_similarity": crop}


# renderings


def ela_image(p: np.ndarray, quality: int = 90, gain: int = 8) -> np.ndarray:
    return np.clip(np.abs(p[..., :3].astype(int) - recompress(p, quality)) * gain, 0, 255).astype(np.uint8)


def bit_plane(p: np.ndarray, bit: int, channel: int | None = None) -> np.ndarray:
    """White where the bit is set, in one channel or in most of the three."""
    if channel is not None:
        return ((p[..., channel] >> bit & 1) * 255).astype(np.uint8)
    return (((p[..., :3] >> bit & 1).sum(axis=-1) >= 2) * 255).astype(np.uint8)


def channel(p: np.ndarray, index: int) -> np.ndarray:
    return p[..., index].copy()


def entropy_map(p: np.ndarray, block: int = 16) -> np.ndarray:
    """Entropy of luma in blocks, 8 bits as 255, each block filled."""
    y = np.clip(np.rint(luma(p)), 0, 255).astype(int)
    h, w = y.shape
    out = np.zeros((h, w), np.uint8)
    for j in range(0, h, block):
        for i in range(0, w, block):
            part = y[j : j + block, i : i + block]
            q = np.bincount(part.ravel(), minlength=256) / part.size
            q = q[q > 0]
            out[j : j + block, i : i + block] = round(float(-(q * np.log2(q)).sum()) / 8 * 255)
    return out


def histogram(p: np.ndarray) -> np.ndarray:
    """Counts of each value: red, green, blue."""
    return np.stack([np.bincount(p[..., c].ravel(), minlength=256) for c in range(3)])


def histogram_image(p: np.ndarray, w: int = 768, h: int = 420, margin: int = 28) -> np.ndarray:
    counts = histogram(p)
    out, top = np.full((h, w, 3), 255, np.uint8), max(1, counts.max())
    for c in range(3):
        for x in range(w - 2 * margin):
            n = counts[c][x * 256 // (w - 2 * margin)]
            y = h - margin - 1 - int(n * (h - 2 * margin - 1) / top)
            out[y : h - margin, margin + x] = np.minimum(out[y : h - margin, margin + x], [255 if k == c else 120 for k in range(3)])
    return out


def difference_image(a: np.ndarray, b: np.ndarray, side: int | None = 512, gain: int = 3) -> np.ndarray:
    if side:
        a, b = resize(a, side, side), resize(b, side, side)
    total = np.abs(a[..., :3].astype(int) - b[..., :3]).sum(axis=-1)
    return np.minimum(255, total // 3 * gain).astype(np.uint8)


def overlay_image(a: np.ndarray, b: np.ndarray, side: int = 768) -> np.ndarray:
    return ((resize(a, side, side)[..., :3].astype(int) + resize(b, side, side)[..., :3]) // 2).astype(np.uint8)


def heat_image(a: np.ndarray, b: np.ndarray, side: int = 512) -> np.ndarray:
    mean = np.abs(resize(a, side, side)[..., :3].astype(int) - resize(b, side, side)[..., :3]).mean(axis=-1)
    red = np.minimum(255, np.rint(mean * 3)).astype(int)
    return np.stack([red, np.minimum(255, np.rint(mean * 3 * 2).astype(int)) * (red < 255) + (red >= 255) * 255, np.zeros_like(red)], axis=-1).astype(np.uint8)


def contact_sheet(a: np.ndarray, b: np.ndarray, side: int = 720, gap: int = 16) -> np.ndarray:
    out = np.full((side, 2 * side + gap, 3), 255, np.uint8)
    for k, p in enumerate((a, b)):
        s = preview(p, side)[..., :3]
        y, x = (side - s.shape[0]) // 2, k * (side + gap) + (side - s.shape[1]) // 2
        out[y : y + s.shape[0], x : x + s.shape[1]] = s
    return out


def oriented(p: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels as they are to be shown, from EXIF orientation 1 to 8."""
    turn = {2: lambda q: q[:, ::-1], 3: lambda q: q[::-1, ::-1], 4: lambda q: q[::-1], 5: lambda q: q.swapaxes(0, 1), 6: lambda q: q.swapaxes(0, 1)[:, ::-1], 7: lambda q: q[::-1, ::-1].swapaxes(0, 1), 8: lambda q: q.swapaxes(0, 1)[::-1]}
    return np.ascontiguousarray(turn.get(orientation, lambda q: q)(p))


# PNG and BMP


def write_png(a: np.ndarray) -> bytes:
    """PNG of gray (h, w), RGB or RGBA uint8."""
    h, w = a.shape[:2]
    kind = {2: 0, 3: 2 if a.ndim == 3 and a.shape[2] == 3 else 6}[a.ndim]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], axis=1).tobytes()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def read_png(data: bytes, most_pixels: int = 60_000_000) -> np.ndarray:
    """RGBA of a non-interlaced PNG of 8 bits (or palette of 1 to 8 bits). ValueError for others and for sizes above the cap,
    which is checked before anything is unpacked."""
    at, packed, palette, alpha, head = 8, [], None, None, None
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", body[:13])
            if w * h > most_pixels or w * h == 0:
                raise ValueError("The picture has more pixels than the limit.")
            if interlaced or depth > 8 or (depth < 8 and kind not in (0, 3)):
                raise ValueError("This kind of PNG has no decoder here.")
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            break
        at += 12 + size
    if head is None or not packed:
        raise ValueError("The PNG has no pixels.")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    step, width = max(1, channels * depth // 8), (w * channels * depth + 7) // 8
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), h * (width + 1))
    except zlib.error as e:
        raise ValueError(f"The PNG can't be unpacked: {e}") from e
    if len(raw) < h * (width + 1):
        raise ValueError("The PNG is cut off.")
    lines = np.frombuffer(raw, np.uint8).reshape(h, width + 1)
    out, above = np.empty((h, width), np.uint8), np.zeros(width, np.uint8)
    for j in range(h):
        out[j] = above = _unfilter(int(lines[j, 0]), lines[j, 1:], above, step)
    if depth < 8:
        out = (np.unpackbits(out, axis=1).reshape(h, -1, depth) @ (1 << np.arange(depth)[::-1]))[:, :w].astype(np.uint8)
        if kind == 0:
            out = out * (255 // ((1 << depth) - 1))
    a = out.reshape(h, w, channels)
    full = np.full((h, w, 1), 255, np.uint8)
    if kind == 3:
        if palette is None or a.max(initial=0) >= len(palette):
            raise ValueError("The PNG's palette is too short.")
        table = np.full(256, 255, np.uint8)
        if alpha is not None:
            table[: len(alpha)] = alpha[:256]
        return np.concatenate([palette[a[..., 0]], table[a]], axis=-1)
    if kind in (0, 4):
        return np.concatenate([np.repeat(a[..., :1], 3, axis=-1), a[..., 1:] if kind == 4 else full], axis=-1)
    return np.concatenate([a, full], axis=-1) if kind == 2 else a.copy()


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:
        n = -line.size % step
        return np.cumsum(np.pad(line, (0, n)).reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: line.size]
    if kind not in (3, 4):
        raise ValueError("The PNG has an unknown filter.")
    out, up = bytearray(line.tobytes()), above.tobytes()
    for i in range(len(out)):
        a, b = out[i - step] if i >= step else 0, up[i]
        if kind == 3:
            out[i] = (out[i] + (a + b) // 2) & 255
        else:
            c = up[i - step] if i >= step else 0
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            out[i] = (out[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
    return np.frombuffer(bytes(out), np.uint8)


def read_bmp(data: bytes, most_pixels: int = 60_000_000) -> np.ndarray:
    """RGBA of an uncompressed BMP of 24 or 32 bits."""
    start, w, h, bits, packing = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<ii", data, 18), struct.unpack_from("<H", data, 28)[0], struct.unpack_from("<I", data, 30)[0]
    if bits not in (24, 32) or packing not in (0, 3) or w <= 0 or w * abs(h) > most_pixels:
        raise ValueError("This kind of BMP has no decoder here.")
    stride = (w * bits // 8 + 3) // 4 * 4
    a = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    a = a[::-1] if h > 0 else a
    return np.concatenate([a[..., 2::-1], np.full((abs(h), w, 1), 255, np.uint8)], axis=-1)


def decode(data: bytes, most_pixels: int = 60_000_000) -> np.ndarray:
    """RGBA of a PNG, BMP or sequential JPEG; other types are decoded by Spark's image source."""
    if data.startswith(b"\xff\xd8"):
        return read_jpeg(data, most_pixels)
    if data.startswith(b"\x89PNG"):
        return read_png(data, most_pixels)
    if data[:2] == b"BM":
        return read_bmp(data, most_pixels)
    raise ValueError("No decoder for this type of picture here.")
