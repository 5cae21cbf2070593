"""The JPEG decoder against the platform's codec, and JPEG in scans."""

import numpy as np
import pytest

from siftstone.functions.jpeg import ZIGZAG, read_jpeg
from siftstone.operators import scan


def picture(w, h, seed=0):
    y, x = np.mgrid[0:h, 0:w]
    rng = np.random.default_rng(seed)
    return np.clip(np.stack([128 + 90 * np.sin(x / 17 + seed), 128 + 80 * np.cos(y / 13), (x + y) * 255 / (w + h)], axis=-1) + rng.normal(0, 3, (h, w, 3)), 0, 255).astype(np.uint8)


def encoded(spark, rgb, quality=0.85, gray=False):
    """(JPEG bytes, pixels) by the JVM's codec."""
    jvm = spark.sparkContext._jvm
    h, w = rgb.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 10 if gray else 1)
    flat = ((rgb[..., 0].astype(int) << 16) | (rgb[..., 1].astype(int) << 8) | rgb[..., 2]).ravel()
    values = spark.sparkContext._gateway.new_array(jvm.int, w * h)
    for i, v in enumerate(flat.tolist()):
        values[i] = v
    image.setRGB(0, 0, w, h, values, 0, w)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setCompressionMode(2)
    how.setCompressionQuality(quality)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    writer.getOutput().flush()
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    if gray:  # stored values; getRGB would also change the tone curve
        got = np.array([back.getRaster().getSample(i % w, i // w, 0) for i in range(w * h)])
        return data, np.repeat(got.reshape(h, w, 1), 3, axis=-1)
    got = np.array([back.getRGB(i % w, i // w) & 0xFFFFFF for i in range(w * h)])
    return data, np.stack([got >> 16, got >> 8 & 255, got & 255], axis=-1).reshape(h, w, 3)


def test_zigzag():
    assert ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(ZIGZAG.tolist()) == list(range(64))


def test_pixels_equal_the_codec(spark):
    for w, h, quality, gray in ((64, 48, 0.9, False), (37, 29, 0.5, False), (16, 8, 0.95, True), (1, 1, 0.8, False)):
        data, want = encoded(spark, picture(w, h), quality, gray)
        got = read_jpeg(data)
        assert got.shape == (h, w, 4) and (got[..., 3] == 255).all()
        far = np.abs(got[..., :3].astype(int) - want)
        assert far.mean() < 3 and np.percentile(far, 90) < 16, (w, h, far.mean(), far.max())


def test_broken_files_are_refused(spark):
    data, _ = encoded(spark, picture(40, 40))
    for bad in (b"\xff\xd8", data[: len(data) // 2], data[:40], data.replace(b"\xff\xc0", b"\xff\xc2"), b"\xff\xd8" + b"\x00" * 100, data[:200] + b"\xff" * 300):
        with pytest.raises(ValueError):
            read_jpeg(bad)
    with pytest.raises(ValueError):
        read_jpeg(data, most_pixels=1000)


def test_jpeg_through_scan(spark):
    one, two = encoded(spark, picture(96, 72))[0], encoded(spark, picture(96, 72), 0.7)[0]
    other = encoded(spark, picture(80, 80, 3))[0]
    files = spark.createDataFrame([(n, i, f"{n}.jpg", bytearray(b)) for i, (n, b) in enumerate((("a", one), ("b", two), ("c", other), ("d", one)))], "file_id string, ord long, name string, content binary")
    rows = {r["file_name"]: r for r in scan.batch_scan(files).collect()}
    assert all(r["p_hash"] is not None and r["error"] is None for r in rows.values())
    assert rows["d.jpg"]["duplicate_of"] == "a.jpg" and rows["b.jpg"]["duplicate_of"] is None
    apart = lambda x, y: ((rows[x]["d_hash"] ^ rows[y]["d_hash"]) & (1 << 64) - 1).bit_count()
    assert apart("a.jpg", "b.jpg") <= 6 < apart("a.jpg", "c.jpg")
    report = {r["file_id"]: r for r in scan.deep_scan(files)["report"].collect()}
    assert report["a"]["measures"]["error"] is None and report["a"]["measures"]["jpeg_quality"] > report["b"]["measures"]["jpeg_quality"]
    assert report["a"]["measures"]["heuristics"]["ela_mean"] > 0 and report["a"]["measures"]["stego"] is not None
