"""WARC archives in Zstandard form: written record by record, and read back with checks.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed or plain. One
dictionary is trained for a whole table, on its ``SAMPLES`` records of the least hash (``SAMPLE_BYTES`` of each); where that
is too little to train on, the sample itself is the dictionary, so each archive has one. Each record is one Zstandard frame with its length and a checksum. The reader loads the dictionary, walks the frames by
their block headers, decodes one frame for one record, and checks the version line, the mandatory headers, the
lengths of frame, block and payload, and the payload's digest. What fails a check raises ``WarcError``. Records other than
HTTP ones (warcinfo, metadata, resource) have their block as payload; ids of any form, frames without a content size and
records without a digest are read as well.

Of records with equal payloads of at least ``least_bytes`` the one with the least id is the response, the others
are revisits of it; rows that share that least id are responses each. Null payloads are empty, null urls have
no target header. A payload that only rows without an id have is a response each time.

Archives are rows of a table (name, content) of a few MB each, so any store that Spark writes to will do, and tasks
that run again replace what they wrote. ``save`` and ``load`` turn them to and from files.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint_dir, cut

DICT_FRAME, ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Records gathered for one archive, the dictionary's size, and what it is trained on.
ARCHIVE_BYTES, DICT_BYTES, SAMPLES, SAMPLE_BYTES = 16 << 20, 8192, 200, 4096
LEVEL, DATE = 3, "2000-01-01T00:00:00Z"
#: First ids of payloads that occur repeatedly are broadcast up to this many, else joined by shuffle.
BROADCAST_ROWS = 100_000


class WarcError(ValueError):
    """An archive or record that is not as it should be."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name.removeprefix("-").isdecimal() else None


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """A response, or a revisit if ``refers_to`` is given, whose block has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> bytes:
    """A dictionary from a few records, or these themselves (at least the head that all share) if they are too few."""
    chosen = [r[:SAMPLE_BYTES] for r in records]
    if len(chosen) >= 8 and sum(map(len, chosen)) >= 8 * DICT_BYTES:
        try:
            return zstandard.train_dictionary(DICT_BYTES, chosen, k=256, d=8, dict_id=int.from_bytes(hashlib.sha1(b"".join(chosen)).digest()[:4], "little") % (1 << 31) + (1 << 15)).as_bytes()
        except zstandard.ZstdError:
            pass
    return (b"".join(chosen) + record(0, "http://example.org/", b""))[-DICT_BYTES:]


def write_archive(records: list[bytes], dictionary: bytes) -> bytes:
    """An archive of these records."""
    out = io.BytesIO()
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    out.write(DICT_FRAME.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True)
    for r in records:
        out.write(press.compress(r))
    return out.getvalue()


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, by its header and block headers."""
    if len(data) - at < 6:
        raise WarcError("a frame is cut off")
    kind = data[at + 4]
    single, checksum = kind >> 5 & 1, kind >> 2 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[kind & 3] + ((1 if single else 0), 2, 4, 8)[kind >> 6]
    while True:
        if len(data) - at < 3:
            raise WarcError("a block is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise WarcError("a frame is cut off")
    return at


def read_archive(content: bytes) -> Iterator[dict]:
    """Records as dicts of ``headers`` (lower-case names), ``http`` and ``payload``."""
    data, at, learned = memoryview(content), 0, None
    if len(data) >= 8 and int.from_bytes(data[:4], "little") == DICT_FRAME:
        n = int.from_bytes(data[4:8], "little")
        held = bytes(data[8 : 8 + n])
        if len(held) < n:
            raise WarcError("the dictionary is cut off")
        if held[:4] == ZSTD_FRAME.to_bytes(4, "little"):
            held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
        learned, at = zstandard.ZstdCompressionDict(held), 8 + n
    press = zstandard.ZstdDecompressor(dict_data=learned) if learned else zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if at > len(data):
                raise WarcError("a skippable frame is cut off")
            continue
        if magic != ZSTD_FRAME:
            raise WarcError(f"no frame at byte {at}")
        end = frame_end(data, at)
        frame = bytes(data[at:end])
        size = zstandard.frame_content_size(frame)
        try:
            press_one = press.decompressobj()
            text = press_one.decompress(frame)
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {at} can't be decoded: {e}") from e
        if not press_one.eof or size >= 0 and size != len(text):
            raise WarcError("a frame's length is not as its header says")
        yield parse_record(text)
        at = end


def _headers(text: bytes) -> dict[str, str]:
    out = {}
    for line in text.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name.strip() != name:
            raise WarcError(f"not a header: {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def parse_record(text: bytes) -> dict:
    """One whole record, checked."""
    head, gap, rest = text.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if not gap or first not in (b"WARC/1.0", VERSION):
        raise WarcError(f"not a record: {text[:40]!r}")
    headers = _headers(lines)
    if missing := [h for h in MANDATORY if h not in headers]:
        raise WarcError(f"a record lacks {', '.join(missing)}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("a block's length is not as its header says")
    kind, block = headers["warc-type"], rest[:-4]
    if not headers.get("content-type", "").replace(" ", "").startswith("application/http"):
        if kind == "revisit" and "warc-refers-to" not in headers:
            raise WarcError("a revisit must refer to a record")
        return {"headers": headers, "status": "", "http": {}, "payload": block, "payload_bytes": len(block)}
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("a block has no HTTP headers")
    status, _, lines = http.partition(b"\r\n")
    fields = _headers(lines)
    n = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else len(payload)
    if kind == "response":
        if n != len(payload):
            raise WarcError("a payload's length is not as its header says")
        named = headers.get("warc-payload-digest", "")
        if named.startswith("sha1:") and named != f"sha1:{digest(payload)}":
            raise WarcError("a payload's digest is not as its header says")
    elif kind == "revisit" and ("warc-refers-to" not in headers or payload):
        raise WarcError("a revisit must refer to a record and have no payload")
    return {"headers": headers, "status": status.decode("latin-1"), "http": fields, "payload": payload, "payload_bytes": n}


def first_records(pages: DataFrame, key: str, payload: str, least_bytes: int) -> DataFrame:
    """(digest, first) for the payloads that occur more than once: the least id that has them."""
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    slim = pages.select(F.col(key).alias("key"), F.sha1(raw).alias("sum"), F.octet_length(raw).alias("n")).where(F.col("n") >= least_bytes)
    return slim.groupBy("sum").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("sum", "first")


def learn(pages: DataFrame, key: str, url: str, payload: str) -> bytes:
    """The dictionary for ``pages``; what comes to the driver is bounded by ``SAMPLES`` and ``SAMPLE_BYTES``. The ids' hashes are
    ranked first, which reads no payload and sends a few bytes for each task; then the records of the least hashes are
    fetched, one for each hash (of rows that share an id, or have none, the least)."""
    place = F.xxhash64(F.col(key))
    least = [r[0] for r in pages.select(place.alias("place")).orderBy("place").limit(SAMPLES).collect()]
    if not least:
        return train([])
    start = F.substring(F.coalesce(F.col(payload), F.lit("")).cast("binary"), 1, SAMPLE_BYTES)
    near = pages.where(place <= least[-1]).select(place.alias("place"), F.struct(F.col(key).alias("key"), F.col(url).alias("url"), start.alias("start")).alias("r"))
    rows = near.groupBy("place").agg(F.min("r").alias("r")).collect()
    return train([record(r["r"]["key"], r["r"]["url"], bytes(r["r"]["start"])) for r in sorted(rows, key=lambda r: r["place"])])


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """(name, records, content) for each archive; every row of ``pages`` is a record of one of them."""
    first = cut(first_records(pages, key, payload, least_bytes))
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    learned = learn(pages, key, url, payload)
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), raw.alias("payload"), F.sha1(raw).alias("sum")).join(first, "sum", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("key")), F.col("first"))
    rows = rows.select("key", "url", "payload", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made, task = [], 0, 0, TaskContext.get().partitionId()

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:05d}-{made:05d}.warc.zst"]), pa.array([len(held)], pa.int64()), pa.array([write_archive(held, learned)], pa.binary())], ["name", "records", "content"])

        for batch in batches:
            for k, u, p, r in zip(*batch.columns):
                held.append(record(k.as_py(), u.as_py(), p.as_py(), r.as_py()))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    held, size, made = [], 0, made + 1
        if held:
            yield archive()

    return rows.mapInArrow(run, "name string, records long, content binary")


def read_archives(archives: DataFrame, content: str = "content") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, record_id) for each record. page_id and
    refers_to are null where an id is not one that ``write_archives`` gives; record_id is the id as it stands. A response's
    missing digest is computed, a revisit's is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "record_id"]
        named = lambda r: r["headers"]["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in r["headers"] else None if r["headers"]["warc-type"] == "revisit" else digest(r["payload"])
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for value in batch.column(0):
                rows, size = [], 0
                for r in read_archive(value.as_py()):
                    h = r["headers"]
                    rows.append((_id(h["warc-record-id"]), h.get("warc-target-uri"), r["payload_bytes"], named(r), h["warc-type"], _id(h["warc-refers-to"]) if "warc-refers-to" in h else None, r["payload"] if h["warc-type"] != "revisit" else None, h["warc-record-id"]))
                    size += len(r["payload"])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("record_id", T.StringType())])
    return archives.select(content).mapInArrow(run, schema)


def stored(archives: DataFrame) -> DataFrame:
    """``archives`` written to the shared folder and read from there."""
    spark = archives.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archives.write.parquet(path)
    return spark.read.schema(archives.schema).parquet(path)


def save(archives: DataFrame, folder: str) -> None:
    """Each archive as a file of its own below ``folder``, a path or URI that pyarrow can write to from executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    archives.select("name", "content").mapInArrow(run, "name string").count()


def load(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the archive files below ``folder``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
