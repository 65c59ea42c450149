"""WARC archives as seekable Zstandard bundles: independent frames, a seek table in the footer, an index into frames."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from actfold.llm.common import Scratch, pick, short_batches

# The seekable format of Zstandard (a skippable frame whose last bytes say how many entries it has), and WARC's revisit profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id string, record_id string, record_type string, file string, frame int, offset long, length long"
RECORD = "page_id string, record_id string, record_type string, refers_to_id string, url string, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(hexes: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hexes[:32])}>"


def record(kind: str, record_id: str, date: str, fields: dict[str, str], block: bytes) -> bytes:
    """One WARC record; fields that are None are left out."""
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date} | fields | {"Content-Length": str(len(block))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items() if v is not None), "\r\n"]).encode() + block + b"\r\n\r\n"


def page_record(page_id: str | None, record_id: str, date: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit of the record ``refers_to`` with the response's head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Target-URI": quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else "urn:page:unknown", "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Refers-To": refers_to, "WARC-Profile": PROFILE if refers_to else None, "Page-Id": None if page_id is None else quote(page_id, safe=""), "Content-Type": "application/http; msgtype=response",
    }
    return record("revisit" if refers_to else "response", record_id, date, fields, head if refers_to else head + payload)


def records(frame: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, fields (names in lower case) and block of each record of a frame."""
    at = 0
    while at < len(frame):
        head = frame.index(b"\r\n\r\n", at) + 4
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in frame[at:head].decode().split("\r\n")[1:] if line)}
        end = head + int(fields["content-length"])
        if frame[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"a record at {at} does not end where its length says")
        yield at, end + 4 - at, fields, frame[head:end]
        at = end + 4


class Bundle:
    """Writes one archive: frames of whole records, then the seek table."""

    def __init__(self, path: str, frame_bytes: int, level: int = 3):
        self.path, self.frame_bytes, self.zstd = path, frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        fs, at = pafs.FileSystem.from_uri(path)
        fs.create_dir(at.rpartition("/")[0])
        self.out, self.entries, self.held, self.size, self.written = fs.open_output_stream(at, compression=None), [], [], 0, 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """The frame and the place in it that a record gets."""
        if self.size and self.size + len(raw) > self.frame_bytes:
            self.flush()
        at = (len(self.entries), self.size)
        self.held.append(raw)
        self.size += len(raw)
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.zstd.compress(b"".join(self.held))
            self.out.write(packed)
            self.entries.append((len(packed), self.size))
            self.held, self.size, self.written = [], 0, self.written + len(packed)

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Frames:
    """Reads frames of one archive by their number, by its seek table; nothing else of the file is read."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(path)
        self.file, self.path = fs.open_input_file(at), path
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        each = 12 if flags & 0x80 else 8
        table = self.file.read_at(n * each, size - 9 - n * each)
        entries = [struct.unpack_from("<II", table, k * each) for k in range(n)]
        self.places, at = [], 0
        for packed, plain in entries:
            self.places.append((at, packed, plain))
            at += packed
        self.zstd = zstandard.ZstdDecompressor()

    def __getitem__(self, k: int) -> bytes:
        at, packed, plain = self.places[k]
        frame = self.zstd.decompress(self.file.read_at(packed, at), max_output_size=plain)
        if len(frame) != plain:
            raise ValueError(f"frame {k} of {self.path} has {len(frame)} bytes, not {plain}")
        return frame


def opened(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """A record as a row of RECORD. A response's payload must have the digest that its record states."""
    _, _, payload = block.partition(b"\r\n\r\n")
    head = block[: len(block) - len(payload)].decode("latin-1")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    size = next(int(line.partition(":")[2]) for line in head.split("\r\n") if line.lower().startswith("content-length:"))
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is not what its record states")
    page_id = fields.get("page-id")
    return (None if page_id is None else unquote(page_id), fields["warc-record-id"], kind, fields.get("warc-refers-to"), fields["warc-target-uri"], size, digest, payload if payloads and kind == "response" else None)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)], schema=schema)


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", date: str = "2000-01-01T00:00:00Z", frame_bytes: int = 1 << 20, bundle_bytes: int = 64 << 20, work: Scratch | None = None) -> DataFrame:
    """Writes a record for each row into archives below ``folder`` and returns their index, a written table.

    Of rows with equal payloads (null texts are empty ones) the one with the
    smallest id is a response, of rows with equal ids too the one that is
    read first; null ids come last. The others are revisits, whose block is the
    response's head alone. An empty table gives no archive. Records have the
    same date, as pages have none.

    A file has whole records in independent frames of about ``frame_bytes``
    (a longer record is a frame of its own) and is closed at about
    ``bundle_bytes``. The index has a row a record: file, frame, and offset and
    length within the frame, which is found by the file's seek table. Files are
    named anew at each attempt of a task; those that count are those of the
    index, which Spark commits as a whole, so lost executors leave stray files
    at worst. ``folder`` must be one that executors reach (local and shared
    paths, HDFS and object stores that pyarrow knows).
    """
    work = work or Scratch(df.sparkSession)
    short_batches(df.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = pick(df, page_id=id_col, url=url_col, text=text_col).select(F.monotonically_increasing_id().alias("uid"), "page_id", F.col("url").cast("string").alias("url"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"))
    rows = work.save(rows, "pages", compression="zstd")
    first = rows.groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "uid")).alias("first")).select("sha", F.col("first.uid").alias("first_uid"))
    first = work.save(first, "first")
    found = rows.join(first.hint("merge"), "sha").select("uid", F.col("page_id").cast("string").alias("page_id"), "url", "text", F.hex("sha").alias("sha"), (F.col("uid") == F.col("first_uid")).alias("is_first"))
    schema = T._parse_datatype_string(INDEX)
    fields = to_arrow_schema(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bundle, out = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for uid, page_id, url, text, sha, is_first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    bundle = Bundle(f"{folder}/{part:06d}-{uuid.uuid4().hex}.warc.zst", frame_bytes)
                    bundle.add(record("warcinfo", urn(uuid.uuid4().hex), date, {"Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                    bundle.flush()
                response = urn(sha)
                own = response if is_first else urn(hashlib.sha256(f"{sha}:{uid}".encode()).hexdigest())
                raw = page_record(page_id, own, date, url, text.encode(), None if is_first else response)
                frame, at = bundle.add(raw)
                out.append((page_id, own, "response" if is_first else "revisit", bundle.path, frame, at, len(raw)))
                if bundle.written >= bundle_bytes:
                    bundle.close()
                    bundle = None
            yield _table(out, fields)
            out = []
        if bundle is not None:
            bundle.close()

    index = work.save(found.mapInArrow(write, schema), "index")
    work.drop(rows, first)
    return index


def read_archives(index: DataFrame, payloads: bool = True, frames: int = 32) -> DataFrame:
    """All records of an index's archives as rows of RECORD, read from the files; revisits have no payload of their own.

    Tasks get runs of ``frames`` frames and hold one frame at a time.
    """
    run = F.floor(F.col("frame") / frames)
    runs = index.groupBy("file", run.alias("run")).agg(F.min("frame").alias("low"), F.max("frame").alias("high"))
    schema = T._parse_datatype_string(RECORD)
    fields = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, low, high in zip(*(batch.column(n).to_pylist() for n in ("file", "low", "high")), strict=True):
                archive = Frames(file)
                for k in range(low, high + 1):
                    yield _table([opened(f, block, payloads) for _, _, f, block in records(archive[k])], fields)

    # Runs are a few bytes each, so adaptive execution would give them all to one task.
    return runs.repartition(max(1, min(runs.count(), 20_000))).mapInArrow(read, schema)


def fetch(index: DataFrame, wanted: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The records of the wanted pages as rows of RECORD; a revisit comes with the payload that it refers to.

    Only frames that hold a wanted record, or a response to one, are read. A
    page that is wanted twice comes once; pages that no archive holds, and null
    ids, are left out.
    """
    ids = pick(wanted, page_id=id_col).select(F.col("page_id").cast("string")).where("page_id is not null").distinct()
    found = _at(index.join(ids.hint("merge"), "page_id", "left_semi"))
    found = Scratch(index.sparkSession).save(found, "fetched")
    response = index.join(found.where("refers_to_id is not null").select(F.col("refers_to_id").alias("record_id")).distinct().hint("merge"), "record_id", "left_semi")
    payload = _at(response).select(F.col("record_id").alias("refers_to_id"), F.col("payload").alias("_payload"))
    return found.join(payload.hint("merge"), "refers_to_id", "left").withColumn("payload", F.coalesce("payload", "_payload")).select(*T._parse_datatype_string(RECORD).names)


def _at(places: DataFrame) -> DataFrame:
    """The records at places of an index."""
    schema = T._parse_datatype_string(RECORD)
    fields = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, held, frame = None, None, b""
        for batch in batches:
            for file, k, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "frame", "offset", "length")), strict=True):
                if archive is None or archive.path != file:
                    archive, held = Frames(file), None
                if held != k:
                    held, frame = k, archive[k]
                ((_, _, found, block),) = records(frame[at : at + n])
                yield _table([opened(found, block, True)], fields)

    return places.repartition("file", "frame").sortWithinPartitions("file", "frame", "offset").select("file", "frame", "offset", "length").mapInArrow(read, schema)


def page_records(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", work: Scratch | None = None, **sizes: int) -> DataFrame:
    """Writes archives, reads all of them back and says what each page's record is: page_id, payload_bytes, payload_digest, record_type, refers_to.

    ``refers_to`` is the id of the page whose response a revisit refers to, by
    the record id that it states.
    """
    work = work or Scratch(df.sparkSession)
    kind = pick(df, page_id=id_col).schema["page_id"].dataType
    index = write_archives(df, folder or f"{work.root}/warc", id_col, url_col, text_col, work=work, **sizes)
    read = work.save(read_archives(index, payloads=False).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_id"), "read")
    responses = work.save(read.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")), "responses")
    revisits = read.where("record_type = 'revisit'").join(responses.hint("merge"), "refers_to_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast(kind)).select(columns).union(revisits.select(columns))
