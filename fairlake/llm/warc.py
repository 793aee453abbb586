"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlake.llm.common import settle
from fairlake.session import shared_dir

#: Fixed values of the format: the skippable frame of a dictionary, a frame, and a trained dictionary.
DICTIONARY_FRAME, FRAME, TRAINED = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-page:"
PIECE = 1 << 20
#: A longer dictionary or header is taken for damage.
MOST_DICTIONARY, MOST_HEADERS = 1 << 26, 1 << 20

RECORD_SCHEMA = ("path string, offset long, record_id string, record_type string, url string, date string, payload_bytes long, "
                 "payload_digest string, refers_to_id string, error string")


def _files(uri: str):
    """A file system that pyarrow knows, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if "://" in uri else Path(uri).absolute().as_uri())


def train_dictionary(payloads: list[bytes], size: int = 1 << 16) -> bytes:
    """A trained dictionary; the last bytes of the samples where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, payloads, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(payloads)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == struct.pack("<I", TRAINED) else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind) if len(data) >= 8 else None


def _clean(value: object) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record_bytes(record_id: str, url: str | None, payload: bytes, date: str, digest: str, refers_to: str | None) -> bytes:
    """A WARC record: headers, an HTTP response, two line ends. A revisit leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    headers = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{_clean(record_id)}>",
               f"WARC-Date: {_clean(date)}", *([] if url is None else [f"WARC-Target-URI: {_clean(url)}"]),
               "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
               *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_clean(refers_to)}>"] if refers_to else []),
               f"Content-Length: {len(block)}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError("a header has no name")
        if out.setdefault(name.strip().lower(), value.strip()) != value.strip():
            raise ValueError(f"header {name.strip()} has two values")
    return out


def parse_record(data: bytes) -> dict:
    """The parts of one record; a ValueError says what is wrong with it."""
    top, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = top.partition(b"\r\n")
    if not gap or len(top) > MOST_HEADERS:
        raise ValueError("the headers have no end")
    if not re.fullmatch(rb"WARC/1\.[01]", version):
        raise ValueError("not a WARC version")
    head = _headers(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not head.get(name):
            raise ValueError(f"{name} is missing")
    if not head["content-length"].isdigit() or len(rest) != int(head["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("the length does not fit")
    http_top, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    status, _, http_lines = http_top.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise ValueError("the block is no HTTP response")
    http = _headers(http_lines) if http_lines else {}
    size = http.get("content-length", str(len(payload)))
    algorithm, _, digest = head.get("warc-payload-digest", "").partition(":")
    kind, refers = head["warc-type"], head.get("warc-refers-to", "").strip("<>") or None
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if size != str(len(payload)) or algorithm == "sha256" and digest != found:
            raise ValueError("the payload is not what its headers say")
        digest = found
    elif kind == "revisit":
        if payload or not refers or not size.isdigit() or algorithm != "sha256":
            raise ValueError("the revisit is not complete")
    else:
        raise ValueError(f"unknown type {kind}")
    return {"record_id": head["warc-record-id"].strip("<>"), "record_type": kind, "url": head.get("warc-target-uri"),
            "date": head["warc-date"], "payload_bytes": int(size), "payload_digest": digest, "refers_to_id": refers, "payload": payload}


def _write_part(folder: str, dictionary: bytes, date: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, count, stream, at = TaskContext.get().partitionId(), 0, None, 0
        held = _dictionary(dictionary)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=held) if held else zstandard.ZstdCompressor(level=3)
        target = f"{folder}/part-{part:05d}-{uuid.uuid4().hex}.warc.zst"  # a repeated task writes another file
        for batch in batches:
            for row in batch.itertuples(index=False):
                if stream is None:
                    files, path = _files(target)
                    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    stream = files.open_output_stream(path, compression=None)
                    stream.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                name = f"{ID_PREFIX}{row.id}" if not pd.isna(row.id) else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{part}-{count}')}"
                refers = None if pd.isna(row.refers_to) else f"{ID_PREFIX}{int(row.refers_to)}"
                stream.write(compressor.compress(record_bytes(name, row.url, row.payload.encode(), date, row.digest, refers)))
                count += 1
        if stream is not None:
            at = stream.tell()
            stream.close()
            yield pd.DataFrame({"path": [target], "records": [count], "bytes": [at]})

    return write


def write_archives(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 100,
                   date: str = "2024-01-01T00:00:00Z", sample: int = 400, folder: str | None = None) -> DataFrame:
    """Writes a record per page into archives, one per partition; returns ``(path, records, bytes)``.

    The payload is the page in UTF-8, empty for null. Of pages with equal payloads of at least
    ``least`` bytes the one with the smallest id is a response and the others are revisits of
    it; rows that repeat this id are responses too, and so are pages of a group without ids. Ids are integers. The dictionary is
    trained on at most ``sample`` pages, drawn by hash and cut to 64 KB each. Only archives named in the result count: a task
    that is run again leaves its first file unnamed. Further columns are ignored. An empty table writes nothing.
    """
    spark = pages.sparkSession
    text = F.coalesce(F.col(html), F.lit(""))
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"), text.alias("payload"),
                       F.sha2(text, 256).alias("digest"))
    sizes = own.select("id", "digest", F.octet_length("payload").alias("size"))
    first = sizes.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("times"))
    first = settle(first.where("times > 1").select(F.col("digest").alias("d"), "first"), "warc-first")
    drawn = own.where("payload <> ''").select(F.substring("payload", 1, 1 << 16).alias("x"), F.xxhash64("digest").alias("h"))
    hashes = [r["h"] for r in drawn.select("h").distinct().orderBy("h").limit(sample).collect()]  # numbers only
    samples = [r["x"].encode() for r in drawn.where(F.col("h").isin(hashes)).groupBy("h").agg(F.first("x").alias("x")).orderBy("h").collect()]
    linked = own.join(first, F.col("digest") == F.col("d"), "left").select(
        "id", "url", "payload", "digest", F.when(F.col("first") != F.col("id"), F.col("first"))
        .otherwise(F.when(F.col("id").isNull(), F.col("first"))).alias("refers_to"))
    folder = folder or shared_dir(spark, "warc")
    manifest = linked.select(F.col("id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string"))
    return settle(manifest.mapInPandas(_write_part(folder, train_dictionary(samples), date), "path string, records long, bytes long"), "warc-manifest")


class _Reader:
    """Reads an archive front to back, a record at a time."""

    def __init__(self, path: str):
        files, inner = _files(path)
        self.path, self.stream, self.held, self.at = path, files.open_input_stream(inner, compression=None), b"", 0

    def _need(self, n: int) -> bool:
        while len(self.held) < n and (more := self.stream.read(PIECE)):
            self.held += more
        return len(self.held) >= n

    def _take(self, n: int) -> bytes:
        out, self.held = self.held[:n], self.held[n:]
        self.at += n
        return out

    def dictionary(self) -> zstandard.ZstdCompressionDict | None:
        if not self._need(8) or struct.unpack("<I", self.held[:4])[0] != DICTIONARY_FRAME:
            raise ValueError("the archive does not begin with a dictionary frame")
        size = struct.unpack("<I", self._take(8)[4:])[0]
        if size > MOST_DICTIONARY or not self._need(size):
            raise ValueError("the dictionary is cut short")
        data = self._take(size)
        if data[:4] == struct.pack("<I", FRAME):  # the dictionary itself may be a frame
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        return _dictionary(data)

    def frames(self, dictionary) -> Iterator[tuple[int, bytes]]:
        context = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        while self._need(4):
            start, magic = self.at, struct.unpack("<I", self.held[:4])[0]
            if 0x184D2A50 <= magic <= 0x184D2A5F:  # another skippable frame
                self._need(8)
                size = 8 + struct.unpack("<I", self.held[4:8])[0]
                if not self._need(size):
                    raise ValueError("a frame is cut short")
                self._take(size)
                continue
            frame, parts = context.decompressobj(), []
            while not frame.eof:
                if not self.held and not self._need(1):
                    raise ValueError("a frame is cut short")
                piece, self.held = self.held, b""
                parts.append(frame.decompress(piece))
                self.held = frame.unused_data if frame.eof else b""
                self.at += len(piece) - len(self.held)
            yield start, b"".join(parts)
        if self.held:
            raise ValueError("bytes follow the last frame")


def read_archive(path: str) -> Iterator[dict]:
    """The records of one archive. What is wrong is told in ``error``; after damage between frames reading stops."""
    offset = 0
    try:
        reader = _Reader(path)
        for offset, data in reader.frames(reader.dictionary()):
            try:
                yield {"path": path, "offset": offset, "error": None, **parse_record(data)}
            except ValueError as wrong:
                yield {"path": path, "offset": offset, "error": str(wrong)}
    except (ValueError, zstandard.ZstdError) as wrong:
        yield {"path": path, "offset": offset, "error": str(wrong)}


def read_archives(paths: DataFrame, path: str = "path", payload: bool = True) -> DataFrame:
    """The records of all archives that ``path`` names: columns of ``RECORD_SCHEMA``, and ``payload`` if asked for.

    An archive is read in pieces by one task; a task holds one record at a time beside a batch of
    results of at most 8 MB. A record with wrong headers, length or digest gives a row with
    ``error`` and is skipped; nulls and repeated paths are read as given. No paths give no rows.
    """
    columns = [c.split()[0] for c in RECORD_SCHEMA.split(", ")] + (["payload"] if payload else [])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"].dropna():
                held, size = [], 0
                for record in read_archive(name):
                    held.append([record.get(c) for c in columns])
                    size += 500 + (len(record.get("payload") or b"") if payload else 0)
                    if size > 1 << 23:
                        yield _frame(held, columns)
                        held, size = [], 0
                yield _frame(held, columns)

    names = paths.select(F.col(path).alias("path"))
    return names.mapInPandas(rows, RECORD_SCHEMA + (", payload binary" if payload else ""))


def _frame(rows: list[list], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"offset": "Int64", "payload_bytes": "Int64"})


def page_id_of(name: str):
    """The page id in a record's name."""
    return F.expr(f"try_cast(CASE WHEN startswith({name}, '{ID_PREFIX}') THEN substr({name}, {len(ID_PREFIX) + 1}) END AS bigint)")


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages`` and reads the archives back: one row per record, without the payload."""
    manifest = write_archives(pages)
    found = read_archives(manifest.repartition(max(1, manifest.count())), payload=False)
    return found.select(page_id_of("record_id").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type",
                        page_id_of("refers_to_id").alias("refers_to"), "error")
