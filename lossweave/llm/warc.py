"""WARC archives with a Zstandard dictionary: written by tasks, read back from the files.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on records of the
archive itself; then every record is a Zstandard frame of its own, so that a reader can begin at any record
whose offset it knows. Of records with equal payloads of at least ``least_bytes`` the one with the smallest
page id is a response, the others are revisits that refer to it and carry no payload.

Tasks write through ``pyarrow.fs`` (file, hdfs, s3, gs), under names of their own; the index table lists the
files of the tasks that Spark counts as done, so files of lost attempts are never read. A task holds the
records of one archive (``archive_bytes``) at a time.

Defined results: null html is an empty payload; rows that share the smallest page id of a payload are all
responses; a null page id is a revisit if an equal payload has an id, else a response; pages are told apart
by nothing but their rows, so repeated rows give repeated records; an archive with too few records to train
on has no dictionary frame; an empty table gives no archive and an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from lossweave.llm.tables import pin
from lossweave.runtime import shared_dir

DICTIONARY_MAGIC = 0x184D2A5D  # fixed by the format
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by the format
_INDEX = pa.schema([("page_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if is_revisit else http + payload
    target = "".join(" " if c in "\r\n" else c for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if is_revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes], size: int, sample_bytes: int) -> zstandard.ZstdCompressionDict | None:
    """Trained on a bounded sample spread evenly over the archive's records."""
    total = sum(map(len, records))
    samples = [r[: 1 << 17] for r in records[:: max(1, -(-total // sample_bytes))]]
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8, level=3)
    except zstandard.ZstdError:
        return None


def _write(folder: str, dictionary_bytes: int, sample_bytes: int, archive_bytes: int, date: str):
    def flush(where: fs.FileSystem, root: str, held: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        records = [r for _, r in held]
        trained = _dictionary(records, dictionary_bytes, sample_bytes)
        # without a shared dictionary object the frames would name no dictionary, so each compressor takes it
        compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        rows = []
        with where.open_output_stream(f"{root}/{name}", compression=None) as out:
            at = 0
            if trained is not None:
                raw = trained.as_bytes()
                at += out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
            for page_id, data in held:
                frame = compressor.compress(data)
                out.write(frame)
                rows.append((page_id, f"{folder}/{name}", at, len(frame)))
                at += len(frame)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = filesystem(folder)
        where.create_dir(root, recursive=True)
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c for c in batch.columns)):
                page_id, url, html, digest, length, refers_to, is_revisit = (v.as_py() for v in row)
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, length, refers_to, is_revisit, date)
                held.append((page_id, data))
                size += len(data)
                if size >= archive_bytes:
                    yield flush(where, root, held)
                    held, size = [], 0
        if held:
            yield flush(where, root, held)

    return run


def write_archives(
    pages: DataFrame,
    folder: str,
    least_bytes: int = 100,
    dictionary_bytes: int = 32_768,
    sample_bytes: int = 2_000_000,
    archive_bytes: int = 16_000_000,
    date: str = "2020-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per row of (page_id, url, html); returns the index (page_id, path, offset, size)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("length", F.octet_length("html").cast("long"))
    # only payloads that occur twice are looked up again, so the join side is small where copies are few
    copies = (
        rows.where(F.col("length") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("times"))
        .where("times > 1")
        .select(F.col("digest").alias("copied"), "first")
    )
    marked = rows.join(pin(copies, "copies").hint("shuffle_hash"), F.col("digest") == F.col("copied"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    chosen = marked.select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "length",
        F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"),
    )
    written = chosen.mapInArrow(
        _write(folder, dictionary_bytes, sample_bytes, archive_bytes, date), "page_id long, path string, offset long, size long"
    )
    return pin(written, "warc-index")


def open_archive(stream: io.RawIOBase | pa.NativeFile) -> io.BufferedReader:
    """The records of an archive as one stream of text, with the dictionary from its first frame."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    trained = None
    if magic == DICTIONARY_MAGIC:
        trained = zstandard.ZstdCompressionDict(stream.read(size))
    else:
        stream.seek(0)
    reader = zstandard.ZstdDecompressor(dict_data=trained).stream_reader(stream, read_across_frames=True)
    return io.BufferedReader(reader, 1 << 18)


def parse(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record."""
    while version := stream.readline():
        if version.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = {}
        while line := stream.readline().strip():
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield fields, block


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _read(with_payload: bool):
    def rows_of(path: str) -> Iterator[tuple]:
        where, name = filesystem(path)
        with where.open_input_file(name) as file:
            for fields, block in parse(open_archive(file)):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.rpartition(b"Content-Length:")[2])
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response":
                    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} in {path} is damaged")
                refers_to = _page(fields.get("warc-refers-to"))
                yield (_page(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, kind, refers_to, payload if with_payload else None)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held: list[tuple] = []
                for row in rows_of(path):
                    held.append(row)
                    if len(held) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

    return run


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read whole archives named in ``index``: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload (null for revisits' missing blocks or if not asked for). Payloads are checked against
    their digests."""
    paths = pin(index.select("path").distinct(), "archives")
    # a task per archive: paths are short, so without a number they would all go to one task
    paths = paths.repartition(max(1, paths.count()), "path")
    return paths.mapInArrow(
        _read(with_payload),
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    index = write_archives(pages, shared_dir(pages.sparkSession, "warc"))
    return read_archives(index, with_payload=False)
