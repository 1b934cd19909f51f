"""WARC archives: writing them, normalizing whole-file gzip streams, and reading them back.

Files are written to a folder that all machines share, through pyarrow's file systems, under a name
that no other attempt of a task uses. Only files that a finished task lists in its manifest count, so
a lost or repeated task leaves no wrong archive behind.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.errors import ConfigError
from brindle.session import bound_batches, materialize, qualified, scratch, shared_folder

#: Bytes of records after which a writer starts another archive, so that an archive's index is bounded, too.
ARCHIVE_BYTES = 64 << 20
#: Bytes read or inflated at once.
CHUNK = 1 << 20
#: The date of records, fixed so that archives are alike in each run.
DATE = "2000-01-01T00:00:00Z"

_MANIFEST = "path string, records bigint, bytes bigint"
_INDEXED = "path string, index string, records bigint"
_READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, sound boolean"


def digest(payload: bytes) -> str:
    """The bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record. A revisit has the headers of the response, and not its payload."""
    name = lambda n: f"<urn:page:{'' if n is None else n}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[-1:-1] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """Header fields with lower-case names."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse(data: bytes) -> tuple[int | None, str, int, str, str, int | None, bool]:
    """A whole record's page id, URL, payload size and digest, type, what it refers to, and whether the payload has its digest."""
    head, _, block = data.partition(b"\r\n\r\n")
    f = fields(head)
    block = block[: int(f["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(fields(http)["content-length"])
    stated = f["warc-payload-digest"].removeprefix("sha1:")
    if f["warc-type"] == "revisit":
        return _page(f["warc-record-id"]), f["warc-target-uri"], size, stated, "revisit", _page(f["warc-refers-to"]), not payload
    found = digest(payload)
    return _page(f["warc-record-id"]), f["warc-target-uri"], len(payload), found, "response", None, found == stated and size == len(payload)


def inflated(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The content of a gzip stream of one or more members, in bounded pieces."""
    z, data = zlib.decompressobj(31), read(CHUNK)
    while data:
        piece = z.decompress(data, CHUNK)
        if piece:
            yield piece
        data = z.unconsumed_tail
        if z.eof:
            data = z.unused_data or read(CHUNK)
            if data:
                z = zlib.decompressobj(31)
        elif not data:
            data = read(CHUNK)
            if not data:
                raise ValueError("the gzip stream is cut off")


def normalize(read: Callable[[int], bytes], write: Callable[[bytes], object], level: int = 6) -> list[tuple[int, int, str, str]]:
    """Rewrites a WARC file so that each record is a gzip member of its own.

    ``read`` gives the bytes of a file that may be one gzip stream from first to last record, or have
    members anywhere; it is inflated once, and a record's block is passed on in pieces, so memory doesn't
    depend on its length. A header is held whole, however long its URL. Returns offset, length, id and
    type of each record.
    """
    pieces, held, at = inflated(read), b"", 0
    index, offset = [], 0

    def fill() -> bool:
        nonlocal held, at
        piece = next(pieces, None)
        if piece is None:
            return False
        held, at = held[at:] + piece, 0
        return True

    while at < len(held) or fill():
        while not held.startswith(b"WARC/", at) and len(held) - at < 5 and fill():
            pass
        if not held.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        looked = at
        while (end := held.find(b"\r\n\r\n", looked)) < 0:
            looked = max(len(held) - at - 3, 0)  # from where the header starts, which fill() moves to 0
            if not fill():
                raise ValueError("a record's header has no end")
        head = held[at : end + 4]
        f = fields(head)
        if not f.get("content-length", "").isdigit():
            raise ValueError("not a WARC record")
        left, at = int(f["content-length"]) + 4, end + 4
        z, length, last = zlib.compressobj(level, zlib.DEFLATED, 31), 0, b""
        out = z.compress(head)
        while left:
            if at == len(held) and not fill():
                raise ValueError("the last record is cut off")
            part = held[at : at + left]
            at, left, last = at + len(part), left - len(part), (last + part)[-4:]
            out += z.compress(part)
            if len(out) >= CHUNK:
                write(out)
                length, out = length + len(out), b""
        if last != b"\r\n\r\n":
            raise ValueError("a record has another length than it states")
        out += z.flush()
        write(out)
        length += len(out)
        index.append((offset, length, f.get("warc-record-id", ""), f.get("warc-type", "")))
        offset += length
    return index


def _move(system: fs.FileSystem, path: str) -> None:
    system.move(path + ".part", path)


def _writer(folder: str, level: int, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        path, out, z, records, size = "", None, None, 0, 0

        def close() -> pa.RecordBatch:
            out.write(z.flush())
            out.close()
            _move(system, path)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to", "revisit")), strict=True):
                page_id, url, payload, refers_to, revisit = (x.as_py() for x in row)
                if out is None:
                    path, z, records, size = f"{base}/{uuid.uuid4().hex}.warc.gz", zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                    out = system.open_output_stream(path + ".part", compression=None)
                made = record(page_id, url, payload, refers_to, revisit)
                out.write(z.compress(made))
                records, size = records + 1, size + len(made)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def _normalizer(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for source in batch.column("path").to_pylist():
                path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                with system.open_input_stream(source, compression=None) as a, system.open_output_stream(path + ".part", compression=None) as b:
                    index = normalize(a.read, b.write, level)
                with system.open_output_stream(path + ".idx.part", compression=None) as c:
                    for entry in index:
                        c.write(json.dumps(entry).encode() + b"\n")
                _move(system, path)
                _move(system, path + ".idx")
                yield pa.RecordBatch.from_pydict({"path": [path], "index": [path + ".idx"], "records": [len(index)]}, pa.schema([("path", pa.string()), ("index", pa.string()), ("records", pa.int64())]))

    return run


def read_record(file: pa.NativeFile, offset: int, length: int) -> bytes:
    """One record by its place in the index."""
    file.seek(offset)
    return zlib.decompress(file.read(length), 31)


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("sound", pa.bool_())])
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                with system.open_input_stream(index, compression=None) as f:
                    entries = [json.loads(line) for line in f.read().splitlines()]
                with system.open_input_file(path) as f:
                    for at in range(0, len(entries), 1000):
                        rows = [parse(read_record(f, offset, length)) for offset, length, _, _ in entries[at : at + 1000]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _by_file(manifest: DataFrame) -> DataFrame:
    """A written manifest with its files dealt evenly to tasks."""
    return manifest.repartition(max(1, min(manifest.count(), 20_000)))


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to and revisit: among equal payloads of ``least_bytes`` or more the
    least page_id is the response that the others revisit; shorter ones are all responses.

    Only digests are grouped, and only of payloads that occur twice; that table is written, so that a
    payload with a third of all rows is spread by the skew join.
    """
    bound_batches(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha", F.unhex(F.sha1("payload")))
    once = p.filter(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    once = materialize(once.filter("n > 1").select(F.col("sha").alias("_sha"), "first"), "digests")
    out = p.join(once, F.col("sha") == F.col("_sha"), "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return out.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(records: DataFrame, folder: str, level: int = 1, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes records to archives that are one gzip stream each; returns the manifest."""
    return materialize(records.mapInArrow(_writer(folder, level, archive_bytes), _MANIFEST), "manifest")


def normalize_archives(manifest: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrites the archives of a manifest with a member a record and an index beside each."""
    return materialize(_by_file(manifest).mapInArrow(_normalizer(folder, level), _INDEXED), "manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of indexed archives, each read by its place: sizes and digests as read."""
    return _by_file(manifest).mapInArrow(_reader(folder), _READ)


def archived(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes a record for each page, normalizes the archives and reads them back.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to, a row a page. A record's
    payload is the page's html in UTF-8. The whole-file streams are deleted once normalized; the normalized
    archives stay in ``folder``, or are deleted once read if no folder is given. A folder without a scheme is on
    the cluster's default file system, and one that pyarrow can't reach is an error.

    Defined results: a null html has an empty payload; a null URL is about:blank; a page_id that occurs
    again with the same payload is a response each time if it is the least; a null page_id revisits the
    least one of its payload, and is a response if there is none; pages and URLs of any length are kept
    whole; an empty table gives no rows and no archives; other columns, whatever their names, are left out.
    """
    spark = pages.sparkSession
    own = folder is None
    folder = qualified(spark, folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    try:
        fs.FileSystem.from_uri(folder)
    except (pa.ArrowException, OSError) as e:
        raise ConfigError(f"archives can't be written to {folder}: {e}") from e
    with scratch() as keep:
        whole = write_archives(roles(pages, least_bytes), f"{folder}/streams")
        single = normalize_archives(whole, f"{folder}/records")
        _delete(spark, f"{folder}/streams")
        found = read_archives(single, f"{folder}/records")
        broken = F.assert_true(F.col("sound"), F.lit("a payload read back differs from its digest"))
        out = keep(materialize(found.filter(broken.isNull()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records"))
    if own:
        _delete(spark, folder)
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
