"""WARC files of pages, and their normalisation from one gzip stream to a member a record.

`write_archives` makes archives as they often come: files that are one monolithic gzip stream over many records. The
normaliser reads such a file once, in pieces, finds the records by their Content-Length, writes each as a gzip member
of its own into a new .warc.gz and notes (offset, length, record id) of each member in a sidecar index beside it, a line
a record, so any record can be read by a seek. A task holds one record and one piece at a time, whatever the size of
the archive. Files live in a folder that all executors share and are opened through Arrow's file systems; their names
are new for each attempt of a task, and the tables of paths that the steps return name those of successful attempts
only, so a lost executor leaves at most files that nobody reads.

Of records with equal payloads of at least `least_bytes` bytes that with the largest id is written as response,
the others as revisit without a body; smaller payloads are all responses. Page ids are carried in extension fields.

Defined results: a null or empty payload is empty bytes (its digest is that of no bytes); null urls give an
empty target; a null page_id takes part, is least among equals, and is written as an empty id; repeated rows
are records each with an id of its own (rows alike in id and payload alike in type); payloads of any size are whole
records; an empty table gives no archive; further columns are not looked at. A stream that ends inside a member or a
record, or a record without a length, is an error.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop, lookup, materialise, work_folder

_CRLF = b"\r\n"
PIECE = 1 << 20


def digest(payload: bytes) -> str:
    """Upper-case base32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, size: int, date: str = "2000-01-01T00:00:00Z", refers_url: str | None = None) -> bytes:
    """A WARC/1.1 record; a revisit has no body but tells its payload's digest and length."""
    body = b"" if kind == "revisit" else payload
    target = lambda u: (u or "").encode("utf-8", "surrogatepass").replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    fields = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:uuid:%s>" % str(uuid4()).encode(), b"WARC-Date: " + date.encode(), b"WARC-Target-URI: " + target(url), b"WARC-Payload-Digest: sha1:" + sha1.encode()]
    fields += [b"X-Page-ID: " + (b"" if page_id is None else str(page_id).encode()), b"X-Payload-Length: %d" % size]
    if refers_to is not None:
        fields += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To-Target-URI: " + target(refers_url), b"WARC-Refers-To-Date: " + date.encode(), b"X-Refers-To-Page-ID: %d" % refers_to]
    fields += [b"Content-Type: text/html", b"Content-Length: %d" % len(body)]
    return _CRLF.join(fields) + 2 * _CRLF + body + 2 * _CRLF


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of one record."""
    head, _, rest = data.partition(2 * _CRLF)
    fields = {k.decode(): v.decode("utf-8", "replace") for k, _, v in (line.partition(b": ") for line in head.split(_CRLF)[1:])}
    return fields, rest[: int(fields["Content-Length"])]


def inflate(chunks: Iterator[bytes], most: int = PIECE) -> Iterator[bytes]:
    """What gzip data (of one or more members) holds, in pieces of at most `most` bytes."""
    d = None  # None between members
    for chunk in chunks:
        while chunk:
            d = d or zlib.decompressobj(31)
            piece = d.decompress(chunk, most)
            while piece:
                yield piece
                # a full piece may leave more inside, even where no input is left
                piece = d.decompress(d.unconsumed_tail, most) if not d.eof and (d.unconsumed_tail or len(piece) == most) else b""
            chunk = d.unused_data if d.eof else b""
            d = None if d.eof else d
    if d is not None:
        raise ValueError("the gzip stream ends early")


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, each with its closing blank lines; holds one record at a time."""
    buffer, start, need = bytearray(), 0, 0
    for piece in stream:
        buffer += piece
        while len(buffer) >= need:
            head = buffer.find(2 * _CRLF, start)
            if head < 0:
                break
            fields = bytes(buffer[start:head]).lower() + _CRLF
            at = fields.find(b"\r\ncontent-length:")
            if at < 0:
                raise ValueError("a record without Content-Length")
            stop = fields.find(_CRLF, at + 2)
            end = head + 8 + int(fields[at + 17 : stop])
            if len(buffer) < end:
                need = end - start
                break
            yield bytes(buffer[start:end])
            start, need = end, 0
        if start:
            del buffer[:start]
            start = 0
    if buffer:
        raise ValueError("the stream ends inside a record")


def normalise(chunks: Iterator[bytes], level: int = 1) -> Iterator[tuple[bytes, int, int, str]]:
    """(member, offset, length, record id) of each record of a monolithic gzip stream, as written one after another."""
    offset = 0
    for r in records(inflate(chunks)):
        c = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = c.compress(r) + c.flush()
        fields = r[: r.find(2 * _CRLF)].split(_CRLF)
        name = next((f.partition(b":")[2].strip().decode("utf-8", "replace") for f in fields if f.lower().startswith(b"warc-record-id:")), "")
        yield member, offset, len(member), name
        offset += len(member)


def _opened(path: str):
    """The Arrow file system of a path or URI, and the path in it."""
    import pyarrow.fs as fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def normalise_file(source: str, target: str, level: int = 1) -> int:
    """Rewrites the archive at source with a member a record to target and its index to target.idx; how many records."""
    fs, path = _opened(source)
    out, to = _opened(target)
    n = 0
    with fs.open_input_stream(path, compression=None) as f, out.open_output_stream(to, compression=None) as members, out.open_output_stream(to + ".idx", compression=None) as index:
        chunks = iter(lambda: f.read(PIECE), b"")
        for member, offset, length, name in normalise(chunks, level):
            members.write(member)
            index.write(f"{offset} {length} {name}\n".encode())
            n += 1
    return n


def read_index(path: str) -> Iterator[tuple[int, int, str]]:
    """(offset, length, record id) of the members of a normalised archive, from its sidecar."""
    fs, at = _opened(path + ".idx")
    with fs.open_input_stream(at, compression=None) as f:
        rest = b""
        while piece := f.read(PIECE):
            *lines, rest = (rest + piece).split(b"\n")
            for line in lines:
                offset, length, name = line.decode().split(" ", 2)
                yield int(offset), int(length), name


def plan(pages: DataFrame, least_bytes: int = 0, broadcast_rows: int = 100_000, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, sha1, record_type, refers_to, refers_url of every row."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    sha1 = F.sha1(payload)
    size = F.octet_length(payload).cast("long")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), size.alias("payload_bytes"), sha1.alias("sha1"))
    # one row a payload that occurs again; a null id is least, so it is newest only where all are null
    keys = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), sha1.alias("sha1"), size.alias("payload_bytes")).where(F.col("payload_bytes") >= least_bytes)
    newest = keys.groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("r"), F.count("*").alias("copies")).where("copies > 1")
    newest = materialise(newest.select("sha1", F.col("r.page_id").alias("newest"), F.col("r.url").alias("refers_url"), "copies"), "newest")
    # up to broadcast_rows repeated payloads (some 20 MB) go to the tasks; of more the hot ones, the others meet by a shuffle
    few = newest.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = rows.join(F.broadcast(newest), "sha1", "left") if few else lookup(rows, newest, "sha1", "copies", "left")
    revisit = F.coalesce((F.col("payload_bytes") >= least_bytes) & F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest")), F.lit(False))
    told = rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("newest")))
    return told.select("page_id", "url", "payload", "payload_bytes", "sha1", "record_type", "refers_to", "refers_url")


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = 16 << 20, level: int = 1) -> DataFrame:
    """archive (a path): monolithic gzip files of about archive_bytes of records each, written into folder as the rows are made."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def go(batches):
        f = None
        for b in batches:
            for i in range(b.num_rows):
                kind, page, url, payload, sha1, refers, refers_url, n = (b.column(k)[i].as_py() for k in range(8))
                if f is None:
                    path = f"{folder}/pages-{uuid4().hex}.warc.gz"
                    fs, at = _opened(path)
                    f, z, size = fs.open_output_stream(at, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0
                data = record(kind, page, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), refers, n, date, refers_url)
                size += len(data)
                f.write(z.compress(data))
                if size >= archive_bytes:
                    f.write(z.flush())
                    f.close()
                    f = None
                    yield pa.record_batch({"archive": [path]})
        if f is not None:
            f.write(z.flush())
            f.close()
            yield pa.record_batch({"archive": [path]})

    _opened(folder)[0].create_dir(_opened(folder)[1], recursive=True)
    return planned.select("record_type", "page_id", "url", "payload", "sha1", "refers_to", "refers_url", "payload_bytes").mapInArrow(go, "archive string")


def _spread(paths: DataFrame) -> DataFrame:
    """A task for each path, up to 10 000 tasks."""
    return paths.repartition(max(1, min(10_000, paths.count())))


def normalise_archives(archives: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """archive, normalised (paths), records of every archive; beside each normalised file stands its index (path + '.idx')."""

    def go(batches):
        for b in batches:
            for source in b.column(0).to_pylist():
                target = f"{folder}/{source.rpartition('/')[2].removesuffix('.warc.gz')}-{uuid4().hex}.warc.gz"
                n = normalise_file(source, target, level)
                yield pa.record_batch({"archive": [source], "normalised": [target], "records": pa.array([n], pa.int64())})

    _opened(folder)[0].create_dir(_opened(folder)[1], recursive=True)
    return _spread(archives.select("archive")).mapInArrow(go, "archive string, normalised string, records long")


def read_archives(normalised: DataFrame, bodies: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, body (null without bodies) of every record, each
    read by a seek to its index entry and held against its digest."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "body"]
    number = lambda x: int(x) if x else None

    def go(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = _opened(path)
                rows, size = [], 0
                with fs.open_input_file(at) as f:
                    for offset, length, name in read_index(path):
                        f.seek(offset)
                        fields, body = parse(zlib.decompress(f.read(length), 31))
                        kind, sha1 = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Record-ID"] != name or kind == "response" and digest(body) != sha1:
                            raise ValueError(f"{path}: the record at {offset} doesn't match its index entry or its digest")
                        rows.append((number(fields["X-Page-ID"]), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), sha1, kind, number(fields.get("X-Refers-To-Page-ID")), body if bodies else None))
                        size += len(body) if bodies else 0
                        if len(rows) == 5000 or size >= 4 * PIECE:
                            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return _spread(normalised.select("normalised")).mapInArrow(go, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, body binary")


def round_trip(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 16 << 20, level: int = 1, bodies: bool = True, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes pages as monolithic archives, normalises these and reads every record back by its index entry."""
    spark = pages.sparkSession
    folder = work_folder(spark)
    raw = materialise(write_archives(plan(pages, least_bytes, page_id=page_id, url=url, html=html), f"{folder}/monolithic", archive_bytes, level), "monolithic")
    done = materialise(normalise_archives(raw, f"{folder}/normalised", level), "normalised")
    out = materialise(read_archives(done, bodies), "records")
    drop(raw, done, folder=folder)
    return out
