"""WARC archives: writing, normalising monolithic gzip, indexed reading.

Some producers compress a whole archive as one gzip stream; nothing in it can be
reached without inflating all before it.  The normaliser inflates such a stream once,
in pieces, and rewrites every record as a gzip member of its own beside a sidecar
index (one line a record: offset, length, type, record id, payload digest), through
which readers fetch single records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import own_exchange
from .storage import attempt, drop, materialize, open_input, scratch, write_atomically

VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"
PIECE = 1 << 20
#: Uncompressed bytes after which a new archive begins.
ARCHIVE_BYTES = 256 << 20
#: Equal payloads of at least so many bytes are written once.
REVISIT_MIN_BYTES = 0


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> bytes:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in value).encode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, serial: str) -> bytes:
    """One WARC record with its closing blank lines; a revisit holds the HTTP head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if is_revisit else head + payload
    lines = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if is_revisit else b"response"),
        b"WARC-Record-ID: <urn:page:%s>" % serial.encode(),
        b"WARC-Date: " + DATE,
        b"WARC-Payload-Digest: sha1:" + digest_of(payload).encode(),
        b"Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _line(url))
    if page_id is not None:
        lines.append(b"X-Page-ID: %d" % page_id)
    if is_revisit:
        lines += [b"WARC-Profile: " + PROFILE, b"X-Refers-To-Page-ID: %d" % refers_to]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> tuple[bytes, dict[bytes, bytes]]:
    first, *rest = raw.split(b"\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in rest)}


def inflate(stream) -> Iterator[bytes]:
    """Inflated pieces of a gzip stream of one or many members; a cut stream is an error."""
    z = None
    while True:
        data = stream.read(PIECE)
        if not data:
            break
        while data:
            z = z or zlib.decompressobj(31)
            out = z.decompress(data, PIECE)
            if out:
                yield out
            if z.eof:
                data, z = z.unused_data, None
            else:
                data = z.unconsumed_tail
    if z is not None:
        yield z.flush()
        if not z.eof:
            raise EOFError("gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a WARC byte stream; holds one record and one piece at a time."""
    buf = bytearray()
    at, need = 0, -1
    for piece in pieces:
        buf += piece
        while True:
            if need < 0:
                end = buf.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                version, head = _headers(bytes(buf[at:end]))
                if not version.startswith(b"WARC/"):
                    raise ValueError(f"not a WARC record: {version[:20]!r}")
                need = end + 4 + int(head[b"content-length"]) + 4
            if len(buf) < need:
                break
            yield bytes(buf[at:need])
            at, need = need, -1
        if at > PIECE or at == len(buf):
            del buf[:at]
            need, at = need - at if need >= 0 else need, 0
    if len(buf) > at:
        raise EOFError("WARC stream ends inside a record")


def split_record(record: bytes) -> tuple[dict[bytes, bytes], dict[bytes, bytes], bytes]:
    """WARC headers, HTTP headers and body."""
    raw, _, rest = record.partition(b"\r\n\r\n")
    _, head = _headers(raw)
    block = rest[: int(head[b"content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return head, _headers(http)[1], body


def normalize_archive(source: str, target: str) -> tuple[int, int]:
    """Rewrite an archive with a member for each record and ``target + '.idx'`` beside it; (records, bytes)."""
    index: list[bytes] = []
    total = 0

    def write(out):
        nonlocal total
        stream = open_input(source)
        for record in records(inflate(stream)):
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = z.compress(record) + z.flush()
            out.write(member)
            head = _headers(record.partition(b"\r\n\r\n")[0])[1]
            index.append(b"%d %d %s %s %s\n" % (total, len(member), head[b"warc-type"], head[b"warc-record-id"], head.get(b"warc-payload-digest", b"-")))
            total += len(member)
        stream.close()

    write_atomically(target, write)
    write_atomically(f"{target}.idx", lambda out: out.write(b"".join(index)))
    return len(index), total


def read_index(uri: str) -> list[tuple[int, int, str, str, str]]:
    stream = open_input(f"{uri}.idx")
    lines = stream.read().decode().splitlines()
    stream.close()
    return [(int(a), int(b), kind, rid, digest) for a, b, kind, rid, digest in (x.split(" ") for x in lines)]


def _writer(folder: str):
    def run(batches):
        own, n, held = attempt(), 0, 0
        rows = (r for b in batches for at in range(0, b.num_rows, 128) for r in zip(*(c.to_pylist() for c in b.slice(at, 128).columns), strict=True))
        row = next(rows, None)
        while row is not None:
            uri = f"{folder}/raw/{own}-{n:06d}.warc.gz"
            held = 0

            def write(out):
                nonlocal row, held
                z = zlib.compressobj(4, zlib.DEFLATED, 31)
                while row is not None and held < ARCHIVE_BYTES:
                    page_id, url, html, refers_to, is_revisit = row
                    record = build_record(page_id, url, (html or "").encode(), refers_to, is_revisit, f"{'none' if page_id is None else page_id}:{own}:{n}:{held}")
                    held += len(record)
                    out.write(z.compress(record))
                    row = next(rows, None)
                out.write(z.flush())

            write_atomically(uri, write)
            yield pa.RecordBatch.from_pydict({"uri": [uri]})
            n += 1

    return run


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_min_bytes: int = REVISIT_MIN_BYTES) -> DataFrame:
    """One record per row into archives of one gzip stream each; returns their ``uri``.

    Of rows with equal payloads of at least ``revisit_min_bytes`` that with the least
    id is a response, the others revisit it.  A null payload is empty.  Null ids come
    after all others; where a group has no id, all are responses; repeated rows of the
    least id are responses both.  Other columns are ignored; an empty table gives no
    archive.  Who revisits whom is settled on ids and hashes alone; pages meet only
    with the verdict on their own id and hash, so a page that very many rows hold is
    never gathered.  Archives are named by task attempt and listed by the attempt that
    was committed, whatever order its rows came in: what a lost or slower attempt leaves
    is not read.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha"))
    lean = rows.where(F.octet_length("html") >= revisit_min_bytes).select("sha", "id")
    same = lean.groupBy("sha").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1 AND least IS NOT NULL").select("sha", "least")
    verdict = lean.distinct().join(own_exchange(same, "sha"), "sha").where("NOT id <=> least")
    verdict = own_exchange(verdict.select(F.col("sha").alias("vsha"), F.col("id").alias("vid"), "least"), "vsha", "vid")
    joined = rows.join(verdict, (F.col("sha") == F.col("vsha")) & F.col("id").eqNullSafe(F.col("vid")), "left")
    is_revisit = F.col("least").isNotNull()
    # a revisit needs the length of its payload and the digest, which are taken from the page itself
    records = joined.select("id", "url", "html", "least", is_revisit)
    return materialize(records.mapInArrow(_writer(folder), "uri string"), "archives")


def _normalizer(batches):
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            target = uri.replace("/raw/", "/members/")  # equal bytes in every attempt: an archive is rewritten as it stands
            n, size = normalize_archive(uri, target)
            yield pa.RecordBatch.from_pydict({"uri": pa.array([target]), "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})


def normalize_archives(archives: DataFrame, keep_source: bool = True) -> DataFrame:
    """Normalise every archive; ``(uri, n_records, n_bytes)`` of the new files.

    Without ``keep_source`` the folders that held the archives are deleted once all new files are written.
    """
    spark = archives.sparkSession
    n = max(1, min(archives.count(), 1_000_000))
    out = materialize(archives.repartition(n, "uri").mapInArrow(_normalizer, "uri string, n_records long, n_bytes long"), "members")
    if not keep_source:
        folders = archives.select(F.regexp_replace("uri", "/[^/]*$", "").alias("folder")).distinct().limit(1000).collect()  # one for each call of write_archives
        drop(spark, [r["folder"] for r in folders])
    return out


def _reader(batches):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            stream, rows = open_input(uri), []
            for offset, length, kind, _, _ in read_index(uri):
                stream.seek(offset)
                head, http, body = split_record(zlib.decompress(stream.read(length), 31))
                number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                if kind == "revisit":
                    size, digest = int(http[b"content-length"]), head[b"warc-payload-digest"].decode().removeprefix("sha1:")
                else:
                    size, digest = len(body), digest_of(body)
                rows.append((number(b"x-page-id"), size, digest, kind, number(b"x-refers-to-page-id")))
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            stream.close()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_archives(members: DataFrame) -> DataFrame:
    """A row per record, read through the sidecar indexes; lengths and digests are those of the full payload."""
    n = max(1, min(members.count(), 1_000_000))
    return members.select("uri").repartition(n, "uri").mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
