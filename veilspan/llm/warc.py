"""WARC archives: write pages, resolve revisits by payload digest, write the archives anew without repeated payloads, read them back.

* ``capture`` writes one response record for each page and yields its header row: archive, offset, length, id,
  payload digest and size.  ``scan`` yields the same rows from archives that exist already.
* ``resolve`` shuffles header rows (never payloads) by payload digest.  Of the responses of one digest the one of the
  smallest id stays; the others become revisits of it, and revisit records that came in are joined to it.
* ``rewrite`` deals the verdicts by archive; a task reads the records of its archives by offset and writes new archives
  with fresh headers, where a revisit holds no payload but refers to the record of its response.

Archives are gzip members, one a record, in files of about ``ARCHIVE_BYTES`` of payload.  A task writes under names of
its own, and a file counts only if the table that the task's job commits names it, so attempts that
were lost or run twice leave nothing behind that is read.  A payload is held one record at a time.
Paths are opened with ``pyarrow.fs``, so a folder may be local, HDFS or an object store.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.storage import written
from veilspan.llm.text import raw
from veilspan.session import work_folder

ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 20_000
LEVEL = 3  # of gzip
SMALLEST = 100  # payloads of fewer bytes are stored each time
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 18

HEADER = "archive string, offset long, length long, type string, id string, url string, digest binary, bytes long"
READ = HEADER + ", record_id string, refers_to string, actual binary, stored long"
FILE = "archive string, records long"


def _coded(value: bytes, also: bytes = b"") -> bytes:
    """A header value on one line: control characters, and those of ``also``, are percent-coded."""
    return b"".join(b"%%%02X" % c if c < 32 or c == 127 or c in also else bytes((c,)) for c in value)


def _decoded(value: bytes) -> str:
    return unquote_to_bytes(value).decode()


def record(kind: bytes, record_id: str, block: bytes, date: str, fields: list[tuple[bytes, bytes | None]]) -> bytes:
    """One gzip member; fields without a value are left out."""
    lines = [(b"WARC-Type", kind), (b"WARC-Record-ID", b"<" + record_id.encode() + b">"), (b"WARC-Date", date.encode()), *fields,
             (b"Content-Length", b"%d" % len(block))]
    head = b"WARC/1.1\r\n" + b"".join(k + b": " + _coded(v) + b"\r\n" for k, v in lines if v is not None)
    packed = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packed.compress(head + b"\r\n") + packed.compress(block) + packed.compress(b"\r\n\r\n") + packed.flush()


def parsed(member: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Header fields (names in lower case) and block of an unpacked record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines[1:])}
    size = int(fields[b"content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a gzip member must hold one whole record")
    return fields, rest[:size]


def record_id(archive: str, offset: int) -> str:
    """The id of the record that is made from the one at this place."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}"


class _Writer:
    """Archives of one task, a new file when the last one is full; ``done`` are the closed ones."""

    def __init__(self, folder: str, date: str):
        self.folder, self.date = folder, date
        self.files, self.base = fs.FileSystem.from_uri(folder)
        self.out, self.done = None, []

    def put(self, member: bytes, size: int) -> tuple[str, int]:
        if self.out and (self.size + size > ARCHIVE_BYTES or self.count >= ARCHIVE_RECORDS):
            self.close()
        if not self.out:
            name = f"{uuid.uuid4().hex}.warc.gz"
            self.files.create_dir(self.base, recursive=True)
            self.out = self.files.open_output_stream(f"{self.base}/{name}", compression=None)
            self.archive, self.at, self.size, self.count = f"{self.folder}/{name}", 0, 0, 0
            info = record(b"warcinfo", f"urn:uuid:{uuid.uuid4()}", b"format: WARC File Format 1.1\r\n", self.date,
                          [(b"Content-Type", b"application/warc-fields")])
            self.at += self.out.write(info)
        place = self.archive, self.at
        self.at += self.out.write(member)
        self.size, self.count = self.size + size, self.count + 1
        return place

    def close(self):
        if self.out:
            self.out.close()
            self.done.append((self.archive, self.count))
            self.out = None


def _fields(kind: bytes, page: bytes | None, url: bytes | None, digest: bytes, size: int, refers: str | None = None):
    more = [(b"WARC-Refers-To", b"<" + refers.encode() + b">" if refers else None), (b"WARC-Profile", PROFILE)] if kind == b"revisit" else []
    return [(b"WARC-Target-URI", url), (b"X-Page-ID", None if page is None else _coded(page, b" %")), (b"WARC-Payload-Digest", b"sha256:" + digest.hex().encode()),
            (b"X-Payload-Length", b"%d" % size), *more, (b"Content-Type", b"text/html; charset=utf-8")]


def _table(rows: list[tuple], like: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in like.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def capture(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
            date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes every page as a response and returns the header rows (written).

    A null payload counts as empty; null ids and urls leave their header out; repeated rows are records of their own;
    no pages make no archive.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, date)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part, rows = batch.slice(start, 512), []
                ids, urls = part.column(0).to_pylist(), part.column(1).to_pylist()
                for i, u, payload in zip(ids, urls, raw(part.column(2))):
                    digest = hashlib.sha256(payload).digest()
                    head = _fields(b"response", None if i is None else i.encode(), None if u is None else u.encode(), digest, len(payload))
                    member = record(b"response", f"urn:uuid:{uuid.uuid4()}", payload, date, head)
                    archive, offset = out.put(member, len(payload))
                    rows.append((archive, offset, len(member), "response", i, u, digest, len(payload)))
                yield _table(rows, HEADER)
        out.close()

    return written(pages.select(F.col(page_id).cast("string").alias("id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
                   .mapInArrow(run, HEADER))


def members(archive: str) -> Iterator[tuple[int, int, bytes]]:
    """``(offset, length, record)`` of each gzip member, read in chunks."""
    files, path = fs.FileSystem.from_uri(archive)
    with files.open_input_stream(path, compression=None) as source:
        data, offset = source.read(CHUNK), 0
        while data:
            unpack, parts, length = zlib.decompressobj(31), [], 0
            while not unpack.eof:
                if not data:
                    raise ValueError(f"{archive} ends within a record")
                parts.append(unpack.decompress(data))
                length += len(data) - len(unpack.unused_data)
                data = unpack.unused_data or source.read(CHUNK)
            yield offset, length, b"".join(parts)
            offset += length


def scan(archives: DataFrame, parts: int | None = None) -> DataFrame:
    """Header rows of all records but ``warcinfo`` in ``archives`` ``(archive)``, with the digest of what is stored (``actual``)."""
    unbracketed = lambda x: None if x is None else x.strip(b"<>").decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                for offset, length, member in members(archive):
                    head, block = parsed(member)
                    kind, page, url = head[b"warc-type"].decode(), head.get(b"x-page-id"), head.get(b"warc-target-uri")
                    if kind == "warcinfo":
                        continue
                    size = int(head.get(b"x-payload-length", b"%d" % len(block)))
                    declared = head.get(b"warc-payload-digest", b"").removeprefix(b"sha256:")
                    actual = hashlib.sha256(block).digest()
                    rows.append((archive, offset, length, kind, None if page is None else _decoded(page), None if url is None else url.decode(),
                                 bytes.fromhex(declared.decode()) if declared else actual, size,
                                 unbracketed(head[b"warc-record-id"]), unbracketed(head.get(b"warc-refers-to")), actual, len(block)))
                    if len(rows) == 1024:
                        yield _table(rows, READ)
                        rows = []
                yield _table(rows, READ)

    spread = archives.select("archive").distinct()
    return spread.repartition(parts or _spread(spread)).mapInArrow(run, READ)


def _spread(archives: DataFrame) -> int:
    """As many partitions as archives, up to 20,000: an archive is a small row but much work."""
    return max(1, min(20_000, archives.count()))


def resolve(headers: DataFrame, smallest: int = SMALLEST, order: str = "long") -> DataFrame:
    """``headers`` with ``original`` ``(archive, offset, id)``: the response that the record repeats, null for those that stay as they are.

    Among responses of one digest the smallest id counts (as ``order``; null after all others), of equal ids the first place.
    Payloads under ``smallest`` bytes are no repeats.  A revisit whose response is not there keeps no original.
    """
    me = F.struct(F.col("id").isNull().alias("none"), F.col("id").cast(order).alias("order"), "archive", "offset", "id")
    large = headers.filter(F.col("bytes") >= smallest)
    first = large.filter("type = 'response'").groupBy("digest").agg(F.min(me).alias("first"))
    met = headers.join(first, "digest", "left")
    own = (F.col("archive") == F.col("first.archive")) & (F.col("offset") == F.col("first.offset"))
    repeat = (F.col("bytes") >= smallest) & F.col("first").isNotNull() & ~own
    return met.withColumn("original", F.when(repeat, F.struct("first.archive", "first.offset", "first.id"))).drop("first")


def rewrite(verdicts: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", parts: int | None = None) -> DataFrame:
    """New archives ``(archive, records)`` (written) in which every repeat of a payload is a revisit with fresh headers.

    A revisit record without an original stays one and refers to nothing.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("offset").to_pylist()
        files, path = fs.FileSystem.from_uri(rows[0]["archive"])
        out = _Writer(folder, date)
        with files.open_input_file(path) as source:
            for r in rows:
                page, url = (None if r[k] is None else r[k].encode() for k in ("id", "url"))
                repeat = r["original"] is not None or r["type"] == "revisit"
                kind, block = (b"revisit", b"") if repeat else (b"response", None)
                if block is None:
                    source.seek(r["offset"])
                    block = parsed(zlib.decompress(source.read(r["length"]), 31))[1]
                first = r["original"]
                refers = record_id(first["archive"], first["offset"]) if first else None
                head = _fields(kind, page, url, r["digest"], r["bytes"], refers)
                out.put(record(kind, record_id(r["archive"], r["offset"]), block, date, head), len(block))
        out.close()
        return pa.Table.from_batches([_table(out.done, FILE)])

    place = F.when(F.col("original").isNotNull(), F.struct("original.archive", "original.offset")).alias("original")
    dealt = verdicts.select("archive", "offset", "length", "type", "id", "url", "digest", "bytes", place)
    parts = parts or _spread(verdicts.select("archive").distinct())
    return written(dealt.repartition(parts, "archive").groupBy("archive").applyInArrow(run, FILE))


def deduplicated(headers: DataFrame, folder: str, smallest: int = SMALLEST, order: str = "long") -> DataFrame:
    """The archives of ``headers`` written anew without repeated payloads; returns ``(archive, records)``."""
    return rewrite(resolve(headers, smallest, order), folder)


def read_back(archives: DataFrame) -> DataFrame:
    """``(id, bytes, digest, type, refers_to, intact)`` of every record; a revisit takes bytes and digest from the response it refers to.

    ``refers_to`` is the response's id.  ``intact`` tells whether the stored payload has the digest that the record declares.
    """
    read = written(scan(archives))
    payload = read.filter("type = 'response'").select(F.col("record_id").alias("to"), F.col("id").alias("to_id"),
                                                      F.col("actual").alias("to_digest"), F.col("stored").alias("to_bytes"))
    responses = read.filter("type = 'response'").select(
        "id", F.col("stored").alias("bytes"), F.col("actual").alias("digest"), "type", F.lit(None).cast("string").alias("refers_to"), (F.col("actual") == F.col("digest")).alias("intact"))
    revisits = read.filter("type = 'revisit'").join(payload, F.col("refers_to") == F.col("to"), "left").select(
        "id", F.col("to_bytes").alias("bytes"), F.col("to_digest").alias("digest"), "type", F.col("to_id").alias("refers_to"),
        (F.col("to_digest").eqNullSafe(F.col("digest"))).alias("intact"))
    return responses.union(revisits)


def warc_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", smallest: int = SMALLEST) -> DataFrame:
    """Pages written as archives, deduplicated and read back: a row of ``read_back`` for each page."""
    spark = pages.sparkSession
    order = "long" if dict(pages.dtypes)[page_id] in ("tinyint", "smallint", "int", "bigint") else "string"
    headers = capture(pages, work_folder(spark, "warc-in"), page_id, url, html)
    return read_back(deduplicated(headers, work_folder(spark, "warc"), smallest, order))
