"""WARC archives with a two-level capture index.

Pages are written as gzip members of WARC records, an archive file for each
task. The captures are range-sorted by reversed-host URL key and cut into
compressed blocks, an index file for each range; beside it, a sparse directory
keeps the first and last key of each block. A lookup finds the index file of a
key, binary-searches its directory, reads the ranges of the blocks it needs, and
then the ranges of the records they name.

Tasks write and read these files through pyarrow's file systems, so the folder
may lie in any store that these and Spark both reach. A file's name is unique to
the attempt that wrote it, and only names that a finished task returned are ever
read: a task that runs twice or is lost leaves a file that nothing names.
"""

from __future__ import annotations

import bisect
import gzip
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.llm.common import scratch_path, written

#: Payloads of fewer bytes are never written as revisits.
LEAST_REVISIT = 1000
#: Captures in a block of the index.
BLOCK = 1000
#: Date of the records, a parameter of the archive so that reruns agree.
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Folder of an archive: warc/ and index/ hold the files, index.parquet a row
    for each index file (file, first_key, last_key)."""

    path: str

    def index(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/index.parquet")


def url_key(url: str) -> str:
    """The URL with its host reversed, lower case, without scheme, user, port of
    the scheme and fragment: http://www.b.org:80/x?y -> org,b,www)/x?y."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.strip()
    if not host:
        return url.strip()
    at = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme.lower()) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{at}){parts.path or '/'}{query}"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _clean(value: str) -> str:
    """A header value: no line ends, which would end the header."""
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzip member that holds one WARC record. A revisit has the HTTP head of
    its response, Content-Length included, and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}:{digest}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        f"Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers with lower-case names, HTTP head, payload) of a gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    http, _, payload = rest[: int(headers["content-length"])].partition(b"\r\n\r\n")
    return headers, http, payload


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, refers_to): of pages with equal payloads of at
    least ``least`` bytes all but that with the largest page_id refer to it. Null
    texts are empty. Pages that share that page_id and payload are all responses;
    a page with a null page_id refers to it if there is one."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= least
    first = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    # written, so that the pages of one digest, of which there may be any number, can be split over tasks and files
    first = written(first.where("n > 1").select(F.col("digest").alias("d"), "first"), "digests")
    joined = rows.join(first, F.col("digest") == F.col("d"), "left")
    other = F.coalesce(F.col("page_id") != F.col("first"), F.lit(True))
    return joined.select("page_id", "url", "html", "digest", F.when(large & other, F.col("first")).alias("refers_to"))


_CAPTURES = "key string, page_id long, file string, offset long, length long"


def write_archive(pages: DataFrame, path: str | None = None, block: int = BLOCK) -> Archive:
    """Write a record for every row of ``pages`` (page_id, url, html, ...) below
    ``path`` (a new scratch folder by default), and the index over them."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(path)
        name, at, out = f"warc/{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                if out is None and batch.num_rows:
                    files.create_dir(f"{root}/warc", recursive=True)
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                rows = []
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    member = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)
                    out.write(member)
                    rows.append((url_key(url), page_id, name, at, len(member)))
                    at += len(member)
                yield _batch(rows, _CAPTURES)
        finally:
            if out is not None:
                out.close()

    captures_at = f"{path}/captures.parquet"
    with_revisits(pages).mapInArrow(write, _CAPTURES).write.parquet(captures_at)
    captures = spark.read.parquet(captures_at)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(path)
        name, at, out, held, directory = f"index/{uuid.uuid4().hex}", 0, None, [], []

        def flush() -> None:
            nonlocal at, out
            if out is None:
                files.create_dir(f"{root}/index", recursive=True)
                out = files.open_output_stream(f"{root}/{name}.gz", compression=None)
            member = _packed(held, _CAPTURES)
            out.write(member)
            directory.append((held[0][0], held[-1][0], at, len(member)))
            at += len(member)
            held.clear()

        try:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    held.append(row)
                    if len(held) == block:
                        flush()
            if held:
                flush()
        finally:
            if out is not None:
                out.close()
        if directory:
            with files.open_output_stream(f"{root}/{name}.directory", compression=None) as sink:
                sink.write(_packed(directory, _DIRECTORY))
            yield _batch([(name, directory[0][0], directory[-1][1])], _INDEX)

    ranged = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    ranged.mapInArrow(index, _INDEX).write.parquet(f"{path}/index.parquet")
    return Archive(path)


def _packed(rows: list[tuple], schema: str) -> bytes:
    """A gzip member that holds the rows as an Arrow stream."""
    table = pa.Table.from_batches([_batch(rows, schema)])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return gzip.compress(sink.getvalue(), 6, mtime=0)


def _unpacked(member: bytes) -> Iterator[tuple]:
    columns = pa.ipc.open_stream(gzip.decompress(member)).read_all().columns
    return zip(*(c.to_pylist() for c in columns))


_INDEX = "file string, first_key string, last_key string"
_DIRECTORY = "first_key string, last_key string, offset long, length long"
_TYPES = {"string": pa.string(), "long": pa.int64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds)], names=list(names))


def _reaching(firsts: list[bytes], lasts: list[bytes], key: bytes) -> Iterator[int]:
    """Places of the ranges, in key order, that may hold a key, by binary search."""
    at = bisect.bisect_right(firsts, key) - 1  # the last that starts at or before it
    while at >= 0 and lasts[at] >= key:
        yield at
        at -= 1


def _coded(key: str) -> bytes:
    return key.encode("utf-8", "surrogatepass")


def lookup(archive: Archive, urls: DataFrame) -> DataFrame:
    """Captures (key, page_id, file, offset, length) of every distinct key of
    ``urls`` (url).

    A key is sent to the index files whose range holds it; of those there are at
    most as many as the index had partitions, so their ranges go with the task.
    The task of an index file binary-searches the file's directory of blocks for
    its keys, which come sorted, and reads the range of each block once.
    """
    listed = [tuple(r) for r in archive.index(urls.sparkSession).select("file", "first_key", "last_key").collect()]
    listed.sort(key=lambda r: (_coded(r[1]), _coded(r[2]), r[0]))
    firsts, lasts = [_coded(r[1]) for r in listed], [_coded(r[2]) for r in listed]
    names = [r[0] for r in listed]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(url_key(u or ""),) for u in batch.column(0).to_pylist()], "key string")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, names[i]) for k in batch.column(0).to_pylist() for i in _reaching(firsts, lasts, _coded(k))]
            yield _batch(rows, "key string, file string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(archive.path)
        now, blocks, starts, ends, source, held = None, [], [], [], None, (None, {})
        for batch in batches:
            rows = []
            for key, file in zip(*(c.to_pylist() for c in batch.columns)):
                if now != file:
                    if source is not None:
                        source.close()
                    with files.open_input_stream(f"{root}/{file}.directory", compression=None) as d:
                        blocks = list(_unpacked(d.read()))
                    starts, ends = [_coded(b[0]) for b in blocks], [_coded(b[1]) for b in blocks]
                    now, source, held = file, files.open_input_file(f"{root}/{file}.gz"), (None, {})
                for i in _reaching(starts, ends, _coded(key)):
                    if held[0] != i:
                        found: dict[str, list[tuple]] = {}
                        for row in _unpacked(source.read_at(blocks[i][3], blocks[i][2])):
                            found.setdefault(row[0], []).append(row)
                        held = (i, found)
                    rows += held[1].get(key, [])
            yield _batch(rows, _CAPTURES)
        if source is not None:
            source.close()

    wanted = urls.select("url").mapInArrow(keys, "key string").distinct().mapInArrow(send, "key string, file string")
    return wanted.repartition("file").sortWithinPartitions("file", "key").mapInArrow(read, _CAPTURES)


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(archive: Archive, captures: DataFrame) -> DataFrame:
    """What the records of ``captures`` (page_id, file, offset, length) say:
    page_id, payload_bytes and payload_digest of the full payload, record_type
    and refers_to. Ranges of a file are read in order. The digest of a response
    is taken from its payload and compared with the header."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        files, root = _files(archive.path)
        now, source = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if now != file:
                    if source is not None:
                        source.close()
                    now, source = file, files.open_input_file(f"{root}/{file}")
                headers, http, payload = parse(source.read_at(length, offset))
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                n = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1])
                if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != n):
                    raise OSError(f"damaged record at {offset} of {file}")
                page, refers = headers["page-id"], headers.get("warc-refers-to-page-id")
                rows.append((int(page) if page else None, n, digest, kind, int(refers) if refers else None))
            yield _batch(rows, _READ)
        if source is not None:
            source.close()

    where = captures.select("file", "offset", "length").repartition("file", F.expr("offset div 33554432"))
    return where.sortWithinPartitions("file", "offset").mapInArrow(read, _READ)


def op9_warc(pages: DataFrame) -> DataFrame:
    """Write all pages, look every URL up in the index and read its records back:
    (page_id, payload_bytes, payload_digest, record_type, refers_to). Null texts
    are empty payloads, null URLs empty ones; see ``with_revisits`` for ties and
    null page_ids. Other columns are ignored; an empty table gives an empty table."""
    archive = write_archive(pages)
    return read_records(archive, lookup(archive, pages.select("url")))


OP9_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT payload_digest AS d, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON payload_digest = d
"""
