"""WARC archives: writing, normalising monolithic gzip streams, reading by offset.

``write_archives`` writes one gzip stream per task (the monolithic form that
many crawls ship).  ``normalise`` inflates such a stream once, from its start
to its end, rewrites every record as a gzip member of its own and writes a
sidecar index of offsets (one JSON line a record).  ``read_records`` then
reads members by offset, in parallel inside an archive too.  Files are written
under names of their own by each task attempt and count only if the attempt's
manifest row was committed, so lost executors and repeated tasks do no harm.

Payloads of at least ``least`` bytes are kept once: the record with the
smallest page id is the response, the others revisit it.

Defined results: a null payload is empty; a null url leaves the field out;
line breaks in a url are percent-encoded; rows that repeat the smallest page
id are all responses; where every copy lacks an id, each is a response; an
empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunesift.llm.common import n_partitions, shared_path, ship, stored

ship(__name__)

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16
#: Bytes of an archive that one read task takes.
READ_SPAN = 16 << 20


def _filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def _make(uri: str) -> None:
    files, path = _filesystem(uri)
    files.create_dir(path, recursive=True)


def record(kind: str, page_id, url, payload: bytes, digest: str, length: int, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    fields = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    fields.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_roles(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """(page_id, url, payload, digest, n_bytes, response): ``response`` is the page a revisit refers to, else null.

    The smallest id of each payload is a partial aggregate over digests; pages
    join it by digest, which adaptive execution splits where one payload is frequent.
    """
    raw = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        raw.alias("payload"), F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("long").alias("n_bytes"))
    first = rows.filter(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")) \
        .filter("n > 1").drop("n")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, "digest", "left").select(
        "page_id", "url", F.when(~other, F.col("payload")).alias("payload"), "digest", "n_bytes", F.when(other, F.col("first")).alias("response"))


def write_archives(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """(archive, records): one monolithic .warc.gz per partition of ``with_roles`` rows."""
    _make(folder)

    def run(batches):
        files = out = None
        n = 0
        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        for b in batches:
            for i in range(b.num_rows):
                page_id, url, payload, digest, length, response = (b.column(c)[i].as_py() for c in range(6))
                if out is None:
                    files, path = _filesystem(name)
                    out = files.open_output_stream(path, compression=None)
                kind = "response" if response is None else "revisit"
                out.write(packer.compress(record(kind, page_id, url, payload or b"", digest, length, response, date)))
                n += 1
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["archive", "records"])

    return stored(rows.mapInArrow(run, "archive string, records long"), "warc-archives")


class Inflated:
    """The bytes of a gzip file (one member or many) in order, held a chunk at a time."""

    def __init__(self, raw):
        self.raw, self.held, self.end = raw, bytearray(), False
        self.packer = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.end:
            return False
        data = self.packer.unused_data if self.packer.eof else self.packer.unconsumed_tail
        data = data or self.raw.read(CHUNK)
        if not data:
            self.end = True
            if not self.packer.eof:
                raise ValueError("gzip stream ends inside a member")
            return False
        if self.packer.eof:
            self.packer = zlib.decompressobj(31)
        self.held += self.packer.decompress(data, CHUNK)
        return True

    def line(self) -> bytes:
        """Up to and with the next line feed; empty at the end."""
        seen = 0
        while True:
            at = self.held.find(b"\n", seen)
            if at >= 0:
                return self._take(at + 1)
            seen = len(self.held)
            if not self._more():
                return self._take(len(self.held))

    def some(self, n: int) -> bytes:
        """Up to n bytes; none at the end only."""
        while not self.held and self._more():
            pass
        return self._take(min(n, len(self.held)))

    def _take(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def headers(stream: Inflated) -> tuple[bytes, dict[str, str]] | None:
    """The next record's head as it stands, and its fields by lower-case name."""
    line = stream.line()
    while line in (b"\r\n", b"\n"):
        line = stream.line()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    head, fields = [line], {}
    while line not in (b"\r\n", b"\n"):
        line = stream.line()
        if not line:
            raise ValueError("WARC head ends early")
        head.append(line)
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return b"".join(head), fields


def normalise_stream(raw, out, level: int = 6):
    """Rewrite a WARC stream record by record; yields (fields, offset, length) of each member written."""
    stream, at = Inflated(raw), 0
    while (found := headers(stream)) is not None:
        head, fields = found
        packer, start = zlib.compressobj(level, zlib.DEFLATED, 31), at
        left = int(fields["content-length"])
        parts = [packer.compress(head)]
        while left:
            data = stream.some(min(left, CHUNK))
            if not data:
                raise ValueError("WARC block ends early")
            left -= len(data)
            parts.append(packer.compress(data))
            if sum(map(len, parts)) >= CHUNK:
                at += out.write(b"".join(parts))
                parts = []
        parts += [packer.compress(b"\r\n\r\n"), packer.flush()]
        at += out.write(b"".join(parts))
        yield fields, start, at - start


INDEX = "archive string, offset long, length long, record_id string, type string, uri string"


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """The offset index (``INDEX``) of archives rewritten under ``folder``: warc/*.warc.gz and index/*.jsonl.

    Needs the column ``archive``: files of whole-file gzip streams.  A task
    rewrites one archive after another, a chunk in memory at a time.
    """
    for part in ("warc", "index"):
        _make(f"{folder}/{part}")

    def run(batches):
        for b in batches:
            for archive in b.column("archive").to_pylist():
                name = uuid.uuid4().hex
                target = f"{folder}/warc/{name}.warc.gz"
                files, path = _filesystem(archive)
                into, out_path = _filesystem(target)
                _, side_path = _filesystem(f"{folder}/index/{name}.jsonl")
                n = 0
                with files.open_input_stream(path, compression=None) as raw, into.open_output_stream(out_path, compression=None) as out, \
                        into.open_output_stream(side_path, compression=None) as side:
                    for fields, offset, length in normalise_stream(raw, out, level):
                        side.write(json.dumps({"archive": target, "offset": offset, "length": length, "record_id": fields.get("warc-record-id"),
                                               "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri")}).encode() + b"\n")
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())], names=["archive", "records"])

    names = archives.select("archive")
    done = stored(names.repartition(max(1, names.count())).mapInArrow(run, "archive string, records long"), "warc-members")
    index = archives.sparkSession.read.schema(INDEX).json(f"{folder}/index")
    return index.join(done.select("archive"), "archive", "left_semi")


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), each record read at its offset.

    A response's payload is inflated, counted and hashed; a revisit's length
    and digest are those its head states.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def urn(value):
        digits = (value or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches):
        held = (None, None)
        for b in batches:
            out = []
            for archive, offset, length in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if held[0] != archive:
                    files, path = _filesystem(archive)
                    held = (archive, files.open_input_file(path))
                data = zlib.decompress(held[1].read_at(length, offset), 31)
                head, _, block = data.partition(b"\r\n\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
                http, _, payload = block[:int(fields["content-length"])].partition(b"\r\n\r\n")
                if fields["warc-type"] == "revisit":
                    size = int(http.decode().lower().partition("content-length:")[2].split("\r\n")[0])
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                else:
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if digest != fields["warc-payload-digest"].removeprefix("sha256:"):
                        raise ValueError(f"payload of {fields['warc-record-id']} in {archive} is damaged")
                out.append((urn(fields["warc-record-id"]), size, digest, fields["warc-type"], urn(fields.get("warc-refers-to"))))
            cols = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    n = n_partitions(index.sparkSession)
    spans = index.select("archive", "offset", "length", F.floor(F.col("offset") / READ_SPAN).alias("span")) \
        .repartition(n, "archive", "span").sortWithinPartitions("archive", "offset")
    return stored(spans.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), "warc-read")


def round_trip(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               least: int = 100) -> DataFrame:
    """Write pages as monolithic archives, normalise those, and read every record back through the sidecar index."""
    archives = write_archives(with_roles(pages, id_col, url_col, payload_col, least), f"{folder}/monolithic")
    return read_records(normalise(archives, folder))


def op7_warc_normalise(spark, sf):
    return round_trip(spark.read.parquet(f"{sf}/pages.parquet"), shared_path(spark, "warc"))


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
r AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN p.n >= 100 AND p.page_id <> r.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.n >= 100 AND p.page_id <> r.first THEN r.first END AS refers_to
FROM p LEFT JOIN r ON p.d = r.d
"""
