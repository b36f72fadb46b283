"""Legacy archive converter: ARC files of version 1 and 2 to WARC 1.1.

An ARC file starts with a version block, whose content says which version it is and so which fields the header lines of
its records have. A record is its header line and as many bytes as the line declares. The converter gives each record
what WARC asks for and ARC lacks: an identifier (UUID of file and place, so that a rerun agrees), a timestamp with
time zone, a record type, block and payload digests. Records with equal payloads can be written as revisits.

Payloads never move between executors: they are read where they are archived, and only digests and decisions shuffle.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import fs_write, lean, materialize, open_fs, scratch, slices

#: Fields of a record's header line, by version of the file (fixed values of the format).
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of content after which an archive is closed and the next one begun.
ROLL = 64 << 20
DATE = "20000101000000"


#: The empty line that ends a header block; old servers ended lines with LF alone.
_GAP = re.compile(rb"\r?\n\r?\n")


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Header block (with the empty line that ends it) and payload of an HTTP message; all is header if no line is empty."""
    gap = _GAP.search(content)
    at = gap.end() if gap else len(content)
    return content[:at], content[at:]


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _token(x: str) -> str:
    """A header field has no white space."""
    return "".join(c if not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in x) or "-"


# ARC ---------------------------------------------------------------------------------------------------------------


def arc_start(version: int, name: str, date: str = DATE) -> bytes:
    body = f"{version} 0 lexiloom\n{ARC_TITLES[version]}\n\n".encode()
    return arc_record(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", body, name)


def arc_record(version: int, url: str, ip: str, date: str, kind: str, content: bytes, name: str = "-", status: str = "200") -> bytes:
    head = [_token(url), ip, date, kind]
    if version == 2:
        head += [status, base64.b32encode(hashlib.sha1(content).digest()).decode(), "-", "0", _token(name)]
    return " ".join([*head, str(len(content))]).encode() + b"\n" + content + b"\n"


@dataclass
class ArcRecord:
    ordinal: int
    version: int
    fields: dict[str, str]
    content: bytes

    @property
    def http(self) -> tuple[bytes, bytes] | None:
        """Header block and payload if the content is an HTTP response."""
        return split_http(self.content) if self.content.startswith(b"HTTP/") else None

    @property
    def payload(self) -> bytes:
        return self.http[1] if self.http else self.content


def read_arc(stream) -> Iterator[ArcRecord]:
    """Records of an uncompressed ARC stream, the version block first. ValueError if the stream is cut short or no ARC."""
    version, ordinal = 0, 0
    while True:
        line = stream.readline()
        while line in (b"\n", b"\r\n"):
            line = stream.readline()
        if not line:
            return
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        if not version:
            if not text.startswith("filedesc:"):
                raise ValueError("no ARC version block")
            length = int(text.rsplit(" ", 1)[1])
            content = stream.read(max(0, length))
            version = int(content[: content.index(b" ")])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
        names = ARC_FIELDS[version]
        parts = text.rsplit(" ", len(names) - 1)  # a URL may hold spaces
        if len(parts) < len(names) and text.startswith("filedesc:"):
            parts = parts[:4] + ["-"] * (len(names) - len(parts)) + parts[4:]
        if len(parts) != len(names):
            raise ValueError(f"header line with {len(parts)} fields: {text[:200]}")
        fields = dict(zip(names, parts, strict=True))
        if ordinal:
            length = int(fields["length"])
            content = stream.read(max(0, length))
        if len(content) != length:
            raise ValueError(f"record {ordinal} is cut short")
        yield ArcRecord(ordinal, version, fields, content)
        ordinal += 1


def open_gzip(path: str):
    """The uncompressed stream of a file that may be compressed record by record."""
    system, base = open_fs(path)
    raw = system.open_input_stream(base, compression=None)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 16)


def salvage(path: str, faults: list[str]) -> Iterator[ArcRecord]:
    """Records of a file as far as it can be read; what stopped the reading goes to `faults`.

    A record whose declared length is wrong leaves no place where the next one surely begins, so that the file ends there.
    """
    try:
        with open_gzip(path) as stream:
            yield from read_arc(stream)
    except (ValueError, EOFError, zlib.error, gzip.BadGzipFile) as e:
        if isinstance(e, io.UnsupportedOperation):  # no fault of the file
            raise
        faults.append(f"{type(e).__name__}: {e}")


# WARC --------------------------------------------------------------------------------------------------------------


def digest32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str, ordinal: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{ordinal}')}"


def warc_date(date: str) -> str:
    """ISO form of an ARC date of 4 to 14 digits; missing parts count as their first value."""
    d = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() and len(date) >= 4 else DATE
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def convert(record: ArcRecord, name: str, refers: dict | None = None) -> bytes:
    """The WARC record for an ARC record of the file `name`; a revisit if `refers` names what it repeats (id, uri, date)."""
    f = record.fields
    common = [("WARC-Record-ID", f"<{record_id(name, record.ordinal)}>"), ("WARC-Date", warc_date(f["date"]))]
    if record.ordinal == 0:
        body = f"software: lexiloom\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC version {record.version}\r\n".encode()
        return warc_record([("WARC-Type", "warcinfo"), *common, ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], body)
    common += [("WARC-Target-URI", f["url"]), ("WARC-IP-Address", f["ip"])]
    if record.http is None:
        kind = "response" if f["url"].startswith("dns:") else "resource"
        return warc_record([("WARC-Type", kind), *common, ("WARC-Block-Digest", digest32(record.content)), ("Content-Type", f["type"])], record.content)
    head, payload = record.http
    common += [("WARC-Payload-Digest", digest32(payload))]
    block = head if refers else record.content
    common += [("WARC-Block-Digest", digest32(block)), ("Content-Type", "application/http; msgtype=response")]
    if refers:
        more = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers['id']}>"), ("WARC-Refers-To-Target-URI", refers["uri"]), ("WARC-Refers-To-Date", refers["date"]), ("WARC-Truncated", "length")]
        return warc_record([("WARC-Type", "revisit"), *common, *more], block)
    return warc_record([("WARC-Type", "response"), *common], block)


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an uncompressed WARC stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            headers[k.strip().lower()] = v.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("a record is cut short")
        yield headers, block


def http_header(block: bytes, name: str) -> str | None:
    for line in split_http(block)[0].splitlines()[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == name.lower().encode():
            return v.strip().decode("utf-8", "replace")
    return None


# Tables --------------------------------------------------------------------------------------------------------------


def write_arcs(pages: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Archives pages (page_id, url, html) as ARC files, of version 1 and 2 by turns; the table of files (path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        rows = (r for b in slices(batches, 2) for r in zip(*(c.to_pylist() for c in (b.column(0), b.column(1), b.column(2).cast(pa.large_binary()))), strict=True))
        paths = []
        for k in itertools.count():
            first = next(rows, None)
            if first is None:
                break
            version = 1 + (context.partitionId() + k) % 2
            name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}-{k}.arc.gz"

            def data(first=first, version=version, name=name):
                yield _member(arc_start(version, name), 1)
                size = 0
                for page_id, url, html in itertools.chain([first], rows):
                    payload = html or b""
                    mark = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
                    content = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (mark, len(payload), payload)
                    yield _member(arc_record(version, url or "-", "0.0.0.0", DATE, "text/html", content, name), 1)
                    size += len(content)
                    if size >= roll:
                        return

            paths.append(fs_write(folder, data(), name))
        if paths:
            yield pa.RecordBatch.from_pydict({"path": paths})

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return materialize(src.mapInArrow(lean(run), "path string"), "arc-files")


def _spread(files: DataFrame) -> DataFrame:
    """Deals files evenly to tasks, in ranges of their names: a join on path has no such partitioning, so Spark keeps this one."""
    return files.repartitionByRange(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def _page(content: bytes) -> int | None:
    """The page that a record of `write_arcs` holds; null for records from elsewhere."""
    page = http_header(content, "X-Page-Id") if content.startswith(b"HTTP/") else None
    return int(page) if page is not None and page.lstrip("-").isdigit() else None


def index_arcs(files: DataFrame) -> DataFrame:
    """(path, ordinal, page_id, url, date, n, sha1) of every record but the version blocks, as far as a file can be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                out: dict[str, list] = {k: [] for k in ("path", "ordinal", "page_id", "url", "date", "n", "sha1")}
                for r in salvage(path, []):
                    if r.ordinal:
                        row = (path, r.ordinal, _page(r.content), r.fields["url"], warc_date(r.fields["date"]), len(r.payload), hashlib.sha1(r.payload).digest())
                        for k, v in zip(out, row, strict=True):
                            out[k].append(v)
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return _spread(files.select("path")).mapInArrow(lean(run), "path string, ordinal int, page_id long, url string, date string, n long, sha1 binary")


def repeats(index: DataFrame, least: int = 1000) -> DataFrame:
    """(path, revisits array<struct<ordinal, id, uri, date>>): records whose payload of `least` bytes or more equals that of a record with a larger page_id.

    The record that stays is that of the largest page_id (null counts as least; then the last by file and place).
    """
    big = index.where(F.col("n") >= least)
    me = F.struct("page_id", "path", "ordinal", "url", "date")
    top = big.groupBy("sha1", "n").agg(F.max(me).alias("top"), F.count("*").alias("times")).where("times > 1").select("sha1", "n", "top")
    pairs = big.join(top, ["sha1", "n"]).where((F.col("path") != F.col("top.path")) | (F.col("ordinal") != F.col("top.ordinal")))
    entry = F.struct("ordinal", F.col("top.path").alias("of_path"), F.col("top.ordinal").alias("of_ordinal"), F.col("top.url").alias("uri"), F.col("top.date").alias("date"))
    return pairs.groupBy("path").agg(F.collect_list(entry).alias("revisits"))


def convert_arcs(files: DataFrame, folder: str, revisits: DataFrame | None = None) -> DataFrame:
    """Converts every ARC file of `files` to a WARC file below folder; the table of files (path, fault).

    A file that is cut short or malformed is converted up to the fault, which its row names; fault is null for the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            for path, again in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name = path.rsplit("/", 1)[1]
                of = {x["ordinal"]: {"id": record_id(x["of_path"].rsplit("/", 1)[1], x["of_ordinal"]), "uri": x["uri"], "date": x["date"]} for x in again or ()}

                faults: list[str] = []

                def data(path=path, name=name, of=of, faults=faults):
                    for r in salvage(path, faults):
                        yield _member(convert(r, name, of.get(r.ordinal)), 6)

                done = fs_write(folder, data(), f"{name.split('.arc')[0]}-{attempt}.warc.gz")
                yield pa.RecordBatch.from_pydict({"path": [done], "fault": pa.array([faults[0] if faults else None], pa.string())})

    src = files.select("path")
    kinds = "array<struct<ordinal:int,of_path:string,of_ordinal:int,uri:string,date:string>>"
    src = src.withColumn("revisits", F.lit(None).cast(kinds)) if revisits is None else src.join(revisits, "path", "left")
    return materialize(_spread(src).mapInArrow(lean(run), "path string, fault string"), "warc-files")


def read_warcs(files: DataFrame) -> DataFrame:
    """(record_id, page_id, record_type, uri, date, payload_bytes, payload_digest hex, refers_to_id) of every record but warcinfo.

    Digests of responses are measured on what was read and must equal the header's. A revisit has no payload of its own:
    its payload_bytes are what its HTTP header declares, null if that is no number.
    """
    names = ("record_id", "page_id", "record_type", "uri", "date", "payload_bytes", "payload_digest", "refers_to_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                out: dict[str, list] = {k: [] for k in names}
                with open_gzip(path) as stream:
                    for h, block in read_warc(stream):
                        if h["warc-type"] == "warcinfo":
                            continue
                        http = h.get("content-type", "").startswith("application/http")
                        page = _page(block) if http else None
                        declared = h.get("warc-payload-digest", h.get("warc-block-digest", ""))
                        if h["warc-type"] == "revisit":
                            said = http_header(block, "Content-Length") or ""
                            size = int(said) if said.isdigit() else None
                        else:
                            payload = split_http(block)[1] if http else block
                            size = len(payload)
                            if digest32(payload) != declared:
                                raise ValueError(f"{path}: digest of {h['warc-record-id']} is wrong")
                        row = (
                            h["warc-record-id"].strip("<>"), page, h["warc-type"], h.get("warc-target-uri"), h["warc-date"], size,
                            base64.b32decode(declared.split(":", 1)[1]).hex(), h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None,
                        )
                        for k, v in zip(out, row, strict=True):
                            out[k].append(v)
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return _spread(files.select("path")).mapInArrow(lean(run), "record_id string, page_id long, record_type string, uri string, date string, payload_bytes long, payload_digest string, refers_to_id string")


def archive_pages(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages written as ARC, converted to WARC and read back.

    A null html is an empty payload, a null url the URL `-`. Of equal payloads of `least` bytes or more the largest
    page_id is the response and the others revisit it; repeated rows of that page revisit it too. Rows without page_id
    are archived, and returned with a null page_id. Other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    arcs = write_arcs(pages, scratch(spark, "arc"))
    index = materialize(index_arcs(arcs), "arc-index")
    warcs = convert_arcs(arcs, scratch(spark, "warc"), repeats(index, least))
    rows = materialize(read_warcs(warcs), "warc-rows")
    of = rows.where("record_type <> 'revisit'").select(F.col("record_id").alias("id_"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes_"))
    again = rows.where("record_type = 'revisit'").join(of, F.col("refers_to_id") == F.col("id_"), "left").withColumn("payload_bytes", F.coalesce("bytes_", "payload_bytes"))
    first = rows.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return first.select(*names).unionByName(again.select(*names))


def op3_warc(spark, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY h)
SELECT p.page_id, n AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN top IS NOT NULL AND top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS NOT NULL AND top <> p.page_id THEN top END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h
"""
