"""Legacy archive converter: ARC files to equivalent WARC files, payloads that repeat as revisit records."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive_files import RollingFile, locate, make_folder
from .common import bound_batches, fresh_path, hot_keys, materialize, skew_join

#: The field names of an ARC file's records, by the version its first record declares.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ROLL = 64 << 20
#: Bytes of an archive whose records one task converts, and bytes read from it at once.
SPLIT, READ = 16 << 20, 4 << 20
#: Shorter payloads are never stored as revisits.
REVISIT_BYTES = 1000
KEY_HEADER = "X-Source-Id"


def _gz(data: bytes) -> bytes:
    """One gzip member without a time stamp, so that equal records have equal bytes."""
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def gzip_members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a file; memory holds one member."""
    offset, used, pending, parts = 0, 0, b"", []
    member = zlib.decompressobj(31)
    while data := pending or stream.read(1 << 20):
        parts.append(member.decompress(data))
        pending = member.unused_data
        used += len(data) - len(pending)
        if member.eof:
            yield offset, used, b"".join(parts)
            offset, used, parts, member = offset + used, 0, [], zlib.decompressobj(31)
    if used:
        raise ValueError("the last member is cut off")


class _ArcFile(RollingFile):
    def __init__(self, folder: str, version: str, date: str):
        super().__init__(folder, lambda: f"part-{uuid.uuid4().hex}.arc.gz", ROLL)
        self.version, self.date = version, date

    def header(self, path: str) -> bytes:
        body = f"{self.version} 0 cmdspark\n{ARC_FIELDS[self.version]}\n".encode()
        line = f"filedesc://{path} 0.0.0.0 {self.date} text/plain"
        if self.version == "2":
            line += f" 200 - - 0 {path}"
        return _gz(f"{line} {len(body)}\n".encode() + body + b"\n")


def _write_arc(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    files: dict[str, _ArcFile] = {}
    number = 0
    for batch in batches:
        for id_, url, html in zip(batch.column("id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), strict=True):
            version = "12"[number % 2]
            number += 1
            if version not in files:
                files[version] = _ArcFile(folder, version, date)
            payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
            key = "" if id_ is None else str(id_)
            block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{KEY_HEADER}: {key}\r\n\r\n".encode() + payload
            place = quote(url or "urn:unknown", safe="!#$%&'()*+,/:;=?@[]~")
            line = f"{place} 0.0.0.0 {date} text/html"
            if version == "2":
                path, at = files[version].place()
                line += f" 200 {hashlib.md5(block).hexdigest()} - {at} {path}"
            files[version].write(_gz(f"{line} {len(block)}\n".encode() + block + b"\n"))
    done = [x for f in files.values() for x in f.close()]
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["archive", "bytes"])


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20000101000000") -> DataFrame:
    """Write pages as ARC files of both versions; the files, one row each. Archives of failed attempts aren't among them."""
    make_folder(folder)
    rows = bound_batches(pages).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return materialize(rows.mapInArrow(lambda it: _write_arc(it, folder, date), "archive string, bytes long"), "arc-files")


def parse_arc(content: bytes, fields: list[str]) -> tuple[dict[str, str], bytes]:
    """Header fields and block of an ARC record; the declared length says where the block ends. A URL may hold blanks, no other field."""
    line, _, rest = content.partition(b"\n")
    values = line.decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(fields) - 1)
    if len(values) != len(fields):
        raise ValueError(f"{len(values)} fields, {len(fields)} declared")
    record = dict(zip(fields, values, strict=True))
    length = int(record["Archive-length"])
    if length > len(rest):
        raise ValueError(f"{length} bytes declared, {len(rest)} there")
    return record, rest[:length]


def arc_fields(content: bytes) -> list[str]:
    """Field names of a file's records, from its version block, the record that comes first."""
    _, _, rest = content.partition(b"\n")
    version = rest.split(b" ", 1)[0].decode()
    if version not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {version!r}")
    return ARC_FIELDS[version].split(" ")


def warc_date(date: str) -> str | None:
    """An ARC date of 4 to 14 digits, from the year on, what is absent at its least; null if it is none."""
    if not re.fullmatch(r"\d{4}(\d\d){0,5}", date):
        return None
    try:
        when = datetime.strptime(date + "00000101000000"[len(date) :], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
    except ValueError:
        return None
    return when.strftime("%Y-%m-%dT%H:%M:%SZ")


def is_http(url: str, block: bytes) -> bool:
    """Whether a block has HTTP's framing. For schemes that come without it, text that only begins like it is none: the frame must hold our own header, as it does for every page that was written here."""
    if not re.match(rb"HTTP/\d", block):
        return False
    return not url.lower().startswith(("dns:", "whois:")) or http_field(split_http(block)[0], KEY_HEADER) is not None


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header, with its blank line, and payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    return (head + gap, payload) if gap else (b"", block)


def split_block(url: str, block: bytes) -> tuple[bytes, bytes]:
    """Header and payload of a record; what isn't HTTP is all payload."""
    return split_http(block) if is_http(url, block) else (b"", block)


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n"):
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def _index_arc(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    system, path = locate(folder)
    kinds = {"archive": pa.string(), "at": pa.int64(), "size": pa.int64(), "fields": pa.int32(), "archive_date": pa.string(), "id": pa.int64(), "payload_bytes": pa.int64(), "digest": pa.binary()}

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds.values(), strict=True)], list(kinds))

    for batch in batches:
        for name in batch.column("archive").to_pylist():
            out: list[tuple] = []
            with system.open_input_stream(f"{path}/{name}", compression=None) as f:
                fields: list[str] = []
                made = None
                for offset, length, content in gzip_members(f):
                    if not fields:
                        fields = arc_fields(content)
                        made = parse_arc(content, fields)[0]["Archive-date"]
                        out.append((name, offset, length, len(fields), made, None, None, None))  # the version block
                        continue
                    record, block = parse_arc(content, fields)
                    head, payload = split_block(record["URL"], block)
                    key = http_field(head, KEY_HEADER)
                    out.append((name, offset, length, len(fields), made, int(key) if key else None, len(payload), hashlib.sha1(payload).digest() + hashlib.sha256(payload).digest()))
                    if len(out) >= 5000:
                        yield rows(out)
                        out = []
            yield rows(out)


class _WarcFile(RollingFile):
    def __init__(self, folder: str):
        super().__init__(folder, lambda: f"part-{uuid.uuid4().hex}.warc.gz", ROLL)


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_id(archive: str, at: int) -> str:
    """The identifier of the WARC record for the ARC record at that place: the same in every run of a task."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{at}')}>"


def warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, **fields, "Content-Length": str(len(block))}.items())
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def convert_record(arc: dict[str, str], block: bytes, r: dict) -> bytes:
    """The WARC record for an ARC record ``r`` of the index, which says what it revisits.

    An HTTP block becomes a response; any other, and what schemes like dns or ftp gave, a resource of the
    ARC record's content type. A date that is none becomes the archive's.
    """
    name, at = r["archive"], r["at"]
    head, payload = split_block(arc["URL"], block)
    http = is_http(arc["URL"], block)
    kind = "response" if http else "resource"
    fields = {
        "WARC-Record-ID": record_id(name, at), "WARC-Date": warc_date(arc["Archive-date"]) or warc_date(r["archive_date"]) or "1970-01-01T00:00:00Z", "WARC-Target-URI": arc["URL"],
        "WARC-IP-Address": arc["IP-address"], "WARC-Warcinfo-ID": record_id(name, 0),
        "Content-Type": "application/http; msgtype=response" if http else content_type(arc["Content-type"]),
        "WARC-Payload-Digest": sha1_label(hashlib.sha1(payload).digest()), "X-Payload-Length": str(len(payload)),
    }
    if r["keep_archive"] is not None and (r["keep_archive"], r["keep_at"]) != (name, at):
        kind, block = "revisit", head
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(r["keep_archive"], r["keep_at"]), "X-Refers-To-Source-Id": "" if r["keep_id"] is None else str(r["keep_id"])}
    fields["WARC-Block-Digest"] = sha1_label(hashlib.sha1(block).digest())
    return warc_record(kind, fields, block)


def content_type(declared: str) -> str:
    return declared if re.fullmatch(r"[\w.+-]+/[\w.+-]+.*", declared) else "application/octet-stream"


def convert_filedesc(arc: dict[str, str], block: bytes, r: dict) -> bytes:
    """The warcinfo record for an archive's version block, which it quotes."""
    lines = {"software": "cmdspark", "format": "WARC File Format 1.1", "source-archive": r["archive"], "source-format": f"ARC version {block.split(b' ', 1)[0].decode('utf-8', 'replace')}", "source-uri": arc["URL"]}
    body = "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"source-version-block: " + base64.b64encode(block) + b"\r\n"
    fields = {"WARC-Record-ID": record_id(r["archive"], r["at"]), "WARC-Date": warc_date(arc["Archive-date"]) or "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}
    return warc_record("warcinfo", fields, body)


def _convert(batches: Iterator[pa.RecordBatch], arcs: str, folder: str) -> Iterator[pa.RecordBatch]:
    system, path = locate(arcs)
    out = _WarcFile(folder)
    name, stream, start, held = None, None, 0, b""
    names = {len(v.split(" ")): v.split(" ") for v in ARC_FIELDS.values()}
    for batch in batches:
        for r in batch.to_pylist():
            if r["archive"] != name:
                if stream is not None:
                    stream.close()
                name, start, held = r["archive"], 0, b""
                stream = system.open_input_file(f"{path}/{name}")
            a = r["at"] - start
            if a < 0 or a + r["size"] > len(held):  # records come in order, many in one read
                start, held, a = r["at"], stream.read_at(max(r["size"], READ), r["at"]), 0
            arc, block = parse_arc(zlib.decompress(held[a : a + r["size"]], 31), names[r["fields"]])
            out.write(_gz((convert_filedesc if r["payload_bytes"] is None else convert_record)(arc, block, r)))
    if stream is not None:
        stream.close()
    done = out.close()
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["archive", "bytes"])


def file_tasks(total: int, parallel: int) -> int:
    """Tasks for ``total`` bytes in files that are read whole: a file of common size for each, but a few for each core."""
    return max(1, parallel * 4, -(-total // ROLL))


def convert_arc(arc_files: DataFrame, arcs: str, folder: str) -> DataFrame:
    """Convert the ARC files (archive, bytes) under ``arcs`` to WARC files under ``folder``; the new files, one row each.

    First every record is parsed by its file's version and its declared length, and its place and payload
    digests listed. Of records with equal payloads (SHA-1 and SHA-256) of at least REVISIT_BYTES bytes the
    one with the largest source id keeps its type, on ties the last place; the others revisit it. The
    list, not the payloads, is shuffled: a group of copies holds numbers only, hot ones by broadcast of
    their few responses. Tasks then take SPLIT bytes of an archive each, read its records by offset and
    write their equivalents; an archive's version block becomes a warcinfo record. Records without a
    source id have a null id, which comes before all others.
    """
    make_folder(folder)
    total = arc_files.agg(F.sum("bytes")).first()[0] or 0
    parallel = arc_files.sparkSession.sparkContext.defaultParallelism
    spread = arc_files.select("archive").repartition(file_tasks(total, parallel), F.xxhash64("archive"))
    schema = "archive string, at long, size long, fields int, archive_date string, id long, payload_bytes long, digest binary"
    index = materialize(spread.mapInArrow(lambda it: _index_arc(it, arcs), schema), "arc-index")
    last = F.max(F.struct(F.col("id").isNotNull().alias("some"), "id", "archive", "at")).alias("keep")
    long = index.filter(F.col("payload_bytes") >= REVISIT_BYTES)
    keep = long.groupBy("digest").agg(last).select("digest", F.col("keep.archive").alias("keep_archive"), F.col("keep.at").alias("keep_at"), F.col("keep.id").alias("keep_id"))
    short = index.filter("payload_bytes is null or payload_bytes < " + str(REVISIT_BYTES)).select("*", F.lit(None).cast("string").alias("keep_archive"), F.lit(None).cast("long").alias("keep_at"), F.lit(None).cast("long").alias("keep_id"))
    planned = skew_join(long, keep, "digest", hot_keys(long, "digest")).unionByName(short).drop("digest")
    # the list is small for the work that it stands for, so the number of tasks is given, by the archives' bytes
    tasks = max(parallel * 2, -(-total // SPLIT))
    dealt = planned.repartition(tasks, "archive", F.floor(F.col("at") / SPLIT)).sortWithinPartitions("archive", "at")
    return materialize(dealt.mapInArrow(lambda it: _convert(it, arcs, folder), "archive string, bytes long"), "warc-files")


def parse_warc(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["Content-Length"])]


def _read_warc(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    system, path = locate(folder)
    kinds = {"id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "warc_date": pa.string(), "record_id": pa.string()}
    for batch in batches:
        for name in batch.column("archive").to_pylist():
            rows: list[tuple] = []
            with system.open_input_stream(f"{path}/{name}", compression=None) as f:
                for offset, _, content in gzip_members(f):
                    fields, block = parse_warc(content)
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        rows.append((None, None, None, kind, None, None, fields["WARC-Date"], fields["WARC-Record-ID"]))
                        continue
                    head, payload = split_http(block) if fields["Content-Type"].startswith("application/http") else (b"", block)
                    key, digest = http_field(head, KEY_HEADER), base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                    if kind != "revisit" and hashlib.sha1(payload).digest() != digest:
                        raise ValueError(f"{name} at {offset}: the payload isn't that of its digest")
                    refers = fields.get("X-Refers-To-Source-Id")
                    rows.append((int(key) if key else None, int(fields["X-Payload-Length"]), digest.hex(), kind, int(refers) if refers else None, fields["WARC-Target-URI"], fields["WARC-Date"], fields["WARC-Record-ID"]))
            for a in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 5000], strict=True), kinds.values(), strict=True)], list(kinds))


def read_warc(files: DataFrame, folder: str, infos: bool = False) -> DataFrame:
    """One row per record of the WARC files (archive, bytes) under ``folder``; digests of stored payloads are checked. With ``infos`` warcinfo records too, which have no payload."""
    total = files.agg(F.sum("bytes")).first()[0] or 0
    spread = files.select("archive").repartition(file_tasks(total, files.sparkSession.sparkContext.defaultParallelism), F.xxhash64("archive"))
    records = spread.mapInArrow(lambda it: _read_warc(it, folder), "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string, record_id string")
    return records if infos else records.filter("record_type <> 'warcinfo'")


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    arcs, warcs = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    files = convert_arc(write_arc(pages, arcs), arcs, warcs)
    records = read_warc(files, warcs)
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
g AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
             max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM g
"""
