"""Media columns: payloads as 8-bit images in tar archives, read by a custom Spark data source in byte ranges."""

from __future__ import annotations

import hashlib
import json
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .archive_files import RollingFile, locate, make_folder
from .common import bound_batches, fresh_path

WIDTH = 64
BLOCK = 512
SIGNATURE = b"\x89PNG\r\n\x1a\n"
FEATURE_NAMES = "height,mean,deviation,entropy,edge"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(payload: bytes, unpadded: int) -> bytes:
    """A grey 8-bit PNG, WIDTH samples a row, of a payload of a positive multiple of WIDTH bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()  # no row filter
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % unpadded) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def image_chunks(image: bytes) -> list[tuple[bytes, bytes]]:
    """(kind, content) of an image's chunks, their sums checked; ValueError if bytes aren't as written. Nothing is inflated."""
    if image[:8] != SIGNATURE:
        raise ValueError("no image")
    at, chunks = 8, []
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(kind + body) != int.from_bytes(image[at + 8 + n : at + 12 + n], "big"):
            raise ValueError(f"chunk {kind!r} is damaged")
        chunks.append((kind, body))
        at += 12 + n
    if not chunks or chunks[-1][0] != b"IEND":
        raise ValueError("the image is cut off")
    return chunks


def decode_image(image: bytes) -> tuple[bytes, int]:
    """Payload and unpadded length of an image; ValueError if its bytes aren't as written."""
    data, size, unpadded = [], (0, 0), 0
    for kind, body in image_chunks(image):
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            unpadded = int(body[6:])
        elif kind == b"IDAT":
            data.append(body)
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("row filters aren't used here")
    return lines[:, 1:].tobytes(), unpadded


def image_features(payload: bytes) -> str:
    """FEATURE_NAMES of the samples, as text with four decimals."""
    samples = np.frombuffer(payload, np.uint8)
    count = np.bincount(samples, minlength=256)
    share = count[count > 0] / len(samples)
    value = np.arange(256)
    mean = float((count * value).sum() / len(samples))
    deviation = float(np.sqrt(max(0.0, (count * value * value).sum() / len(samples) - mean * mean)))
    edge = float(np.abs(np.diff(samples.astype(np.int16))).mean()) if len(samples) > 1 else 0.0
    return f"{len(samples) // WIDTH};{mean:.4f};{deviation:.4f};{float(-(share * np.log2(share)).sum()):.4f};{edge:.4f}"


def _token(name: str) -> str:
    """What each member's name in an archive begins with, so that no payload is taken for a member's header."""
    return name.removeprefix("shard-").removesuffix(".tar")


def _header(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT)


class _Shard(RollingFile):
    def __init__(self, folder: str, roll: int):
        super().__init__(folder, lambda: f"shard-{uuid.uuid4().hex}.tar", roll)
        self.member = ""

    def add(self, member: str, body: bytes) -> None:
        head = _header(f"{_token(self.place()[0])}/{member}", len(body))
        self.write(head + body + bytes(-len(body) % BLOCK))

    def trailer(self) -> bytes:
        return bytes(2 * BLOCK)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _MediaWriter(DataSourceArrowWriter):
    """Each task writes shards of its own; those of tasks that ended are named in the folder's manifest, others are never read."""

    def __init__(self, options: dict):
        self.path, self.roll = options["path"], int(options.get("roll", 256 << 20))
        make_folder(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        shard = _Shard(self.path, self.roll)
        for batch in iterator:
            for id_, size, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard.add(f"{'null' if id_ is None else id_}.png", encode_image(payload.as_py(), size))
        return _Written(shard.close())

    def commit(self, messages: list) -> None:
        system, path = locate(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        with system.open_output_stream(f"{path}/manifest.json") as out:
            out.write(json.dumps(files).encode())


class _Range(InputPartition):
    def __init__(self, name: str, start: int, end: int, size: int):
        self.name, self.start, self.end, self.size = name, start, end, size


#: Bytes of a range unless the option says otherwise, and ranges beyond which they grow, so that planning stays small; an archive has one at least.
RANGE_BYTES, MOST_RANGES = 32 << 20, 100_000


def range_bytes(total: int) -> int:
    return max(RANGE_BYTES, -(-total // MOST_RANGES))


class _MediaReader(DataSourceReader):
    """Plans ranges of bytes over the archives; a range yields the members whose header begins in it.

    A header or body that can't be read is tried again by its offset with a file opened anew. What stays
    unreadable gives a row without media whose ``error`` says what and where; a lost header also hides
    where its member ends, so that reading goes on at the next block that is a sound header. The range
    that ends with a member looks at the header after it too, since the range that header lies in
    can't tell a damaged header from the body before it: so each is reported once.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.range = int(options["range"]) if "range" in options else None
        self.batch, self.tries = int(options.get("batch", 8 << 20)), int(options.get("tries", 3))

    def partitions(self) -> list[InputPartition]:
        system, path = locate(self.path)
        with system.open_input_stream(f"{path}/manifest.json") as f:
            files = json.loads(f.read())
        step = self.range or range_bytes(sum(size for _, size in files))
        return [_Range(name, a, min(a + step, size), size) for name, size in files for a in range(0, size, step)] or [_Range("", 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for member in self._members(part):
            rows.append(member)
            held += len(member[1] or b"")
            if held >= self.batch:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "media", "archive", "at", "error"])

    def _members(self, part: _Range) -> Iterator[tuple]:
        if not part.name:
            return
        system, path = locate(self.path)
        own, token = f"{path}/{part.name}", _token(part.name)
        with system.open_input_file(own) as f:
            # the first member of an archive has its header at 0; another range's first one is looked for
            at = 0 if part.start == 0 else self._next(system, own, f, part.start + -part.start % BLOCK, part.end, token)
            while at is not None and at < part.size - 2 * BLOCK:  # the trailer
                info, error = self._read(system, own, f, at, BLOCK, lambda block: self._info(block, token))
                if info is None:
                    after = self._next(system, own, f, at + BLOCK, part.end, token)
                    yield None, None, part.name, at, f"header: {error}; nothing is read up to {after or 'the next sound header'}"
                    at = after
                    continue
                if at >= part.end:
                    return
                body, error = self._read(system, own, f, at + BLOCK, info.size, self._sound)
                name = info.name.rpartition("/")[2].removesuffix(".png")
                yield None if name == "null" else int(name), body, part.name, at, error and f"body: {error}"
                at += BLOCK + info.size + -info.size % BLOCK

    @staticmethod
    def _info(block: bytes, token: str) -> tarfile.TarInfo:
        if not block.startswith(token.encode()):
            raise ValueError(f"it begins with {block[:60].rstrip(bytes(1))!r}")
        try:
            return tarfile.TarInfo.frombuf(block, "utf-8", "strict")  # checks the header's sum
        except tarfile.HeaderError as e:
            raise ValueError(f"{e}, the name reads {block[len(token) + 1 : 100].rstrip(bytes(1))!r}") from e

    @staticmethod
    def _sound(body: bytes) -> bytes:
        image_chunks(body)
        return body

    def _next(self, system, own: str, f, at: int, end: int, token: str) -> int | None:
        """The first sound header from ``at`` on and before ``end``."""
        while at < end:
            window, _ = self._read(system, own, f, at, 1 << 20, lambda x: x)
            for k in range(0, min(len(window or b"") - BLOCK + 1, end - at), BLOCK):
                if window.startswith(token.encode(), k):
                    try:
                        self._info(window[k : k + BLOCK], token)
                        return at + k
                    except ValueError:
                        continue
            at += 1 << 20
        return None

    def _read(self, system, own: str, f, at: int, size: int, check) -> tuple:
        """What ``check`` makes of the bytes at an offset, tried again with a file opened anew; else None and the error."""
        error = ""
        for turn in range(self.tries):
            try:
                if turn:
                    time.sleep(0.1 * turn)
                    with system.open_input_file(own) as again:
                        return check(again.read_at(size, at)), None
                return check(f.read_at(size, at)), None
            except (OSError, ValueError, zlib.error, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
        return None, error


class MediaArchive(DataSource):
    """Data source ``media_archive``: (id long, bytes long, payload binary) written, (id, media, archive, at, error) read."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "id long, media binary, archive string, at long, error string"

    def reader(self, schema) -> DataSourceReader:
        return _MediaReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _MediaWriter(self.options)


def store_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every text's padded UTF-8 as an image into archives under ``path``.

    Null text is empty; each payload is padded with bytes 0 to a positive multiple of 64. Null and
    repeated ids have a member each; other columns are ignored; an empty table leaves an empty manifest.
    """
    bound_batches(docs).sparkSession.dataSource.register(MediaArchive)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size = F.octet_length(text)
    padded = (F.greatest(F.lit(1), F.ceil(size / WIDTH)) * WIDTH).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), size.cast("long").alias("bytes"), F.rpad(text, padded, F.lit(b"\0")).alias("payload"))
    rows.write.format("media_archive").mode("append").save(path)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")}
        for id_, media, error in zip(batch.column("id").to_pylist(), batch.column("media"), batch.column("error").to_pylist(), strict=True):
            image = media.as_py()
            try:
                if image is None:
                    raise ValueError(error)
                payload, size = decode_image(image)
                row = (id_, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), image_features(payload), None)
            except (ValueError, zlib.error, struct.error) as e:
                row = (id_, None, None, None, None, None, None, None, str(e))
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], list(out))


def describe_media(spark: SparkSession, path: str) -> DataFrame:
    """Features of every member of the archives under ``path``, from the stored bytes; ``error`` says why a member has none."""
    spark.dataSource.register(MediaArchive)
    media = spark.read.format("media_archive").load(path).select("id", "media", "error")
    return bound_batches(media).mapInArrow(
        _describe,
        "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string",
    )


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "media")
    store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return describe_media(spark, path).withColumnRenamed("id", "doc_id")
