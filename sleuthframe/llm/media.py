"""Media columns: payloads kept as image members of archives, read by a Spark data source.

A payload is stored as an 8-bit grey PNG of 64 samples a row (lossless), and PNGs as members
of ZIP archives, one archive per task. The data source "media_archive" lists a folder's
archives, plans byte ranges of them as partitions, and each partition reads the archive's
directory, streams the members that begin in its range through Arrow in batches of bounded
bytes, and reads every member by its own offset: one that fails its checksum or read is tried
again alone, and after ``retries`` comes out with its error instead of failing the rest.

Defined cases: a null or empty text is 64 zero bytes; texts of any length are one member;
repeated rows and repeated or null ids are members of their own; equal texts give equal media;
an empty table gives no rows; other columns of the input are not read."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import Scratch, text_slices

WIDTH = 64
PNG = b"\x89PNG\r\n\x1a\n"
SCHEMA = "member string, media binary, payload binary, n_bytes long, feature string, error string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def encode_png(data: bytes, level: int = 1) -> bytes:
    """Bytes, zero-padded to whole rows, as samples; the unpadded length is a text chunk."""
    import numpy as np

    payload = np.frombuffer(padded(data), np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(payload), WIDTH + 1), np.uint8)
    rows[:, 1:] = payload
    head = struct.pack(">IIBBBBB", WIDTH, len(payload), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0" + str(len(data)).encode()) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length); checks every chunk."""
    import numpy as np

    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, head, data, length = 8, None, [], None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            length = int(body[6:])
        at += 12 + n
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(head[1], head[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    payload = rows[:, 1:].tobytes()
    return payload, len(payload) if length is None else length


def feature_of(payload: bytes) -> str:
    """Rows, mean and spread of the samples, and their shares in 16 equal bins, in whole
    thousandths."""
    import numpy as np

    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    mean = int(x.sum(dtype=np.int64)) * 1000 // len(x)
    square = int((x.astype(np.int64) ** 2).sum()) * 1000 // len(x)
    return f"rows={len(x) // WIDTH};mean={mean};square={square};bins=" + ",".join(str(int(b) * 1000 // len(x)) for b in bins)


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text; returns the manifest (file, members, bytes), a written table in
    ``folder``. An archive gets its final name when it is whole, and a repeated task replaces
    it by the same one, so the folder never holds half an archive or two of one task."""
    spark = docs.sparkSession

    def written(batches: Iterator) -> Iterator:
        import zipfile

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        where, base = fs.FileSystem.from_uri(f"{folder}/archives")
        where.create_dir(base, recursive=True)
        name = f"{base}/part-{task.partitionId():06d}.zip"
        draft = f"{name}.{task.taskAttemptId()}"
        out = archive = None
        members = size = 0
        for keys, texts in text_slices(batches):
            for key, text in zip(keys, texts, strict=True):
                if archive is None:
                    out = where.open_output_stream(draft)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                media = encode_png(text.encode("utf-8", "surrogatepass"))
                info = zipfile.ZipInfo(f"{members}_{'null' if key is None else key}.png")
                archive.writestr(info, media)
                members += 1
                size += len(media)
        if archive is not None:
            archive.close()
            out.close()
            where.move(draft, name)
            yield pa.RecordBatch.from_pylist([{"file": name, "members": members, "bytes": size}], schema=pa.schema([("file", pa.string()), ("members", pa.int64()), ("bytes", pa.int64())]))

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    manifest = own.mapInArrow(written, "file string, members long, bytes long")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


class ByteRange(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def read_member(file, info, retries: int = 2, reopen=None) -> tuple[bytes | None, str | None]:
    """A stored member by its offset, checked; (bytes, None) or (None, error)."""
    error = None
    for _ in range(retries + 1):
        try:
            head = file.read_at(30, info.header_offset)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("no member begins there")
            name, extra = struct.unpack_from("<HH", head, 26)
            data = file.read_at(info.compress_size, info.header_offset + 30 + name + extra)
            if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
                raise ValueError("checksum differs")
            return data, None
        except (OSError, ValueError, struct.error) as x:
            error = f"{type(x).__name__}: {x}"
            if reopen is not None:
                file = reopen()
    return None, error


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.range = int(options.get("rangebytes", 16 << 20))
        self.batch = int(options.get("batchbytes", 8 << 20))
        self.retries = int(options.get("retries", 2))

    def partitions(self):
        """Byte ranges of every archive. The driver sees a row per archive, no members."""
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(self.folder)
        found = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return [ByteRange(f.path, a, min(f.size, a + self.range)) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".zip") for a in range(0, f.size, self.range)] or [ByteRange("", 0, 0)]

    def read(self, partition):
        import zipfile

        import pyarrow as pa
        from pyarrow import fs

        if not partition.file:
            return
        schema = pa.schema([("member", pa.string()), ("media", pa.binary()), ("payload", pa.binary()), ("n_bytes", pa.int64()), ("feature", pa.string()), ("error", pa.string())])
        where, _ = fs.FileSystem.from_uri(self.folder)
        with where.open_input_file(partition.file) as file:
            directory = zipfile.ZipFile(file).infolist()
            held, size = [], 0
            for info in directory:
                if not partition.start <= info.header_offset < partition.end:
                    continue
                media, error = read_member(file, info, self.retries, lambda: where.open_input_file(partition.file))
                payload = length = feature = None
                if media is not None:
                    try:
                        payload, length = decode_png(media)
                        feature = feature_of(payload)
                    except (ValueError, zlib.error) as x:
                        payload, length, error = None, None, f"{type(x).__name__}: {x}"
                held.append((info.filename, media, payload, length, feature, error))
                size += len(media or b"") + len(payload or b"")
                if size >= self.batch:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class MediaArchive(DataSource):
    """format("media_archive"): options path (a folder of archives), rangeBytes, batchBytes, retries."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MediaReader(self.options)


def read_archives(spark, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(f"{folder}/archives")


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    """All texts stored as media and read back by the data source."""
    folder = Scratch(spark, "media").root
    write_archives(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    out = read_archives(spark, folder)
    return out.select(
        F.nullif(F.regexp_extract("member", r"_(null|-?\d+)\.png$", 1), F.lit("null")).cast("long").alias("doc_id"), "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -WIDTH, WIDTH)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "error",
    )


QUERIES = {"op9_media_columns": op9_media_columns}
ORACLE_SQL: dict[str, str] = {}
