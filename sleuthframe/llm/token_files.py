"""Token ids in binary files of patched frame-of-reference blocks.

A shard file holds blocks of 256 ids in a row, across document borders. A block stores its
minimum, the differences packed at a width that a percentile of them needs, and an exception
list (position and high bits) for those that need more. Little-endian layout:

    magic "PFORIDS1" | blocks | documents | block starts | footer
    block      u32 minimum, u8 width, u8 0, u16 exceptions, width*32 bytes of packed
               differences (8 lanes of 32 values), u8 positions, u32 high bits
    documents  i64 ids (null: the least i64), u32 token counts
    block starts  u64 place of each block, so a reader can begin at any token
    footer     u64 places of documents and block starts, u64 documents, u64 tokens, magic

A document's first id may so be found by its start // 256. Files are written under a name of
the task and renamed when whole; a repeated task replaces its own file by the same bytes.

Defined cases: a null or empty text is its end id alone; rows of one doc_id are written in
order of their text's crc32, null ids first; a text of any length streams through in parts; an
empty table gives no rows; other columns of the input are not read."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, default_tokenizer, encoder, give_back, shuffle_partitions, text_slices

MAGIC, BLOCK, LANES = b"PFORIDS1", 256, 8
NO_ID = -(1 << 63)
READ_TOKENS = 1 << 24
HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("zero", "u1"), ("exceptions", "<u2")])


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs."""
    return np.searchsorted(np.left_shift(np.uint64(1), np.arange(33, dtype=np.uint64)), x.astype(np.uint64), side="right").astype(np.uint8)


def pack_blocks(values: np.ndarray, percentile: float = 0.9) -> list[bytes]:
    """Encodes unsigned 32-bit values, whose count is a multiple of 256, block by block."""
    v = values.reshape(-1, BLOCK)
    least = v.min(axis=1, initial=2**32 - 1) if len(v) else np.zeros(0, np.uint32)
    diff = v - least[:, None]
    rank = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = _bits(np.partition(diff, rank, axis=1)[:, rank]) if len(v) else np.zeros(0, np.uint8)
    out: list[bytes] = [b""] * len(v)
    for w in np.unique(width):
        w = int(w)
        own = np.flatnonzero(width == w)
        d = diff[own]
        high = np.right_shift(d.astype(np.uint64), np.uint64(w)).astype(np.uint32)
        low = (d & np.uint32((1 << w) - 1)).reshape(len(own), BLOCK // LANES, LANES)
        packed = np.zeros((len(own), w, LANES), dtype="<u4")
        for i in range(BLOCK // LANES if w else 0):
            word, shift = divmod(i * w, 32)
            packed[:, word] |= low[:, i] << np.uint32(shift)
            if shift + w > 32:
                packed[:, word + 1] |= low[:, i] >> np.uint32(32 - shift)
        heads = np.zeros(len(own), HEAD)
        heads["least"], heads["width"], heads["exceptions"] = least[own], w, (high > 0).sum(axis=1)
        for k, at in enumerate(own):
            place = np.flatnonzero(high[k])
            out[at] = heads[k].tobytes() + packed[k].tobytes() + place.astype("u1").tobytes() + high[k, place].astype("<u4").tobytes()
    return out


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Decodes the blocks that begin at the given places of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    heads = np.stack([raw[s : s + 8] for s in starts]).reshape(-1).view(HEAD) if len(starts) else np.zeros(0, HEAD)
    out = np.empty((len(starts), BLOCK), np.uint32)
    for w in np.unique(heads["width"]):
        w = int(w)
        own = np.flatnonzero(heads["width"] == w)
        packed = np.stack([raw[starts[k] + 8 : starts[k] + 8 + w * 32] for k in own]).view("<u4").reshape(len(own), w, LANES)
        mask = np.uint32((1 << w) - 1)
        for i in range(BLOCK // LANES):
            word, shift = divmod(i * w, 32)
            got = packed[:, word] >> np.uint32(shift) if w else np.zeros((len(own), LANES), np.uint32)
            if shift + w > 32:
                got = got | packed[:, word + 1] << np.uint32(32 - shift)
            out[own, i * LANES : (i + 1) * LANES] = got & mask
    for k in np.flatnonzero(heads["exceptions"]):
        at, n, w = int(starts[k]) + 8 + int(heads["width"][k]) * 32, int(heads["exceptions"][k]), int(heads["width"][k])
        place, high = raw[at : at + n], np.frombuffer(data, "<u4", n, at + n)
        out[k, place] |= high << np.uint32(w)
    return (out + heads["least"][:, None]).reshape(-1)


class ShardWriter:
    """Streams documents into one file."""

    def __init__(self, out, percentile: float = 0.9):
        self.out, self.percentile = out, percentile
        self.out.write(MAGIC)
        self.at, self.tokens, self.held, self.size = len(MAGIC), 0, [], 0
        self.keys, self.counts, self.starts = [], [], []

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(NO_ID if key is None else key)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.size += len(ids)
        self.tokens += len(ids) // 4
        if self.size >= 1 << 22:
            self._write(False)

    def _write(self, last: bool) -> None:
        data = b"".join(self.held)
        whole = len(data) - len(data) % (4 * BLOCK)
        if last and whole < len(data):
            data += data[-4:] * (BLOCK - (len(data) - whole) // 4)
            whole = len(data)
        self.held, self.size = [data[whole:]], len(data) - whole
        for b in pack_blocks(np.frombuffer(data[:whole], "<u4"), self.percentile):
            self.starts.append(self.at)
            self.out.write(b)
            self.at += len(b)

    def close(self) -> None:
        self._write(True)
        docs = np.array(self.keys, "<i8").tobytes() + np.array(self.counts, "<u4").tobytes()
        self.out.write(docs + np.array(self.starts, "<u8").tobytes())
        self.out.write(struct.pack("<QQQQ", self.at, self.at + len(docs), len(self.keys), self.tokens) + MAGIC)


class ShardReader:
    """Reads a shard file by its index."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        docs_at, starts_at, n, self.tokens = struct.unpack("<QQQQ", file.read_at(32, size - 40))
        if file.read_at(8, size - 8) != MAGIC or file.read_at(8, 0) != MAGIC:
            raise ValueError("not a whole shard file")
        self.keys = np.frombuffer(file.read_at(8 * n, docs_at), "<i8")
        self.counts = np.frombuffer(file.read_at(4 * n, docs_at + 8 * n), "<u4").astype(np.int64)
        self.starts = np.append(np.frombuffer(file.read_at(size - 40 - starts_at, starts_at), "<u8").astype(np.int64), docs_at)

    def ids(self, start: int, count: int) -> np.ndarray:
        """Any range of the shard's ids."""
        a, b = start // BLOCK, -(-(start + count) // BLOCK)
        if a >= b:
            return np.zeros(0, np.uint32)
        data = self.file.read_at(int(self.starts[b] - self.starts[a]), int(self.starts[a]))
        return unpack_blocks(data, self.starts[a:b] - self.starts[a])[start - a * BLOCK : start - a * BLOCK + count]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, int, bytes]]:
        """(key, start, ids) of each document, decoding about ``most`` ids at a time."""
        ends = np.cumsum(self.counts)
        k = 0
        while k < len(ends):
            first = int(ends[k] - self.counts[k])
            last = max(k, int(np.searchsorted(ends, first + most, side="right")) - 1)
            ids = self.ids(first, int(ends[last]) - first)
            for j in range(k, last + 1):
                a = int(ends[j] - self.counts[j])
                key = int(self.keys[j])
                yield None if key == NO_ID else key, a, ids[a - first : int(ends[j]) - first].astype("<u4").tobytes()
            k = last + 1


def row_slices(batches: Iterator, most: int = 256) -> Iterator:
    """Cuts Arrow batches into so many rows, so that Python holds objects for a slice and not
    a batch. Nothing is copied."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def narrow(ids: list[bytes]) -> tuple[bool, list[bytes]]:
    """The same ids in two bytes each, or as they are (True) if one of them needs more."""
    data = np.frombuffer(b"".join(ids), "<u4")
    if data.max(initial=0) > 0xFFFF:
        return True, ids
    half, ends = data.astype("<u2").tobytes(), np.cumsum([0, *map(len, ids)]) // 2
    return False, [half[a:b] for a, b in itertools.pairwise(ends.tolist())]


def widen(ids: bytes) -> bytes:
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, percentile: float = 0.9, shards: int | None = None) -> DataFrame:
    """Writes shard files in ascending id order and returns their manifest (shard, file,
    documents, tokens), itself a written table of one file in ``folder``. The driver handles a
    row per shard file.

    Shard borders are quantiles of the ids, from a scan of that column alone; a run of one id
    is not cut, but ids are what identifies documents, so runs are short. Token ids are
    shuffled in two bytes each, in four where a slice of the texts has one beyond 65535."""
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shards = shards or max(8, shuffle_partitions(spark))
    cuts = own.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 100 * shards)).first()[0] or [] if shards > 1 else []
    edges = np.array(sorted(set(cuts)), np.int64)
    def encoded(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        enc, end = encoder(path), end_id.to_bytes(4, "little")
        for keys, texts in text_slices(row_slices(batches)):
            wide, ids = narrow([x + end for x in enc.encode(texts)])
            shard = [0 if k is None else int(np.searchsorted(edges, k)) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(keys, pa.int64()), pa.array([zlib.crc32((t or "").encode()) for t in texts], pa.int64()), pa.array([wide] * len(ids), pa.bool_()), pa.array(ids, pa.binary())], names=["shard", "doc_id", "tie", "wide", "ids"])
        give_back()

    def written(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        name = f"{base}/shard-{task.partitionId():06d}.pfor"
        draft = f"{name}.{task.taskAttemptId()}"
        out = writer = None
        for batch in row_slices(batches):
            for key, wide, ids in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4)), strict=True):
                if writer is None:
                    out = where.open_output_stream(draft)
                    writer = ShardWriter(out, percentile)
                writer.add(key, ids if wide else widen(ids))
        if writer is not None:
            writer.close()
            out.close()
            where.move(draft, name)
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "file": name, "documents": len(writer.keys), "tokens": writer.tokens}], schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    dealt = own.mapInArrow(encoded, "shard int, doc_id long, tie long, wide boolean, ids binary").repartitionById(len(edges) + 1, F.col("shard")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    made = dealt.mapInArrow(written, "shard int, file string, documents long, tokens long")
    manifest = spark.createDataFrame(sorted(made.collect()), made.schema).coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, read back from the files; start
    counts the ids of all documents before it, over all shards. A task reads neighbouring
    files of READ_TOKENS ids together (or one file), of fewer ids where cores would idle. The
    driver handles a row per shard file."""
    spark = manifest.sparkSession
    found = sorted(manifest.collect())
    most = min(READ_TOKENS, sum(r.tokens for r in found) // spark.sparkContext.defaultParallelism)
    rows, base, tasks, held = [], 0, 0, 0
    for r in found:
        if held and held + r.tokens > most:
            tasks, held = tasks + 1, 0
        rows.append((tasks, r.file, base))
        base, held = base + r.tokens, held + r.tokens

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        where, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for r in batch.to_pylist():
                with where.open_input_file(r["file"]) as file:
                    held, size = [], 0
                    for key, start, ids in ShardReader(file).documents():
                        held.append((key, r["base"] + start, len(ids) // 4, ids))
                        size += len(ids)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
        give_back()

    files = spark.createDataFrame(rows, "n int, file string, base long")
    return files.repartitionById(tasks + 1, F.col("n")).select("file", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back; the digest replaces the ids."""
    folder = Scratch(spark, "token-files").root
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_token_files(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op8_token_files": op8_token_files}
ORACLE_SQL: dict[str, str] = {}
