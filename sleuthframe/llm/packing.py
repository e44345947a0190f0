"""Hierarchical multi-length packing of tokenized documents.

Documents are routed to tiers of context sizes (powers of two), each tier is packed, gaps in
long windows are filled from shorter tiers, and finished sequences are dealt to step groups
of nearly equal tokens. A partition is packed on its own, batch by batch, so nothing is
shuffled, no key can grow hot and memory follows ``batch_tokens``. What a partition has left
at its end is cut into sequences whose lengths are powers of two, so padding is nil.

Defined cases: a null or empty text is its end token alone; repeated rows and repeated or null
ids are packed as documents of their own; a text of any length is cut into as many pieces as
it needs; an empty table gives no rows; other columns of the input are not read."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import default_tokenizer, encoder, give_back, text_slices

TIERS = (512, 1024, 2048, 4096)
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, window int, step_group long, ids binary"


class Packer:
    """Packs token counts; holds no tokens. ``add`` takes documents, ``flush`` returns
    (doc, start, length, sequence, offset, window) of the batch and the lengths of its
    sequences. Documents are numbered as they come."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) for t in tiers):
            raise ValueError("tiers must be rising powers of two")
        self.tiers = tiers
        self.queues: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
        self.pieces: list[tuple[int, int, int, int, int, int]] = []
        self.lengths: list[int] = []

    def _sequence(self, parts: list[tuple[int, int, int]], window: int) -> None:
        at, number = 0, len(self.lengths)
        for doc, start, length in parts:
            self.pieces.append((doc, start, length, number, at, window))
            at += length
        self.lengths.append(at)

    def _route(self, doc: int, start: int, length: int) -> None:
        """To the shortest tier that holds the piece."""
        self.queues[next(t for t in self.tiers if length <= t)].append((doc, start, length))

    def add(self, doc: int, tokens: int) -> None:
        """Whole windows of the longest tier are cut off; the rest is routed."""
        longest = self.tiers[-1]
        full = tokens - tokens % longest
        for start in range(0, full, longest):
            self._sequence([(doc, start, longest)], longest)
        if tokens > full:
            self._route(doc, full, tokens - full)

    def _fill(self, room: int, below: int) -> list[tuple[int, int, int]]:
        """Pieces of shorter tiers, the longest first, that fill a gap; the last may be cut."""
        parts = []
        for tier in reversed(self.tiers[:below]):
            queue = self.queues[tier]
            while room and queue:
                doc, start, length = queue.pop()
                take = min(length, room)
                parts.append((doc, start, take))
                room -= take
                if take < length:
                    self._route(doc, start + take, length - take)
        return parts

    def flush(self, last: bool = False) -> tuple[list[tuple[int, int, int, int, int, int]], list[int]]:
        """Packs what is queued. All but the last flush leave less than a window of each tier
        to the next batch."""
        for k in range(len(self.tiers) - 1, 0, -1):
            window, queue = self.tiers[k], self.queues[self.tiers[k]]
            queue.sort(key=lambda p: p[2])
            while queue:
                parts = [queue.pop()]
                parts += self._fill(window - parts[0][2], k)
                room = window - sum(p[2] for p in parts)
                if room and queue:  # no shorter piece is left, and this tier's fill half a window each
                    doc, start, length = queue.pop(0)
                    parts.append((doc, start, room))
                    room, rest = 0, length - room
                    if rest:
                        self._route(doc, start + length - rest, rest)
                        queue.sort(key=lambda p: p[2])
                if room:
                    for p in parts:
                        self._route(*p)
                    break
                self._sequence(parts, window)
        shortest = self.tiers[0]
        queue = self.queues[shortest]
        self.queues[shortest] = []
        parts, room = [], shortest
        for doc, start, length in queue:
            while length:
                take = min(length, room)
                parts.append((doc, start, take))
                start, length, room = start + take, length - take, room - take
                if not room:
                    self._sequence(parts, shortest)
                    parts, room = [], shortest
        if last:
            self._powers(parts + [p for t in self.tiers[1:] for p in self.queues[t]])
            self.queues = {t: [] for t in self.tiers}
        else:
            self.queues[shortest] = parts
        out = self.pieces, self.lengths
        self.pieces, self.lengths = [], []
        return out

    def _powers(self, parts: list[tuple[int, int, int]]) -> None:
        """Cuts the remainder of a partition into sequences of power-of-two lengths."""
        left = sum(p[2] for p in parts)
        parts = parts[::-1]
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            left -= size
            room, own = size, []
            while room:
                doc, start, length = parts.pop()
                take = min(length, room)
                own.append((doc, start, take))
                room -= take
                if take < length:
                    parts.append((doc, start + take, length - take))
            self._sequence(own, size)


def balance(lengths: list[int], group_tokens: int) -> list[int]:
    """A step group for each sequence: the longest first, each to the group with the fewest
    tokens, so groups differ by less than the longest sequence."""
    groups = max(1, round(sum(lengths) / group_tokens))
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        tokens, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (tokens + lengths[k], g))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, tiers: tuple[int, ...] = TIERS, group_tokens: int = 1 << 18, batch_tokens: int = 1 << 21) -> DataFrame:
    """One row per piece: its document, place and ids (little-endian unsigned 32-bit), its
    sequence, offset there, the sequence's window and step group. Sequence and group numbers
    hold the partition in their upper bits; the rows of a file scan come in the same order
    again, so a repeated task makes the same sequences."""
    path = tokenizer or default_tokenizer()

    def packed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        end, packer, enc = end_id.to_bytes(4, "little"), Packer(tiers), encoder(path)
        ids: dict[int, tuple[int | None, bytes]] = {}
        count = tokens = sequences = groups = 0

        def emit(last: bool) -> Iterator:
            nonlocal sequences, groups
            pieces, lengths = packer.flush(last)
            of = balance(lengths, group_tokens)
            for i in range(0, len(pieces), 4096):
                part = pieces[i : i + 4096]
                cols = [
                    [ids[d][0] for d, *_ in part],
                    [p[1] for p in part],
                    [p[2] for p in part],
                    [len(ids[p[0]][1]) // 4 for p in part],
                    [base + sequences + p[3] for p in part],
                    [p[4] for p in part],
                    [p[5] for p in part],
                    [base + groups + of[p[3]] for p in part],
                    [ids[p[0]][1][4 * p[1] : 4 * (p[1] + p[2])] for p in part],
                ]
                kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])
            sequences += len(lengths)
            groups += max(of, default=-1) + 1
            kept = {p[0] for q in packer.queues.values() for p in q}
            for d in [d for d in ids if d not in kept]:
                del ids[d]

        for keys, texts in text_slices(batches):
            for key, found in zip(keys, enc.encode(texts), strict=True):
                found += end
                ids[count] = key, found
                packer.add(count, len(found) // 4)
                count += 1
                tokens += len(found) // 4
            if tokens >= batch_tokens:
                yield from emit(False)
                tokens = 0
        yield from emit(True)
        del ids, packer
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(packed, SCHEMA)


def op1_pack_hierarchical(spark, sf_dir: str) -> DataFrame:
    """All documents packed; the digest of a piece's ids replaces the ids."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


QUERIES = {"op1_pack_hierarchical": op1_pack_hierarchical}
ORACLE_SQL: dict[str, str] = {}
