"""Exact top-k search by tiled matrix products.

Queries and candidates are packed into blocks of rows; every pair of a query block and a
candidate block is one tile. A tile is a matrix product, from which each query keeps its k
best by partial selection; the lists of a query are then merged in a tree, eight at a time, so
no task holds more than eight lists of a block. A query block travels once per candidate
block: the stated query set against all rows, in blocks.

Components become floor(scale * x) of the double x. Products run in doubles where they are
exact (below 2**53), else in whole numbers of any size; scores beyond 64 bits are clamped.

Defined cases: vectors that are null or hold a null, NaN or infinite component, and rows with
a null id, take no part; vectors of fewer components than others count zeros for the rest;
rows that repeat a candidate's id and vector count once each, but no row of the query's own id
is its candidate; equal scores go to the smaller id; an empty table or no query gives no rows;
other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

FAN = 8
BLOCKS = "block long, ids binary, cells binary, dims int, big boolean"


def floored(vectors: list[list[float]], scale: float) -> tuple[np.ndarray, bool]:
    """floor(scale * x) as a matrix of 64-bit integers, or of Python integers where some do
    not fit well below 64 bits."""
    dims = max(map(len, vectors))
    x = np.zeros((len(vectors), dims))
    for r, v in enumerate(vectors):
        x[r, : len(v)] = v
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    if not y.size or np.abs(y).max() < 2.0**62:
        return y.astype("<i8"), False
    exact = [[int(b) if np.isfinite(b) else int(scale) * int(a) for a, b in zip(p, q, strict=True)] for p, q in zip(x, y, strict=True)]
    return np.array(exact, dtype=object), True


def block_rows(vectors: DataFrame, rows: int, scale: float) -> DataFrame:
    """(id, vector) packed into blocks of up to so many rows, within partitions."""

    def blocks(batches: Iterator) -> Iterator:
        import json

        import pyarrow as pa
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 32, 0
        ids: list[int] = []
        held: list[list[float]] = []

        def emit():
            cells, big = floored(held, scale)
            data = json.dumps(cells.tolist()).encode() if big else cells.tobytes()
            cols = [[base + n], [np.array(ids, "<i8").tobytes()], [data], [cells.shape[1]], [big]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "ids", "cells", "dims", "big"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                held.append(v)
                if len(ids) == rows:
                    yield emit()
                    ids, held, n = [], [], n + 1
        if ids:
            yield emit()

    return vectors.mapInArrow(blocks, BLOCKS)


def _load(ids: bytes, cells: bytes, dims: int, big: bool) -> tuple[np.ndarray, np.ndarray]:
    import json

    keys = np.frombuffer(ids, "<i8")
    if big:
        return keys, np.array(json.loads(cells), dtype=object).reshape(len(keys), dims)
    return keys, np.frombuffer(cells, "<i8").reshape(len(keys), dims)


def tile_top(query_ids, queries, ids, cells, k: int) -> list[list[tuple[int, int, int]]]:
    """Per query the k best of the tile as (-score, id, occurrence), ascending."""
    dims = max(queries.shape[1], cells.shape[1])
    wide = lambda m: m if m.shape[1] == dims else np.hstack([m, np.zeros((len(m), dims - m.shape[1]), m.dtype)])
    q, c = wide(queries), wide(cells)
    bound = (int(abs(q).max()) if q.size else 0) * (int(abs(c).max()) if c.size else 0) * dims
    order = np.argsort(ids, kind="stable")
    ids, c = ids[order], c[order]
    out = []
    if bound < 1 << 46 and len(ids) <= 1 << 15:
        # Exact in doubles; one key orders by score, then by the smaller id.
        score = (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
        key = score * (1 << 16) + (len(ids) - np.arange(len(ids)))
        for r, own in enumerate(query_ids):
            keys = key[r].copy()
            keys[ids == own] = np.iinfo(np.int64).min
            best = np.argpartition(keys, -min(k, len(keys)))[-min(k, len(keys)) :]
            best = best[ids[best] != own]
            out.append(sorted((-int(score[r, b]), int(ids[b]), int(b)) for b in best))
        return out
    qo, co = q.astype(object), c.astype(object)
    for r, own in enumerate(query_ids):
        s = co @ qo[r]
        out.append(sorted((-int(min(max(s[b], -(1 << 63) + 1), (1 << 63) - 1)), int(ids[b]), b) for b in range(len(ids)) if ids[b] != own)[:k])
    return out


def _lists(tops: list[list[tuple[int, int, int]]]) -> tuple[bytes, bytes, bytes]:
    """Lists of a block as lengths, scores and ids."""
    flat = [x for t in tops for x in t]
    return np.array([len(t) for t in tops], "<i4").tobytes(), np.array([-x[0] for x in flat], "<i8").tobytes(), np.array([x[1] for x in flat], "<i8").tobytes()


def merge_lists(parts: list[tuple[bytes, bytes, bytes]], k: int) -> tuple[bytes, bytes, bytes]:
    """The k best of each query from several blocks of lists."""
    read = [(np.frombuffer(n, "<i4"), np.frombuffer(s, "<i8"), np.frombuffer(i, "<i8")) for n, s, i in parts]
    rows = np.concatenate([np.repeat(np.arange(len(n)), n) for n, _, _ in read])
    scores, ids = np.concatenate([x[1] for x in read]), np.concatenate([x[2] for x in read])
    order = np.lexsort((ids, -scores, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    count = np.bincount(rows, minlength=len(read[0][0]))
    place = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    keep = place < k
    return np.minimum(count, k).astype("<i4").tobytes(), scores[keep].tobytes(), ids[keep].tobytes()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = 512, block_size: int = 4096) -> DataFrame:
    """(query_id, rank, id_col, score) of every query row's k highest inner products."""
    import math

    scratch = Scratch(vectors.sparkSession, "top-k")
    inf = float("inf")

    def blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        fine = F.col(id_col).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))
        return scratch.save(block_rows(df.where(fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v")), rows, scale), name)

    shards, asked = blocks(vectors, block_size, "shards"), blocks(queries, query_rows, "queries")
    # Shards are numbered without gaps, partition by partition; the driver sees a count of each.
    part, place = F.shiftright("block", 32), F.col("block").bitwiseAND((1 << 32) - 1)
    counts = sorted(shards.select("block").groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    count = sum(n for _, n in counts)
    if not count:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    before = [(p, sum(n for _, n in counts[:k])) for k, (p, _) in enumerate(counts)]
    offsets = vectors.sparkSession.createDataFrame(before, "part long, before long")
    # The planner takes a table's size from its compressed file, and an exploded one's from before
    # the explosion: blocks are joined by merging alone, so that no driver collects them.
    numbered = shards.withColumn("part", part).join(F.broadcast(offsets), "part").select((F.col("before") + place).alias("shard"), F.struct("ids", "cells", "dims", "big").alias("c"))
    sent = asked.select(F.col("block").alias("query_block"), F.struct("ids", "cells", "dims", "big").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("shard"))

    def tiles(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                qi, q = _load(**r["q"])
                ci, c = _load(**r["c"])
                yield pa.RecordBatch.from_pylist([dict(zip(("query_block", "part", "n", "s", "i"), (r["query_block"], r["shard"], *_lists(tile_top(qi, q, ci, c, k))), strict=True))], schema=schema())

    def schema():
        import pyarrow as pa

        return pa.schema([("query_block", pa.int64()), ("part", pa.int64()), ("n", pa.binary()), ("s", pa.binary()), ("i", pa.binary())])

    def merged(table):
        import pyarrow as pa

        rows = table.to_pylist()
        return pa.Table.from_pylist([dict(zip(("query_block", "part", "n", "s", "i"), (rows[0]["query_block"], rows[0]["part"] // FAN, *merge_lists([(r["n"], r["s"], r["i"]) for r in rows], k)), strict=True))], schema=schema())

    kind = "query_block long, part long, n binary, s binary, i binary"
    tops = sent.hint("merge").join(numbered.hint("merge"), "shard").select("query_block", "shard", "q", "c").mapInArrow(tiles, kind)
    for _ in range(max(1, math.ceil(math.log(count, FAN) - 1e-9))):
        tops = tops.withColumn("up", F.floor(F.col("part") / FAN)).groupBy("query_block", "up").applyInArrow(lambda t: merged(t.drop_columns(["up"])), kind)

    def unpacked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                ids, n = np.frombuffer(r["q"], "<i8"), np.frombuffer(r["n"], "<i4")
                rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(rank.astype("i4")), pa.array(np.frombuffer(r["i"], "<i8")), pa.array(np.frombuffer(r["s"], "<i8"))], names=["query_id", "rank", id_col, "score"])

    named = asked.select(F.col("block").alias("query_block"), F.col("ids").alias("q"))
    return tops.join(named.hint("merge"), "query_block").select("q", "n", "s", "i").mapInArrow(unpacked, f"query_id long, rank int, {id_col} long, score long")


def op7_exact_topk(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 20 = 0"))


QUERIES = {"op7_exact_topk": op7_exact_topk}
ORACLE_SQL = {
    "op7_exact_topk": """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""
}
