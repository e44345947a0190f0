"""Directed cycles of timed edges within a window, counted without listing them.

Edges go to slices of time, with those that follow a slice by less than the window. In a slice, cycles
of nodes are found over pairs of nodes, not over edges. The start times are taken ``STARTS`` at a time;
per pair, a bit for each tells whether an edge lies in its window. A cycle that starts at s is counted as the product
of its pairs' edges in [s, s + width) less that of (s, s + width); its least legs are chosen one by one among
the windows that still hold an edge of every later pair. A cycle is met from the first of its pairs with an edge at a
start, so none is met twice. Edges without a time fit every window; cycles of such edges alone are a slice of their own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Start times taken at once (bits of a mask) and paths held at once.
STARTS, HELD = 62, 500_000
NEVER, TOP = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _spread(times: list[np.ndarray], width: int) -> tuple[int, int]:
    """The least (low, high) of one time of each array, NEVER being no time."""
    if all(x[0] == NEVER for x in times):
        return NEVER, NEVER
    for low in sorted({int(y) for x in times for y in x if y != NEVER}):
        at = [[int(y) for y in x if y == NEVER or low <= y < low + width] for x in times]
        if all(at):
            return low, max(low, *(min(x) for x in at))
    raise AssertionError("no window holds the legs")


def _sets(nodes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each set, the set of each row) of rows of sorted nodes."""
    if n ** nodes.shape[1] < 1 << 62:
        code = nodes[:, 0].astype(np.int64)
        for k in range(1, nodes.shape[1]):
            code = code * n + nodes[:, k]
        _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    else:
        _, first, inverse = np.unique(nodes, axis=0, return_index=True, return_inverse=True)
    return first, inverse.reshape(-1)


class Slice:
    """The edges (u, v, t, id) of one slice; ``t`` is NEVER where it is not known."""

    def __init__(self, u: list, v: list, t: np.ndarray, ids: list, width: int):
        self.names = sorted(set(u) | set(v))
        self.labels = sorted(set(ids), key=lambda x: (x is not None, x))
        node, label = ({x: k for k, x in enumerate(y)} for y in (self.names, self.labels))
        self.n, self.width = len(self.names), width
        code = np.array([node[x] for x in u], np.int64) * self.n + np.array([node[x] for x in v], np.int64)
        pairs, pair = np.unique(code, return_inverse=True)
        self.src, self.dst, rank = pairs // self.n, pairs % self.n, np.array([label[x] for x in ids], np.int64)
        order = np.lexsort((t, rank, pair))
        self.pair, self.rank, self.t = pair[order], rank[order], t[order]
        self.has = self.t != NEVER
        self.times = np.unique(self.t[self.has])
        self.at = np.searchsorted(self.times, self.t)
        self.key = np.sort(self.pair[self.has] * (len(self.times) + 1) + self.at[self.has])
        self.timeless = np.bincount(self.pair[~self.has], minlength=len(pairs))
        self.pair_head = np.searchsorted(self.pair, np.arange(len(pairs)))
        # Edges of one pair and one id are one name, whose times may be several.
        new = np.r_[True, (np.diff(self.pair) != 0) | (np.diff(self.rank) != 0)]
        self.name_head = np.flatnonzero(new)
        self.name_rank = self.rank[self.name_head]
        self.first_name = np.searchsorted(self.name_head, self.pair_head)
        self.found: dict[int, list] = {}

    def scan(self, start: int, stop: int, least: int, most: int, part: int = 0, parts: int = 1) -> None:
        """All cycles whose earliest time is from start to before stop."""
        a, b = np.searchsorted(self.times, [start, stop])
        for i in range(a, b, STARTS):
            self._scan(i, min(i + STARTS, b), least, most, part, parts)

    def _scan(self, i: int, j: int, least: int, most: int, part: int, parts: int) -> None:
        s = j - i
        end = np.searchsorted(self.times, self.times[i:j] + self.width)
        above = np.clip(self.at - i + 1, 0, s).astype(np.uint64)
        below = np.minimum(np.searchsorted(end, self.at, side="right"), above).astype(np.uint64)
        one = np.uint64(1)
        bits = np.where(self.has, (one << above) - (one << below), (one << np.uint64(s)) - one)
        mask, self.name_mask = np.bitwise_or.reduceat(bits, self.pair_head), np.bitwise_or.reduceat(bits, self.name_head)
        starts = np.zeros(len(mask), bool)
        starts[self.pair[self.has & (self.at >= i) & (self.at < j)]] = True
        alive = np.flatnonzero(mask)
        begin = np.searchsorted(self.src[alive], np.arange(self.n + 1))
        first = np.flatnonzero(starts & (np.arange(len(mask)) % parts == part))
        stack = [(first[:, None], mask[first])]
        while stack:
            path, held = stack.pop()
            last = self.dst[path[:, -1]]
            count = begin[last + 1] - begin[last]
            total = int(count.sum())
            if total > HELD and len(path) > 1:
                stack += [(x, y) for x, y in zip(np.array_split(path, 2), np.array_split(held, 2), strict=True)]
                continue
            row = np.repeat(np.arange(len(path)), count)
            q = alive[np.arange(total) - np.repeat(np.cumsum(count) - count - begin[last], count)]
            both = held[row] & mask[q]
            fine = (both != 0) & (~starts[q] | (q > path[row, 0]))
            row, q, both = row[fine], q[fine], both[fine]
            to, size = self.dst[q], path.shape[1] + 1
            back = to == self.src[path[row, 0]]
            if size >= least and back.any():
                self._close(np.column_stack([path[row[back]], q[back]]), both[back], i, end)
            if size < most:
                on = ~back
                for k in range(1, size - 1):
                    on &= to != self.src[path[row, k]]
                if on.any():
                    stack.append((np.column_stack([path[row[on]], q[on]]), both[on]))

    def _close(self, cycles: np.ndarray, held: np.ndarray, i: int, end: np.ndarray) -> None:
        used = np.zeros(len(self.src), bool)
        used[cycles] = True
        place, pairs = np.cumsum(used) - 1, np.flatnonzero(used)
        base, at = pairs[:, None] * (len(self.times) + 1), i + np.arange(len(end))
        free = self.timeless[pairs][:, None]
        to = np.searchsorted(self.key, base + end) + free
        since, after = to - np.searchsorted(self.key, base + at), to - np.searchsorted(self.key, base + at + 1)
        size = cycles.shape[1]
        if int(since.max()) ** size * len(end) >= TOP:
            since, after = since.astype(object), after.astype(object)
        counts = []
        for k in range(0, len(cycles), 1 << 14):
            legs = place[cycles[k : k + (1 << 14)]]
            x, y = since[legs[:, 0]], after[legs[:, 0]]
            for c in range(1, size):
                x, y = x * since[legs[:, c]], y * after[legs[:, c]]
            counts.append((x - y).sum(axis=1))
        counts = np.concatenate(counts)
        fine = counts > 0
        cycles, held, counts = cycles[fine], held[fine], counts[fine]
        if not len(cycles):
            return
        nodes = self.src[cycles]
        turn = (np.argmin(nodes, axis=1)[:, None] + np.arange(size)) % size
        cycles, nodes = np.take_along_axis(cycles, turn, axis=1), np.sort(nodes, axis=1)
        one, group = _sets(nodes, self.n)
        instances = np.zeros(len(one), counts.dtype)
        np.add.at(instances, group, counts)
        # Leg by leg, the least id that some window still allows; of a set only the least go on.
        names = np.zeros(cycles.shape, np.int64)
        for k in range(size):
            name, open_ = self.first_name[cycles[:, k]], np.arange(len(cycles))
            while len(open_):
                open_ = open_[(self.name_mask[name[open_]] & held[open_]) == 0]
                name[open_] += 1
            names[:, k], rank = name, self.name_rank[name]
            best = np.full(len(one), TOP)
            np.minimum.at(best, group, rank)
            fine = rank == best[group]
            cycles, names, group, held = cycles[fine], names[fine], group[fine], (held & self.name_mask[name])[fine]
        stop = np.append(self.name_head, len(self.t))
        times = self.t[self.name_head[names]]
        low = np.where(times == NEVER, TOP, times).min(axis=1)
        low, high = np.where(low == TOP, NEVER, low), times.max(axis=1)
        for r in np.flatnonzero((stop[names + 1] - stop[names] > 1).any(axis=1)):
            low[r], high[r] = _spread([self.t[stop[x] : stop[x + 1]] for x in names[r]], self.width)
        order = np.lexsort((high, low, group))
        order = order[np.r_[True, np.diff(group[order]) != 0]]
        self._keep(size, nodes[one], self.name_rank[names[order]], low[order], high[order], instances)

    def _keep(self, size: int, *parts: np.ndarray) -> None:
        rows = self.found.setdefault(size, [])
        rows.append(parts)
        if sum(len(x[0]) for x in rows) > 8 * HELD:
            self.found[size] = [self._united(size)]

    def _united(self, size: int) -> tuple:
        """One row of each set: its least legs, and its cycles counted."""
        nodes, ranks, low, high, counts = (np.concatenate(x) for x in zip(*self.found[size], strict=True))
        one, group = _sets(nodes, self.n)
        sums = np.zeros(len(one), object if counts.dtype == object or len(counts) * float(counts.max()) > 2.0**62 else np.int64)
        np.add.at(sums, group, counts)
        order = np.lexsort((high, low, *ranks.T[::-1], group))
        order = order[np.r_[True, np.diff(group[order]) != 0]]
        return nodes[one], ranks[order], low[order], high[order], sums

    def batches(self, case: str) -> Iterator:
        import pyarrow as pa

        for size in self.found:
            nodes, ranks, low, high, counts = self._united(size)
            lists = lambda texts, rows: pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype="i4") * size, pa.array(texts, pa.string()).take(pa.array(rows.reshape(-1))))
            some = lambda x: pa.array(x, pa.int64(), mask=x == NEVER)
            yield pa.table({"case_id": pa.array([case] * len(nodes), pa.string()), "ids": lists(self.names, nodes), "legs": lists(self.labels, ranks), "low": some(low), "high": some(high), "instances": pa.array([int(min(c, TOP)) for c in counts], pa.int64())})


RESULT = "case_id string, ids array<string>, legs array<string>, low long, high long, instances long"


def cycle_sets(edges: DataFrame, least: int, most: int, width: int, windows: int = 4, heavy: int = 50_000) -> DataFrame:
    """(case_id, ids, legs, low, high, instances) of ``edges(case_id, u, v, t, id)``, t and width in
    microseconds: per set of nodes the cycles of least to most nodes whose times all lie within less than ``width``, and
    of these the least by (legs, low, high); legs begin at the least node. A slice has so many ``windows``; one of more than ``heavy`` edges is
    searched by several tasks, each of which holds the slice and takes a share of the first pairs."""
    span = windows * width
    edges = edges.where("u <> v")
    at = lambda t: F.expr(f"({t} - pmod({t}, {span}L)) div {span}L")
    timed = edges.where("t is not null").withColumn("slice", F.explode(F.array_distinct(F.array(at("t"), at(f"(t - {width - 1}L)")))))
    # Edges without a time go to every slice, and to one of their own.
    timeless = edges.where("t is null")
    slices = edges.where("t is not null").select("case_id", at("t").alias("slice")).distinct()
    every = timeless.join(slices, "case_id").select(*edges.columns, "slice").unionByName(timeless.withColumn("slice", F.lit(int(NEVER))))
    rows = timed.unionByName(every)
    sizes = rows.groupBy("case_id", "slice").agg(F.ceil(F.count("*") / heavy).cast("int").alias("parts"))
    rows = rows.join(sizes, ["case_id", "slice"])
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spark = edges.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def run(table):
        import pyarrow as pa

        at, parts, part, case = (table.column(c)[0].as_py() for c in ("slice", "parts", "part", "case_id"))
        t = table.column("t").combine_chunks().fill_null(0 if at == NEVER else NEVER).to_numpy(zero_copy_only=False).astype(np.int64)
        held = Slice(table.column("u").to_pylist(), table.column("v").to_pylist(), t, table.column("id").to_pylist(), width)
        held.scan(*((0, 1) if at == NEVER else (at * span, (at + 1) * span)), least, most, part, parts)
        found = list(held.batches(case))
        if not found:
            return pa.schema([("case_id", pa.string()), ("ids", pa.list_(pa.string())), ("legs", pa.list_(pa.string())), ("low", pa.int64()), ("high", pa.int64()), ("instances", pa.int64())]).empty_table()
        out = pa.concat_tables(found)
        if at == NEVER:
            out = out.set_column(3, "low", pa.nulls(len(out), pa.int64())).set_column(4, "high", pa.nulls(len(out), pa.int64()))
        return out

    found = rows.repartition(tasks, "case_id", "slice", "part").groupBy("case_id", "slice", "part").applyInArrow(run, RESULT)
    best = found.groupBy("case_id", "ids").agg(F.min(F.struct("legs", "low", "high")).alias("m"), F.coalesce(F.try_sum("instances"), F.lit(int(TOP))).alias("instances"))
    return best.select("case_id", "ids", "m.legs", "m.low", "m.high", "instances")
