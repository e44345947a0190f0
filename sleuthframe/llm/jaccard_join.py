"""Similarity self-join of documents on sets of word n-grams (Jaccard), with Bayesian pruning.

Words are the white-space-separated tokens of the lower-cased text; a text's set holds its
runs of five words, or, below five, all its words as one. Texts that are equal are one node;
links join different texts.

1. Every text gets 160 MinHash values. 32 bands of five make candidates: texts that share a
   band. At a similarity of 0.8 a pair shares none with probability 3e-6, above it with less.
2. The least text of a band is its star, and a text goes to each of its stars once: texts
   alike mostly share one or two. A pair is looked at in the least of the stars it shares, so
   once. Nothing is closed over bands, and loosely alike texts make no chains.
3. The texts of a star are dealt into chunks of bounded number and size, and each pair of
   chunks is a tile. In a tile the MinHash values of all pairs are compared 16 at a time, and a
   pair is dropped as soon as the posterior probability that its similarity reaches the
   threshold (uniform prior) falls below the tolerance of 1e-8.
4. The rest is verified exactly on the sets (64-bit hashes of the n-grams). A tile returns for
   each text the count of its links and one link that ties it to the tile's group, never pairs.

A star of one chunk, as nearly all are, sends a text once. Counting all links of a larger
group of different texts needs every two of them side by side once, so there a text is sent
once for each chunk of its star; exact copies are one text and count as one.

Defined cases: null, empty and blank texts have no n-gram, no link and are each a class of
their own; a repeated row is a copy (or, if blank, a class of its own like its twin); null ids
are nodes like others, a class of theirs alone has the null id; texts of any length are whole
sets; an empty table gives no rows; other columns of the input are not read."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, give_back, shuffle_partitions, unused

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-8
BANDS, ROWS, STEP = 32, 5, 16
#: Texts and characters of a chunk, and texts of a block that is compared at once.
CHUNK, CHUNK_CHARS, BLOCK = 512, 4_000_000, 128
_MASK = (1 << 64) - 1


def _constants(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers from a counter (splitmix)."""
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & _MASK
        out.append((z ^ z >> 31) | 1)
    return np.array(out, np.uint64)


class Shingler:
    """Sets of n-gram hashes; word hashes are kept in a bounded cache."""

    def __init__(self, words: int = WORDS, most: int = 400_000):
        self.words, self.most, self.known = words, most, {}
        self.factors = _constants(words, 11)

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.most:
            known = self.known = {}
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = self.words
        if len(h) < n:
            h = np.concatenate([h, np.full(n - len(h), len(h), np.uint64)])
        x = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            y = h[k : len(h) - n + 1 + k] * self.factors[k]
            x += y ^ (y >> np.uint64(29))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique(x ^ (x >> np.uint64(32)))


def minhash(grams: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """Least values of ``count`` hash functions over a set (32 bits each)."""
    a, b = _constants(count, 23), _constants(count, 37)
    least = np.full(count, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(grams), 2048):
        x = grams[i : i + 2048]
        for k in range(0, count, 32):
            v = (a[k : k + 32, None] * x[None, :] + b[k : k + 32, None]) >> np.uint64(32)
            least[k : k + 32] = np.minimum(least[k : k + 32], v.min(axis=1))
    return least.astype("<u4")


def fewest_matches(compared: int, threshold: float, tolerance: float) -> int:
    """Fewest of so many equal values at which the posterior probability of a similarity of at
    least ``threshold`` is not below the tolerance. With a uniform prior that probability is
    P(Binomial(compared + 1, threshold) <= matches)."""
    p = 0.0
    for m in range(compared + 1):
        p += comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if p >= tolerance:
            return m
    return compared


def surviving(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Which pairs of two signature matrices are left after incremental comparison."""
    count = np.zeros((len(a), len(b)), np.int16)
    alive = np.ones(count.shape, bool)
    for k in range(0, a.shape[1], STEP):
        if alive.sum() * 8 < alive.size:  # few pairs are left: compare these alone
            i, j = np.nonzero(alive)
            if not len(i):
                break
            count[i, j] += (a[i, k : k + STEP] == b[j, k : k + STEP]).sum(axis=1, dtype=np.int16)
        else:
            count += (a[:, None, k : k + STEP] == b[None, :, k : k + STEP]).sum(axis=2, dtype=np.int16)
        alive &= count >= fewest_matches(min(k + STEP, a.shape[1]), threshold, tolerance)
    return alive


def common_counts(a: list[np.ndarray], b: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j), exactly."""
    if len(pairs) < 64:
        return np.array([len(np.intersect1d(a[i], b[j], assume_unique=True)) for i, j in pairs], np.int64)
    shared = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    total = np.zeros((len(a), len(b)))
    for k in range(0, len(shared), 8192):
        part = shared[k : k + 8192]
        sides = []
        for group in (a, b):
            m = np.zeros((len(group), len(part)), np.float32)
            for r, grams in enumerate(group):
                cut = grams[np.searchsorted(grams, part[0]) : np.searchsorted(grams, part[-1], side="right")]
                at = np.searchsorted(part, cut)
                m[r, at[part[at] == cut]] = 1
            sides.append(m)
        total += sides[0] @ sides[1].T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def tile_links(a: list[np.ndarray], b: list[np.ndarray] | None, sig_a: np.ndarray, sig_b: np.ndarray | None, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, elsewhere=None) -> np.ndarray:
    """Verified links of a block as (i, j); without ``b`` those inside ``a``, i < j. Pairs that
    ``elsewhere(i, j)`` holds are looked at in another tile."""
    same = b is None
    alive = surviving(sig_a, sig_a if same else sig_b, threshold, tolerance)
    if same:
        alive = np.triu(alive, 1)
        b = a
    pairs = np.argwhere(alive)
    if elsewhere and len(pairs):
        pairs = pairs[[not elsewhere(i, j) for i, j in pairs.tolist()]]
    if not len(pairs):
        return pairs
    size_a, size_b = np.array([len(x) for x in a])[pairs[:, 0]], np.array([len(x) for x in b])[pairs[:, 1]]
    limit = Fraction(str(threshold))
    both = common_counts(a, b, pairs)
    return pairs[(both * limit.denominator >= (size_a + size_b - both) * limit.numerator) & (both > 0)]


class _Side:
    """The texts of one side of a tile."""

    def __init__(self, rows: list[dict], shingler: Shingler):
        rows.sort(key=lambda r: r["fp"])
        self.rows = rows
        self.grams = [shingler(r["text"]) for r in rows]
        self.sigs = np.frombuffer(b"".join(r["sig"] for r in rows), "<u4").reshape(len(rows), BANDS * ROWS)
        self.less = [frozenset(r["less"]) for r in rows]


def side_links(one: _Side, other: _Side | None, threshold: float, tolerance: float) -> np.ndarray:
    """Links of a tile, block by block; without ``other`` those inside ``one``."""
    out, right = [], other or one
    for i in range(0, len(one.rows), BLOCK):
        for j in range(0 if other else i, len(right.rows), BLOCK):
            a, b = slice(i, i + BLOCK), slice(j, j + BLOCK)
            shared = lambda x, y, i=i, j=j: not one.less[i + x].isdisjoint(right.less[j + y])
            if other is None and i == j:
                found = tile_links(one.grams[a], None, one.sigs[a], None, threshold, tolerance, shared)
            else:
                found = tile_links(one.grams[a], right.grams[b], one.sigs[a], right.sigs[b], threshold, tolerance, shared)
            if len(found):
                out.append(found + [i, j])
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def least_linked(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of so many places the least one that links tie it to."""
    root = np.arange(count)
    while True:
        new = root.copy()
        np.minimum.at(new, left, root[right])
        np.minimum.at(new, right, root[left])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tiles(words: int, threshold: float, tolerance: float):
    """Streams rows sorted by tile; one tile is in memory at a time."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler = Shingler(words)
        schema = pa.schema([("node", pa.binary()), ("root", pa.binary()), ("texts", pa.int64()), ("documents", pa.int64())])

        def done(rows):
            sides = [[r for r in rows if r["side"] == s] for s in (0, 1)]
            if not sides[0] or rows[0]["p"] != rows[0]["q"] and not sides[1]:
                return None
            one, other = _Side(sides[0], shingler), _Side(sides[1], shingler) if sides[1] else None
            links = side_links(one, other, threshold, tolerance)
            if not len(links):
                return None
            every = sides[0] + sides[1]
            left, right = links[:, 0], links[:, 1] + (len(sides[0]) if sides[1] else 0)
            copies = np.array([r["copies"] for r in every])
            texts = np.bincount(left, minlength=len(every)) + np.bincount(right, minlength=len(every))
            docs = np.bincount(left, copies[right], len(every)) + np.bincount(right, copies[left], len(every))
            own = np.flatnonzero(texts)
            root = least_linked(len(every), left, right)
            best: dict[int, bytes] = {}  # of each group the least text, so that tiles agree
            for k in own:
                best[root[k]] = min(best.get(root[k], every[k]["fp"]), every[k]["fp"])
            cols = [pa.array([every[k]["fp"] for k in own], pa.binary()), pa.array([best[root[k]] for k in own], pa.binary()), pa.array(texts[own].astype(np.int64)), pa.array(docs[own].astype(np.int64))]
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        rows, now = [], None
        for batch in batches:
            for r in batch.to_pylist():
                key = r["star"], r["p"], r["q"]
                if key != now and rows:
                    out = done(rows)
                    if out is not None:
                        yield out
                    rows = []
                now = key
                rows.append(r)
        if rows and (out := done(rows)) is not None:
            yield out
        rows, out = [], None
        shingler.known = {}
        give_back()

    return run


def _signed(words: int):
    """(doc_id, fp, signature, characters) of documents; a task signs a repeated text once."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler, seen = Shingler(words), {}
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sigs, sizes = [], []
                for fp, t in zip(part.column(2).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if fp not in seen:
                        if len(seen) >= 4096:
                            seen.clear()
                        grams = shingler(t)
                        seen[fp] = minhash(grams).tobytes() if len(grams) else None
                    sigs.append(seen[fp])
                    sizes.append(len(t))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "fp", "sig", "chars"])
        del shingler, seen
        give_back()

    return run


def candidates(texts: DataFrame, scratch: Scratch, chunk: int, chunk_chars: int) -> DataFrame:
    """Of each text that shares a band (fp, least, copies, sig, stars): its stars with the
    number of chunks that the star's texts are dealt into. All joins are of written tables, so
    the planner may split a frequent band or star over tasks."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.substr("sig", k * (4 * ROWS) + 1, F.lit(4 * ROWS)))
    bands = texts.select(F.xxhash64("fp").alias("n"), F.posexplode(cut)).select("n", F.xxhash64("pos", "col").alias("band"))
    stars = bands.groupBy("band").agg(F.count("*").alias("m"), F.min("n").alias("star")).where("m > 1")
    stars = scratch.save(stars.select("band", "star"), "stars")
    held = scratch.save(bands.join(stars, "band").groupBy("n").agg(F.collect_set("star").alias("stars")), "held")
    chosen = scratch.save(texts.withColumn("n", F.xxhash64("fp")).join(held, "n"), "chosen")
    spread = chosen.select("fp", "chars", F.explode("stars").alias("star"))
    chunks = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("chars") / chunk_chars)).cast("int")
    sizes = scratch.save(spread.groupBy("star").agg(chunks.alias("chunks")).where("chunks > 1"), "sizes")
    places = spread.join(sizes, "star", "left").groupBy("fp").agg(F.collect_list(F.struct("star", F.coalesce("chunks", F.lit(1)).alias("chunks"))).alias("stars"))
    return scratch.save(chosen.drop("stars", "n", "chars").join(places, "fp"), "candidates")


def link_texts(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float, tolerance: float, chunk: int = CHUNK, chunk_chars: int = CHUNK_CHARS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, sig) of every document, and of every text with words (fp, copies, least,
    class_id, class_size, class_fp, n_links, n_text_links)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("fp", F.unhex(F.md5("text")))
    rows = scratch.save(own.mapInArrow(_signed(words), "doc_id long, fp binary, sig binary, chars long"), "rows")
    texts = rows.where("sig is not null").groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("chars").alias("chars"))
    texts = scratch.save(texts, "texts")
    chosen = candidates(texts, scratch, chunk, chunk_chars)

    # One row of each text brings its words.
    spoken = own.where(F.length("text") > 0)
    chosen = spoken.join(chosen, (spoken["fp"] == chosen["fp"]) & spoken["doc_id"].eqNullSafe(chosen["least"])).select(chosen["fp"], "copies", "sig", "stars", "text").dropDuplicates(["fp"])
    dealt = chosen.withColumn("to", F.explode("stars")).select("fp", "copies", "sig", "text", "to.star", "to.chunks", F.filter(F.col("stars")["star"], lambda s: s < F.col("to.star")).alias("less"))
    mine = F.pmod(F.xxhash64(F.col("fp"), F.lit(5)), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("fp", "copies", "sig", "star", "less", "text", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"))
    # Tiles of a star lie on partitions next to one another.
    parts = shuffle_partitions(spark)
    place = F.pmod(F.xxhash64("star") % 1_000_003 + F.expr("q * (q + 1) div 2") + F.col("p"), F.lit(parts)).cast("int")
    tiled = dealt.repartitionById(parts, place).sortWithinPartitions("star", "p", "q")
    links = scratch.save(tiled.mapInArrow(_tiles(words, threshold, tolerance), "node binary, root binary, texts long, documents long"), "links")

    groups = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch, "groups")
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp")
    groups = scratch.save(groups, "grouped")
    counts = links.groupBy(F.col("node").alias("fp")).agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    linked = scratch.save(texts.select("fp", "copies", "least").join(counts, "fp").join(groups, "fp"), "linked")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp"))
    classes = scratch.save(linked.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), first["fp"].alias("class_fp")), "classes")
    judged = linked.join(classes, "root").select("fp", "texts", "documents", "class_id", "class_size", "class_fp")
    nodes = texts.select("fp", "copies", "least").join(judged, "fp", "left")
    none = F.col("class_fp").isNull()
    nodes = nodes.select("fp", "copies", "least", F.when(none, F.col("least")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", "copies").alias("class_size"), F.coalesce("class_fp", "fp").alias("class_fp"), (F.col("copies") - 1 + F.coalesce("documents", F.lit(0))).cast("long").alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"))
    nodes = scratch.save(nodes, "nodes")
    scratch.drop("texts", "stars", "held", "chosen", "sizes", "candidates", "links", "grouped", "linked", "classes")
    return rows, nodes


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, text_md5, class_id (least id of the documents tied by
    links), class_md5 (the text of that document), class_size, n_links (other documents linked to it, copies included),
    n_text_links (different texts linked to its own)."""
    rows, nodes = link_texts(docs, id_col, text_col, words, threshold, tolerance)
    out = rows.select("doc_id", "fp").join(nodes, "fp", "left")
    return out.select("doc_id", F.lower(F.hex("fp")).alias("text_md5"), F.lower(F.hex(F.coalesce("class_fp", "fp"))).alias("class_md5"), F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The input's rows with all their columns, one of each class: that of the least id. Rows
    without words all stay."""
    rows, nodes = link_texts(docs, id_col, text_col, words, threshold, tolerance)
    first = nodes.where("fp = class_fp").select("fp", F.col("least").alias("id"), F.lit(True).alias("has_words"))
    blank = rows.where("sig is null").select("fp", F.col("doc_id").alias("id"), F.lit(False).alias("has_words")).distinct()
    kept = first.unionByName(blank)
    fp, key, once = unused(docs.columns, "_fp", "_key", "_once")
    marked = docs.withColumns({fp: F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))), key: F.col(id_col).cast("long")})
    out = marked.join(kept, (marked[fp] == kept["fp"]) & marked[key].eqNullSafe(kept["id"])).select(*[marked[c] for c in marked.columns], F.when(~kept["has_words"], F.monotonically_increasing_id()).alias(once))
    return out.dropDuplicates([fp, key, once]).select(*docs.columns)


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return join_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
ORACLE_SQL: dict[str, str] = {}
