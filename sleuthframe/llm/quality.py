"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are indicators only: word unigrams and bigrams of the lower-cased text, hashed, and
unigrams and bigrams of token shapes (letter case, trailing marks, repetition of the token
before) in steps of their share of the text, so that a text's make-up counts as well as its
words. Each indicator is scaled by the log-count ratio of the classes, each of the two groups
to unit length, and a linear hinge-loss model is fitted by dual coordinate descent. A logistic
curve, fitted on a fifth of the sample that the model has not seen, turns margins into
scores.

The fit uses at most ``per_class`` labelled rows of each class, those whose id's MD5 comes
first, and of these the first whose texts have at most ``sample_chars`` characters together, or
the first alone (bounds stated here, so the driver's share does not grow); every row is scored.
Labels count only where crc32(id as text) mod 3 is not 1, and where all labels of an id agree.

Defined cases: a null or empty text has no indicators and scores by the intercept; null ids
are scored and held_out is null; repeated rows score alike; with no label of one class every
score is 1 or 0 after the other, with no label at all 0.5; an empty table gives no rows; other
columns pass through; the added ones are named by parameters and replace those of their name."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, text_slices

WORD_BITS, SHAPE_BITS = 18, 16
#: Words that a Python worker keeps the shape and the hash of.
CACHED = 1 << 17
STEPS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
MARKS = re.compile(r"[^\w\s]+$")
#: Stands for the shape of a word that repeats the one before.
SAME = zlib.crc32(b"=") & 0xFFFF
_known: dict[str, int] = {}


def shape(word: str) -> str:
    marks = MARKS.search(word)
    body = word[: marks.start()] if marks else word
    kind = "U" if len(body) > 1 and body.isupper() else "C" if body[:1].isupper() else "l" if body.isalpha() else "d" if body.isdigit() else "x" if body else ""
    return kind + (marks[0][-2:] if marks else "")


def word_codes(words: list[str]) -> np.ndarray:
    """For each word 32 bits of the lower-cased word and 16 bits of its shape."""
    if len(_known) > CACHED:
        _known.clear()
    for w in set(words):
        if w not in _known:
            _known[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) << 16 | zlib.crc32(shape(w).encode("utf-8", "surrogatepass")) & 0xFFFF
    return np.fromiter(map(_known.__getitem__, words), np.int64, len(words))


def indicators(text: str) -> np.ndarray:
    """Sorted numbers of a text's features: words below 2**18, shapes above."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32)
    codes = word_codes(words)
    h = (codes >> 16).astype(np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
    hashed = np.unique(np.concatenate([h, pairs]) & np.uint64((1 << WORD_BITS) - 1))
    s = codes & 0xFFFF
    s[1:][codes[1:] == codes[:-1]] = SAME
    found = []
    for grams in (s + (1 << 33), s[:-1] << 16 | s[1:]):
        grams, counts = np.unique(grams, return_counts=True)
        keys = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
        for k, step in enumerate(STEPS):
            reached = counts >= step * max(1, counts.sum())
            if not reached.any():
                break
            found.append((keys[reached] * np.uint64(31) + np.uint64(k * 0x9E3779B1) >> np.uint64(3)) % np.uint64(1 << SHAPE_BITS))
    return np.concatenate([hashed, np.unique(np.concatenate(found)) + np.uint64(1 << WORD_BITS)]).astype(np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 12, alpha: float = 1.0) -> dict:
    """The model as a scale and a weight per feature, an intercept and a logistic curve."""
    size = (1 << WORD_BITS) + (1 << SHAPE_BITS)
    if len(set(labels.tolist())) < 2:
        p = float(labels[0]) if len(labels) else 0.5
        return {"weights": np.zeros(size, np.float32), "scale": np.zeros(size, np.float32), "bias": 0.0, "curve": (0.0, math.inf if p == 1 else -math.inf if p == 0 else 0.0)}
    test = np.arange(len(rows)) % 5 == 4
    if len(set(labels[test].tolist())) < 2 or len(set(labels[~test].tolist())) < 2:
        test[:] = False
    counts = {y: np.full(size, alpha) for y in (0, 1)}
    for k in np.flatnonzero(~test):
        counts[int(labels[k])][rows[k]] += 1
    scale = (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float32)
    values = [scaled(r, scale) for r in rows]
    y = np.where(labels == 1, 1.0, -1.0)
    share = {s: max(1, int((y[~test] == s).sum())) for s in (1.0, -1.0)}
    top = {s: c * (~test).sum() / (2 * share[s]) for s in share}
    w, bias, a = np.zeros(size), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    order, rng = np.flatnonzero(~test), np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(order):
            r, v = rows[k], values[k]
            g = y[k] * (float(w[r] @ v) + bias) - 1
            new = min(max(a[k] - g / square[k], 0.0), top[y[k]])
            if (d := (new - a[k]) * y[k]) != 0.0:
                w[r] += d * v
                bias += d
                a[k] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    margins = np.array([float(w[r] @ v) + bias for r, v in zip(rows, values, strict=True)])
    use = test if test.any() else np.ones(len(rows), bool)
    return {"weights": w.astype(np.float32), "scale": scale, "bias": bias, "curve": logistic(margins[use], (labels[use] == 1).astype(float))}


def scaled(row: np.ndarray, scale: np.ndarray) -> np.ndarray:
    v = scale[row]
    cut = int(np.searchsorted(row, 1 << WORD_BITS))
    for part in (v[:cut], v[cut:]):
        if n := float(np.sqrt(part @ part)):
            part /= n
    return v


def logistic(margins: np.ndarray, hits: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with targets drawn in a little from 0 and 1."""
    n1, n0 = hits.sum(), len(hits) - hits.sum()
    goal = np.where(hits > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    s, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(s * margins + b, -30, 30)))
        e, q = p - goal, p * (1 - p) + 1e-9
        grad = np.array([e @ margins + 1e-3 * s, e.sum()])
        hess = np.array([[q @ margins**2 + 1e-3, q @ margins], [q @ margins, q.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        s, b = s - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if abs(step).max() < 1e-8:
            break
    return max(s, 1e-3), b


def scores(texts: list[str], model: dict) -> np.ndarray:
    """Of many texts at once: one flat array of features, sums by text and feature group."""
    rows = [indicators(t) for t in texts]
    flat = np.concatenate([*rows, np.zeros(0, np.int32)])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = model["scale"][flat].astype(np.float64)
    group = 2 * of + (flat >= 1 << WORD_BITS)
    length = np.sqrt(np.bincount(group, value * value, 2 * len(rows)))
    length[length == 0] = 1.0
    margin = np.bincount(of, model["weights"][flat] * value / length[group], len(rows)) + model["bias"]
    slope, shift = model["curve"]
    with np.errstate(over="ignore", invalid="ignore"):
        return 1 / (1 + np.exp(-np.nan_to_num(slope * margin + shift, posinf=np.inf, neginf=-np.inf)))


def labelled(labels: DataFrame, key, label_col: str) -> DataFrame:
    """(_id, _y) of the ids that the fit may use."""
    known = labels.where(F.col(label_col).isin(0, 1) & key.isNotNull() & (F.crc32(key.cast("string").cast("binary")) % 3 != 1))
    return known.groupBy(key.alias("_id")).agg(F.min(label_col).alias("_low"), F.max(label_col).alias("_y")).where("_low = _y").select("_id", F.col("_y").cast("int").alias("_y"))


def within(found: list[tuple[int, int, int]], most: int) -> list[int]:
    """Of (id, label, characters) the ids that a class's budget of characters holds, in the
    order of their MD5."""
    out = []
    for y in (0, 1):
        spent = 0
        for i, _, n in sorted((r for r in found if r[1] == y), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])):
            spent += n
            if spent > most and spent > n:
                break
            out.append(i)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 4000, sample_chars: int = 20_000_000) -> dict:
    """Fits on the driver, on the bounded sample."""
    key = F.col(id_col).cast("long")
    known = labelled(labels, key, label_col)
    picked = None
    for y in (0, 1):
        one = known.where(F.col("_y") == y).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    rows = {r[0]: r[1] for r in picked.collect()}
    if not rows:
        return fit([], np.zeros(0, int))
    # At most 2 * per_class ids: a proven bound for the broadcast.
    spark = docs.sparkSession
    sample = F.broadcast(spark.createDataFrame([(i,) for i in rows], "_id long"))

    def featured(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([indicators(t).tobytes() for t in texts], pa.binary())], names=["_id", "chars", "row"])
        give_back()

    # One text per id, should an id repeat: the least.
    texts = docs.select(key.alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t")).join(sample, "_id").groupBy("_id").agg(F.min("_t").alias("_t"))
    scratch = Scratch(spark, "quality")
    table = scratch.save(texts.mapInArrow(featured, "_id long, chars long, row binary"), "sample")
    chosen = within([(i, rows[i], n) for i, n in table.select("_id", "chars").collect()], sample_chars)
    if not chosen:
        return fit([], np.zeros(0, int))
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in chosen], "_id long"))
    found = {i: np.frombuffer(bytes(r), np.int32) for i, r in table.join(wanted, "_id", "left_semi").select("_id", "row").collect()}
    scratch.drop("sample")
    ids = sorted(found, key=lambda i: zlib.crc32(str(i).encode()))
    model = fit([found[i] for i in ids], np.array([rows[i] for i in ids], int))
    del found, rows
    give_back()
    return model


def classify(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """The input with the score and the prediction."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out, part, size = [], [], 0
            for t in batch:
                part.append(t or "")
                size += len(part[-1])
                if size > 1_000_000:
                    out.append(scores(part, model))
                    part, size = [], 0
            yield pd.Series(np.concatenate([*out, scores(part, model)]), dtype="float64")
        give_back()

    out = docs.withColumn(score_col, scored(F.col(text_col).cast("string")))
    return out.withColumn(predicted_col, (F.col(score_col) >= 0.5).cast("int"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"), "score", "predicted")


QUERIES = {"op5_quality": op5_quality}
ORACLE_SQL: dict[str, str] = {}
