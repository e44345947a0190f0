"""Mixing sources to target weights by iterative proportional fitting. Native throughout.

Token weights are counted in cells of source, language and topic. Raking scales the cells in
turn until the weights of each dimension are in the target proportions; a cell's inclusion
probability is its raked weight over its own tokens. Keeping documents by these probabilities
makes the expected tokens of every source, language and topic stand in the target proportions.
A document is kept or not by a hash of its id, so the choice is the same at every run.

There are two scales. Without ``keep`` the largest probability is 1, so all targets are met and
the cell that is rarest against its target decides how much of the rest is left. With ``keep``,
the share of all tokens to keep, no cell gives more than it has: a value whose target is out of
reach is kept whole, the others share what it lacks by their targets, and capped cells stay at
probability 1 while the rest is raked. ``mix_report`` says which targets were not met.

Only the cells are raked: their number is the product of the three dimensions' sizes, however
many documents there are, and counting them aggregates before the shuffle. The cells sit in
one partition, where each round is three window sums without an exchange.

The text of a document is read once: its cell and tokens are written beside the other columns.

Defined cases: null source or language is a value of its own (shown as ''); a null or empty
text has no words, counts no tokens, and is kept with its cell's probability (1 in a cell
without tokens, so everything stays of a table without words); repeated rows count and share
one decision; targets for values that do not occur are passed over and the others scaled up, and
if none is left, no document with words is kept; targets without a positive one are an error; an
empty table gives no rows; other columns pass through, those named like the added ones are
replaced (``sample`` adds none and so replaces none)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, unused

DIMS = ("source", "lang", "topic")
#: Topics by the family of word endings that prevails; ties go to the earlier one.
TOPICS = (("abstract", r"(tion|ment|keit|heit|ción)([^\p{L}\p{N}]|$)"), ("process", r"(ing|ung|ando|endo)([^\p{L}\p{N}]|$)"))
#: Rounds of raking and of those per written table.
ROUNDS, STRIDE = 20, 10
SEED = "mix-1"
#: Share of the tokens that the pipeline keeps.
KEEP = 0.6
#: Without given targets, a value's target is its natural share to this power, scaled.
TEMPERATURES = {"source": 0.5, "lang": 0.9, "topic": 0.9}


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("bigint")


def topic_of(text: Column, topics=TOPICS) -> Column:
    """The topic with the most hits, 'general' without any."""
    hits = [F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)) for _, p in topics]
    best = F.greatest(*hits) if len(hits) > 1 else hits[0]
    out = F.lit("general")
    for (name, _), h in reversed(list(zip(topics, hits, strict=True))):
        out = F.when((h == best) & (h > 0), F.lit(name)).otherwise(out)
    return out


def targets_of(cells: DataFrame, dim: str, targets: dict[str, float] | None, temperature: float) -> Column:
    """Target share of each cell's value: given, or the natural share to a power, and scaled
    to sum to 1 over the values that occur. A value takes part if it has tokens."""
    by = W.partitionBy(dim)
    if targets is None:
        weight = F.pow(F.sum("tokens").over(by).cast("double"), F.lit(float(temperature))) if temperature else F.lit(1.0)
    else:
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in targets.items() for x in (kv[0], float(kv[1]))])[F.col(dim)], F.lit(0.0))
    return weight


def attainable(one: DataFrame, dim: str, total: Column) -> Column:
    """Tokens that each cell's value gives if all values give ``total``: its target's part,
    or all it has where that is less, and the others make up for it by their targets.

    Values stand in order of tokens over target; one is whole if those up to it, and the rest
    at its ratio, take no more than the total."""
    whole, upto = W.partitionBy(F.lit(1)), W.partitionBy(F.lit(1)).orderBy("ratio")
    once = lambda c: F.sum(F.when(F.col("first") == 1, c))
    t, have = F.col(f"t_{dim}"), F.col("have")
    full = (t > 0) & (once(have).over(upto) + F.col("ratio") * (once(t).over(whole) - once(t).over(upto)) <= total)
    one = one.withColumn("full", F.coalesce(full, F.lit(False))).withColumn("total", total)
    free = once(F.when(~F.col("full"), t)).over(whole)
    rest = F.col("total") - F.coalesce(once(F.when(F.col("full"), have)).over(whole), F.lit(0.0))
    return one.withColumn(f"g_{dim}", F.when(F.col("full"), have).when(t > 0, F.least(have, t * rest / free)).otherwise(F.lit(0.0))).drop("full", "total")


def with_goals(one: DataFrame, keep: float) -> DataFrame:
    """The tokens to keep of each cell's values, g_source and so on, that sum to the same in
    every dimension: ``keep`` of all, or what the values with a target have if that is less."""
    whole = W.partitionBy(F.lit(1))
    for d in DIMS:
        one = one.withColumn(f"r_{d}", F.sum(F.when(F.col(f"t_{d}") > 0, F.col("tokens").cast("double"))).over(whole))
    one = one.withColumn("goal", F.least(F.lit(float(keep)) * F.sum(F.col("tokens").cast("double")).over(whole), *[F.coalesce(f"r_{d}", F.lit(0.0)) for d in DIMS]))
    for d in DIMS:
        by = W.partitionBy(d)
        first = F.row_number().over(by.orderBy(*[x for x in DIMS if x != d]))
        one = one.withColumns({"first": first, "have": F.sum(F.col("tokens").cast("double")).over(by)})
        one = one.withColumn("ratio", F.when(F.col(f"t_{d}") > 0, F.col("have") / F.col(f"t_{d}")).otherwise(F.lit(float("inf"))))
        one = attainable(one, d, F.col("goal"))
    return one.drop("first", "have", "ratio", "goal", *[f"r_{d}" for d in DIMS])


def rake(cells: DataFrame, scratch: Scratch, targets: dict[str, dict[str, float] | None], temperatures: dict[str, float], rounds: int = ROUNDS, keep: float | None = None) -> DataFrame:
    """Cells (dims, tokens) with the raked weight, the probability and the target share of
    each dimension's value; with ``keep`` the weight is the tokens to keep."""
    one = cells.coalesce(1)
    for d in DIMS:
        one = one.withColumn(f"t_{d}", targets_of(one, d, targets.get(d), temperatures.get(d, 0.0)))
    for d in DIMS:
        first = F.row_number().over(W.partitionBy(d).orderBy(*[x for x in DIMS if x != d]))
        one = one.withColumn("first", first)
        sum_of = F.sum(F.when(F.col("first") == 1, F.col(f"t_{d}"))).over(W.partitionBy(F.lit(1)))
        one = one.withColumn(f"t_{d}", F.when(sum_of > 0, F.col(f"t_{d}") / sum_of).otherwise(F.lit(0.0)))
    one = one.drop("first").withColumn("w", F.col("tokens").cast("double"))
    if keep is not None:
        one = scratch.save(with_goals(one, keep).withColumn("w", F.col("w") * float(keep)), "goals").coalesce(1)
    for k in range(rounds):
        for d in DIMS:
            by = W.partitionBy(d)
            if keep is None:
                have = F.sum("w").over(by)
                one = one.withColumn("w", F.when(have > 0, F.col("w") * F.col(f"t_{d}") / have).otherwise(F.lit(0.0)))
            else:
                # Falling, all cells of a value scale; rising, those that have tokens left.
                one = one.withColumns({"have": F.sum("w").over(by), "capped": F.sum(F.when(F.col("w") >= F.col("tokens"), F.col("w")).otherwise(F.lit(0.0))).over(by)})
                falls, free = F.col(f"g_{d}") <= F.col("have"), F.col("have") - F.col("capped")
                factor = F.when(falls & (F.col("have") > 0), F.col(f"g_{d}") / F.col("have")).when(~falls & (free > 0), (F.col(f"g_{d}") - F.col("capped")) / free).otherwise(F.lit(1.0))
                one = one.withColumn("w", F.least(F.col("tokens").cast("double"), F.col("w") * factor)).drop("have", "capped")
        if (k + 1) % STRIDE == 0 and k + 1 < rounds:
            one = scratch.save(one, f"cells-{k}").coalesce(1)
    g = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens"))
    scale = F.max(g).over(W.partitionBy(F.lit(1))) if keep is None else F.lit(1.0)
    share = F.when(F.col("tokens") > 0, F.when(scale > 0, g / scale).otherwise(F.lit(0.0))).otherwise(F.lit(1.0))
    return one.withColumn("probability", F.round(share, 9)).select(*DIMS, "tokens", F.col("w").alias("weight"), "probability", *[f"t_{d}" for d in DIMS])


def mix_report(raked: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(dim, value, tokens, target, reached, met) of the raked cells: the target share, the
    expected share of what is kept, and whether they differ by less than the tolerance of the
    target."""
    share = F.col("kept") / F.sum("kept").over(W.partitionBy("dim"))
    rows = raked.select("tokens", (F.col("tokens") * F.col("probability")).alias("kept"), F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value"), F.col(f"t_{d}").alias("target")) for d in DIMS])).alias("e")).select("e.*", "tokens", "kept")
    out = rows.groupBy("dim", "value").agg(F.sum("tokens").alias("tokens"), F.first("target").alias("target"), F.sum("kept").alias("kept"))
    return out.withColumn("reached", F.coalesce(share, F.lit(0.0))).withColumn("met", F.abs(F.col("reached") - F.col("target")) <= tolerance * F.col("target")).drop("kept")


def unit(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from a key's MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0


#: Columns that ``mix`` adds.
ADDED = ("mix_source", "mix_lang", "topic", "tokens", "probability", "kept")


def mix_and_cells(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", targets: dict[str, dict[str, float] | None] | None = None, temperatures: dict[str, float] | None = None, seed: str = SEED, keep: float | None = None, names: tuple[str, ...] = ADDED, with_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of ``mix`` and the raked cells, for ``mix_report``."""
    if keep is not None and not 0 < keep <= 1:
        raise ValueError("keep is a share of the tokens, above 0 and at most 1")
    for dim, given in (targets or {}).items():
        if given is not None and not any(v > 0 for v in given.values()):
            raise ValueError(f"no target of {dim} is positive")
    source, lang, topic, tokens, probability, kept = names
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.withColumns({source: F.coalesce(F.col(source_col).cast("string"), F.lit("")), lang: F.coalesce(F.col(lang_col).cast("string"), F.lit("")), topic: topic_of(F.col(text_col)), tokens: word_count(F.col(text_col))})
    rows = scratch.save(rows.drop(probability, kept) if with_text else rows.drop(probability, kept, text_col), "rows")
    cells = rows.groupBy(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(topic).alias("topic")).agg(F.sum(tokens).alias("tokens"))
    cells = scratch.save(cells.coalesce(1), "cells")
    raked = scratch.save(rake(cells, scratch, targets or {}, temperatures or TEMPERATURES, keep=keep), "raked")
    # A row per cell; Spark broadcasts it below its own threshold and joins by shuffle beyond.
    keyed = raked.select(F.col("source").alias(source), F.col("lang").alias(lang), F.col("topic").alias(topic), F.col("probability").alias(probability))
    out = rows.join(keyed, [source, lang, topic]).select(*rows.columns, probability)
    return out.withColumn(kept, unit(F.col(id_col), seed) < F.col(probability)), raked


def mix(docs: DataFrame, *args, **options) -> DataFrame:
    """The input (``with_text=False``: without its text) with mix_source, mix_lang, topic,
    tokens, probability and kept.

    Targets and TEMPERATURES may be given for each dimension, and ``keep``, the share of all
    tokens to keep."""
    return mix_and_cells(docs, *args, **options)[0]


def sample(docs: DataFrame, **options) -> DataFrame:
    """The kept rows of the input, with the input's columns as they are."""
    names = tuple(unused(docs.columns, *ADDED))
    return mix(docs, names=names, **options).where(F.col(names[-1])).select(*docs.columns)


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs.select("doc_id", "text", "source", "lang"), with_text=False)
    return out.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), "topic", "tokens", F.round("probability", 6).alias("probability"), "kept")


def _sql() -> str:
    hits = ", ".join(f"coalesce(len(regexp_extract_all(text, '{p}')), 0) AS h{i}" for i, (_, p) in enumerate(TOPICS))
    best = "greatest(" + ", ".join(f"h{i}" for i in range(len(TOPICS))) + ")"
    topic = " ".join(f"WHEN h{i} = {best} AND h{i} > 0 THEN '{t}'" for i, (t, _) in enumerate(TOPICS))
    ctes, last = [], "c0"
    for k in range(ROUNDS):
        for d in DIMS:
            name = f"r{k}_{d}"
            ctes.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * t_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w) FROM {last})")
            last = name
    share = lambda d, w: f"(SELECT {d} AS k, {w} / sum({w}) OVER () AS t FROM (SELECT {d}, sum(tokens)::DOUBLE AS x FROM cells GROUP BY {d}))"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {hits},
  coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0)::BIGINT AS tokens FROM documents),
e AS MATERIALIZED (SELECT doc_id, source, lang, tokens, CASE {topic} ELSE 'general' END AS topic FROM d),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM e GROUP BY ALL),
c0 AS MATERIALIZED (SELECT c.*, s.t AS t_source, l.t AS t_lang, o.t AS t_topic, c.tokens::DOUBLE AS w FROM cells c
  JOIN {share('source', 'pow(x, 0.5)')} s ON s.k = c.source JOIN {share('lang', 'pow(x, 0.9)')} l ON l.k = c.lang JOIN {share('topic', 'pow(x, 0.9)')} o ON o.k = c.topic),
{', '.join(ctes)},
p AS (SELECT source, lang, topic, round(coalesce(g / max(g) OVER (), 1.0), 9) AS probability FROM (SELECT *, CASE WHEN tokens > 0 THEN w / tokens END AS g FROM {last}))
SELECT doc_id, source, lang, topic, tokens, round(probability, 6) AS probability,
  (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE) < probability AS kept
FROM e JOIN p USING (source, lang, topic)"""


QUERIES = {"op2_mix_sources": op2_mix_sources}
ORACLE_SQL = {"op2_mix_sources": _sql()}
