"""URL filter: rules first, a character language-model ratio for the rest. Native throughout.

Two smoothed variable-order Markov models over 32 symbols, one of accepted and one of rejected
URLs (those that a rule decides), give every symbol after its two predecessors a weight: the
difference of the log-likelihoods. Orders are interpolated by Witten-Bell smoothing, so each
context counts for as much as it has been seen. A URL's score is the mean weight of its
symbols; the threshold is calibrated on three sixteenths of the decided URLs, which the models
never see, for the best mean of both classes' hit rates.

All URLs of the table count. The model has 32768 weights however many URLs there are, a bound
set by the alphabet, so it is carried as one literal and scoring shuffles nothing. Weights are
whole ten-thousandths of a nat, so scores are sums of integers and do not hang on row order.

Defined cases: a null URL, or one without "://", has an empty host and path, fits no rule and
scores by its characters, the empty text 0; repeated rows count and are judged as often as
they come; with no accepted or no rejected URL to learn from, or none to calibrate on, the
threshold is 0; an empty table gives no rows; other columns are passed by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols 1 to 30; 0 is the start, 31 any other character. Digit runs are one 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-"
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
HELD = ("0", "1", "2")
#: Threshold candidates lie this many ten-thousandths of a nat apart.
STEP = 100


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or null; of equal lengths the
    first by name."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=False):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def codes_of(url: Column) -> Column:
    """A number below 32768 for every character: its symbol and those of its two predecessors."""
    low = F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "[0-9]+", "0")
    chars = F.filter(F.split(low, ""), lambda c: c != "")
    symbols = F.transform(chars, lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(31)))
    s2 = F.concat(F.array(F.lit(0), F.lit(0)), symbols)
    s1 = F.concat(F.array(F.lit(0)), symbols)
    pairs = F.zip_with(s1, symbols, lambda a, b: F.coalesce(a, F.lit(0)) * 32 + b)
    codes = F.zip_with(s2, pairs, lambda a, b: F.coalesce(a, F.lit(0)) * 1024 + b)
    return F.slice(codes, 1, F.greatest(F.size(symbols), F.lit(0)))


def weights(seen: DataFrame) -> DataFrame:
    """(code, weight) of all 32768 codes from (allow, codes) of the URLs to learn from."""
    counts = seen.select("allow", F.explode("codes").alias("code")).groupBy("allow", "code").agg(F.count("*").alias("n3"))
    spark = seen.sparkSession
    grid = spark.range(32768).select(F.col("id").cast("int").alias("code"), F.explode(F.array(F.lit(True), F.lit(False))).alias("allow"))
    from pyspark.sql import Window as W

    g = grid.join(counts, ["allow", "code"], "left").na.fill(0, ["n3"])
    g = g.select("allow", "code", "n3", F.shiftright("code", 5).alias("c2"), F.col("code").bitwiseAND(1023).alias("b"), F.shiftright("code", 5).bitwiseAND(31).alias("c1"), F.col("code").bitwiseAND(31).alias("s"))
    over = lambda *k: W.partitionBy("allow", *k)
    g = g.withColumns({"k2": F.sum("n3").over(over("c2")), "t2": F.sum((F.col("n3") > 0).cast("int")).over(over("c2")), "n2": F.sum("n3").over(over("b")), "n1": F.sum("n3").over(over("s"))})
    g = g.withColumns({"k1": F.sum("n3").over(over("c1")), "t1": F.sum(((F.col("n2") > 0) & (F.shiftright("code", 10) == 0)).cast("int")).over(over("c1")), "k0": F.sum("n3").over(over())})
    p0 = (F.col("n1") + 1.0) / (F.col("k0") + 32.0)
    p1 = F.when(F.col("k1") > 0, (F.col("n2") + F.col("t1") * p0) / (F.col("k1") + F.col("t1"))).otherwise(p0)
    p2 = F.when(F.col("k2") > 0, (F.col("n3") + F.col("t2") * p1) / (F.col("k2") + F.col("t2"))).otherwise(p1)
    logs = g.select("allow", "code", F.log(p2).alias("l"))
    both = logs.groupBy("code").agg(F.max(F.when(F.col("allow"), F.col("l"))).alias("a"), F.max(F.when(~F.col("allow"), F.col("l"))).alias("r"))
    return both.select("code", F.round((F.col("a") - F.col("r")) * 10000).cast("int").alias("weight"))


def _mean(codes: Column, model: str) -> Column:
    """Mean weight, rounded down, in ten-thousandths of a nat."""
    total = F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, c: a + F.get(F.expr(model), c))
    return F.floor(total / F.greatest(F.size(codes), F.lit(1)))


def threshold(scored: DataFrame) -> int:
    """The calibrated threshold from (allow, score); the histogram has a row per step."""
    from pyspark.sql import Window as W

    h = scored.groupBy(F.floor(F.col("score") / STEP).alias("step")).agg(F.sum(F.col("allow").cast("bigint")).alias("a"), F.sum((~F.col("allow")).cast("bigint")).alias("r"))
    up = W.orderBy("step").rowsBetween(0, W.unboundedFollowing)
    below = W.orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("step").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    h = h.select("step", F.sum("a").over(up).alias("a_up"), F.coalesce(F.sum("r").over(below), F.lit(0)).alias("r_below"), F.sum("a").over(every).alias("a_all"), F.sum("r").over(every).alias("r_all"))
    best = h.where("a_all > 0 and r_all > 0").orderBy((F.col("a_up") * F.col("r_all") + F.col("r_below") * F.col("a_all")).desc(), "step").limit(1).collect()
    return best[0].step * STEP if best else 0


def filter_urls(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """The input with host, path, rule, verdict, url_score and url_threshold; columns of these
    names are replaced."""
    url = F.col(url_col).cast("string")
    host, path = host_of(url), path_of(url)
    ruled = pages.select(rule_of(host, path, rules).alias("r"), url.alias("u")).where("r is not null")
    ruled = ruled.select((F.col("r.verdict") == "allow").alias("allow"), codes_of(F.col("u")).alias("codes"), F.substring(F.md5("u"), 1, 1).isin(*HELD).alias("held"))
    text = weights(ruled.where("not held")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", "weight"))), lambda x: x["weight"].cast("string")), ",")).first()[0]
    model = f"cast(split('{text}', ',') as array<int>)"
    limit = threshold(ruled.where("held").select("allow", _mean(F.col("codes"), model).alias("score")))
    score = _mean(codes_of(url), model)
    found = rule_of(host, path, rules)
    return pages.withColumns({
        "host": host, "path": path, "rule": found["rule"], "url_score": score, "url_threshold": F.lit(limit).cast("bigint"),
        "verdict": F.coalesce(found["verdict"], F.when(score >= limit, "allow").otherwise("block")),
    })


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "url_score", "url_threshold")


def _sql() -> str:
    ruled = sorted(RULES, key=lambda r: (len(r[1]), r[1]), reverse=True)

    def fits(rule):
        h, _, p = rule.partition("/")
        return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"

    case = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ruled)
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in ruled)
    return f"""
WITH parts AS MATERIALIZED (
  SELECT page_id, coalesce(url, '') AS u,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
hosts AS MATERIALIZED (
  SELECT page_id, u, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    list_transform(list_filter(string_split(regexp_replace(translate(u, '{UPPER}', '{LOWER}'), '[0-9]+', '0', 'g'), ''), lambda c: c <> ''),
      lambda c: coalesce(nullif(strpos('{ALPHABET}', c), 0), 31)) AS sy FROM parts),
coded AS MATERIALIZED (
  SELECT page_id, host, path, CASE {case} END AS rule, substr(md5(u), 1, 1) IN ('0', '1', '2') AS held,
    list_transform(range(1, len(sy) + 1), lambda i: coalesce(CASE WHEN i > 2 THEN sy[i - 2] END, 0) * 1024 + coalesce(CASE WHEN i > 1 THEN sy[i - 1] END, 0) * 32 + sy[i]) AS codes FROM hosts),
judged AS MATERIALIZED (SELECT *, CASE rule {verdict} END AS v FROM coded),
counts AS (SELECT v = 'allow' AS allow, code, count(*) AS n3 FROM (SELECT v, unnest(codes) AS code FROM judged WHERE rule IS NOT NULL AND NOT held) GROUP BY ALL),
grid AS (SELECT a.allow, r.code, coalesce(n3, 0) AS n3, r.code // 32 AS c2, r.code % 1024 AS b, (r.code // 32) % 32 AS c1, r.code % 32 AS s
  FROM range(32768) r(code) CROSS JOIN (VALUES (true), (false)) a(allow) LEFT JOIN counts USING (allow, code)),
g1 AS (SELECT *, sum(n3) OVER (PARTITION BY allow, c2) AS k2, sum((n3 > 0)::INT) OVER (PARTITION BY allow, c2) AS t2,
  sum(n3) OVER (PARTITION BY allow, b) AS n2, sum(n3) OVER (PARTITION BY allow, s) AS n1 FROM grid),
g2 AS (SELECT *, sum(n3) OVER (PARTITION BY allow, c1) AS k1, sum((n2 > 0 AND code < 1024)::INT) OVER (PARTITION BY allow, c1) AS t1, sum(n3) OVER (PARTITION BY allow) AS k0 FROM g1),
g3 AS (SELECT *, (n1 + 1.0::DOUBLE) / (k0 + 32.0::DOUBLE) AS p0 FROM g2),
g4 AS (SELECT *, CASE WHEN k1 > 0 THEN (n2 + t1 * p0) / (k1 + t1) ELSE p0 END AS p1 FROM g3),
g5 AS (SELECT allow, code, ln(CASE WHEN k2 > 0 THEN (n3 + t2 * p1) / (k2 + t2) ELSE p1 END) AS l FROM g4),
model AS MATERIALIZED (SELECT list(weight ORDER BY code) AS w FROM (
  SELECT code, round((max(l) FILTER (allow) - max(l) FILTER (NOT allow)) * 10000)::BIGINT AS weight FROM g5 GROUP BY code)),
scored AS MATERIALIZED (SELECT j.*, floor(coalesce(list_sum(list_transform(codes, lambda c: w[c + 1])), 0)::DOUBLE / greatest(len(codes), 1))::BIGINT AS score FROM judged j, model),
hist AS (SELECT floor(score / {STEP}.0)::BIGINT AS step, count(*) FILTER (v = 'allow') AS a, count(*) FILTER (v = 'block') AS r FROM scored WHERE rule IS NOT NULL AND held GROUP BY 1),
cum AS (SELECT step, sum(a) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS au,
  coalesce(sum(r) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rb, sum(a) OVER () AS aa, sum(r) OVER () AS ra FROM hist),
cut AS (SELECT coalesce((SELECT step * {STEP} FROM cum WHERE aa > 0 AND ra > 0 ORDER BY au * ra + rb * aa DESC, step LIMIT 1), 0)::BIGINT AS t)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict, score AS url_score, t AS url_threshold FROM scored, cut
"""


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLE_SQL = {"op4_url_filter": _sql()}
