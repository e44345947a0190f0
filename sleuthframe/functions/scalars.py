"""Scalar functions as Column expressions: normalisers, keys, times, masks, text patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import GENESIS, HONORIFICS

# Patterns of phones, vehicle plates, names, places and headers.
PHONE = r"(?:\+?91[\s\-]?)?[6-9]\d{4}[\s\-]?\d{5}"
VEHICLE = r"\b[A-Z]{2}[\s\-]?\d{1,2}[\s\-]?[A-Z]{1,3}[\s\-]?\d{3,4}\b"
VEHICLE_STRICT = r"\b[A-Z]{2}-\d{2}-[A-Z]{1,2}-\d{4}\b"
NAME = r"\b(?:[A-Z]\.\s*)?[A-Z][a-z]+\s+[A-Z][a-z]+\b"
DEVANAGARI_NAME = r"[\u0900-\u097F]{2,}(?:\s+[\u0900-\u097F]{2,})+"
DEVANAGARI_PLACE = r"(?:थाना|जिला|गाँव|गांव|शहर|राज्य|मोहल्ला|चौक|बाज़ार|बाजार)\s*[:\-]?\s*([\u0900-\u097F]{2,}(?:\s+[\u0900-\u097F]{2,}){0,2})"
RUPEES = r"(?i)(?:Rs\.?|INR|₹)\s*([\d,]+(?:\.\d+)?)"
STAMP = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?)"
TRIGGER = r"(?i)\b(driving|riding|driver|rider|vehicle(?:\s*no\.?)?|registration(?:\s*no\.?)?|plate(?:\s*no\.?)?|owned\s+by|belonging\s+to)\b"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def digits_of(x) -> Column:
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"[^0-9]", "")


def normalize_phone(x) -> Column:
    """Ten digits without country code or trunk zero, or the empty text."""
    d = digits_of(x)
    d = F.when((F.length(d) == 12) & d.startswith("91"), F.substring(d, 3, 10)).when((F.length(d) == 11) & d.startswith("0"), F.substring(d, 2, 10)).otherwise(d)
    d = F.right(d, F.lit(10))
    return F.when(F.length(d) == 10, d).otherwise(F.lit(""))


def canonical_phone(x) -> Column:
    d = normalize_phone(x)
    return F.when(d != "", F.concat(F.lit("+91-"), d)).otherwise(F.lit(""))


def loose_phone(x) -> Column:
    """The last ten digits with the country code, whatever their number."""
    return F.concat(F.lit("+91-"), F.right(digits_of(x), F.lit(10)))


def normalize_vehicle(x) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(_c(x), F.lit(""))), r"[\s\-_]", "")


def name_tokens(x) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(_c(x), F.lit(""))), ".", " "), r"\s+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*HONORIFICS))


def normalize_name(x) -> Column:
    return F.array_join(name_tokens(x), " ")


def name_variants(x) -> Column:
    """The normalised name, and it without one-letter words, sorted."""
    full = normalize_name(x)
    short = F.array_join(F.filter(name_tokens(x), lambda w: F.length(w) > 1), " ")
    return F.array_sort(F.array_distinct(F.when(short != "", F.array(full, short)).otherwise(F.array(full))))


def split_multi(x) -> Column:
    """Values parted by | ; or , without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), r"[|;,]"), lambda v: F.trim(v)), lambda v: v != "")


def parse_ts(x) -> Column:
    """ISO text as TIMESTAMP_NTZ in UTC: whole, without Z, its first 19, its first 10 characters."""
    s = F.trim(_c(x))
    tries = [s, F.replace(s, F.lit("Z"), F.lit("")), F.substring(s, 1, 19), F.substring(s, 1, 10)]
    return F.coalesce(*[F.when(F.length(t) >= 10, t).try_cast("timestamp_ntz") for t in tries])


def normalize_ts(x) -> Column:
    """The three written forms of a time as ISO text with offset; anything else as it is."""
    s = F.trim(_c(x))
    t = F.coalesce(*[F.when(s.rlike(p), F.try_to_timestamp(s, F.lit(f))) for p, f in ((r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$", "yyyy-MM-dd'T'HH:mm:ss"), (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", "yyyy-MM-dd HH:mm:ss"), (r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd"))])
    return F.coalesce(F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")), s)


def fmt_inr(x) -> Column:
    return F.concat(F.lit("₹"), F.format_number(F.bround(_c(x), 0), 0))


def severity(score) -> Column:
    s = _c(score)
    return F.when(s >= 0.75, "high").when(s >= 0.4, "medium").otherwise("low")


def clamp(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def score_for_z(z) -> Column:
    return clamp(0.4 + 0.08 * _c(z), 0.0, 1.0)


def robust_z(x, median, mad) -> Column:
    """0.6745 (x - median) / MAD; with no spread, the distance in medians."""
    x, m, d = _c(x), _c(median), _c(mad)
    return F.when(d == 0, (x - m) / F.greatest(F.lit(1.0), F.abs(m))).otherwise(0.6745 * (x - m) / F.nullif(d, F.lit(0.0)))


def set_hash(ids) -> Column:
    return F.substring(F.sha2(F.array_join(F.array_sort(_c(ids)), "|"), 256), 1, 16)


def merge_id(survivor, ids, rule) -> Column:
    text = F.concat(_c(survivor), F.lit("|"), F.array_join(F.array_sort(_c(ids)), "|"), F.lit("|"), _c(rule))
    return F.concat(F.lit("MERGE-"), F.upper(F.substring(F.sha2(text, 256), 1, 12)))


def content_hash(text) -> Column:
    return F.substring(F.sha2(F.coalesce(_c(text), F.lit("")), 256), 1, 16)


def run_key(source, record, text) -> Column:
    return F.concat_ws(":", _c(source), _c(record), content_hash(text))


def node_id(case_id, kind, name, phones=None, vehicles=None) -> Column:
    """PHONE-, VEH- or ENT- with a hash of what identifies the entity."""
    phones = F.array().cast("array<string>") if phones is None else _c(phones)
    vehicles = F.array().cast("array<string>") if vehicles is None else _c(vehicles)
    text = F.concat_ws("|", _c(case_id), _c(kind), normalize_name(name), F.array_join(F.array_sort(phones), ","), F.array_join(F.array_sort(vehicles), ","))
    other = F.concat(F.lit("ENT-"), F.upper(F.substring(F.sha2(text, 256), 1, 10)))
    return F.when(_c(kind) == "phone", F.concat(F.lit("PHONE-"), normalize_phone(name))).when(_c(kind) == "vehicle", F.concat(F.lit("VEH-"), normalize_vehicle(name))).otherwise(other)


def chain_hash(ts, actor, action, case_id, previous) -> Column:
    return F.sha2(F.array_join(F.array(*[F.coalesce(_c(x), F.lit("")) for x in (ts, actor, action, case_id)], F.coalesce(_c(previous), F.lit(GENESIS))), "|"), 256)


def mask_phone(x) -> Column:
    p = _c(x)
    return F.when(F.length(p) >= 6, F.concat(F.left(p, F.lit(4)), F.lit("******"), F.right(p, F.lit(2)))).otherwise(F.lit("*" * 10))


def mask_name(x) -> Column:
    n = F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\s+", " "))
    return F.when(F.length(n) < 2, F.lit("***")).otherwise(F.array_join(F.transform(F.split(n, " "), lambda w: F.concat(F.left(w, F.lit(1)), F.lit("***"))), " "))


def paragraphs(x) -> Column:
    parts = F.filter(F.transform(F.split(_c(x), r"\n+|(?<=\.)\s+(?=[A-Z\u0900-\u097F])"), lambda v: F.trim(v)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(_c(x)))


def find_all(x, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(pattern), F.lit(group))
