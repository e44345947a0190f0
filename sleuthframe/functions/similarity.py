"""Name similarity in Arrow batches: token-set ratio over sorted token sets."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..config import HONORIFICS


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows of ``a``."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _ratio(matching: int, total: int) -> float:
    return 100.0 * 2 * matching / total if total else 100.0


@functools.lru_cache(maxsize=100_000)
def token_set_ratio(a: str, b: str) -> float:
    """0-100: the best of the shared tokens against each side and of the sides."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and not (left and right):
        return 100.0
    gap = 1 if shared else 0
    size = len(shared)
    la, lb = size + gap + len(left), size + gap + len(right)
    best = _ratio(size + gap + common_subsequence(left, right), la + lb)
    if shared:
        best = max(best, _ratio(size, size + la), _ratio(size, size + lb))
    return best


def tokens(name: str | None) -> list[str]:
    return [w for w in (name or "").lower().replace(".", " ").split() if w not in HONORIFICS]


def name_similarity(a: str | None, b: str | None) -> float:
    """The best ratio over the names with and without initials; an initial that fits the
    other's first name, beside the same last name, counts 90."""
    ta, tb = tokens(a), tokens(b)
    if not ta or not tb:
        return 0.0
    forms = [{" ".join(t), " ".join(w for w in t if len(w) > 1)} - {""} for t in (ta, tb)]
    best = max(token_set_ratio(p, q) for p in forms[0] for q in forms[1])
    if ta[-1] == tb[-1]:
        short, long = sorted((ta[0], tb[0]), key=len)
        if len(short) == 1 and long.startswith(short):
            best = max(best, 90.0)
    return best


@pandas_udf(DoubleType())
def similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([name_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def cuts(text: str, most: int) -> dict[str, int]:
    """Every string left of ``text`` by leaving out up to so many characters, with the fewest left out."""
    out, last = {text: 0}, {text}
    for k in range(1, most + 1):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        for t in last:
            out.setdefault(t, k)
    return out


def name_signs(name: str | None, words: set[str], common: set[str], least: float, most_cuts: int = 2, most_words: int = 6) -> list[tuple[str, str, int, int, int]]:
    """(kind, key, cut, most, size) of a name whose block words are ``words``, ``common`` of them
    frequent. Two names that share of those words frequent ones only and reach ``least`` (above
    0.9) agree in a sign: with c the words that a form of each has in common and n a form's length,
    either c is nearly all of one form (its "core" is a "part" of the other), or the rests agree
    after leaving out cut + cut' <= (1 - least) * (n + n') characters ("rest"), which bounds what
    each may lose by 2 * (1 - least) / least * n. Names of too many signs are "wide" instead."""
    from itertools import combinations

    own = tokens(name)
    if set(own) != words:
        return [("wide", "", 0, 0, 0)]
    out = set()
    for form in {frozenset(own), frozenset(w for w in own if len(w) > 1)}:
        shared = sorted(w for w in form if w in common or len(w) == 1)
        size = len(" ".join(form))
        most = int(2 * (1 - least) / least * size + 1e-6)
        if most > most_cuts or len(shared) > most_words:
            return [("wide", "", 0, 0, 0)]
        for k in range(1, len(shared) + 1):
            for c in combinations(shared, k):
                if not common.intersection(c):
                    continue
                key = " ".join(c)
                out.add(("part", key, 0, 0, size))
                if 2 * len(key) >= least * (len(key) + size) - 1e-6:
                    out.add(("core", key, 0, 0, size))
                rest = " ".join(sorted(form.difference(c)))
                if rest:
                    out.update(("rest", f"{key}\n{t}", cut, most, size) for t, cut in cuts(rest, most).items())
    return sorted(out)


def signs(least: float):
    """``name_signs`` of (case_id, id, name, words, common) as a function of Arrow batches."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["case_id", "id", "kind", "key", "cut", "most", "size"]
        kinds = [pa.string()] * 4 + [pa.int32()] * 3
        for batch in batches:
            people = list(zip(*[batch.column(c).to_pylist() for c in ("case_id", "id", "name", "words", "hot")], strict=True))
            for k in range(0, len(people), 500):
                rows = [(case, i, *s) for case, i, name, words, common in people[k : k + 500] for s in name_signs(name, set(words), set(words) & set(common), least)]
                cols = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run
