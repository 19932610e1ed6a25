"""String similarity and text-quality metrics of two columns.

Set metrics and BLEU are expressions over arrays. What would compare all positions of two texts there (edit scripts, multisets of
n-grams) runs as Arrow UDFs, whole batches at a time. Null on either side gives null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.tokens import characters, let, ngrams, tokens
from tessera.functions.vectors import ratio


def _parts(text: Column, tokenize: bool) -> Column:
    return tokens(text) if tokenize else characters(text)


def _known(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def normalized_levenshtein(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return _known(a, b, 1 - ratio(F.levenshtein(a, b), longest))


def _dp(fn, kind: str):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b, strict=True)])

    return run


def _damerau(a: str, b: str) -> int:
    """Least number of insertions, deletions, substitutions and swaps of neighbours, where text may be edited between the swapped ones."""
    big = len(a) + len(b)
    seen: dict[str, int] = {}
    rows = [[big] * (len(b) + 2), [big, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, match = [big, i] + [0] * len(b), 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), match
            if x == y:
                match = j
            row[j + 1] = min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1))
        rows.append(row)
        seen[x] = i
    return rows[-1][-1]


def _jaro(a: str, b: str) -> float:
    """Matches within half the longer length less one; transposed matches count a half each, unrounded."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free, left = [True] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [y for y, f in zip(b, free, strict=True) if not f]
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def _lcs(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of a longest common subsequence, one bit per position of ``a``."""
    place: dict[str, int] = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & place.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def damerau_levenshtein(a: Column, b: Column) -> Column:
    return _dp(_damerau, "long")(a, b)


def jaro(a: Column, b: Column) -> Column:
    return _dp(_jaro, "double")(a, b)


def jaro_winkler(a: Column, b: Column, *, p: float = 0.1) -> Column:
    """Jaro, raised by the common prefix (4 at most) without a threshold."""
    if not 0 <= p <= 0.25:
        raise ValueError("p must lie in [0, 0.25]")
    j = jaro(a, b)
    prefix = F.lit(0)
    for n in (1, 2, 3, 4):
        same = (F.length(a) >= n) & (F.length(b) >= n) & (F.substring(a, 1, n) == F.substring(b, 1, n))
        prefix = prefix + F.when(same, 1).otherwise(0)
    return j + prefix * p * (1 - j)


def jaccard_token(a: Column, b: Column, *, tokenize: bool = True) -> Column:
    """Shared over all distinct tokens (or characters); 1 where both are empty."""
    x, y = F.array_distinct(_parts(a, tokenize)), F.array_distinct(_parts(b, tokenize))
    return _known(a, b, ratio(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)), 1.0))


def _times(grams: Column, g: Column) -> Column:
    return F.size(F.filter(grams, lambda x: x == g))


def _clipped(units: Callable[[list[str]], list], tokenize: bool) -> Callable[[Column, Column], Column]:
    """Of (reference, hypothesis): clipped matches of their units, and how many units each has, in time linear in both."""

    def count(reference: str, hypothesis: str) -> list[int]:
        r, h = (units(x.lower().split() if tokenize else list(x)) for x in (reference, hypothesis))
        return [sum((Counter(r) & Counter(h)).values()), len(r), len(h)]

    return _dp(count, "array<long>")


def _runs(n: int) -> Callable[[list[str]], list]:
    if n < 1:
        raise ValueError("n must be at least 1")
    return lambda parts: list(zip(*(parts[i:] for i in range(n)), strict=False))


def _skips(most: int | None) -> Callable[[list[str]], list]:
    """Ordered pairs with at most ``most`` parts between them (any number if None)."""
    return lambda parts: [(x, y) for i, x in enumerate(parts) for y in parts[i + 1 : None if most is None else i + most + 2]]


def ngram_overlap(reference: Column, hypothesis: Column, *, n: int = 2, tokenize: bool = True) -> Column:
    """Clipped n-gram precision of ``hypothesis``; 0 where it has no n-grams."""
    c = _clipped(_runs(n), tokenize)(reference, hypothesis)
    return _known(reference, hypothesis, ratio(c[0], c[2]))


def _f(p: Column, r: Column, beta: float) -> Column:
    b2 = beta * beta
    return ratio((1 + b2) * p * r, b2 * p + r)


def rouge_n(reference: Column, hypothesis: Column, *, n: int = 2, tokenize: bool = True) -> Column:
    """Struct ``precision, recall, f1`` of clipped n-gram matches."""
    c = _clipped(_runs(n), tokenize)(reference, hypothesis)
    p, q = ratio(c[0], c[2]), ratio(c[0], c[1])
    return _known(reference, hypothesis, F.struct(p.alias("precision"), q.alias("recall"), _f(p, q, 1.0).alias("f1")))


def rouge_l(reference: Column, hypothesis: Column, *, tokenize: bool = True, beta: float = 1.2) -> Column:
    """Struct ``precision, recall, f1`` (an F-measure with ``beta``) of the longest common subsequence."""
    r, h = _parts(reference, tokenize), _parts(hypothesis, tokenize)
    m = _dp(lambda x, y: _lcs(list(x), list(y)), "long")(r, h)
    p, q = ratio(m, F.size(h)), ratio(m, F.size(r))
    return _known(reference, hypothesis, F.struct(p.alias("precision"), q.alias("recall"), _f(p, q, beta).alias("f1")))


def rouge_s(reference: Column, hypothesis: Column, *, tokenize: bool = True, beta: float = 1.2, skip_distance: int | None = None) -> Column:
    """Struct ``precision, recall, f1`` of clipped skip-bigram matches."""
    c = _clipped(_skips(skip_distance), tokenize)(reference, hypothesis)
    p, q = ratio(c[0], c[2]), ratio(c[0], c[1])
    return _known(reference, hypothesis, F.struct(p.alias("precision"), q.alias("recall"), _f(p, q, beta).alias("f1")))


def bleu(references: Column, hypothesis: Column, *, max_n: int = 4, weights: Sequence[float] | None = None) -> Column:
    """Struct ``score, bp, precisions`` of a hypothesis against an array of references.

    Matches are clipped by the reference that has most of each n-gram; the closest length (the shorter in a tie) sets the
    brevity penalty. If any precision is 0, score and penalty are both 0.
    """
    if max_n < 1 or (weights is not None and len(weights) != max_n):
        raise ValueError("max_n must be positive and match the weights")
    w = list(weights) if weights is not None else [1 / max_n] * max_n

    def of(n: int) -> Column:
        return F.transform(references, lambda r: ngrams(tokens(r), n))

    grams = {f"h{n}": ngrams(tokens(hypothesis), n) for n in range(1, max_n + 1)} | {f"r{n}": of(n) for n in range(1, max_n + 1)}

    def clipped(h: Column, r: Column) -> Column:
        most = lambda g: F.coalesce(F.array_max(F.transform(r, lambda x: _times(x, g))), F.lit(0))
        return F.aggregate(F.array_distinct(h), F.lit(0), lambda k, g: k + F.least(_times(h, g), most(g)))

    def matched(s: Column) -> Column:
        """Clipped matches and n-grams of each order, and the two lengths."""
        hits = [clipped(s[f"h{n}"], s[f"r{n}"]) for n in range(1, max_n + 1)]
        size = F.size(s["h1"])
        closest = F.array_min(F.transform(s["r1"], lambda r: F.struct(F.abs(F.size(r) - size).alias("d"), F.size(r).alias("n"))))["n"]
        return F.struct(F.array(*(ratio(x, F.size(s[f"h{n}"])) for n, x in enumerate(hits, 1))).alias("p"), size.alias("size"), closest.alias("closest"))

    def score(s: Column) -> Column:
        p = s["m"]["p"]
        bp = F.when(s["m"]["size"] > s["m"]["closest"], 1.0).otherwise(F.exp(1 - ratio(s["m"]["closest"], s["m"]["size"])))
        mean = F.aggregate(F.zip_with(p, F.array(*(F.lit(float(x)) for x in w)), lambda q, x: x * F.ln(q)), F.lit(0.0), lambda t, x: t + x)
        sound = F.forall(p, lambda q: q > 0)
        return F.struct(F.when(sound, bp * F.exp(mean)).otherwise(0.0).alias("score"), F.when(sound, bp).otherwise(0.0).alias("bp"), p.alias("precisions"))

    return _known(references, hypothesis, let(score, m=let(matched, **grams)))
