"""Tokens and n-grams of text as array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(fn: Callable[[Column], Column], **values: Column) -> Column:
    """``fn`` of a struct of values, each of which is computed once, however often ``fn`` and its lambdas use it."""
    bound = F.struct(*(v.alias(k) for k, v in values.items()))
    return F.element_at(F.transform(F.array(bound), fn), 1)


def tokens(text: Column) -> Column:
    """Lower-cased words between runs of Unicode white space."""
    return F.filter(F.split(F.lower(text), "(?U)\\s+"), lambda x: x != "")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def ngrams(parts: Column, n: int) -> Column:
    """All runs of ``n`` parts, joined by a space; none where there are fewer."""
    if n < 1:
        raise ValueError("n must be at least 1")


    def runs(s: Column) -> Column:
        p = s["p"]
        grams = F.transform(F.sequence(F.lit(1), F.size(p) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(p, i, F.lit(n))))
        return F.when(F.size(p) >= n, grams).otherwise(F.array().cast("array<string>"))

    return let(runs, p=parts)
