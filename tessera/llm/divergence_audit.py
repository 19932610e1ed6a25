"""How far the word use of each source departs from that of its language, and from that of each other source.

A term is a maximal run of characters other than the ASCII ones that are no letters, with A-Z lower-cased. Each language
keeps the terms that at least ``LEAST_DOCS`` of its documents hold. With N occurrences of kept terms in a group and V kept
terms, a term that occurs ``count`` times has ``p = 1 + floor(10**9 * (count + 5) / (N + 5 * V))``, in whole numbers.

``over_used`` is an upper-bound search. Within a group p depends on the count alone, so the terms of one (group, count)
are a bucket, and with the least probability that the language gives any of them, ``p - q_low`` bounds each difference in
it. Buckets are opened best first, four times as many terms each round, and a group is done when the best bound that is
still closed lies strictly below its k-th value; equal values are always opened, as ties go by the term.

``pair_distances`` sums abs(p - q) over all kept terms from postings. A term that neither source holds adds what two counts
of zero add; a source's own terms are taken against the other's zero count by bucket, and only terms that both hold meet
as postings, where they correct the two sums. A posting list has one row for each source, whatever the corpus holds.

Null text, lang and source read as ''. A group without any kept term has its rows in ``pair_distances``, where all its
counts are zero, and none in ``over_used``. A language without kept terms has distances 0. Repeated rows each count.
Without documents there are no groups and so no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _text
from tessera.plans.scratch import Scratch

#: Documents of a language that must hold a term.
LEAST_DOCS = 30
#: Added to each count.
PRIOR = 5
#: What one probability is measured in.
SCALE = 1_000_000_000
#: Terms of a group opened in the first round, for each that is wanted.
AHEAD = 1

_BREAK = np.zeros(256, bool)
_BREAK[:128] = True
_BREAK[65:91] = _BREAK[97:123] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_COUNTED = "lang string, source string, term string, count long, docs long"


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The lower-cased spans of a byte array as strings."""
    sizes = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[at]])])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of a slice of texts."""
    for batch in batches:
        lang, source = (batch.column(i).cast(pa.string()).fill_null("") for i in (1, 2))
        codes = [c.dictionary_encode() for c in (lang, source)]
        group = codes[0].indices.to_numpy(zero_copy_only=False).astype(np.int64) * (len(codes[1].dictionary) + 1) + codes[1].indices.to_numpy(zero_copy_only=False)
        for texts in _text.slices(batch.column(0)):
            starts, ends, heads = _text.spans(texts, _BREAK)
            if not len(starts):
                continue
            doc = np.repeat(np.arange(texts.hi - texts.lo), np.diff(heads))
            own = group[texts.lo : texts.hi][doc].astype(np.uint64)
            word = _text.word_hashes(texts.data, starts, ends, lower=True)
            proof = _text.word_hashes(texts.data, starts, ends, lower=True, check=True)
            key = _text.mix(word ^ _text.mix(own))
            order = np.argsort(key, kind="stable")  # so documents ascend within a key
            key, proof, own, doc = key[order], proof[order], own[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (proof[1:] != proof[:-1]) | (own[1:] != own[:-1])
            first = np.flatnonzero(new)
            another = new.copy()
            another[1:] |= doc[1:] != doc[:-1]
            at = order[first]
            row = texts.lo + doc[first]
            yield pa.RecordBatch.from_arrays(
                [
                    lang.take(pa.array(row)), source.take(pa.array(row)), _gather(texts.data, starts[at], ends[at]).cast(pa.string()),
                    pa.array(np.diff(np.append(first, len(key)))), pa.array(np.add.reduceat(another.astype(np.int64), first)),
                ],
                names=["lang", "source", "term", "count", "docs"],
            )


def _probability(count: Column, n: Column, v: Column) -> Column:
    """p of a count; in decimals, as a corpus may hold more than 2**63 / 10**9 occurrences."""
    wide = "decimal(19,0)"
    return (F.lit(1) + F.call_function("div", (count + PRIOR).cast(wide) * F.lit(SCALE).cast("decimal(10,0)"), (n + PRIOR * v).cast(wide))).cast("long")


class Model:
    """Kept terms and group sizes of a corpus, as tables in the shared folder.

    ``groups`` has (lang, source, n, v), ``postings`` (lang, source, term, count, p, q) for each count above zero, with the
    group's p and the language's q, and ``buckets`` (lang, source, count, p, terms, q_low) for each (group, count).
    """

    def __init__(self, docs: DataFrame, *, least_docs: int = LEAST_DOCS):
        scratch = self.scratch = Scratch(docs.sparkSession, "divergence")
        columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
        named = docs.select(*columns)
        found = named.mapInArrow(_counted, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
        found = scratch.table(found, "found")
        kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count")).where(F.col("docs") >= least_docs).drop("docs")
        kept = scratch.table(kept, "kept")
        counts = scratch.table(found.select("lang", "source", "term", "count").join(kept, ["lang", "term"]), "counts")
        sizes = kept.groupBy("lang").agg(F.sum("lang_count").alias("lang_n"), F.count("*").alias("v"))
        own = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
        groups = named.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(sizes, "lang", "left")
        self.groups = scratch.table(groups.fillna(0, ["n", "v", "lang_n"]), "groups")
        p, q = _probability(F.col("count"), F.col("n"), F.col("v")), _probability(F.col("lang_count"), F.col("lang_n"), F.col("v"))
        self.postings = scratch.table(counts.join(self.groups, ["lang", "source"]).select("lang", "source", "term", "count", p.alias("p"), q.alias("q")), "postings")
        buckets = self.postings.groupBy("lang", "source", "count", "p").agg(F.count("*").alias("terms"), F.min("q").alias("q_low"))
        self.buckets = scratch.table(buckets, "buckets")
        scratch.drop("found", "kept", "counts")


def over_used(model: Model, k: int = 50) -> DataFrame:
    """The k terms of each group that it holds and uses most above its language: ``lang``, ``source``, ``item``, ``value``, ``rank``."""
    scratch, group = model.scratch, ["lang", "source"]
    best_first = Window.partitionBy(*group).orderBy(F.desc("bound"), "count")
    closed = model.buckets.withColumn("bound", F.col("p") - F.col("q_low")).where("bound > 0")
    closed = closed.withColumn("earlier", F.coalesce(F.sum("terms").over(best_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    closed = scratch.table(closed.select(*group, "count", "bound", "earlier"), "closed")
    ranked = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    best, reach, opened_before, n = None, k * AHEAD, F.lit(False), 0
    while True:
        now = closed.where((F.col("earlier") < reach) & ~opened_before)
        if best is not None:  # groups whose k-th value no closed bucket can reach are done
            least = best.where(F.col("rank") == k).select(*group, F.col("value").alias("kth"))
            now = now.join(least, group, "left").where("kth IS NULL OR bound >= kth").drop("kth")
        opened = model.postings.join(now.select(*group, "count"), [*group, "count"]).where("p > q").select(*group, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        found = opened if best is None else opened.unionByName(best.drop("rank"))
        found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        best = scratch.table(found, f"best{n}")
        rest = closed.where(F.col("earlier") >= reach).join(best.where(F.col("rank") == k).select(*group, F.col("value").alias("kth")), group, "left").where("kth IS NULL OR bound >= kth")
        if rest.isEmpty():
            return best
        opened_before, reach, n = F.col("earlier") < reach, reach * 4, n + 1


def pair_distances(model: Model) -> DataFrame:
    """The sum of abs(p - q) over the kept terms of a language, for each ordered pair of its sources: ``lang``, ``source``, ``item``, ``value``."""
    groups = model.groups.select("lang", "source", "v", F.when(F.col("v") > 0, _probability(F.lit(0), F.col("n"), F.greatest("v", F.lit(1)))).otherwise(0).alias("zero"))
    left, right = groups, groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_b"))
    pairs = left.join(right, "lang").where("source <> item")
    base = pairs.select("lang", "source", "item", (F.col("v") * F.abs(F.col("zero") - F.col("zero_b"))).alias("value"))
    # a source's own terms against the other's zero count, instead of both zero counts
    against = model.buckets.groupBy("lang", "source", "p").agg(F.sum("terms").alias("terms")).join(pairs, ["lang", "source"])
    moved = (F.col("terms") * (F.abs(F.col("p") - F.col("zero_b")) - F.abs(F.col("zero") - F.col("zero_b")))).alias("value")
    one = against.select("lang", "source", "item", moved).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    # terms that both hold: one row for each pair of sources and term, summed where it is made
    zeros = groups.select("lang", "source", "zero")
    held = model.postings.select("lang", "term", "source", "p").join(zeros, ["lang", "source"])
    met = held.join(held.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p_b"), F.col("zero").alias("zero_b")), ["lang", "term"]).where("source < item")
    a, b, za, zb = (F.col(c) for c in ("p", "p_b", "zero", "zero_b"))
    both = met.groupBy("lang", "source", "item").agg(F.sum(F.abs(a - b) - F.abs(a - zb) - F.abs(za - b) + F.abs(za - zb)).alias("value"))
    turned = both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = base.unionByName(one).unionByName(other).unionByName(both).unionByName(turned)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, k: int = 50) -> DataFrame:
    """Both parts: ``lang``, ``source``, ``part`` (pair or term), ``item``, ``value``, ``rank`` from 1, value descending, then item ascending.

    Only ``text``, ``lang`` and ``source`` of ``docs`` are read.
    """
    model = Model(docs)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_distances(model).withColumn("rank", F.row_number().over(ranked))
    names = ["lang", "source", "part", "item", "value", "rank"]
    terms = over_used(model, k).withColumn("part", F.lit("term"))
    return pairs.withColumn("part", F.lit("pair")).select(*names).unionByName(terms.select(*names))
