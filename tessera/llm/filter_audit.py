"""How document filters interact: what each filter removes in every order, by one cube over their failure flags.

``flags`` marks the filters that each text fails. ``audit`` counts documents by the flags with ``CUBE``: the row of the
grouping set of filters S whose flags are all false counts what survives S, so 2**n counts for each part hold every order
of n filters. A step of an order is a pair of subsets, without and with its filter, and its figures are differences of
the survivors of the pair.

Nothing but one row for each document (a digest, an id, a part and flags) leaves the scan. Copies meet by text digest and
id first, then as one row for each text, part and label, so a text that a third of all documents share is summed in the
tasks that read it.

Rows without a text count as empty texts, those without a source as part ''. A null doc_id is not smaller than any, and
has no label. Repeated rows each count; copies under one doc_id do not fail ``repeated`` against each other. Several
labels of a doc_id count once, and as set if any of them is. Without documents there are no parts and so no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The filters of ``flags``, each by its letter.
FILTERS = "ABCDE"


def text_failures(text: Column, *, least_words: int = 200, least_distinct: int = 50, most_capitals: int = 2, symbols: str = r"[#$%&*|]") -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null; shares are whole percentages."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < least_words,
        "B": 100 * F.size(F.array_distinct(words)) < least_distinct * n,
        "C": 100 * capitals.cast("long") > most_capitals * F.length(text),
        "D": text.rlike(symbols),
    }


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts ``n`` of documents by ``part``, ``good``, ``toxic`` and the flags A to E (true: fails).

    Only ``doc_id``, ``text`` and ``source`` of ``docs`` and ``doc_id``, ``quality`` and ``toxic`` of ``labels`` are read.
    """
    text = F.coalesce("text", F.lit(""))
    described = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        *(v.alias(k) for k, v in text_failures(text).items()),
    )
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic")).where("good or toxic")
    kind = ["part", "good", "toxic", "A", "B", "C", "D"]
    marked = described.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    ids = marked.groupBy("digest", "doc_id", *kind).agg(F.count("*").alias("n"))
    # of each text, part and label: all rows, those without an id, and the least id with its rows
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    texts = ids.groupBy("digest", *kind).agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"), least.alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    kept = F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = texts.withColumn("first", first).select(*kind, "all", kept.alias("kept"))
    split = F.array(F.struct(F.lit(False).alias("E"), F.col("kept").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("all") - F.col("kept")).alias("n")))
    return both.select(*kind, F.explode(split).alias("x")).select(*kind, "x.E", "x.n").where("n > 0").groupBy(*kind, "E").agg(F.sum("n").alias("n"))


def survivors(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Documents of each part left by each subset of filters: ``part``, ``passed`` (a bit for each filter), ``n``, ``good``, ``toxic``.

    ``counts`` has the columns of ``flags``. Subsets that leave nothing of a part have no row.
    """
    cube = ", ".join(["part", *filters])
    spark = counts.sparkSession
    summed = counts.groupBy("part", *filters).agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))
    cubed = spark.sql(
        f"SELECT {cube}, grouping_id() AS g, sum(n) AS n, sum(good) AS good, sum(toxic) AS toxic FROM {{counts}} GROUP BY CUBE({cube})",
        counts=summed,
    )
    # grouping_id has a bit for each column that is summed over, the last column lowest; part is the highest
    chosen = [F.col("g").bitwiseAND(1 << (len(filters) - 1 - i)) == 0 for i in range(len(filters))]
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(chosen)), F.lit(0))
    passes = [~c | ~F.col(f) for f, c in zip(filters, chosen, strict=True)]
    of_part = F.col("g").bitwiseAND(1 << len(filters)) == 0
    rows = cubed.where(of_part)
    for p in passes:
        rows = rows.where(p)
    return rows.select("part", bits.cast("int").alias("passed"), "n", "good", "toxic")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every step of every order of the filters, for each part.

    Columns: ``part``, ``filter_order``, ``step`` (from 1), ``kept`` after the step, ``removed`` by it, ``redundant`` (fail its
    filter, removed earlier), ``unique_fails`` (fail its filter only), ``good_lost``, ``toxic_lost``, and ``shapley``, what its
    filter removes summed over all orders.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "filter-audit")
    n = len(FILTERS)
    everything = (1 << n) - 1
    # written, as several sides of the joins below read them: the corpus itself is read once
    counted = scratch.table(survivors(scratch.table(flags(docs, labels), "counts")), "survivors")
    # every part has a document, so subset 0 has a row: from it come the subsets that leave nothing
    empty = counted.where("passed = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(everything))).alias("passed"), *(F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")))
    full = scratch.table(counted.unionByName(empty).groupBy("part", "passed").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic"))), "subsets")
    steps = []
    for order in permutations(range(n)):
        before = 0
        for k, f in enumerate(order):
            steps.append(("".join(FILTERS[i] for i in order), k + 1, 1 << f, before, before | 1 << f))
            before |= 1 << f
    plan = spark.createDataFrame(steps, "filter_order string, step int, own int, before int, after int")
    pairs = plan.select("own", "before", "after").distinct()

    def of(name: str) -> DataFrame:
        return full.select("part", F.col("passed").alias(name), F.struct("n", "good", "toxic").alias(f"at_{name}"))

    found = pairs.join(of("before"), "before").join(of("after"), ["part", "after"]).withColumn("removed", F.col("at_before.n") - F.col("at_after.n"))
    alone = found.where("before = 0").select("part", "own", F.col("removed").alias("fails"))
    last = found.where(F.col("after") == everything).select("part", "own", F.col("removed").alias("unique_fails"))
    figures = found.join(alone, ["part", "own"]).join(last, ["part", "own"]).select(
        "part", "own", "before", "after", "removed", "unique_fails",
        F.col("at_after.n").alias("kept"), (F.col("fails") - F.col("removed")).alias("redundant"),
        (F.col("at_before.good") - F.col("at_after.good")).alias("good_lost"), (F.col("at_before.toxic") - F.col("at_after.toxic")).alias("toxic_lost"),
    )
    rows = figures.join(F.broadcast(plan), ["own", "before", "after"])
    return rows.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "own")).alias("shapley"),
    )
