"""A persisted inverted index whose queries open only blocks of documents that can reach the k-th best score.

Documents are numbered by length and cut into blocks. For each term and block the index keeps the postings, and for each score
the greatest share that the term can give a document there. A query's bound on a block is the weighted sum of those over its
terms. Blocks are opened best first, four times as many each round, all queries together; a query is done when the best bound
that is still closed lies below its k-th score. So the result is that of scoring every document, ties included, and what is
read follows how far the bounds are apart.

The index is committed as a whole (``plans/versions.py``): readers see the last complete one.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.tokens import tokens
from tessera.operators.ranking import counted_terms, postings, with_idf
from tessera.plans.ordered import row_numbers
from tessera.plans.scratch import Scratch, broadcast_if_small
from tessera.plans.versions import Versions

#: Documents of a block.
BLOCK = 128
#: Terms that are sent to the scan as a filter; with more, postings are joined. Terms and documents that a join may broadcast.
FEW_TERMS, MANY_TERMS, FEW_DOCS = 500, 200_000, 100_000
#: Open pairs of a query and a block, a number each, that a join may broadcast.
MANY_PAIRS = 2_500_000
#: Scores have so many decimals, so that equal documents tie in whatever order their shares were added up.
DECIMALS = 10
#: Bounds give way by this much, so that rounding never hides a document.
SLACK = 1e-9
SCORES = ("bm25", "tfidf")


class InvertedIndex:
    """The index last committed under ``path``.

    Tables: ``docs`` (doc_id, number, block, len, norm), ``terms`` (term, df, idf, bm25_idf), ``postings`` (term, block, number, c, bm25,
    tfidf) with what a posting gives to each score before the query's weight. The first posting of each term and block also has ``n``,
    their number, and the greatest of those; ``bounds`` (term, block, n, bm25, tfidf) are these rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self._versions = spark, Versions(spark, path)
        found = self._versions.latest()
        if found is None:
            raise ValueError(f"there is no index under {path}")
        said = found[1]
        self.n, self.k1, self.b = said["n"], said["k1"], said["b"]
        self.docs, self.terms, self.postings = (self._versions.table(said["tables"][t]) for t in ("docs", "terms", "postings"))
        self.bounds = self.postings.where("n IS NOT NULL").select("term", "block", "n", *(F.col(f"most_{s}").alias(s) for s in SCORES))
        #: Blocks that the last ``top_k`` opened, and blocks that hold a term of one of its queries.
        self.opened: tuple[int, int] | None = None

    @classmethod
    def build(cls, docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75, smooth_idf: bool = True, block: int = BLOCK) -> InvertedIndex:
        """Index ``docs``; ids must be given and unique. A null text has no terms."""
        spark = docs.sparkSession
        scratch, versions = Scratch(spark, "index"), Versions(spark, path)
        counted = scratch.table(counted_terms(docs, doc_id, text), "counted")
        sized = counted.select("doc_id", "len")
        if not sized.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
            raise ValueError("document ids must be given and unique")
        n, mean = sized.agg(F.count("*"), F.avg("len")).first()
        numbered = scratch.table(row_numbers(sized, [F.col("len"), F.col("doc_id")], "number"), "numbered")
        numbered = numbered.withColumn("block", F.floor((F.col("number") - 1) / block).cast("int"))
        df = postings(counted).groupBy("term").agg(F.count("*").alias("df"))
        idf = F.ln((F.lit(n) + 1) / (F.col("df") + 1)) + 1 if smooth_idf else F.ln(F.lit(n) / F.col("df")) + 1
        bm25_idf = F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        terms = scratch.table(df.select("term", "df", idf.alias("idf"), bm25_idf.alias("bm25_idf")), "terms")
        weighed = with_idf(postings(counted), terms).withColumn("w", F.col("c") / F.col("len") * F.col("idf"))
        norms = weighed.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        folder = versions.folder()
        tables = {"docs": versions.write(numbered.join(norms, "doc_id", "left").select("doc_id", "number", "block", "len", "norm"), folder, "docs")}
        tables["terms"] = versions.write(terms.repartitionByRange("term").sortWithinPartitions("term"), folder, "terms")
        # a document moves as one row; where there are many, Spark would judge by their compressed file that they can be broadcast
        placed = versions.table(tables["docs"]).select("doc_id", "number", "block", "norm")
        placed = F.broadcast(placed) if n <= FEW_DOCS else placed.hint("merge")
        # what a posting gives follows from its document's length and norm, which take less room on the way than both shares
        moved = postings(counted.join(placed, "doc_id"), "number", "block", "norm").select("term", "block", "number", "c", "len", "norm").repartitionByRange("term", "block")
        shares = moved.select(
            "term", "block", "number", "c",
            (F.col("c") * (k1 + 1) / (F.col("c") + k1 * (1 - b + b * F.col("len") / F.lit(mean)))).alias("bm25"), (F.col("c") / F.col("len") / F.col("norm")).alias("tfidf"),
        )
        # sorted by term, so that a filter on terms skips row groups; the first posting of a block has what bounds the block, so that
        # nothing is shuffled for it
        run = Window.partitionBy("term", "block").orderBy("number")
        every = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first = F.row_number().over(run) == 1
        shares = shares.sortWithinPartitions("term", "block", "number")
        shares = shares.select("*", F.when(first, F.count("*").over(every)).alias("n"), *(F.when(first, F.max(x).over(every)).alias(f"most_{x}") for x in SCORES))
        tables["postings"] = versions.write(shares, folder, "postings")
        latest = versions.latest()
        versions.commit(latest[0] + 1 if latest else 0, {"tables": tables, "n": n, "k1": k1, "b": b})
        return cls(spark, path)

    def _weights(self, queries: DataFrame, score: str) -> DataFrame:
        """``query_id, term, weight``: what a posting's share is multiplied with, for the terms that the index knows."""
        words = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qc"))
        known = self._of_terms(self.terms, words.select("term").distinct()).join(words, "term")
        if score == "bm25":
            return known.select("query_id", "term", (F.col("bm25_idf") * F.col("qc")).alias("weight"))
        length = words.groupBy("query_id").agg(F.sum("qc").alias("ql"))
        own = known.join(length, "query_id").withColumn("qw", F.col("qc") / F.col("ql") * F.col("idf"))
        norm = own.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
        return own.join(norm, "query_id").select("query_id", "term", (F.col("idf") * F.col("qw") / F.col("qn")).alias("weight"))

    def _of_terms(self, table: DataFrame, terms: DataFrame) -> DataFrame:
        few = [r[0] for r in terms.limit(FEW_TERMS + 1).collect()]
        return table.where(F.col("term").isin(few)) if len(few) <= FEW_TERMS else table.join(broadcast_if_small(terms, terms.count(), MANY_TERMS), "term", "left_semi")

    def top_k(self, queries: DataFrame, k: int, *, score: str = "bm25") -> DataFrame:
        """``query_id, doc_id, score, rank`` of the k best documents of each row of ``queries(query_id, text)``, ties to smaller ids.

        As when every document is scored, those without a term of the query have score 0. Query ids must be given and unique.
        """
        if k < 1:
            raise ValueError("k must be positive")
        if score not in SCORES:
            raise ValueError(f"scores are {SCORES}")
        scratch = Scratch(self.spark, "top-k")
        given = scratch.table(queries.select("query_id", "text"), "queries")
        if not given.groupBy("query_id").count().where("count > 1 OR query_id IS NULL").isEmpty():
            raise ValueError("query ids must be given and unique")
        n_queries = given.count()
        given = scratch.table(row_numbers(given, [F.col("query_id")], "asked"), "asked")
        asked = given.select(F.col("asked").alias("query_id"), "text")
        weights = scratch.table(self._weights(asked, score), "weights")
        few = weights.select("term").distinct()
        side = broadcast_if_small(weights, weights.count(), 100_000)
        share = F.sum(F.col(score) * F.col("weight")).alias("bound")
        closed = self._of_terms(self.bounds, few).join(side, "term").groupBy("query_id", "block").agg(share)
        best_first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        closed = scratch.table(closed.withColumn("place", F.row_number().over(best_first)), "closed")
        # postings of the queries' terms move once, block by block, so that each round sums scores where they are
        parts = max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.n // BLOCK)))
        held = self._of_terms(self.postings, few).select("block", "number", "term", score).repartition(parts, "block").persist(StorageLevel.DISK_ONLY)
        opening = F.col("block").cast("long") * (n_queries + 1) + F.col("query_id")
        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        reach, before, n, opened = max(1, -(-2 * k // BLOCK)), 0, 0, 0
        best: DataFrame | None = None

        def pending(beyond: int) -> DataFrame:
            rest = closed.where(F.col("place") > beyond)
            if best is None:
                return rest
            least = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
            return rest.join(least, "query_id", "left").where(F.col("kth").isNull() | (F.col("bound") * (1 + SLACK) + SLACK >= F.col("kth"))).drop("kth")

        while True:
            now = scratch.table(pending(before).where(F.col("place") <= reach).select("query_id", "block", opening.alias("opening")), f"open{n}")
            pairs = now.count()
            opened += pairs
            blocks = now.select("block").distinct()
            here = held.join(broadcast_if_small(blocks, blocks.count(), MANY_TERMS), "block", "left_semi")
            each = here.join(side, "term").withColumn("opening", opening).join(broadcast_if_small(now.select("opening"), pairs, MANY_PAIRS), "opening", "left_semi")
            hits = each.groupBy("query_id", "block", "number").agg(F.round(F.sum(F.col(score) * F.col("weight")), DECIMALS).alias("score"))
            # ids are only needed of the best and what ties with them
            first = hits.withColumn("at", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("at") <= k).drop("at")
            found = first.join(self.docs.select("number", "doc_id"), "number").select("query_id", "doc_id", "score")
            found = found if best is None else found.unionByName(best.drop("rank"))
            best = scratch.table(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), f"best{n}")
            if pending(reach).isEmpty():
                break
            before, reach, n = reach, reach * 4, n + 1
        held.unpersist()
        self.opened = (opened, closed.count())
        names = given.select(F.col("query_id").alias("name"), F.col("asked").alias("query_id"))
        return self._filled(asked, best, k).join(names, "query_id").select(F.col("name").alias("query_id"), "doc_id", "score", "rank")

    def _filled(self, asked: DataFrame, best: DataFrame, k: int) -> DataFrame:
        """With documents of score 0, smallest ids first, where a query has fewer than k others."""
        have = best.groupBy("query_id").agg(F.count("*").alias("have"))
        lacking = asked.select("query_id").join(have, "query_id", "left").where("have IS NULL OR have < " + str(k)).select("query_id")
        if lacking.isEmpty():
            return best
        first = self.docs.orderBy("doc_id").limit(2 * k).select("doc_id")  # at most k of them have a score already
        zero = lacking.crossJoin(F.broadcast(first)).join(best.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
        every: Column = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        return best.select("query_id", "doc_id", "score").unionByName(zero).withColumn("rank", every).where(F.col("rank") <= k)
