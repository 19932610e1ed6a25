"""A training-data pipeline: filter, deduplicate and pack documents.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; its result is written as Parquet
and read again. All but the last return the columns of ``documents``.

1. toxicity: documents whose probability of any toxic grade reaches one half go.
2. language_id: documents without a letter, and those that the best language's model codes worse than ``MOST_BITS`` bits a
   byte, go; a missing ``lang`` is filled in.
3. ngram_join: of rows linked by Jaccard similarity 0.8 of five-word shingles, one stays: that with the smallest doc_id
   (nulls last), and of several texts under it the one of least md5.
4. substring_dedup: words in passages of 50 words that also start in a document with a smaller doc_id go; ``n_chars`` follows, and a
   document that loses all its words goes.
5. best_fit_packing: what is left is packed into sequences.

Stage 3 decides for each row by its own text, so a null or repeated doc_id does not tie different texts together; of copies that
all have a null doc_id one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, ngram_join, packing, substring_dedup
from tessera.llm import toxicity as toxicity_model
from tessera.llm._names import free
from tessera.plans.scratch import Scratch, broadcast_if_small
from tessera.plans.session import prepare


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = free(docs.columns, "__severity", "__grade", "__toxic")
    return toxicity_model.predict(docs, model, names=names).where(~F.col(names[2])).drop(*names)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = free(docs.columns, "__lang", "__score", "__bits")
    found = language_id.predict(docs, language_id.fit(docs), names=names)
    kept = found.where((F.col(names[0]) != "und") & (F.col(names[2]) <= language_id.MOST_BITS))
    return kept.withColumn("lang", F.coalesce("lang", names[0])).drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline-join")
    groups = scratch.table(ngram_join.similar_rows(docs, n=5, threshold=0.8), "groups")
    own_id, own_key = free(docs.columns, "__id", "__key")
    # a row is known by doc_id and text: equal ones are always in one component
    linked = groups.where("component is not null")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    stays = linked.groupBy("component").agg(F.min(order).alias("stays"))
    gone = linked.join(stays, "component").where(~order.eqNullSafe(F.col("stays"))).select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key)).distinct()
    gone = scratch.table(gone, "gone")
    copied = F.col("doc_id").isNotNull() | F.col("component").isNotNull()
    repeated = groups.where(copied).groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key))
    repeated = scratch.table(repeated, "repeated")
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (ngram_join.text_key("text") == F.col(own_key))
    kept = docs.join(broadcast_if_small(gone, gone.count(), 1_000_000), same, "left_anti")
    n = repeated.count()
    if not n:
        return kept
    again = kept.join(broadcast_if_small(repeated, n, 1_000_000), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(broadcast_if_small(repeated, n, 1_000_000), same, "left_anti").unionByName(again)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    words, removed = names = free(docs.columns, "n_words", "n_removed")
    found = substring_dedup.remove_repeats(docs, names=names)
    changed = F.col(removed) > 0
    kept = found.where(~changed | (F.col(words) > F.col(removed)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("language_id", language),
    ("ngram_join", near_duplicates),
    ("substring_dedup", passages),
    ("best_fit_packing", sequences),
]

#: Language identification and the regression cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    prepare(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
