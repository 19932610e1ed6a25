"""The registered queries of this subpackage and the SQL that says what they must return."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, divergence_audit, filter_audit, html_text, id_store, language_id, ngram_join, packing, substring_dedup, toxicity, vector_dedup, warc
from tessera.plans.scratch import shared_root


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_read(spark, sf_dir, "documents"), n=3, threshold=0.9)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), digest=True)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"), f"{shared_root(spark)}/warc-{uuid.uuid4().hex[:12]}")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op9_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    path = f"{shared_root(spark)}/ids-{uuid.uuid4().hex[:12]}"
    id_store.write_store(_read(spark, sf_dir, "documents"), path, spec, end_id=2)
    return id_store.read_digests(spark, path)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return bpe.digests(_read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit(_read(spark, sf_dir, "documents"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_ngram_join": op2_ngram_join,
    "op3_language_id": op3_language_id,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_vector_dedup": op8_vector_dedup,
    "op9_id_store": op9_id_store,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_divergence_audit": op11_divergence_audit,
    "op12_html_text": op12_html_text,
    "op13_filter_audit": op13_filter_audit,
}

#: Words of a text as SQL: runs of anything but the six ASCII white-space characters.
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

_OP2 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce({_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 90 * (p.n + q.n - common)
), e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.y)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.x = w.doc_id GROUP BY w.doc_id
"""

_OP5 = f"""
WITH w AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
m AS (SELECT g, min(doc_id) AS low FROM p GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM p JOIN m USING (g) WHERE low < doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN t USING (doc_id)
"""

_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), t AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS lc FROM t GROUP BY 1, 2 HAVING count(DISTINCT i) >= 30),
ls AS (SELECT lang, sum(lc)::HUGEINT AS ln, count(*)::HUGEINT AS v FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
gn AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS cn,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (gn.n + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (lc + 5)) // (ln + 5 * v) AS q
  FROM g JOIN gn USING (lang, source) JOIN kept USING (lang) JOIN ls USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE cn > 0 AND p > q
), k AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 50
"""

_OP13 = f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, coalesce({_WORDS.format("text")}, []) AS ws FROM documents),
m AS (SELECT x, min(doc_id) AS low FROM t GROUP BY x),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * (length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(x))::INT
    + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(low < t.doc_id, false)::INT AS fails
  FROM t JOIN m USING (x) LEFT JOIN l ON l.doc_id = t.doc_id
), c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
o AS (
  SELECT '' AS filter_order, 0 AS step, 0 AS own, 0 AS before, 0 AS after
  UNION ALL
  SELECT filter_order || substr('ABCDE', i + 1, 1), step + 1, (1 << i)::INT, after, (after | (1 << i))::INT
  FROM o, (SELECT unnest(range(0, 5))::INT AS i) WHERE step < 5 AND (after & (1 << i)) = 0
), r AS (SELECT a.filter_order, b.step, b.own, b.before, b.after FROM o a JOIN o b ON starts_with(a.filter_order, b.filter_order) WHERE a.step = 5 AND b.step > 0),
d AS (SELECT DISTINCT own, before, after FROM r),
s AS (
  SELECT part, own, before, after,
    sum(n * ((fails & after) = 0)::INT)::BIGINT AS kept,
    sum(n * ((fails & before) = 0 AND (fails & own) <> 0)::INT)::BIGINT AS removed,
    sum(n * ((fails & before) <> 0 AND (fails & own) <> 0)::INT)::BIGINT AS redundant,
    sum(n * (fails = own)::INT)::BIGINT AS unique_fails,
    sum(good * ((fails & before) = 0 AND (fails & own) <> 0)::INT)::BIGINT AS good_lost,
    sum(toxic * ((fails & before) = 0 AND (fails & own) <> 0)::INT)::BIGINT AS toxic_lost
  FROM c, d GROUP BY part, own, before, after
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM s JOIN r USING (own, before, after)
"""

ORACLE_SQL: dict[str, str] = {"op11_divergence_audit": _OP11, "op13_filter_audit": _OP13, "op2_ngram_join": _OP2, "op5_substring_dedup": _OP5}
