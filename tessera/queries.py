"""Registered queries over the standard tables, each with the SQL that says what it must return where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.functions.special import normal_cdf
from tessera.operators import anomaly, clustering, evaluation, graph, pairs, ranking, sampling, stats, testing, text_metrics
from tessera.operators.inverted_index import InvertedIndex
from tessera.plans.scratch import Scratch
from tessera.plans.selection import quantiles
from tessera.sources import stores
from tessera.study import durable, governance
from tessera.study.contracts import StudyMode
from tessera.study.provenance import ProvenanceTrail

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(table: str, sql: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Register a query of one table under its function's name."""

    def register(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(_read(spark, sf_dir, table))
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and without negative zeros), as the SQL side does."""
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def _r_many(df: DataFrame) -> DataFrame:
    """The same to six digits for very many rows: by multiples of the last digit, halves away from zero, as the SQL side rounds, and no decimal for each row."""

    def rounded(x):
        y = x * 1e6
        whole = F.rint(y)
        rest = y - whole
        away = F.when((rest == 0.5) & (y > 0), 1.0).when((rest == -0.5) & (y < 0), -1.0).otherwise(0.0)
        return F.when(F.abs(y) < 2.0**52, (whole + away) / F.lit(1e6)).otherwise(x) + 0.0

    return df.select(*(rounded(F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


# --- descriptive statistics -------------------------------------------------------------------------------------------------

_DESCRIBE = """
WITH m AS (
  SELECT event_type, count(*) AS n, avg(value) AS mean, var_samp(value) AS v, min(value) AS lo, max(value) AS hi,
    quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events GROUP BY event_type
), d AS (
  SELECT event_type, avg(power(value - mean, 3)) / power(any_value(v), 1.5) AS s3, avg(power(value - mean, 4)) / power(any_value(v), 2) AS s4, quantile_cont(abs(value - b), 0.5) AS mad
  FROM events JOIN m USING (event_type) GROUP BY event_type
)
SELECT event_type, n, round(mean, 6) AS mean, round(v, 6) AS variance, round(sqrt(v), 6) AS std, lo AS minimum, round(a, 6) AS q25, round(b, 6) AS median, round(c, 6) AS q75, hi AS maximum,
  round(c - a, 6) AS iqr, round(s3 * sqrt(n * (n - 1.0)) / (n - 2), 6) AS skewness, round((n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * (s4 - 3) + 6), 6) AS kurtosis, round(mad, 6) AS mad
FROM m JOIN d USING (event_type)
"""


@_query("events", _DESCRIBE)
def stats_describe(df: DataFrame) -> DataFrame:
    return _r(stats.describe(df, "value", ["event_type"]))


@_query("events", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY event_type")
def baseline_descriptive_stats(df: DataFrame) -> DataFrame:
    return _r(stats.descriptive_stats(df, "value", ["event_type"]))


@_query("lineitem", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS quantile FROM lineitem GROUP BY l_returnflag")
def stats_quantile(df: DataFrame) -> DataFrame:
    return _r(stats.quantile(df, "l_extendedprice", 0.9, ["l_returnflag"]), 4)


@_query("lineitem", "SELECT status, round(quantile_cont(l_extendedprice, 0.01), 4) AS q01, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.999), 4) AS q999 FROM (SELECT *, nullif(l_linestatus, 'F') AS status FROM lineitem) GROUP BY status")
def stats_quantiles_by_selection(df: DataFrame) -> DataFrame:
    """Every group by selection, whatever its size; one key is null."""
    rows = df.select(F.nullif("l_linestatus", F.lit("F")).alias("status"), F.col("l_extendedprice").alias("x"))
    found = quantiles(rows, [0.01, 0.5, 0.999], ["status"], small=0)
    return _r(found.select("status", *(F.col("q")[i].alias(n) for i, n in enumerate(("q01", "q50", "q999")))), 4)


@_query("orders", "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderstatus)) / stddev_samp(o_totalprice) OVER (PARTITION BY o_orderstatus), 6) + 0.0 AS z FROM orders")
def stats_z_scores(df: DataFrame) -> DataFrame:
    return _r(stats.z_scores(df, "o_totalprice", ["o_orderstatus"]).select("o_orderkey", "z"))


_ROBUST = """
WITH m AS (SELECT {key}, quantile_cont({x}, 0.5) AS med FROM {t} GROUP BY {key}),
d AS (SELECT {key}, any_value(med) AS med, quantile_cont(abs({x} - med), 0.5) AS mad FROM {t} JOIN m USING ({key}) GROUP BY {key})
"""


@_query("orders", _ROBUST.format(key="o_orderstatus", x="o_totalprice", t="orders") + "SELECT o_orderkey, round(0.6745 * (o_totalprice - med) / mad, 6) + 0.0 AS z FROM orders JOIN d USING (o_orderstatus)")
def stats_robust_z_scores(df: DataFrame) -> DataFrame:
    return _r(stats.robust_z_scores(df, "o_totalprice", ["o_orderstatus"]).select("o_orderkey", "z"))


@_query("lineitem", "SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS geometric_mean FROM lineitem GROUP BY l_returnflag")
def stats_geometric_mean(df: DataFrame) -> DataFrame:
    return _r(stats.geometric_mean(df, "l_quantity", ["l_returnflag"]))


@_query("lineitem", "SELECT l_returnflag, round(count(*) / sum(1 / l_quantity), 6) AS harmonic_mean FROM lineitem GROUP BY l_returnflag")
def stats_harmonic_mean(df: DataFrame) -> DataFrame:
    return _r(stats.harmonic_mean(df, "l_quantity", ["l_returnflag"]))


@_query("customer", "WITH q AS (SELECT quantile_cont(c_acctbal, 0.05) AS a, quantile_cont(c_acctbal, 0.95) AS b FROM customer) SELECT c_custkey, round(greatest(a, least(b, c_acctbal)), 4) AS winsorised FROM customer, q")
def stats_winsorise(df: DataFrame) -> DataFrame:
    return _r(stats.winsorise(df, "c_acctbal").select("c_custkey", "winsorised"), 4)


@_query("events", "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events) SELECT round(avg(value), 6) AS trim_mean FROM r WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1)")
def stats_trim_mean(df: DataFrame) -> DataFrame:
    return _r(stats.trim_mean(df, "value"))


@_query("documents", "WITH c AS (SELECT source, lang, count(*)::DOUBLE AS c FROM documents GROUP BY 1, 2), p AS (SELECT source, c / sum(c) OVER (PARTITION BY source) AS p FROM c) SELECT source, round(-sum(p * ln(p)), 6) + 0.0 AS entropy FROM p GROUP BY source")
def stats_entropy(df: DataFrame) -> DataFrame:
    return _r(stats.entropy(df, "lang", ["source"]))


# --- vectors ----------------------------------------------------------------------------------------------------------------

_PAIR = "WITH p AS (SELECT a.vec_id AS i, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), z AS (SELECT i, x, y, list_zip(x, y) AS w FROM p)"
_S = "list_sum(list_transform(w, lambda t: {}))"
_MEASURES = f"""
{_PAIR}
SELECT i, round({_S.format("t[1] * t[2]")} / sqrt({_S.format("t[1] * t[1]")} * {_S.format("t[2] * t[2]")}), 6) + 0.0 AS cosine,
  round((SELECT corr(u[1], u[2]) FROM (SELECT unnest(w) AS u)), 6) + 0.0 AS pearson,
  1.0::DOUBLE AS jaccard, 1.0::DOUBLE AS overlap_coefficient,
  round(sqrt({_S.format("power(t[1] - t[2], 2)")}), 6) AS euclidean, round({_S.format("abs(t[1] - t[2])")}, 6) AS manhattan,
  round(list_max(list_transform(w, lambda t: abs(t[1] - t[2]))), 6) AS chebyshev, round(power({_S.format("power(abs(t[1] - t[2]), 3)")}, 1 / 3.0), 6) AS minkowski,
  1.0::DOUBLE AS hamming, round({_S.format("abs(t[1] - t[2]) / (abs(t[1]) + abs(t[2]))")}, 6) AS canberra
FROM z
"""


@_query("embeddings", _MEASURES)
def vector_measures(df: DataFrame) -> DataFrame:
    a = df.select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("x"))
    b = df.select((F.col("vec_id") - 1).alias("i"), F.col("embedding").cast("array<double>").alias("y"))
    x, y = F.col("x"), F.col("y")
    named = {**V.SIMILARITIES, **V.DISTANCES, "minkowski": lambda p, q: V.minkowski(p, q, 3.0)}
    return _r(a.join(b, "i").select("i", *(fn(x, y).alias(k) for k, fn in named.items())))


_COS = "list_sum(list_transform(list_zip(a.x, b.x), lambda t: t[1] * t[2]))"
_VECS = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)"


@_query("embeddings", f"{_VECS} SELECT a.vec_id AS i, b.vec_id AS j, round(greatest(-1, least(1, {_COS} / sqrt(list_sum(list_transform(a.x, lambda t: t * t)) * list_sum(list_transform(b.x, lambda t: t * t))))), 6) + 0.0 AS value FROM e a, e b")
def similarity_matrix(df: DataFrame) -> DataFrame:
    return _r_many(pairs.similarity_matrix(df, id_col="vec_id", vector="embedding"))


QUERIES["cosine_matrix_blocks"] = lambda spark, sf_dir: _r_many(pairs.cosine_matrix_blocks(_read(spark, sf_dir, "embeddings"), id_col="vec_id", vector="embedding"))
ORACLE_SQL["cosine_matrix_blocks"] = ORACLE_SQL["similarity_matrix"]


@_query("embeddings", f"{_VECS} SELECT a.vec_id AS i, b.vec_id AS j, round(sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda t: power(t[1] - t[2], 2)))), 6) + 0.0 AS value FROM e a, e b")
def distance_matrix(df: DataFrame) -> DataFrame:
    return _r_many(pairs.distance_matrix(df, id_col="vec_id", vector="embedding"))


_DIST = "sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda t: power(t[1] - t[2], 2))))"


@_query("embeddings", f"{_VECS}, d AS (SELECT a.vec_id AS i, b.vec_id AS j, {_DIST} AS d FROM e a, e b WHERE a.vec_id <> b.vec_id) SELECT i, j, round(d, 6) AS d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM d QUALIFY r <= 5")
def nearest_neighbours(df: DataFrame) -> DataFrame:
    return _r(pairs.nearest(df, 5, id_col="vec_id", vector="embedding").withColumn("r", F.col("r").cast("long")))


@_query("embeddings", ORACLE_SQL["nearest_neighbours"])
def nearest_by_pivots(df: DataFrame) -> DataFrame:
    """The same by the triangle inequality, whatever the number of rows."""
    return _r(pairs.nearest(df, 5, id_col="vec_id", vector="embedding", all_pairs=0).withColumn("r", F.col("r").cast("long")))


@_query("events", "WITH p AS (SELECT event_id, user_id % 97 AS x, value AS y FROM events WHERE event_type = 'error') SELECT a.event_id AS i, b.event_id AS j FROM p a JOIN p b ON b.y BETWEEN a.y - 0.51 AND a.y + 0.51 AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 0.25")
def join_within_distance(df: DataFrame) -> DataFrame:
    """Errors at a distance of at most one half in the plane of user class and value."""
    points = df.where("event_type = 'error'").select("event_id", F.array((F.col("user_id") % 97).cast("double"), "value").alias("v"))
    return pairs.within(points, 0.5, id_col="event_id")


# --- tests ------------------------------------------------------------------------------------------------------------------

_TWO = "WITH s AS (SELECT count(*) FILTER (event_type = 'click') AS n1, count(*) FILTER (event_type = 'error') AS n2, avg(value) FILTER (event_type = 'click') AS m1, avg(value) FILTER (event_type = 'error') AS m2, var_samp(value) FILTER (event_type = 'click') AS v1, var_samp(value) FILTER (event_type = 'error') AS v2 FROM events)"
#: 1 - I_y(1/2, f/2) with y = t^2 / (f + t^2), by the series of the incomplete beta function.
_T_P = "1 - list_sum(list_transform(range(0, 500), lambda k: exp(0.5 * ln(y) + f / 2 * ln(1 - y) + lgamma(0.5 + f / 2 + k) - lgamma(f / 2) - lgamma(1.5 + k) + k * ln(y))))"
#: P(a, x) by its series.
_GAMMA_P = "list_sum(list_transform(range(0, 400), lambda ii: exp(-({x}) + ({a} + ii) * ln({x}) - lgamma({a} + ii + 1))))"


@_query("events", f"""
{_TWO}, t AS (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) AS f FROM s),
u AS (SELECT *, t * t / (f + t * t) AS y FROM t)
SELECT round(t, 6) AS statistic, round({_T_P}, 6) AS p_value, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS effect_size, n1, n2 FROM u
""")
def test_welch(df: DataFrame) -> DataFrame:
    return _r(testing.welch_t_test(df, "value", "event_type", "click", "error"))


@_query("events", f"""
WITH s AS (SELECT event_type, count(*) AS n1, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY event_type),
t AS (SELECT *, (m - 50) / (s / sqrt(n1)) AS t, (n1 - 1)::DOUBLE AS f FROM s), u AS (SELECT *, t * t / (f + t * t) AS y FROM t)
SELECT event_type, round(t, 6) AS statistic, round({_T_P}, 6) AS p_value, round(abs(m - 50) / s, 6) AS effect_size, n1 FROM u
""")
def test_one_sample(df: DataFrame) -> DataFrame:
    return _r(testing.one_sample_t_test(df, "value", 50.0, ["event_type"]))


@_query("events", f"""
WITH e AS (SELECT value, event_type = 'click' AS f FROM events WHERE event_type IN ('click', 'error')),
r AS (SELECT f, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM e),
s AS (SELECT sum(r) FILTER (f) AS r1, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2 FROM r),
u AS (SELECT n1, n2, least(r1 - n1 * (n1 + 1) / 2.0, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0)) AS u FROM s),
z AS (SELECT *, (u - n1 * n2 / 2.0 + 0.5) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0) AS z FROM u)
SELECT u::DOUBLE AS statistic, round(1 - ({_GAMMA_P.format(a=0.5, x="z * z / 2")}), 6) AS p_value, round(1 - 2 * u / (n1 * n2), 6) AS effect_size, n1, n2 FROM z
""")
def test_mann_whitney(df: DataFrame) -> DataFrame:
    return _r(testing.mann_whitney(df, "value", "event_type", "click", "error"))


@_query("events", """
WITH e AS (SELECT value, event_type = 'click' AS f FROM events WHERE event_type IN ('click', 'error')), n AS (SELECT count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2 FROM e),
c AS (SELECT value, count(*) FILTER (f) AS a, count(*) FILTER (NOT f) AS b FROM e GROUP BY value),
d AS (SELECT max(abs(x / n1 - y / n2)) AS d, any_value(n1) AS n1, any_value(n2) AS n2 FROM (SELECT sum(a) OVER (ORDER BY value) AS x, sum(b) OVER (ORDER BY value) AS y FROM c), n),
l AS (SELECT *, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d AS l FROM d)
SELECT round(d, 6) AS statistic, round(greatest(0, least(1, 2 * list_sum(list_transform(range(1, 100), lambda k: power(-1, k - 1) * exp(-2.0 * k * k * l * l))))), 6) AS p_value, round(d, 6) AS effect_size, n1, n2 FROM l
""")
def test_ks(df: DataFrame) -> DataFrame:
    return _r(testing.ks_test(df, "value", "event_type", "click", "error"))


@_query("lineitem", f"""
WITH c AS (SELECT l_returnflag, count(*)::DOUBLE AS o FROM lineitem GROUP BY 1), e AS (SELECT sum(o) / count(*) AS e, sum(o) AS n, count(*) AS k FROM c),
s AS (SELECT sum(power(o - e, 2) / e) AS s, any_value(n) AS n, any_value(k) AS k FROM c, e)
SELECT round(s, 6) AS statistic, round(1 - {_GAMMA_P.format(a="((k - 1) / 2.0)", x="(s / 2)")}, 6) AS p_value, round(sqrt(s / (n * (k - 1))), 6) AS effect_size, n::BIGINT AS n1, k AS n2 FROM s
""")
def test_chi_squared(df: DataFrame) -> DataFrame:
    return _r(testing.chi_squared_test(df.groupBy("l_returnflag").count(), "count"))


_KEY = "md5(concat_ws('|', {seed}, '{stream}', {ids}))"


def _u(stream: str, ids: str, seed: int = 0) -> str:
    return f"(('0x' || substr({_KEY.format(seed=seed, stream=stream, ids=ids)}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


QUERIES["test_permutation"] = lambda spark, sf_dir: _r(
    testing.permutation_test(_read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents"), "doc_id"), "n_chars", "toxic", 1, 0, id_col="doc_id", n_permutations=200, method="draws"), 4
)
ORACLE_SQL["test_permutation"] = f"""
WITH e AS (SELECT l.doc_id::VARCHAR AS id, d.n_chars::DOUBLE AS x, l.toxic = 1 AS f FROM labels l JOIN documents d USING (doc_id)), n AS (SELECT count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, avg(x) FILTER (f) - avg(x) FILTER (NOT f) AS s FROM e),
r AS (SELECT run, x, row_number() OVER (PARTITION BY run ORDER BY {_KEY.format(seed=0, stream="permutation", ids="run, id")}, id) <= n1 AS f FROM e, range(200) t(run), n),
p AS (SELECT avg(x) FILTER (f) - avg(x) FILTER (NOT f) AS d FROM r GROUP BY run)
SELECT round(s, 4) AS statistic, round((count(*) FILTER (abs(d) >= abs(s) - 1e-12) + 1) / 201.0, 4)::DOUBLE AS p_value, n1, n2 FROM p, n GROUP BY ALL
"""

_PS = "WITH p AS (SELECT user_id AS id, least(1, power(10, -abs(avg(value) - 50) / 5)) AS p FROM events GROUP BY user_id), m AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, id) AS rn FROM p)"


def _p_values(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("m")).select("id", F.least(F.lit(1.0), F.pow(F.lit(10.0), -F.abs(F.col("m") - 50) / 5)).alias("p"))


@_query("events", f"{_PS} SELECT id, round(least(1, p * m), 8) AS adjusted_p, least(1, p * m) <= 0.05 AS rejected FROM m")
def correct_bonferroni(df: DataFrame) -> DataFrame:
    return _r(testing.bonferroni(_p_values(df), "p").drop("p"), 8)


@_query("events", f"{_PS}, h AS (SELECT id, max(least(1, p * (m - rn + 1))) OVER (ORDER BY rn) AS a FROM m) SELECT id, round(a, 8) AS adjusted_p, a <= 0.05 AS rejected FROM h")
def correct_holm(df: DataFrame) -> DataFrame:
    return _r(testing.holm(_p_values(df), "p", id_col="id").drop("p"), 8)


@_query("events", f"{_PS}, h AS (SELECT id, least(1, min(p * m / rn) OVER (ORDER BY rn DESC)) AS a FROM m) SELECT id, round(a, 8) AS adjusted_p, a <= 0.05 AS rejected FROM h")
def correct_benjamini_hochberg(df: DataFrame) -> DataFrame:
    return _r(testing.benjamini_hochberg(_p_values(df), "p", id_col="id").drop("p"), 8)


# --- evaluation -------------------------------------------------------------------------------------------------------------

_EVAL = "WITH e AS (SELECT doc_id AS id, quality AS y, d.n_chars AS n, (d.n_chars % 997) / 997.0 AS s, (d.n_chars > 1500)::INT AS yhat FROM labels JOIN documents d USING (doc_id))"


def _evaluated(query: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """Register a query of labels against scores made from their documents."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents"), "doc_id")
        return _r(query(rows.select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), (F.col("n_chars") % 997 / 997.0).alias("s"), (F.col("n_chars") > 1500).cast("int").alias("yhat"), F.col("n_chars").alias("n"))))

    QUERIES[query.__name__] = run
    ORACLE_SQL[query.__name__] = _EVAL + sql


def eval_confusion_matrix(e: DataFrame) -> DataFrame:
    return evaluation.confusion_matrix(e, "y", "yhat")


_CM = ", c AS (SELECT count(*) FILTER (y = 1 AND yhat = 1) AS tp, count(*) FILTER (y <> 1 AND yhat = 1) AS fp, count(*) FILTER (y = 1 AND yhat <> 1) AS fn, count(*) FILTER (y <> 1 AND yhat <> 1) AS tn FROM e)"
_evaluated(eval_confusion_matrix, f"{_CM} SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, tp + fn AS support FROM c")


def eval_f_beta(e: DataFrame) -> DataFrame:
    return evaluation.f_beta(e, "y", "yhat", beta=2.0)


_evaluated(eval_f_beta, f"{_CM} SELECT round(5 * tp / (5 * tp + 4 * fn + fp), 6) AS f_beta FROM c")


def eval_classification_report(e: DataFrame) -> DataFrame:
    return evaluation.classification_report(e.withColumn("a", F.col("n") % 4).withColumn("b", F.floor(F.col("s") * 4).cast("long")), "a", "b")


_evaluated(eval_classification_report, """
, k AS (SELECT n % 4 AS a, floor(s * 4)::BIGINT AS b FROM e), c AS (SELECT DISTINCT unnest([a, b]) AS c FROM k),
q AS (SELECT c, count(*) FILTER (a = c AND b = c) AS tp, count(*) FILTER (a <> c AND b = c) AS fp, count(*) FILTER (a = c AND b <> c) AS fn FROM c, k GROUP BY c),
m AS (SELECT avg(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END) AS p, avg(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END) AS r, sum(tp) / sum(tp + fp) AS a FROM q)
SELECT round(p, 6) AS macro_precision, round(r, 6) AS macro_recall, round(2 * p * r / (p + r), 6) AS macro_f1, round(a, 6) AS micro_precision, round(a, 6) AS micro_recall, round(a, 6) AS micro_f1, round(a, 6) AS accuracy FROM m
""")


def eval_roc_curve(e: DataFrame) -> DataFrame:
    return evaluation.roc_curve(e, "y", "s")


_STEPS = ", c AS (SELECT s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM e GROUP BY s), w AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c)"
_evaluated(eval_roc_curve, f"{_STEPS} SELECT round(s, 6)::DOUBLE AS threshold, round((fp - neg) / n, 6) AS fpr, round((tp - pos) / p, 6) AS tpr FROM w UNION ALL SELECT 0.0, 1.0, 1.0 UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0")


def eval_roc_auc(e: DataFrame) -> DataFrame:
    return evaluation.roc_auc(e, "y", "s")


_evaluated(eval_roc_auc, f"{_STEPS} SELECT round(sum(neg * (tp - pos / 2)) / any_value(p * n), 6) AS auc FROM w")


def eval_pr_curve(e: DataFrame) -> DataFrame:
    return evaluation.pr_curve(e, "y", "s", id_col="id").select("rank", "threshold", "precision", "recall")


_PR = ", w AS (SELECT id, s, y, sum((y = 1)::INT) OVER (ORDER BY s DESC, y DESC, id) AS tp, row_number() OVER (ORDER BY s DESC, y DESC, id) AS rank, sum((y = 1)::INT) OVER () AS p FROM e)"
_evaluated(eval_pr_curve, f"{_PR} SELECT rank, round(s, 6)::DOUBLE AS threshold, round(tp / rank, 6) AS precision, round(tp / p, 6) AS recall FROM w")


def eval_average_precision(e: DataFrame) -> DataFrame:
    return evaluation.average_precision_score(e, "y", "s", id_col="id")


_evaluated(eval_average_precision, f"{_PR} SELECT round(sum(tp / rank) FILTER (y = 1) / any_value(p), 6) AS average_precision FROM w")


def eval_calibration_error(e: DataFrame) -> DataFrame:
    return evaluation.expected_calibration_error(e, "y", "s")


_evaluated(eval_calibration_error, ", b AS (SELECT least(trunc(s * 10), 9) AS b, count(*) AS n, avg(s) AS c, avg((y = 1)::INT) AS a FROM e GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 6)::DOUBLE AS ece FROM b")


@_query("lineitem", """
WITH e AS (SELECT l_extendedprice / 1000 AS t, l_quantity * 1.5 AS p FROM lineitem)
SELECT round(avg(abs(t - p)), 6) AS mae, round(avg((t - p) * (t - p)), 6) AS mse, round(sqrt(avg((t - p) * (t - p))), 6) AS rmse, round(1 - avg((t - p) * (t - p)) / var_pop(t), 6) AS r2, CASE WHEN min(abs(t)) > 0 THEN round(avg(abs(t - p) / abs(t)) * 100, 6) END AS mape FROM e
""")
def eval_regression(df: DataFrame) -> DataFrame:
    return _r(evaluation.regression_metrics(df.select((F.col("l_extendedprice") / 1000).alias("t"), (F.col("l_quantity") * 1.5).alias("p")), "t", "p"))


# --- ranking ----------------------------------------------------------------------------------------------------------------

_WORDS = "the and ention der worthless the"
#: Words of a text as the tokeniser has them, for texts whose white space is ASCII.
_TOKENS = "list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> '')"
_DOCS = f"WITH d AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents), x AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d), c AS (SELECT doc_id, any_value(len) AS len, term, count(*) AS c FROM x GROUP BY doc_id, term), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), f AS (SELECT term, count(*) AS df FROM c GROUP BY term), q AS (SELECT term, count(*) AS qc FROM (SELECT unnest(string_split('{_WORDS}', ' ')) AS term) GROUP BY term)"
_TFIDF = f"""
{_DOCS}, i AS (SELECT term, ln((n + 1) / (df + 1)) + 1 AS idf FROM f, n), qw AS (SELECT term, qc / 6 * idf AS w FROM q JOIN i USING (term)), qn AS (SELECT sqrt(sum(w * w)) AS qn FROM qw),
s AS (SELECT doc_id, sum(c / len * idf * coalesce(w, 0)) / (sqrt(sum(power(c / len * idf, 2))) * any_value(qn)) AS s FROM c JOIN i USING (term) LEFT JOIN qw USING (term), qn GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(s, 0), 6) AS score FROM d LEFT JOIN s USING (doc_id)
"""
_BM25_CTE = f"{_DOCS}, s AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * len / avgdl)) * qc) AS s FROM c JOIN q USING (term) JOIN f USING (term), n GROUP BY doc_id)"


@_query("documents", _TFIDF)
def rank_tfidf(df: DataFrame) -> DataFrame:
    return _r(ranking.tfidf_score(df, _WORDS))


@_query("documents", f"{_BM25_CTE} SELECT d.doc_id, round(coalesce(s, 0), 6) AS score FROM d LEFT JOIN s USING (doc_id)")
def rank_bm25(df: DataFrame) -> DataFrame:
    return _r(ranking.bm25_score(df, _WORDS))


_MANY = f"WITH d AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents), x AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d), c AS (SELECT doc_id, any_value(len) AS len, term, count(*) AS c FROM x GROUP BY doc_id, term), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), f AS (SELECT term, count(*) AS df FROM c GROUP BY term), w AS (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark), q AS (SELECT item_id, term, count(*) AS qc FROM w GROUP BY 1, 2)"
_TOP = "s AS (SELECT b.item_id AS query_id, d.doc_id, round(coalesce(s, 0), 10) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN p ON p.item_id = b.item_id AND p.doc_id = d.doc_id) SELECT query_id, doc_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank FROM s QUALIFY rank <= 10"


def _indexed(name: str, score: str, sql: str) -> None:
    """Register the ten best documents for each text of ``benchmark``, from an index that is built, committed and opened again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = Scratch(spark, "inverted").path
        InvertedIndex.build(_read(spark, sf_dir, "documents"), path)
        queries = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
        return _r(InvertedIndex(spark, path).top_k(queries, 10, score=score))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"{_MANY}, {sql}, {_TOP}"


_indexed("index_bm25_top_k", "bm25", "p AS (SELECT item_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * len / avgdl)) * qc) AS s FROM c JOIN q USING (term) JOIN f USING (term), n GROUP BY ALL)")
_indexed(
    "index_tfidf_top_k", "tfidf",
    "i AS (SELECT term, ln((n + 1) / (df + 1)) + 1 AS idf FROM f, n), z AS (SELECT doc_id, sqrt(sum(power(c / len * idf, 2))) AS dn FROM c JOIN i USING (term) GROUP BY doc_id), "
    "l AS (SELECT item_id, sum(qc) AS ql FROM q GROUP BY 1), u AS (SELECT item_id, term, idf, qc / ql * idf AS w FROM q JOIN l USING (item_id) JOIN i USING (term)), v AS (SELECT item_id, sqrt(sum(w * w)) AS qn FROM u GROUP BY 1), "
    "p AS (SELECT u.item_id, c.doc_id, sum(c / len * idf * w) / (any_value(dn) * any_value(qn)) AS s FROM c JOIN u USING (term) JOIN z USING (doc_id) JOIN v USING (item_id) GROUP BY ALL)",
)


_LISTS = "WITH a AS (SELECT doc_id, source AS query_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS pos FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS pos FROM documents)"


def _lists(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return df.select("doc_id", F.col("source").alias("query_id"), F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("pos"))


@_query("documents", f"{_LISTS}, l AS (SELECT doc_id, pos FROM a UNION ALL SELECT doc_id, pos FROM b) SELECT doc_id, round(sum(1 / (60 + pos)), 8) AS score FROM l GROUP BY doc_id")
def rank_fusion(df: DataFrame) -> DataFrame:
    from tessera.plans.ordered import row_numbers

    by_length = row_numbers(df.select("doc_id", "n_chars"), [F.col("n_chars"), F.col("doc_id")], "pos").select("doc_id", "pos")
    return _r(ranking.reciprocal_rank_fusion(_lists(df).select("doc_id", "pos").unionByName(by_length), rank="pos"), 8)


@_query("documents", """
WITH e AS (SELECT source AS query, (n_chars % 4)::DOUBLE AS rel, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p, row_number() OVER (PARTITION BY source ORDER BY n_chars % 4 DESC, doc_id) AS i FROM documents),
g AS (SELECT query, coalesce(sum(rel / log2(p + 1)) FILTER (p <= 10), 0) AS d, coalesce(sum(rel / log2(i + 1)) FILTER (i <= 10), 0) AS b FROM e GROUP BY query)
SELECT query, round(CASE WHEN b <= 0 THEN 0 ELSE d / b END, 6) AS ndcg FROM g
""")
def rank_ndcg(df: DataFrame) -> DataFrame:
    return _r(ranking.ndcg(df.withColumn("rel", F.col("n_chars") % 4), query="source", position="doc_id", relevance="rel", k=10))


def _judged(name: str, query: Callable[[DataFrame, DataFrame], DataFrame], sql: str) -> None:
    """Register a ranking metric: lists per source by length, relevant are the documents labelled 1."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _read(spark, sf_dir, "documents")
        relevant = _read(spark, sf_dir, "labels").where("quality = 1").join(docs.select("doc_id", F.col("source").alias("query_id")), "doc_id").select("query_id", "doc_id")
        return _r(query(_lists(docs), relevant))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"{_LISTS}, k AS (SELECT doc_id FROM labels WHERE quality = 1), m AS (SELECT query_id AS query, pos, (doc_id IN (SELECT doc_id FROM k))::INT AS rel FROM a), w AS (SELECT *, sum(rel) OVER (PARTITION BY query ORDER BY pos) AS h, sum(rel) OVER (PARTITION BY query) AS total FROM m), ap AS (SELECT query, CASE WHEN any_value(total) = 0 THEN 0 ELSE sum(rel * h / pos) / any_value(total) END AS ap, coalesce(1 / min(pos) FILTER (rel = 1), 0) AS rr FROM w GROUP BY query) {sql}"


_judged("rank_average_precision", ranking.average_precision, "SELECT query, round(ap, 6) AS ap FROM ap")
_judged("rank_mean_average_precision", ranking.mean_average_precision, "SELECT round(avg(ap), 6) AS map FROM ap")
_judged("rank_reciprocal_rank", ranking.reciprocal_rank, "SELECT query, round(rr, 6)::DOUBLE AS rr FROM ap")
_judged("rank_mean_reciprocal_rank", ranking.mean_reciprocal_rank, "SELECT round(avg(rr), 6) AS mrr FROM ap")
_judged("rank_precision_at_k", lambda a, b: ranking.precision_at_k(a, b, 10), "SELECT query, round(sum(rel) FILTER (pos <= 10) / count(*) FILTER (pos <= 10), 6) AS precision FROM w GROUP BY query")
_judged("rank_recall_at_k", lambda a, b: ranking.recall_at_k(a, b, 10), "SELECT query, round(CASE WHEN any_value(total) = 0 THEN 0 ELSE sum(rel) FILTER (pos <= 10) / any_value(total) END, 6) AS recall FROM w GROUP BY query")


# --- text -------------------------------------------------------------------------------------------------------------------

_TURNS = f"WITH c AS (SELECT conv_id, turn, text AS h, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations), p AS (SELECT conv_id, turn, h, r, {_TOKENS.format('h')} AS th, {_TOKENS.format('r')} AS tr FROM c WHERE r IS NOT NULL)"


def _turns(df: DataFrame) -> DataFrame:
    """Each turn beside the one before it."""
    from pyspark.sql import Window

    return df.select("conv_id", "turn", F.col("text").alias("h"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("r")).where("r is not null")


_NAMES = "FROM part"


@_query("part", f"SELECT p_partkey, levenshtein(p_name, p_type)::INT AS d, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS s, damerau_levenshtein(p_name, p_type)::BIGINT AS dl {_NAMES}")
def text_edit_distances(df: DataFrame) -> DataFrame:
    a, b = F.col("p_name"), F.col("p_type")
    return _r(df.select("p_partkey", text_metrics.levenshtein(a, b).alias("d"), text_metrics.normalized_levenshtein(a, b).alias("s"), text_metrics.damerau_levenshtein(a, b).alias("dl")))


@_query("part")
def text_jaro(df: DataFrame) -> DataFrame:
    a, b = F.col("p_name"), F.col("p_brand")
    return _r(df.select("p_partkey", text_metrics.jaro(a, b).alias("jaro"), text_metrics.jaro_winkler(a, b).alias("jaro_winkler")))


@_query("conversations", f"{_TURNS} SELECT conv_id, turn, round(len(list_intersect(list_distinct(th), list_distinct(tr))) / len(list_distinct(list_concat(th, tr))), 6) AS j FROM p")
def text_jaccard_token(df: DataFrame) -> DataFrame:
    return _r(_turns(df).select("conv_id", "turn", text_metrics.jaccard_token(F.col("r"), F.col("h")).alias("j")))


def _gram_sql(n: int, select: str) -> str:
    grams = lambda t: f"(CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n - 2}), lambda i: array_to_string({t}[i:i + {n - 1}], ' ')) ELSE [] END)"
    return f"{_TURNS}, g AS (SELECT conv_id, turn, {grams('th')} AS gh, {grams('tr')} AS gr FROM p), u AS (SELECT conv_id, turn, len(gh) AS nh, len(gr) AS nr, list_sum(list_transform(list_distinct(gh), lambda x: least(len(list_filter(gh, lambda y: y = x)), len(list_filter(gr, lambda y: y = x))))) AS m FROM g), v AS (SELECT conv_id, turn, CASE WHEN nh = 0 THEN 0 ELSE coalesce(m, 0) / nh END AS p, CASE WHEN nr = 0 THEN 0 ELSE coalesce(m, 0) / nr END AS r FROM u) {select}"


@_query("conversations", _gram_sql(1, "SELECT conv_id, turn, round(p, 6) AS overlap FROM v"))
def text_ngram_overlap(df: DataFrame) -> DataFrame:
    return _r(_turns(df).select("conv_id", "turn", text_metrics.ngram_overlap(F.col("r"), F.col("h"), n=1).alias("overlap")))


@_query("conversations", _gram_sql(2, "SELECT conv_id, turn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM v"))
def text_rouge_n(df: DataFrame) -> DataFrame:
    return _r(_turns(df).select("conv_id", "turn", text_metrics.rouge_n(F.col("r"), F.col("h")).alias("m")).select("conv_id", "turn", "m.*"))


@_query("conversations")
def text_rouge_l(df: DataFrame) -> DataFrame:
    return _r(_turns(df).select("conv_id", "turn", text_metrics.rouge_l(F.col("r"), F.col("h")).alias("m")).select("conv_id", "turn", "m.*"))


@_query("conversations", f"""
{_TURNS}, s AS (SELECT conv_id, turn, 'h' AS side, unnest(flatten(list_transform(range(1, len(th)), lambda i: list_transform(range(i + 1, least(len(th), i + 3) + 1), lambda j: th[i] || ' ' || th[j])))) AS g FROM p
  UNION ALL SELECT conv_id, turn, 'r', unnest(flatten(list_transform(range(1, len(tr)), lambda i: list_transform(range(i + 1, least(len(tr), i + 3) + 1), lambda j: tr[i] || ' ' || tr[j])))) FROM p),
k AS (SELECT conv_id, turn, g, count(*) FILTER (side = 'h') AS a, count(*) FILTER (side = 'r') AS b FROM s GROUP BY ALL), u AS (SELECT conv_id, turn, sum(least(a, b)) AS m, sum(a) AS nh, sum(b) AS nr FROM k GROUP BY ALL),
v AS (SELECT p.conv_id, p.turn, coalesce(CASE WHEN nh > 0 THEN m / nh END, 0) AS p, coalesce(CASE WHEN nr > 0 THEN m / nr END, 0) AS r FROM p LEFT JOIN u USING (conv_id, turn))
SELECT conv_id, turn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN 1.44 * p + r = 0 THEN 0 ELSE 2.44 * p * r / (1.44 * p + r) END, 6) AS f1 FROM v
""")
def text_rouge_s(df: DataFrame) -> DataFrame:
    return _r(_turns(df).select("conv_id", "turn", text_metrics.rouge_s(F.col("r"), F.col("h"), skip_distance=2).alias("m")).select("conv_id", "turn", "m.*"))


@_query("conversations", f"""
{_TURNS}, g AS (SELECT conv_id, turn, 1 AS n, 'h' AS side, unnest(th) AS g FROM p UNION ALL SELECT conv_id, turn, 1, 'r', unnest(tr) FROM p
  UNION ALL SELECT conv_id, turn, 2, 'h', unnest(list_transform(range(1, len(th)), lambda i: th[i] || ' ' || th[i + 1])) FROM p UNION ALL SELECT conv_id, turn, 2, 'r', unnest(list_transform(range(1, len(tr)), lambda i: tr[i] || ' ' || tr[i + 1])) FROM p),
k AS (SELECT conv_id, turn, n, g, count(*) FILTER (side = 'h') AS a, count(*) FILTER (side = 'r') AS b FROM g GROUP BY ALL), m AS (SELECT conv_id, turn, n, CASE WHEN sum(a) > 0 THEN sum(least(a, b)) / sum(a) ELSE 0 END AS q FROM k GROUP BY ALL),
v AS (SELECT conv_id, turn, coalesce(max(q) FILTER (n = 1), 0) AS p1, coalesce(max(q) FILTER (n = 2), 0) AS p2 FROM m GROUP BY ALL),
b AS (SELECT p.conv_id, p.turn, coalesce(p1, 0) AS p1, coalesce(p2, 0) AS p2, CASE WHEN len(th) > len(tr) THEN 1.0 ELSE exp(1 - CASE WHEN len(th) > 0 THEN len(tr) / len(th) ELSE 0 END) END AS bp FROM p LEFT JOIN v USING (conv_id, turn))
SELECT conv_id, turn, round(CASE WHEN p1 > 0 AND p2 > 0 THEN bp * exp(0.5 * ln(greatest(p1, 1e-300)) + 0.5 * ln(greatest(p2, 1e-300))) ELSE 0 END, 6)::DOUBLE AS score, round(CASE WHEN p1 > 0 AND p2 > 0 THEN bp ELSE 0 END, 6)::DOUBLE AS bp FROM b
""")
def text_bleu(df: DataFrame) -> DataFrame:
    return _r(_turns(df).select("conv_id", "turn", text_metrics.bleu(F.array("r"), F.col("h"), max_n=2).alias("m")).select("conv_id", "turn", "m.score", "m.bp"))


# --- sampling ---------------------------------------------------------------------------------------------------------------


@_query("labels", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_KEY.format(seed=7, stream='split', ids='doc_id')}, doc_id) AS rn, count(*) OVER () AS n FROM labels) SELECT doc_id, CASE WHEN rn <= greatest(1, ceil(n * 0.2)) THEN 'test' ELSE 'train' END AS split FROM r")
def sample_train_test_split(df: DataFrame) -> DataFrame:
    return sampling.train_test_split(df.select("doc_id"), "doc_id", seed=7)


@_query("labels", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_KEY.format(seed=7, stream='split', ids='doc_id')}, doc_id) AS rn, count(*) OVER () AS n FROM labels) SELECT doc_id, CASE WHEN rn <= ceil(n * 0.1) THEN 'test' WHEN rn <= 2 * ceil(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM r")
def sample_train_val_test_split(df: DataFrame) -> DataFrame:
    return sampling.train_val_test_split(df.select("doc_id"), "doc_id", seed=7)


@_query("labels", f"SELECT doc_id, (ntile(5) OVER (ORDER BY {_KEY.format(seed=7, stream='fold', ids='doc_id')}, doc_id) - 1)::INT AS fold FROM labels")
def sample_kfold(df: DataFrame) -> DataFrame:
    return sampling.kfold(df.select("doc_id"), "doc_id", 5, seed=7)


@_query("labels", f"SELECT doc_id, ((row_number() OVER (PARTITION BY quality ORDER BY {_KEY.format(seed=7, stream='fold', ids='doc_id')}, doc_id) - 1) % 5)::INT AS fold FROM labels")
def sample_stratified_kfold(df: DataFrame) -> DataFrame:
    return sampling.stratified_kfold(df, "doc_id", "quality", 5, seed=7).select("doc_id", "fold")


@_query("orders", f"SELECT o_orderkey FROM orders ORDER BY {_KEY.format(seed=7, stream='reservoir', ids='o_orderkey')}, o_orderkey LIMIT 500")
def sample_reservoir(df: DataFrame) -> DataFrame:
    return sampling.reservoir_sample(df, "o_orderkey", 500, seed=7).select("o_orderkey")


@_query("labels", f"""
WITH v AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS at, quality::DOUBLE AS x, count(*) OVER () AS n FROM labels), n AS (SELECT any_value(n) AS n FROM v),
d AS (SELECT i // n AS run, i % n AS draw, n FROM n, range(200 * (SELECT count(*) FROM labels)) t(i)),
k AS (SELECT run, least(floor({_u("bootstrap", "run, draw", 7)} * n), n - 1) AS at FROM d), s AS (SELECT run, avg(x) AS s FROM k JOIN v ON v.at = k.at GROUP BY run)
SELECT (SELECT round(avg(x), 6) FROM v) AS statistic, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std, round(list_sort(list(s))[6], 6) AS ci_lower, round(list_sort(list(s))[196], 6) AS ci_upper, 200::BIGINT AS n_resamples FROM s
""")
def sample_bootstrap(df: DataFrame) -> DataFrame:
    return _r(sampling.bootstrap(df, "quality", "doc_id", n_resamples=200, seed=7, method="draws"))


@_query("orders", "SELECT round(avg(o_totalprice), 4) AS statistic, 10000::BIGINT AS n_resamples, true AS mean_close, true AS std_close, true AS interval_close FROM orders")
def sample_bootstrap_counts(df: DataFrame) -> DataFrame:
    """All 10,000 resamples of order prices, held against what the law of large numbers says of their mean, deviation and interval."""
    b = sampling.bootstrap(df, "o_totalprice", "o_orderkey", method="counts")
    known = df.agg(F.avg("o_totalprice").alias("m"), (F.stddev_pop("o_totalprice") / F.sqrt(F.count("*"))).alias("se"))
    near = lambda x, y, tolerance: F.abs(x - y) < tolerance
    m, se = F.col("m"), F.col("se")
    return b.join(F.broadcast(known)).select(
        F.round("statistic", 4).alias("statistic"), "n_resamples", near(F.col("mean"), m, se / 20).alias("mean_close"), near(F.col("std"), se, se / 20).alias("std_close"),
        (near(F.col("ci_lower"), m - 1.96 * se, se / 5) & near(F.col("ci_upper"), m + 1.96 * se, se / 5)).alias("interval_close"),
    )


@_query("orders", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS statistic, true AS inside FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def sample_bootstrap_median(df: DataFrame) -> DataFrame:
    """The median of 10,000 resamples, each from the leaf that holds its middle draw."""
    b = sampling.bootstrap(df.where("o_orderstatus = 'F'"), "o_totalprice", "o_orderkey", "median", seed=5, method="counts")
    return b.select(F.lit("F").alias("o_orderstatus"), F.round("statistic", 4).alias("statistic"), ((F.col("ci_lower") <= F.col("statistic")) & (F.col("statistic") <= F.col("ci_upper")) & (F.col("std") > 0)).alias("inside"))


def test_permutation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 10,000 permutations; p lies near that of the normal approximation."""
    df = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents"), "doc_id")
    p = testing.permutation_test(df, "n_chars", "toxic", 1, 0, id_col="doc_id", method="counts")
    x, first = F.col("n_chars").cast("double"), F.col("toxic") == 1
    n1, n2 = F.count_if(first), F.count_if(~first)
    se = F.sqrt(F.var_samp(x) * (1 / n1 + 1 / n2))
    known = df.where("toxic IN (0, 1)").agg((F.abs(F.avg(F.when(first, x)) - F.avg(F.when(~first, x))) / se).alias("z"))
    normal = 2 * (1 - normal_cdf(F.col("z")))
    return p.join(F.broadcast(known)).select(F.round("statistic", 4).alias("statistic"), (F.abs(F.col("p_value") - normal) < 0.05).alias("p_close"), "n1", "n2")


QUERIES["test_permutation_counts"] = test_permutation_counts
ORACLE_SQL["test_permutation_counts"] = "SELECT round(avg(n_chars) FILTER (toxic = 1) - avg(n_chars) FILTER (toxic = 0), 4) AS statistic, true AS p_close, count(*) FILTER (toxic = 1) AS n1, count(*) FILTER (toxic = 0) AS n2 FROM labels JOIN documents USING (doc_id)"


# --- anomalies --------------------------------------------------------------------------------------------------------------

_Z = "SELECT event_id, round(s, 6) AS score, s > {} AS is_outlier FROM z"


@_query("events", "WITH z AS (SELECT event_id, abs(value - avg(value) OVER w) / stddev_samp(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY event_type)) " + _Z.format(3))
def anomaly_zscore(df: DataFrame) -> DataFrame:
    return _r(anomaly.zscore_detector(df, "value", ["event_type"]).select("event_id", "score", "is_outlier"))


@_query("events", "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1), z AS (SELECT event_id, greatest(0, a - 1.5 * (b - a) - value, value - b - 1.5 * (b - a)) / (b - a) AS s FROM events JOIN q USING (event_type)) " + _Z.format(0))
def anomaly_iqr(df: DataFrame) -> DataFrame:
    return _r(anomaly.iqr_detector(df, "value", ["event_type"]).select("event_id", "score", "is_outlier"))


@_query("events", _ROBUST.format(key="event_type", x="value", t="events") + ", z AS (SELECT event_id, abs(0.6745 * (value - med) / mad) AS s FROM events JOIN d USING (event_type)) " + _Z.format(3.5))
def anomaly_mad(df: DataFrame) -> DataFrame:
    return _r(anomaly.mad_detector(df, "value", ["event_type"]).select("event_id", "score", "is_outlier"))


@_query("embeddings", f"""
{_VECS}, d AS (SELECT a.vec_id AS i, b.vec_id AS j, {_DIST} AS d FROM e a, e b WHERE a.vec_id <> b.vec_id),
k AS (SELECT i, j, d FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 10), m AS (SELECT i, max(d) AS kd FROM k GROUP BY i),
l AS (SELECT k.i, 1 / avg(greatest(d, kd)) AS lrd FROM k JOIN m ON m.i = k.j GROUP BY k.i), o AS (SELECT k.i, avg(b.lrd) / any_value(a.lrd) AS s FROM k JOIN l a ON a.i = k.i JOIN l b ON b.i = k.j GROUP BY k.i)
SELECT i AS id, round(s, 6) AS score, s > 1.5 AS is_outlier FROM o
""")
def anomaly_lof(df: DataFrame) -> DataFrame:
    return _r(anomaly.lof(df, id_col="vec_id", vector="embedding", k=10))


@_query("events")
def anomaly_isolation(df: DataFrame) -> DataFrame:
    return _r(anomaly.isolation_score(df, "value", "event_id"))


# --- clusters ---------------------------------------------------------------------------------------------------------------

_KM = "list_sum(list_transform(list_zip(p.v, c{0}.v), lambda t: power(t[1] - t[2], 2)))"


def _kmeans_sql(rounds: int, k: int) -> str:
    parts = [f"WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS label, v FROM p ORDER BY id LIMIT {k})"]
    for r in range(rounds):
        parts.append(f"a{r} AS (SELECT p.id, p.v, c{r}.label FROM p, c{r} QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {_KM.format(r)}, c{r}.label) = 1)")
        parts.append(f"u{r} AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{r}), m{r} AS (SELECT label, d, avg(x) AS x FROM u{r} GROUP BY label, d), c{r + 1} AS (SELECT label, list(x ORDER BY d) AS v FROM m{r} GROUP BY label)")
    return ", ".join(parts) + f" SELECT p.id, c{rounds}.label::INT AS label FROM p, c{rounds} QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {_KM.format(rounds)}, c{rounds}.label) = 1"


@_query("embeddings", _kmeans_sql(3, 4))
def cluster_kmeans(df: DataFrame) -> DataFrame:
    start = [r[0] for r in df.orderBy("vec_id").limit(4).select(F.col("embedding").cast("array<double>")).collect()]
    return clustering.kmeans(df, 4, id_col="vec_id", vector="embedding", start=start, max_iter=3, tol=0.0)[0]


@_query("customer")
def cluster_kmeans_plus_plus(df: DataFrame) -> DataFrame:
    points = df.select("c_custkey", F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("v"))
    return clustering.kmeans(points, 5, id_col="c_custkey", n_init=3, max_iter=20)[0]


def _plane(df: DataFrame) -> DataFrame:
    """Two coordinates of each customer, on a common scale."""
    return df.select("c_custkey", F.array(F.col("c_acctbal") / 100, F.col("c_nationkey") * 4.0).alias("v"))


@_query("customer", """
WITH RECURSIVE p AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, c_nationkey * 4.0 AS y FROM customer), n AS (SELECT a.id AS i, b.id AS j FROM p a JOIN p b ON sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 0.6),
c AS (SELECT i AS id FROM n GROUP BY i HAVING count(*) >= 4), g AS (SELECT i, j FROM n WHERE i IN (SELECT id FROM c) AND j IN (SELECT id FROM c)),
r AS (SELECT id AS i, id AS j FROM c UNION SELECT r.i, g.j FROM r JOIN g ON g.i = r.j), m AS (SELECT i, min(j) AS lead FROM r GROUP BY i), k AS (SELECT i, dense_rank() OVER (ORDER BY lead) - 1 AS label FROM m)
SELECT p.id, coalesce(any_value(own.label), min(k.label), -1)::INT AS label, bool_or(own.label IS NOT NULL) AS core FROM p LEFT JOIN n ON n.i = p.id LEFT JOIN k ON k.i = n.j LEFT JOIN k own ON own.i = p.id GROUP BY p.id
""")
def cluster_dbscan(df: DataFrame) -> DataFrame:
    return clustering.dbscan(_plane(df), eps=0.6, min_samples=4, id_col="c_custkey")


@_query("supplier")
def cluster_agglomerative(df: DataFrame) -> DataFrame:
    return clustering.agglomerative(df.select("s_suppkey", F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double")).alias("v")), 5, id_col="s_suppkey")


@_query("embeddings", f"""
{_VECS}, d AS (SELECT a.vec_id AS i, la.label AS li, lb.label AS lj, {_DIST} AS d FROM e a JOIN embeddings la ON la.vec_id = a.vec_id, e b JOIN embeddings lb ON lb.vec_id = b.vec_id WHERE a.vec_id <> b.vec_id),
m AS (SELECT i, li, lj, avg(d) AS d FROM d GROUP BY ALL), s AS (SELECT i, coalesce(max(d) FILTER (li = lj), 0) AS a, min(d) FILTER (li <> lj) AS b FROM m GROUP BY i)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s
""")
def cluster_silhouette(df: DataFrame) -> DataFrame:
    return _r(clustering.silhouette_score(df, "label", id_col="vec_id", vector="embedding"))


@_query("embeddings", f"""
{_VECS}, u AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, avg(x) AS x FROM u GROUP BY ALL), c AS (SELECT label, list(x ORDER BY d) AS x FROM m GROUP BY label),
s AS (SELECT b.label, avg({_DIST}) AS s, any_value(b.x) AS x FROM e a JOIN embeddings l ON l.vec_id = a.vec_id JOIN c b ON b.label = l.label GROUP BY b.label),
r AS (SELECT a.label, max((a.s + b.s) / {_DIST}) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label) SELECT round(avg(r), 6) AS davies_bouldin FROM r
""")
def cluster_davies_bouldin(df: DataFrame) -> DataFrame:
    return _r(clustering.davies_bouldin_index(df, "label", vector="embedding"))


# --- graphs -----------------------------------------------------------------------------------------------------------------

_EDGES = "WITH g AS (SELECT l_suppkey AS src, l_partkey AS dst, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2), v AS (SELECT DISTINCT unnest([src, dst]) AS id FROM g)"


def _supply(df: DataFrame) -> graph.Graph:
    """Suppliers and parts that occur together, counted once and written; a node's vector is its id's last digits."""
    edges = df.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    edges = Scratch(df.sparkSession, "supply").table(edges, "edges")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.Graph(nodes.withColumn("features", F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double"))), edges)


@_query("lineitem", f"{_EDGES}, i AS (SELECT dst AS id, count(*) AS n FROM g GROUP BY 1), o AS (SELECT src AS id, count(*) AS n FROM g GROUP BY 1) SELECT v.id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM v LEFT JOIN i USING (id) LEFT JOIN o USING (id)")
def graph_degrees(df: DataFrame) -> DataFrame:
    return graph.degrees(_supply(df))


@_query("lineitem", f"""
{_EDGES}, e AS (SELECT src, dst, weight FROM g WHERE src <> dst UNION ALL SELECT id, id, 1.0 FROM v), s AS (SELECT dst AS id, 1 / sqrt(sum(weight)) AS s FROM e GROUP BY dst)
SELECT e.dst AS id, round(sum(weight * a.s * b.s * (e.src % 7)), 6) AS x, round(sum(weight * a.s * b.s * (e.src % 5)), 6) AS y FROM e JOIN s a ON a.id = e.src JOIN s b ON b.id = e.dst GROUP BY e.dst
""")
def graph_gcn_propagate(df: DataFrame) -> DataFrame:
    return _r(graph.gcn_propagate(_supply(df)).select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")))


@_query("lineitem", f"{_EDGES}, m AS (SELECT dst AS id, avg(src % 7) AS x, avg(src % 5) AS y FROM g GROUP BY dst) SELECT v.id, round(coalesce(x, 0), 6)::DOUBLE AS x, round(coalesce(y, 0), 6)::DOUBLE AS y FROM v LEFT JOIN m USING (id)")
def graph_sage_propagate(df: DataFrame) -> DataFrame:
    return _r(graph.sage_propagate(_supply(df)).select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")))


@_query("lineitem", f"""
{_EDGES}, e AS (SELECT src, dst FROM g WHERE src <> dst UNION ALL SELECT id, id FROM v), w AS (SELECT src, dst, exp(0.1 * (src % 7 + dst % 7) - 0.2 * (src % 5 + dst % 5)) AS w FROM (SELECT * FROM e))
SELECT dst AS id, round(sum(w * (src % 7)) / sum(w), 6) AS x, round(sum(w * (src % 5)) / sum(w), 6) AS y FROM w GROUP BY dst
""")
def graph_gat_propagate(df: DataFrame) -> DataFrame:
    return _r(graph.gat_propagate(_supply(df), [0.1, -0.2]).select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")))


def _gcn_layers() -> list[tuple[np.ndarray, np.ndarray | None]]:
    rng = np.random.default_rng(0)
    return [(rng.standard_normal((2, 4)), np.zeros(4)), (rng.standard_normal((4, 2)), None)]


def _gcn_sql() -> str:
    """Two layers: sums over neighbours scaled at both ends, times the weights, with ReLU between."""
    (first, _), (second, _) = _gcn_layers()
    term = lambda names, w: " + ".join(f"{n} * ({float(x)!r})" for n, x in zip(names, w, strict=True))
    hidden = ", ".join(f"greatest(0, {term(['a', 'b'], first[:, j])}) AS h{j}" for j in range(4))
    moved = ", ".join(f"sum(weight * p.s * q.s * x.h{j}) AS m{j}" for j in range(4))
    out = [term([f"m{j}" for j in range(4)], second[:, k]) for k in range(2)]
    return f"""
{_EDGES}, e AS (SELECT src, dst, weight FROM g WHERE src <> dst UNION ALL SELECT id, id, 1.0 FROM v), s AS (SELECT dst AS id, 1 / sqrt(sum(weight)) AS s FROM e GROUP BY dst),
n AS (SELECT e.dst AS id, sum(weight * p.s * q.s * (e.src % 7)) AS a, sum(weight * p.s * q.s * (e.src % 5)) AS b FROM e JOIN s p ON p.id = e.src JOIN s q ON q.id = e.dst GROUP BY e.dst),
x AS (SELECT id, {hidden} FROM n), m AS (SELECT e.dst AS id, {moved} FROM e JOIN s p ON p.id = e.src JOIN s q ON q.id = e.dst JOIN x ON x.id = e.src GROUP BY e.dst)
SELECT id, round({out[0]}, 6) + 0.0 AS x, round({out[1]}, 6) + 0.0 AS y FROM m
"""


@_query("lineitem", _gcn_sql())
def graph_gcn(df: DataFrame) -> DataFrame:
    return _r(graph.gcn(_supply(df), _gcn_layers()).select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")))


_NUMBERED = f"{_EDGES}, z AS (SELECT src, count(*) AS deg FROM g GROUP BY 1), num AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k FROM g)"


def _pick(stream: str, ids: str) -> str:
    return f"least(floor({_u(stream, ids)} * deg), deg - 1)::BIGINT"


def _walks_sql(length: int, walks: int) -> str:
    out = [f"{_NUMBERED}, w0 AS (SELECT id, walk::INT AS walk, id AS here, [id] AS path FROM v, range({walks}) t(walk))"]
    for s in range(1, length):
        pick = _pick(f"walk{s}", "w.id, walk")
        out.append(f"w{s} AS (SELECT w.id, walk, e.dst AS here, CASE WHEN e.dst IS NULL THEN path ELSE list_append(path, e.dst) END AS path FROM w{s - 1} w LEFT JOIN z ON z.src = here LEFT JOIN num e ON e.src = here AND e.k = {pick})")
    return f"{', '.join(out)} SELECT id, walk, array_to_string(path, ' ') AS path FROM w{length - 1}"


@_query("lineitem", _walks_sql(4, 2))
def graph_random_walks(df: DataFrame) -> DataFrame:
    return graph.random_walks(_supply(df), walk_length=4, num_walks=2).withColumn("path", F.concat_ws(" ", F.col("path").cast("array<string>")))


def _biased_sql(length: int, walks: int, p: float, q: float) -> str:
    """The same draws: the first accepted of ``PATIENCE`` proposals, else the race of all edges."""
    back, away = 1 / p, 1 / q
    w = f"CASE WHEN prev IS NULL THEN 1.0 WHEN dst = prev THEN {back} WHEN near THEN 1.0 ELSE {away} END"
    top = f"CASE WHEN prev IS NULL THEN 1.0 WHEN EXISTS (SELECT 1 FROM g WHERE g.src = here AND g.dst = prev) THEN {max(back, 1, away)} ELSE {max(1, away)} END"
    out = [f"{_NUMBERED}, s0 AS (SELECT id, walk::INT AS walk, NULL::BIGINT AS prev, id AS here, [id] AS path FROM v, range({walks}) t(walk))"]
    for i in range(length - 1):
        ids = f"s.id, walk, {i}"
        near = "(c.src IS NOT NULL) AS near"
        out += [
            f"p{i} AS (SELECT s.id, walk, prev, here, t, e.dst, {near}, {_u('accept', f'{ids}, t')} AS u FROM (SELECT *, unnest(range({graph.PATIENCE})) AS t FROM s{i} JOIN z ON z.src = here) s JOIN num e ON e.src = s.here AND e.k = {_pick('propose', f'{ids}, t')} LEFT JOIN g c ON c.src = prev AND c.dst = e.dst)",
            f"a{i} AS (SELECT id, walk, arg_min(dst, t) AS nxt FROM (SELECT *, {w} AS w, {top} AS top FROM p{i}) WHERE u * top < w GROUP BY 1, 2)",
            f"r{i} AS (SELECT id, walk, arg_min(dst, -ln(greatest(u, 1e-12)) / w) AS nxt FROM (SELECT *, {w} AS w FROM (SELECT s.id, walk, prev, e.dst, {near}, {_u('race', f'{ids}, e.k')} AS u FROM s{i} s JOIN num e ON e.src = here LEFT JOIN g c ON c.src = prev AND c.dst = e.dst)) GROUP BY 1, 2)",
            f"s{i + 1} AS (SELECT s.id, s.walk, here AS prev, coalesce(a.nxt, r.nxt) AS here, CASE WHEN coalesce(a.nxt, r.nxt) IS NULL THEN path ELSE list_append(path, coalesce(a.nxt, r.nxt)) END AS path FROM s{i} s LEFT JOIN a{i} a ON a.id = s.id AND a.walk = s.walk LEFT JOIN r{i} r ON r.id = s.id AND r.walk = s.walk)",
        ]
    return f"{', '.join(out)} SELECT id, walk, array_to_string(path, ' ') AS path FROM s{length - 1}"


@_query("lineitem", _biased_sql(4, 2, 0.25, 4.0))
def graph_biased_walks(df: DataFrame) -> DataFrame:
    return graph.biased_walks(_supply(df), walk_length=4, num_walks=2, p=0.25, q=4.0).withColumn("path", F.concat_ws(" ", F.col("path").cast("array<string>")))


@_query("lineitem", f"{_EDGES}, s AS (SELECT src, dst, 1 / (1 + exp(-(0.01 * (src % 7) * (dst % 7) - 0.02 * (src % 5) * (dst % 5)))) AS s FROM g) SELECT src, dst, round(s, 6) AS score, s >= 0.5 AS predicted FROM s")
def graph_link_scores(df: DataFrame) -> DataFrame:
    g = _supply(df)
    left = g.nodes.select("id", F.array(F.col("features")[0] * 0.01, F.col("features")[1] * -0.02).alias("a"), F.col("features").alias("b"))
    a, b = left.select(F.col("id").alias("src"), "a"), left.select(F.col("id").alias("dst"), "b")
    score = 1 / (1 + F.exp(-V.dot(F.col("a"), F.col("b"))))
    return _r(g.edges.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", score.alias("score"), (score >= 0.5).alias("predicted")))


def _nations(nation: DataFrame) -> graph.Graph:
    """Nations of a region are linked."""
    a, b = nation.select(F.col("n_nationkey").cast("long").alias("src"), "n_regionkey"), nation.select(F.col("n_nationkey").cast("long").alias("dst"), "n_regionkey")
    nodes = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.array(F.col("n_regionkey").cast("double")).alias("features"))
    return graph.Graph(nodes, a.join(b, "n_regionkey").where("src <> dst").select("src", "dst", F.lit(1.0).alias("weight")))


@_query("nation")
def graph_dominant(df: DataFrame) -> DataFrame:
    return _r(graph.dominant_scores(_nations(df)), 4)


# --- studies and streams ----------------------------------------------------------------------------------------------------


def _corpus_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as units; each is related to the one before it in its source."""
    from pyspark.sql import Window

    units = docs.select(F.col("doc_id").cast("string").alias("unit_id"), "lang", "source")
    before = F.lag("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))
    relations = docs.select(F.col("doc_id").cast("string").alias("source_id"), before.cast("string").alias("target_id")).where("target_id is not null")
    return units, relations


_LINKS = "WITH u AS (SELECT doc_id::VARCHAR AS unit_id, lang FROM documents), r AS (SELECT doc_id::VARCHAR AS source_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id)::VARCHAR AS target_id FROM documents QUALIFY target_id IS NOT NULL)"


@_query("documents", f"{_LINKS} SELECT source_id, target_id FROM r JOIN u a ON a.unit_id = source_id JOIN u b ON b.unit_id = target_id WHERE a.lang = 'en' AND b.lang = 'en'")
def study_subset_relations(df: DataFrame) -> DataFrame:
    units, relations = _corpus_tables(df)
    keep = units.where("lang = 'en'").select("unit_id")
    ends = [keep.withColumnRenamed("unit_id", c) for c in ("source_id", "target_id")]
    return relations.join(ends[0], "source_id", "left_semi").join(ends[1], "target_id", "left_semi").select("source_id", "target_id")


@_query("documents", f"{_LINKS}, k AS (SELECT unit_id FROM u WHERE lang <> 'fr') SELECT DISTINCT unit_id FROM (SELECT unnest([source_id, target_id]) AS unit_id FROM r) WHERE unit_id NOT IN (SELECT unit_id FROM k)")
def study_dangling_endpoints(df: DataFrame) -> DataFrame:
    from tessera.study.contracts import dangling_endpoints

    units, relations = _corpus_tables(df)
    return dangling_endpoints(units.where("lang <> 'fr'"), relations)


@_query("lineitem", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def study_duplicate_ids(df: DataFrame) -> DataFrame:
    from tessera.study.contracts import duplicate_ids

    return duplicate_ids(df, "l_orderkey")


@_query("events", f"{_PS} SELECT id, CASE WHEN p > 0.05 THEN 'indeterminate' WHEN id % 2 = 0 THEN 'supported' ELSE 'contradicted' END AS label FROM p")
def study_verdicts(df: DataFrame) -> DataFrame:
    from tessera.study.methodology import verdict_column

    return _p_values(df).select("id", verdict_column(F.col("p"), 0.05, F.col("id") % 2 == 0, F.lit(True)).alias("label"))


_LABEL = "CASE WHEN quality = 0 THEN 'indeterminate' WHEN toxic = 1 THEN 'contradicted' ELSE 'supported' END"


def study_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.study.methodology import score_table

    verdict = F.when(F.col("quality") == 0, "indeterminate").when(F.col("toxic") == 1, "contradicted").otherwise("supported")
    rows = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").withColumn("label", verdict)
    return _r(score_table(rows))


QUERIES["study_scorecard"] = study_scorecard
ORACLE_SQL["study_scorecard"] = f"""
WITH v AS (SELECT source, {_LABEL} AS label FROM labels JOIN documents USING (doc_id)),
c AS (SELECT source, count(*) FILTER (label = 'supported') AS n_supported, count(*) FILTER (label = 'contradicted') AS n_contradicted, count(*) FILTER (label = 'indeterminate') AS n_indeterminate FROM v GROUP BY source)
SELECT *, CASE WHEN n_supported + n_contradicted > 0 THEN round(n_supported / (n_supported + n_contradicted), 6) END AS alignment_rate FROM c
"""


@_query("embeddings", f"{_VECS} SELECT b.vec_id AS ref, round({_COS} / sqrt(list_sum(list_transform(a.x, lambda t: t * t)) * list_sum(list_transform(b.x, lambda t: t * t))), 6) AS score FROM (SELECT * FROM e ORDER BY vec_id LIMIT 1) a, e b ORDER BY score DESC, ref LIMIT 10")
def store_top_k(df: DataFrame) -> DataFrame:
    """Through the store: two generations of rows, of which the second replaces a third of the first, and a query."""
    rows = df.select(F.col("vec_id").cast("string").alias("ref"), F.col("embedding").cast("array<double>").alias("v"))
    probe = df.orderBy("vec_id").limit(1).select(F.col("embedding").cast("array<double>")).first()[0]
    store = stores.VectorTable(df.sparkSession, Scratch(df.sparkSession, "vectors").path, len(probe))
    stale = F.when(F.pmod(F.xxhash64("ref"), F.lit(3)) == 0, F.reverse("v")).otherwise(F.col("v"))
    store.upsert(rows.withColumn("v", stale))
    store.upsert(rows.where(F.pmod(F.xxhash64("ref"), F.lit(3)) == 0))
    return store.query(probe, 10).select(F.col("ref").cast("long").alias("ref"), F.round("score", 6).alias("score"))


@_query("embeddings", f"{_VECS}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS ref, greatest(-1, least(1, {_COS} / sqrt(list_sum(list_transform(a.x, lambda t: t * t)) * list_sum(list_transform(b.x, lambda t: t * t))))) AS score FROM e a, e b WHERE a.vec_id % 50 = 0) SELECT query_id, ref, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ref))::INT AS r FROM s QUALIFY r <= 5")
def store_query_many(df: DataFrame) -> DataFrame:
    store = stores.VectorTable(df.sparkSession, Scratch(df.sparkSession, "vectors").path, 64)
    store.upsert(df.select(F.col("vec_id").cast("string").alias("ref"), F.col("embedding").alias("v")))
    found = store.query_many(df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), 5)
    return found.select("query_id", F.col("ref").cast("long").alias("ref"), F.round("score", 6).alias("score"), "r")


@_query("events", "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM events GROUP BY 1, 2")
def stream_windowed_stats(df: DataFrame) -> DataFrame:
    from tessera.streaming import windowed_stats

    return _r(windowed_stats(df).withColumn("start", F.unix_timestamp("start")))


def _parked_run(spark: SparkSession, sf_dir: str) -> tuple[durable.RunStore, str]:
    """A run over ``lineitem`` that parks at a gate, and is resumed by a graph and a store that know nothing of its beginning."""
    path, run_id = Scratch(spark, "runs").path, "prices"
    gate = governance.Gate("prices", governance.Phase.DISCOVERY, governance.Phase.PREREGISTER, frozenset([StudyMode.DISCOVERY]))
    trail = ProvenanceTrail()

    def graph() -> durable.Graph:
        def ingest(state: durable.RunState) -> dict[str, DataFrame]:
            return {"rows": _read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")}

        def baseline(state: durable.RunState) -> dict[str, DataFrame]:
            return {"baseline": state.tables["rows"].groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("mean"))}

        def report(state: durable.RunState) -> dict[str, DataFrame]:
            above = state.tables["rows"].join(state.tables["baseline"], "l_returnflag").where("l_extendedprice > mean")
            return {"report": above.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("above"))}

        def build(b: durable.GraphBuilder) -> None:
            b.phase("ingest", ingest, "baseline").phase("baseline", baseline, "prices")
            b.phase("prices", durable.make_gate_node(gate, lambda s: {"groups": s.tables["baseline"].count()}, recorder=trail.as_recorder()), "report")
            b.phase("report", report)

        return durable.compile_graph(build, store=durable.RunStore(spark, path), requires_store=True)

    durable.run(graph(), run_id=run_id)
    durable.resume(graph(), run_id=run_id, gate="prices", approved=True, reason="in range")
    return durable.RunStore(spark, path), run_id


def study_resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a parked and resumed run reports."""
    store, run_id = _parked_run(spark, sf_dir)
    return store.load(run_id)[2]["report"]


def study_run_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commits of that run, each with the rows of what it added."""
    store, run_id = _parked_run(spark, sf_dir)
    tables = store.load(run_id)[2]
    rows = [tables[t].select(F.lit(t).alias("added")) for t in ("rows", "baseline", "report")]
    sizes = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("added").agg(F.count("*").alias("n_rows"))
    commits = store.commits(run_id).withColumn("added", F.get(F.from_json("tables", "array<string>"), F.lit(0)))
    return commits.join(sizes, "added", "left").select("number", "phase", F.coalesce("next", F.lit("-")).alias("next_phase"), F.coalesce("parked", F.lit("-")).alias("parked"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


QUERIES["study_resumed_run"], QUERIES["study_run_commits"] = study_resumed_run, study_run_commits
_REPORT = "SELECT l_returnflag, l_linestatus, count(*) AS above FROM lineitem JOIN (SELECT l_returnflag, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1) USING (l_returnflag) WHERE l_extendedprice > mean GROUP BY 1, 2"
ORACLE_SQL["study_resumed_run"] = _REPORT
ORACLE_SQL["study_run_commits"] = f"""
SELECT 0::BIGINT AS number, 'ingest' AS phase, 'baseline' AS next_phase, '-' AS parked, (SELECT count(*) FROM lineitem) AS n_rows
UNION ALL SELECT 1, 'baseline', 'prices', '-', (SELECT count(DISTINCT l_returnflag) FROM lineitem)
UNION ALL SELECT 2, 'prices', 'prices', 'prices', 0 UNION ALL SELECT 3, 'prices', 'report', '-', 0
UNION ALL SELECT 4, 'report', '-', '-', (SELECT count(*) FROM ({_REPORT}))
"""


def _three(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three hypotheses: is the mean of a type above all; null and resampled values are means by user."""
    means = df.groupBy("event_type", "user_id").agg(F.avg("value").alias("value"))
    null = df.groupBy("user_id").agg(F.avg("value").alias("value")).crossJoin(df.select(F.col("event_type").alias("hypothesis_id")).distinct()).select("hypothesis_id", "value")
    observed = df.groupBy(F.col("event_type").alias("hypothesis_id")).agg(F.max("value").alias("value")).withColumn("direction", F.lit("greater"))
    return observed, null, means.select(F.col("event_type").alias("hypothesis_id"), "value")


@_query("events", """
WITH n AS (SELECT user_id, avg(value) AS v FROM events GROUP BY 1), o AS (SELECT event_type AS h, max(value) AS x FROM events GROUP BY 1), s AS (SELECT event_type AS h, user_id, avg(value) AS v FROM events GROUP BY ALL),
p AS (SELECT h, x, (count(*) FILTER (v >= x) + 1) / (count(*) + 1) AS p, (count(*) FILTER (v <= x) + 1) / (count(*) + 1) AS q FROM o, n GROUP BY ALL),
r AS (SELECT s.h, s.user_id, (count(*) FILTER (n.v >= s.v) + 1) / (count(*) + 1) AS p FROM s, n GROUP BY ALL), t AS (SELECT h, avg((p <= 0.05)::INT) AS stability FROM r GROUP BY h)
SELECT h AS hypothesis_id, x AS observed, round(p, 6) AS p_value, round(stability, 6) AS stability, CASE WHEN q <= 0.05 THEN 'contradicted' WHEN stability < 0.9 THEN 'indeterminate' WHEN p <= 0.05 THEN 'supported' ELSE 'indeterminate' END AS label FROM p JOIN t USING (h)
""")
def study_whole_corpus_verdicts(df: DataFrame) -> DataFrame:
    from tessera.study.methodology import whole_corpus_table

    return _r(whole_corpus_table(*_three(df)))
