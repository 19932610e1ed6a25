"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

One weight per word is shared by all thresholds: ``P(grade > k) = sigmoid(x . w - cut_k)`` with ascending
cuts. ``x`` marks which words a text holds (presence, so a long text is not worse than a short one for
its length alone), and weights are not negative: a text without any of the words is never worse than another. Words are chosen by proximal gradient steps with an L1 penalty, and the few that are chosen are fitted again
without it. The score is the expected severity, ``sum_k P(grade > k)``.

The model is fitted on a bounded sample of labelled rows, of which those with the same grade and the same set of words count once, and
on a bounded number of words (``SAMPLE_TOXIC``, ``SAMPLE_CLEAN``, ``FEATURES``); every text is scored whole.

Defined results: null or empty text has no words and gets the base rates of the cuts; without labels
nothing is toxic (severity 0); labels without a document, and null labels, are not used; repeated rows
are scored each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._text import Texts, signed, slices, spans, word_hashes
from tessera.plans.scratch import Scratch

#: Labelled rows used for fitting, at most this many of toxic and of other ones.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3_000, 6_000
#: Words kept by screening, and the rows that must hold a word.
FEATURES, LEAST_ROWS = 2_048, 3
#: Penalties on the sum of absolute weights that are tried, the ridge of the final fit, and gradient steps.
PENALTIES, RIDGE, STEPS = (0.03, 0.01, 0.003, 0.001), 5e-5, 150
#: Least distance of two cuts.
GAP = 0.05
#: Highest derived grade.
TOP_GRADE = 3

#: Words are runs of ASCII letters and digits and of all other non-ASCII bytes.
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = False
_BREAK[128:] = False


def _words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z folded) and each text's first word."""
    starts, ends, first = spans(texts, _BREAK)
    return signed(word_hashes(texts.data, starts, ends, lower=True)), first


@dataclass
class OrdinalModel:
    """Sorted word hashes with their shared weights, ascending cuts between grades, and the P(grade > 0) from which a text counts as toxic."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    decide: float = 0.5

    def linear(self, texts: Texts) -> np.ndarray:
        """``x . w`` of each text."""
        n = len(texts.offsets) - 1
        if not len(self.words):
            return np.zeros(n)
        words, first = _words(texts)
        at = np.searchsorted(self.words, words)
        at[at == len(self.words)] = 0
        hit = np.flatnonzero(self.words[at] == words)
        text = np.searchsorted(first, hit, "right") - 1
        held = np.unique(text * len(self.words) + at[hit])  # presence: each word once in each text
        return np.bincount(held // len(self.words), self.weights[held % len(self.words)], n)

    def above(self, linear: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and cut."""
        return _sigmoid(linear[:, None] - self.cuts[None, :])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t in slices(batch.column(1)):
            words, first = _words(t)
            out += [np.unique(words[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["grade", "words"])


def screen(sample: DataFrame, n1: int, n0: int, *, features: int = FEATURES, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The words of ``sample(grade, words)`` that are most more frequent in positive rows than in other ones.

    ``word, a, total``: rows that hold it, positive and all; the greatest signed z of the two shares come first, because a
    word that is rarer in positive rows may get no weight and must not take another's place.
    """
    counts = sample.select((F.col("grade") > 0).cast("long").alias("y"), F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("total"))
    pooled = (F.col("total") + 1) / (n1 + n0 + 2)
    z = (F.col("a") / max(1, n1) - (F.col("total") - F.col("a")) / max(1, n0)) / F.sqrt(pooled * (1 - pooled))
    return counts.where(F.col("total") >= least_rows).orderBy(z.desc(), "word").limit(features)


@dataclass
class _Sets:
    """Rows as word indexes, flat, with the row of each."""

    at: np.ndarray
    owner: np.ndarray
    rows: int

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> _Sets:
        return cls(np.concatenate([np.zeros(0, np.int64), *rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows))

    def only(self, words: np.ndarray) -> _Sets:
        keep = words[self.at]
        return _Sets(self.at[keep], self.owner[keep], self.rows)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights[self.at], self.rows)


def _ascending(cuts: np.ndarray) -> np.ndarray:
    """Cuts at least ``GAP`` apart, so that every grade keeps some probability."""
    at = np.arange(len(cuts)) * GAP
    return np.maximum.accumulate(cuts - at) + at


def _steepness(x: _Sets, m: int) -> float:
    """Greatest eigenvalue of X'X / n, by power iteration."""
    v = np.ones(m) / max(1.0, m**0.5)
    value = 0.0
    for _ in range(20):
        w = np.bincount(x.at, x.times(v)[x.owner], m) / max(1, x.rows)
        value = float(np.linalg.norm(w))
        if not value:
            break
        v = w / value
    return value


def _solve(x: _Sets, grades: np.ndarray, m: int, top: int, l1: float, l2: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts by accelerated proximal gradient (with restarts) on the cumulative-link likelihood."""
    n = x.rows
    weights, cuts = np.zeros(m), np.zeros(top)
    for k in range(top):
        p = np.clip((grades > k).mean(), 1e-3, 1 - 1e-3)
        cuts[k] = np.log((1 - p) / p)
    cuts = _ascending(cuts)
    step = 1 / (0.3 * (_steepness(x, m) + 2) + l2)
    ahead_w, ahead_c, t = weights, cuts, 1.0
    low, high = grades > 0, grades < top
    for _ in range(steps):
        eta = x.times(ahead_w)
        # P(grade) = sigmoid(upper - eta) - sigmoid(lower - eta)
        upper = np.clip(ahead_c[np.minimum(grades, top - 1)] - eta, -30, 30)
        lower = np.clip(ahead_c[np.maximum(grades - 1, 0)] - eta, -30, 30)
        su, sl = np.where(high, _sigmoid(upper), 1.0), np.where(low, _sigmoid(lower), 0.0)
        p = np.maximum(su - sl, 1e-15)
        du, dl = np.minimum(su * (1 - su) / p, 1 / GAP), np.minimum(sl * (1 - sl) / p, 1 / GAP)
        g_cut = np.zeros(top)
        np.add.at(g_cut, grades[high], -du[high] / n)
        np.add.at(g_cut, grades[low] - 1, dl[low] / n)
        new_w = ahead_w - step * (np.bincount(x.at, ((du - dl) / n)[x.owner], m) + l2 * ahead_w)
        new_w = np.maximum(new_w - step * l1, 0)  # words add to severity or say nothing
        new_c = _ascending(ahead_c - step * g_cut)
        if (ahead_w - new_w) @ (new_w - weights) + (ahead_c - new_c) @ (new_c - cuts) > 0:
            t = 1.0  # the momentum points uphill
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w = new_w + (t - 1) / t2 * (new_w - weights)
        ahead_c = _ascending(new_c + (t - 1) / t2 * (new_c - cuts))
        weights, cuts, t = new_w, new_c, t2
    return weights, cuts


def _relaxed(x: _Sets, grades: np.ndarray, m: int, top: int, l1: float, markers: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Choose words under the penalty ``l1``; fit them and the markers again with a light ridge, so that weights are shared, not shrunk."""
    chosen = (_solve(x, grades, m, top, l1, 0.0, steps)[0] != 0) | markers
    return _solve(x.only(chosen), grades, m, top, 0.0, RIDGE, 2 * steps)


def _decision(p: np.ndarray, y: np.ndarray) -> float:
    """The probability, 0.5 at most, that parts held-out rows with the least sum of both error shares (midway between its neighbours)."""
    at = np.unique(np.append(p[p <= 0.5], 0.5))
    error = [(p[y] < c).mean() + ((p[~y] >= c).mean() if (~y).any() else 0) for c in at]
    k = len(at) - 1 - int(np.argmin(error[::-1]))
    below = p[p < at[k]]
    return float((at[k] + below.max()) / 2) if len(below) else float(at[k])


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, words: np.ndarray, *, markers: np.ndarray | None = None, penalties: tuple[float, ...] = PENALTIES, steps: int = STEPS) -> OrdinalModel:
    """Fit to word sets (indexes of ``words``) and grades 0, 1, ...; the penalty is the one that loses least on every fifth row.

    ``markers`` are words that are used whatever the penalty.
    """
    top = int(grades.max()) if len(grades) else 0
    if top < 1:
        return OrdinalModel()
    m = len(words)
    markers = np.zeros(m, bool) if markers is None else markers
    test = np.arange(len(rows)) % 5 == 0
    best, penalty, decide = np.inf, penalties[0], 0.5
    if (grades[~test] > 0).any() and (grades[test] > 0).any():
        learn = _Sets.of([r for r, held in zip(rows, test, strict=True) if not held])
        check = _Sets.of([r for r, held in zip(rows, test, strict=True) if held])
        y = grades[test] > 0
        for l1 in penalties:
            weights, cuts = _relaxed(learn, np.minimum(grades[~test], top), m, top, l1, markers, steps)
            p = np.clip(_sigmoid(check.times(weights) - cuts[0]), 1e-4, 1 - 1e-4)
            loss = -np.log(p[y]).mean() - (np.log(1 - p[~y]).mean() if (~y).any() else 0)
            if loss < best - 1e-3:
                best, penalty, decide = loss, l1, _decision(p, y)
    weights, cuts = _relaxed(_Sets.of(rows), grades, m, top, penalty, markers, steps)
    used = weights != 0
    bare = float(_sigmoid(-cuts[:1])[0])  # of a text that holds none of the words: never toxic
    return OrdinalModel(words[used], weights[used], cuts, max(decide, bare + 1e-6))


def derived_grades(rows: list[np.ndarray], toxic: np.ndarray, markers: np.ndarray, top: int = TOP_GRADE) -> np.ndarray:
    """Ordered grades where labels only say toxic or not.

    0 is not toxic; a toxic row is graded 1 to ``top`` by how many distinct marker words it holds (1 or none, 2 to
    3, 4 or more). ``markers`` tells which words are; see ``fit``.
    """
    held = np.array([int(markers[r].sum()) for r in rows], np.int64)
    return np.where(toxic, np.minimum(top, 1 + (held >= 2) + (held >= 4)), 0)


def fit(docs: DataFrame, labels: DataFrame, *, grade: str | None = None, text: str = "text", sample: tuple[int, int] = (SAMPLE_TOXIC, SAMPLE_CLEAN)) -> OrdinalModel:
    """Fit on labelled documents: ``labels(doc_id, toxic)``, or ``labels(doc_id, <grade>)`` with whole-number grades.

    At most about ``sample`` rows (positive, other) are drawn by the hash of ``doc_id`` over all labels; only they are
    joined to their texts.
    """
    value = F.col(grade or "toxic").cast("long")
    rows = labels.select("doc_id", value.alias("grade")).where("doc_id is not null and grade is not null and grade >= 0").dropDuplicates(["doc_id"])
    rows = rows.withColumn("draw", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1 << 30)) / float(1 << 30))
    n = {r[0]: r[1] for r in rows.groupBy((F.col("grade") > 0).alias("positive")).count().collect()}
    share = [min(1.0, sample[0] / max(1, n.get(True, 0))), min(1.0, sample[1] / max(1, n.get(False, 0)))]
    drawn = rows.where(F.col("draw") < F.when(F.col("grade") > 0, share[0]).otherwise(share[1])).select("doc_id", "grade")
    # the sample is bounded by its parameter, so its ids can go to every executor
    texts = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(drawn), "doc_id").select("grade", "text")
    scratch = Scratch(docs.sparkSession, "toxicity")
    held = texts.mapInArrow(_distinct_words, "grade long, words array<long>")
    # copies of one text would vouch for all of its words: of sampled rows with the same grade and the same words one stays
    held = scratch.table(held.dropDuplicates(["grade", "words"]), "sample")
    n = {r[0]: r[1] for r in held.groupBy((F.col("grade") > 0).alias("positive")).count().collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    chosen = sorted(tuple(r) for r in screen(held, n1, n0).collect())
    words = np.array([r[0] for r in chosen], np.int64)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.flatnonzero(np.isin(words, np.asarray(r, np.int64))).astype(np.int32) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["grade", "words"])

    got = held.mapInArrow(index, "grade long, words array<int>").toPandas()
    scratch.drop("sample")
    sets = [np.asarray(w, np.int64) for w in got["words"]]
    grades = got["grade"].to_numpy(np.int64)
    # an order that follows from the rows alone, and spreads grades over the folds
    order = sorted(range(len(sets)), key=lambda i: (hashlib.md5(sets[i].tobytes()).digest(), grades[i]))
    sets, grades = [sets[i] for i in order], grades[order]
    # a marker is a word in at least 1 % of the positive rows that is ten times as frequent there, beyond chance
    a, total = np.array([r[1:] for r in chosen], float).reshape(-1, 2).T
    share = (total + 1) / (n1 + n0 + 2)
    z = (a / max(1, n1) - (total - a) / max(1, n0)) / np.sqrt(share * (1 - share) * (1 / max(1, n1) + 1 / max(1, n0)))
    markers = (a >= max(3, 0.01 * n1)) & (a / max(1, n1) > 10 * (total - a) / max(1, n0)) & (z > 4)
    if grade is None and len(sets):
        grades = derived_grades(sets, grades > 0, markers)
    return fit_ordinal(sets, grades, words, markers=markers)


def predict(docs: DataFrame, model: OrdinalModel, *, text: str = "text", names: tuple[str, str, str] = ("expected_severity", "severity", "toxic"), cut: float | None = None) -> DataFrame:
    """``docs`` with expected severity, most probable grade, and whether P(grade > 0) reaches ``cut`` (the model's own unless given).

    Columns that already have one of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in names]
    order = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            linear = np.concatenate([np.zeros(0), *[m.linear(t) for t in slices(batch.column(text))]])
            above = m.above(linear)
            full = np.concatenate([np.ones((len(linear), 1)), above, np.zeros((len(linear), 1))], 1)
            grade = (full[:, :-1] - full[:, 1:]).argmax(1)
            toxic = above[:, 0] >= (m.decide if cut is None else cut) if above.shape[1] else np.zeros(len(linear), bool)
            new = [pa.array(above.sum(1)), pa.array(grade.astype(np.int32)), pa.array(toxic)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in order), *new], [*order, *names])

    schema = type(docs.schema)(kept).add(names[0], "double").add(names[1], "integer").add(names[2], "boolean")
    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, expected_severity, severity, toxic`` for every document."""
    return predict(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
