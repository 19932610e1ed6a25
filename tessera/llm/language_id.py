"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order byte context tree: a context of up to ``ORDER`` bytes is a node if
it was seen often enough. At a node the seen symbols share ``n / (n + q)`` of the probability (``n``
occurrences, ``q`` distinct symbols) and ``q / (n + q)`` escapes to the context shortened by its oldest byte,
whose distribution is renormalised over the symbols not seen here (exclusion). Below order 0 all 256
bytes are equally likely. Contexts that a language never saw are skipped without an escape. Statistics
are frozen after training, so the code length of a byte depends only on the bytes before it; the
trees of all languages compile into one table of code lengths and a text is scored, whole, by
gathers.

Defined results: ``und`` with score 0 for null or empty text, text without a letter, or where no
language was learned; ties go to the first language in sorted order; training rows with null text
or language are not used; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._text import slices

#: Bytes of context at most.
ORDER = 3
#: Training rows per language at most; drawn by a hash of the row, so any run draws the same ones.
SAMPLE_ROWS = 400
#: Occurrences that make a context a node, and nodes of all trees at most.
LEAST, MOST_NODES = 6, 9_000
#: Bits a byte above which the pipeline takes a text for no learned language: the best model codes it worse than plain bytes.
MOST_BITS = 8.0

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def held_out(doc_id: str = "doc_id") -> Column:
    """The test fold: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


@dataclass
class PpmModel:
    """Compiled trees. ``deep`` maps the last three symbol classes to a node, ``bits`` a node and class to code lengths."""

    languages: list[str]
    classes: np.ndarray = field(default_factory=lambda: np.zeros(256, np.uint8))
    width: int = 1
    deep: np.ndarray = field(default_factory=lambda: np.zeros(8, np.int32))
    bits: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.float32))

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Exact code length in bits of each text (rows) under each language (columns)."""
        n, wide = len(data), self.width + 1
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not n or not self.languages:
            return out
        symbol = self.classes[data].astype(np.int32)
        heads = offsets[:-1][offsets[:-1] < n]
        context, last = np.zeros(n, np.int32), symbol
        for power in (wide * wide, wide, 1):  # the byte before counts most
            shifted = np.empty(n, np.int32)
            shifted[1:] = last[:-1]
            shifted[heads] = self.width  # no byte there
            context += shifted * np.int32(power)
            last = shifted
        cell = self.deep[context]
        cell *= np.int32(self.width)
        cell += symbol
        for k in range(len(self.languages)):
            total = np.zeros(n + 1)
            np.cumsum(self.bits[k][cell], dtype=np.float64, out=total[1:])
            out[:, k] = total[offsets[1:]] - total[offsets[:-1]]
        return out


def compile_model(counts: list[tuple[str, bytes, int, int]], *, least: int = LEAST, most_nodes: int = MOST_NODES) -> PpmModel:
    """A model from rows (language, context bytes, next byte, occurrences)."""
    languages = sorted({r[0] for r in counts})
    if not languages:
        return PpmModel([])
    seen = sorted({r[2] for r in counts})
    width = len(seen) + 1  # the last class is any byte never seen
    classes = np.full(256, width - 1, np.uint8)
    classes[seen] = np.arange(len(seen))
    copies = np.ones(width)
    copies[-1] = 256 - len(seen)
    trees: list[dict[bytes, np.ndarray]] = [{} for _ in languages]
    index = {x: k for k, x in enumerate(languages)}
    for language, context, symbol, times in counts:
        tree = trees[index[language]]
        if context not in tree:
            tree[context] = np.zeros(width)
        tree[context][classes[symbol]] += times
    weight: dict[bytes, float] = {}
    for tree in trees:
        for context, row in tree.items():
            weight[context] = max(weight.get(context, 0), row.sum())
    nodes = [b""] + sorted((c for c in weight if c and weight[c] >= least), key=lambda c: (-weight[c], c))[: most_nodes - 1]
    wanted = set(nodes)
    nodes = sorted((c for c in wanted if all(c[i:] in wanted for i in range(len(c)))), key=lambda c: (len(c), c))
    number = {c: i for i, c in enumerate(nodes)}
    bits = np.empty((len(languages), len(nodes) * width), np.float32)
    for k, tree in enumerate(trees):
        chance = np.empty((len(nodes), width))
        for i, context in enumerate(nodes):
            lower = chance[number[context[1:]]] if context else copies / 256
            row = tree.get(context)
            if row is None or row.sum() < (least if context else 1):
                chance[i] = lower
                continue
            here = row > 0
            n, q = row.sum(), here.sum()
            rest = lower[~here].sum()
            chance[i] = row / (n + q) if rest > 0 else row / n
            if rest > 0:
                chance[i, ~here] = q / (n + q) * lower[~here] / rest
        bits[k] = -np.log2(chance / copies).astype(np.float32).ravel()
    wide = width + 1
    deep = np.zeros((wide, wide, wide), np.int32)  # the last byte first
    for context, i in number.items():  # shorter ones first, so that deeper ones win
        at = tuple(int(classes[b]) for b in reversed(context))
        deep[at] = i
    return PpmModel(languages, classes, width, deep.ravel(), bits)


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of (language, context of 0 to ORDER bytes, next byte) in each batch."""
    for batch in batches:
        rows: dict[str, list[bytes]] = {}
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows.setdefault(language, []).append(text.encode())
        for language, texts in rows.items():
            gathered: list[np.ndarray] = []
            for text in texts:
                data = np.frombuffer(text, np.uint8).astype(np.int64)
                code = data + 256 * 0
                gathered.append(code)
                for order in range(1, ORDER + 1):
                    if len(data) <= order:
                        break
                    code = data[order:].copy()
                    for back in range(1, order + 1):
                        code += data[order - back : len(data) - back] << (8 * back)
                    gathered.append(code + (order << 40))
            codes, times = np.unique(np.concatenate(gathered), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(codes)), pa.array(codes), pa.array(times.astype(np.int64))], ["language", "code", "times"]
            )


def fit(labelled: DataFrame, *, text: str = "text", language: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> PpmModel:
    """Learn from about ``sample_rows`` whole texts of each language, all of them where it has fewer.

    Rows are drawn by the hash of ``key`` against a share per language that follows from its count, so the
    sample is bounded, spread over all rows and independent of partitioning. Context counts are summed by Spark.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(language).isNotNull() & (F.length(text) > 0))
    rows = rows.select(F.col(language).alias("language"), F.col(text).alias("text"), (F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)).alias("draw"))
    sizes = {r[0]: r[1] for r in rows.groupBy("language").count().collect()}
    if not sizes:
        return PpmModel([])
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, sample_rows / n))])
    drawn = rows.where(F.col("draw") < F.element_at(share, F.col("language"))).select("language", "text")
    counted = (
        drawn.mapInArrow(_count_contexts, "language string, code long, times long")
        .groupBy("language", "code")
        .agg(F.sum("times").alias("times"))
        .withColumn("seen", F.sum("times").over(_context_window()))
        .where((F.col("seen") >= LEAST) | (F.shiftright("code", 40) == 0))
        .select("language", "code", "times")
        .toPandas()
    )
    counts = []
    for name, code, times in counted.itertuples(index=False):
        order = code >> 40
        context = bytes((code >> (8 * back)) & 255 for back in range(order, 0, -1))
        counts.append((name, context, code & 255, times))
    return compile_model(counts)


def _context_window():
    from pyspark.sql import Window

    return Window.partitionBy("language", F.shiftright("code", 8))


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTER[data], out=total[1:])
    found = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~found):
        if offsets[i + 1] > offsets[i]:
            found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def predict(docs: DataFrame, model: PpmModel, *, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """``docs`` with the predicted language, its posterior under equal priors, and the best code's bits per byte.

    Columns that already have one of these names are replaced. ``bits_per_byte`` is null for ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in names]
    order = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            label, score, rate = [], [], []
            for t in slices(batch.column(text)):
                size = np.diff(t.offsets)
                lengths = m.code_lengths(t.data, t.offsets)
                usable = _has_letter(t.data, t.offsets) if m.languages else np.zeros(len(size), bool)
                best = lengths.argmin(1) if m.languages else np.zeros(len(size), int)
                for i, ok in enumerate(usable):
                    if not ok:
                        label.append("und")
                        score.append(0.0)
                        rate.append(None)
                        continue
                    gap = lengths[i] - lengths[i, best[i]]
                    label.append(m.languages[best[i]])
                    score.append(float(1 / np.exp2(-np.minimum(gap, 1000)).sum()))
                    rate.append(float(lengths[i, best[i]] / size[i]))
            new = [pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in order), *new], [*order, *names])

    schema = type(docs.schema)(kept).add(names[0], "string").add(names[1], "double").add(names[2], "double")
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document, learned from the rows that are not held out."""
    model = fit(docs.where(~held_out()), sample_rows=sample_rows)
    found = predict(docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")
