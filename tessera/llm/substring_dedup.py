"""Removal of long repeated passages by compacted De Bruijn paths.

Every window of ``k`` consecutive words is an edge of a De Bruijn graph (its ends are (k-1)-mers). Edges are
never shuffled one by one. Each edge belongs to the bucket of its *minimizer*, the m-mer of least hash within it, and
consecutive edges of one bucket form a path that is compacted into one row: minimizer, hash of all its words,
source document and position. Equal passages break into equal paths, except at their ends.

Joins on those rows then do the work:

* a path that also lies in a document with a smaller id is repeated whole (nothing branches there);
* where a bucket holds different paths, they may share some edges only. Each distinct path of such a branching bucket is
  expanded once, from its source coordinates, into its edges; an edge found in a path from a smaller document is repeated.

Repeated edges cover words, and covered words are removed. The result is exact: an edge is repeated if and only if
its k words also start in a document with a smaller id, and both lie in the same bucket.

Defined results: null text has no words; texts shorter than k words lose nothing; repeats within one document, or among
rows of one doc_id, do not count; rows with a null doc_id neither lose nor witness anything; edges are judged on
the input, not on what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._names import free
from tessera.llm._text import Sequences, signed, slices, spans, word_hashes
from tessera.plans.scratch import Scratch, broadcast_if_small

#: Words of a window, and of a minimizer.
K, M = 50, 10
#: Rows that may be broadcast to meet the texts.
MOST_BROADCAST = 500_000
_POS = np.uint64((1 << 26) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, in log2(width) passes."""
    n, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n]) if span < width else x[:n]


def compact_paths(words: np.ndarray, first: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """Compacted paths of consecutive texts: text index, first edge (word of the text), edges, minimizer, hash of all words."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(words) < k:
        return none
    seq = Sequences(words)
    at = np.arange(len(words) - m + 1)
    mers = seq(at, at + m)
    least = _sliding_min((mers & ~_POS) | at.astype(np.uint64), k - m + 1) & _POS
    sizes = np.maximum(0, np.diff(first) - k + 1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    edge = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    here = edge + first[:-1][owner]
    if not len(here):
        return none
    mini = least[here]
    new = np.ones(len(here), bool)
    new[1:] = (mini[1:] != mini[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(here)))
    lo = here[begin]
    return owner[begin], edge[begin], count, mers[mini[begin].astype(np.int64)], seq(lo, lo + count - 1 + k)


def _whole(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    return signed(Sequences(words)(first[:-1], first[1:]))


def _paths(rows: DataFrame, k: int, m: int) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for t in slices(batch.column(1)):
                starts, ends, first = spans(t)
                words = word_hashes(t.data, starts, ends)
                owner, edge, count, mini, path = compact_paths(words, first, k, m)
                whole = _whole(words, first)
                columns = [ids.take(pa.array(owner + t.lo)), pa.array(whole[owner]), pa.array(signed(mini)), pa.array(signed(path)), pa.array(edge.astype(np.int32)), pa.array(count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "whole", "mini", "path", "start", "edges"])

    return rows.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, whole long, mini long, path long, start int, edges int")


def _expand(rows: DataFrame, k: int) -> DataFrame:
    """Edges of paths, from the texts they come from: ``mini, path, source, i, edge``."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2).to_pylist()
            for t in slices(batch.column(1)):
                starts, ends, first = spans(t)
                words = word_hashes(t.data, starts, ends)
                whole, seq = _whole(words, first), Sequences(words)
                mini, path, row, start, count = [], [], [], [], []
                for i in range(t.lo, t.hi):
                    for w in wanted[i]:
                        if w["whole"] == whole[i - t.lo]:  # else the path is of another row with this doc_id
                            mini.append(w["mini"])
                            path.append(w["path"])
                            row.append(i)
                            start.append(w["start"] + first[i - t.lo])
                            count.append(w["edges"])
                if not mini:
                    continue
                count = np.array(count)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                lo = np.repeat(np.array(start), count) + step
                edge = signed(seq(lo, lo + k))
                rep = lambda x: pa.array(np.repeat(np.array(x, np.int64), count))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [rep(mini), rep(path), batch.column(0).take(rep(row)), pa.array(step.astype(np.int32)), pa.array(edge)], ["mini", "path", "source", "i", "edge"]
                )

    return rows.select("doc_id", "text", "wanted").mapInArrow(run, f"mini long, path long, source {kind}, i int, edge long")


def repeated_spans(rows: DataFrame, scratch: Scratch, *, k: int = K, m: int = M) -> DataFrame:
    """``doc_id, spans``: merged word ranges (``whole, lo, hi``) of ``rows(doc_id, text)`` that repeat in smaller documents."""
    paths = scratch.table(_paths(rows, k, m), "paths")
    first = paths.groupBy("mini", "path").agg(F.min(F.struct("doc_id", "whole", "start", "edges")).alias("a"), F.max("doc_id").alias("last"))
    first = scratch.table(first.select("mini", "path", "a.*", "last"), "distinct")
    shared = first.where("last > doc_id").select("mini", "path", F.col("doc_id").alias("source"))
    full = paths.join(shared, ["mini", "path"]).where("doc_id > source").select("doc_id", "whole", F.col("start").alias("lo"), (F.col("start") + F.col("edges") - 1 + k).alias("hi"))
    # buckets that branch between documents
    branching = first.groupBy("mini").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("n > 1 and low < high").select("mini")
    open_paths = first.join(branching, "mini", "left_semi").select("doc_id", F.struct("whole", "mini", "path", "start", "edges").alias("w"))
    wanted = scratch.table(open_paths.groupBy("doc_id").agg(F.collect_list("w").alias("wanted")), "wanted")
    n = wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0]
    edges = scratch.table(_expand(rows.join(broadcast_if_small(wanted, n, MOST_BROADCAST), "doc_id"), k), "edges")
    low = edges.groupBy("mini", "edge").agg(F.min("source").alias("low"), F.max("source").alias("high")).where("low < high").select("mini", "edge", "low")
    part = edges.join(low, ["mini", "edge"]).where("low < source").groupBy("mini", "path", F.col("source").alias("doc_id")).agg(F.collect_list("i").alias("at"))
    partial = paths.join(part, ["mini", "path", "doc_id"]).select("doc_id", "whole", F.explode(F.transform("at", lambda i: i + F.col("start"))).alias("lo"))
    spans_ = full.unionByName(partial.select("doc_id", "whole", "lo", (F.col("lo") + k).alias("hi")))
    gathered = spans_.groupBy("doc_id").agg(F.collect_list(F.struct("whole", "lo", "hi")).alias("spans"))
    return scratch.table(_merged(gathered), "spans")


def _merged(gathered: DataFrame) -> DataFrame:
    """Each document's ranges in order, touching ones joined; one sort for each batch, however many ranges a document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            first, flat = lists.offsets.to_numpy(), lists.values
            whole, lo, hi = (flat.field(c).to_numpy()[first[0] : first[-1]].astype(np.int64) for c in ("whole", "lo", "hi"))
            owner = np.repeat(np.arange(len(batch)), np.diff(first))
            order = np.lexsort((lo, whole, owner))
            whole, lo, hi, owner = whole[order], lo[order], hi[order], owner[order]
            group = np.cumsum(np.append(0, (whole[1:] != whole[:-1]) | (owner[1:] != owner[:-1]))) << 32 if len(lo) else lo
            reach = np.maximum.accumulate(group + hi) if len(lo) else lo
            new = np.append(True, (group + lo)[1:] > reach[:-1])[: len(lo)]  # a new group starts beyond all reaches before it
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(lo)) - 1
            kept = pa.StructArray.from_arrays([pa.array(whole[begin]), pa.array(lo[begin].astype(np.int32)), pa.array((reach[end] - group[end]).astype(np.int32))], ["whole", "lo", "hi"])
            offsets = np.append(0, np.cumsum(np.bincount(owner[begin], minlength=len(batch))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), kept)], ["doc_id", "spans"])

    return gathered.mapInArrow(run, gathered.schema)


def _kept(text: bytes, mine: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """Words that stay and how many go."""
    words = text.split()  # splits at the six ASCII white-space bytes
    if not mine:
        return words, 0
    keep = np.ones(len(words), bool)
    for lo, hi in mine:
        keep[lo:hi] = False
    return [w for w, ok in zip(words, keep.tolist(), strict=True) if ok], int((~keep).sum())


def remove_repeats(docs: DataFrame, *, k: int = K, text: str = "text", doc_id: str = "doc_id", digest: bool = False, names: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """``docs`` without the words that repeat a passage of a smaller document, and with ``n_words, n_removed``.

    Texts that lose words are written with single spaces; others stay as they are. ``digest`` gives ``kept_sha256``, the
    hash of all kept words joined by single spaces, in place of the other columns. Columns that already have one of ``names``
    are replaced; any other column may have any name.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = repeated_spans(rows, scratch, k=k)
    scratch.drop("paths", "distinct", "wanted", "edges")
    n = found.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    own_id, own_spans = free(docs.columns, "__id", "__spans")
    found = found.select(F.col("doc_id").alias(own_id), F.col("spans").alias(own_spans))
    kept = [f for f in docs.schema.fields if f.name not in (*names, "kept_sha256") and (not digest or f.name == doc_id)]
    source = docs.select(*{doc_id: None, text: None}) if digest else docs.select(*(f.name for f in kept))
    joined = source.join(broadcast_if_small(found, n, MOST_BROADCAST), F.col(doc_id) == F.col(own_id), "left").drop(own_id)
    order = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_of = batch.column(own_spans).to_pylist()
            column, counts, gone, out = batch.column(text), [], [], []
            for t in slices(column):
                starts, ends, first = spans(t)
                counts += np.diff(first).tolist()
                whole = _whole(word_hashes(t.data, starts, ends), first) if any(spans_of[t.lo : t.hi]) else None
                for i in range(t.lo, t.hi):
                    mine = [(x["lo"], x["hi"]) for x in spans_of[i] or () if x["whole"] == whole[i - t.lo]]
                    if digest or mine:
                        words, removed = _kept(t.data[t.offsets[i - t.lo] : t.offsets[i - t.lo + 1]].tobytes(), mine)
                        joined_words = b" ".join(words)
                        out.append(hashlib.sha256(joined_words).hexdigest() if digest else joined_words.decode())
                    else:
                        removed = 0
                        out.append(column[i].as_py())
                    gone.append(removed)
            new = [pa.array(counts, pa.int64()), pa.array(gone, pa.int64())]
            if digest:
                yield pa.RecordBatch.from_arrays([batch.column(doc_id), *new, pa.array(out, pa.string())], ["doc_id", *names, "kept_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([*(pa.array(out, pa.string()) if x == text else batch.column(x) for x in order), *new], [*order, *names])

    schema = type(docs.schema)(kept).add(names[0], "long").add(names[1], "long")
    return joined.mapInArrow(run, schema.add("kept_sha256", "string") if digest else schema)
