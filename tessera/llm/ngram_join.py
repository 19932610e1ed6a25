"""Exact self-join of documents by Jaccard similarity of word n-grams, over a token-group matrix.

A document is the set of hashes of its n-grams. Two sets Q and S with ``J(Q, S) >= t`` differ in at most
``d = floor((|Q| + |S|)(1 - t) / (1 + t))`` elements. The hash range is cut into k > d equal segments; what a
set holds of one segment is one *token* of the matrix, and such a pair has at least ``k - d`` tokens in common. Set
sizes fall in bands so that k is the same for every pair that could link: band i spans sizes ``lo`` to ``lo / t``, and a
document has tokens for its own band and for the one below.

1. Equal sets collapse to one; the rest of the work is on distinct sets.
2. Tokens that only one set holds are useless. A set needs ``r = max(1, k - empty - d)`` tokens in common with any
   partner, so a set with fewer than r shared tokens is done, and its ``r - 1`` most widely shared tokens need not find candidates.
3. Similar sets are put in groups (by the most widely shared token they hold); large groups are dealt into blocks of bounded
   size. Each block links its members, and each member of a large group is compared with the group's pilots, the few
   members whose tokens are held most widely. So a group of f near copies becomes few components at a cost of O(f).
4. The matrix holds the union of the tokens of each group. A query's candidate groups are those that share a token which
   may find candidates, seen from the side of the fewer: under each token, sets of the component that holds it most are never queries,
   for among themselves they are connected already. The number of a query's tokens in a group's union bounds its overlap with any
   member; only groups that reach r are opened, but for their blocks of the query's own component, and there the exact overlap with
   each member of another component decides.
5. Links give connected components.

Nothing is dropped or capped: skipped tokens cannot hide a pair (the rarest of the r common tokens is kept on both
sides), blocks and their salts only bound memory, and skipped pairs are connected already. Sets that share r tokens
without being linked, directly or through others, have to be compared; many such in one group cost the square of their number over
the size of a block.

Defined results: null or empty text has an empty set, which links with nothing and is its own component; fewer words than
n make one shingle of the whole sequence; equal rows and repeated or null doc_ids each keep their row, and a null doc_id names a
component only if all of its rows have none; other columns, whatever
their names, are not read; an empty table gives an empty result. Hashes have 64 bits, names of sets 128.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._text import Sequences, U, mix, signed, slices, spans, word_hashes
from tessera.operators.components import connected_components
from tessera.plans.scratch import Scratch, broadcast_if_small

#: Members and n-grams of a block of a group, about; queries that one copy of a block answers, about.
BLOCK_SETS, BLOCK_GRAMS, BLOCK_QUERIES = 256, 200_000, 256
#: Tokens in one batch that goes back to Spark, about.
TOKENS_AT_ONCE = 1 << 16
#: Members of a large group that all others are compared with.
PILOTS = 32
#: Ids that may be broadcast to pick the texts of candidate sets.
MOST_BROADCAST = 1_000_000


class Bands:
    """Size bands and segment counts for one threshold."""

    def __init__(self, threshold: float):
        self.t = Fraction(str(threshold))

    @lru_cache(maxsize=None)  # noqa: B019
    def band(self, i: int) -> tuple[int, int]:
        """Least and greatest size of band i."""
        lo = 1 if i == 0 else self.band(i - 1)[1] + 1
        return lo, int(lo / self.t)

    def of(self, n: int) -> int:
        i = 0
        while self.band(i)[1] < n:
            i += 1
        return i

    @lru_cache(maxsize=None)  # noqa: B019
    def differ(self, i: int) -> int:
        """Elements in which a linked pair within band i, or of bands i and i + 1, can differ at most."""
        hi = self.band(i)[1]
        return int((hi + int(hi / self.t)) * (1 - self.t) / (1 + self.t))

    @lru_cache(maxsize=None)  # noqa: B019
    def segments(self, i: int) -> int:
        """d + 1, room for empty segments, and a tenth of d to spare, so that widely shared tokens can be skipped."""
        d, lo = self.differ(i), self.band(i)[0]
        k = d + 1
        empty = k * float(np.exp(-lo / k))
        return k + (int(np.ceil(empty + 3 * empty**0.5)) + d // 10 + 1 if d else 0)


_BANDS: dict[float, Bands] = {}


def _bands(threshold: float) -> Bands:
    return _BANDS.setdefault(threshold, Bands(threshold))


@lru_cache(maxsize=4096)
def _edges(k: int) -> np.ndarray:
    """Inner borders of k equal segments of the hash range."""
    return np.array([(j << 64) // k for j in range(1, k)], np.uint64)


def tokens_of(grams: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix tokens of one sorted gram set: keys, the band space of each, and how many each must share (r).

    Tokens of empty segments are left out where r stays positive without them.
    """
    n = len(grams)
    own = bands.of(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(grams), out=total[1:])
    keys, spaces, needs = [], [], []
    for space in (own, own - 1):
        if space < 0:
            continue
        k, d = bands.segments(space), bands.differ(space)
        at = np.concatenate([[0], np.searchsorted(grams, _edges(k)), [n]])
        key = mix(mix(total[at[1:]] - total[at[:-1]]) + (np.arange(k, dtype=np.uint64) + U(space << 32)) * U(0x9E3779B97F4A7C15))
        filled = at[1:] > at[:-1]
        need = k - int((~filled).sum()) - d
        if need >= 1:
            key = key[filled]
        keys.append(key)
        spaces.append(np.full(len(key), space, np.int16))
        needs.append(np.full(len(key), max(1, need), np.int32))
    return np.concatenate(keys), np.concatenate(spaces), np.concatenate(needs)


def gram_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text of a column (A-Z folded)."""
    for texts in slices(column):
        starts, ends, first = spans(texts)
        words = word_hashes(texts.data, starts, ends, lower=True)
        seq = Sequences(words)
        lo = np.arange(max(0, len(words) - n + 1))
        grams = seq(lo, lo + n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield seq(np.array([a]), np.array([b]))
            else:
                yield np.zeros(0, np.uint64)


def _name(grams: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    return np.array([mix(grams).sum(), mix(grams ^ U(0x5851F42D4C957F2D)).sum() + U(len(grams))], np.uint64).tobytes()


def _describe(docs: DataFrame, n: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``row, doc_id, n_grams, name, half`` (the name's first 64 bits) and the columns in ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40  # the output is written before it is used, so row numbers hold
        for batch in batches:
            sets = [(len(grams), _name(grams) if len(grams) else None) for grams in gram_sets(batch.column(1), n)]
            names = [name for _, name in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at, at + len(batch))), batch.column(0), pa.array([size for size, _ in sets], pa.int64()), pa.array(names, pa.binary()), pa.array([_half(x) for x in names], pa.int64()), *batch.columns[2:]],
                ["row", "doc_id", "n_grams", "name", "half", *keep],
            )
            at += len(batch)

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("doc_id", "text", *keep).mapInArrow(run, f"row long, doc_id {kind}, n_grams long, name binary, half long{more}")


def _half(name: bytes | None) -> int | None:
    return None if name is None else int.from_bytes(name[:8], "little", signed=True)


def _tokens(texts: DataFrame, n: int, bands: Bands) -> DataFrame:
    """``half, key, space, need``: the matrix tokens of the set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            held = 0
            for grams in gram_sets(batch.column(0), n):
                if len(grams):
                    key, space, need = tokens_of(grams, bands)
                    parts.append((np.full(len(key), _half(_name(grams))), signed(key), space, need))
                    held += len(key)
                if held > TOKENS_AT_ONCE:
                    yield _columns(parts)
                    parts, held = [], 0
            if parts:
                yield _columns(parts)

    return texts.select("text").mapInArrow(run, "half long, key long, space short, need int")


def _columns(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["half", "key", "space", "need"])


def _grams(texts: DataFrame, n: int) -> DataFrame:
    """``name, grams`` of the set of each text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [g for g in gram_sets(batch.column(0), n) if len(g)]
            yield pa.RecordBatch.from_arrays([pa.array([_name(g) for g in found], pa.binary()), pa.array([signed(g) for g in found], pa.list_(pa.int64()))], ["name", "grams"])

    return texts.select("text").mapInArrow(run, "name binary, grams array<long>")


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a and b| >= num * |a or b| for sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if den * len(a) < num * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return den * common >= num * (len(a) + len(b) - common)


class _Block:
    """The members of one block, which queries are compared with."""

    def __init__(self, bands: Bands):
        self.bands, self.num, self.den = bands, bands.t.numerator, bands.t.denominator
        self.sets: list[int] = []
        self.grams: list[np.ndarray] = []
        self.parent: list[int] = []
        self.first: dict[int, int] = {}  # of each component the first member
        self.holders: dict[int, array] = {}

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def partners(self, grams: np.ndarray, keys: np.ndarray, spaces: np.ndarray, needs: np.ndarray, component: int) -> list[int]:
        """Members linked with a set, one at least of each of their components but the set's own."""
        home = self.first.get(component)
        done = set() if home is None else {self.root(home)}
        out = []
        for space in np.unique(spaces):
            of = spaces == space
            lists = [x for x in map(self.holders.get, keys[of].tolist()) if x]
            if not lists:
                continue
            shared = np.bincount(np.concatenate([np.frombuffer(x, np.int32) for x in lists]), minlength=len(self.sets))
            enough = np.flatnonzero(shared >= int(needs[of][0]))
            for i in enough[np.argsort(-shared[enough], kind="stable")].tolist():
                r = self.root(i)
                if r not in done and _linked(grams, self.grams[i], self.num, self.den):
                    done.add(r)
                    out.append(i)
        return out

    def ask(self, grams: np.ndarray, component: int) -> list[int]:
        """Members that a query is linked with."""
        return [self.sets[i] for i in self.partners(grams, *tokens_of(grams, self.bands), component)]

    def add(self, name: int, grams: np.ndarray, component: int, link: bool) -> list[int]:
        """Take in a member; with ``link``, members it is linked with."""
        i, tokens = len(self.sets), tokens_of(grams, self.bands)
        found = self.partners(grams, *tokens, component) if link else []
        self.sets.append(name)
        self.grams.append(grams)
        self.parent.append(self.first.setdefault(component, i))
        for j in found:
            self.parent[self.root(i)] = self.root(j)
        for key in tokens[0].tolist():
            if key not in self.holders:
                self.holders[key] = array("i")
            self.holders[key].append(i)
        return [self.sets[j] for j in found]


def _open_blocks(rows: DataFrame, bands: Bands, link: bool) -> DataFrame:
    """Links between the queries and the members of each block, and with ``link`` among its members: ``u, v`` (sets).

    Rows ``block, salt, query, set, component, grams`` come sorted by block and salt, members first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block = None, None
        for batch in batches:
            u, v = [], []
            flat = batch.column("grams")
            first, values = flat.offsets.to_numpy(), flat.values.to_numpy().view(np.uint64)
            columns = [batch.column(c).to_pylist() for c in ("block", "salt", "query", "set", "component")]
            for i, (group, salt, query, name, component) in enumerate(zip(*columns, strict=True)):
                grams = values[first[i] : first[i + 1]].copy()
                if (group, salt) != current:
                    current, block = (group, salt), _Block(bands)
                for other in block.ask(grams, component) if query else block.add(name, grams, component, link):
                    u.append(name)
                    v.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.select("block", "salt", "query", "set", "component", "grams").mapInArrow(run, "u long, v long")


def text_key(text: str) -> Column:
    """16 bytes that name a text; none for null."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def similar_documents(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Links are pairs whose sets of n-word shingles have Jaccard similarity of at least ``threshold``, tested in whole
    numbers; ``component_id`` is the smallest doc_id reachable by links, the row's own included.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = _linked_rows(rows, n, threshold)
    return found.select("doc_id", F.col("n_grams").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def similar_rows(docs: DataFrame, *, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``doc_id, key, component`` for every row of ``docs(doc_id, text)``: ``text_key`` and a number of what its links reach.

    Rows without words have a null component. Equal texts always have the same one, whatever their doc_ids.
    """
    rows = docs.select("doc_id", "text", text_key("text").alias("key"))
    return _linked_rows(rows, n, threshold, ("key",)).select("doc_id", "key", "component")


class _Sources:
    """Texts of the rows that stand for sets, fetched from the rows by doc_id.

    A doc_id that is null or comes more than once names no single row; the distinct texts under such ids are always taken along.
    """

    def __init__(self, rows: DataFrame, base: DataFrame, scratch: Scratch):
        self.rows = rows
        self.loose = scratch.table(base.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "loose")
        self.n_loose = self.loose.count()

    def _small(self, ids: DataFrame) -> DataFrame:
        return broadcast_if_small(ids, ids.count(), MOST_BROADCAST)

    def _with_loose(self, texts: DataFrame) -> DataFrame:
        if not self.n_loose:
            return texts
        named = self.rows.alias("a").join(self._small(self.loose).alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left_semi")
        return texts.unionByName(named.select("text").where("text is not null").distinct())

    def but(self, ids: DataFrame) -> DataFrame:
        """Texts of all rows but those with these doc_ids."""
        out = self.loose.where("doc_id is not null").unionByName(ids.where("doc_id is not null")).distinct()
        return self._with_loose(self.rows.where("doc_id is not null").join(self._small(out), "doc_id", "left_anti").select("text"))

    def of(self, ids: DataFrame) -> DataFrame:
        """Texts of the rows with these doc_ids."""
        ids = ids.where("doc_id is not null").join(self.loose, "doc_id", "left_anti").distinct()
        return self._with_loose(self.rows.join(self._small(ids), "doc_id", "left_semi").select("text"))


def _linked_rows(rows: DataFrame, n: int, threshold: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_grams, component, component_id`` and the columns in ``keep`` of each row; both components are null without words."""
    bands, scratch = _bands(threshold), Scratch(rows.sparkSession, "ngram-join")
    base = scratch.table(_describe(rows, n, keep), "sets")
    # 1. distinct sets; one row stands for each, and its number is the set's
    named = base.where("name is not null")
    first = named.groupBy("name", "half").agg(F.min("doc_id").alias("least"), F.min(F.struct("row", "doc_id")).alias("of"), F.min("n_grams").alias("n_grams"))
    first = scratch.table(first.select("name", "half", "least", F.col("of.row").alias("set"), F.col("of.doc_id").alias("doc_id"), "n_grams"), "distinct")
    sources = _Sources(rows.select("doc_id", "text"), base, scratch)
    copies = scratch.table(named.join(first.select(F.col("set").alias("row")), "row", "left_anti").select("doc_id").distinct(), "copies")
    # 2. tokens that several sets hold. They are counted in partial aggregates and joined, so that Spark may split a hot token.
    # Two sets of one half are taken for one that holds the tokens of both, which can only add candidates
    tokens = _tokens(sources.but(copies), n, bands)
    held = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    each = Window.partitionBy("half", "space")
    shared = tokens.join(held, "key").withColumns({"rank": F.row_number().over(each.orderBy(F.desc("held"), "key")), "n": F.count(F.lit(1)).over(each)}).where("n >= need")
    hits = shared.select("half", "key", "space", "need", "held", (F.col("rank") >= F.col("need")).alias("finds")).join(first.select("half", "set", "n_grams"), "half").drop("half")
    hits = scratch.table(hits, "hits")
    # 3. groups of sets with the same most widely shared token. Near copies agree on that token even where each has n-grams
    # of its own, so a group of many copies makes few blocks
    wide = F.max(F.struct("held", F.bitwise_not("key").alias("last")))
    active = hits.groupBy("set").agg(wide.alias("wide"), F.sum("held").alias("central"), F.first("n_grams").alias("n_grams"))
    active = scratch.table(active.select("set", "central", "n_grams", F.col("wide.last").alias("token")), "active")
    sizes = active.groupBy("token").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).alias("blocks"))
    part = F.pmod(F.xxhash64("set"), F.col("blocks"))
    member = active.join(sizes, "token").select("set", "token", "central", "blocks", part.alias("part"), F.xxhash64("token", part).alias("block"))
    member = scratch.table(member, "members")
    near = scratch.table(_open_blocks(_dealt(_first_look(member), sources, first, n), bands, True), "near")
    parts = connected_components(near, "u", "v").select(F.col("node").alias("set"), "component")
    placed = member.select("set", "token", "block", "blocks").join(parts, "set", "left").select("set", F.col("token").alias("group"), "block", "blocks", F.coalesce("component", "set").alias("component"))
    placed = scratch.table(placed, "placed")
    # 4. the matrix, and which groups each query opens
    opened = scratch.table(_qualifying(hits, placed, scratch), "opened")
    far = scratch.table(_open_blocks(_dealt(_second_look(opened, placed), sources, first, n), bands, False), "far")
    # 5. components; the smallest doc_id of each
    edges = near.unionByName(far) if far.isEmpty() else placed.select(F.col("set").alias("u"), F.col("component").alias("v")).unionByName(far)
    whole = parts if far.isEmpty() else connected_components(edges, "u", "v").select(F.col("node").alias("set"), "component")
    sets = first.select("name", "set", "least").join(whole, "set", "left").withColumn("component", F.coalesce("component", "set"))
    sets = scratch.table(sets.select("name", "component", "least"), "components")
    least = sets.groupBy("component").agg(F.min("least").alias("component_id"))
    found = scratch.table(sets.select("name", "component").join(least, "component"), "found")
    scratch.drop("distinct", "copies", "hits", "active", "members", "placed", "candidates", "opened", "near", "far", "components", "loose")
    return base.join(found, "name", "left").select("doc_id", "n_grams", "component", "component_id", *keep)


def _first_look(member: DataFrame) -> DataFrame:
    """``block, salt, query, set, component``: the members of each block, and those of large groups with copies of the group's pilots."""
    no = F.lit(0).cast("long")
    alone = member.select("block", no.alias("salt"), F.lit(False).alias("query"), "set")
    large = member.where("blocks > 1")
    pilot = F.max(F.struct("central", "set"))["set"]
    pilots = large.groupBy("token", F.pmod(F.xxhash64("set", F.lit(1)), F.lit(PILOTS))).agg(pilot.alias("set"), F.max("blocks").alias("blocks"))
    home = F.xxhash64("token", F.lit("pilots"))
    copies = pilots.select(home.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("salt"), F.lit(False).alias("query"), "set")
    asked = large.select(home.alias("block"), F.col("part").alias("salt"), F.lit(True).alias("query"), "set")
    rows = alone.unionByName(copies).unionByName(asked)
    # a lone member can have no link in its block
    busy = member.groupBy("block").count().where("count > 1 ").select("block").unionByName(large.select(home.alias("block")).distinct())
    return rows.join(busy, "block", "left_semi").withColumn("component", F.col("set"))


def _qualifying(hits: DataFrame, placed: DataFrame, scratch: Scratch) -> DataFrame:
    """``set, block, component``: the blocks of each group whose token union has as many of a set's tokens as a linked member would."""
    finds = hits.where("finds").select("key", "set").join(placed, "set")
    # under a token, the sets of the component with most holders are never queries: they are connected among themselves
    most = finds.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("most"), F.count(F.lit(1)).alias("parts"))
    live = finds.join(most.where("parts > 1").select("key", "most"), "key").withColumn("inner", F.col("component") == F.col("most")).drop("most")
    live = scratch.table(live, "live")
    cells = live.groupBy("key", F.col("group").alias("to")).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("inner").alias("any_inner"))
    # two groups whose sets all are queries are looked at from one side; a group of one block is known within
    side = F.when(F.col("group") == F.col("to"), F.col("blocks") > 1).otherwise(F.col("any_inner") | (F.col("group") > F.col("to")))
    candidates = live.where("not inner").join(cells, "key").where(side & ((F.col("lo") != F.col("hi")) | (F.col("lo") != F.col("component"))))
    candidates = scratch.table(candidates.select("set", "component", "block", F.col("to").alias("group")).distinct(), "candidates")
    scratch.drop("live")
    places = placed.select("set", "group").join(candidates.select("group").distinct(), "group", "left_semi")
    matrix = hits.select("key", "set").join(places, "set").select("key", "group").distinct()
    overlap = candidates.join(hits.select("set", "key", "space", "need"), "set").join(matrix, ["key", "group"])
    enough = overlap.groupBy("set", "component", "block", "group", "space").agg(F.count(F.lit(1)).alias("common"), F.max("need").alias("need")).where("common >= need")
    queries = enough.select("set", "component", F.col("block").alias("home"), "group").distinct()
    blocks = placed.groupBy("group", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    opened = queries.join(blocks, "group").where((F.col("block") != F.col("home")) & ((F.col("lo") != F.col("hi")) | (F.col("lo") != F.col("component"))))
    return opened.select("set", "component", "block")


def _second_look(opened: DataFrame, placed: DataFrame) -> DataFrame:
    """``block, salt, query, set, component``: opened blocks, one copy for about ``BLOCK_QUERIES`` queries, and their queries."""
    copies = opened.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("copies"))
    members = placed.join(copies, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"), F.lit(False).alias("query"), "set", "component")
    asked = opened.join(copies, "block").select("block", F.pmod(F.xxhash64("set"), F.col("copies")).alias("salt"), F.lit(True).alias("query"), "set", "component")
    return members.unionByName(asked)


def _dealt(openings: DataFrame, sources: _Sources, first: DataFrame, n: int) -> DataFrame:
    """``openings`` with the n-grams of each set, a block to a task and members first."""
    scratch = Scratch(openings.sparkSession, "ngram-blocks")
    openings = scratch.table(openings, "openings")
    wanted = scratch.table(first.join(openings.select("set").distinct(), "set", "left_semi").select("name", "set", "doc_id"), "wanted")
    grams = _grams(sources.of(wanted.select("doc_id")), n).join(wanted.select("name", "set"), "name").select("set", "grams")
    if sources.n_loose:
        grams = grams.dropDuplicates(["set"])
    return openings.join(grams, "set").repartition("block", "salt").sortWithinPartitions("block", "salt", "query", "set")
