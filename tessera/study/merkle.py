"""A hash tree over a corpus, built where the rows lie: equal roots mean equal corpora, and unequal trees tell what differs.

Rows become canonical JSON and are hashed in the tasks that read them; equal rows are one leaf with a count. Leaves in the order of
their ids are cut into runs after each leaf whose hash ends in eight zero bits, so where the cuts are depends on the content next
to them and not on how many rows there are or how they are partitioned. A run's hash covers its leaves in order; runs are cut
and hashed the same way until few are left. A change moves the hashes on its path to the root and, at most, the cut beside it.

Only nodes of the topmost level, fewer than ``FEW``, and the root come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.ordered import running
from tessera.plans.scratch import Scratch
from tessera.study.canonical import hash_value
from tessera.study.contracts import Corpus, canonical_rows

#: Nodes that the root covers directly.
FEW = 1_024
#: The last two hexadecimal digits of a hash after which a run ends.
CUT = "00"
NODES = "part string, level int, number long, parent long, first string, last string, leaves long, hash string"


def _leaves(rows: DataFrame, part: str) -> DataFrame:
    """``part, key, hash, n``: a leaf for each distinct row; ``key`` is JSON of its ids."""
    keys = [c for c in rows.columns if c != "json"]
    key = F.to_json(F.array(*(F.col(k) for k in keys)))
    return rows.groupBy(key.alias("key"), "json").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "key", F.sha2(F.concat_ws("\n", "json", F.col("n").cast("string")), 256).alias("hash"), "n")


def _numbered(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """With ``parent``: the number of the run that a node is in, from 0 for each part of the tree."""
    cuts = F.when(F.substring("hash", -2, 2) == CUT, 1).otherwise(0).cast("long")
    return running(nodes, [F.col("part"), *order], {"parent": cuts}, before=True)


def _level(below: DataFrame, order: list[str], level: int) -> DataFrame:
    """The nodes over runs of ``below(part, parent, hash, leaves, first, last, ...)``; a run holds 256 nodes on average."""
    inside = F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, "hash"]))))
    one = below.groupBy("part", "parent").agg(inside.alias("s"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("leaves").alias("leaves"))
    return one.select("part", F.lit(level).alias("level"), F.col("parent").alias("number"), "first", "last", "leaves", F.sha2(F.concat_ws("", F.col("s.hash")), 256).alias("hash"))


def corpus_tree(corpus: Corpus) -> tuple[str, DataFrame]:
    """The root over units, relations and metadata, and all nodes (schema ``NODES``); level 0 holds the leaves.

    Relations that share both ends and the kind are leaves of their own, in the order of their hashes; equal ones count up.
    """
    scratch = Scratch(corpus.units.sparkSession, "tree")
    units = canonical_rows(corpus.units, {"id": "unit_id", "text": "text"}, ["unit_id"])
    relations = canonical_rows(corpus.relations, {"s": "source_id", "t": "target_id", "k": "kind"}, ["source_id", "target_id", "kind"])
    leaves = scratch.table(_leaves(units, "units").unionByName(_leaves(relations, "relations")), "hashed")
    leaves = leaves.select("part", F.lit(0).alias("level"), F.col("key").alias("first"), F.col("key").alias("last"), F.col("n").alias("leaves"), "hash")
    now = scratch.table(running(_numbered(leaves, [F.col("first"), F.col("hash")]), [F.col("part"), F.col("first"), F.col("hash")], {"number": F.lit(1).cast("long")}), "level0")
    levels, order, level = [now], ["first", "hash"], 0
    while now.limit(FEW).count() >= FEW:
        level += 1
        above = scratch.table(_level(now, order, level), f"nodes{level}")
        now = scratch.table(_numbered(above, [F.col("number")]), f"level{level}")
        levels.append(now)
        order = ["number"]
    names = [c.split()[0] for c in NODES.split(", ")]
    nodes = levels[0].select(*names)
    for one in levels[1:]:
        nodes = nodes.unionByName(one.select(*names))
    top = {"units": [], "relations": []}
    for r in now.select("part", "number", "hash").orderBy("part", "number").collect():  # fewer than FEW
        top[r.part].append(r.hash)
    return hash_value({"units": top["units"], "relations": top["relations"], "metadata": corpus.metadata, "levels": level}), nodes


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """``part, key, change`` (added, removed or changed) between the nodes of two trees.

    From the top, only children of nodes whose hash the other tree lacks are looked at.
    """
    scratch = Scratch(old.sparkSession, "drift")
    tops = [d.agg(F.max("level")).first()[0] for d in (old, new)]

    def differing(one: DataFrame, other: DataFrame, top: int | None, name: str) -> DataFrame:
        open_ = None
        for level in range(top if top is not None else 0, -1, -1):
            here = one.where(F.col("level") == level)
            if open_ is not None:
                here = here.join(open_.select("part", F.col("number").alias("parent")), ["part", "parent"], "left_semi")
            theirs = other.where(F.col("level") == level).select("part", "hash", *(["first"] if level == 0 else []))
            open_ = scratch.table(here.join(theirs, theirs.columns, "left_anti").select("part", "number", "first"), f"{name}{level}")
        return open_.select("part", F.col("first").alias("key")).distinct()

    gone, come = differing(old, new, tops[0], "old"), differing(new, old, tops[1], "new")
    both = gone.withColumn("was", F.lit(True)).join(come.withColumn("now", F.lit(True)), ["part", "key"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return both.select("part", "key", change.alias("change"))
