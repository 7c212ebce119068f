"""Merkle manifest of a table: one tree a group, and one over the groups, with a proof for every row.

A digest is the lowercase hex SHA-256 of its parts put together.  A leaf's parts are a row's values, each ``-`` if
null, else its UTF-8 byte count, ``:`` and itself.  Within a tree, leaves go by ``order`` and then by digest; while a tree has
several nodes, every ``FAN`` consecutive ones (the last run may have fewer, even one) become the digest of their
digests.  What remains is the tree's root (a lone leaf is its own).  The roots of all trees, by the bytes of their group (null first),
make one more tree in the same way.

Checkpoint and recompute: only every ``STRIDE``-th level is stored.  A stored node's subtree has at most
``FAN ** STRIDE`` stored nodes at its foot, so one group of that many digests gives its node (`_up`), and the levels in between
are made again from these when proofs are asked for (`_down`): each aligned subtree emits the siblings of its nodes and forgets
the rest.  Proofs go from the top down, and a node's own proof is joined to the subtree below it once, not once a leaf.

Places are exact and no tree is in one task: rows are dealt by ranges of (group, order, digest), written, and counted by
(range, group); a row's place is its place in its range plus the counts before it.  Equal rows may be split between ranges, so
neither a group of a third of all rows nor a row repeated without end meets in a task.  Column functions only.

Defined cases: a null group is a tree of its own; a null value of ``order`` comes first; repeated rows are leaves of their own, in any order,
as they are equal; null, empty and very long values are whole; an empty table has no trees and no root; a table's other columns, whatever
their names, are not read, and what a caller wants to see again goes along in one struct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, materialize

FAN = 8
#: Levels from one stored level to the next.
STRIDE = 3
FOOT = FAN**STRIDE


def framed(value: Column) -> Column:
    """``-`` for null, else the value's byte count, ``:`` and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*(framed(v) for v in values)), 256)


def fold(leaf_digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf_digest, lambda now, step: F.sha2(F.concat(step["before"], now, step["after"]), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof's siblings put together, level by level, left to right."""
    return F.concat_ws("", F.transform(proof, lambda step: F.concat(step["before"], step["after"])))


@dataclass
class Manifest:
    """``levels``: the stored levels of the groups' trees, lowest first (tree, pos, n, digest; the lowest also row);
    ``top``: those of the tree over their roots."""

    levels: list[DataFrame]
    top: list[DataFrame]

    def roots(self) -> DataFrame:
        """(tree, subroot) of every group; a tree's name is ``0`` for the null group, else ``1`` and the group."""
        return _roots(self.levels).select("tree", F.col("digest").alias("subroot"))

    def root(self) -> DataFrame:
        """(root): one row, or none for an empty table."""
        return _roots(self.top).select(F.col("digest").alias("root"))

    def proofs(self) -> DataFrame:
        """(tree, pos, digest, row, proof) of every leaf: proof lists (before, after) from the leaf up to the root of all,
        the digests of the siblings on either side."""
        none = _roots(self.top).select("tree", "pos", F.array().cast("array<struct<before:string,after:string>>").alias("proof"))
        over = _descend(self.top, none).select(F.col("row.tree").alias("tree"), F.lit(0).cast("long").alias("pos"), "proof")
        return _descend(self.levels, materialize(over, "merkle-over"))


def build(rows: DataFrame, leaf_digest: Column, tree: Column, order: list[Column], carried: Column) -> Manifest:
    """The manifest of ``rows``; ``carried`` (a struct) comes back as ``row`` beside each proof."""
    group = F.coalesce(F.concat(F.lit("1"), tree.cast("string")), F.lit("0"))
    keys = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    leaves = materialize(rows.select(group.alias("tree"), keys.alias("key"), leaf_digest.alias("digest"), carried.alias("row")), "merkle-leaves")
    levels = _levels(_placed(leaves))
    over = _roots(levels).select(F.lit("").alias("tree"), F.struct(F.col("tree").alias("o0")).alias("key"), "digest", F.struct("tree").alias("row"))
    return Manifest(levels, _levels(_placed(materialize(over, "merkle-roots"))))


def _placed(leaves: DataFrame) -> DataFrame:
    """(tree, pos, n, digest, row): each leaf's place in its tree and the tree's number of leaves."""
    order = ("tree", "key", "digest", "tie")
    dealt = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    written = materialize(dealt.select("tree", "digest", "row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "merkle-order")
    whole = Window.partitionBy("tree")
    # a row for each range and each tree that begins in it
    runs = written.groupBy("tree", "part").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialize(runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("here").over(whole).alias("n")), "merkle-runs")
    out = written.join(if_small(runs, runs.count()), ["tree", "part"])
    return out.select("tree", (F.col("at") + F.col("shift")).alias("pos"), "n", "digest", "row")


def _levels(placed: DataFrame) -> list[DataFrame]:
    levels = [materialize(placed, "merkle-level")]
    while not levels[-1].where("n > 1").isEmpty():
        levels.append(materialize(_up(levels[-1].where("n > 1")), "merkle-level"))
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    out = levels[0].where("n = 1").select("tree", "pos", "digest")
    for level in levels[1:]:
        out = out.unionByName(level.where("n = 1").select("tree", "pos", "digest"))
    return out


def _above(digests: Column) -> Column:
    """The next level over a run of nodes that begins at a multiple of ``FAN``."""
    last = ((F.size(digests) - 1) / FAN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.concat_ws("", F.slice(digests, i * FAN + 1, F.lit(FAN))), 256))


def _counts() -> list[Column]:
    """Number of nodes of a whole tree on a stored level and on those over it up to the next stored one."""
    return [F.ceil(F.col("n") / FAN**k) for k in range(STRIDE + 1)]


def _subtrees(level: DataFrame) -> DataFrame:
    """(tree, foot, n, nodes, l0, l1, ...): each aligned subtree of a stored level with the levels in it made again; a
    level over the tree's root is null."""
    kept = [c for c in ("digest", "row") if c in level.columns]
    # up to FOOT entries in any group, as positions are consecutive
    out = level.groupBy("tree", F.expr(f"pos div {FOOT}").alias("foot")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", *kept))).alias("nodes"))
    out = out.withColumn("l0", F.col("nodes.digest"))
    for k, n in enumerate(_counts()[:-1]):
        out = out.withColumn(f"l{k + 1}", F.when(n > 1, _above(F.col(f"l{k}"))))
    return out


def _up(level: DataFrame) -> DataFrame:
    """The next stored level: the uppermost level of each subtree."""
    top = F.coalesce(*(F.get(f"l{k}", F.lit(0)) for k in range(STRIDE, 0, -1)))
    return _subtrees(level.drop("row")).select("tree", F.col("foot").alias("pos"), _counts()[-1].alias("n"), top.alias("digest"))


def _down(level: DataFrame, over: DataFrame) -> DataFrame:
    """(tree, pos, digest, row, proof) of the nodes of a stored level, given (tree, pos, proof) of the next one."""
    blocks = _subtrees(level).join(over.withColumnRenamed("pos", "foot"), ["tree", "foot"])

    def step(k: int, i: Column) -> Column:
        """What stands beside the ancestor of the ``i``-th node that is ``k`` levels over it."""
        at, run = (F.floor(i / FAN**k)).cast("int"), (F.floor(i / FAN ** (k + 1)) * FAN).cast("int")
        before = F.concat_ws("", F.slice(f"l{k}", run + 1, at - run))
        return F.struct(before.alias("before"), F.concat_ws("", F.slice(f"l{k}", at + 2, run + FAN - 1 - at)).alias("after"))

    none = F.array().cast("array<struct<before:string,after:string>>")
    own = lambda i: [F.when(F.col(f"l{k + 1}").isNotNull(), F.array(step(k, i))).otherwise(none) for k in range(STRIDE)]
    made = F.transform("nodes", lambda x, i: F.struct(*(x[c].alias(c) for c in ("pos", "digest", *(["row"] if "row" in level.columns else []))), F.concat(*own(i), F.col("proof")).alias("proof")))
    return blocks.select("tree", F.explode(made).alias("node")).select("tree", "node.*")


def _descend(levels: list[DataFrame], given: DataFrame) -> DataFrame:
    """Proofs of the lowest level's nodes; ``given``: those of the roots."""
    over = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        extra = [c for c in ("digest", "row") if c in level.columns and k == 0]
        at_root = level.where("n = 1").drop("n").join(given.drop("pos"), "tree").select("tree", "pos", *extra, "proof")
        here = at_root if over is None else at_root.unionByName(_down(level.where("n > 1"), over).select("tree", "pos", *extra, "proof"))
        over = here if k == 0 else materialize(here, "merkle-proofs")
    return over
