"""Merkle manifest of a table as a persistent tree: one tampered leaf is a new version that shares all untouched nodes.

Leaves of one group (a source) are numbered in order; every ``FANOUT`` consecutive nodes have a parent, up to the group's
subroot; the subroots, in order of their groups, have a tree of the same kind.  The tree is cut into aligned blocks of
``DEPTH`` levels (4,096 leaves).  A block is the unit of work:

* upwards, a block's leaves give its inner nodes; block tops are the leaves of the next, 4,096 times smaller table;
* downwards, a block learns the path above its top: left and right siblings per level, one row per block;
* a version copies the ancestors of its leaf inside the block and goes on along the block's upper path.  Every version
  ends in its own root; no task sees the versions of another block, so a hot group or the root is no bottleneck.

Only (key, two digests) rows are sorted and shuffled, never texts.  Positions come from a range partitioning, so one group
may hold any share of the rows.  All tables between stages are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kelvingrid.session import written

FANOUT, DEPTH = 16, 3
BLOCK = FANOUT**DEPTH
#: Levels that a tree can have: 16^15 leaves.
LEVELS_MOST = 15

PATH = "array<struct<left: string, right: string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Block:
    """The levels of one aligned block; ``levels[0]`` are its leaves, each next level the parents of every 16."""

    def __init__(self, leaves: list[str], depth: int):
        self.levels = [leaves]
        for _ in range(depth):
            below = self.levels[-1]
            self.levels.append([_h("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
        self.runs = [["".join(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)] for nodes in self.levels[:-1]]

    def path(self, leaf: int) -> list[tuple[str, str]]:
        """(left, right) siblings of the leaf and of its ancestors, up to the block's top."""
        out = []
        for run in self.runs:
            siblings, place = run[leaf // FANOUT], leaf % FANOUT * 64
            out.append((siblings[:place], siblings[place + 64 :]))
            leaf //= FANOUT
        return out


def version(leaf: str, path: Sequence[tuple[str, str]]) -> list[str]:
    """The nodes a version copies: the new ancestors of a new leaf, lowest first; every sibling is shared."""
    copied = []
    for left, right in path:
        leaf = _h(left + leaf + right)
        copied.append(leaf)
    return copied


def field(value: Column) -> Column:
    """A value as ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def placed(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` (with ``grp``) plus ``pos``, the place within the group in this order, and the ``depth`` of its tree.

    A range partitioning spreads every group, whatever its size; the places are the row's number in its partition, less
    that of the group's first row there, plus the group's rows in earlier partitions.
    """
    ranged = leaves.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_at", 33)
    held = ranged.groupBy("grp", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # one row per group and partition that holds some of it
    group = Window.partitionBy("grp")
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("grp", "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("_all"))
    depth = sum((F.when(F.col("_all") > FANOUT**k, 1).otherwise(0) for k in range(LEVELS_MOST)), F.lit(0))
    out = ranged.withColumn("_part", part).join(before, ["grp", "_part"])
    return out.withColumns({"pos": F.col("_at") - F.col("_first") + F.col("_before"), "depth": depth}).drop("_at", "_part", "_first", "_before", "_all")


class Forest:
    """The inner nodes of the trees of all groups, stage by stage of blocks.

    ``stages[s]`` holds (grp, pos, digest, depth): the nodes of level ``DEPTH * s``, which are the leaves of the blocks of
    stage s.  ``tops`` is (grp, digest): one row per group.
    """

    def __init__(self, leaves: DataFrame):
        self.stages = [leaves.select("grp", "pos", "digest", "depth")]
        self.nodes = []
        tops = leaves.filter("depth = 0").select("grp", "digest")
        deepest = leaves.agg(F.max("depth")).first()[0] or 0
        for stage in range(-(-deepest // DEPTH)):
            nodes = written(self._inner(self.stages[stage].filter(F.col("depth") > DEPTH * stage), stage), "nodes")
            self.nodes.append(nodes)
            self.stages.append(nodes.filter(F.col("level") == DEPTH * (stage + 1)).select("grp", "pos", "digest", "depth"))
            tops = tops.unionByName(nodes.filter("level = depth").select("grp", "digest"))
        self.tops = tops

    @staticmethod
    def _inner(leaves: DataFrame, stage: int) -> DataFrame:
        """(grp, level, pos, digest, depth): the nodes above the leaves of every block."""

        def build(block: pa.Table) -> pa.Table:
            block = block.sort_by("pos")
            depth, first = block.column("depth")[0].as_py(), block.column("pos")[0].as_py()
            tree = Block(block.column("digest").to_pylist(), min(DEPTH, depth - DEPTH * stage))
            rows = [(DEPTH * stage + k, first // FANOUT**k + i, h) for k, nodes in enumerate(tree.levels) if k for i, h in enumerate(nodes)]
            grp = block.column("grp")[0].as_py()
            return pa.table({"grp": [grp] * len(rows), "level": pa.array([r[0] for r in rows], pa.int32()), "pos": pa.array([r[1] for r in rows], pa.int64()), "digest": [r[2] for r in rows], "depth": pa.array([depth] * len(rows), pa.int32())})

        block = F.floor(F.col("pos") / BLOCK).alias("block")
        return leaves.groupBy("grp", block).applyInArrow(build, "grp string, level int, pos long, digest string, depth int")

    def paths(self, above: DataFrame) -> DataFrame:
        """(grp, block, path): the path above every block of stage 0, given the one above every group's top (grp, path)."""
        known = above.select("grp", F.lit(0).cast("bigint").alias("block"), "path")
        found = None
        for stage in reversed(range(1, len(self.stages))):
            # groups whose top block is of this stage start here, the others come from the stage above
            mine = self.stages[stage].filter(F.col("depth") > DEPTH * stage)
            starts = known.join(mine.select("grp").distinct(), "grp", "left_semi")
            if found is not None:
                starts = starts.join(found.select("grp").distinct(), "grp", "left_anti").unionByName(found)
            found = written(child_paths(mine, starts, DEPTH * stage), "paths")
        if found is None:
            return known
        return known.join(found.select("grp").distinct(), "grp", "left_anti").unionByName(found)


def _by_block(df: DataFrame, block: Column):
    """Rows grouped by (grp, block), under new names for Spark, as both sides of a cogroup may stem from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns if c != "block"], block.alias("block")).groupBy("grp", "block")


def child_paths(children: DataFrame, paths: DataFrame, base: int = 0) -> DataFrame:
    """(grp, block, path) for every child: its siblings inside its block, then the block's own path.

    A child of level ``base`` is the top of the block of the same number one stage below.
    """

    def extend(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        depth = nodes.column("depth")[0].as_py()
        tree = Block(nodes.column("digest").to_pylist(), min(DEPTH, depth - base))
        upper = [(s["left"], s["right"]) for s in above.column("path")[0].as_py()]
        paths = [[{"left": a, "right": b} for a, b in tree.path(i) + upper] for i in range(nodes.num_rows)]
        return pa.table({"grp": nodes.column("grp"), "block": nodes.column("pos"), "path": pa.array(paths, _PATH)})

    return _by_block(children, F.floor(F.col("pos") / BLOCK)).cogroup(_by_block(paths, F.col("block"))).applyInArrow(extend, f"grp string, block long, path {PATH}")


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, changed_leaf string, copied array<string>, folded_root string, verified boolean"


def versions(
    docs: DataFrame,
    tampered: Column,
    tampered_values: dict[str, Column],
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs`` with its proof and its version of the tree.

    ``tampered`` says which rows are tampered with, ``tampered_values`` what their columns become then.  Result:
    ``doc_id``, ``leaf`` (the untampered digest), ``subroot`` and ``root`` of the untampered tree, ``proof_sha256`` (digest
    of all siblings from the leaf's level to the root's, left to right), ``changed_leaf`` (null where not tampered),
    ``copied`` (the ancestors this row's version has for itself, lowest first), ``folded_root`` (the version's root) and
    ``verified`` (equal to ``root``).

    Leaves of a group ascend by id, nulls first; rows that share an id by their digests; equal rows are leaves of their own.
    A null group is a group and comes first; a null value has a digest of its own, unlike an empty text.  Texts are hashed
    whole.  A group of one leaf has that leaf as its subroot, a table of one group that subroot as its root.  An empty
    table gives no rows.  Other columns are ignored, whatever their names.
    """
    values = [F.col(c) for c in columns]
    after = [tampered_values.get(c, F.col(c)) for c in columns]
    # a prefix keeps the byte order and leaves the empty name to the null group
    grp = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit(""))
    changed = F.when(tampered, leaf_digest(after))
    rows = docs.select(grp.alias("grp"), F.col(id_col).cast("long").alias("doc_id"), leaf_digest(values).alias("digest"), changed.alias("changed_leaf"))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "digests")
    leaves = written(placed(rows, ["doc_id", "digest", "changed_leaf", "_row"]).drop("_row"), "placed")

    groups = Forest(leaves)
    subroots = placed(groups.tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"])
    subroots = written(subroots, "subroots")
    top = Forest(subroots)
    nothing = F.array().cast(PATH)
    roots = top.tops.select("grp", "digest", nothing.alias("path"))
    over = child_paths(subroots, top.paths(roots.select("grp", "path")))
    over = over.withColumnRenamed("block", "pos").join(subroots.select("pos", "name", "digest"), "pos")
    over = written(over.select(F.col("name").alias("grp"), "path", F.col("digest").alias("subroot"), roots.select("digest").scalar().alias("root")), "over")
    blocks = groups.paths(over.select("grp", "path")).join(over.drop("path"), "grp")

    def verify(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        leaf, new = nodes.column("digest").to_pylist(), nodes.column("changed_leaf").to_pylist()
        tree = Block(leaf, min(DEPTH, nodes.column("depth")[0].as_py()))
        upper = [(s["left"], s["right"]) for s in above.column("path")[0].as_py()]
        shared = "".join(a + b for a, b in upper)
        subroot, root = (above.column(c)[0].as_py() for c in ("subroot", "root"))
        proofs, copies, ends = [], [], []
        for i, own in enumerate(leaf):
            inside = tree.path(i)
            proofs.append(_h("".join(a + b for a, b in inside) + shared))
            copied = version(new[i] or own, inside + upper)
            copies.append(copied if new[i] else [])
            ends.append(copied[-1] if copied else new[i] or own)
        n = len(leaf)
        return pa.table(
            {
                "doc_id": nodes.column("doc_id"), "leaf": leaf, "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs,
                "changed_leaf": nodes.column("changed_leaf"), "copied": pa.array(copies, pa.list_(pa.string())), "folded_root": ends, "verified": [e == root for e in ends],
            }
        )

    return _by_block(leaves, F.floor(F.col("pos") / BLOCK)).cogroup(_by_block(blocks, F.col("block"))).applyInArrow(verify, RESULT)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_case_versions(docs: DataFrame) -> DataFrame:
    """``versions`` of ``documents`` in which every fifth row by checksum of its id has A-Z of its text lower-cased."""
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return versions(docs, F.coalesce(fifth, F.lit(False)), {"text": F.translate("text", UPPER, LOWER)})
