"""Merkle manifest of a table: a tree of digests for each group, one root over the groups.

A leaf is the digest of a row's named columns.  The leaves of a group ascend by
an order column; two consecutive nodes become one (the last may stand alone),
level by level, until one is left, the group's root.  The roots of the groups,
ordered by group, form the tree of the manifest in the same way.

The leaves of a group are cut into superblocks of ``BLOCK`` leaves.  A first
pass reduces each superblock to its top node; the few top nodes are nodes of a
smaller tree that is cut and reduced likewise.  On the way down, each
superblock is cogrouped with the outer nodes it needs, which are the siblings
from its top node to the root: one task group finishes the local levels, joins
the proofs and folds them.  No group holds more than a superblock.

H is SHA-256 in lowercase hexadecimal of the concatenated inputs, digests as
that text.  A column is written as ``-`` if null, else as the number of its
UTF-8 bytes, a colon and the value.

Defined cases: rows with a null group are a group of their own, first in order;
null order values come first; equal order values are ordered by leaf, and rows
alike in all named columns have equal leaves and may swap places, which changes
no digest; empty and long texts are hashed whole; an empty table gives an empty
manifest; columns that are not named are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.ranges import positions
from vigil.session import materialize

#: Leaves of a superblock: a power of two.
LEVELS = 10
BLOCK = 1 << LEVELS


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(values: list[Column]) -> Column:
    """The input of a leaf: every value as text with its length, or ``-``."""
    texts = [v.cast("string") for v in values]
    each = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.concat(*each)


def levels(row: list[str], most: int | None) -> list[list[str]]:
    """Nodes level by level: ``most`` levels above the first, or up to a single node."""
    out = [row]
    while len(out) <= most if most is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([h("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return out


def path_of(tree: list[list[str]], at: int) -> list[str]:
    """Siblings of a leaf below the last level: ``L`` or ``R`` and the digest, ``-`` where it stands alone."""
    out = []
    for row in tree[:-1]:
        beside = at ^ 1
        out.append(("L" if beside < at else "R") + row[beside] if beside < len(row) else "-")
        at >>= 1
    return out


def fold(leaf: str, path: str) -> str:
    """The root that a leaf and its path (entries joined by commas) lead to."""
    for step in path.split(",") if path else []:
        other = step[1:]
        leaf = h(other + leaf if step[0] == "L" else leaf + other)
    return leaf


def _local(nodes: pd.DataFrame) -> tuple[pd.DataFrame, list[list[str]]]:
    nodes = nodes.sort_values("_pos")
    whole = int(nodes["_size"].iloc[0]) > BLOCK
    return nodes, levels(nodes["_digest"].tolist(), LEVELS if whole else None)


def _reduced(nodes: pd.DataFrame) -> pd.DataFrame:
    """Top node of one superblock."""
    nodes, tree = _local(nodes)
    size, at = int(nodes["_size"].iloc[0]), int(nodes["_pos"].iloc[0]) // BLOCK
    return pd.DataFrame(
        {"_group": nodes["_group"].iloc[:1], "_pos": [at], "_size": [-(-size // BLOCK)], "_digest": [tree[-1][0]]}
    )


def _layers(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, the top nodes of their superblocks, and so on up to one node a group."""
    out = [nodes]
    while True:
        block = F.floor(F.col("_pos") / BLOCK).alias("_block")
        below = out[-1].select("_group", block, "_pos", "_size", "_digest")
        tops = below.groupBy("_group", "_block").applyInPandas(
            _reduced, "_group string, _pos long, _size long, _digest string"
        )
        out.append(materialize(tops, "tops"))
        if (out[-1].agg(F.max("_size")).first()[0] or 1) == 1:  # one number
            return out


def _exchange(nodes: DataFrame, outer: DataFrame, kept: list[str], work, added: str) -> DataFrame:
    """Superblocks of ``nodes`` with the outer row of their top node: ``_group``, ``_pos``, ``kept`` and what ``work`` adds."""
    block = F.floor(F.col("_pos") / BLOCK)
    left = nodes.select("_group", block.alias("_block"), "_pos", "_size", "_digest", *kept).groupBy("_group", "_block")
    right = outer.groupBy("_group", "_pos")
    names = ["_group", "_pos", *kept]
    kinds = ", ".join(["_group string", "_pos long", *[f"`{c}` string" for c in kept]])

    def join(mine: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        mine, tree = _local(mine)
        top = above.iloc[0]
        paths = [path_of(tree, i) + ([top["_path"]] if top["_path"] else []) for i in range(len(mine))]
        found = pd.DataFrame(work(mine, [",".join(p) for p in paths], top))
        return pd.concat([mine[names].reset_index(drop=True), found], axis=1)

    return left.cogroup(right).applyInPandas(join, f"{kinds}, {added}")


def _outer(mine: pd.DataFrame, paths: list[str], top: pd.Series) -> dict:
    return {"_path": paths, "_sub": [top["_sub"]] * len(mine), "_root": [top["_root"]] * len(mine)}


_OUTER = "_path string, _sub string, _root string"


def _descend(layers: list[DataFrame], outer: DataFrame) -> DataFrame:
    """Outer rows of the nodes of the second layer, from those of the last."""
    for nodes in reversed(layers[1:-1]):
        outer = materialize(_exchange(nodes, outer, [], _outer, _OUTER), "outer")
    return outer


def manifest(
    df: DataFrame,
    kept: list[str],
    fields: list[str],
    group: str,
    order: str,
    claimed: dict[str, Column] | None = None,
) -> DataFrame:
    """``kept`` (of types that can be cast to text and back), ``leaf``, ``subroot``, ``root``, ``path`` and ``folded_root``.

    ``path`` holds the siblings from the leaf to the root, joined by commas:
    ``L`` or ``R`` (their side) and the digest, or ``-`` where a node stands
    alone.  ``claimed`` gives other values for some fields; the root is then
    folded from the leaf of the claimed row and the original siblings.
    """
    own = [F.col(f"`{c}`") for c in fields]
    changed = [(claimed or {}).get(c, F.col(f"`{c}`")) for c in fields]
    differs = F.lit(False)
    for a, b in zip(own, changed):
        differs = differs | ~a.cast("string").eqNullSafe(b.cast("string"))
    named = [f"_kept_{i}" for i in range(len(kept))]
    rows = df.select(
        # a text without nulls in the order of the groups: null first, then by bytes
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-")).alias("_group"),
        F.col(f"`{order}`").alias("_order"),
        *[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(kept, named)],
        F.sha2(encoded(own), 256).alias("_digest"),
        F.when(differs, F.sha2(encoded(changed), 256)).alias("_claimed"),
    )
    # rows alike in everything may swap places; the tie lets ranges cut them
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    sort = [F.col("_order").asc_nulls_first(), F.col("_digest"), F.col("_tie")]
    leaves = materialize(positions(rows, ["_group"], sort, "_pos", "_size").drop("_order", "_tie"), "leaves")
    layers = _layers(leaves)
    subroots = layers[-1].select(F.lit("").alias("_group"), F.col("_group").alias("_kept_group"), "_digest")
    subroots = materialize(positions(subroots, ["_group"], [F.col("_kept_group")], "_pos", "_size"), "subroots")
    summit = _layers(subroots)
    top = summit[-1].select("_group", "_pos", F.lit("").alias("_path"), F.lit("").alias("_sub"), F.col("_digest").alias("_root"))
    above = _descend(summit, top)

    def of_group(mine: pd.DataFrame, paths: list[str], top: pd.Series) -> dict:
        return {"_path": paths, "_sub": mine["_digest"].tolist(), "_root": [top["_root"]] * len(mine)}

    over = _exchange(subroots, above, ["_kept_group"], of_group, _OUTER)
    over = over.select(F.col("_kept_group").alias("_group"), F.lit(0).cast("long").alias("_pos"), "_path", "_sub", "_root")
    outer = _descend(layers, materialize(over, "outer"))

    def proofs(mine: pd.DataFrame, paths: list[str], top: pd.Series) -> dict:
        leaf = mine["_digest"].tolist()
        other = [b if isinstance(b, str) else a for a, b in zip(leaf, mine["_claimed"])]
        return {
            "leaf": leaf,
            "subroot": [top["_sub"]] * len(mine),
            "root": [top["_root"]] * len(mine),
            "path": paths,
            "folded_root": [fold(a, p) for a, p in zip(other, paths)],
        }

    found = _exchange(
        leaves, outer, [*named, "_claimed"], proofs, "leaf string, subroot string, root string, path string, folded_root string"
    )
    back = [F.col(n).cast(df.schema[c].dataType).alias(c) for c, n in zip(kept, named)]
    return found.select(*back, "leaf", "subroot", "root", "path", "folded_root")


def siblings(path: Column) -> Column:
    """The digests of a path, concatenated."""
    return F.translate(path, "LR,-", "")
