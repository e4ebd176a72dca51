"""Hash trees over the rows of a table: a root for the whole, and for every row the hashes that prove it is in there.

Rows are leaves. Each group of rows has a tree of its own, and the roots of the groups are the leaves of a last tree.
A level is made by a slot pivot: conditional aggregates spread the children of each parent over ``fanout`` columns, the
columns end to end are hashed into the parent, and without a child's own column they are its siblings. Pivots are
written level by level on the way up and read again on the way down, where every parent hands its siblings' path on to
its children. A level has a ``fanout``-th of the rows of the one below, so all levels together cost a few passes over
the leaves, which carry hashes and not texts.

Defined for awkward rows: a null group is a group, the first in order; nulls come first in the order of leaves; equal
rows are leaves of their own, side by side; an empty table gives no rows. Columns other than those named play no part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.ordering import numbered
from ledgerlight.session import cut_lineage

PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts end to end."""
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(columns: Sequence[Column]) -> Column:
    """Hash of one row: every value with its length in bytes before it, a dash for null."""
    cells = [c.cast("string") for c in columns]
    return digest(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings' path lead to."""
    return F.aggregate(path, leaf, lambda node, level: digest(level["left"], node, level["right"]))


def siblings(path: Column) -> Column:
    """All hashes of a path in one string, level by level and left to right."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), "")


def _text(columns: Sequence[Column]) -> Column:
    return F.concat(F.lit(""), *[F.coalesce(c, F.lit("")) for c in columns])


def _pivot(nodes: DataFrame, fanout: int, carried: Sequence[str]) -> DataFrame:
    """One row per parent: ``c0``, ``c1``, ... its children in order, null where the last run is shorter."""
    child = F.struct("hash", *carried)
    parents = nodes.filter("n > 1").groupBy("tree", F.expr(f"pos div {fanout}").alias("pos")).agg(
        F.max(F.expr(f"(n + {fanout - 1}) div {fanout}")).alias("n"),
        *[F.first(F.when(F.col("pos") % fanout == s, child), ignorenulls=True).alias(f"c{s}") for s in range(fanout)])
    return cut_lineage(parents.withColumn("hash", F.sha2(_text([F.col(f"c{s}.hash") for s in range(fanout)]), 256)))


def _children(parents: DataFrame, fanout: int, carried: Sequence[str]) -> DataFrame:
    """One row per child: its siblings, which are all columns but its own, go before the path of its parent."""
    slots = [F.col(f"c{s}") for s in range(fanout)]
    hashes = [c["hash"] for c in slots]
    cells = F.array(*[F.struct(F.lit(s).alias("slot"), slots[s].alias("own"), _text(hashes[:s]).alias("left"),
                               _text(hashes[s + 1:]).alias("right")) for s in range(fanout)])
    rows = parents.select("tree", "pos", "path", "subroot", "root", F.explode(cells).alias("cell")).filter(
        F.col("cell.own").isNotNull())
    return rows.select("tree", (F.col("pos") * fanout + F.col("cell.slot")).alias("pos"),
                       F.concat(F.array(F.struct("cell.left", "cell.right")), "path").alias("path"), "subroot", "root",
                       F.col("cell.own.hash").alias("hash"), *[F.col(f"cell.own.{c}").alias(c) for c in carried])


def _proofs(nodes: DataFrame, fanout: int, carried: Sequence[str], last: bool) -> DataFrame:
    """``path``, ``subroot`` and ``root`` of every node of ``tree, pos, n, hash``; the last tree's subroot is its root."""
    size = nodes.agg(F.max("n")).first()[0] or 1
    levels, level = [nodes], 0
    while size > 1:
        levels.append(_pivot(levels[-1], fanout, carried if level == 0 else ()))
        size, level = -(-size // fanout), level + 1
    tops = [rows.filter("n = 1").select("tree", "pos", "hash", F.lit(k).alias("level")) for k, rows in enumerate(levels)]
    roots = tops[0]
    for top in tops[1:]:
        roots = roots.unionAll(top)
    if last:
        known = roots.select("tree", "pos", "level", F.expr(f"cast(array() as {PATH})").alias("path"),
                             F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    else:
        roots = cut_lineage(roots)
        above = numbered(roots.withColumn("all", F.lit("")), "all", ["tree"]).select(
            F.col("all").alias("tree"), F.col("tree").alias("key"), "pos", "n", "hash", "level")
        proved = _proofs(above, fanout, ("key", "level"), True)
        known = proved.select(F.col("key").alias("tree"), F.lit(0).cast("long").alias("pos"), "level", "path",
                              F.col("hash").alias("subroot"), "root")
    known = cut_lineage(known)
    ends = {r[0] for r in known.select("level").distinct().collect()}  # a level for each power of the fanout at most
    below = None
    for k in range(len(levels) - 1, -1, -1):
        here = known.filter(F.col("level") == k).drop("level")
        if below is not None:
            here = below.select(*here.columns).unionAll(here) if k in ends else below.select(*here.columns)
        if k:
            below = _children(levels[k].join(here, ["tree", "pos"]), fanout, carried if k == 1 else ())
    own = ["path", "subroot", "root", "hash", *carried]
    lone = nodes.filter("n = 1").join(known.filter("level = 0"), ["tree", "pos"]) if 0 in ends else None
    if below is None:
        return nodes.join(known.drop("level"), ["tree", "pos"]).select(*own)
    return below.select(*own) if lone is None else below.select(*own).unionAll(lone.select(*own))


def manifest(docs: DataFrame, columns: Sequence[Column], by: Column, order: Column,
             keep: Mapping[str, Column] | None = None, fanout: int = 2) -> DataFrame:
    """``row``, ``leaf``, ``path``, ``subroot`` and ``root`` for every row of ``docs``.

    ``columns`` are hashed into the leaf. Within each value of ``by``, taken as text, leaves ascend by ``order`` and,
    where that is equal, by hash. ``row`` is a struct of ``keep``. ``path`` holds the siblings on every level up to the
    root of all, so ``fold(leaf, path)`` is ``root`` for every row that is unchanged. With fewer than two children in
    the last run of a level, its parent is the hash of that child alone.
    """
    key = by.cast("string")
    leaves = docs.select(F.struct(*[c.alias(name) for name, c in (keep or {"order": order}).items()]).alias("row"),
                         leaf_hash(columns).alias("hash"), order.alias("order"),
                         F.when(key.isNull(), "").otherwise(F.concat(F.lit("="), key)).alias("tree"))
    nodes = numbered(cut_lineage(leaves), "tree", ["order", "hash"]).drop("order")
    return _proofs(cut_lineage(nodes), fanout, ("row",), False).select(
        "row", F.col("hash").alias("leaf"), "path", "subroot", "root")
