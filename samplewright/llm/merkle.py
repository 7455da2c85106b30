"""A Merkle manifest of a table: a root digest over all rows, and for each row a proof that it belongs to it.

Rows become leaves, leaves of a group a tree, and the groups' roots a tree of their own. A tree is rolled up by
its ranks: written with ``digits`` digits, a rank says which block a leaf belongs to (what lies above the digits) and
where in it. Rows are dealt out by block once; grouping by all digits but the last, then all but the last two,
and so on, nests child structs in parent structs until a block is one row that holds its whole subtree, of a size
that doesn't depend on the table. Blocks' roots are ranked leaves of the next layer. On the way back the nested
struct is transformed into its leaves with their siblings and exploded: no leaf is joined with anything. What a
block's root needs from the layer above is a short row that is grouped with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import store

#: Steps of a proof from the leaf up: digests that stand before and after the node among its siblings.
_PATH = "array<struct<before:string,after:string>>"


def encoded(*columns: Column | str) -> Column:
    """Values as one text that tells all of them apart: '-' for null, else number of UTF-8 bytes, ':', value."""
    parts = []
    for column in columns:
        text = (F.col(column) if isinstance(column, str) else column).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds ``rank`` (from 0, in the group) and ``n`` (rows of the group).

    Rows are sorted over ranges of (group, order), so that neither a large group nor a repeated value meets in one
    task, and written; a rank is the place in the range plus the group's rows in the ranges before.
    """
    # The ranges' limits come from a sample of their keys, so a long digest is cut for them.
    short = [F.substring(c, 1, 8) if rows.schema[c].dataType == T.StringType() and c == order[-1] else F.col(c) for c in order]
    in_order = rows.repartitionByRange(group, *short).sortWithinPartitions(group, *order)
    at = F.monotonically_increasing_id()
    placed = store(in_order.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at), "ranked")
    # At most a row for each range and one for each group.
    parts = placed.groupBy(group, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    in_group = Window.partitionBy(group)
    before = F.sum("_rows").over(in_group.orderBy("_part")) - F.col("_rows")
    parts = parts.select(group, "_part", "_first", before.alias("_before"), F.sum("_rows").over(in_group).alias("n"))
    found = placed.join(parts, [group, "_part"])
    return found.withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def _one_left(n: Column, fanout: int, level: int) -> Column:
    """Whether a tree of n leaves has a single node at a level."""
    return n <= F.lit(fanout**level)


def _roll_up(nodes: DataFrame, fanout: int, digits: int) -> DataFrame:
    """Blocks (grp, n, block, node) of nodes (grp, n, rank, node), n being the number of nodes in the group."""
    names = [f"d{k}" for k in range(digits)]
    for k, name in enumerate(names):
        nodes = nodes.withColumn(name, F.pmod(F.floor(F.col("rank") / F.lit(fanout**k)), F.lit(fanout)).cast("int"))
    nodes = nodes.withColumn("block", F.floor(F.col("rank") / F.lit(fanout**digits)))
    # All groupings below keep to this dealing.
    nodes = nodes.repartition("grp", "block").select("grp", "n", "block", *names, "node")
    for k in range(digits):
        grouped = nodes.groupBy("grp", "n", "block", *names[k + 1 :])
        nodes = grouped.agg(F.sort_array(F.collect_list(F.struct(names[k], "node"))).alias("kids"))
        joined = F.array_join(F.transform("kids", lambda c: c["node"]["hash"]), "")
        own = F.when(_one_left(F.col("n"), fanout, k), F.col("kids")[0]["node"]["hash"]).otherwise(digest(joined))
        nodes = nodes.withColumn("node", F.struct(own.alias("hash"), F.col("kids"))).drop("kids")
    return nodes


def _leaves(node: Column, n: Column, fanout: int, level: int) -> Column:
    """The leaves below a node with their paths, as an array of structs (node, path)."""
    if not level:
        return F.array(F.struct(node.alias("node"), F.array().cast(_PATH).alias("path")))
    kids = node["kids"]

    def step(i: Column) -> Column:
        hashes = F.transform(kids, lambda c: c["node"]["hash"])
        before = F.array_join(F.slice(hashes, F.lit(1), i), "")
        after = F.array_join(F.slice(hashes, i + 2, F.lit(fanout)), "")
        one = F.array(F.struct(before.alias("before"), after.alias("after")))
        return F.when(_one_left(n, fanout, level - 1), F.array().cast(_PATH)).otherwise(one)

    def below(kid: Column, i: Column) -> Column:
        found = _leaves(kid["node"], n, fanout, level - 1)
        return F.transform(found, lambda e: F.struct(e["node"].alias("node"), F.concat(e["path"], step(i)).alias("path")))

    return F.flatten(F.transform(kids, below))


def _layers(nodes: DataFrame, most: int, fanout: int, digits: int) -> list[DataFrame]:
    """Written layers of blocks, from the leaves up; ``most`` is the number of leaves in the largest group."""
    layers = []
    while True:
        layers.append(store(_roll_up(nodes, fanout, digits), "blocks"))
        most = -(-most // fanout**digits)
        if most <= 1:
            return layers
        rank = F.col("block").alias("rank")
        above = F.ceil(F.col("n") / F.lit(fanout**digits)).alias("n")
        nodes = layers[-1].select("grp", above, rank, F.struct(F.col("node.hash").alias("hash"), rank).alias("node"))


def _emit(layers: list[DataFrame], above: DataFrame, fanout: int, digits: int) -> DataFrame:
    """Leaves (grp, node, path, subroot) of a tree, given (grp, path, subroot) of its root."""
    above = above.select("grp", F.lit(0).cast("long").alias("block"), "path", "subroot")
    for k in reversed(range(len(layers))):
        # A block and what lies above its root are grouped: two rows each.
        none = [F.lit(None).cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot")]
        blocks = layers[k].select("grp", "block", "n", "node", *none)
        empty = [F.lit(None).cast(layers[k].schema[c].dataType).alias(c) for c in ("n", "node")]
        both = blocks.unionByName(above.select("grp", "block", *empty, "path", "subroot")).groupBy("grp", "block")
        met = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "path", "subroot")])
        found = met.select("grp", "path", "subroot", F.explode(_leaves(F.col("node"), F.col("n"), fanout, digits)).alias("e"))
        path = F.concat("e.path", "path").alias("path")
        if not k:
            return found.select("grp", F.col("e.node").alias("node"), path, "subroot")
        above = found.select("grp", F.col("e.node.rank").alias("block"), path, "subroot")


def manifest(
    rows: DataFrame,
    id_col: str,
    group_col: str,
    value_cols: Sequence[str],
    claimed: Column | None = None,
    fanout: int = 2,
    digits: int = 10,
) -> DataFrame:
    """The manifest of a table: (id, grp, leaf, claimed, rank, subroot, root, path), a row for each row.

    A leaf is the SHA-256, as lower-case hex, of the values of ``value_cols`` (``encoded``). Leaves of a group
    ascend by id; while several nodes remain, each run of ``fanout`` (the last may be shorter, even a single
    one) becomes the digest of its digests. What remains is the group's subroot; subroots, in the order of their
    groups (null first, then by UTF-8 bytes), become the root in the same way. ``path`` holds a step for each level
    from the leaf to the root: the digests that stand before and after the node in its run, joined. ``claimed``, if
    given, is the digest that the row is to be checked with; null means its leaf. ``grp`` is the group as text
    with '=' before it, '-' for null.

    Null ids come first in their group. Rows with equal ids stand in the order of their leaves; repeated rows are
    leaves of their own. Null and empty values differ. Other columns are ignored. An empty table gives no rows.
    """
    if fanout < 2 or digits < 1:
        raise ValueError("fanout must be 2 or more, digits 1 or more")
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))
    leaf = digest(encoded(*value_cols))
    said = F.lit(None).cast("string") if claimed is None else claimed
    leaves = store(rows.select(group.alias("grp"), F.col(id_col).alias("id"), leaf.alias("leaf"), said.alias("claimed")), "leaves")
    placed = ranked(leaves, "grp", ["id", "leaf"])
    node = F.struct(F.col("leaf").alias("hash"), "id", "claimed", "rank")
    placed = placed.select("grp", "n", "rank", node.alias("node"))
    largest = leaves.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    layers = _layers(placed, largest, fanout, digits)

    top = layers[-1].select(F.lit("").alias("all"), F.col("grp").alias("id"), F.col("node.hash").alias("hash"))
    groups = ranked(top, "all", ["id"]).select(F.col("all").alias("grp"), "n", "rank", F.struct("hash", "id", "rank").alias("node"))
    roots = _layers(groups, top.count(), fanout, digits)
    root = roots[-1].select("node.hash").first()
    start = roots[-1].select("grp", F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"))
    subroots = _emit(roots, start, fanout, digits)
    subroots = subroots.select(F.col("node.id").alias("grp"), "path", F.col("node.hash").alias("subroot"))

    found = _emit(layers, subroots, fanout, digits)
    return found.select(
        F.col("node.id").alias(id_col),
        "grp",
        F.col("node.hash").alias("leaf"),
        F.coalesce("node.claimed", "node.hash").alias("claimed"),
        F.col("node.rank").alias("rank"),
        "subroot",
        F.lit(root[0] if root else None).cast("string").alias("root"),
        "path",
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.concat(step["before"], node, step["after"])))


def siblings(path: Column) -> Column:
    """The digests of a proof from the leaf up, left to right, joined."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")
