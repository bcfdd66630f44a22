"""A Merkle manifest of a table: one root over all rows, and a proof for every row that its content is part of it.

Every row is a leaf. The leaves of a group, in the order of their ids, are a tree: every ``FAN_OUT`` consecutive nodes of
a level become the hash of their digests, as hex text one behind the other, until one node is left, the root of the
group. The roots of the groups, in the order of the groups, are the leaves of one last tree. A proof is the list of the
siblings of a row, level by level, as what stands before and what stands behind it in its run.

A level isn't a row per node. The leaves are cut into aligned blocks of ``FAN_OUT ** BLOCK_LEVELS``; a block keeps each of
its levels as one string of hex digests, all of the same width, so the parents of a level are hashes of its fixed-width
substrings and the siblings of a node are the two substrings beside it in its run. The roots of the blocks are the
leaves of the next step. A step divides the nodes by 243, so a table of 10^12 rows takes five steps. Everything is SQL
functions; the texts are read and hashed once, where they lie, and only digests are shuffled.

Places in a group come from one range-partitioned sort of (group, id, leaf) and the sizes of its partitions, so a group
that holds most of all rows is spread like any other.

Bounds: a block has 243 nodes (15,552 characters); there is one row per group and sort partition beside it.

Edge cases: a null field counts as ``-``; null is a group of its own and comes first, as do null ids; rows of equal id
are ordered by their leaf, and rows equal in all fields are leaves of their own; a lone leaf is the root of its group;
an empty table gives an empty result; columns that aren't named as fields are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faktorium.llm.texts import only
from faktorium.session import work_path

FAN_OUT = 3
BLOCK_LEVELS = 5
BLOCK = FAN_OUT**BLOCK_LEVELS
WIDTH = 64
PATH_TYPE = "array<struct<left: string, right: string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value that can't be confused with its neighbours: UTF-8 length, colon, value; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def _stored(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)


def placed(spark: SparkSession, rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Add ``place`` (from 0, inside ``tree``, in the given order with nulls first) and ``n``, the size of the tree.

    ``order`` should tell rows apart that may be many, so that they don't share one sort partition.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order)
    # A row number in a partition and, above it, the number of the partition: together the order of all rows.
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    stored = _stored(spark, ranged, "merkle-order")
    sizes = stored.groupBy(F.struct(tree).alias("_tree"), "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("_tree")
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.select(
        F.struct("_tree", "_part").alias("_key"), "_first",
        (F.sum("_n").over(before) - F.col("_n")).alias("_before"), F.sum("_n").over(group).alias("n"),
    )
    keyed = stored.withColumn("_key", F.struct(F.struct(tree).alias("_tree"), "_part"))
    joined = keyed.join(sizes, "_key").withColumn("place", F.col("_before") + F.col("_at") - F.col("_first"))
    return joined.drop("_key", "_part", "_at", "_first", "_before")


def parents(level: Column) -> Column:
    """The next level of one level: hashes of its substrings of ``FAN_OUT`` digests, the last one maybe shorter."""
    run = FAN_OUT * WIDTH
    starts = F.sequence(F.lit(1), F.length(level), F.lit(run))
    return F.array_join(F.transform(starts, lambda i: digest(F.substring(level, i, F.lit(run)))), "")


def blocks(nodes: DataFrame) -> DataFrame:
    """Aligned blocks of ``tree, place, n, digest`` and a struct ``item`` per node.

    ``tree, block, n`` (blocks of the tree), ``items`` in order, ``levels`` (the strings of all levels) and ``digest``.
    """
    grouped = nodes.groupBy(F.struct("tree").alias("key"), (F.col("place") / BLOCK).cast("long").alias("block")).agg(
        F.max("n").alias("size"), F.array_sort(F.collect_list(F.struct("place", "digest", "item"))).alias("nodes")
    )
    sizes = F.array(*[F.lit(FAN_OUT**i).cast("long") for i in range(BLOCK_LEVELS)])
    # As many levels as the tree still needs, at most those of a block.
    steps = F.filter(sizes, lambda x: x < F.col("size"))
    first = F.array_join(F.transform("nodes", lambda x: x["digest"]), "")
    levels = F.aggregate(steps, F.array(first), lambda done, _: F.array_append(done, parents(F.element_at(done, -1))))
    return grouped.select(
        F.col("key.tree").alias("tree"), "block", F.ceil(F.col("size") / BLOCK).alias("n"),
        F.transform("nodes", lambda x: x["item"]).alias("items"), levels.alias("levels"),
    ).withColumn("digest", F.element_at("levels", -1))


def siblings(levels: Column, j: Column) -> Column:
    """Left and right siblings of the node at index ``j`` of a block, level by level."""
    below = F.slice(levels, F.lit(1), F.size(levels) - 1)
    widths = F.array(*[F.lit(FAN_OUT**i) for i in range(BLOCK_LEVELS)])

    def beside(level: Column, i: Column) -> Column:
        node = F.floor(j / F.get(widths, i)).cast("int")
        inside = node % FAN_OUT
        left = F.substring(level, (node - inside) * WIDTH + 1, inside * WIDTH)
        return F.struct(left.alias("left"), F.substring(level, (node + 1) * WIDTH + 1, (FAN_OUT - 1 - inside) * WIDTH).alias("right"))

    return F.transform(below, beside)


def climb(spark: SparkSession, nodes: DataFrame) -> list[DataFrame]:
    """The stored blocks of every step, up to one block per tree; the last step's digests are the roots."""
    steps = [_stored(spark, blocks(nodes), "merkle-blocks")]
    while steps[-1].agg(F.max("n")).first()[0] not in (None, 1):
        upper = steps[-1].select("tree", F.col("block").alias("place"), "n", "digest", F.lit(0).alias("item"))
        steps.append(_stored(spark, blocks(upper), "merkle-blocks"))
    return steps


def descend(steps: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """``item, path`` of every node of the first step; ``above`` has the ``path`` of each tree's root."""
    paths = above.select(F.struct("tree", F.lit(0).cast("long").alias("block")).alias("key"), "path")
    for i, step in enumerate(reversed(steps)):
        joined = step.withColumn("key", F.struct("tree", "block")).join(paths, "key")
        found = F.transform(
            "items", lambda item, j: F.struct(item.alias("item"), j.alias("j"), F.concat(siblings(F.col("levels"), j), F.col("path")).alias("path"))
        )
        rows = joined.select("tree", "block", F.explode(found).alias("node"))
        if i + 1 == len(steps):
            return rows.select("tree", F.col("node.item").alias("item"), F.col("node.path").alias("path"))
        place = (F.col("block") * BLOCK + F.col("node.j")).alias("block")
        paths = rows.select(F.struct("tree", place).alias("key"), F.col("node.path").alias("path"))
    raise ValueError("no steps")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda node, x: digest(F.concat(x["left"], node, x["right"])))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


def build(
    spark: SparkSession, documents: DataFrame, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", group: str = "source",
    changed: Column | None = None, changed_field: str = "text",
) -> DataFrame:
    """``doc_id, group, leaf, changed_leaf, subroot, root, path`` per row.

    ``changed``, if given, is another value of ``changed_field``; ``changed_leaf`` is the leaf that it would give, and null
    where ``changed`` is null. ``path`` is the proof: ``fold(leaf, path)`` is the root.
    """
    values = [F.col(f"`{c}`") for c in fields]
    other = F.lit(None).cast("string")
    if changed is not None:
        other = F.when(changed.isNotNull(), leaf([changed if c == changed_field else v for c, v in zip(fields, values)]))
    rows = only(
        documents, doc_id=doc_id, tree=group, digest=leaf(values), changed_leaf=other, row_no=F.monotonically_increasing_id()
    )
    rows = placed(spark, _stored(spark, rows, "merkle-leaves"), "tree", ["doc_id", "digest", "row_no"])
    item = F.struct("doc_id", F.col("digest").alias("leaf"), "changed_leaf").alias("item")
    steps = climb(spark, rows.select("tree", "place", "n", "digest", item))

    subroots = steps[-1].select(F.col("tree").cast("string").alias("name"), F.col("tree").alias("group"), "digest")
    groups = placed(spark, subroots.withColumn("tree", F.lit(0)), "tree", ["name"])
    item = F.struct("group", F.col("digest").alias("subroot")).alias("item")
    top = climb(spark, groups.select("tree", "place", "n", "digest", item))
    root = top[-1].select("tree", F.col("digest").alias("root"))
    no_path = F.array().cast(PATH_TYPE).alias("path")
    above = descend(top, root.select("tree", no_path)).join(F.broadcast(root), "tree")
    above = _stored(spark, above.select(F.col("item.group").alias("tree"), "item.subroot", "root", "path"), "merkle-groups")

    leaves = descend(steps, above.select("tree", "path")).withColumn("key", F.struct("tree"))
    roots = above.select(F.struct("tree").alias("key"), "subroot", "root")
    return leaves.join(roots, "key").select(
        "item.doc_id", F.col("tree").alias("group"), "item.leaf", "item.changed_leaf", "subroot", "root", "path"
    )
