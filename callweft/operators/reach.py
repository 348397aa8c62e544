"""Traces over call edges (caller, callee): depths, paths, frontiers, fair node caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweft.plans.lineage import cut


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))


def reach_depth(edges: DataFrame, seeds: DataFrame, max_depth: int = 8) -> DataFrame:
    """(root, node, depth): all that each root reaches, at its least depth.

    ``seeds`` is (root); many roots are traced in the same joins. A node is expanded once per root: a
    level is the distinct successors of the last one that aren't known yet.
    """
    edges = cut(edges.select("caller", "callee"))  # every level reads them
    level = seeds.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    known = level
    for depth in range(1, max_depth + 1):
        found = level.join(edges, level["node"] == edges["caller"]).select("root", F.col("callee").alias("node")).distinct()
        level = cut(found.join(known, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known


def paths(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(root, path): every path of up to ``max_depth`` calls, without going round a cycle."""
    level = seeds.select("root", F.array("root").alias("path"))
    every = None
    for _ in range(max_depth):
        step = level.join(edges, F.element_at("path", -1) == F.col("caller")).filter(~F.array_contains("path", F.col("callee")))
        level = step.select("root", F.array_append("path", F.col("callee")).alias("path"))
        every = level if every is None else every.unionByName(level)
    return every


def frontier_pending(edges: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """(root, node, pending): nodes at ``depth`` and how many distinct groups an expansion would show."""
    front = reached.filter(F.col("depth") == depth)
    following = edges.groupBy("caller").agg(F.count_distinct("callee").alias("pending"))
    return front.join(following, front["node"] == following["caller"], "left").select("root", "node", F.coalesce("pending", F.lit(0)).alias("pending"))


def fair_cap(edges: DataFrame, root: str, max_depth: int, max_nodes: int) -> DataFrame:
    """(depth, node, parent, ord): breadth-first expansion that stops at ``max_nodes`` nodes.

    Groups of a level are taken in the order of their parent, then by name; each node once. The cap is a
    distributed top-k per level, the result is at most ``max_nodes`` rows.
    """
    spark, edges = edges.sparkSession, cut(edges)
    level = spark.createDataFrame([(0, root, None, 1)], "depth int, node string, parent string, ord long")
    known, count = level, 1
    for depth in range(1, max_depth + 1):
        found = level.select(F.col("node").alias("parent"), F.col("ord").alias("parent_ord")).join(edges, F.col("parent") == F.col("caller"))
        found = found.groupBy(F.col("callee").alias("node")).agg(F.min(F.struct("parent_ord", "parent")).alias("by"))
        found = found.join(known.select("node"), "node", "left_anti")
        taken = found.orderBy("by.parent_ord", "node").limit(max_nodes - count)
        place = Window.orderBy("by.parent_ord", "node")  # at most max_nodes rows
        taken = taken.select(F.lit(depth).alias("depth"), "node", F.col("by.parent").alias("parent"), (F.row_number().over(place) + count).cast("long").alias("ord"))
        level = cut(taken)
        n = level.count()
        if not n:
            break
        known, count = known.unionByName(level), count + n
        if count >= max_nodes:
            break
    return known


def edge_groups(edges: DataFrame, caller: str, callee: str, seq: str) -> DataFrame:
    """(caller, callee, n_sites, first_seq): call sites grouped, with the order of first appearance."""
    return edges.groupBy(caller, callee).agg(F.count("*").alias("n_sites"), F.min(seq).alias("first_seq"))


def entry_first(paths_: DataFrame) -> DataFrame:
    """(prefix, parent, node, depth): root-to-leaf paths turned round and merged on their common beginnings."""
    turned = paths_.select(F.reverse("path").alias("path"))
    prefixes = turned.select(F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth"), "path")
    key = F.array_join(F.slice("path", F.lit(1), F.col("depth")), ">")
    up = F.when(F.col("depth") > 1, F.array_join(F.slice("path", F.lit(1), F.col("depth") - 1), ">"))
    return prefixes.select(key.alias("prefix"), up.alias("parent"), F.get("path", F.col("depth") - 1).alias("node"), "depth").distinct()


def layout_rows(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """(group, leaf rows..., row_at): leaves by a running number inside their group; a parent stands at their mean."""
    return leaves.withColumn("row_at", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def subtree_counts(rows: DataFrame) -> DataFrame:
    """(depth, ord, node, n) of tree rows with their ``path`` from the root: every row counts for each beginning of its path."""
    key = F.array_join("path", ">")
    begins = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.array_join(F.slice("path", F.lit(1), i), ">"))).alias("_key"))
    counts = begins.groupBy("_key").agg(F.count("*").alias("n"))
    return rows.select("depth", "ord", "node", key.alias("_key")).join(counts, "_key").drop("_key")


def without_callers(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Nodes that nothing calls."""
    return nodes.join(edges.select(node), node, "left_anti")
