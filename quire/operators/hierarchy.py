"""Folder trees: paths, closure, recursive totals, merging of namesakes, selections.

Trees are walked by a recursive CTE: depth is bounded by MAX_DEPTH, and a folder that is its own ancestor ends the walk,
so cycles do no harm. Spark bounds the rows of a recursion; trees whose closure has more than a million rows need a
larger ``spark.sql.cteRecursionRowLimit``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.strings import sanitize_underscore

MAX_DEPTH = 64


def roots(folders: DataFrame, shared_keys: bool = False) -> DataFrame:
    """Folders without a parent; with ``shared_keys`` (accounts and folders numbered as one) also those whose parent is
    their account."""
    top = F.col("parent_id").isNull()
    return folders.where(top | (F.col("parent_id") == F.col("account_id")) if shared_keys else top)


def closure(folders: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(ancestor_id, folder_id, depth, path): every folder below every ancestor, itself at depth 0.

    ``path`` is the sanitised names from the ancestor down, joined with "/". A recursive CTE; a folder on the way is
    not entered twice.
    """
    named = folders.select("folder_id", "parent_id", sanitize_underscore(F.coalesce("name", F.lit(""))).alias("part"))
    query = f"""
      WITH RECURSIVE t(ancestor_id, folder_id, depth, path, seen) MAX RECURSION LEVEL {max_depth} AS (
        SELECT folder_id, folder_id, 0, part, array(folder_id) FROM {{named}}
        UNION ALL
        SELECT t.ancestor_id, f.folder_id, t.depth + 1, concat(t.path, '/', f.part), array_append(t.seen, f.folder_id)
        FROM t JOIN {{named}} f ON f.parent_id = t.folder_id WHERE NOT array_contains(t.seen, f.folder_id))
      SELECT ancestor_id, folder_id, depth, path FROM t"""
    return folders.sparkSession.sql(query, named=named)


def paths(folders: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(folder_id, path from its root). A folder in a cycle starts at its own name."""
    tree = closure(folders) if tree is None else tree
    tops = folders.where("parent_id IS NULL").select(F.col("folder_id").alias("ancestor_id"))
    from_root = tree.join(tops, "ancestor_id", "left_semi").select("folder_id", "path")
    out = folders.select("folder_id", sanitize_underscore("name").alias("_own")).join(from_root, "folder_id", "left")
    return out.select("folder_id", F.coalesce("path", "_own").alias("path"))


def rollup(tree: DataFrame, notes: DataFrame) -> DataFrame:
    """Per ancestor: notes in and below it, latest change, earliest creation.

    Notes are summed by folder before they meet the tree, so that a folder of any size is one row in the join.
    """
    own = notes.groupBy("folder_id").agg(F.count("*").alias("n"), F.max("modified").alias("m"), F.min("created").alias("c"))
    return (
        tree.join(own, "folder_id", "left").groupBy(F.col("ancestor_id").alias("folder_id"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.max("m").alias("latest"), F.min("c").alias("earliest"))
    )


def merge_namesakes(folders: DataFrame, notes: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """Folders of one account with the same path of names become one: the least id stands for them, notes are pooled."""
    where = paths(folders, tree).join(folders.select("folder_id", "account_id"), "folder_id")
    own = notes.groupBy("folder_id").agg(F.count("*").alias("n"))
    return (
        where.join(own, "folder_id", "left").groupBy("account_id", "path")
        .agg(F.min("folder_id").alias("folder_id"), F.count("*").alias("merged"), F.coalesce(F.sum("n"), F.lit(0)).alias("notes"))
    )


def subtree(tree: DataFrame, chosen: DataFrame) -> DataFrame:
    """Ids of the chosen folders and all below them."""
    return tree.join(chosen.select(F.col("folder_id").alias("ancestor_id")), "ancestor_id", "left_semi").select("folder_id").distinct()


def deselect(selection: DataFrame, tree: DataFrame, dropped: DataFrame) -> DataFrame:
    return selection.join(subtree(tree, dropped), "folder_id", "left_anti")


def toggle(selection: DataFrame, tree: DataFrame, switched: DataFrame) -> DataFrame:
    """Each switched subtree changes sides."""
    below = subtree(tree, switched)
    return selection.join(below, "folder_id", "left_anti").unionByName(below.join(selection, "folder_id", "left_anti"))


def sorted_folders(stats: DataFrame, by: str) -> DataFrame:
    """By name, latest change (newest first, none last) or earliest creation (oldest first, none last)."""
    order = {"name": [F.lower("name")], "modified": [F.col("latest").desc_nulls_last()], "created": [F.col("earliest").asc_nulls_last()]}[by]
    return stats.orderBy(*order, "folder_id")
