"""Trees of any depth and size: totals, depths and interval labels by pointer doubling.

Every folder holds a pointer to an ancestor, twice as far up after each round, so rounds are as many as the binary digits of
the depth; each is two joins on ids over one row a folder, written, and the table before it goes. What a round carries
along adds up: the distance to the root, the size of the subtree, sums, greatest and least values below. From the sizes,
and the sizes of earlier siblings, follow the places of an Euler tour: a subtree is the interval from ``pre`` to ``last``,
and a selection of subtrees is a running sum over the tour. No table of pairs of folders is made.

Parents that do not exist count as none. Folders that are their own ancestors are a cycle: it is cut above its least id,
and since each of them reaches all that is in and below the cycle, all of them have the totals of the whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.running import Ordered
from quire.sources.shared import discard, scratch

ADD = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest), "min": (F.min, F.least)}


@dataclass(frozen=True)
class Carried:
    """A value of each folder and how it adds up: ``sum``, ``max`` or ``min``."""

    value: Column
    how: str = "sum"


def _rounds(rows: DataFrame, up: dict[str, str], along: dict[str, str], most: int) -> tuple[DataFrame, str, bool]:
    """Of (id, ptr, …): columns of ``up`` added up over all descendants, those of ``along`` over the ancestors; at most ``most``
    rounds. The table, its path, and whether any pointer is left."""
    spark, names = rows.sparkSession, [*up, *along]

    def put(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(spark, "forest")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    state, path = put(rows)
    for _ in range(most):
        if not state.where("ptr IS NOT NULL").head(1):
            return state, path, False
        top = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), *[F.col(c).alias(f"_{c}") for c in along])
        out = state.join(top, "ptr", "left")
        if up:
            below = state.where("ptr IS NOT NULL").groupBy(F.col("ptr").alias("id")).agg(*[ADD[how][0](c).alias(f"_{c}") for c, how in up.items()])
            out = out.join(below, "id", "left")
        both = {**up, **along}
        new, new_path = put(out.select("id", F.col("_ptr").alias("ptr"), *[ADD[both[c]][1](F.col(c), F.col(f"_{c}")).alias(c) for c in names]))
        discard(spark, path)
        state, path = new, new_path
    return state, path, bool(state.where("ptr IS NOT NULL").head(1))


def rooted(folders: DataFrame) -> DataFrame:
    """(folder_id, parent_id, cycle) of each id once: parents that exist, cycles cut; ``cycle`` is the least id of the cycle
    that a folder is in, null elsewhere. Null ids are left out; of several parents the least counts."""
    spark = folders.sparkSession
    one = folders.where("folder_id IS NOT NULL").groupBy("folder_id").agg(F.min("parent_id").alias("parent_id"))
    known = one.select(F.col("folder_id").alias("parent_id"), F.lit(True).alias("_known"))
    own = one.join(known, "parent_id", "left").select(F.col("folder_id").alias("id"), F.when(F.col("_known"), F.col("parent_id")).alias("ptr"))
    n = own.count()
    state, path, left = _rounds(own.withColumn("least", F.col("id")), {}, {"least": "min"}, max(1, n).bit_length() + 1)
    links = own.withColumnsRenamed({"id": "folder_id", "ptr": "parent_id"})
    if not left:
        discard(spark, path)
        return links.withColumn("cycle", F.lit(None).cast("long"))
    # After as many steps as there are folders a pointer is in its cycle, and every folder of a cycle is pointed at.
    inside = state.where("ptr IS NOT NULL").select(F.col("ptr").alias("folder_id")).distinct()
    marked = inside.join(state.select(F.col("id").alias("folder_id"), F.col("least").alias("cycle")), "folder_id")
    return links.join(marked, "folder_id", "left").select("folder_id", F.when(F.coalesce(F.col("cycle") == F.col("folder_id"), F.lit(False)), None).otherwise(F.col("parent_id")).alias("parent_id"), "cycle")


def totals(folders: DataFrame, values: DataFrame, carried: dict[str, Carried], links: DataFrame | None = None) -> DataFrame:
    """(folder_id, …): each of ``carried``, worked out from rows of ``values`` by folder, in and below every folder.

    Values are added up by folder before they meet the tree. Where there are none, sums are 0 and others null."""
    links = rooted(folders) if links is None else links
    own = values.groupBy("folder_id").agg(*[ADD[c.how][0](c.value).alias(name) for name, c in carried.items()])
    rows = links.join(own, "folder_id", "left").select(F.col("folder_id").alias("id"), F.col("parent_id").alias("ptr"), *[F.coalesce(n, F.lit(0)).alias(n) if c.how == "sum" else F.col(n) for n, c in carried.items()])
    done, _, _ = _rounds(rows, {n: c.how for n, c in carried.items()}, {}, 64)
    done = done.drop("ptr").withColumnRenamed("id", "folder_id")
    cycles = links.where("cycle IS NOT NULL").select("folder_id", "cycle")
    whole = cycles.join(done.withColumnRenamed("folder_id", "cycle"), "cycle").drop("cycle")
    return done.join(cycles, "folder_id", "left_anti").unionByName(whole)


def tour(folders: DataFrame, links: DataFrame | None = None, hot: bool | None = None) -> DataFrame:
    """(folder_id, parent_id, depth, pre, last): places of an Euler tour, children by their ids, roots too; a folder's subtree
    are those with ``pre`` between its ``pre`` and ``last``."""
    links = rooted(folders) if links is None else links
    rows = links.select(F.col("folder_id").alias("id"), F.col("parent_id").alias("ptr"), F.lit(1).cast("long").alias("size"))
    sizes, _, _ = _rounds(rows, {"size": "sum"}, {}, 64)
    sized = links.select("folder_id", "parent_id").join(sizes.select(F.col("id").alias("folder_id"), "size"), "folder_id")
    placed = Ordered(sized, ["parent_id"], ["folder_id"], hot).before("_at", F.col("size")).done()
    inner = F.col("parent_id").isNotNull().cast("long")
    steps = placed.select(F.col("folder_id").alias("id"), F.col("parent_id").alias("ptr"), (F.col("_at") + inner).alias("pre"), inner.alias("depth"))
    lifted, _, _ = _rounds(steps, {}, {"pre": "sum", "depth": "sum"}, 64)
    out = sized.join(lifted.select(F.col("id").alias("folder_id"), "pre", "depth"), "folder_id")
    return out.select("folder_id", "parent_id", "depth", "pre", (F.col("pre") + F.col("size") - 1).alias("last"))


def subtrees(places: DataFrame, chosen: DataFrame, hot: bool | None = None) -> DataFrame:
    """Ids of the chosen folders and all below them: those at which more chosen intervals are open than none, by a running sum
    over the tour."""
    opened = places.join(chosen.select("folder_id").distinct(), "folder_id", "left_semi")
    at = lambda pos, kind, delta: [pos.alias("_pos"), F.lit(kind).alias("_kind"), F.lit(delta).cast("long").alias("_delta")]
    none = F.lit(None).cast(places.schema["folder_id"].dataType).alias("folder_id")
    events = opened.select(none, *at(F.col("pre"), 0, 1)).unionByName(opened.select(none, *at(F.col("last") + 1, 0, -1)))
    events = events.groupBy("folder_id", "_pos", "_kind").agg(F.sum("_delta").alias("_delta")).unionByName(places.select("folder_id", *at(F.col("pre"), 1, 0)))
    rows = Ordered(events.withColumn("_all", F.lit(0)), ["_all"], ["_pos", "_kind"], hot).before("_open", F.col("_delta")).done()
    return rows.where("_kind = 1 AND _open > 0").select("folder_id")
