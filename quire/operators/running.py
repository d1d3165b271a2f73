"""Running sums and neighbours in ordered groups of any size.

A window keeps a group in one task. Where the largest group is too large for that, rows are dealt out by ranges of their
keys and order, so that a large group lies in many splits; each split is summed up, the sums of a group's splits, one row
each, are scanned, and every split goes on from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.shared import written

#: Rows of a group up to which one task may hold it.
HOT_ROWS = 2_000_000


def largest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group, or of all where they are few (a count that reads next to nothing)."""
    n = df.count()
    return n if n <= HOT_ROWS // 2 else df.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


class Ordered:
    """Rows in groups of ``keys`` by ``order`` (column names, a total order within a group)."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], hot: bool | None = None):
        self.keys, self.order = keys, order
        self.hot = largest(rows, keys) > HOT_ROWS if hot is None else hot
        if self.hot and "_split" not in rows.columns:
            rows = written(rows.repartitionByRange(*keys, *order).withColumn("_split", F.spark_partition_id()), "ordered")
        self.rows = rows

    def _with(self, rows: DataFrame) -> Ordered:
        return Ordered(rows, self.keys, self.order, self.hot)

    def _window(self):  # noqa: ANN202
        return Window.partitionBy(*(["_split"] if self.hot else []), *self.keys).orderBy(*self.order)

    def _carried(self, rows: DataFrame, each: Column, over: Column) -> DataFrame:
        """Rows with ``_carry``: ``over`` the groups' earlier splits of what ``each`` split comes to."""
        ends = self.rows.groupBy("_split", *self.keys).agg(each.alias("_each"))
        ends = ends.select(F.col("_split").alias("_s"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], over.alias("_carry"))
        same = F.col("_split") == F.col("_s")
        for i, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return rows.join(ends, same, "left").drop("_s", *[f"_k{i}" for i in range(len(self.keys))])

    def _splits(self):  # noqa: ANN202
        return Window.partitionBy(*self.keys).orderBy("_split")

    def before(self, name: str, value: Column) -> Ordered:
        """``name``: the sum of ``value`` over the rows before each one in its group, 0 for the first."""
        zero = F.lit(0).cast("long")
        own = F.coalesce(F.sum(value).over(self._window().rowsBetween(Window.unboundedPreceding, -1)), zero)
        rows = self.rows.withColumn(name, own)
        if self.hot:
            earlier = F.sum("_each").over(self._splits().rowsBetween(Window.unboundedPreceding, -1))
            rows = self._carried(rows, F.sum(value), earlier).withColumn(name, F.col(name) + F.coalesce("_carry", zero)).drop("_carry")
        return self._with(rows)

    def previous(self, name: str, *cols: str) -> Ordered:
        """``name``: a struct of ``cols`` of the row before each one in its group, null for the first."""
        one = F.struct(*cols)
        rows = self.rows.withColumn(name, F.lag(one).over(self._window()))
        if self.hot:
            last = F.max_by(one, F.struct(*self.order))
            rows = self._carried(rows, last, F.lag("_each").over(self._splits())).withColumn(name, F.coalesce(name, "_carry")).drop("_carry")
        return self._with(rows)

    def done(self) -> DataFrame:
        return self.rows.drop("_split")
