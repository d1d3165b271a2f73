"""Tables inside documents: rebuilt from cells or from an object graph, and rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import strings as S


def build(cells: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
    """(table_id, grid array<array<string>>, n_rows, n_cols) from (table_id, row_key, col_key, text).

    ``rows`` and ``cols`` (table_id, key, ord) give the order; without them keys stand in their own order. Cells that
    are missing are empty. Each table's grid is rows x columns of its own.
    """

    def keys(name: str, given: DataFrame | None) -> DataFrame:
        if given is not None:
            return given.select("table_id", F.col("key").alias(name), "ord")
        k = cells.select("table_id", name).distinct()
        return k.withColumn("ord", F.row_number().over(Window.partitionBy("table_id").orderBy(name)) - 1)

    r, c = keys("row_key", rows).withColumnRenamed("ord", "r"), keys("col_key", cols).withColumnRenamed("ord", "c")
    full = r.join(c, "table_id").join(cells, ["table_id", "row_key", "col_key"], "left")
    lines = full.groupBy("table_id", "r").agg(F.sort_array(F.collect_list(F.struct("c", F.coalesce("text", F.lit("")).alias("text")))).alias("line"))
    grid = lines.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("r", F.transform("line", lambda x: x["text"]).alias("line")))).alias("g"))
    grid = grid.select("table_id", F.transform("g", lambda x: x["line"]).alias("grid"))
    return grid.withColumn("n_rows", F.size("grid")).withColumn("n_cols", F.size(F.get("grid", 0)))


def from_objects(objects: DataFrame) -> DataFrame:
    """Cells and orders of tables from object rows (table_id, kind, key, value, ord): ``row`` and ``column`` give the
    order of keys, ``remap`` sends an id of the contents to a key, ``cell`` is column -> row -> text in ``key``
    (column), ``row`` and ``value``. Returns what ``build`` makes of them."""
    remap = objects.where("kind = 'remap'").select("table_id", F.col("key").alias("_id"), F.col("value").alias("_to"))

    def mapped(df: DataFrame, name: str) -> DataFrame:
        m = remap.withColumnRenamed("_id", name)
        return df.join(m, ["table_id", name], "left").withColumn(name, F.coalesce("_to", name)).drop("_to")

    cells = objects.where("kind = 'cell'").select("table_id", F.col("key").alias("col_key"), F.col("row").alias("row_key"), F.col("value").alias("text"))
    cells = mapped(mapped(cells, "row_key"), "col_key")
    order = lambda kind: objects.where(F.col("kind") == kind).select("table_id", "key", "ord")
    return build(cells, order("row"), order("column"))


def to_text(grid: Column | str) -> Column:
    return F.array_join(F.transform(S.c(grid), lambda r: F.array_join(r, "\t")), "\n")


def to_html(grid: Column | str) -> Column:
    cell = lambda x: F.concat(F.lit("<td>"), F.replace(S.html_escape(x), F.lit("\n"), F.lit("<br>")), F.lit("</td>"))
    line = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(S.c(grid), line), ""), F.lit("</table>"))


def to_markdown(grid: Column | str) -> Column:
    """The first row is the head; bars and line feeds inside cells are escaped."""
    g = S.c(grid)
    cell = lambda x: F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.get(g, 0))))
    rest = F.transform(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(1))), line)
    return F.concat_ws("\n", line(F.get(g, 0)), rule, F.when(F.size(g) > 1, F.array_join(rest, "\n")))
