"""Unique output paths and other window-shaped operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.strings import split_ext
from quire.operators import running


#: Folder and name of a path.
PARTS = r"(?s)^(?:(.*)/)?([^/]*)\z"
#: A name with a number: its stem and the number, from 2 on, without leading zeros.
NUMBERED = r"(?s)^(.*) \(([2-9]|[1-9][0-9]{1,17})\)\z"


def _numbered(name: str) -> tuple[Column, Column]:
    number = F.regexp_extract(name, NUMBERED, 2)
    return F.when(number != "", F.regexp_extract(name, NUMBERED, 1)), F.when(number != "", number.cast("long"))


def allocate(notes: DataFrame, ext: str = "md", reserved: DataFrame | None = None, date_prefix: str | None = None, hot: bool | None = None) -> DataFrame:
    """(…, filename, rel_path) for rows of note_id, folder_path, base, created: no two rows share a path, whatever the names.

    ``date_prefix`` is a date pattern: names begin with the day of creation and a space. ``reserved`` (note_id, path) are
    paths given out before: a note keeps its own (of several notes with one path, that with the least id), and no other
    gets it. In a folder the first of a name, by creation and id, is ``base.ext`` unless that is reserved; so names that
    stand for themselves come before numbers. All others get ``base (2).ext`` and so on: the free numbers in order. Numbers
    that reserved paths or names of other notes have are left out: each run of them is an interval, known by how many
    numbers are free below it, and a note's number is its place among the free ones and the lengths of the intervals below.
    Null names are empty ones; notes of no folder (null or empty) lie at the top.
    """
    cols = [c for c in notes.columns if c not in ("filename", "rel_path")]
    rows = notes.select(*cols, F.coalesce("base", F.lit("")).alias("_base"), F.coalesce("folder_path", F.lit("")).alias("_f"))
    if date_prefix:
        rows = rows.withColumn("_base", F.concat(F.coalesce(F.concat(F.date_format("created", date_prefix), F.lit(" ")), F.lit("")), "_base"))
    end = f".{ext}"
    kept = None
    if reserved is not None:
        given = reserved.where("path IS NOT NULL").groupBy("path").agg(F.min("note_id").alias("note_id"))
        # A note has one path of its own; all paths are taken.
        mine = given.groupBy("note_id").agg(F.min("path").alias("_path"))
        rows = rows.join(mine, "note_id", "left")
        # Rows that repeat an id: the first keeps the path.
        first = F.row_number().over(Window.partitionBy("note_id").orderBy("created", "_f", "_base"))
        rows = rows.withColumn("_path", F.when(first == 1, F.col("_path")))
        kept, rows = rows.where("_path IS NOT NULL"), rows.where("_path IS NULL").drop("_path")
        place = F.regexp_extract("path", PARTS, 1)
        taken = given.select(place.alias("_f"), F.regexp_extract("path", PARTS, 2).alias("_name")).distinct()
        taken = taken.where(F.col("_name").endswith(end)).select("_f", F.expr(f"substring(_name, 1, length(_name) - {len(end)})").alias("_base"))
    bases = rows.select("_f", "_base")
    names = bases.distinct() if reserved is None else bases.unionByName(taken).distinct()
    stem, number = _numbered("_base")
    numbers = names.select("_f", stem.alias("_base"), number.alias("_k")).where("_k < 100000000000000000")
    if hot is None:
        stems = bases if reserved is None else bases.unionByName(taken)
        hot = 2 * running.largest(stems.select("_f", F.coalesce(stem, F.col("_base")).alias("_base")), ["_f", "_base"]) > running.HOT_ROWS
    keys = ["_f", "_base"]
    ranked = running.Ordered(rows, keys, ["created", "note_id"], hot).before("_j", F.lit(1)).done()
    if reserved is not None:
        ranked = ranked.join(taken.withColumn("_own", F.lit(1)), keys, "left").withColumn("_j", F.col("_j") + F.coalesce("_own", F.lit(0))).drop("_own")
    # Runs of taken numbers, by how many free ones (from 2 on) lie below them.
    islands = running.Ordered(numbers, keys, ["_k"], hot).before("_i", F.lit(1)).done().select(*keys, (F.col("_k") - F.col("_i") - 2).alias("_j"))
    islands = islands.groupBy(*keys, "_j").agg(F.count("*").alias("_n"))
    row = F.struct(*[F.col(c) for c in cols])
    events = ranked.select(*keys, "_j", F.lit(0).alias("_type"), F.lit(0).cast("long").alias("_n"), row.alias("_row"))
    events = events.unionByName(islands.withColumn("_type", F.lit(1)), allowMissingColumns=True)
    placed = running.Ordered(events, keys, ["_j", "_type"], hot).before("_skip", F.col("_n")).done().where("_type = 0")
    number = F.when(F.col("_j") == 0, "").otherwise(F.concat(F.lit(" ("), (F.col("_j") + 1 + F.col("_skip")).cast("string"), F.lit(")")))
    out = placed.select("_row.*", "_f", F.concat("_base", number, F.lit(end)).alias("filename"))
    out = out.select(*cols, "filename", F.when(F.col("_f") == "", F.col("filename")).otherwise(F.concat_ws("/", "_f", "filename")).alias("rel_path"))
    if kept is not None:
        out = out.unionByName(kept.select(*cols, F.regexp_extract("_path", PARTS, 2).alias("filename"), F.col("_path").alias("rel_path")))
    return out


def attachment_names(atts: DataFrame) -> DataFrame:
    """``out_name``: the second use of a file name in a note gets `` (2)`` before its extension, and so on."""
    r = F.row_number().over(Window.partitionBy("note_id", "filename").orderBy("seq", "attachment_id"))
    parts = split_ext("filename")
    numbered = F.concat(parts["name"], F.lit(" ("), F.col("_r").cast("string"), F.lit(")"), F.when(parts["ext"] != "", F.concat(F.lit("."), parts["ext"])).otherwise(""))
    return atts.withColumn("_r", r).withColumn("out_name", F.when(F.col("_r") == 1, F.col("filename")).otherwise(numbered)).drop("_r")


def first_by_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merge_runs(runs: DataFrame, style: tuple[str, ...] = ("style",), attachment: str | None = None, hot: bool | None = None) -> DataFrame:
    """Neighbouring runs of one style become one; attachment runs stay alone. (note_id, seq, style…, length, merged)

    A note of any number of runs: see ``running``."""
    rows = running.Ordered(runs, ["note_id"], ["seq"], hot).previous("_p", *style, *([attachment] if attachment else []))
    same = F.col("_p").isNotNull()
    for s in style:
        same = same & F.col(s).eqNullSafe(F.col("_p")[s])
    if attachment:
        same = same & F.col(attachment).isNull() & F.col("_p")[attachment].isNull()
    new = F.when(same, 0).otherwise(1)
    rows = running.Ordered(rows.rows.withColumn("_new", new).drop("_p"), ["note_id"], ["seq"], rows.hot).before("_g", F.col("_new")).done()
    return rows.groupBy("note_id", (F.col("_g") + F.col("_new")).alias("_g")).agg(
        F.min("seq").alias("seq"), *[F.first(s).alias(s) for s in style], F.sum("length").alias("length"), F.count("*").alias("merged")
    ).drop("_g")


def run_offsets(runs: DataFrame, text_length: str | None = None, hot: bool | None = None) -> DataFrame:
    """``start`` and ``end`` of each run in its text, clipped to ``text_length`` where given."""
    out = running.Ordered(runs, ["note_id"], ["seq"], hot).before("start", F.col("length")).done().withColumn("end", F.col("start") + F.col("length"))
    if text_length:
        out = out.withColumn("start", F.least("start", text_length)).withColumn("end", F.least("end", text_length))
    return out


def sorted_notes(notes: DataFrame, by: str = "modified") -> DataFrame:
    """By name (any case; ``collated``: in the order of dictionaries), last change (newest first) or creation (newest first);
    the id decides ties."""
    order = {"name": F.lower("title").asc_nulls_last(), "collated": F.collate("title", "UNICODE_CI").asc_nulls_last(), "modified": F.col("modified").desc_nulls_last(), "created": F.col("created").desc_nulls_last()}[by]
    return notes.orderBy(order, "note_id")
