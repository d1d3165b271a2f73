"""Scans of landed object stores: one wide table with many kinds of rows, whose columns differ by release."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.dates import from_epoch
from quire.operators.filters import account_type, live, title, unlocked

# Marker columns of the releases, newest first; candidate columns of each logical field.
MARKERS = (
    ("v26", "zattributedsnippet"), ("v18", "zunappliedencryptedrecorddata"), ("v17", "zgeneration"), ("v16", "zaccount6"), ("v15", "zaccount5"),
    ("v14", "zlastopeneddate"), ("v13", "zaccount4"), ("v12", "zserverrecorddata"),
)
CANDIDATES = {
    "account": ("zaccount7", "zaccount6", "zaccount5", "zaccount4", "zaccount3", "zaccount2", "zaccount"),
    "folder_account": ("zowner", "zaccount", "zaccount2", "z_pk"),
    "created": ("zcreationdate3", "zcreationdate1", "zcreationdate"),
    "modified": ("zmodificationdate1", "zmodificationdate"),
    "folder": ("zfolder", "zfolder2"),
    "title": ("ztitle2", "ztitle1", "ztitle"),
}
NEW_TYPE = {"v15", "v16", "v17", "v18", "v26"}


def detect_layout(tables: dict[str, DataFrame]) -> str:
    """Release of a store from its tables and columns alone: no rows are read."""
    if "bodies" not in tables:
        return "legacy"
    have = {c.lower() for c in tables["objects"].columns}
    for release, column in MARKERS:
        if column in have:
            return release
    return "v11" if "folder_bridge" in tables else "unknown"


def resolve(df: DataFrame, field: str) -> str | None:
    """First candidate column that the table has."""
    have = {c.lower(): c for c in df.columns}
    return next((have[x] for x in CANDIDATES[field] if x in have), None)


def resolve_by_data(entity: DataFrame, field: str = "title") -> str | None:
    """First candidate that some row of the entity fills, all probed in one pass; else the last one there is."""
    have = {c.lower(): c for c in entity.columns}
    there = [have[x] for x in CANDIDATES[field] if x in have]
    if not there:
        return None
    filled = entity.agg(*[F.bool_or(F.col(x).isNotNull()).alias(x) for x in there]).first()
    return next((x for x in there if filled[x]), there[-1])


def coalesce_type(df: DataFrame, layout: str) -> Column:
    """Newer releases fill a new type column, but not for all kinds."""
    if layout in NEW_TYPE and "ztypeuti1" in df.columns:
        return F.coalesce("ztypeuti1", "ztypeuti")
    return F.col("ztypeuti")


def entity(objects: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    """Rows of one kind, by the kind's name."""
    return objects.join(entities.where(F.col("z_name") == name).select("z_ent"), "z_ent", "left_semi")


def accounts(objects: DataFrame, entities: DataFrame) -> DataFrame:
    rows = live(entity(objects, entities, "account"), "zmarkedfordeletion")
    return rows.select(F.col("z_pk").alias("account_id"), F.col("zname").alias("name"), account_type("zaccounttype").alias("account_type"))


def folders(objects: DataFrame, entities: DataFrame) -> DataFrame:
    rows = live(entity(objects, entities, "folder"), "zmarkedfordeletion")
    name = resolve_by_data(rows)
    return rows.where(F.col(name).isNotNull()).select(
        F.col("z_pk").alias("folder_id"), F.col(name).alias("name"), F.col("zparent").alias("parent_id"), F.col(resolve(rows, "folder_account")).alias("account_id")
    )


def notes(objects: DataFrame, entities: DataFrame, bodies: DataFrame) -> DataFrame:
    """Live unlocked notes with their body, which may be missing."""
    rows = unlocked(live(entity(objects, entities, "note"), "zmarkedfordeletion"), "zispasswordprotected")
    out = rows.join(bodies.select(F.col("znote").alias("_n"), F.col("zdata").alias("body")), F.col("z_pk") == F.col("_n"), "left")
    return _note_columns(out, rows, resolve_by_data(rows))


def _note_columns(out: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    created = from_epoch(resolve(rows, "created"))
    return out.select(
        F.col("z_pk").alias("note_id"), title(name, created).alias("title"), created.alias("created"), from_epoch(resolve(rows, "modified")).alias("modified"),
        F.col(resolve(rows, "folder")).alias("folder_id"), F.col(resolve(rows, "account")).alias("account_id"), "body",
    )


def notes_bridge(objects: DataFrame, entities: DataFrame, bodies: DataFrame, bridge: DataFrame) -> DataFrame:
    """The oldest wide layout: a note has a row for each folder that the bridge (note, folder) names; bodies are a must."""
    rows = live(entity(objects, entities, "note"), "zmarkedfordeletion")
    out = rows.drop("zfolder").join(bodies.where("zdata IS NOT NULL").select(F.col("znote").alias("z_pk"), F.col("zdata").alias("body")), "z_pk")
    out = out.join(bridge.select(F.col("note").alias("z_pk"), F.col("folder").alias("zfolder")), "z_pk")
    return _note_columns(out, out, resolve_by_data(rows))


def notes_legacy(note: DataFrame, body: DataFrame, store: DataFrame) -> DataFrame:
    """The separate tables before the wide one: raw text bodies, root folders only, nothing pinned."""
    s = store.select(F.col("z_pk").alias("zstore"), F.col("zaccount").alias("account_id"))
    rows = live(note, "zdeletedflag").join(body.select(F.col("zowner").alias("z_pk"), F.col("zcontent").alias("body")), "z_pk").join(s, "zstore")
    created = from_epoch("zcreationdate")
    return rows.select(
        F.col("z_pk").alias("note_id"), title("ztitle", created).alias("title"), created.alias("created"), from_epoch("zmodificationdate").alias("modified"),
        F.col("zstore").alias("folder_id"), "account_id", "body",
    )


def any_layout(tables: dict[str, DataFrame]) -> DataFrame:
    """Notes of a store of any layout under one schema."""
    layout = detect_layout(tables)
    if layout == "legacy":
        return notes_legacy(tables["note"], tables["notebody"], tables["store"])
    if layout == "v11":
        return notes_bridge(tables["objects"], tables["entities"], tables["bodies"], tables["folder_bridge"])
    return notes(tables["objects"], tables["entities"], tables["bodies"])


def union_layouts(stores: list[dict[str, DataFrame]]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [any_layout(s) for s in stores])


def attachments(atts: DataFrame, media: DataFrame, note_rows: DataFrame, account_rows: DataFrame) -> DataFrame:
    """Attachments that are live, of a live note or of none, with media and account."""
    m = media.select("media_id", F.col("filename").alias("media_name"))
    n = note_rows.select("note_id", "account_id", F.col("deleted").alias("_gone"))
    a = account_rows.select("account_id", F.col("name").alias("account"))
    out = live(atts).join(m, "media_id", "left").join(n, "note_id", "left").join(a, "account_id", "left")
    return out.where(~F.coalesce("_gone", F.lit(False))).drop("_gone")


def media_listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length")


def manifest(spark: SparkSession, path: str, schema: str = "note_id long, modified timestamp_ntz, path string") -> DataFrame:
    """The last committed sync state, or an empty one."""
    from quire.sources.sinks import read_manifest

    return read_manifest(spark, path, schema)
