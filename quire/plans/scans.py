"""Queries of scans, layouts, filters, projections and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import filters as X
from quire.operators import hierarchy, joins, paths
from quire.plans.base import Data, query
from quire.sources import stores
from quire.sources.catalog import Catalog

T0 = "TIMESTAMP '2024-01-01 00:00:00'"
TITLE = "coalesce(nullif(regexp_replace({t}, '^\\s+|\\s+$', '', 'g'), ''), strftime({c}, '%Y-%m-%d'))"
LIVE = "coalesce(zmarkedfordeletion, 0) = 0"
TS = "make_timestamp(CAST(round(({x} + 978307200) * 1000000) AS BIGINT))"


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("SELECT z_pk, z_ent FROM raw_objects WHERE z_ent = (SELECT z_ent FROM raw_entities WHERE z_name = 'note')", "raw_objects raw_entities")
def scan_entity(d: Data) -> DataFrame:
    return stores.entity(d.raw_objects, d.raw_entities, "note").select("z_pk", "z_ent")


def _tables(d: Data) -> dict[str, DataFrame]:
    return {"objects": d.raw_objects, "entities": d.raw_entities, "bodies": d.raw_bodies}


#: Store -> the release that it must be taken for: columns of one release, of two, none, other tables.
STORES = {
    "snippet": "v26", "unapplied": "v18", "generation": "v17", "account6": "v16", "account5": "v15", "opened": "v14", "account4": "v13", "server": "v12",
    "snippet and account4": "v26", "bridge": "v11", "bare": "unknown", "no bodies": "legacy",
}
MARKS = {
    "snippet": "ZAttributedSnippet", "unapplied": "zunappliedencryptedrecorddata", "generation": "zgeneration", "account6": "zaccount6", "account5": "zaccount5", "opened": "zlastopeneddate",
    "account4": "zaccount4", "server": "zserverrecorddata",
}


@query(
    f"SELECT store, layout, z_ent, count(*) AS n FROM raw_objects, (VALUES {', '.join(f'{kv}' for kv in STORES.items())}) AS s(store, layout) GROUP BY ALL", "raw_objects"
)
def detect_layout(d: Data) -> DataFrame:
    """Stores of every release, made of the one at hand by the columns and tables that tell them apart."""
    found = []
    for store in STORES:
        have = _tables(d)
        for mark, column in MARKS.items():
            if mark in store.split(" and "):
                have["objects"] = have["objects"].withColumn(column, F.lit(None).cast("long"))
        if store == "bridge":
            have["folder_bridge"] = d.raw_bridge
        if store == "no bodies":
            del have["bodies"]
        found.append(F.struct(F.lit(store).alias("store"), F.lit(stores.detect_layout(have)).alias("layout")))
    return d.raw_objects.groupBy("z_ent").agg(F.count("*").alias("n")).select(F.inline(F.array(*found)), "z_ent", "n")


#: Columns of the store at hand under the names that other releases give them.
RENAMED = {
    "v26": {}, "v17": {"zcreationdate1": "zcreationdate3"}, "v16": {"zaccount7": "zaccount6"}, "v15": {"zaccount7": "zaccount5", "zfolder": "zfolder2"}, "v13": {"zaccount7": "zaccount4"},
    "v12": {"zaccount7": "ZACCOUNT3", "zcreationdate1": "zcreationdate"}, "v11": {"zaccount7": "zaccount", "zcreationdate1": "zcreationdate", "zmodificationdate1": "zmodificationdate"},
}


@query(
    f"SELECT layout, z_pk, zcreationdate1 AS created, zmodificationdate1 AS modified, zaccount7 AS account, zfolder AS folder FROM raw_objects, (VALUES {', '.join(f'({k!r})' for k in RENAMED)}) AS s(layout) WHERE z_ent = 3",
    "raw_objects",
)
def resolve_columns(d: Data) -> DataFrame:
    """The same notes from stores of several releases: one scan, read through each release's columns."""
    fields, found = ("created", "modified", "account", "folder"), []
    for layout, names in RENAMED.items():
        renamed = d.raw_objects.withColumnsRenamed(names)
        back = {new: old for old, new in names.items()}
        at = {f: stores.resolve(renamed, f) for f in fields}
        found.append(F.struct(F.lit(layout).alias("layout"), *[F.col(back.get(at[f], at[f])).alias(f) for f in fields]))
    return d.raw_objects.where("z_ent = 3").select("z_pk", F.inline(F.array(*found))).select("layout", "z_pk", *fields)


@query("SELECT z_pk, ztitle1 AS title FROM raw_objects WHERE z_ent = 3 UNION ALL SELECT z_pk, ztitle2 FROM raw_objects WHERE z_ent = 2", "raw_objects")
def resolve_by_data(d: Data) -> DataFrame:
    out = [d.raw_objects.where(F.col("z_ent") == e) for e in (3, 2)]
    a, b = [x.select("z_pk", F.col(stores.resolve_by_data(x)).alias("title")) for x in out]
    return a.unionByName(b)


@query("SELECT z_pk, coalesce(ztypeuti1, ztypeuti) AS type FROM raw_objects WHERE z_ent = 3", "raw_objects")
def coalesce_type(d: Data) -> DataFrame:
    return d.raw_objects.where("z_ent = 3").select("z_pk", stores.coalesce_type(d.raw_objects, "v15").alias("type"))


@query(f"SELECT z_pk AS account_id, zname AS name, CASE zaccounttype WHEN 0 THEN 'On My Mac' WHEN 1 THEN 'Exchange' WHEN 2 THEN 'IMAP' WHEN 4 THEN 'Google' ELSE 'iCloud' END AS account_type FROM raw_objects WHERE z_ent = 1 AND {LIVE}", "raw_objects")
def scan_accounts(d: Data) -> DataFrame:
    return stores.accounts(d.raw_objects, d.raw_entities)


@query(f"SELECT z_pk AS folder_id, ztitle2 AS name, zparent AS parent_id, zowner AS account_id FROM raw_objects WHERE z_ent = 2 AND {LIVE} AND ztitle2 IS NOT NULL", "raw_objects")
def scan_folders(d: Data) -> DataFrame:
    return stores.folders(d.raw_objects, d.raw_entities)


NOTE_COLS = f"z_pk AS note_id, {TITLE.format(t='ztitle1', c=TS.format(x='zcreationdate1'))} AS title, {TS.format(x='zcreationdate1')} AS created, {TS.format(x='zmodificationdate1')} AS modified"


@query(
    f"SELECT {NOTE_COLS}, zfolder AS folder_id, zaccount7 AS account_id, md5(zdata) AS body FROM raw_objects LEFT JOIN raw_bodies ON znote = z_pk WHERE z_ent = 3 AND {LIVE} AND coalesce(zispasswordprotected, 0) = 0",
    "raw_objects raw_bodies",
)
def scan_notes(d: Data) -> DataFrame:
    return stores.notes(d.raw_objects, d.raw_entities, d.raw_bodies).withColumn("body", F.md5("body"))


@query(
    f"SELECT {NOTE_COLS}, folder AS folder_id, zaccount7 AS account_id, md5(zdata) AS body FROM raw_objects JOIN raw_bodies ON znote = z_pk JOIN raw_bridge ON note = z_pk WHERE z_ent = 3 AND {LIVE} AND zdata IS NOT NULL",
    "raw_objects raw_bodies raw_bridge",
)
def scan_notes_bridge(d: Data) -> DataFrame:
    return stores.notes_bridge(d.raw_objects, d.raw_entities, d.raw_bodies, d.raw_bridge).withColumn("body", F.md5("body"))


OLD = f"""SELECT n.z_pk AS note_id, {TITLE.format(t="ztitle", c=TS.format(x="zcreationdate"))} AS title, {TS.format(x="zcreationdate")} AS created,
  {TS.format(x="zmodificationdate")} AS modified, zstore AS folder_id, zaccount AS account_id, md5(zcontent) AS body
  FROM old_note n JOIN old_body ON zowner = n.z_pk JOIN old_store s ON s.z_pk = zstore WHERE coalesce(zdeletedflag, 0) = 0"""


@query(OLD, "old_note old_body old_store")
def scan_notes_legacy(d: Data) -> DataFrame:
    return stores.notes_legacy(d.old_note, d.old_body, d.old_store).withColumn("body", F.md5("body"))


@query(
    f"{OLD} UNION ALL SELECT {NOTE_COLS}, zfolder, zaccount7, md5(zdata) FROM raw_objects LEFT JOIN raw_bodies ON znote = z_pk WHERE z_ent = 3 AND {LIVE} AND coalesce(zispasswordprotected, 0) = 0",
    "old_note old_body old_store raw_objects raw_bodies",
)
def scan_any_layout(d: Data) -> DataFrame:
    both = stores.union_layouts([_tables(d), {"note": d.old_note, "notebody": d.old_body, "store": d.old_store}])
    return both.withColumn("body", F.md5("body"))


@query("SELECT note_id, modified FROM notes WHERE modified BETWEEN TIMESTAMP '2024-01-01 03:00:00' AND TIMESTAMP '2024-01-01 12:00:00'", "notes")
def scan_range(d: Data) -> DataFrame:
    return X.in_range(d.notes, ts("2024-01-01 03:00:00"), ts("2024-01-01 12:00:00")).select("note_id", "modified")


@query(
    """SELECT attachment_id, a.note_id, type, a.filename, m.filename AS media_name, s.account_id, c.name AS account FROM attachments a LEFT JOIN media m USING (media_id)
    LEFT JOIN (SELECT *, note_id % 97 = 0 AS gone FROM notes_star) s ON s.note_id = a.note_id LEFT JOIN accounts c ON c.account_id = s.account_id WHERE NOT deleted AND NOT coalesce(gone, false)""",
    "attachments media notes_star accounts",
)
def scan_attachments(d: Data) -> DataFrame:
    notes = d.notes_star.withColumn("deleted", F.col("note_id") % 97 == 0)
    return stores.attachments(d.attachments, d.media, notes, d.accounts).select("attachment_id", "note_id", "type", "filename", "media_name", "account_id", "account")


@query(needs="")
def scan_media_listing(d: Data) -> DataFrame:
    """Files of the data folder with their sizes."""
    return stores.media_listing(d.spark, d.sf_dir, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("SELECT note_id, modified, path FROM manifest_prev", "manifest_prev")
def scan_manifest(d: Data) -> DataFrame:
    from quire.plans.io import scratch
    from quire.sources.sinks import write_manifest

    path = scratch(d.spark, "manifest")
    write_manifest(d.manifest_prev.select("note_id", "modified", "path"), path)
    return stores.manifest(d.spark, path)


@query(
    f"SELECT 'account' AS kind, count(*) AS n FROM raw_objects WHERE z_ent = 1 AND {LIVE} UNION ALL SELECT 'folder', count(*) FROM raw_objects WHERE z_ent = 2 AND {LIVE} AND ztitle2 IS NOT NULL"
    f" UNION ALL SELECT 'note', count(*) FROM raw_objects WHERE z_ent = 3 AND {LIVE} AND coalesce(zispasswordprotected, 0) = 0",
    "raw_objects",
)
def scan_catalog(d: Data) -> DataFrame:
    cat = Catalog.open(d.raw_objects, d.raw_entities, d.raw_bodies)
    one = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one(cat.accounts, "account").unionByName(one(cat.folders, "folder")).unionByName(one(cat.notes, "note"))


# Filters


@query("SELECT note_id, account_id FROM notes WHERE account_id IN (SELECT account_id FROM accounts WHERE contains(lower(name), 'ASI'.lower()))".replace("'ASI'.lower()", "'asi'"), "notes accounts")
def filter_account(d: Data) -> DataFrame:
    return X.by_name(d.notes, d.accounts, "account_id", "ASI").select("note_id", "account_id")


@query("SELECT note_id, folder_id FROM notes WHERE folder_id IN (SELECT folder_id FROM folders WHERE contains(lower(name), 'a'))", "notes folders")
def filter_folder(d: Data) -> DataFrame:
    return X.by_name(d.notes, d.folders, "folder_id", "a").select("note_id", "folder_id")


@query("SELECT note_id, account_id FROM notes WHERE account_id IN (SELECT account_id FROM accounts WHERE lower(name) = 'europe')", "notes accounts")
def filter_name_exact(d: Data) -> DataFrame:
    return X.by_exact_name(X.by_exact_name(d.notes, d.accounts, "account_id", "europe"), d.folders, "folder_id", "").select("note_id", "account_id")


@query("SELECT note_id, title FROM notes WHERE contains(lower(title), 'the')", "notes")
def filter_title(d: Data) -> DataFrame:
    return X.by_title(d.notes, "THE").select("note_id", "title")


@query("SELECT note_id, title FROM notes WHERE contains(lower(title), 'ther')", "notes")
def filter_title_indexed(d: Data) -> DataFrame:
    """The same kind of search through an index of three letters each."""
    from quire.plans.io import scratch
    from quire.sources import stored

    path = scratch(d.spark, "titles")
    stored.index_titles(d.notes, path)
    return stored.search_titles(d.notes, path, "THER").select("note_id", "title")


@query("SELECT n.note_id, n.account_id FROM notes n JOIN accounts a ON a.account_id = n.account_id WHERE lower(a.name) = 'europe'", "notes accounts")
def filter_name_collated(d: Data) -> DataFrame:
    return X.by_collated_name(d.notes, d.accounts, "account_id", "Europe").select("note_id", "account_id")


@query("SELECT note_id, modified FROM notes WHERE modified > TIMESTAMP '2024-01-01 02:00:00' AND modified < TIMESTAMP '2024-01-01 20:00:00'", "notes")
def filter_modified(d: Data) -> DataFrame:
    return X.between_strictly(d.notes, "modified", ts("2024-01-01 02:00:00"), ts("2024-01-01 20:00:00")).select("note_id", "modified")


@query("SELECT note_id, created FROM notes WHERE created > TIMESTAMP '2024-01-01 01:00:00'", "notes")
def filter_created(d: Data) -> DataFrame:
    return X.between_strictly(d.notes, "created", ts("2024-01-01 01:00:00")).select("note_id", "created")


@query("SELECT note_id, title FROM notes WHERE note_id IN (3, 14, 159)", "notes")
def filter_ids(d: Data) -> DataFrame:
    return X.by_ids(d.notes, "3, 14 ,159,").select("note_id", "title")


@query("SELECT note_id FROM notes WHERE NOT coalesce(deleted, false)", "notes")
def filter_live(d: Data) -> DataFrame:
    return X.live(d.notes).select("note_id")


@query("SELECT note_id FROM notes WHERE NOT coalesce(locked, false)", "notes")
def filter_unlocked(d: Data) -> DataFrame:
    return X.unlocked(d.notes).select("note_id")


@query("SELECT attachment_id, type FROM attachments WHERE NOT (starts_with(type, 'com.apple.notes.table') OR starts_with(type, 'com.apple.notes.inlinetextattachment') OR starts_with(type, 'public.url'))", "attachments")
def filter_file_attachments(d: Data) -> DataFrame:
    return X.file_attachments(d.attachments).select("attachment_id", "type")


@query("SELECT page_id FROM pages WHERE page_id % 3 <> 0 AND length(html) > 0")
def filter_has_data(d: Data) -> DataFrame:
    rows = d.pages.select("page_id", F.when(F.col("page_id") % 3 != 0, F.encode("html", "UTF-8")).alias("data"))
    return X.has_data(rows).select("page_id")


@query("SELECT note_id, status FROM export_log WHERE status = 'failed'", "export_log")
def filter_log(d: Data) -> DataFrame:
    return X.export_log(d.export_log, failed_only=True).select("note_id", "status")


# Projections


@query(f"SELECT note_id, {TITLE.format(t='title', c='created')} AS title FROM notes", "notes")
def project_title(d: Data) -> DataFrame:
    return d.notes.select("note_id", X.title("title", "created").alias("title"))


@query(f"SELECT z_pk, {TS.format(x='zcreationdate1')} AS created, zcreationdate1 AS back FROM raw_objects WHERE z_ent = 3", "raw_objects")
def project_epoch(d: Data) -> DataFrame:
    from quire.functions.dates import from_epoch, to_epoch

    rows = d.raw_objects.where("z_ent = 3").select("z_pk", from_epoch("zcreationdate1").alias("created"))
    return rows.withColumn("back", to_epoch("created"))


LIST = """SELECT n.note_id, n.title, n.created, n.modified, coalesce(f.name, 'Unknown') AS folder, coalesce(a.name, 'Unknown') AS account, coalesce(c.n, 0) AS attachment_count
  FROM notes_star n LEFT JOIN folders f ON f.folder_id = n.folder_id LEFT JOIN accounts a ON a.account_id = n.account_id LEFT JOIN (SELECT note_id, count(*) AS n FROM attachments GROUP BY note_id) c ON c.note_id = n.note_id"""


@query(LIST, "notes_star folders accounts attachments")
def project_note_row(d: Data) -> DataFrame:
    rows = joins.with_name(joins.with_name(d.notes_star, d.folders, "folder_id", "folder", "Unknown"), d.accounts, "account_id", "account", "Unknown")
    counts = d.attachments.groupBy("note_id").agg(F.count("*").alias("n"))
    return rows.join(counts, "note_id", "left").select("note_id", "title", "created", "modified", "folder", "account", F.coalesce("n", F.lit(0)).alias("attachment_count"))


@query("SELECT account_id, CASE account_type WHEN 0 THEN 'On My Mac' WHEN 1 THEN 'Exchange' WHEN 2 THEN 'IMAP' WHEN 4 THEN 'Google' ELSE 'iCloud' END AS kind FROM accounts", "accounts")
def project_account_type(d: Data) -> DataFrame:
    return d.accounts.select("account_id", X.account_type("account_type").alias("kind"))


@query("SELECT attachment_id, coalesce(filename, 'x' || attachment_id) AS name FROM attachments", "attachments")
def project_attachment_name(d: Data) -> DataFrame:
    ident = F.concat(F.lit("root/dir/x"), F.col("attachment_id").cast("string"))
    return d.attachments.select("attachment_id", X.attachment_name("filename", ident).alias("name"))


# Lookups and joins


@query("SELECT note_id, coalesce(a.name, 'Unknown') AS account FROM notes n LEFT JOIN accounts a ON a.account_id = n.account_id", "notes accounts")
def join_account_name(d: Data) -> DataFrame:
    return joins.with_name(d.notes, d.accounts, "account_id", "account", "Unknown").select("note_id", "account")


@query("SELECT note_id, coalesce(f.name, 'Unknown') AS folder FROM notes n LEFT JOIN folders f ON f.folder_id = n.folder_id + 2", "notes folders")
def join_folder_name(d: Data) -> DataFrame:
    notes = d.notes.withColumn("folder_id", F.col("folder_id") + 2)
    return joins.with_name(notes, d.folders, "folder_id", "folder", "Unknown").select("note_id", "folder")


@query("SELECT folder_id, f.name, parent_id, a.name AS account FROM folders f JOIN accounts a ON a.account_id = f.account_id WHERE contains(lower(a.name), 'a')", "folders accounts")
def join_folder_account(d: Data) -> DataFrame:
    some = X.by_name(d.folders, d.accounts, "account_id", "A")
    return joins.with_name(some, d.accounts, "account_id", "account", "Unknown Account").select("folder_id", "name", "parent_id", "account")


REFS = "refs AS (SELECT attachment_id, CASE WHEN attachment_id % 50 = 0 THEN note_id + 1 ELSE note_id END AS note_id FROM attachments)"


def _refs(d: Data) -> DataFrame:
    return d.attachments.select("attachment_id", F.when(F.col("attachment_id") % 50 == 0, F.col("note_id") + 1).otherwise(F.col("note_id")).alias("note_id"))


@query(f"WITH {REFS} SELECT r.attachment_id, r.note_id FROM refs r WHERE EXISTS (SELECT 1 FROM attachments a WHERE a.attachment_id = r.attachment_id AND a.note_id = r.note_id AND NOT a.deleted)", "attachments")
def join_attachment_owner(d: Data) -> DataFrame:
    return joins.owned(_refs(d), d.attachments)


@query(f"WITH {REFS} SELECT r.attachment_id, r.note_id FROM refs r WHERE EXISTS (SELECT 1 FROM attachments a WHERE a.attachment_id = r.attachment_id AND a.note_id = r.note_id AND NOT a.deleted)", "attachments")
def join_attachment_owner_stored(d: Data) -> DataFrame:
    """Both sides stored by attachment, and joined as they lie."""
    from quire.sources import stored

    refs = stored.store(_refs(d), "attachment_id", 8)
    return stored.owned(refs, stored.store(d.attachments.select("attachment_id", "note_id", "deleted"), "attachment_id", 8))


META = f"WITH {REFS} SELECT r.attachment_id, a.type, coalesce(m.filename, a.filename) AS filename FROM refs r LEFT JOIN attachments a ON a.attachment_id = r.attachment_id LEFT JOIN media m ON m.media_id = a.media_id"


@query(META, "attachments media")
def join_attachment_meta(d: Data) -> DataFrame:
    return joins.attachment_meta(_refs(d), d.attachments, d.media).select("attachment_id", "type", "filename")


@query("SELECT attachment_id, a.media_id, m.filename AS media_name, height, width FROM attachments a LEFT JOIN media m ON m.media_id = a.media_id", "attachments media")
def join_media_chain(d: Data) -> DataFrame:
    return d.attachments.join(d.media.select("media_id", F.col("filename").alias("media_name"), "height", "width"), "media_id", "left").select("attachment_id", "media_id", "media_name", "height", "width")


@query("SELECT attachment_id, coalesce(CASE WHEN a.media_id % 2 = 0 THEN m.filename END, a.filename) AS filename FROM attachments a LEFT JOIN media m ON m.media_id = a.media_id", "attachments media")
def join_filename(d: Data) -> DataFrame:
    media = d.media.withColumn("filename", F.when(F.col("media_id") % 2 == 0, F.col("filename")))
    return joins.attachment_meta(d.attachments.select("attachment_id"), d.attachments, media).select("attachment_id", "filename")


GAL = """SELECT g.attachment_id AS gallery_id, c.attachment_id AS child_id, c.type AS child_type FROM attachments g JOIN attachments c ON c.note_id = g.note_id
  WHERE g.type = 'com.apple.notes.gallery' AND c.type = 'public.jpeg' AND g.seq = (SELECT min(seq) FROM attachments h WHERE h.note_id = g.note_id AND h.type = g.type)"""


def _galleries(d: Data) -> tuple[DataFrame, DataFrame]:
    galleries = d.attachments.where("type = 'com.apple.notes.gallery'").groupBy("note_id").agg(F.min_by("attachment_id", "seq").alias("attachment_id"))
    kids = d.attachments.where("type = 'public.jpeg'").join(galleries.select("note_id", F.col("attachment_id").alias("parent_id")), "note_id")
    return galleries, kids


@query(GAL, "attachments")
def join_gallery_children(d: Data) -> DataFrame:
    return joins.gallery_children(*_galleries(d))


@query(
    """SELECT attachment_id, CASE WHEN kind IN ('inline_mention', 'inline_link') AND token IS NOT NULL THEN coalesce(alt, '') || ' [' || token || ']' ELSE coalesce(alt, '') END AS text FROM (SELECT attachment_id,
    CASE attachment_id % 3 WHEN 0 THEN 'inline_hashtag' WHEN 1 THEN 'inline_mention' ELSE 'inline_link' END AS kind, CASE WHEN attachment_id % 5 <> 0 THEN filename END AS alt,
    CASE WHEN attachment_id % 5 <> 0 AND attachment_id % 7 <> 0 THEN 't' || attachment_id END AS token FROM attachments WHERE type = 'com.apple.notes.inlinetextattachment.hashtag')""",
    "attachments",
)
def join_inline_text(d: Data) -> DataFrame:
    rows = d.attachments.where("type = 'com.apple.notes.inlinetextattachment.hashtag'")
    kinds = rows.selectExpr("attachment_id", "CASE attachment_id % 3 WHEN 0 THEN 'inline_hashtag' WHEN 1 THEN 'inline_mention' ELSE 'inline_link' END AS type")
    inline = rows.where("attachment_id % 5 <> 0").selectExpr("attachment_id", "filename AS alt_text", "CASE WHEN attachment_id % 7 <> 0 THEN 't' || attachment_id END AS token")
    return joins.inline_text(kinds, inline).select("attachment_id", "text")


@query(
    """SELECT attachment_id, url, CASE WHEN url IS NULL THEN '[URL]' ELSE coalesce(title, alt, url) END AS label FROM (SELECT a.attachment_id, p.url, CASE WHEN p.page_id % 2 = 0 THEN 'Page ' || p.page_id END AS title,
    CASE WHEN p.page_id % 3 = 0 THEN 'alt' END AS alt FROM attachments a LEFT JOIN pages p ON p.page_id = a.media_id WHERE a.type = 'public.url')""",
    "attachments",
)
def join_url_card(d: Data) -> DataFrame:
    refs = d.attachments.where("type = 'public.url'").select("attachment_id", "media_id")
    cards = refs.join(d.pages, refs.media_id == d.pages.page_id).selectExpr("attachment_id", "url", "CASE WHEN page_id % 2 = 0 THEN 'Page ' || page_id END AS card_title", "CASE WHEN page_id % 3 = 0 THEN 'alt' END AS alt_text")
    return joins.url_card(refs, cards).select("attachment_id", "url", "label")


@query("SELECT a.attachment_id, m.filename AS user_title FROM attachments a LEFT JOIN media m ON m.media_id = a.media_id AND m.media_id % 2 = 0", "attachments media")
def join_user_title(d: Data) -> DataFrame:
    titles = d.media.where("media_id % 2 = 0").select("media_id", F.col("filename").alias("user_title"))
    return d.attachments.join(titles, "media_id", "left").select("attachment_id", "user_title")


CAND = """near AS (SELECT w.file_id, t * 6 + 2 * e + g AS priority, CASE t WHEN 0 THEN 'Accounts/' || account || '/' ELSE '' END || 'FallbackImages/' || w.file_id ||
    CASE g WHEN 0 THEN '.' || ext ELSE '/' || generation || '/FallbackImage.' || ext END AS path FROM wanted w, (VALUES (0, 'jpeg'), (1, 'png'), (2, 'jpg')) x(e, ext), (VALUES (0), (1)) y(t), (VALUES (0), (1)) z(g)
    WHERE g = 0 OR generation <> ''),
  far AS (SELECT w.file_id, 1000 AS priority, l.path FROM wanted w JOIN listing l ON regexp_extract(l.path, 'FallbackImages/([^./]+)', 1) = CAST(w.file_id AS VARCHAR)
    WHERE regexp_extract(l.path, '^Accounts/([^/]+)/FallbackImages/', 1) NOT IN ('', w.account))"""


@query(f"WITH {CAND} SELECT file_id, priority, path FROM near", "wanted")
def join_media_candidates(d: Data) -> DataFrame:
    return joins.media_candidates(d.wanted).select("file_id", "priority", "path")


@query(
    f"WITH {CAND} SELECT file_id, path FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY priority, path) AS r FROM (SELECT * FROM near WHERE path IN (SELECT path FROM listing) UNION ALL SELECT * FROM far)) WHERE r = 1",
    "wanted listing",
)
def pick_first_path(d: Data) -> DataFrame:
    return joins.first_path(d.wanted, d.listing)


@query(
    f"""WITH g AS ({GAL}), w AS (SELECT attachment_id, 'out/' || attachment_id AS path FROM attachments WHERE type IN ('public.jpeg', 'com.adobe.pdf'))
    SELECT a.attachment_id, coalesce(w.path, k.path) AS path FROM attachments a LEFT JOIN w ON w.attachment_id = a.attachment_id
    LEFT JOIN (SELECT gallery_id, arg_min(w.path, child_id) AS path FROM g JOIN w ON w.attachment_id = child_id GROUP BY gallery_id) k ON k.gallery_id = a.attachment_id""",
    "attachments",
)
def join_note_attachment_paths(d: Data) -> DataFrame:
    written = d.attachments.where("type IN ('public.jpeg', 'com.adobe.pdf')").selectExpr("attachment_id", "'out/' || attachment_id AS path")
    return joins.attachment_paths(d.attachments.select("attachment_id"), written, joins.gallery_children(*_galleries(d)))


# Flagship listing


@query(
    f"""WITH RECURSIVE t(folder_id, path) AS (SELECT folder_id, name FROM folders WHERE parent_id IS NULL UNION ALL SELECT f.folder_id, t.path || '/' || f.name FROM folders f JOIN t ON f.parent_id = t.folder_id)
    SELECT n.note_id, n.title, n.modified, t.path AS folder_path, a.name AS account, coalesce(c.n, 0) AS attachment_count FROM notes_star n LEFT JOIN t ON t.folder_id = n.folder_id JOIN accounts a ON a.account_id = n.account_id
    LEFT JOIN (SELECT note_id, count(*) AS n FROM attachments WHERE NOT deleted GROUP BY note_id) c ON c.note_id = n.note_id
    WHERE contains(lower(a.name), 'a') AND contains(lower(n.title), 'urgent') AND n.modified > {T0.replace("2024", "1994")}""",
    "notes_star folders accounts attachments",
)
def list_notes(d: Data) -> DataFrame:
    """Listing by account, title and change, with folder path, account and attachments, newest first."""
    some = X.between_strictly(X.by_title(X.by_name(d.notes_star, d.accounts, "account_id", "a"), "urgent"), "modified", ts("1994-01-01 00:00:00"))
    named = joins.with_name(some, d.accounts, "account_id", "account", "Unknown").join(hierarchy.paths(d.folders).withColumnRenamed("path", "folder_path"), "folder_id", "left")
    counts = X.live(d.attachments).groupBy("note_id").agg(F.count("*").alias("n"))
    rows = named.join(counts, "note_id", "left").withColumn("attachment_count", F.coalesce("n", F.lit(0)))
    return paths.sorted_notes(rows, "modified").select("note_id", "title", "modified", "folder_path", "account", "attachment_count")
