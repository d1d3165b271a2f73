"""Queries of aggregates, windows, sorts, set and recursive operators, and sync."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.strings import sanitize_drop
from quire.operators import forest, hierarchy, joins, paths, sync
from quire.plans.base import Data, query
from quire.plans.io import scratch
from quire.plans.scans import _galleries

CLOSURE = """clo(ancestor_id, folder_id, depth, path) AS (SELECT folder_id, folder_id, 0, name FROM folders UNION ALL
  SELECT c.ancestor_id, f.folder_id, c.depth + 1, c.path || '/' || f.name FROM clo c JOIN folders f ON f.parent_id = c.folder_id)"""
ROLL = f"""WITH RECURSIVE {CLOSURE}, roll AS (SELECT c.ancestor_id AS folder_id, count(n.note_id) AS total, max(n.modified) AS latest, min(n.created) AS earliest
  FROM clo c LEFT JOIN notes_star n ON n.folder_id = c.folder_id GROUP BY c.ancestor_id)"""


def _roll(d: Data) -> DataFrame:
    return hierarchy.rollup(hierarchy.closure(d.folders), d.notes_star)


@query(f"{ROLL} SELECT folder_id, total FROM roll", "folders notes_star")
def agg_folder_total(d: Data) -> DataFrame:
    return _roll(d).select("folder_id", "total")


@query(f"{ROLL} SELECT folder_id, latest FROM roll", "folders notes_star")
def agg_folder_latest(d: Data) -> DataFrame:
    return _roll(d).select("folder_id", "latest")


@query(f"{ROLL} SELECT folder_id, earliest FROM roll", "folders notes_star")
def agg_folder_earliest(d: Data) -> DataFrame:
    return _roll(d).select("folder_id", "earliest")


@query(
    """WITH RECURSIVE f2 AS (SELECT folder_id, 'N' || (folder_id // 10) AS name, parent_id, account_id FROM folders), t(folder_id, account_id, path) AS (SELECT folder_id, account_id, name FROM f2 WHERE parent_id IS NULL
    UNION ALL SELECT f.folder_id, f.account_id, t.path || '/' || f.name FROM f2 f JOIN t ON f.parent_id = t.folder_id)
    SELECT t.account_id, path, min(t.folder_id) AS folder_id, count(DISTINCT t.folder_id) AS merged, count(n.note_id) AS notes FROM t LEFT JOIN notes_star n ON n.folder_id = t.folder_id GROUP BY t.account_id, path""",
    "folders notes_star",
)
def agg_merge_folders(d: Data) -> DataFrame:
    alike = d.folders.withColumn("name", F.concat(F.lit("N"), F.floor(F.col("folder_id") / 10).cast("string")))
    return hierarchy.merge_namesakes(alike, d.notes_star)


PLACED = f"""WITH RECURSIVE {CLOSURE}, p AS (SELECT c.folder_id, c.path FROM clo c JOIN folders f ON f.folder_id = c.ancestor_id WHERE f.parent_id IS NULL),
  placed AS (SELECT n.*, a.name AS account, p.path AS folder_path FROM notes_star n JOIN p ON p.folder_id = n.folder_id JOIN accounts a ON a.account_id = n.account_id)"""


def _placed(d: Data, notes: DataFrame | None = None) -> DataFrame:
    rows = joins.with_name(d.notes_star if notes is None else notes, d.accounts, "account_id", "account", "Unknown Account")
    return rows.join(hierarchy.paths(d.folders).withColumnRenamed("path", "folder_path"), "folder_id")


@query(f"{PLACED} SELECT account, folder_path, count(*) AS notes, min(note_id) AS first_id FROM placed GROUP BY account, folder_path", "folders accounts notes_star")
def agg_group_layout(d: Data) -> DataFrame:
    return _placed(d).groupBy("account", "folder_path").agg(F.count("*").alias("notes"), F.min("note_id").alias("first_id"))


@query(f"{PLACED} SELECT account, folder_path, min(created) AS created, max(modified) AS modified FROM placed GROUP BY GROUPING SETS ((account, folder_path), (account))", "folders accounts notes_star")
def agg_dir_times(d: Data) -> DataFrame:
    rows = _placed(d)
    sets = [[F.col("account"), F.col("folder_path")], [F.col("account")]]
    return rows.groupingSets(sets, "account", "folder_path").agg(F.min("created").alias("created"), F.max("modified").alias("modified")).select("account", "folder_path", "created", "modified")


@query(
    """SELECT count(*) FILTER (status = 'completed') AS exported, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, CAST(sum(failed_attachments) AS BIGINT) AS failed_attachments,
    count(*) FILTER (status = 'failed') = 0 AS success FROM export_log""",
    "export_log",
)
def agg_export_stats_observed(d: Data) -> DataFrame:
    """The same, taken while the log is written."""
    from quire.sources.sinks import write_observed

    seen = write_observed(d.export_log, scratch(d.spark, "log"), **sync.stat_columns())
    return d.spark.createDataFrame([tuple(seen[k] for k in sync.stat_columns())], "exported long, failed long, skipped long, failed_attachments long, success boolean")


@query(
    """SELECT count(*) FILTER (status = 'completed') AS exported, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, CAST(sum(failed_attachments) AS BIGINT) AS failed_attachments,
    count(*) FILTER (status = 'failed') = 0 AS success FROM export_log""",
    "export_log",
)
def agg_export_stats(d: Data) -> DataFrame:
    return sync.run_stats(d.export_log)


@query("SELECT n.note_id, count(a.attachment_id) AS attachments, count(a.attachment_id) > 0 AS has_attachments FROM notes_star n LEFT JOIN attachments a ON a.note_id = n.note_id GROUP BY n.note_id", "notes_star attachments")
def agg_attachment_count(d: Data) -> DataFrame:
    counts = d.attachments.groupBy("note_id").agg(F.count("*").alias("attachments"))
    rows = d.notes_star.select("note_id").join(counts, "note_id", "left").fillna(0, ["attachments"])
    return rows.withColumn("has_attachments", F.col("attachments") > 0)


@query("SELECT count(*) > 0 AS found, max(modified) AS last_sync, count(*) AS tracked FROM manifest_prev", "manifest_prev")
def agg_sync_status(d: Data) -> DataFrame:
    return sync.status(d.manifest_prev)


@query("SELECT 'accounts' AS kind, count(*) AS n FROM accounts UNION ALL SELECT 'folders', count(*) FROM folders UNION ALL SELECT 'notes', count(*) FROM notes_star UNION ALL SELECT 'attachments', count(*) FROM attachments", "accounts folders notes_star attachments")
def agg_totals(d: Data) -> DataFrame:
    parts = [getattr(d, t).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, t in (("accounts", "accounts"), ("folders", "folders"), ("notes", "notes_star"), ("attachments", "attachments"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT note_id, list_sort(list_distinct(list(split_part(filename, '.', 2)))) AS exts FROM attachments WHERE filename IS NOT NULL GROUP BY note_id", "attachments")
def agg_distinct_ext(d: Data) -> DataFrame:
    return d.attachments.where("filename IS NOT NULL").groupBy("note_id").agg(F.sort_array(F.collect_set(F.split_part("filename", F.lit("."), F.lit(2)))).alias("exts"))


# Windows

CLEAN = "regexp_replace(title, '[\\\\/:*?\"<>|\\x00-\\x1f\\x7f-\\x9f]', '', 'g')"


def _alloc_sql(base: str, taken: str, own: str) -> str:
    """Paths by trying numbers: of all from 2 on that could be needed, those not taken, in order. ``taken``: SQL of
    (folder_path, name) that were given out before, ``own``: of (note_id, path) that notes keep."""
    number = "TRY_CAST(regexp_extract(name, '^(.*) \\(([2-9]|[1-9][0-9]+)\\)$', 2) AS BIGINT)"
    return f"""WITH mine AS ({own}), given AS ({taken}),
  b AS (SELECT note_id, 'F' || folder_id AS folder_path, {base} AS base, created FROM notes WHERE note_id NOT IN (SELECT note_id FROM mine)),
  r AS (SELECT b.*, row_number() OVER (PARTITION BY folder_path, base ORDER BY created, note_id) + CASE WHEN (folder_path, base) IN (SELECT (folder_path, name) FROM given) THEN 1 ELSE 0 END AS r FROM b),
  names AS (SELECT folder_path, name, {number} AS k, regexp_extract(name, '^(.*) \\(([2-9]|[1-9][0-9]+)\\)$', 1) AS stem FROM (SELECT folder_path, base AS name FROM b UNION SELECT folder_path, name FROM given)),
  stems AS (SELECT folder_path, base, max(r) AS most, (SELECT count(*) FROM names n WHERE n.folder_path = r.folder_path AND n.stem = r.base AND n.k IS NOT NULL) AS used FROM r GROUP BY folder_path, base HAVING max(r) > 1),
  tried AS (SELECT folder_path, base, CAST(unnest(range(2, most + used + 1)) AS BIGINT) AS k FROM stems),
  free AS (SELECT *, row_number() OVER (PARTITION BY folder_path, base ORDER BY k) + 1 AS r FROM tried t WHERE NOT EXISTS (SELECT 1 FROM names n WHERE n.folder_path = t.folder_path AND n.stem = t.base AND n.k = t.k))
  SELECT note_id, path AS rel_path FROM mine WHERE note_id IN (SELECT note_id FROM notes)
  UNION ALL SELECT note_id, r.folder_path || '/' || r.base || CASE WHEN r.r = 1 THEN '' ELSE ' (' || f.k || ')' END || '.md' FROM r LEFT JOIN free f ON f.folder_path = r.folder_path AND f.base = r.base AND f.r = r.r"""


ALLOC = _alloc_sql(CLEAN, "SELECT '' AS folder_path, '' AS name WHERE false", "SELECT CAST(0 AS BIGINT) AS note_id, '' AS path WHERE false")


@query(ALLOC, "notes")
def alloc_note_paths(d: Data) -> DataFrame:
    rows = d.notes.select("note_id", F.concat(F.lit("F"), F.col("folder_id").cast("string")).alias("folder_path"), sanitize_drop("title").alias("base"), "created")
    return paths.allocate(rows).select("note_id", "rel_path")


SHORT = "strftime(created, '%Y-%m') || ' ' || upper(substr(regexp_replace(title, '[^A-Za-z]', '', 'g'), 1, 1))"
GIVEN = f"""SELECT CASE WHEN note_id % 10 = 3 THEN note_id ELSE note_id + 1000000 END AS note_id, 'F' || folder_id || '/' || {SHORT} || CASE WHEN note_id % 10 = 3 THEN '' ELSE ' (' || (2 + note_id % 4) || ')' END || '.md' AS path
  FROM notes WHERE note_id % 10 IN (3, 7)"""
FIRST_GIVEN = f"SELECT min(note_id) AS note_id, path FROM ({GIVEN}) GROUP BY path"


@query(_alloc_sql(SHORT, f"SELECT split_part(path, '/', 1) AS folder_path, left(split_part(path, '/', 2), -3) AS name FROM ({FIRST_GIVEN})", f"SELECT * FROM ({FIRST_GIVEN})"), "notes")
def alloc_reserved_paths(d: Data) -> DataFrame:
    """Short names behind a date, with paths that an earlier run gave out."""
    short = F.upper(F.substring(F.regexp_replace("title", "[^A-Za-z]", ""), 1, 1))
    rows = d.notes.select("note_id", F.concat(F.lit("F"), F.col("folder_id").cast("string")).alias("folder_path"), short.alias("base"), "created")
    known = F.col("note_id") % 10 == 3
    name = F.concat("folder_path", F.lit("/"), F.date_format("created", "yyyy-MM"), F.lit(" "), "base", F.when(known, "").otherwise(F.concat(F.lit(" ("), (2 + F.col("note_id") % 4).cast("string"), F.lit(")"))), F.lit(".md"))
    given = rows.where("note_id % 10 IN (3, 7)").select(F.when(known, F.col("note_id")).otherwise(F.col("note_id") + 1_000_000).alias("note_id"), name.alias("path"))
    return paths.allocate(rows, reserved=given, date_prefix="yyyy-MM").select("note_id", "rel_path")


@query(
    """SELECT attachment_id, CASE WHEN r = 1 THEN filename ELSE regexp_extract(filename, '^(.+)\\.([^.]*)$', 1) || ' (' || r || ').' || regexp_extract(filename, '^(.+)\\.([^.]*)$', 2) END AS out_name
    FROM (SELECT *, row_number() OVER (PARTITION BY note_id, filename ORDER BY seq) AS r FROM attachments WHERE filename IS NOT NULL)""",
    "attachments",
)
def alloc_attachment_names(d: Data) -> DataFrame:
    return paths.attachment_names(d.attachments.where("filename IS NOT NULL")).select("attachment_id", "out_name")


@query("SELECT media_id, attachment_id, filename FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY attachment_id) AS r FROM attachments) WHERE r = 1", "attachments")
def dedupe_first_id(d: Data) -> DataFrame:
    return paths.first_by_id(d.attachments, "media_id", "attachment_id").select("media_id", "attachment_id", "filename")


RUNS = """m AS (SELECT note_id, min(seq) AS seq, min(style) AS style, CAST(sum(length) AS BIGINT) AS length, count(*) AS merged FROM (SELECT *, sum(new) OVER (PARTITION BY note_id ORDER BY seq) AS g FROM (
  SELECT *, CASE WHEN style = lag(style) OVER (PARTITION BY note_id ORDER BY seq) THEN 0 ELSE 1 END AS new FROM runs)) GROUP BY note_id, g)"""


@query(f"WITH {RUNS} SELECT * FROM m", "runs")
def merge_runs(d: Data) -> DataFrame:
    return paths.merge_runs(d.runs)


@query(
    f"""WITH {RUNS}, o AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY note_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM m)
    SELECT note_id, seq, length, least(s, 500) AS start, least(s + length, 500) AS "end" FROM o""",
    "runs",
)
def run_offsets(d: Data) -> DataFrame:
    rows = paths.merge_runs(d.runs).withColumn("n", F.lit(500).cast("long"))
    return paths.run_offsets(rows, "n").select("note_id", "seq", "length", "start", "end")


# Sorts


@query("SELECT note_id, title, row_number() OVER (ORDER BY lower(title) NULLS LAST, note_id) AS place FROM notes", "notes")
def sort_notes(d: Data) -> DataFrame:
    """The sort itself is distributed; places are added for comparison."""
    rows = paths.sorted_notes(d.notes.select("note_id", "title"), "name").select("note_id", "title")
    return _placed_rows(rows)


def _placed_rows(rows: DataFrame) -> DataFrame:
    """Positions of a sorted table: partition sizes are added up (one number each), rows stay where they are."""
    tagged = rows.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33).cast("int")).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    path = scratch(rows.sparkSession, "sorted")
    tagged.write.parquet(path)
    tagged, before, total = rows.sparkSession.read.schema(tagged.schema).parquet(path), {}, 0
    for p, n in sorted(tagged.groupBy("_p").count().collect()):
        before[p], total = total, total + n
    starts = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    return tagged.withColumn("place", (F.element_at(starts, F.col("_p")) + F.col("_i") + 1).cast("long")).drop("_m", "_p", "_i")


@query(f"{ROLL} SELECT r.folder_id, name, latest FROM roll r JOIN folders f ON f.folder_id = r.folder_id ORDER BY latest DESC NULLS LAST, r.folder_id", "folders notes_star")
def sort_folders(d: Data) -> DataFrame:
    return hierarchy.sorted_folders(_roll(d).join(d.folders.select("folder_id", "name"), "folder_id"), "modified").select("folder_id", "name", "latest")


@query("SELECT note_id, arg_min(media_id, (height * width, media_id)) AS smallest, arg_max(media_id, (height * width, media_id)) AS largest FROM attachments JOIN media USING (media_id) GROUP BY note_id", "attachments media")
def sort_thumbnails(d: Data) -> DataFrame:
    area = F.struct(F.col("height") * F.col("width"), F.col("media_id"))
    rows = d.attachments.join(d.media.drop("filename"), "media_id")
    return rows.groupBy("note_id").agg(F.min_by("media_id", area).alias("smallest"), F.max_by("media_id", area).alias("largest"))


@query(
    """SELECT g.attachment_id AS gallery_id, list(c.attachment_id ORDER BY c.attachment_id) AS children FROM attachments g JOIN attachments c ON c.note_id = g.note_id WHERE g.type = 'com.apple.notes.gallery' AND c.type = 'public.jpeg'
    AND g.seq = (SELECT min(seq) FROM attachments h WHERE h.note_id = g.note_id AND h.type = g.type) GROUP BY g.attachment_id""",
    "attachments",
)
def sort_gallery(d: Data) -> DataFrame:
    kids = joins.gallery_children(*_galleries(d))
    return kids.groupBy("gallery_id").agg(F.sort_array(F.collect_list("child_id")).alias("children"))


GONE = "gone AS (SELECT path FROM manifest_prev WHERE note_id NOT IN (SELECT note_id FROM notes)), kept AS (SELECT path FROM manifest_prev WHERE note_id IN (SELECT note_id FROM notes))"


def _delete_list(d: Data) -> DataFrame:
    return sync.delete_list(sync.gone(d.notes, d.manifest_prev).select("path"), sync.kept(d.notes, d.manifest_prev).where("path LIKE 'x%'").select("path"))


@query(f"WITH {GONE} SELECT path, 'file' AS kind, 2 AS depth FROM gone UNION ALL SELECT DISTINCT 'old', 'directory', 1 FROM gone", "manifest_prev")
def sort_dirs_deepest(d: Data) -> DataFrame:
    """With no survivor below ``old`` the directory goes too, after its files."""
    return _delete_list(d).orderBy(F.desc("depth"), "path")


@query("SELECT EXISTS (SELECT 1 FROM notes WHERE locked) AS any_locked", "notes")
def limit_probe(d: Data) -> DataFrame:
    return d.notes.agg(F.coalesce(F.bool_or("locked"), F.lit(False)).alias("any_locked"))


# Sets and recursion


@query(f"WITH RECURSIVE {CLOSURE} SELECT c.folder_id, c.path FROM clo c JOIN folders f ON f.folder_id = c.ancestor_id WHERE f.parent_id IS NULL", "folders")
def folder_path(d: Data) -> DataFrame:
    return hierarchy.paths(d.folders)


@query(f"WITH RECURSIVE {CLOSURE} SELECT ancestor_id, folder_id, depth, path FROM clo", "folders")
def folder_closure(d: Data) -> DataFrame:
    return hierarchy.closure(d.folders)


@query("SELECT folder_id, name FROM folders WHERE parent_id IS NULL", "folders")
def folder_roots(d: Data) -> DataFrame:
    return hierarchy.roots(d.folders).select("folder_id", "name")


@query(
    f"""WITH RECURSIVE {CLOSURE}, chosen AS (SELECT DISTINCT folder_id FROM clo WHERE ancestor_id IN (1, 2)), off AS (SELECT DISTINCT folder_id FROM clo WHERE ancestor_id = 12),
    kept AS (SELECT folder_id FROM chosen WHERE folder_id NOT IN (SELECT folder_id FROM off)), sw AS (SELECT DISTINCT folder_id FROM clo WHERE ancestor_id IN (6, 8))
    SELECT folder_id FROM kept WHERE folder_id NOT IN (SELECT folder_id FROM sw) UNION ALL SELECT folder_id FROM sw WHERE folder_id NOT IN (SELECT folder_id FROM kept)""",
    "folders",
)
def select_subtree(d: Data) -> DataFrame:
    """Select two folders, deselect one below, toggle two more, always with all below."""
    tree = hierarchy.closure(d.folders)
    pick = lambda *ids: d.folders.where(F.col("folder_id").isin(*ids))
    chosen = hierarchy.deselect(hierarchy.subtree(tree, pick(1, 2)), tree, pick(12))
    return hierarchy.toggle(chosen, tree, pick(6, 8))


TOUR = f"""WITH RECURSIVE {CLOSURE}, r(folder_id, parent_id, depth, way) AS (SELECT folder_id, parent_id, 0, lpad(CAST(folder_id AS VARCHAR), 9, '0') FROM folders WHERE parent_id IS NULL
  UNION ALL SELECT f.folder_id, f.parent_id, r.depth + 1, r.way || '/' || lpad(CAST(f.folder_id AS VARCHAR), 9, '0') FROM r JOIN folders f ON f.parent_id = r.folder_id),
  t AS (SELECT folder_id, parent_id, CAST(depth AS BIGINT) AS depth, row_number() OVER (ORDER BY way) - 1 AS pre FROM r)"""


@query(f"{TOUR} SELECT folder_id, depth, pre, pre + (SELECT count(*) FROM clo c WHERE c.ancestor_id = t.folder_id) - 1 AS last FROM t", "folders")
def tree_intervals(d: Data) -> DataFrame:
    return forest.tour(d.folders).drop("parent_id")


@query(f"{ROLL} SELECT * FROM roll", "folders notes_star")
def agg_folder_any_depth(d: Data) -> DataFrame:
    """All three rollups without a closure."""
    kept = {"total": forest.Carried(F.lit(1)), "latest": forest.Carried(F.col("modified"), "max"), "earliest": forest.Carried(F.col("created"), "min")}
    return forest.totals(d.folders, d.notes_star, kept)


@query(f"WITH RECURSIVE {CLOSURE} SELECT DISTINCT folder_id FROM clo WHERE ancestor_id IN (1, 6, 8, 12)", "folders")
def select_subtree_intervals(d: Data) -> DataFrame:
    return forest.subtrees(forest.tour(d.folders), d.folders.where("folder_id IN (1, 6, 8, 12)"))


# Sync

DIFF = """d AS (SELECT n.note_id, n.modified, m.path, CASE WHEN m.note_id IS NULL THEN 'new' WHEN epoch_us(n.modified) - epoch_us(m.modified) > 1000 THEN 'changed' ELSE 'unchanged' END AS status
  FROM notes n LEFT JOIN manifest_prev m ON m.note_id = n.note_id)"""


@query(f"WITH {DIFF} SELECT note_id, status FROM d", "manifest_prev")
def join_sync_diff(d: Data) -> DataFrame:
    return sync.diff(d.notes, d.manifest_prev).select("note_id", "status")


@query("SELECT note_id, path FROM manifest_prev WHERE note_id NOT IN (SELECT note_id FROM notes)", "manifest_prev")
def join_sync_deleted(d: Data) -> DataFrame:
    return sync.gone(d.notes, d.manifest_prev).select("note_id", "path")


@query(f"WITH {DIFF} SELECT note_id, status, modified, path FROM d UNION ALL SELECT note_id, 'deleted', modified, path FROM manifest_prev WHERE note_id NOT IN (SELECT note_id FROM notes)", "manifest_prev")
def sync_plan(d: Data) -> DataFrame:
    return sync.plan(d.notes, d.manifest_prev)


APPLIED = f"WITH {DIFF} SELECT n.note_id, CASE WHEN d.status = 'unchanged' THEN m.modified ELSE n.modified END AS modified, coalesce(m.path, a.path) AS path FROM notes n JOIN d ON d.note_id = n.note_id LEFT JOIN manifest_prev m ON m.note_id = n.note_id JOIN allocated a ON a.note_id = n.note_id"


@query(APPLIED, "manifest_prev allocated")
def sync_apply(d: Data) -> DataFrame:
    return sync.apply(d.notes, d.manifest_prev, d.allocated).select("note_id", "modified", "path")


@query("SELECT note_id, modified, path FROM manifest_prev WHERE note_id IN (SELECT note_id FROM notes)", "manifest_prev")
def sync_noop(d: Data) -> DataFrame:
    """Nothing is newer than the manifest: what is gone is still pruned."""
    stale = d.notes.withColumn("modified", F.expr("modified - INTERVAL '1' DAY"))
    known = stale.join(d.manifest_prev.select("note_id"), "note_id", "left_semi")
    return sync.apply(known, d.manifest_prev, d.allocated).select("note_id", "modified", "path")


@query("SELECT n.note_id, n.modified, a.path FROM notes n JOIN allocated a ON a.note_id = n.note_id", "manifest_prev allocated")
def sync_reset(d: Data) -> DataFrame:
    """From the empty state everything is new."""
    return sync.apply(d.notes, d.manifest_prev.limit(0), d.allocated).select("note_id", "modified", "path")


@query(f"WITH {GONE} SELECT path, 'file' AS kind, 2 AS depth FROM gone UNION ALL SELECT DISTINCT 'old', 'directory', 1 FROM gone WHERE NOT EXISTS (SELECT 1 FROM kept)", "manifest_prev")
def sync_delete_files(d: Data) -> DataFrame:
    return sync.delete_list(sync.gone(d.notes, d.manifest_prev).select("path"), sync.kept(d.notes, d.manifest_prev).select("path"))


@query("SELECT note_id, modified, path FROM manifest_prev WHERE note_id NOT IN (SELECT note_id FROM notes WHERE note_id % 3 = 0) UNION ALL SELECT n.note_id, n.modified, a.path FROM notes n JOIN allocated a ON a.note_id = n.note_id WHERE n.note_id % 3 = 0", "manifest_prev allocated")
def set_sync_upsert(d: Data) -> DataFrame:
    exported = d.notes.where("note_id % 3 = 0").select("note_id", "modified").join(d.allocated, "note_id")
    return sync.upsert(d.manifest_prev.select("note_id", "modified", "path"), exported)


@query("SELECT note_id, 'kept' AS side FROM manifest_prev WHERE note_id IN (SELECT note_id FROM notes) UNION ALL SELECT note_id, 'removed' FROM manifest_prev WHERE note_id NOT IN (SELECT note_id FROM notes)", "manifest_prev")
def set_sync_prune(d: Data) -> DataFrame:
    kept, gone = sync.kept(d.notes, d.manifest_prev), sync.gone(d.notes, d.manifest_prev)
    return kept.select("note_id", F.lit("kept").alias("side")).unionByName(gone.select("note_id", F.lit("removed").alias("side")))


@query("SELECT note_id, coalesce(m.path, a.path) AS path FROM allocated a FULL JOIN manifest_prev m USING (note_id)", "manifest_prev allocated")
def set_paths_merge(d: Data) -> DataFrame:
    return sync.merge_paths(d.allocated, d.manifest_prev)


STREAM = """SELECT note_id, modified FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY modified DESC, event_id DESC) AS r FROM change_feed) WHERE r = 1 AND NOT tombstone"""


def _replayed(d: Data, files: int) -> DataFrame:
    """The feed as a stream of files, one for each batch."""
    src = scratch(d.spark, "feed")
    d.change_feed.repartition(files, "event_id").write.parquet(src)
    return d.spark.readStream.schema(d.spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)


@query(STREAM, "change_feed")
def sync_stream(d: Data) -> DataFrame:
    """The feed replayed out of order, then the keyed state that it left."""
    from quire.streaming import feed

    checkpoint = scratch(d.spark, "stream")
    feed.follow(_replayed(d, 2), checkpoint).awaitTermination()
    return feed.live(feed.followed(d.spark, checkpoint))


@query(STREAM, "change_feed")
def sync_stream_parts(d: Data) -> DataFrame:
    """The same with the state in files."""
    from quire.streaming import feed

    path = scratch(d.spark, "state")
    feed.start(_replayed(d, 3), path, scratch(d.spark, "offsets")).awaitTermination()
    return feed.live(feed.state(d.spark, path))
