"""Links between documents: the graph, and rewriting of links and attachment markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import strings as S

#: Fixed value: an internal link; its id is eight or more hexadecimal digits or dashes.
NOTE_LINK = r"applenotes:note/([0-9A-Fa-f-]{8,})(\?[^'\"\s<>]*)?"
MARKER = r"<span data-attachment-id=\"([^\"]*)\" data-attachment-type=\"([^\"]*)\">[^<]*</span>"


def resolved(links: DataFrame, paths: DataFrame) -> DataFrame:
    """Links (source_id, target_id) with the target's path (null: dangling) and the path relative to the source."""
    t = paths.select(F.col("note_id").alias("target_id"), F.col("path").alias("target_path"))
    s = paths.select(F.col("note_id").alias("source_id"), F.col("path").alias("source_path"))
    out = links.join(t, "target_id", "left").join(s, "source_id", "left")
    return out.withColumn("resolved", F.col("target_path").isNotNull()).withColumn("rel_path", S.relative_path("source_path", "target_path"))


def degrees(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links out of, dangling links out of, and links into every node."""
    known = nodes.select(F.col("note_id").alias("target_id"), F.lit(1).alias("_t"))
    marked = links.join(known, "target_id", "left")
    out = marked.groupBy(F.col("source_id").alias("note_id")).agg(F.count("*").alias("out_links"), F.count_if(F.col("_t").isNull()).alias("dangling"))
    into = links.groupBy(F.col("target_id").alias("note_id")).agg(F.count("*").alias("in_links"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("note_id").join(out, "note_id", "left").join(into, "note_id", "left").select("note_id", zero("out_links"), zero("dangling"), zero("in_links"))


def found_links(notes: DataFrame, html: str = "html") -> DataFrame:
    """(note_id, target) for each internal link in a text; texts without the scheme are not searched."""
    hits = F.when(F.col(html).contains("applenotes:note/"), F.regexp_extract_all(html, F.lit(NOTE_LINK), F.lit(1)))
    return notes.select("note_id", F.explode(hits).alias("target"))


def _pieces(notes: DataFrame, html: str, pattern: str) -> DataFrame:
    """Texts cut at the matches: (note_id, pos, text, hit), a match after each text but the last."""
    gaps, hits = F.split(F.col(html), pattern, -1), F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    return notes.select("note_id", F.posexplode(F.arrays_zip(gaps.alias("text"), hits.alias("hit"))).alias("pos", "p")).select("note_id", "pos", "p.text", "p.hit")


def _joined(pieces: DataFrame) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("pos", "text", "new")))
    text = F.array_join(F.transform(rows, lambda r: F.concat(F.coalesce(r["text"], F.lit("")), F.coalesce(r["new"], F.lit("")))), "")
    return pieces.groupBy("note_id").agg(text.alias("html"))


def rewrite(notes: DataFrame, paths: DataFrame, html: str = "html") -> DataFrame:
    """(note_id, html): internal links become relative encoded paths; unknown targets stay as they are.

    ``notes`` has note_id, path and the text; ``paths`` (key, path) by upper-case link id. Only texts with links are cut,
    each match joined with its target, and put together again.
    """
    has = F.coalesce(F.col(html).rlike(NOTE_LINK), F.lit(False))
    cut = _pieces(notes.where(has), html, NOTE_LINK).withColumn("key", F.upper(F.regexp_extract("hit", NOTE_LINK, 1)))
    cut = cut.join(notes.select("note_id", F.col("path").alias("_source")), "note_id").join(paths.select(F.upper("key").alias("key"), F.col("path").alias("_target")), "key", "left")
    new = F.when(F.col("_target").isNotNull(), S.path_encode(S.relative_path("_source", "_target"))).otherwise(F.col("hit"))
    return _joined(cut.withColumn("new", new)).unionByName(notes.where(~has).select("note_id", F.col(html).alias("html")))


def replacement(kind: Column, path: Column, label: Column, table_html: Column) -> Column:
    """What stands for a marker: table, image, card, PDF link, file link, or a placeholder when nothing is known."""
    p, name = S.html_escape(S.path_encode(path)), S.html_escape(F.coalesce(label, F.lit("Attachment")))
    link = lambda text: F.concat(F.lit("<a href='"), p, F.lit("'>"), text, F.lit("</a>"))
    return (
        F.when((kind == "table") & table_html.isNotNull(), table_html)
        .when(kind.isin("image", "drawing", "sketch", "scan", "gallery") & path.isNotNull(), F.concat(F.lit("<img src='"), p, F.lit("' alt='"), name, F.lit("'>")))
        .when((kind == "url") & path.isNotNull(), F.concat(F.lit("<a href='"), S.safe_href(path), F.lit("'>"), name, F.lit("</a>")))
        .when((kind == "pdf") & path.isNotNull(), link(F.concat(F.lit("PDF: "), name)))
        .when(path.isNotNull(), link(name))
        .otherwise(F.concat(F.lit("[Attachment: "), name, F.lit("]")))
    )


def resolve_markers(notes: DataFrame, known: DataFrame, html: str = "html") -> DataFrame:
    """(note_id, html): markers replaced by what ``known`` (attachment_id, kind, path, label, table_html) has for them."""
    has = F.coalesce(F.col(html).contains("data-attachment-id"), F.lit(False))
    cut = _pieces(notes.where(has), html, MARKER).withColumn("attachment_id", S.html_unescape(F.regexp_extract("hit", MARKER, 1)))
    cut = cut.join(known, "attachment_id", "left")
    new = F.when(F.col("hit").isNotNull(), replacement(F.coalesce("kind", F.lit("unknown")), F.col("path"), F.col("label"), F.col("table_html")))
    return _joined(cut.withColumn("new", new)).unionByName(notes.where(~has).select("note_id", F.col(html).alias("html")))
