"""Lookups and ownership joins. Sides are left to the optimizer's size statistics; no side is forced to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_name(df: DataFrame, dim: DataFrame, key: str, out: str, default: str) -> DataFrame:
    """``out``: the name that ``key`` has in ``dim``, or ``default``."""
    names = dim.select(F.col(key).alias("_k"), F.col("name").alias("_n"))
    return df.join(names, F.col(key) == F.col("_k"), "left").withColumn(out, F.coalesce("_n", F.lit(default))).drop("_k", "_n")


def owned(refs: DataFrame, attachments: DataFrame) -> DataFrame:
    """References to attachments that are live and belong to the very note that refers to them."""
    return refs.join(attachments.where(~F.col("deleted")).select("attachment_id", "note_id"), ["attachment_id", "note_id"], "left_semi")


def attachment_meta(refs: DataFrame, attachments: DataFrame, media: DataFrame) -> DataFrame:
    """References with type, names and media; media's own file name comes first."""
    meta = attachments.select("attachment_id", "type", F.col("filename").alias("own_name"), "media_id")
    names = media.select("media_id", F.col("filename").alias("media_name"))
    out = refs.join(meta, "attachment_id", "left").join(names, "media_id", "left")
    return out.withColumn("filename", F.coalesce("media_name", "own_name"))


def gallery_children(galleries: DataFrame, children: DataFrame) -> DataFrame:
    """Direct children of each gallery in the order of their keys; galleries within galleries are not opened."""
    kids = children.select("parent_id", F.col("attachment_id").alias("child_id"), F.col("type").alias("child_type"))
    return galleries.select(F.col("attachment_id").alias("gallery_id")).join(kids, F.col("gallery_id") == F.col("parent_id")).drop("parent_id")


def inline_text(refs: DataFrame, inline: DataFrame) -> DataFrame:
    """Text of inline attachments: mentions and links carry their token; missing ones are empty."""
    out = refs.join(inline.select("attachment_id", "alt_text", "token"), "attachment_id", "left")
    tagged = F.concat(F.coalesce("alt_text", F.lit("")), F.lit(" ["), F.col("token"), F.lit("]"))
    marked = F.col("type").isin("inline_mention", "inline_link") & F.col("token").isNotNull()
    return out.withColumn("text", F.when(marked, tagged).otherwise(F.coalesce("alt_text", F.lit("")))).drop("alt_text", "token")


def url_card(refs: DataFrame, cards: DataFrame) -> DataFrame:
    """Card of a URL attachment: title, else alternative text, else the URL; a null URL is a placeholder."""
    out = refs.join(cards.select("attachment_id", "url", "card_title", "alt_text"), "attachment_id", "left")
    return out.withColumn("label", F.when(F.col("url").isNull(), "[URL]").otherwise(F.coalesce("card_title", "alt_text", "url"))).drop("card_title", "alt_text")


def media_candidates(wanted: DataFrame, extensions: tuple[str, ...] = ("jpeg", "png", "jpg")) -> DataFrame:
    """Paths under which a file may lie, in two tiers: the account's folder, then the root; with the generation or not.

    ``wanted`` has file_id, account and generation. The third tier, any other account, is ``other_accounts``.
    """
    g = F.col("generation")
    tiers = [F.concat(F.lit("Accounts/"), F.col("account"), F.lit("/")), F.lit("")]
    paths = []
    for tier, prefix in enumerate(tiers):
        for e, ext in enumerate(extensions):
            flat = F.concat(prefix, F.lit("FallbackImages/"), F.col("file_id").cast("string"), F.lit(f".{ext}"))
            deep = F.concat(prefix, F.lit("FallbackImages/"), F.col("file_id").cast("string"), F.lit("/"), g, F.lit(f"/FallbackImage.{ext}"))
            base = tier * 2 * len(extensions) + 2 * e
            paths += [F.struct(F.lit(base).alias("priority"), flat.alias("path")), F.struct(F.lit(base + 1).alias("priority"), F.when(g != "", deep).alias("path"))]
    return wanted.select("*", F.inline(F.array(*paths))).where("path IS NOT NULL")


def other_accounts(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """Third tier: files of the same name below any other account, by account and path."""
    files = listing.select(F.col("path"), F.regexp_extract("path", "^Accounts/([^/]+)/FallbackImages/", 1).alias("_a"), F.regexp_extract("path", "FallbackImages/([^./]+)", 1).alias("_f"))
    return wanted.join(files, (F.col("file_id").cast("string") == F.col("_f")) & (F.col("_a") != F.col("account")) & (F.col("_a") != "")).drop("_f", "_a").withColumn("priority", F.lit(1000))


def first_path(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """file_id and the first existing path by tier."""
    near = media_candidates(wanted).join(listing.select("path"), "path", "left_semi").select("file_id", "priority", "path")
    far = other_accounts(wanted, listing).select("file_id", "priority", "path")
    return near.unionByName(far).groupBy("file_id").agg(F.min(F.struct("priority", "path"))["path"].alias("path"))


def attachment_paths(refs: DataFrame, written: DataFrame, children: DataFrame) -> DataFrame:
    """Written path of each attachment; a gallery's is its first child's."""
    own = refs.join(written.select("attachment_id", "path"), "attachment_id", "left")
    kids = children.join(written.select(F.col("attachment_id").alias("child_id"), F.col("path").alias("child_path")), "child_id")
    first = kids.groupBy(F.col("gallery_id").alias("attachment_id")).agg(F.min_by("child_path", "child_id").alias("child_path"))
    return own.join(first, "attachment_id", "left").withColumn("path", F.coalesce("path", "child_path")).drop("child_path")
