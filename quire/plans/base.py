"""Bindings of the given tables to the logical schemas, and the registry of queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from quire import registry

#: Logical table -> SQL over the given tables and earlier bindings, in the order of their dependencies.
BINDINGS = {
    "accounts": "SELECT r_regionkey AS account_id, r_name AS name, r_regionkey % 5 AS account_type FROM region",
    "folders": "SELECT n_nationkey AS folder_id, n_name AS name, CASE WHEN n_nationkey < 5 THEN NULL ELSE n_nationkey - 5 END AS parent_id, n_regionkey AS account_id FROM nation",
    "notes": (
        "SELECT doc_id AS note_id, trim(regexp_extract(text, '^[^\\n]*', 0)) AS title, text AS body, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS created,"
        " TIMESTAMP '2024-01-01 00:00:00' + (doc_id + n_chars % 1000) * INTERVAL '1' MINUTE AS modified, doc_id % 25 AS folder_id, doc_id % 5 AS account_id,"
        " doc_id % 97 = 0 AS deleted, doc_id % 89 = 0 AS locked FROM documents"
    ),
    "notes_star": (
        "SELECT o_orderkey AS note_id, o_orderpriority AS title, o_orderdate AS created, coalesce(m.modified, o_orderdate) AS modified, c_nationkey AS folder_id, n_regionkey AS account_id"
        " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
        " LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS modified FROM lineitem GROUP BY l_orderkey) m ON m.l_orderkey = o_orderkey"
    ),
    "attachments": (
        "SELECT l_orderkey * 1000 + seq AS attachment_id, l_orderkey AS note_id, seq, l_partkey AS media_id, CASE l_linenumber % 7 WHEN 0 THEN 'com.apple.notes.table' WHEN 1 THEN 'public.jpeg'"
        " WHEN 2 THEN 'public.url' WHEN 3 THEN 'com.adobe.pdf' WHEN 4 THEN 'com.apple.notes.gallery' WHEN 5 THEN 'com.apple.notes.inlinetextattachment.hashtag' ELSE 'dyn.x' END AS type,"
        " CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'file' || (l_partkey % 3) || '.' || lower(l_linestatus) END AS filename, l_returnflag = 'A' AND l_linenumber = 1 AS deleted"
        " FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS seq FROM lineitem) x"
    ),
    "media": "SELECT p_partkey AS media_id, p_name AS filename, p_size AS height, p_size % 7 + 1 AS width FROM part",
    "runs": "SELECT user_id AS note_id, event_id AS seq, event_type AS style, CAST(floor(value) AS BIGINT) % 50 + 1 AS length FROM events",
    "cells": "SELECT l_orderkey AS table_id, l_linenumber AS row_key, l_returnflag AS col_key, min(l_linestatus) AS text FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag",
    "manifest_prev": (
        "SELECT note_id, CASE WHEN note_id % 4 = 0 THEN modified - INTERVAL '1' HOUR ELSE modified END AS modified, 'old/' || note_id || '.md' AS path FROM notes WHERE note_id % 10 <> 0"
        " UNION ALL SELECT note_id + 1000000, modified, 'old/gone-' || note_id || '.md' FROM notes WHERE note_id % 50 = 0"
    ),
    "note_links": "SELECT note_id AS source_id, (note_id * 7 + 3) % 1100 AS target_id FROM notes",
    "raw_entities": "SELECT r_regionkey + 1 AS z_ent, CASE r_regionkey WHEN 0 THEN 'account' WHEN 1 THEN 'folder' WHEN 2 THEN 'note' ELSE 'other' END AS z_name FROM region",
    "raw_objects": (
        "SELECT account_id AS z_pk, 1 AS z_ent, name AS zname, account_type AS zaccounttype, CAST(NULL AS STRING) AS ztitle1, CAST(NULL AS STRING) AS ztitle2, CAST(NULL AS BIGINT) AS zparent,"
        " CAST(NULL AS BIGINT) AS zowner, CAST(NULL AS BIGINT) AS zfolder, CAST(NULL AS BIGINT) AS zaccount7, CAST(NULL AS DOUBLE) AS zcreationdate1, CAST(NULL AS DOUBLE) AS zmodificationdate1,"
        " CAST(NULL AS INT) AS zmarkedfordeletion, CAST(NULL AS INT) AS zispasswordprotected, CAST(NULL AS STRING) AS ztypeuti, CAST(NULL AS STRING) AS ztypeuti1 FROM accounts"
        " UNION ALL SELECT 1000 + folder_id, 2, NULL, NULL, NULL, CASE WHEN folder_id = 23 THEN NULL ELSE name END, 1000 + parent_id, account_id, NULL, NULL, NULL, NULL, CASE WHEN folder_id = 24 THEN 1 ELSE 0 END, NULL, NULL, NULL FROM folders"
        " UNION ALL SELECT 100000 + doc_id, 3, NULL, NULL, CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE regexp_extract(text, '^[^\\n]*', 0) END, NULL, NULL, NULL, 1000 + doc_id % 25, doc_id % 5, CAST(725760000 + doc_id * 60 AS DOUBLE),"
        " CAST(725760000 + (doc_id + n_chars % 1000) * 60 AS DOUBLE), CASE WHEN doc_id % 97 = 0 THEN 1 ELSE 0 END, CASE WHEN doc_id % 89 = 0 THEN 1 ELSE NULL END, CASE WHEN doc_id % 3 = 0 THEN 'public.jpeg' END,"
        " CASE WHEN doc_id % 2 = 0 THEN 'com.adobe.pdf' END FROM documents"
    ),
    "raw_bodies": "SELECT 100000 + doc_id AS znote, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE text END AS zdata FROM documents WHERE doc_id % 13 <> 0",
    "raw_bridge": "SELECT 100000 + doc_id AS note, 1000 + doc_id % 25 AS folder FROM documents UNION ALL SELECT 100000 + doc_id, 1000 + (doc_id + 1) % 25 FROM documents WHERE doc_id % 4 = 0",
    "old_note": "SELECT doc_id AS z_pk, regexp_extract(text, '^[^\\n]*', 0) AS ztitle, doc_id % 5 AS zstore, CAST(doc_id * 60 AS DOUBLE) AS zcreationdate, CAST(doc_id * 61 AS DOUBLE) AS zmodificationdate, CASE WHEN doc_id % 10 = 0 THEN 1 END AS zdeletedflag FROM documents",
    "old_body": "SELECT doc_id AS zowner, text AS zcontent FROM documents WHERE doc_id % 6 <> 0",
    "old_store": "SELECT r_regionkey AS z_pk, r_regionkey + 10 AS zaccount FROM region WHERE r_regionkey < 4",
    "listing": "SELECT CASE p_partkey % 3 WHEN 0 THEN 'Accounts/A' || (p_partkey % 5) || '/FallbackImages/' || p_partkey || '.png' WHEN 1 THEN 'FallbackImages/' || p_partkey || '/g1/FallbackImage.jpeg' ELSE 'Accounts/A' || ((p_partkey + 1) % 5) || '/FallbackImages/' || p_partkey || '.jpg' END AS path FROM part WHERE p_partkey % 10 <> 0",
    "wanted": "SELECT p_partkey AS file_id, 'A' || (p_partkey % 5) AS account, CASE WHEN p_partkey % 2 = 1 THEN 'g1' ELSE '' END AS generation FROM part",
    "export_log": "SELECT o_orderkey AS note_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'skipped' END AS status, CAST(o_orderkey % 3 AS BIGINT) AS failed_attachments FROM orders",
    "allocated": "SELECT note_id, 'new/' || note_id || '.md' AS path FROM notes",
    "change_feed": "SELECT event_id, user_id AS note_id, ts AS modified, event_type = 'error' AS tombstone FROM events",
}
#: What DuckDB's trim takes away: spaces of any width. Spark's own takes U+0020 alone.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Data:
    """The given tables and the bindings as lazy DataFrames, read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in BINDINGS and name not in TABLES:
            raise AttributeError(name)
        if name not in self._seen:
            if name in TABLES:
                self._seen[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = BINDINGS[name].replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace("\\n", "\\\\n").replace("trim(", f"trim(BOTH '{SPACES}' FROM ")
                words = set(sql.replace("(", " ").replace(")", " ").split())
                uses = [t for t in [*TABLES, *BINDINGS] if t in words and t != name]
                for t in uses:
                    sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
                self._seen[name] = self.spark.sql(sql, **{t: getattr(self, t) for t in uses if f"{{{t}}}" in sql})
        return self._seen[name]

    @cached_property
    def live_notes(self) -> DataFrame:
        return self.notes.where("NOT deleted AND NOT locked")


def _needs(names: tuple[str, ...]) -> list[str]:
    if any(n in ("manifest_prev", "note_links", "allocated") for n in names):
        names = (*names, "notes")
    if "raw_objects" in names:
        names = (*names, "accounts", "folders")
    return [n for n in BINDINGS if n in names]


def query(oracle: str | None = None, needs: str = "", name: str | None = None):
    """Register a function of ``Data`` under its name; ``oracle`` is SQL that may use the bindings in ``needs``."""

    def register(f: Callable[[Data], DataFrame]):
        key = name or f.__name__
        registry.QUERIES[key] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if oracle is not None:
            ctes = ",\n".join(f"{n} AS ({BINDINGS[n]})" for n in _needs(tuple(needs.split())))
            body = oracle.strip()
            if body[:15].upper() == "WITH RECURSIVE ":
                body = body[15:]
            elif body[:5].upper() == "WITH ":
                body = body[5:]
            elif ctes:
                registry.ORACLES[key] = f"WITH {ctes}\n{body}"
                return f
            else:
                registry.ORACLES[key] = body
                return f
            registry.ORACLES[key] = "WITH RECURSIVE " + (ctes + ",\n" if ctes else "") + body
        return f

    return register
