"""Sinks: partitioned texts, records in four formats, concatenations, and the versioned manifest."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.dates import formatted
from quire.functions.strings import csv_escape
from quire.operators.running import Ordered
from quire.sources.shared import filesystem


#: Between notes of one text.
SEPARATOR = "\n\n---\n\n"


def record(attachments: bool = True) -> Column:
    """struct of a note's record; ``attachments`` is left out of it where asked."""
    fields = [
        F.col("title"), F.col("body"), formatted("created", "iso").alias("created"), formatted("modified", "iso").alias("modified"), F.col("folder"), F.col("account"),
        F.size("attachments").alias("attachment_count"),
    ]
    return F.struct(*fields, *([F.col("attachments")] if attachments else []))


def jsonl(notes: DataFrame) -> DataFrame:
    """(note_id, line): one JSON object for each note, nulls written."""
    return notes.select("note_id", F.to_json(record(), {"ignoreNullFields": "false"}).alias("line"))


def json_pretty(notes: DataFrame) -> DataFrame:
    """(note_id, document): the same over several lines, without ``attachments`` where there are none."""
    options = {"ignoreNullFields": "false", "pretty": "true"}
    return notes.select("note_id", F.when(F.size("attachments") == 0, F.to_json(record(False), options)).otherwise(F.to_json(record(), options)).alias("document"))


def csv_rows(notes: DataFrame) -> DataFrame:
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return notes.select(
        F.col("title").alias("Title"), F.col("folder").alias("Folder"), F.col("account").alias("Account"), when("created").alias("Created"), when("modified").alias("Modified"),
        F.col("body").alias("Body"), F.size("attachments").alias("Attachment Count"),
    )


def write_csv(notes: DataFrame, path: str) -> None:
    """Every field quoted as it is, with all of its white space; nothing between the commas is null. Spark's own writer would
    quote nulls too, and so make them empty texts. Each file begins with the names of the columns."""
    rows = csv_rows(notes)
    header = ",".join(f'"{c}"' for c in rows.columns)
    fields = [F.coalesce(F.concat(F.lit('"'), csv_escape(F.col(f"`{c}`").cast("string")), F.lit('"')), F.lit("")) for c in rows.columns]
    # The low bits of such an id number the rows of a task, which writes one file.
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    lines = rows.select(F.concat(F.when(first, header + "\n").otherwise(""), F.concat_ws(",", *fields)).alias("line"))
    lines.write.mode("overwrite").option("maxRecordsPerFile", 0).text(path)
    if not notes.sparkSession.read.text(path).head(1):
        notes.sparkSession.createDataFrame([(header,)], "line string").write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_csv`` has written, as texts. Line ends inside of fields stay as they are, and no text counts as null."""
    names = ("Title", "Folder", "Account", "Created", "Modified", "Body", "Attachment Count")
    shape = ", ".join(f"`{c}` string" for c in names)
    # A new name for nulls, which no text that was written before can be equal to.
    options = {"header": True, "multiLine": True, "escape": '"', "lineSep": "\n", "nullValue": uuid.uuid4().hex, "emptyValue": "", "mode": "FAILFAST"}
    return spark.read.schema(shape).options(**options).csv(path)


def write_jsonl(notes: DataFrame, path: str) -> None:
    jsonl(notes).select("line").write.mode("overwrite").text(path)


def write_xml(notes: DataFrame, path: str) -> None:
    """``<note>`` records; the attachments' number is an attribute of their list."""
    listed = F.struct(F.size("attachments").alias("_count"), F.col("attachments").alias("attachment")).alias("attachments")
    rows = notes.select("title", "folder", "account", formatted("created", "iso").alias("created"), formatted("modified", "iso").alias("modified"), "body", listed)
    rows.write.mode("overwrite").format("xml").option("rowTag", "note").option("rootTag", "notes").save(path)


def plan(notes: DataFrame) -> DataFrame:
    """(account, folder_path, filename, rel_path, content): where each text goes."""
    return notes.select("note_id", "account", "folder_path", "filename", F.concat_ws("/", "account", "folder_path", "filename").alias("rel_path"), "content")


def write_partitioned(planned: DataFrame, path: str, parts: int | None = None) -> None:
    """Texts below account=…/folder_path=…. Rows are dealt by folder and a share of the id, so that one large folder is
    written by many tasks."""
    rows = planned.repartition(*([parts] if parts else []), "account", "folder_path", F.pmod(F.xxhash64("note_id"), F.lit(32)))
    rows.write.mode("overwrite").partitionBy("account", "folder_path").parquet(path)


def write_observed(rows: DataFrame, path: str, **metrics: Column) -> dict:
    """Write ``rows`` and take ``metrics`` (aggregates) of what is written, in one pass over them. A write that fails raises,
    and has no metrics: none of its rows count."""
    seen = Observation()
    rows.observe(seen, *[m.alias(k) for k, m in metrics.items()]).write.mode("overwrite").parquet(path)
    return seen.get


def concatenated(notes: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """(account, folder_path, content, notes): the texts of each folder in the order of their paths, failed ones (null) left out."""
    rows = F.sort_array(F.collect_list(F.struct("rel_path", "content")))
    good = notes.where("content IS NOT NULL")
    return good.groupBy("account", "folder_path").agg(F.array_join(F.transform(rows, lambda r: r["content"]), separator).alias("content"), F.count("*").alias("notes"))


#: Bytes of a block of a concatenated text; digests that one of the next level is made of, and levels at most.
BLOCK_BYTES, FAN, LEVELS = 1 << 16, 1024, 4


def concatenated_blocks(notes: DataFrame, separator: str = SEPARATOR, hot: bool | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(account, folder_path, block, bytes): the texts of ``concatenated`` as blocks of so many bytes, the last one shorter.

    A note's place is the sum of what stands before it in its folder, whatever the folder's size (see ``running``); its
    bytes go to the blocks that they lie in. No task holds more than blocks. A folder without a byte has no block.
    """
    gap = len(separator.encode())
    rows = notes.where("content IS NOT NULL").select("account", "folder_path", "rel_path", "content")
    placed = Ordered(rows, ["account", "folder_path"], ["rel_path", "content"], hot).before("_at", F.octet_length("content").cast("long") + gap).done()
    text = F.when(F.col("_at") > 0, F.concat(F.lit(separator), "content")).otherwise(F.col("content")).cast("binary")
    pieces = placed.select("account", "folder_path", F.greatest(F.col("_at") - gap, F.lit(0)).alias("_at"), text.alias("_b")).where("length(_b) > 0")
    size = F.length("_b")
    spread = pieces.select("*", F.explode(F.sequence(F.floor(F.col("_at") / block_bytes), F.floor((F.col("_at") + size - 1) / block_bytes))).alias("block"))
    first = F.greatest(F.col("block") * block_bytes - F.col("_at"), F.lit(0))
    last = F.least((F.col("block") + 1) * block_bytes - F.col("_at"), size)
    part = F.substring("_b", first.cast("int") + 1, (last - first).cast("int"))
    cut = spread.select("account", "folder_path", "block", F.struct((F.col("_at") + first).alias("at"), part.alias("b")).alias("p"))
    whole = F.aggregate(F.sort_array(F.collect_list("p")), F.lit("").cast("binary"), lambda a, p: F.concat(a, p["b"]))
    return cut.groupBy("account", "folder_path", "block").agg(whole.alias("bytes"))


def tree_digests(blocks: DataFrame, value: str = "bytes") -> DataFrame:
    """(account, folder_path, digest) of blocks: a block's MD5, and level by level the MD5 of up to FAN digests' hex in
    their order, until one is left for the folder. One block's digest is that of the text."""
    keys = ["account", "folder_path"]
    nodes = blocks.select(*keys, F.col("block").alias("i"), F.md5(value).alias("d"))
    for _ in range(LEVELS):
        # What stands alone goes up as it is.
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "d"))), lambda x: x["d"]), "")
        up = nodes.groupBy(*keys, F.floor(F.col("i") / FAN).alias("i")).agg(F.when((F.count("*") == 1) & (F.max("i") == 0), F.first("d")).otherwise(F.md5(joined)).alias("d"))
        nodes = up
    return nodes.select(*keys, F.col("d").alias("digest"))


def concatenated_digests(notes: DataFrame, separator: str = SEPARATOR, hot: bool | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``concatenated`` with the tree digest of each folder's text in place of the text, which is never put together."""
    good = notes.where("content IS NOT NULL")
    folders = good.groupBy("account", "folder_path").agg(F.count("*").alias("notes"))
    found = tree_digests(concatenated_blocks(notes, separator, hot, block_bytes)).withColumnsRenamed({"account": "_a", "folder_path": "_f"})
    same = F.col("account").eqNullSafe(F.col("_a")) & F.col("folder_path").eqNullSafe(F.col("_f"))
    return folders.join(found, same, "left").select("account", "folder_path", F.coalesce("digest", F.md5(F.lit("").cast("binary"))).alias("content"), "notes")


def write_concatenated(notes: DataFrame, path: str, separator: str = SEPARATOR) -> None:
    """The whole corpus as ordered text files, a note after another; never one giant row."""
    notes.where("content IS NOT NULL").orderBy("rel_path").select("content").write.mode("overwrite").option("lineSep", separator).text(path)


def attachment_plan(notes: DataFrame, atts: DataFrame) -> DataFrame:
    """(note_id, attachment_id, source_path, rel_path): file attachments below the folder named after their note."""
    n = notes.select("note_id", "rel_path")
    folder = F.concat(F.regexp_replace("rel_path", r"\.[^./]*$", ""), F.lit(" (Attachments)/"))
    return atts.join(n, "note_id").select("note_id", "attachment_id", F.col("source_path"), F.concat(folder, F.col("out_name")).alias("rel_path"))


LOG, DATA = "_log", "data-"


class Conflict(Exception):
    """Another writer committed the version that this one wanted."""


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions that are still there, in rising order."""
    p, fs = filesystem(spark, path)
    log = p(f"{path}/{LOG}")
    names = [f.getPath().getName() for f in fs.listStatus(log)] if fs.exists(log) else []
    return sorted(int(n) for n in names if n.isdigit())


def current_version(spark: SparkSession, path: str) -> int | None:
    """Number of the newest committed version."""
    return max(versions(spark, path), default=None)


def _data(spark: SparkSession, path: str, version: int) -> str:
    """The folder that a log entry names."""
    p, fs = filesystem(spark, path)
    io = spark.sparkContext._jvm.java.io
    stream = fs.open(p(f"{path}/{LOG}/{version}"))
    try:
        return f"{path}/{io.BufferedReader(io.InputStreamReader(stream)).readLine()}"
    finally:
        stream.close()


def read_manifest(spark: SparkSession, path: str, schema: str | T.StructType, version: int | None = None) -> DataFrame:
    """A committed version, the newest if none is named; an empty table before the first."""
    version = current_version(spark, path) if version is None else version
    return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(_data(spark, path, version))


def _put_if_absent(spark: SparkSession, path: str, version: int, name: str) -> bool:
    """The log's entry of a version, whole and at most once: it is written under another name and moved to its own, which
    a file system refuses where that exists. Local files are linked, since there a move would overwrite."""
    p, fs = filesystem(spark, path)
    fs.mkdirs(p(f"{path}/{LOG}"))
    own, target = p(f"{path}/{LOG}/.{name}"), p(f"{path}/{LOG}/{version}")
    out = fs.create(own, True)
    out.write(bytearray((name + "\n").encode()))
    out.close()
    try:
        if fs.getScheme() != "file":
            return not fs.exists(target) and bool(fs.rename(own, target))
        nio = spark.sparkContext._jvm.java.nio.file
        as_local = lambda x: nio.Path.of(x.toUri().getPath(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.String, 0))
        nio.Files.createLink(as_local(target), as_local(own))
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise
    finally:
        fs.delete(own, False)


def write_manifest(state: DataFrame, path: str, keep: int = 2, base: int | None = None) -> int:
    """Commit ``state`` as the version after ``base``, the one it was made from (the newest, if not named).

    Rows go to a folder of their own; the log's entry, which only one writer can make, is the commit. A writer whose version
    is taken leaves nothing behind and raises ``Conflict``, since its state lacks what the other wrote. A write that broke
    off is in no log, so it is never read. All but ``keep`` versions go.
    """
    spark = state.sparkSession
    base = current_version(spark, path) if base is None else base
    v, name = (base or 0) + 1, DATA + uuid.uuid4().hex
    p, fs = filesystem(spark, path)
    state.write.parquet(f"{path}/{name}")
    # A version above this one may be there while this one's entry is gone already.
    if (current_version(spark, path) or 0) >= v or not _put_if_absent(spark, path, v, name):
        fs.delete(p(f"{path}/{name}"), True)
        raise Conflict(f"version {v} of {path}")
    for old in versions(spark, path)[:-keep]:
        fs.delete(p(_data(spark, path, old)), True)
        fs.delete(p(f"{path}/{LOG}/{old}"), False)
    return v


def update_manifest(spark: SparkSession, path: str, schema: str | T.StructType, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
    """Commit ``change(state)`` of the newest state; made anew from the winner's where another writer came first."""
    for k in range(tries):
        base = current_version(spark, path)
        state = read_manifest(spark, path, schema, base) if base is not None else spark.createDataFrame([], schema)
        try:
            return write_manifest(change(state), path, base=base or 0)
        except Conflict:
            if k + 1 == tries:
                raise
    raise ValueError("no tries")


def vacuum(spark: SparkSession, path: str, older_millis: int = 24 * 3_600_000) -> int:
    """Delete what writers that broke off left behind, older than any writer takes; the number of folders."""
    p, fs = filesystem(spark, path)
    known = {_data(spark, path, v).rsplit("/", 1)[1] for v in versions(spark, path)}
    now, gone = spark.sparkContext._jvm.java.lang.System.currentTimeMillis(), 0
    for f in fs.listStatus(p(path)) if fs.exists(p(path)) else []:
        name = f.getPath().getName()
        if name.startswith(DATA) and name not in known and now - f.getModificationTime() >= older_millis:
            gone += fs.delete(f.getPath(), True)
    return gone
