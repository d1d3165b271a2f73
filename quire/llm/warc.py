"""Deterministic sharded WARC writer and reader.

Records are sorted by id and cut into shards at fixed places of the sorted ids, so that shards depend on the rows alone;
each is streamed by one task into gzip members, which rolls files by compressed size and regenerates every header and
digest. What a task writes has a temporary name of its own, so attempts never meet; a manifest table names the files of
the attempts that Spark accepted, and the commit gives exactly those their final names.

Payloads are shuffled once. Which of equal payloads is the response is worked out on ids and digests; the answers
travel to the payloads as marker rows that sort right before them, so that no join has to move payloads again.
"""

from __future__ import annotations

import base64
import hashlib
import io
import math
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import materialize, qualified
from quire.llm.worker import blocks

#: Compressed bytes after which a file is closed; deflate level; shards are the root of the payload's bytes over SHARD_BYTES,
#: so that their number and their size both grow with the root of the table.
ROLL_BYTES, LEVEL, SHARD_BYTES = 64 << 20, 4, 1 << 20
MIN_REVISIT_BYTES = 0
URN = "urn:quire:page:"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, seq int, temp string, name string, bytes long, records long, sha256 string"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None, sha: str, copy: int = 0) -> str:
    """Name of a record: its id (none for null), its payload's digest, and a number for all but the first that repeat both."""
    return f"{URN}{'' if page_id is None else page_id}:{sha}" + (f":{copy}" if copy else "")


def record(page_id: int | None, url: str | None, payload: bytes, copy: int = 0, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit carries the digest and length of the payload that its response holds."""
    kind, sha = "response" if refers_to is None else "revisit", digest(payload)
    url = "".join(c for c in url or urn(page_id, sha, copy) if c >= " " and c != "\x7f")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{urn(page_id, sha, copy)}>", f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha}", f"Quire-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
        payload = b""
    head += [f"WARC-Block-Digest: sha1:{digest(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp: the same bytes on every run."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def plan(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, d, refers_to) of the pages (page_id, d: digest, size) that are revisits: equal payloads of ``min_bytes`` or
    more point to the largest page_id among them. Digests are counted before they are shuffled; one payload may fill
    the table."""
    rows = pages.where(F.col("size") >= min_bytes).select("page_id", "d")
    tops = rows.groupBy("d").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(tops, "d").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "d", "refers_to").distinct()


def cuts(pages: DataFrame) -> np.ndarray:
    """Ids at which a new shard begins: every so many of the sorted ids, whatever partitions they come in. A short array."""
    spark = pages.sparkSession
    n, size = pages.agg(F.count("page_id"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = math.isqrt(size // SHARD_BYTES) + 1
    each = max(1, -(-n // shards))
    tagged = pages.select("page_id").where("page_id IS NOT NULL").orderBy("page_id").withColumn("_m", F.monotonically_increasing_id())
    tagged = materialize(tagged.select("page_id", F.shiftright("_m", 33).cast("int").alias("p"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("i")), "page-ids")
    starts, total = {}, 0
    for p, count in sorted(tagged.groupBy("p").count().collect()):  # a number for each partition
        starts[p], total = total, total + count
    if not starts:
        return np.empty(0, np.int64)
    before = spark.createDataFrame(list(starts.items()), "p int, before long")
    at = tagged.join(F.broadcast(before), "p").where((F.col("before") + F.col("i")) % each == 0)
    return np.unique(np.array([r.page_id for r in at.select("page_id").collect()], np.int64))  # at most a number for each shard


def write(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll_bytes: int = ROLL_BYTES, min_bytes: int = MIN_REVISIT_BYTES
) -> DataFrame:
    """Write the archives below ``path`` (a URI of a store that all executors reach) and return the manifest.

    Null html is an empty payload, a null url is replaced by the record's URN. Every row becomes a record: rows that repeat
    an id and payload are numbered, and revisit the first of them where that is the response; a null id is less than all
    others and is left out of the URN. Other columns are left out. An empty table gives no file.
    """
    spark = pages.sparkSession
    path = qualified(spark, path)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.unhex(F.sha1(html)).alias("d"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.octet_length(html).alias("size"))
    keys = materialize(rows.select("page_id", "d", "size"), "page-keys")
    begins = spark.sparkContext.broadcast(cuts(keys))
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    marks = plan(keys, min_bytes).select("page_id", "d", F.lit(0).alias("mark"), none("string", "url"), none("string", "html"), "refers_to")
    both = rows.select("page_id", "d", F.lit(1).alias("mark"), "url", "html", none("long", "refers_to")).unionByName(marks)
    shards = max(1, len(begins.value))

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(begins.value, page_id.to_numpy(np.int64), side="right"))

    # Rows without an id are dealt by their digest.
    shard = F.when(F.col("page_id").isNull(), -1 - F.pmod(F.xxhash64("d"), F.lit(shards)).cast("int")).otherwise(shard_of(F.coalesce("page_id", F.lit(0))))
    order = ("shard", "page_id", "d", "mark", "url")
    dealt = both.withColumn("shard", shard).repartition(shards, "shard").sortWithinPartitions(*order)
    store = _open(path)[1]
    _open(path)[0].create_dir(posixpath.join(store, "_temporary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        attempt, done, out, seq = uuid.uuid4().hex, [], None, 0
        key, to, copy = None, None, 0  # of the row before: id and digest, where a marker says it points, how often it came

        def close() -> None:
            nonlocal out
            if out is not None:
                out["f"].close()
                name = "null" if out["shard"] < 0 else "part"
                done.append((out["shard"], seq, out["temp"], f"{name}-{abs(out['shard']):06d}-{seq:04d}.warc.gz", out["n"], out["rows"], out["sha"].hexdigest()))
                out = None

        columns = ("shard", "page_id", "d", "mark", "url", "html", "refers_to")
        for b in (x for whole in batches for x in blocks(whole, "html")):
            for shard, pid, d, mark, url, text, refers_to in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if key != (pid, d):
                    key, to, copy = (pid, d), None, -1
                if mark == 0:
                    to = (refers_to,)
                    continue
                copy += 1
                payload = (text or "").encode()
                target = urn(to[0] if to else pid, digest(payload)) if to or copy and len(payload) >= min_bytes else None
                data = member(record(pid, url, payload, copy, target))
                if out is not None and (out["shard"] != shard or out["n"] + len(data) > roll_bytes):
                    same = out["shard"] == shard
                    close()
                    seq = seq + 1 if same else 0
                if out is None:
                    temp = f"_temporary/{abs(shard):06d}-{uuid.uuid4().hex}-{attempt}"
                    out = {"f": fs.open_output_stream(posixpath.join(root, temp), compression=None), "temp": temp, "n": 0, "rows": 0, "sha": hashlib.sha256(), "shard": shard}
                out["f"].write(data)
                out["sha"].update(data)
                out["n"] += len(data)
                out["rows"] += 1
        close()
        if done:
            names = ["shard", "seq", "temp", "name", "bytes", "records", "sha256"]
            types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

    manifest = f"{path.rstrip('/')}/manifest"
    dealt.mapInArrow(run, MANIFEST).write.parquet(manifest)
    return commit(spark, path)


def commit(spark: SparkSession, path: str) -> DataFrame:
    """Give the manifest's files their final names and drop what other attempts left; may be repeated after a failure. One
    row for each file comes back, none for records."""
    path = qualified(spark, path)
    manifest = spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        for b in batches:
            for temp, name in zip(b.column("temp").to_pylist(), b.column("name").to_pylist(), strict=True):
                if fs.get_file_info(posixpath.join(root, name)).type == pa.fs.FileType.NotFound:
                    fs.move(posixpath.join(root, temp), posixpath.join(root, name))
            yield b

    done = manifest.repartition(max(1, min(64, manifest.rdd.getNumPartitions())), "name").mapInArrow(rename, MANIFEST)
    done.agg(F.count("*")).collect()
    fs, root = _open(path)
    if fs.get_file_info(posixpath.join(root, "_temporary")).type != pa.fs.FileType.NotFound:
        fs.delete_dir(posixpath.join(root, "_temporary"))
    return manifest


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC stream, decompressed member by member; checks lengths and digests."""
    buf = io.BufferedReader(_Members(stream), 1 << 18)
    while version := buf.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a record: {version[:40]!r}")
        head = {}
        while (line := buf.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(":")
            head[k] = v.strip()
        block = buf.read(int(head["Content-Length"]))
        if len(block) != int(head["Content-Length"]) or buf.read(4) != b"\r\n\r\n" or head["WARC-Block-Digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"broken record {head.get('WARC-Record-ID')}")
        yield head, block


class _Members(io.RawIOBase):
    """Bytes of concatenated gzip members, a chunk at a time."""

    def __init__(self, stream):
        self.stream, self.z, self.left, self.out = stream, zlib.decompressobj(31), b"", b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.out:
            data = self.left or self.stream.read(1 << 18)
            self.left = b""
            if not data:
                return 0
            self.out = self.z.decompress(data)
            if self.z.eof:
                self.left, self.z = self.z.unused_data, zlib.decompressobj(31)
        n = min(len(into), len(self.out))
        into[:n], self.out = self.out[:n], self.out[n:]
        return n


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the committed archives (see ``ROWS``), each file streamed by one task."""
    path = qualified(spark, path)
    files = spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest").select("name")
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        page = lambda name: int(i) if (i := name[len(URN) + 1 : -1].split(":")[0]) else None
        rows: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for b in batches:
            for name in b.column("name").to_pylist():
                with fs.open_input_stream(posixpath.join(root, name), compression=None) as f:
                    for h, block in read_records(f):
                        kind, sha, size = h["WARC-Type"], h["WARC-Payload-Digest"][5:], int(h["Quire-Payload-Length"])
                        if kind == "response" and (len(block) != size or digest(block) != sha):
                            raise ValueError(f"wrong payload in {h['WARC-Record-ID']}")
                        rows.append((page(h["WARC-Record-ID"]), size, sha, kind, page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None, h["WARC-Target-URI"]))
                        if len(rows) >= 10_000:
                            yield pack()
                            rows.clear()
        if rows:
            yield pack()

    return files.repartition(n).mapInArrow(run, ROWS)
