"""The sync state kept by a stream of changes, in two forms: the latest change of every id wins, whatever the order.

``follow`` keeps it as keyed state of the stream itself: one value for each id that lives, and one with a time to live for each
that is gone, so that an older change can't bring it back as long as that lasts. The work of a batch follows the batch.
Changes are reduced in each task before they are shuffled, so an id with very many is a few rows.

``start`` keeps it as files that others can read: BUCKETS parts by a hash of the id. Each micro-batch is merged into the
parts that it touches; these are written anew beside the old ones, and a small index of the parts, with the batch's
number, is the commit, so that a batch that comes again changes nothing. Parts that no kept index names are deleted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from quire.sources.shared import filesystem
from quire.sources.sinks import current_version, read_manifest, versions, write_manifest

STATE = "note_id long, modified timestamp_ntz, event_id long, tombstone boolean"
INDEX = "bucket int, batch long"
BUCKETS = 64
#: A change inside the stream: times as microseconds.
CHANGE = "note_id long, modified long, event_id long, tombstone boolean"
VALUE = "modified long, event_id long, tombstone boolean"
#: How long a deletion is remembered, and ids that a task holds before it hands on what it has reduced.
TOMBSTONE_MILLIS, REDUCED_IDS = 30 * 24 * 3_600_000, 100_000


def bucket(note_id: str = "note_id") -> Column:
    return F.pmod(F.xxhash64(note_id), F.lit(BUCKETS)).cast("int")


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each id, by time and then event."""
    last = F.max(F.struct("modified", "event_id", "tombstone"))
    return changes.groupBy("note_id").agg(last.alias("l")).select("note_id", "l.modified", "l.event_id", "l.tombstone")


def merged(state: DataFrame, changes: DataFrame) -> DataFrame:
    """State after the changes; tombstones stay in it, so that an older change can't bring a note back."""
    cols = ["note_id", "modified", "event_id", "tombstone"]
    return latest(state.select(*cols).unionByName(changes.select(*cols)))


def live(state: DataFrame) -> DataFrame:
    return state.where("NOT tombstone").select("note_id", "modified")


def index(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    """Bucket -> batch that wrote its part; -1 -> the last batch. At most BUCKETS + 1 rows."""
    return {r.bucket: r.batch for r in read_manifest(spark, path, INDEX, version).collect()}


def state(spark: SparkSession, path: str, only: set[int] | None = None) -> DataFrame:
    """The state, or that of some buckets."""
    parts = [f"{path}/parts/batch={n}/bucket={b}" for b, n in sorted(index(spark, path).items()) if b >= 0 and (only is None or b in only)]
    return spark.read.schema(STATE).parquet(*parts) if parts else spark.createDataFrame([], STATE)


def upsert_batch(path: str):
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base = current_version(spark, path)
        known = index(spark, path, base)
        if known.get(-1, -1) >= number:
            return
        changes = latest(batch)
        touched = {r.b for r in changes.select(bucket().alias("b")).distinct().collect()}  # at most BUCKETS numbers
        new = merged(state(spark, path, touched), changes).withColumn("bucket", bucket())
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/parts/batch={number}")
        rows = known | {b: number for b in touched} | {-1: number}
        write_manifest(spark.createDataFrame(list(rows.items()), INDEX).coalesce(1), path, base=base or 0)
        prune(spark, path, number)

    return run


def prune(spark: SparkSession, path: str, upto: int) -> None:
    """Delete the parts of batches up to ``upto`` that none of the indexes still there names."""
    used = {(r.batch, r.bucket) for v in versions(spark, path) for r in read_manifest(spark, path, INDEX, v).collect()}
    p, fs = filesystem(spark, path)
    root = p(f"{path}/parts")
    for batch in fs.listStatus(root) if fs.exists(root) else []:
        number = int(batch.getPath().getName().removeprefix("batch="))
        for part in fs.listStatus(batch.getPath()) if number <= upto else []:
            name = part.getPath().getName()
            if name.startswith("bucket=") and (number, int(name.removeprefix("bucket="))) not in used:
                fs.delete(part.getPath(), True)
        if number <= upto and not any(b == number for b, _ in used):
            fs.delete(batch.getPath(), True)


def start(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Follow a streaming DataFrame of (event_id, note_id, modified, tombstone) until what is there is worked off."""
    return changes.writeStream.foreachBatch(upsert_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def order(modified: int | None, event_id: int | None, tombstone: bool | None) -> tuple:
    """What changes of one id are compared by: time, event, deletion; nulls come first, as in Spark's order."""
    return tuple((x is not None, x or 0) for x in (modified, event_id, tombstone))


def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The latest change of each id among a task's rows; handed on, and forgotten, at REDUCED_IDS ids."""
    best: dict = {}

    def table() -> pa.RecordBatch:
        columns = zip(*((i, *x) for i, x in best.items()), strict=True)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["note_id", "modified", "event_id", "tombstone"])

    for b in batches:
        for i, *x in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if i not in best or order(*x) > order(*best[i]):
                best[i] = x
        if len(best) > REDUCED_IDS:
            yield table()
            best.clear()
    if best:
        yield table()


class Latest(StatefulProcessor):
    """The latest change of an id. What it hands on are the changes that were newer than the state."""

    def __init__(self, tombstone_millis: int):
        self.tombstone_millis = tombstone_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getValueState("live", VALUE)
        self.gone = handle.getValueState("gone", VALUE, self.tombstone_millis)

    def handleInputRows(self, key: tuple, rows: Iterable[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        new = max(((r.modified, r.event_id, r.tombstone) for r in rows), key=lambda x: order(*x))
        old = self.live.get() or self.gone.get()
        if old is not None and order(*old) >= order(*new):
            return
        into, other = (self.gone, self.live) if new[2] else (self.live, self.gone)
        other.clear()
        into.update(new)
        yield Row(note_id=key[0], modified=new[0], event_id=new[1], tombstone=new[2])

    def close(self) -> None:
        pass


SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # State with a time to live would have a batch follow each batch for ever.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def follow(changes: DataFrame, checkpoint: str, sink: dict[str, str] | None = None, tombstone_millis: int = TOMBSTONE_MILLIS) -> StreamingQuery:
    """Follow a streaming DataFrame of (event_id, note_id, modified, tombstone) until what is there is worked off; the
    state lies in ``checkpoint``, from which a later call goes on. Accepted changes go to ``sink`` (options of a writer, with
    its ``format``), or nowhere. Changes without an id are left out; a null tombstone is none."""
    spark = changes.sparkSession
    micros = F.unix_micros(F.col("modified").cast("timestamp")).alias("modified")
    rows = changes.where("note_id IS NOT NULL").select("note_id", micros, F.col("event_id").cast("long").alias("event_id"), F.coalesce("tombstone", F.lit(False)).alias("tombstone"))
    kept = rows.mapInArrow(reduced, CHANGE).groupBy("note_id").transformWithState(Latest(tombstone_millis), CHANGE, "Update", "ProcessingTime")
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)  # a query takes the settings of its start with it
        options = dict(sink or {"format": "noop"})
        writer = kept.writeStream.outputMode("update").format(options.pop("format")).options(**options)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def followed(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(note_id, modified, event_id, tombstone) as the last batch of ``follow`` left it; none before the first."""
    p, fs = filesystem(spark, checkpoint)
    if not fs.exists(p(f"{checkpoint}/commits")) or not fs.listStatus(p(f"{checkpoint}/commits")):
        return spark.createDataFrame([], STATE)

    def of(name: str, value: str) -> DataFrame:
        rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
        modified = F.timestamp_micros(f"{value}.modified").cast("timestamp_ntz").alias("modified")
        return rows.select(F.col("key.note_id").alias("note_id"), modified, f"{value}.event_id", f"{value}.tombstone")

    return of("live", "value").unionByName(of("gone", "value.value"))
