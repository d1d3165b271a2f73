"""Token counts kept up to date by signed changes.

A batch of changes (inserts, deletes, revised counts) is turned into signed amounts, summed by source, language and
tokenizer version, and added to the totals, which are written as a new version beside the old one; the version's success
mark commits the batch. The cost of a batch follows its own size and that of the totals, not that of the corpus or of
its history. A batch that is committed already changes nothing when it comes again, and is compared with what was
committed; one that failed half way left nothing that totals read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "version")
DELTA = "source string, lang string, version string, docs long, tokens long"


def word_count(text: Column) -> Column:
    """White-space separated words; null and blank texts have none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\f"))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, "[ \\t\\n\\r\\f]+"))).cast("long")


def byte_count(text: Column) -> Column:
    """A token for every four bytes begun."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long")


def signed(changes: DataFrame) -> DataFrame:
    """Changes as signed rows (KEYS, docs, tokens).

    ``changes`` has ``op`` (insert, delete, revise), ``source``, ``lang``, ``version``, ``tokens``, and for deletes and
    revisions ``old_version`` and ``old_tokens``, which are taken back. Null counts are 0, null keys a group of their
    own; other ops are an error.
    """
    c = F.col
    new = F.struct(c("source"), c("lang"), c("version"), F.lit(1).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    old = F.struct(c("source"), c("lang"), c("old_version").alias("version"), F.lit(-1).alias("docs"), (-F.coalesce("old_tokens", F.lit(0))).alias("tokens"))
    rows = F.when(c("op") == "insert", F.array(new)).when(c("op") == "delete", F.array(old)).when(c("op") == "revise", F.array(old, new))
    return changes.select(F.explode(F.coalesce(rows, F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))).alias("d")).select("d.*")


class Rollup:
    """Additive totals below one shared folder: ``batch=<n>/`` holds a batch's sums, ``totals/v=<n>/`` the totals up to and
    with it, whose ``_SUCCESS`` is the commit. Batches come in rising order, with gaps if need be."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """Committed versions that are still there: ``keep`` of them and what a failure left."""
        at = self._path(f"{self.path}/totals")
        if not self._fs.exists(at):
            return []
        names = [f.getPath() for f in self._fs.listStatus(at)]
        return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and self._fs.exists(self._path(p, "_SUCCESS")))

    def last(self) -> int | None:
        """The last batch in the totals."""
        return max(self._versions(), default=None)

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commit a batch; False if that number is committed already. A repeated attempt overwrites a broken one.

        A committed number with other sums, and a number below the last that never came, are errors.
        """
        last, at = self.last(), f"{self.path}/batch={batch}"
        sums = signed(changes).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")
        if last is not None and batch <= last:
            if not self._fs.exists(self._path(at, "_SUCCESS")):
                raise ValueError(f"batch {batch} was never committed, but {last} is")
            old = self.spark.read.schema(DELTA).parquet(at)
            if sums.exceptAll(old).head(1) or old.exceptAll(sums).head(1):
                raise ValueError(f"batch {batch} was committed with other changes")
            return False
        sums.write.mode("overwrite").parquet(at)
        both = self.totals().unionByName(self.spark.read.schema(DELTA).parquet(at))
        new = both.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")
        new.write.mode("overwrite").parquet(f"{self.path}/totals/v={batch}")
        for v in self._versions()[: -self.keep]:
            self._fs.delete(self._path(f"{self.path}/totals/v={v}"), True)
        return True

    def totals(self) -> DataFrame:
        """KEYS, ``docs`` and ``tokens`` over all committed batches; groups that came to nothing are gone."""
        last = self.last()
        return self.spark.createDataFrame([], DELTA) if last is None else self.spark.read.schema(DELTA).parquet(f"{self.path}/totals/v={last}")
