"""Approximate nearest neighbours by inverted lists and an adaptive scan of dimensions.

Equal vectors are one entry that keeps its smallest ids, as many as any answer can hold, so that copies neither crowd a
list nor a task. Entries get one more dimension that makes the largest inner product the least distance, are rotated
at random and dealt to lists by their nearest centre. Queries visit their nearest lists. Within a list the rotated
vectors are read in blocks of columns, for all queries that meet in the list at once; after each block a test on the
partial distances drops candidates that are, with high confidence, farther than the best k found so far. Survivors are
ranked by the exact measure on the original vectors. Long lists are cut into blocks of bounded length, and so are many
queries that meet in one list. A query whose lists hold fewer than k candidates goes on to all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize

#: Lists for the root of the table's different vectors, lists at most, rows of a list from which its centre is fitted (first
#: by a hash), queries that choose how many lists to visit, and recall that these must reach on the sample.
LISTS_PER_ROOT, MAX_LISTS, FIT_PER_LIST, FIT_QUERIES, FIT_RECALL = 2, 2_048, 32, 200, 0.96
#: Columns of a block, width of the test (standard deviations), entries and queries that meet in one task's group.
BLOCK_DIMS, EPSILON, BLOCK_ROWS, BLOCK_QUERIES = 16, 2.1, 4_096, 1_024
#: Share of candidates alive up to which they are read one by one.
SPARSE = 0.2


@dataclass(frozen=True)
class Index:
    """Bounded by MAX_LISTS centres and the square of the dimension."""

    centres: np.ndarray
    rotation: np.ndarray
    norm2: float
    visit: int

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Rotated vectors with the dimension that makes their norms equal."""
        rest = np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0.0))
        return np.column_stack([x, rest]) @ self.rotation

    def lift_queries(self, q: np.ndarray) -> np.ndarray:
        """A query's length does not change its order of candidates; it is scaled to the entries' norm."""
        q = q * (np.sqrt(self.norm2) / np.linalg.norm(q, axis=1))[:, None]
        return np.column_stack([q, np.zeros(len(q))]) @ self.rotation

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        d = (self.centres * self.centres).sum(1)[None, :] - 2 * x @ self.centres.T
        k = min(k, d.shape[1])
        part = np.argpartition(d, k - 1, axis=1)[:, :k]
        return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of the rows that take part: no null, zero or non-finite vectors."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("vec"))


def distinct_vectors(rows: DataFrame, keep: int, salts: int = 64) -> DataFrame:
    """(vec, ids): each different vector with its ``keep`` smallest different ids, ascending; a common one is met in
    parts first."""
    first = Window.partitionBy("vec", "_s").orderBy("id")
    some = rows.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(salts))).withColumn("_r", F.dense_rank().over(first)).where(F.col("_r") <= keep)
    return some.groupBy("vec").agg(F.slice(F.sort_array(F.collect_set("id")), 1, keep).alias("ids"))


def fit(rows: DataFrame, k: int, seed: int = 7) -> Index:
    """Fit on at most MAX_LISTS * FIT_PER_LIST different vectors; every vector is indexed later. The lists grow with the
    root of the table until they are MAX_LISTS."""
    n, norm2 = rows.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))).first()
    lists = int(max(1, min(MAX_LISTS, LISTS_PER_ROOT * np.sqrt(n), n / 4)))
    got = rows.orderBy(F.xxhash64("vec"), "vec").limit(lists * FIT_PER_LIST).toArrow()["vec"].combine_chunks()
    x = got.flatten().to_numpy().reshape(len(got), -1)
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1] + 1,) * 2))[0]
    z = Index(np.zeros((1, x.shape[1] + 1)), rotation, norm2, 1).lift(x)
    centres = z[np.sort(rng.choice(len(z), lists, replace=False))]
    for _ in range(6):
        own = Index(centres, rotation, norm2, 1).nearest(z, 1)[:, 0]
        sums, m = np.zeros_like(centres), np.bincount(own, minlength=lists)
        np.add.at(sums, own, z)
        centres = np.where(m[:, None] > 0, sums / np.maximum(m, 1)[:, None], centres)
    index = Index(centres, rotation, norm2, lists)
    own = index.nearest(z, 1)[:, 0]
    some = rng.choice(len(x), min(FIT_QUERIES, len(x)), replace=False)
    order = index.nearest(index.lift_queries(x[some]), lists)
    rank = np.argsort(order, axis=1)  # rank[q, list]
    scores = x[some] @ x.T
    top = np.argpartition(-scores, min(k, len(x) - 1), axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(rank, own[top], 1).ravel())
    visit = int(needed[int(np.ceil(FIT_RECALL * len(needed))) - 1]) + 1
    return Index(centres, rotation, norm2, visit)


def scan(vecs: np.ndarray, lifted: np.ndarray, queries: np.ndarray, lifted_queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, exact measure) of the rows of ``vecs`` that are among the k nearest of each query, ties included.

    Partial distances of all queries are one product for each block of columns, until few candidates are alive.
    """
    dims, n = lifted.shape[1], len(vecs)
    some = lifted[: min(k, n)]
    limit = np.full(len(queries), np.inf)
    if n > k:
        limit = np.maximum(_squares(lifted_queries, some), 0).max(1)
    partial, alive = np.zeros((len(queries), n)), np.ones((len(queries), n), bool)
    at = 0
    while at < dims and alive.sum() > SPARSE * alive.size:
        to = min(dims, at + BLOCK_DIMS)
        partial += _squares(lifted_queries[:, at:to], lifted[:, at:to])
        at = to
        if at < dims and n > k:
            alive &= partial * (dims / at) <= (limit * (1 + EPSILON / np.sqrt(at)) ** 2)[:, None]
            # A better limit from the candidates nearest so far.
            best = np.argpartition(partial, k - 1, axis=1)[:, :k]
            limit = np.minimum(limit, ((lifted[best] - lifted_queries[:, None, :]) ** 2).sum(2).max(1))
    q, v = np.nonzero(alive)
    left = partial[q, v]
    while at < dims and len(q):
        to = min(dims, at + BLOCK_DIMS)
        diff = lifted[v, at:to] - lifted_queries[q, at:to]
        left += np.einsum("ij,ij->i", diff, diff)
        at = to
        near = left * (dims / at) <= limit[q] * (1 + (EPSILON / np.sqrt(at) if at < dims else 1e-9)) ** 2
        q, v, left = q[near], v[near], left[near]
    scores = np.einsum("ij,ij->i", vecs[v], queries[q])
    order = np.lexsort((-scores, q))
    q, v, scores = q[order], v[order], scores[order]
    starts = np.searchsorted(q, np.arange(len(queries)))
    last = np.minimum(starts[q] + k - 1, np.searchsorted(q, q, side="right") - 1)
    keep = scores >= scores[last]  # ties go on: ids decide later
    return q[keep], v[keep], scores[keep]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T


def search(base: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each query row its k nearest base rows by inner product, but not itself: ``query_id``, ``rank`` (from 1),
    ``vec_id``, ``score``. Ties go to the smaller id; k rows come back, or all candidates if there are fewer.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do those of another length than
    most have (the greater of equally common ones). Rows that repeat id and vector count once; an id with several
    vectors is several candidates, and several queries. Other columns are left out.
    """
    spark = base.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = valid(base, id_col, vec_col)
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    if not lengths:
        return spark.createDataFrame([], out)
    same = F.size("vec") == lengths[0].d
    # The query's own id may take as many places as it has vectors.
    own = rows.where(same).select("id", F.xxhash64("vec").alias("v")).groupBy("id").agg(F.count_distinct("v").alias("n")).agg(F.max("n")).first()[0]
    slots = k + own
    entries = materialize(distinct_vectors(rows.where(same), slots), "entries")
    asked = valid(queries, id_col, vec_col).where(same).distinct().select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    index = fit(entries.select("vec"), k)
    sent = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["list"] = sent.value.nearest(sent.value.lift(np.stack(b["vec"].to_numpy())), 1)[:, 0]
                yield b

    dealt = materialize(entries.mapInPandas(assign, "vec array<double>, ids array<long>, list int"), "lists")
    different = materialize(asked.select("qvec").distinct().withColumn("q", F.xxhash64("qvec")), "queries")
    near = materialize(_nearest(dealt, different, sent, index.visit, slots), "near")
    mine = asked.withColumn("q", F.xxhash64("qvec")).join(near, "q", "left")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    mine = materialize(mine.select("query_id", "q", "qvec", F.coalesce(others, F.array()).alias("near")), "answers")
    short = mine.where(F.size("near") < k)
    if index.visit < len(index.centres) and short.head(1):  # go on to all lists
        more = _nearest(dealt, short.select("qvec", "q").distinct(), sent, len(index.centres), slots)
        others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
        mine = mine.where(F.size("near") >= k).select("query_id", "near").unionByName(short.select("query_id", "q").join(more, "q").select("query_id", others.alias("near")))
    ranked = mine.select("query_id", F.posexplode("near").alias("p", "x"))
    return ranked.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _nearest(dealt: DataFrame, different: DataFrame, sent, lists: int, slots: int) -> DataFrame:
    """(q, near: its nearest ``slots`` of the ``lists`` nearest lists, as structs of rank, vec_id and score)."""

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["list"] = list(sent.value.nearest(sent.value.lift_queries(np.stack(b["qvec"].to_numpy())), lists))
                yield b

    visits = materialize(different.mapInPandas(visit, "qvec array<double>, q long, list array<int>").select("q", "qvec", F.explode("list").alias("list")), "visits")
    blocks = lambda df, rows: df.groupBy("list").agg(F.ceil(F.count("*") / rows).cast("int").alias("n"))  # noqa: E731  a row for each list
    nv = blocks(dealt, BLOCK_ROWS).withColumnRenamed("n", "nv")
    nq = blocks(visits, BLOCK_QUERIES).withColumnRenamed("n", "nq")
    sizes = F.broadcast(nv.join(nq, "list"))  # at most MAX_LISTS rows
    left = dealt.join(sizes, "list").select(
        "list", F.pmod(F.xxhash64("vec"), "nv").cast("int").alias("bv"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("bq"), "vec", "ids"
    )
    right = visits.join(sizes, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("bv"), F.pmod(F.col("q"), F.col("nq")).cast("int").alias("bq"), "q", "qvec"
    )

    def meet(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(vs) or not len(qs):
            return pd.DataFrame({"q": [], "vec_id": [], "score": []})
        x, asked = np.stack(vs["vec"].to_numpy()), np.stack(qs["qvec"].to_numpy())
        q, v, scores = scan(x, sent.value.lift(x), asked, sent.value.lift_queries(asked), slots)
        ids = vs["ids"].to_numpy()[v]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        q, scores, ids = np.repeat(q, sizes), np.repeat(scores, sizes), np.concatenate([*ids, np.empty(0, np.int64)])
        order = np.lexsort((ids, -scores, q))
        q = q[order]
        order = order[np.arange(len(q)) - np.searchsorted(q, q) < slots]
        return pd.DataFrame({"q": qs["q"].to_numpy()[np.repeat(np.arange(len(asked)), np.bincount(q, minlength=len(asked)).clip(max=slots))], "vec_id": ids[order].astype(np.int64), "score": scores[order]})

    part = left.groupBy("list", "bv", "bq").cogroup(right.groupBy("list", "bv", "bq")).applyInPandas(meet, "q long, vec_id long, score double")
    best = part.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= slots)
    return best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
