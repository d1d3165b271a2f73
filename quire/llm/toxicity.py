"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The features of a text are hashed single words, the first letters of long words (stems that inflected forms share),
word pairs, and pairs that skip one word, each counted once. The learner keeps a rate for each coordinate and drives
weights that don't earn their keep to exactly zero, so that the model is a short table of bounded size; it is
broadcast, and scoring is one pass over the texts without any shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import materialize
from quire.llm.worker import blocks, memory

#: log2 of the number of hashed coordinates: bounds the model, and so the broadcast.
BITS = 20
#: Labelled rows used for fitting, and coordinates of all of them; passes over them.
MAX_FIT_ROWS, MAX_FIT_COORDINATES, EPOCHS = 8_000, 1 << 26, 3
#: Rate and L1 (chosen on a fold of the learning rows), and the weight of a text of n coordinates: ROW_WEIGHT / sqrt(n).
ALPHA, L1, ROW_WEIGHT = 2.0, 2.0, 8.0
STEMS = (4, 5)
WORD = re.compile(r"\w+")
MASK = np.uint64((1 << BITS) - 1)
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class Model:
    """Non-zero weights by coordinate, and the intercept."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.index] = self.weight
        return w


#: Bound on words that a Python worker remembers.
MEMORY_WORDS = 150_000


def _learn_words(words: set[str]) -> tuple[dict[str, int], dict[str, tuple[int, ...]]]:
    """64-bit codes and stem coordinates of words; forgets all when the memory's bound is met."""
    kept = memory("toxicity")
    codes, stems = kept.setdefault("codes", {}), kept.setdefault("stems", {})
    new = words.difference(codes)
    if len(codes) + len(new) > MEMORY_WORDS:
        codes.clear()
        stems.clear()
        new = words
    for w in new:
        raw = w.encode()
        codes[w] = zlib.crc32(raw) << 31 ^ zlib.crc32(raw[::-1], 77)
        stems[w] = tuple([_stem_code(w[:k]) for k in STEMS if len(w) >= k])
    return codes, stems


@lru_cache(50_000)
def _stem_code(stem: str) -> int:
    return zlib.crc32(stem.encode(), 1) & ((1 << BITS) - 1)


def coordinates(text: str | None) -> np.ndarray:
    """Coordinates of a whole text, some of them repeatedly; none for a null or empty one."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.int64)
    distinct = set(words)
    codes, stems_of = _learn_words(distinct)
    seq = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    parts = [seq * MIX[0]]
    if len(seq) > 1:
        parts.append(seq[:-1] * MIX[1] + seq[1:] * MIX[2])
    if len(seq) > 2:
        parts.append(seq[:-2] * MIX[3] + seq[2:] * MIX[1])
    grams = ((np.concatenate(parts) >> np.uint64(40)) & MASK).astype(np.int64)
    stems = np.fromiter(chain.from_iterable(map(stems_of.__getitem__, distinct)), np.int64)
    return np.concatenate([grams, stems])


def features(text: str | None) -> np.ndarray:
    """Sorted distinct coordinates of a whole text."""
    return np.unique(coordinates(text))


def ftrl(rows: list[tuple[np.ndarray, int]], alpha: float = ALPHA, beta: float = 1.0, l1: float = L1, l2: float = 0.1, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over rows of (coordinates, label): z and n are kept for each coordinate, weights made when needed.

    A row's loss weighs ROW_WEIGHT / sqrt(its coordinates), so that a long text moves the model no farther than a short one.
    """
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = bias = 0.0
    for _ in range(epochs):
        for x, y in rows:
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= l1, 0.0, (np.sign(zx) * l1 - zx) / ((beta + root) / alpha + l2))
            p = 1.0 / (1.0 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = (p - y) * ROW_WEIGHT / np.sqrt(max(len(x), 1))
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / alpha * w
            n[x] = nx + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * bias
            nb += g * g
            bias = -zb / ((beta + np.sqrt(nb)) / alpha + l2)
    keep = np.flatnonzero(np.abs(z) > l1)
    w = (np.sign(z[keep]) * l1 - z[keep]) / ((beta + np.sqrt(n[keep])) / alpha + l2)
    return Model(keep, w.astype(np.float32), float(bias))


def fit(
    labelled: DataFrame,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = MAX_FIT_ROWS,
    max_coordinates: int = MAX_FIT_COORDINATES,
) -> Model:
    """Fit on at most ``max_rows`` rows of ``labelled`` (id, label; null labels take no part), first by a hash of the id, and
    at most ``max_coordinates`` of their texts, or one text.

    Both bounds hold for the one task that learns, whatever the corpus. An id with several labels is toxic if one says so;
    one with several texts counts once, with the least of their vectors. Without any row the model is empty and scores 0.5.
    """
    chosen = (
        labelled.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sample = texts.join(F.broadcast(chosen), "_id")  # at most max_rows rows of two numbers

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in blocks(whole, "_text")):
            xs = [features(t).astype(np.int32).tobytes() for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(xs, pa.binary())], names=["_id", "_y", "_x"])

    schema = T.StructType([sample.schema["_id"], T.StructField("_y", T.IntegerType()), T.StructField("_x", T.BinaryType())])

    # One row for each id; at most max_rows numbers come to the driver, in the order in which they are learnt from.
    vectored = sample.mapInArrow(vectors, schema).groupBy("_id").agg(F.min(F.struct("_x", "_y")).alias("r")).select("_id", "r._x", "r._y")
    vectored = materialize(vectored.withColumn("_turn", F.xxhash64("_id")), "fit-rows")
    total, last = 0, None
    for r in vectored.select("_id", "_turn", (F.octet_length("_x") / 4).cast("long").alias("n")).orderBy("_turn", "_id").collect():
        total += r.n
        if last is not None and total > max_coordinates:
            break
        last = (r["_turn"], r["_id"])
    if last is None:
        return Model(np.empty(0, np.int32), np.empty(0, np.float32), 0.0)
    upto = (F.col("_turn") < last[0]) | (F.col("_turn") == last[0]) & (F.col("_id") <= F.lit(last[1]))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(b.column("_turn").to_pylist(), b.column("_id").to_pylist(), b.column("_y").to_pylist(), b.column("_x").to_pylist(), strict=True)]
        got.sort(key=lambda r: r[:2])
        m = ftrl([(np.frombuffer(x, np.int32), y) for _, _, y, x in got])
        cols = [pa.array([m.index.astype(np.int32).tobytes()]), pa.array([m.weight.tobytes()]), pa.array([m.bias])]
        yield pa.RecordBatch.from_arrays(cols, names=["i", "w", "b"])

    row = vectored.where(upto).repartition(1).mapInArrow(learn, "i binary, w binary, b double").first()
    return Model(np.frombuffer(row.i, np.int32), np.frombuffer(row.w, np.float32), row.b)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns of ``keep`` and ``score`` (double, 0 to 1) for every row; null and empty texts get the prior."""
    passed = [c for c in dict.fromkeys([id_col, *keep]) if c != "score"]
    rows = df.select(*dict.fromkeys([*passed, text_col]))
    schema = T.StructType([rows.schema[c] for c in passed] + [T.StructField("score", T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast(model)  # at most 2 ** BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = sent.value.dense(), sent.value.bias
        for b in (x for whole in batches for x in blocks(whole, text_col)):
            s = []
            for t in b.column(text_col).to_pylist():
                x = coordinates(t)
                x = np.unique(x[w[x] != 0])  # only what has a weight need be told apart
                s.append(float(w[x].sum(dtype=np.float64)))
            out = 1.0 / (1.0 + np.exp(-np.clip(np.array(s) + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in passed] + [pa.array(out, pa.float64())], names=[*passed, "score"])

    return rows.mapInArrow(run, schema)
