"""Near-duplicate classes by Order MinHash with verification by banded alignment.

Texts are lower-cased words without punctuation; k-mers are five-word shingles labelled with their occurrence. For each
of SKETCHES hash functions the ORDERED least k-mers are taken and kept in the order in which they stand in the text:
two texts share a sketch when the same k-mers are least and their order agrees. Texts with equal words are one class
from the start and only their first one goes on. Texts that share a sketch meet in a bucket: all pairs in a bucket of
at most SMALL, and a pair with the bucket's first text in any bucket. Pairs are verified on their whole texts by an
alignment within the band that the threshold allows; classes are the connected components of what was verified.

Members of larger buckets that are not in one class by then are tried with other hubs, HUB_ROUNDS times: a member of the
bucket's largest class, drawn anew each time, so that a large class gathers what belongs to it at a cost that grows with
the bucket and not with its square. Those that are still apart go through an exact join on their shingles, the rarest
first: as many of each text as any text that is alike must share one of (a prefix filter). Pairs within a class are not
tried, and candidates are verified a few for each text at a time, so that most of a class is joined before the rest of
its pairs come up, and need not. Neither these pairs nor those of hubs are made where the texts' parity bits differ in more
places than texts alike may differ in shingles (an exact filter: two texts differ in at least as many shingles as bits).
"""

from __future__ import annotations

import hashlib
import string
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import discard, materialize, written
from quire.llm.worker import blocks, memory

#: Words of a shingle, least similarity, sketches, k-mers in a sketch, members of a bucket whose pairs are all tried.
K, THRESHOLD, SKETCHES, ORDERED, SMALL = 5, 0.8, 12, 2, 16
#: Times that members of large buckets are tried with a new hub; share of a bucket that its largest class must hold for
#: that after the first time; candidates of a text up to which each wave verifies.
HUB_ROUNDS, HUB_SHARE, WAVES = 3, 0.25, (16, 1 << 62)
PUNCTUATION = string.punctuation + "¡¿«»“”„‘’…–—·"
_rng = np.random.default_rng(20240501)
SEEDS = _rng.integers(1, 1 << 63, SKETCHES, dtype=np.uint64)
POWERS = _rng.integers(1, 1 << 63, K, dtype=np.uint64) | np.uint64(1)
ODD = np.uint64(0xBF58476D1CE4E5B9)

#: Cells in which occurrences of shingles are counted; cells of at most RARE count as equal. They only order shingles.
CELLS, RARE = 1 << 20, 4
#: Parity bits of a text, a multiple of 64; where texts are so long that most bits say nothing, the filter lets them pass.
BITS = 1024
#: Of the shingles that a text is met by, how many of the rarest each row brings along.
SEEN = 64

#: Bound on words that a Python worker remembers.
MEMORY_WORDS = 150_000


def word_codes(text: str | None) -> np.ndarray:
    """A code for each word; tokens of punctuation alone are no words."""
    raw = (text or "").lower().split()
    known = memory("neardup").setdefault("codes", {})
    new = set(raw).difference(known)
    if new:
        if len(known) + len(new) > MEMORY_WORDS:
            known.clear()
            new = set(raw)
        for w in new:
            b = w.strip(PUNCTUATION).encode()
            known[w] = (zlib.crc32(b) << 31 ^ zlib.crc32(b[::-1], 5)) or 1 if b else 0
    codes = np.fromiter(map(known.__getitem__, raw), np.uint64, len(raw))
    return codes[codes != 0]


def shingles(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - K + 1
    if n < 1:
        return codes[:0] if not len(codes) else np.array([np.bitwise_xor.reduce(codes * POWERS[: len(codes)])], np.uint64)
    out = codes[:n] * POWERS[0]
    for i in range(1, K):
        out = out + codes[i : n + i] * POWERS[i]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD
    return x ^ (x >> np.uint64(29))


def labelled(codes: np.ndarray) -> np.ndarray:
    """Mixed codes of a text's shingles, each labelled with its occurrence, in the order of the text."""
    s = shingles(codes)
    if not len(s):
        return s
    order = np.argsort(s, kind="stable")
    same = np.concatenate([[False], s[order[1:]] == s[order[:-1]]])
    if same.any():  # label repeated k-mers with their occurrence
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(s))))
        label = np.empty(len(s), np.uint64)
        label[order] = (np.arange(len(s)) - first).astype(np.uint64)
        s = s + label * np.uint64(0x9E3779B97F4A7C15)
    return _mixed(s)


def sketches(codes: np.ndarray) -> list[int]:
    """Order MinHash sketches of a text, none for one without words."""
    s = labelled(codes)
    if not len(s):
        return []
    out = []
    for seed in SEEDS:
        h = _mixed(s ^ seed)
        least = np.argpartition(h, ORDERED - 1)[:ORDERED] if len(h) > ORDERED else np.arange(len(h))
        at = s[np.sort(least)]
        out.append(zlib.crc32(at.tobytes()) << 31 ^ zlib.crc32(at[::-1].tobytes(), 9))
    return out


def parity(s: np.ndarray) -> np.ndarray:
    """BITS bits as 64-bit numbers: each is one where an odd number of labelled shingles fall."""
    return np.packbits((np.bincount((s >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def may_be_alike(a: tuple[str, str], b: tuple[str, str], threshold: float) -> Column:
    """Whether texts can reach ``threshold`` by the columns of their numbers of shingles and parity bits. Each shingle that only one
    of them has turns one bit, so they have as many of these as bits that differ at least."""
    (n, x), (m, y) = ((F.col(k), F.col(bits)) for k, bits in (a, b))
    differ = reduce(add, (F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(BITS // 64)))
    return (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-6) & (differ <= (n + m) * (1 - 2 * threshold / (1 + threshold)) + 1e-6)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Labelled shingles that the alignment of two texts has in common, over those of either; 0 if below ``threshold``.

    The alignment matches as many shingles as can be in the order of both texts. Only matches within the band of
    diagonals that ``threshold`` allows take part: one that lies as far off as there may be unmatched shingles in all can't
    be part of it. A labelled shingle stands once in a text, so the matches are at most as many as shingles, and the
    longest chain of them takes n log n steps and linear space. Texts of fewer words than a shingle are alike only if equal.
    """
    if len(a) == len(b) and (a == b).all():
        return 1.0
    n, m = len(a) - K + 1, len(b) - K + 1
    if n < 1 or m < 1 or min(n, m) < threshold * max(n, m):
        return 0.0
    _, at, to = np.intersect1d(labelled(a), labelled(b), assume_unique=True, return_indices=True)
    need = threshold / (1 + threshold) * (n + m)
    near = np.abs(at - to) <= n + m - 2 * need + 1e-6
    at, to = at[near], to[near]
    if len(at) < need - 1e-6:
        return 0.0
    to = to[np.argsort(at)]
    chain = len(to)
    if (to[1:] < to[:-1]).any():
        ends: list[int] = []
        for x in to.tolist():
            k = bisect_left(ends, x)
            if k == len(ends):
                ends.append(x)
            else:
                ends[k] = x
        chain = len(ends)
    found = chain / (n + m - chain)
    return found if found >= threshold else 0.0


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, text): rows that repeat both their id and text share ``id``, all others differ in it."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), row_key(id_col, text_col).alias("id"), F.col(text_col).alias("text"))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc: id of the row, id: hash of that id and the text, words: digest of the text's words, sketches) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in blocks(whole, "text")):
            codes = [word_codes(t) for t in b.column("text").to_pylist()]
            digests = pa.array([hashlib.md5(c.tobytes()).digest() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("id"), digests, pa.array([sketches(c) for c in codes], pa.list_(pa.int64()))], names=["doc", "id", "words", "sketches"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc long, id long, words binary, sketches array<long>")


def grows(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: neither is broadcast, also where few bytes lie on disk (there, repeated bits
    and shingles are packed many times as small as in memory)."""
    return df.hint("shuffle_merge")


def candidates(firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (id, sketches): distinct pairs (a, b), a < b, to be tried, and (id, keys) of the members of large buckets: a row for
    each text, with the keys of its large buckets (SKETCHES at most)."""
    keyed = firsts.select("id", F.inline(F.transform("sketches", lambda s, j: F.struct(F.xxhash64(j, s).alias("key")))))
    sizes = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = keyed.join(grows(sizes), "key")
    star = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    few = members.where(f"n > 2 AND n <= {SMALL}").select("key", "id")
    pairs = few.withColumnRenamed("id", "a").join(grows(few.withColumnRenamed("id", "b")), "key").where("a < b").select("a", "b")
    return star.unionByName(pairs).distinct(), members.where(f"n > {SMALL}").groupBy("id").agg(F.collect_list("key").alias("keys"))


def hub_candidates(members: DataFrame, labels: DataFrame, turn: int, threshold: float | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b: each member of a large bucket outside of its largest class with one of that class.
    After the first turn only in buckets that one class holds a good part of: members of others have a frequent passage
    in common and little else. With ``threshold``, members have ``n`` and ``bits`` too (see ``tried_texts``), and pairs that
    cannot reach it are left out."""
    text = F.struct("id", *(["n", "bits"] if threshold is not None else [])).alias("text")
    # A text meets its label once, not once for each bucket; what comes of it is read twice.
    rows = materialize(members.join(grows(labels), "id").select(text, "label", F.explode("keys").alias("key")), "bucket-labels")
    parts = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.min_by("text", F.xxhash64(F.lit(turn), "text.id")).alias("hub"))
    mains = parts.groupBy("key").agg(F.max(F.struct("n", "label", "hub")).alias("main"), F.sum("n").alias("n")).where(f"main.n < n AND main.n >= {HUB_SHARE if turn else 0} * n")
    apart = rows.join(grows(mains.select("key", "main.label", "main.hub").toDF("key", "main", "hub")), "key").where("label <> main")
    if threshold is not None:
        apart = apart.where(may_be_alike(("text.n", "text.bits"), ("hub.n", "hub.bits"), threshold))
    return apart.select(F.least("text.id", "hub.id").alias("a"), F.greatest("text.id", "hub.id").alias("b")).distinct()


def packed(text: str | None) -> bytes:
    """A text's word codes, folded to four bytes each."""
    codes = word_codes(text)
    return ((codes ^ (codes >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32).astype(np.uint64)


def tried_texts(pairs: DataFrame, large: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, large, n, bits, codes) of the texts in pairs: ``large`` for those in large buckets, which are in pairs all; number and
    parity bits of shingles."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"), F.lit(False).alias("large")).unionByName(large.select("id", F.lit(True).alias("large")))
    all_texts = grows(keyed_texts(docs, id_col, text_col).select("id", "text"))
    tried = all_texts.join(ids.groupBy("id").agg(F.max("large").alias("large")), "id").dropDuplicates(["id"]).select("id", "large", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in blocks(whole, "text")):
            codes = [packed(t) for t in b.column("text").to_pylist()]
            # Only members of large buckets are asked for their bits.
            found = [labelled(unpacked(c)) if wanted else None for c, wanted in zip(codes, b.column("large").to_pylist(), strict=True)]
            n = pa.array([None if s is None else len(s) for s in found], pa.int64())
            bits = pa.array([None if s is None else parity(s) for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("large"), n, bits, pa.array(codes, pa.binary())], names=["id", "large", "n", "bits", "codes"])

    return materialize(tried.mapInArrow(run, "id long, large boolean, n long, bits array<long>, codes binary"), "texts")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs whose whole texts reach ``threshold``."""
    texts = texts.select("id", "codes")
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in blocks(whole, "tb")):
            sides = zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True)
            keep = pa.array([similarity(unpacked(x), unpacked(y), threshold) >= threshold for x, y in sides], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of shingles in (id, codes), summed in CELLS cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CELLS, np.int64)
        for b in (x for whole in batches for x in blocks(whole, "codes")):
            for t in b.column("codes").to_pylist():
                np.add.at(sums, (labelled(unpacked(t)) % np.uint64(CELLS)).astype(np.int64), 1)
        at = np.flatnonzero(sums)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)]), pa.array(sums[at[i : i + (1 << 16)]])], names=["cell", "n"])

    found = texts.select("codes").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(f"n > {RARE}").toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return counts


def least_sizes(n: int, threshold: float) -> tuple[int, int]:
    """Of a text of ``n`` shingles, how many of the rarest have one in common with any text alike that is not shorter,
    and with any text alike. (A little more than enough, so that rounding loses none.)"""
    return n - int(np.ceil(2 * threshold / (1 + threshold) * n - 1e-6)) + 1, n - int(np.ceil(threshold * n - 1e-6)) + 1


def rare_shingles(texts: DataFrame, threshold: float) -> DataFrame:
    """(id, n: shingles of the text, bits: their parity, short: rarest ones to meet texts that are not shorter, keys: the rarest in
    order)."""
    shared = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts))  # CELLS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in (x for whole in batches for x in blocks(whole, "codes")):
            rows = []
            for i, t in zip(b.column("id").to_pylist(), b.column("codes").to_pylist(), strict=True):
                codes = unpacked(t)
                if len(codes) < K:  # alike only if equal
                    continue
                s = labelled(codes)
                short, most = least_sizes(len(s), threshold)
                order = np.lexsort((s, counts[(s % np.uint64(CELLS)).astype(np.int64)]))[:most]
                rows.append((i, len(s), parity(s), short, s[order].view(np.int64)))
            ids, sizes, bits, shorts, keys = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            arrays = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(shorts, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "bits", "short", "keys"])

    return texts.select("id", "codes").mapInArrow(run, "id long, n long, bits array<long>, short long, keys array<long>")


def rest_candidates(texts: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct pairs (a, b), a < b, of (id, codes) that can reach ``threshold`` and are not in one class of ``labels``.

    A key whose texts are all in one class is done. Elsewhere the texts outside of the key's largest class meet all texts
    of the key, and thereby each pair of classes meets. A pair need only be made at the first key, in the order of rarity,
    that both have: from there on there must be as many shingles in either as they need in common, and at a later key, where
    one of the rarest (SEEN) of both stands before, it is not made again.
    """
    rows = rare_shingles(texts, threshold).join(grows(labels), "id")
    rows = materialize(rows, "rare-shingles")
    keyed = rows.select("id", "label", "n", "bits", "short", F.posexplode("keys").alias("at", "key"), F.slice("keys", 1, SEEN).alias("first"))
    parts = keyed.groupBy("key", "label").agg(F.count("*").alias("members"), F.max(F.expr("at < short")).alias("opens"))
    several = parts.groupBy("key").agg(F.max_by("label", F.struct("members", "label")).alias("main"), F.count("*").alias("labels"), F.max("opens").alias("opens"))
    met = keyed.join(grows(several.where("labels > 1 AND opens").select("key", "main")), "key")
    met = materialize(met.withColumn("first", F.slice("first", 1, F.least("at", F.lit(SEEN)))), "met")
    outside = met.where("label <> main").select("key", *[F.col(c).alias(f"x_{c}") for c in ("id", "label", "n", "bits", "short", "at", "first")])
    # Where both are outside, one of the two is the one that meets.
    both = outside.join(grows(met), "key").where("x_label <> label AND (label = main OR x_id < id)")
    both = both.where(F.expr("IF(x_n <= n, x_at < x_short, true) AND IF(n <= x_n, at < short, true)"))
    need = threshold / (1 + threshold) * (F.col("n") + F.col("x_n")) - 1e-6
    both = both.where(F.least(F.col("n") - F.col("at"), F.col("x_n") - F.col("x_at")) >= need)
    both = both.where(may_be_alike(("n", "bits"), ("x_n", "x_bits"), threshold))
    both = both.where(~F.arrays_overlap("first", "x_first"))
    return both.select(F.least("id", "x_id").alias("a"), F.greatest("id", "x_id").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every node of (a, b): the least id of its component.

    Each round a node hears its neighbours' labels, and all nodes of a label go on to the least that any of them, or the node
    that the label is named after, has heard; so chains take about as many rounds as their length has binary digits. Labels
    only fall, so this ends: when no node hears of a lesser one. Each round is written, and goes when the next one is there.
    """
    spark = edges.sparkSession
    both, edges_at = written(edges.union(edges.select("b", "a")).toDF("id", "other").distinct(), "edges")
    labels, at = written(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        heard = both.join(labels.toDF("other", "m"), "other").groupBy("id").agg(F.min("m").alias("m"))
        near, near_at = written(labels.join(heard, "id").select("id", "label", F.least("label", "m").alias("next")), "heard")
        if not near.where("next <> label").head(1):
            discard(spark, edges_at)
            discard(spark, near_at)
            return labels
        tops = near.select("label", "next").union(near.select("id", "next")).toDF("next", "top").groupBy("next").agg(F.min("top").alias("top"))
        new, new_at = written(near.join(tops, "next").select("id", F.col("top").alias("label")), "labels")
        discard(spark, at)
        discard(spark, near_at)
        labels, at = new, new_at


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label) when the classes that (a, b) connect are one."""
    of = lambda c: labels.toDF(c, f"l{c}")
    across = links.join(of("a"), "a").join(of("b"), "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
    across = materialize(across.distinct(), "across")
    if not across.head(1):
        return labels
    tops = components(across).toDF("label", "top")
    return materialize(labels.join(tops, "label", "left").select("id", F.coalesce("top", "label").alias("label")), "labels")


def linked(pairs: DataFrame, texts: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``labels`` after all ``pairs``, which are of different classes, are verified, a few of each text first."""
    turn = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.xxhash64("a", "b")))
    ranked = materialize(pairs.withColumn("ra", turn("a")).withColumn("rb", turn("b")).select("a", "b", F.least("ra", "rb").alias("r")), "candidates")
    of = lambda c: labels.toDF(c, f"l{c}")
    given, done = labels, 0
    for upto in WAVES:
        wave = ranked.where((F.col("r") > done) & (F.col("r") <= upto))
        done = upto
        if wave.head(1):
            if labels is not given:  # some are one class by now
                wave = wave.join(of("a"), "a").join(of("b"), "b").where("la <> lb")
            labels = merged(labels, verified(wave.select("a", "b"), texts, threshold))
    return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col`` and ``class_id`` (the least id of the class) of every row.

    Null and blank texts have no words and are one class; repeated rows stay and share theirs. An id with several texts is
    several rows, each in the class of its text; rows with a null id take part, and a class of nothing else has a null
    ``class_id``. Other columns are left behind.
    """
    rows = with_class(docs, id_col, text_col, threshold)
    return rows.select(F.col("doc").alias(id_col), "class_id")


def with_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc, id, class_id, first) of every row: see ``classes`` and ``keyed_texts``; ``first`` is the ``id`` of the row that
    stands for the class: the one of the least doc, null ones last."""
    sigs = materialize(signatures(docs, id_col, text_col), "signatures")
    least = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "id")).alias("least")
    firsts = materialize(sigs.groupBy("words").agg(least, F.any_value("sketches").alias("sketches")).select("words", "least", "least.id", "sketches"), "firsts")
    pairs, large = candidates(firsts.where("size(sketches) > 0").select("id", "sketches"))
    pairs, large = materialize(pairs, "pairs"), materialize(large, "large")
    texts = tried_texts(pairs, large, docs, id_col, text_col)
    found = components(materialize(verified(pairs, texts, threshold), "verified"))
    labels = found
    if large.head(1):
        labels = materialize(texts.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label")), "labels")
        members = materialize(large.join(texts.where("large").select("id", "n", "bits"), "id"), "members")
        for turn in range(HUB_ROUNDS):
            before, labels = labels, merged(labels, verified(hub_candidates(members, labels, turn, threshold), texts, threshold))
            if labels is before:  # nobody found its class
                break
        rest = materialize(rest_candidates(texts.where("large"), labels, threshold), "rest")
        labels = linked(rest, texts, labels, threshold)
    named = firsts.select("words", "least", "id").join(labels, "id", "left").select("words", "least", F.coalesce("label", "id").alias("label"))
    tops = named.groupBy("label").agg(F.min("least").alias("top"))
    named = named.join(tops, "label").select("words", F.col("top.doc").alias("class_id"), F.col("top.id").alias("first"))
    return sigs.select("doc", "id", "words").join(named, "words").select("doc", "id", "class_id", "first")
