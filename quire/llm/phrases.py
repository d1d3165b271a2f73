"""Phrase collocations by HAT-tries.

Each task counts the phrases of its texts in a trie of word ids that is shallow at first: hash containers hang below the
first words, and one that grows too large bursts into a container for each next word. When the trie is full, whole
subtrees leave it, those first in which phrases repeat least, as sorted runs; a hash partition of prefixes merges the runs
of all tasks, and a hot prefix is dealt out over several. Lengths are counted one after the other: a phrase can only be frequent if what it begins
and ends with is, which a filter of fixed size (bits by hash, no frequent phrase is missing) tells in the tasks. So the
pruned work follows the frequent phrases, and the counts are those of all texts.
"""

from __future__ import annotations

import gc
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import discard, materialize, written
from quire.llm.worker import blocks

UNKNOWN_LANG = "und"
#: Phrases of so many words at most and at least so frequent; permille of a longer one from which a shorter one goes; report.
MAX_WORDS, LEAST, COVERED_PERCENT, TOP = 3, 10, 50, 2000
#: Entries of a container before it bursts, of a trie before subtrees leave it, and words that a task remembers.
BURST, MOST_ENTRIES, MOST_WORDS = 4_096, 1_200_000, 500_000
#: Occurrences that a task gathers before it adds them to its trie in one go.
GATHERED = 500_000
#: Parts that the phrases of one prefix are dealt out to; bits of a filter for each phrase in it, and bits at most.
SPLITS, FILTER_BITS, MOST_FILTER_BITS = 64, 16, 1 << 27
#: Bytes to themselves but for letters to lower case, separators to a full stop, and the tab to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
ID_BITS = 21  # three word ids in a long
#: Words that get ids in one go.
SLICE = 1_000_000
BLOCK_BYTES = 4 << 20
BREAK = b"."  # between pieces; no word has it


class HatTrie:
    """Counts of phrases of ``words`` word ids, packed ID_BITS for each into one number."""

    def __init__(self, words: int):
        self.words, self.entries = words, 0
        #: By first word: a container (dict from the packed rest to its count) or, burst, a node (list with one dict of containers).
        self.root: dict[int, dict | list] = {}
        #: Single words have nothing below them: their counts by id.
        self.flat = np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of different packed phrases in rising order."""
        if self.words == 1:
            if len(keys) and keys[-1] >= len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(int(keys[-1]) + 1, np.int64)])
            self.flat[keys] += counts
            self.entries = int(np.count_nonzero(self.flat))
            return
        shift = ID_BITS * (self.words - 1)
        firsts = keys >> shift
        cuts = np.flatnonzero(np.diff(firsts)) + 1
        rest, n = (keys & ((1 << shift) - 1)).tolist(), counts.tolist()
        starts = [0, *cuts.tolist()][: len(keys)]
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=False):
            first = int(firsts[a])
            at = self.root.get(first)
            if isinstance(at, list):
                self._add_below(at[0], rest[a:b], n[a:b])
                continue
            if at is None:
                at = self.root[first] = dict(zip(rest[a:b], n[a:b], strict=True))
                self.entries += len(at)
            else:
                before = len(at)
                for k, c in zip(rest[a:b], n[a:b], strict=True):
                    at[k] = at.get(k, 0) + c
                self.entries += len(at) - before
            if len(at) > BURST and self.words > 2:
                self.root[first] = [self._burst(at)]

    def _burst(self, container: dict) -> dict:
        """A container's entries by their next word."""
        shift = ID_BITS * (self.words - 2)
        node: dict[int, dict] = {}
        for k, c in container.items():
            node.setdefault(k >> shift, {})[k & ((1 << shift) - 1)] = c
        return node

    def _add_below(self, node: dict, rest: list[int], n: list[int]) -> None:
        shift = ID_BITS * (self.words - 2)
        low = (1 << shift) - 1
        for k, c in zip(rest, n, strict=True):
            at = node.get(k >> shift)
            if at is None:
                at = node[k >> shift] = {}
            before = len(at)
            at[k & low] = at.get(k & low, 0) + c
            self.entries += len(at) - before

    def _size(self, at: dict | list) -> tuple[int, int]:
        """Entries and occurrences of a subtree."""
        parts = [at] if isinstance(at, dict) else at[0].values()
        return sum(map(len, parts)), sum(sum(p.values()) for p in parts)

    def coldest(self, least: int) -> list[int]:
        """First words of subtrees that together have ``least`` entries, those with the fewest occurrences of an entry first."""
        sizes = [(*self._size(at), f) for f, at in self.root.items()]
        out, total = [], 0
        for n, _, f in sorted(sizes, key=lambda x: (x[1] / x[0], x[2])):
            if total >= least:
                break
            out.append(f)
            total += n
        return out

    def spill(self, firsts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Take subtrees (all, if none are named) out: packed phrases and their counts."""
        if self.words == 1:
            keys = np.flatnonzero(self.flat)
            counts = self.flat[keys]
            self.flat, self.entries = np.zeros(0, np.int64), 0
            return keys, counts
        shift, low = ID_BITS * (self.words - 1), ID_BITS * (self.words - 2)
        heads, parts = [], []
        for f in list(self.root) if firsts is None else firsts:
            at = self.root.pop(f)
            for w, part in [(0, at)] if isinstance(at, dict) else at[0].items():
                heads.append(f << shift | w << low)
                parts.append(part)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        total = int(sizes.sum())
        self.entries -= total
        keys = np.fromiter(chain.from_iterable(parts), np.int64, total) | np.repeat(np.array(heads, np.int64), sizes)
        return keys, np.fromiter(chain.from_iterable(map(dict.values, parts)), np.int64, total)


class _Words(dict):
    """Ids of one language's words; 0 for a break and for words that the filter does not have."""

    def __init__(self, lang: str, names: list, hashes: array, bits: np.ndarray | None):
        self.lang, self.names, self.hashes = lang, names, hashes
        #: By bytes, of which plain Python takes one out faster.
        self.bits = None if bits is None else bits.astype("<u8", copy=False).tobytes()
        self[BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        h = word_hash(self.lang, word)
        if self.bits is not None and not self.bits[(h % (len(self.bits) * 8)) >> 3] >> (h & 7) & 1:
            self[word] = 0
            return 0
        self[word] = n = len(self.names)
        self.names.append((self.lang, word))
        self.hashes.append(h)
        return n


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word)


def phrase_hash(hashes: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of their words, in order."""
    out = hashes[0]
    for h in hashes[1:]:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h
        out ^= out >> np.uint64(32)
    return out


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[(h % np.uint64(len(bits) * 64)) >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1) != 0


def counted(df: DataFrame, n: int, words: Broadcast | None = None, parts: Broadcast | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, n) of all phrases of ``n`` words whose words ``words`` has and whose first and last ``n - 1`` words
    ``parts`` has (filters; none lets all pass)."""
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    names = ["cell", "lang", "phrase", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here refers to itself, and a search of all containers for what does takes a quarter of the time
        try:
            yield from task(batches)
        finally:
            gc.enable()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, part_bits = (None if b is None else b.value for b in (words, parts))
        trie, ids, known, hashes = HatTrie(n), {}, [(None, b"")], array("Q", [0])
        gathered: list[np.ndarray] = []

        def runs(firsts: list[int] | None = None) -> Iterator[pa.RecordBatch]:
            """A sorted run: by language, then word by word. ``cell`` is the prefix's partition, and the part of it."""
            keys, counts = trie.spill(firsts)
            if not len(keys):
                return
            texts, langs = pa.array([w for _, w in known], pa.binary()), pa.array([g for g, _ in known], pa.string())
            cols = [keys >> (ID_BITS * k) & ((1 << ID_BITS) - 1) for k in reversed(range(n))]
            rank = np.empty(len(known), np.int64)
            rank[pa.compute.sort_indices(texts).to_numpy()] = np.arange(len(known))
            lang_rank = langs.dictionary_encode()
            code = np.argsort(np.argsort(np.array(lang_rank.dictionary.to_pylist(), object)))[lang_rank.indices.fill_null(0).to_numpy(zero_copy_only=False)]
            order = np.lexsort([*[rank[c] for c in reversed(cols)], code[cols[0]]])
            h = np.frombuffer(hashes, np.uint64).copy()
            for at in range(0, len(order), 50_000):
                part = order[at : at + 50_000]
                ws = [texts.take(pa.array(c[part])) for c in cols]
                phrases = pa.compute.binary_join_element_wise(*ws, b" ") if n > 1 else ws[0]
                cell = h[cols[0][part]] * np.uint64(SPLITS) + (h[cols[1][part]] % np.uint64(SPLITS) if n > 1 else np.uint64(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((cell & np.uint64(0x7FFFFFFF)).astype(np.int32)), langs.take(pa.array(cols[0][part])), phrases.cast(pa.string()), pa.array(counts[part], pa.int64())], names=names
                )

        def add(table: _Words, tokens: list[bytes]) -> None:
            at = np.fromiter(map(table.__getitem__, tokens), np.int64, len(tokens))
            cols = [at[i : len(at) - n + 1 + i] for i in range(n)]
            whole = np.logical_and.reduce([c > 0 for c in cols])
            cols = [c[whole] for c in cols]
            if part_bits is not None and len(cols[0]):
                h = np.frombuffer(hashes, np.uint64).copy()
                hs = [h[c] for c in cols]
                good = _has(part_bits, phrase_hash(hs[:-1])) & _has(part_bits, phrase_hash(hs[1:]))
                cols = [c[good] for c in cols]
            key = cols[0]
            for c in cols[1:]:
                key = key << ID_BITS | c
            gathered.append(key)

        def settle() -> None:
            """What was gathered goes to the trie, in which a first word of many texts is looked up once."""
            if gathered:
                trie.add(*np.unique(np.concatenate(gathered), return_counts=True))
                gathered.clear()

        for big in batches:
            for batch in blocks(big, "text", BLOCK_BYTES):
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    tokens = b".".join(texts).translate(FOLD).replace(BREAK, b" . ").split()
                    # Slices overlap by the words that a phrase goes on; so ids stay below ID_BITS, however long a text.
                    for start in range(0, len(tokens) - n + 1, SLICE):
                        table = ids.get(lang)
                        if table is None:
                            table = ids[lang] = _Words(lang, known, hashes, bits)
                        add(table, tokens[start : start + SLICE + n - 1])
                        if len(known) > MOST_WORDS or sum(map(len, ids.values())) > 2 * MOST_WORDS:
                            settle()
                            yield from runs()
                            ids.clear(), known.clear()
                            known.append((None, b""))
                            del hashes[1:]
                        elif sum(map(len, gathered)) > GATHERED:
                            settle()
                            if trie.entries > MOST_ENTRIES:
                                yield from runs(trie.coldest(trie.entries // 2))
        settle()
        yield from runs()

    merged = rows.mapInArrow(run, "cell int, lang string, phrase string, n long").repartition("cell")
    return merged.groupBy("cell", "lang", "phrase").agg(F.sum("n").alias("n")).select("lang", "phrase", "n")


def phrase_filter(frequent: DataFrame) -> Broadcast:
    """Bits by hash of a table (lang, phrase): all of its phrases are in, few others. Its size is bounded whatever the table's."""
    rows = frequent.count()
    size = 1 << 16
    while size < min(rows * FILTER_BITS, MOST_FILTER_BITS):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, phrases = (b.column(c).to_pylist() for c in ("lang", "phrase"))
            if not langs:
                continue
            words = [[word_hash(g, w.encode()) for w in p.split(" ")] for g, p in zip(langs, phrases, strict=True)]
            h = phrase_hash(list(np.array(words, np.uint64).T)) % np.uint64(size)
            bit = np.left_shift(np.uint64(1), h & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(6)).astype(np.int64)), pa.array(bit)], names=["cell", "bits"])

    cells = frequent.select("lang", "phrase").mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most size / 64 rows
    out = np.zeros(size // 64, np.uint64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(out)


def _first(k: int) -> Column:
    return F.substring_index("phrase", " ", k)


def _score(a: str, left: str, right: str) -> Column:
    whole = "cast({} AS decimal(38,0))".format
    return F.expr(f"({whole(1000000)} * {a} * {a}) div ({whole(left)} * {right})")


def candidates(counts: dict[int, DataFrame], n: int) -> DataFrame:
    """Phrases of ``n`` words with their lowest-scoring cut: (lang, phrase, a, l, r, score)."""
    out = counts[n].withColumnRenamed("n", "a")
    side = lambda k, name: counts[k].select("lang", F.col("phrase").alias(f"_{name}"), F.col("n").alias(name))
    cuts = []
    for k in range(1, n):
        out = out.withColumn("_l", _first(k)).withColumn("_r", _first(k - n)).join(side(k, "l"), ["lang", "_l"]).join(side(n - k, "r"), ["lang", "_r"])
        cuts.append(F.struct(F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"), F.col(f"s{k}").alias("score")))
        out = out.withColumn(f"s{k}", _score("a", "l", "r")).withColumnsRenamed({"l": f"l{k}", "r": f"r{k}"}).drop("_l", "_r")
    lowest = F.array_min(F.array(*[F.struct(c["score"].alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")) for c in cuts]))
    return out.select("lang", "phrase", "a", lowest.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, covered_percent: int = COVERED_PERCENT, top: int = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases of 2 to ``max_words`` words.

    Texts are put in lower case (A to Z), pieces end at `.,;:!?` and line ends, words at spaces and tabs. ``a`` is how often a
    phrase occurs within pieces, ``l`` and ``r`` the parts of its lowest-scoring cut (the first of equal ones), ``n`` all words
    of the language, the score a * a * 1000000 / (l * r), rounded down. Phrases inside a longer one that is at least
    ``covered_percent`` as frequent are left out; all of at least ``least`` occurrences take part in that. Null languages are
    `und`, null and empty texts have no words, repeated rows count again, other columns are left behind; an empty table gives
    no row. Ties go to the larger ``a``, then the phrase that comes first in bytes.
    """
    if not 2 <= max_words <= 3:
        raise ValueError("phrases have 2 or 3 words")
    spark, paths = df.sparkSession, []

    def kept(counts: DataFrame, name: str) -> DataFrame:
        out, path = written(counts, name)
        paths.append(path)
        return out

    args = {"text_col": text_col, "lang_col": lang_col}
    words = kept(counted(df, 1, **args), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    counts = {1: words.where(F.col("n") >= least)}
    filters = {1: phrase_filter(counts[1])}
    for n in range(2, max_words + 1):
        counts[n] = kept(counted(df, n, filters[1], filters[n - 1] if n > 2 else None, **args).where(F.col("n") >= least), f"phrases-{n}")
        if n < max_words:
            filters[n] = phrase_filter(counts[n])
    parts = []
    for n in range(2, max_words + 1):
        found = candidates(counts, n)
        for m in range(n + 1, max_words + 1):
            inner = F.array_distinct(F.array(*[F.substring_index(_first(i + n), " ", -n) for i in range(m - n + 1)]))
            longer = counts[m].select("lang", F.explode(inner).alias("phrase"), F.col("n").alias("_n")).groupBy("lang", "phrase").agg(F.max("_n").alias("_longer"))
            found = found.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("_longer") * 100 < F.col("a") * covered_percent, F.lit(True))).drop("_longer")
        parts.append(found)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = every.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    out = materialize(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    for p in paths:
        discard(spark, p)
    return out


def oracle(max_words: int = MAX_WORDS, least: int = LEAST, covered_percent: int = COVERED_PERCENT, top: int = TOP) -> str:
    """The same in SQL for phrases of 2 and 3 words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    gram = lambda n: f"SELECT lang, array_to_string(ws[i : i + {n - 1}], ' ') AS phrase, count(*) AS c FROM w WHERE i + {n - 1} <= len(ws) GROUP BY ALL"
    score = lambda a, x, y: f"CAST((1000000::HUGEINT * {a} * {a}) // ({x}::HUGEINT * {y}) AS BIGINT)"
    return rf"""
WITH d AS (SELECT coalesce(lang, '{UNKNOWN_LANG}') AS lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
s AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
w AS MATERIALIZED (SELECT lang, ws, CAST(unnest(range(1, len(ws) + 1)) AS BIGINT) AS i FROM s),
g1 AS MATERIALIZED ({gram(1)}), g2 AS MATERIALIZED ({gram(2)}), g3 AS MATERIALIZED ({gram(3)}),
t AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM g1 GROUP BY lang),
c2 AS (SELECT g.lang, g.phrase, g.c AS a, x.c AS l, y.c AS r, {score('g.c', 'x.c', 'y.c')} AS score FROM g2 g
  JOIN g1 x ON x.lang = g.lang AND x.phrase = split_part(g.phrase, ' ', 1) JOIN g1 y ON y.lang = g.lang AND y.phrase = split_part(g.phrase, ' ', 2) WHERE g.c >= {least}),
f3 AS (SELECT *, split_part(phrase, ' ', 1) AS w1, split_part(phrase, ' ', 2) AS w2, split_part(phrase, ' ', 3) AS w3 FROM g3 WHERE c >= {least}),
b3 AS (SELECT f.lang, f.phrase, f.c AS a, x.c AS l1, y.c AS r1, {score('f.c', 'x.c', 'y.c')} AS s1, u.c AS l2, v.c AS r2, {score('f.c', 'u.c', 'v.c')} AS s2 FROM f3 f
  JOIN g1 x ON x.lang = f.lang AND x.phrase = f.w1 JOIN g2 y ON y.lang = f.lang AND y.phrase = f.w2 || ' ' || f.w3
  JOIN g2 u ON u.lang = f.lang AND u.phrase = f.w1 || ' ' || f.w2 JOIN g1 v ON v.lang = f.lang AND v.phrase = f.w3),
c3 AS (SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END AS l, CASE WHEN s2 < s1 THEN r2 ELSE r1 END AS r, least(s1, s2) AS score FROM b3),
m AS (SELECT lang, phrase, max(c) AS c FROM (SELECT lang, w1 || ' ' || w2 AS phrase, c FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, c FROM f3) GROUP BY ALL),
e AS (SELECT c2.* FROM c2 LEFT JOIN m ON m.lang = c2.lang AND m.phrase = c2.phrase WHERE coalesce(100 * m.c < {covered_percent} * c2.a, true) UNION ALL SELECT * FROM c3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score FROM k JOIN t ON t.lang = k.lang WHERE k.rank <= {top}"""
