"""Cross-tokenizer alignment by interval coalescing.

Two tokenizers cut the same bytes, a space and the text, in different places. All tokens of both are sorted by their first
byte; the running maximum of their ends tells where both have ended, and there a group is cut. Within groups every pair
of tokens that overlap is a link. How often a pair is linked in the whole corpus tells the usual partners of a token.

A text is cut at the spaces where tokens of either kind must begin, and the pieces that a worker meets are aligned once,
many at a time, in arrays over one line of bytes; what it remembers of them is bounded. Each text's links come out as
different pairs with their numbers, in a written table. Pairs are counted from it, summed in each task before they are
shuffled, and looked up for each text: in a broadcast table where there are few enough, else by a join.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.bpe import CUT, EDGE
from quire.llm.common import discard, materialize, written
from quire.llm.worker import blocks, memory

#: Pieces, and their characters, that a worker remembers between blocks of text.
CACHE_PIECES, CACHE_CHARS = 400_000, 16 << 20
#: Different pairs up to which their counts are broadcast (17 bytes each), and that a task sums up before it hands them on.
BROADCAST_PAIRS, TASK_PAIRS = 4_000_000, 500_000
#: Rows of links that are looked at in one go.
ROWS = 1_000
MADE = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others, in order,
    for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers, and the alignment of many pieces of text at once."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet = byte_alphabet()
        vocabulary = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(alphabet[c] for c in vocabulary[i]) if i in vocabulary else b"" for i in range(max(vocabulary) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.b_size = len(pieces)
        way = json.loads(a_json)["pre_tokenizer"] or {}
        #: With a token for every byte and nothing rewritten, A gives back any text.
        self.lossless = way.get("type") == "ByteLevel" and not way.get("add_prefix_space") and self.a.normalizer is None and len({t for t in self.a_bytes if len(t) == 1}) == 256
        #: Whether no token of B goes on into a new word, and A has its words begin at spaces: then texts can be cut there.
        self.cuts = way.get("type") == "ByteLevel" and way.get("use_regex", True) and not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def pieces(self, text: str) -> list[str]:
        """What a text is made of, each piece with the space it begins with."""
        if not self.cuts or SPACE in text:
            return [" " + text]
        odd = text[:1].isspace() or text[-1:].isspace() or EDGE.search(text)
        return [" " + p for p in (CUT.split(text) if odd else text.split(" "))]

    def tokens(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both for each piece, and whether both stand for its very bytes."""
        a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        b = self.b.encode([p[1:] for p in pieces], num_threads=1)
        same = []
        for p, x, y in zip(pieces, a, b, strict=True):
            raw = p.encode()
            same.append(b"".join(map(self.b_bytes.__getitem__, y)) == raw and (self.lossless or b"".join(map(self.a_bytes.__getitem__, x)) == raw))
        return a, b, same

    def align(self, pieces: list[str]) -> Aligned:
        """Groups and links of pieces of text; those whose bytes the tokens don't give back have none."""
        a, b, same = self.tokens(pieces)
        a = [x if s else [] for x, s in zip(a, same, strict=True)]
        b = [x if s else [] for x, s in zip(b, same, strict=True)]
        ids = [np.fromiter((i for x in side for i in x), np.int64, sum(map(len, side))) for side in (a, b)]
        sizes = [np.array([len(t) for t in table], np.int64)[i] for table, i in zip((self.a_bytes, self.b_bytes), ids, strict=True)]
        ends = [np.cumsum(n) for n in sizes]
        starts = [e - n for e, n in zip(ends, sizes, strict=True)]
        # All tokens by their first byte; a group begins where a start reaches the running maximum of the ends before it.
        first, last = np.concatenate(starts), np.concatenate(ends)
        order = np.lexsort((last, first))
        reach = np.maximum.accumulate(last[order]) if len(order) else last
        begins = np.ones(len(order), bool)
        begins[1:] = first[order][1:] >= reach[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(begins) - 1
        n_groups = int(begins.sum())
        of_a, of_b = group[: len(ids[0])], group[len(ids[0]) :]
        # Within groups: from the first B token that ends behind an A token's start to the last that starts before its end.
        low, high = np.searchsorted(ends[1], starts[0], "right"), np.searchsorted(starts[1], ends[0], "left")
        met = high - low
        partner = np.repeat(low - np.cumsum(met) + met, met) + np.arange(int(met.sum()))
        pairs = np.repeat(ids[0], met) * self.b_size + ids[1][partner]
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        a_at, b_at = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        group_at = np.append(of_a, n_groups)[a_at] if len(of_a) else np.zeros(len(pieces) + 1, np.int64)
        link_at = np.concatenate([[0], np.cumsum(met)])[a_at]
        bounds = [np.searchsorted(g, np.arange(n_groups + 1)).tolist() for g in (of_a, of_b)]
        shown = [list(map(str, i.tolist())) for i in ids]
        texts = [
            f"{','.join(shown[0][i:j])}|{','.join(shown[1][k:m])}"
            for i, j, k, m in zip(bounds[0], bounds[0][1:], bounds[1], bounds[1][1:], strict=False)
        ]
        at = group_at.tolist()
        return Aligned(np.array(same, bool), n_a, n_b, np.diff(group_at), pairs, link_at, [";".join(texts[i:j]) for i, j in zip(at, at[1:], strict=False)])


class Aligned:
    """Pieces that are aligned: their numbers of tokens and groups, their links (``pairs[at[i]:at[i + 1]]``: A id times the size
    of B's vocabulary, plus B id) and their groups as text."""

    def __init__(self, same, n_a, n_b, n_groups, pairs, at, texts):  # noqa: ANN001
        self.same, self.n_a, self.n_b, self.n_groups, self.pairs, self.at, self.texts = same, n_a, n_b, n_groups, pairs, at, texts

    def add(self, more: Aligned) -> None:
        for c in ("same", "n_a", "n_b", "n_groups", "pairs"):
            setattr(self, c, np.concatenate([getattr(self, c), getattr(more, c)]))
        self.at = np.concatenate([self.at, self.at[-1] + more.at[1:]])
        self.texts += more.texts


class _Known:
    """What a worker remembers: the alignment of pieces, by their text."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars, self.store = 0, self.aligner.align([])

    def learn(self, texts: list[list[str]]) -> None:
        """Align all pieces of these texts that aren't known."""
        new = set().union(*texts).difference(self.index)
        size = sum(map(len, new))
        if len(self.index) + len(new) > CACHE_PIECES or self.chars + size > CACHE_CHARS:
            self.clear()
            new = set().union(*texts)
            size = sum(map(len, new))
        if not new:
            return
        fresh = list(new)
        self.store.add(self.aligner.align(fresh))
        self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh)), strict=True))
        self.chars += size


def _known(key: str, packed) -> _Known:  # noqa: ANN001
    kept = memory("align")
    if kept.get("aligner", (None,))[0] != key:
        kept["aligner"] = (key, _Known(Aligner(*packed.value)))
    return kept["aligner"][1]


def _taken(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``values[at[i]:at[i + 1]]`` of each i in ``which``, joined."""
    n = at[which + 1] - at[which]
    return values[np.repeat(at[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


def _lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


def linked(df: DataFrame, a_json: bytes, b_model: bytes, text_col: str = "text", groups: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row with its numbers of tokens, groups and links, the columns of ``groups`` (``groups``: `a1,a2|b1;a3|b2,b3`;
    ``groups_sha256``: its digest), and its links as ``pairs`` and ``times``: different pairs, and how many links of each."""
    key = uuid.uuid4().hex
    packed = df.sparkSession.sparkContext.broadcast((a_json, b_model))  # two vocabularies
    rows = df.select(*keep, F.col(text_col).alias("_text"))
    numbers = [T.StructField(c, T.LongType()) for c in MADE[:4]]
    listed = [T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([rows.schema[c] for c in keep] + numbers + [T.StructField(c, T.StringType()) for c in groups] + listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(key, packed)
        whole_pairs = known.aligner.b_size * len(known.aligner.a_bytes)
        for big in batches:
            for batch in blocks(big, "_text"):
                texts = [known.aligner.pieces(t) if t else [] for t in batch.column("_text").to_pylist()]
                known.learn(texts)
                store, index = known.store, known.index
                sizes = np.array([len(t) for t in texts], np.int64)
                at = np.concatenate([[0], np.cumsum(sizes)])
                which = np.fromiter((index[p] for t in texts for p in t), np.int64, int(at[-1]))
                doc = np.repeat(np.arange(len(texts)), sizes)
                # Where a piece's bytes aren't given back, the text is tried as a whole: its tokens may still give its bytes.
                bad = np.unique(doc[~store.same[which]]).tolist()
                spoilt = np.zeros(len(texts), bool)
                spoilt[bad] = True
                alone = {d: known.aligner.align(["".join(texts[d])]) for d in bad if len(texts[d]) > 1}
                which, doc = which[~spoilt[doc]], doc[~spoilt[doc]]
                total = lambda x, d=doc, w=which: np.bincount(d, x[w], len(texts)).astype(np.int64)  # noqa: B023, E731
                n_links = store.at[1:] - store.at[:-1]
                made = [total(store.n_a), total(store.n_b), total(store.n_groups), total(n_links)]
                links, owner = _taken(store.pairs, store.at, which), np.repeat(doc, n_links[which])
                shown = [";".join([store.texts[index[p]] for p in t]) if not s else "" for t, s in zip(texts, spoilt, strict=True)]
                for d, x in alone.items():
                    for column, v in zip(made, (x.n_a, x.n_b, x.n_groups, np.diff(x.at)), strict=True):
                        column[d] = v[0]
                    shown[d] = x.texts[0]
                    links, owner = np.concatenate([links, x.pairs]), np.concatenate([owner, np.full(len(x.pairs), d)])
                each, times = np.unique(owner * whole_pairs + links, return_counts=True)
                list_at = np.searchsorted(each // whole_pairs, np.arange(len(texts) + 1))
                out = {"groups": lambda s=shown: s, "groups_sha256": lambda s=shown: [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in s]}
                arrays = [batch.column(c) for c in keep] + [pa.array(m, pa.int64()) for m in made] + [pa.array(out[c](), pa.string()) for c in groups]
                arrays += [_lists(each % whole_pairs, list_at, pa.int64()), _lists(times, list_at, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


def pair_counts(links: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best) of all pairs of a table with ``pairs`` and ``times``: the pair's links in all, and whether no other pair
    of its B id has more. Each task sums what it reads before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

        def table(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

        memory("pairs")  # what the worker remembers of pieces goes
        parts, held = [], 0
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            parts.append((b.column("pairs").flatten().to_numpy(zero_copy_only=False), b.column("times").flatten().to_numpy(zero_copy_only=False)))
            held += len(parts[-1][0])
            if held > 2 * TASK_PAIRS:
                parts = [summed(parts)]
                held = len(parts[0][0])
                if held > TASK_PAIRS:
                    yield table(*parts[0])
                    parts, held = [], 0
        if held:
            yield table(*summed(parts))

    counts = links.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts, path = written(counts, "pair-counts")
    b = (F.col("pair") % b_size).cast("int").alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))  # a row for each id of B
    out = materialize(counts.select("pair", "n", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    discard(links.sparkSession, path)
    return out


def _looked_up(links: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_best`` and ``count_sum`` by a broadcast table of all pairs."""
    table = pairs.orderBy("pair").toArrow()  # at most BROADCAST_PAIRS rows
    held = tuple(table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))
    sent = links.sparkSession.sparkContext.broadcast(held)
    schema = T.StructType([links.schema[c] for c in columns] + [T.StructField(c, T.LongType()) for c in MADE[4:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory("pairs")
        pair, n, best = sent.value
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            keys, times = (batch.column(c) for c in ("pairs", "times"))
            at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(keys).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            where = np.searchsorted(pair, keys.flatten().to_numpy(zero_copy_only=False))
            weight = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[at]) for x in (best[where] * weight, n[where] * weight)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(s, pa.int64()) for s in sums], names=schema.names)

    return links.select(*columns, "pairs", "times").mapInArrow(run, schema)


def _joined(links: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """The same by a join on pairs and a sum by row, for any number of pairs."""
    each = links.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = each.join(pairs, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return links.select("_row", *columns).join(sums, "_row", "left").select(*columns, *map(zero, MADE[4:]))


def align(
    df: DataFrame, a_json: bytes, b_model: bytes, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("groups",),
    keep: tuple[str, ...] = (), broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """``id_col``, the columns of ``keep``, MADE and those of ``groups`` (see ``linked``) of each row.

    A encodes a space and the text by a byte-level vocabulary (its JSON file), B the text by a sentencepiece model, which adds
    the space; neither takes special tokens. ``n_best`` counts links whose pair is the commonest of its B id in the corpus,
    ties included, ``count_sum`` adds up the counts of all links' pairs. Null and empty texts, and texts whose bytes the
    tokens of A or of B don't give back, have no tokens: zeros, and empty strings. Rows come back one for one, so repeated
    rows stay and count, null ids too; other columns, also such as are named like those made here, are left behind.
    """
    spark = df.sparkSession
    columns = [c for c in dict.fromkeys([id_col, *keep]) if c not in (*MADE, *groups, "_row", "pairs", "times", "_text")]
    links = linked(df, a_json, b_model, text_col, groups, tuple(columns)).withColumn("_row", F.monotonically_increasing_id())
    links, links_path = written(links, "links")
    b_size = Aligner(a_json, b_model).b_size
    pairs = pair_counts(links, b_size)
    made = [*columns, *MADE[:4], *groups]
    out = (_looked_up if pairs.count() <= broadcast_pairs else _joined)(links, pairs, made)
    out = materialize(out, "aligned").select(*columns, *MADE, *groups)
    discard(spark, links_path)
    return out
