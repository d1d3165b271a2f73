"""Byte-level BPE by corpus-level merge replay.

Texts are cut into chunks at the spaces where a pre-token must begin, and Spark counts the chunks of the whole corpus.
The commonest, up to a fixed number, are split into pre-tokens and replayed once for the whole corpus, hash partition by
hash partition: an inverted index leads from the rank of a token pair to the positions in words where the pair stands,
ranks are taken in rising order, every position of a rank is merged, and only the two touched neighbours enter the index
again. Their encodings are broadcast. A second pass puts the documents together from them; the pre-tokens left over, rare
ones, are replayed where they stand, over an index of their block's, so that nothing is dropped. Documents never leave their partition, and a hot source
costs no more than any other.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import materialize
from quire.llm.worker import blocks, memory

#: Chunks at most whose encodings are broadcast, and their bytes at most.
COMMON_CHUNKS, COMMON_BYTES = 150_000, 8 << 20
#: Bound on chunks of text, and their characters, that a Python worker remembers between batches.
CACHE_CHUNKS, CACHE_CHARS = 150_000, 16 << 20
#: Longer chunks are taken pre-token by pre-token; words of one index.
LONG_CHUNK, INDEX_WORDS = 64, 20_000
#: No pre-token goes on past a space between two other characters: it begins there, and a space with letters, or a run of
#: marks, is one. True of the byte-level patterns in use.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Texts in which a space has white space beside it can't be cut at every space.
EDGE = re.compile(r" \s|\s ")
#: The same for Spark's functions; white space as Python's ``\s`` has it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
MARKS = ".,;:!?)]"


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks file: one ``base64(token) rank`` per line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


class MergeReplay:
    """The merges of one vocabulary, replayed over blocks of distinct byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.byte_rank = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {
            ranks[t[:i]] << 32 | ranks[t[i:]]: r
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        self.text_of = {r: str(r) for r in self.bytes_of}

    def replay(self, words: Iterable[bytes]) -> list[list[int]]:
        """Ids of words by the inverted index over all of them."""
        words, pairs, byte_rank = list(words), self.pairs, self.byte_rank
        tok: list[int] = []
        nxt: list[int] = []
        prv: list[int] = []
        pair: list[int] = []
        starts: list[int] = []
        index: dict[int, list[int]] = defaultdict(list)
        for w in words:
            s = len(tok)
            starts.append(s)
            whole = self.ranks.get(w)
            if whole is not None:  # a word of the vocabulary is its own encoding
                tok.append(whole), nxt.append(-1), prv.append(-1), pair.append(-1)
                continue
            n = len(w)
            tok.extend(byte_rank[b] for b in w)
            nxt.extend(range(s + 1, s + n))
            prv.append(-1)
            prv.extend(range(s, s + n - 1))
            if n:
                nxt.append(-1)
            else:
                prv.pop(), starts.pop(), starts.append(-1)
            for i in range(s, s + n - 1):
                r = pairs.get(tok[i] << 32 | tok[i + 1], -1)
                pair.append(r)
                if r >= 0:
                    index[r].append(i)
            if n:
                pair.append(-1)
        ranks = list(index)
        heapq.heapify(ranks)
        while ranks:
            r = heapq.heappop(ranks)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()  # leftmost first within each word
            for p in places:
                if pair[p] != r:
                    continue
                q = nxt[p]
                tok[p] = r
                pair[q] = -1
                after = nxt[p] = nxt[q]
                before, earlier = prv[p], False
                if after >= 0:
                    prv[after] = p
                    new = pair[p] = pairs.get(r << 32 | tok[after], -1)
                    if new >= 0:
                        earlier = new < r
                        if new not in index:
                            heapq.heappush(ranks, new)
                        index[new].append(p)
                else:
                    pair[p] = -1
                if before >= 0:
                    new = pair[before] = pairs.get(tok[before] << 32 | r, -1)
                    if new >= 0:
                        earlier = earlier or new < r
                        if new not in index:
                            heapq.heappush(ranks, new)
                        index[new].append(before)
                if earlier:  # a pair of lower rank arose: this word alone goes on in its own order
                    self._finish(p, tok, nxt, prv, pair)
        out = []
        for s in starts:
            ids = []
            while s >= 0:
                ids.append(tok[s])
                s = nxt[s]
            out.append(ids)
        return out

    def _finish(self, p: int, tok: list, nxt: list, prv: list, pair: list) -> None:
        while prv[p] >= 0:
            p = prv[p]
        while True:
            best, at, i = -1, -1, p
            while i >= 0:
                if pair[i] >= 0 and (best < 0 or pair[i] < best):
                    best, at = pair[i], i
                i = nxt[i]
            if at < 0:
                return
            q = nxt[at]
            tok[at], pair[q] = best, -1
            after = nxt[at] = nxt[q]
            if after >= 0:
                prv[after] = at
                pair[at] = self.pairs.get(best << 32 | tok[after], -1)
            else:
                pair[at] = -1
            if prv[at] >= 0:
                pair[prv[at]] = self.pairs.get(tok[prv[at]] << 32 | best, -1)

    def encode_words(self, words: Iterable[bytes]) -> list[list[int]]:
        """Ids of any number of words: an index over INDEX_WORDS of them at a time."""
        words = list(words)
        return list(chain.from_iterable(self.replay(words[i : i + INDEX_WORDS]) for i in range(0, len(words), INDEX_WORDS)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def entries(self, ids: list[int], offsets: list[int]) -> Iterator[tuple[str, int, bytes]]:
        """What documents are put together from, of each list of ids between two offsets: the decimal ids joined by a space,
        their number, the decoded bytes."""
        shown, raw = list(map(self.text_of.__getitem__, ids)), list(map(self.bytes_of.__getitem__, ids))
        for a, b in pairwise(offsets):
            yield (shown[a], 1, raw[a]) if b - a == 1 else (" ".join(shown[a:b]), b - a, b"".join(raw[a:b]))


def chunks_of(text: str) -> list[str]:
    """A text cut before every space at which a pre-token must begin; long chunks too."""
    parts = CUT.split(text) if EDGE.search(text) else text.split(" ")
    return [parts[0], *[" " + x for x in parts[1:]]]


def chunk_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(chunk, n) of the distinct chunks of all texts, but for long ones, which go pre-token by pre-token."""
    text = F.col(text_col)
    parts = F.when(text.rlike(f" {SPACE}|{SPACE} "), F.split(text, f"(?<!{SPACE}|^) (?!{SPACE}|$)")).otherwise(F.split(text, " "))
    rows = df.select(F.posexplode(parts).alias("at", "part"))
    chunk = F.when(F.col("at") == 0, F.col("part")).otherwise(F.concat(F.lit(" "), "part"))
    return rows.where(F.length("part") <= LONG_CHUNK).groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n"))


def common_chunks(counts: DataFrame, most: int = COMMON_CHUNKS, most_bytes: int = COMMON_BYTES) -> DataFrame:
    """The commonest short ones of (chunk, n): all whose count lies in the highest classes that together keep both bounds.
    Classes are eighths of powers of two, so that a short table tells where to cut."""
    classed = counts.where(F.length("chunk") <= LONG_CHUNK).withColumn("class", F.floor(F.log2("n") * 8).cast("int"))
    sizes = classed.groupBy("class").agg(F.count("*").alias("n"), F.sum(F.octet_length("chunk")).alias("bytes")).collect()  # at most 8 x 63 rows
    chunks = size = 0
    least = None
    for r in sorted(sizes, key=lambda r: -r["class"]):
        chunks, size = chunks + r.n, size + r.bytes
        if chunks > most or size > most_bytes:
            break
        least = r["class"]
    return classed.where(F.lit(False) if least is None else F.col("class") >= least).select("chunk")


def dictionary(chunks: DataFrame, ranks: bytes, pattern: str) -> pa.Table:
    """(chunk, ids) of a bounded number of chunks: the pre-tokens of each hash partition are replayed once."""
    packed = chunks.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, findall = [c for b in batches for c in b.column(0).to_pylist()], regex.compile(pattern).findall
        pieces = [pieces_of(c, findall) for c in mine]
        words = list(set().union(*pieces))
        ids = dict(zip(words, _replay(packed.value).replay([w.encode() for w in words]) if words else [], strict=True))
        for i in range(0, len(mine), 50_000):
            made = [[x for w in ws for x in ids[w]] for ws in pieces[i : i + 50_000]]
            yield pa.RecordBatch.from_arrays([pa.array(mine[i : i + 50_000], pa.string()), pa.array(made, pa.list_(pa.int32()))], names=["chunk", "ids"])

    return chunks.repartition("chunk").mapInArrow(run, "chunk string, ids array<int>").toArrow()


def pieces_of(chunk: str, findall: Callable[[str], list[str]]) -> list[str]:
    """Pre-tokens of a chunk; a word with closing marks needs no pattern."""
    word = chunk.rstrip(MARKS)
    if word[1:].isalpha() and word[0] == " ":
        return [word, chunk[len(word) :]] if len(word) < len(chunk) else [word]
    return findall(chunk)


def _replay(ranks: bytes) -> MergeReplay:
    """Tables of a vocabulary, built once for each Python worker."""
    kept, key = memory("bpe"), hashlib.sha256(ranks).digest()
    if kept.get("vocabulary", (None,))[0] != key:
        kept["vocabulary"] = (key, MergeReplay(parse_ranks(ranks)))
    return kept["vocabulary"][1]


class _Corpus:
    """What a Python worker knows of one corpus: encodings of the common chunks, and of others met so far."""

    def __init__(self, replay: MergeReplay, pattern: str, table: pa.Table):
        self.replay, self.findall = replay, regex.compile(pattern).findall
        ids = table["ids"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
        self.common = dict(zip(table["chunk"].to_pylist(), replay.entries(ids.flatten().to_pylist(), ids.offsets.to_pylist()), strict=True))
        self.known, self.chars = dict(self.common), 0
        gc.freeze()  # these stay as long as the worker: no need to look through them again

    def chunks(self, text: str) -> list[str]:
        """A text's chunks; pre-tokens in place of long ones."""
        out = chunks_of(text)
        if max(map(len, out)) > LONG_CHUNK:
            out = [x for c in out for x in ((c,) if len(c) <= LONG_CHUNK else self.findall(c))]
        return out

    def learn(self, texts: list[list[str]]) -> dict[str, tuple[str, int, bytes]]:
        """Encodings of all chunks of these texts. Pre-tokens that are not known are replayed here."""
        known, met = self.known, set().union(*texts)
        new = met.difference(known)
        size = sum(map(len, new))
        if len(known) - len(self.common) + len(new) > CACHE_CHUNKS or self.chars + size > CACHE_CHARS:  # go on with this block's
            kept = {c: known[c] for c in met if c in known}
            known.clear()
            known.update(self.common)
            known.update(kept)
            self.chars = sum(map(len, kept))
        self.chars += size
        words = {c for c in new if c[1:].isalpha() and (c[0] == " " or c[0].isalpha())}  # each is one pre-token
        pieces = {c: pieces_of(c, self.findall) for c in new.difference(words)}
        rare = list(words.union(*pieces.values()).difference(known))
        ids = self.replay.encode_words([w.encode() for w in rare])
        known.update(zip(rare, self.replay.entries(list(chain.from_iterable(ids)), [0, *accumulate(map(len, ids))]), strict=True))
        for c, ws in pieces.items():
            if len(ws) != 1:
                got = [known[w] for w in ws]
                known[c] = (" ".join([x[0] for x in got]), sum([x[1] for x in got]), b"".join([x[2] for x in got]))
        return known


def _corpus(ranks: bytes, pattern: str, sent, key: str) -> _Corpus:
    kept = memory("bpe")
    if kept.get("corpus", (None,))[0] != key:
        kept.pop("corpus", None)
        kept["corpus"] = (key, _Corpus(_replay(ranks), pattern, sent.value))
    return kept["corpus"][1]


def encode(
    df: DataFrame,
    ranks: bytes,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = ("ids", "decoded"),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Encode whole texts without special tokens and decode the ids again.

    ``ranks`` is the content of a ranks file (its size is that of the vocabulary), ``pattern`` the pre-token
    pattern. Returns ``id_col``, the columns of ``keep`` and those of ``outputs``: ``ids`` (array of int),
    ``decoded`` (string), ``n_tokens`` (long), ``ids_sha256`` and ``decoded_sha256`` (hex digests of the decimal
    ids joined by one space and of the decoded bytes). Null texts count as empty: no ids. Rows come back one for
    one, so repeated rows stay; columns not named are left behind. The pattern must let pre-tokens begin at every space
    between two other characters (see ``CUT``).
    """
    types = {
        "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "n_tokens": T.LongType(),
        "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(),
    }
    rows = df.select(*dict.fromkeys([id_col, *keep, text_col]))
    passed = list(dict.fromkeys([id_col, *keep]))
    schema = T.StructType([rows.schema[c] for c in passed] + [T.StructField(c, types[c]) for c in outputs if c not in passed])
    made = [c for c in outputs if c not in passed]
    sc = df.sparkSession.sparkContext
    packed = sc.broadcast(ranks)
    # At most COMMON_CHUNKS chunks and COMMON_BYTES bytes of them.
    sent = sc.broadcast(dictionary(common_chunks(materialize(chunk_counts(df, text_col), "chunk-counts")), ranks, pattern))
    key = uuid.uuid4().hex
    arrow = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = _corpus(packed.value, pattern, sent, key)
        for whole in batches:
            for batch in blocks(whole, text_col):
                texts = [corpus.chunks(t or "") for t in batch.column(text_col).to_pylist()]
                known = corpus.learn(texts)
                cols: dict[str, list] = {c: [] for c in made}
                for cs in texts:
                    written, counts, raw = zip(*map(known.__getitem__, cs), strict=True)
                    # An empty chunk has no ids: a text may begin with a space.
                    line = " ".join(written) if all(counts[:1]) else " ".join(written[1:])
                    if "n_tokens" in cols:
                        cols["n_tokens"].append(sum(counts))
                    if "ids" in cols:
                        cols["ids"].append(np.array(line.split(), np.int32))
                    if "ids_sha256" in cols:
                        cols["ids_sha256"].append(hashlib.sha256(line.encode()).hexdigest())
                    if "decoded" in cols or "decoded_sha256" in cols:
                        back = b"".join(raw)
                        if "decoded" in cols:
                            cols["decoded"].append(back.decode("utf-8", "replace"))
                        if "decoded_sha256" in cols:
                            cols["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                arrays = [batch.column(c) for c in passed] + [pa.array(cols[c], arrow.get(c, pa.string())) for c in made]
                yield pa.RecordBatch.from_arrays(arrays, names=passed + made)

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of each row's ids: ``id_col``, ``decoded`` (binary). Null ids give empty bytes; unknown ids are an error."""
    packed = df.sparkSession.sparkContext.broadcast(ranks)
    rows = df.select(id_col, ids_col)
    schema = T.StructType([rows.schema[id_col], T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {r: t for t, r in parse_ranks(packed.value).items()}
        for b in batches:
            out = [b"".join(map(table.__getitem__, ids or ())) for ids in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    return rows.mapInArrow(run, schema)
