"""Cross-tokenizer alignment against a plain version: whole texts, byte by byte."""

import collections
import hashlib
import random

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quire.llm import align, queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(public_tokenizers.path(queries.A_TOKENS))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.B_TOKENS)), align.byte_alphabet(), {i: t for t, i in a.get_vocab().items()}


def plain(both, text):
    """Groups and links of one text."""
    a, b, alphabet, vocabulary = both
    if not text:
        return [], []
    raw = (" " + text).encode()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    data = [bytes(alphabet[c] for c in vocabulary[i]) for i in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [b.id_to_piece(i)]]
    if any(b"".join(d) != raw for d in data):
        return [], []
    spans = []
    for d in data:
        at, out = 0, []
        for x in d:
            out.append((at, at + len(x)))
            at += len(x)
        spans.append(out)
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, start = [], 0
    for end in cuts:
        groups.append([[i for i, (s, e) in zip(ids[k], spans[k], strict=True) if start <= s and e <= end] for k in (0, 1)])
        start = end
    # Pairs that overlap, found the long way within a window of tokens.
    links, low = [], 0
    for i, (s, e) in zip(ids[0], spans[0], strict=True):
        while spans[1][low][1] <= s:
            low += 1
        k = low
        while k < len(spans[1]) and spans[1][k][0] < e:
            links.append((i, ids[1][k]))
            k += 1
    return groups, links


def expected(both, texts):
    parts = [plain(both, t) for t in texts]
    counts = collections.Counter(link for _, links in parts for link in links)
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for groups, links in parts:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        )


def test_whole_table(spark, both):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()
    want = sorted((i, *x) for (i, _), x in zip(rows, expected(both, [t for _, t in rows]), strict=True))
    assert sorted(map(tuple, queries.op12_align(spark, DIR).collect())) == want


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "  two  spaces ", "<|endoftext|> <s> </s> <unk>", "a▁b ▁ c", "▁", "漢字かな交じり文 " * 40, "😀é ﬁ \x00\x1c\x85 　x​y", "\n\n a\t\tb\r\n", "x" * 3000, "don't   we'll\n  indent", "a\xa0 b \xa0c",
    "The same words. The same words.", "The same words. The same words.", "ａ ｂ", " " * 50 + "x" + " " * 33,
]


@pytest.mark.parametrize("most", [10**6, 0])
def test_odd_texts_by_either_way(spark, both, monkeypatch, most):
    rng = random.Random(7)
    parts = [" ", "  ", "\n", "the", "Word", "ing", "é", "漢", "😀", "12", "▁", ".", "'s", "\t", "\xa0", "\x1d", "zq"]
    texts = ODD + ["".join(rng.choices(parts, weights=[8] + [2] * (len(parts) - 1), k=rng.randint(1, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i % 290 or None, t, "x", "x", "x", "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a string, pairs string, _row string, groups string")
    monkeypatch.setattr(align, "CACHE_PIECES", 40)
    got = align.align(df.repartition(3), queries.vocabulary(queries.A_TOKENS), queries.vocabulary(queries.B_TOKENS), groups=("groups", "groups_sha256"), broadcast_pairs=most).collect()
    assert sorted((r.doc_id or 0, *(r[c] for c in (*align.MADE, "groups_sha256"))) for r in got) == sorted((i % 290, *x) for i, x in enumerate(expected(both, texts)))
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got if r.groups)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    args = [queries.vocabulary(queries.A_TOKENS), queries.vocabulary(queries.B_TOKENS)]
    assert align.align(empty, *args).count() == 0 and align.align(empty, *args, broadcast_pairs=-1).count() == 0
