"""Collocations against a plain count, and the trie against a dictionary."""

import collections
import gc
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import phrases

UPPER = {chr(c): chr(c + 32) for c in range(65, 91)}


def plain(rows, least=10, percent=50, top=2000):
    counts, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(str.maketrans(UPPER))):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            counts.update((lang, tuple(ws[i : i + k])) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    frequent = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, ws), a in frequent.items():
        cut = min((10**6 * a * a // (counts[lang, ws[:k]] * counts[lang, ws[k:]]), k) for k in range(1, len(ws)))
        if not any(g == lang and len(vs) > len(ws) and 100 * b >= percent * a and any(vs[i : i + len(ws)] == ws for i in range(2)) for (g, vs), b in frequent.items()):
            k = cut[1]
            out[lang].append((-cut[0], -a, " ".join(ws).encode(), counts[lang, ws[:k]], counts[lang, ws[k:]]))
    return sorted((g, i, p.decode(), -a, x, y, n[g], -s) for g, rs in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rs)[:top], 1))


SCHEMA = "doc_id long, text string, lang string, n string, phrase string, score string"


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_a_plain_count(spark, monkeypatch, small):
    if small:  # every block spills, containers burst, words are forgotten, filters let others pass
        for name, v in (("BURST", 3), ("MOST_ENTRIES", 50), ("MOST_WORDS", 20), ("FILTER_BITS", 1), ("SLICE", 17)):
            monkeypatch.setattr(phrases, name, v)
    rng = random.Random(11)
    words = ["The", "cat", "SAT", "on", "é", "漢字", "a.b", "x\ty", "\x1c", "\xa0", "É", "new", "York", "city", "\x0b", "no:way"]
    rows = [(None, "en"), ("", "en"), ("   ", None), ("one", "de")]
    rows += [(" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(1, 60))), rng.choice(["en", "en", "en", "de", "", None])) for _ in range(260)]
    rows += [("New York city", "en")] * 40 + [("tick tock", None)] * 9 + [("ping pong", None)] * 10
    df = spark.createDataFrame([(i % 9 or None, t, g, "x", "x", "x") for i, (t, g) in enumerate(rows)], SCHEMA).repartition(5)
    assert sorted(map(tuple, phrases.collocations(df).collect())) == plain(rows)
    few = phrases.collocations(df, least=3, top=7, covered_percent=90)
    assert sorted(map(tuple, few.collect())) == plain(rows, 3, 90, 7)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trie(monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 4)
    rng, trie, want = random.Random(1), phrases.HatTrie(3), collections.Counter()
    for _ in range(50):
        grams = [tuple(rng.randint(1, 6) for _ in range(3)) for _ in range(40)]
        want.update(grams)
        keys, n = np.unique(np.array([a << 42 | b << 21 | c for a, b, c in grams]), return_counts=True)
        trie.add(keys, n)
    assert trie.entries == len(want) and any(isinstance(x, list) for x in trie.root.values())
    gone = trie.coldest(trie.entries // 2)
    packed = lambda ks, cs: {(k >> 42, k >> 21 & (1 << 21) - 1, k & (1 << 21) - 1): c for k, c in zip(ks.tolist(), cs.tolist(), strict=True)}
    got = packed(*trie.spill(gone))
    assert len(got) >= len(want) // 2 and trie.entries == len(want) - len(got)
    got |= packed(*trie.spill())
    assert got == dict(want) and not trie.entries


def test_a_task_adds_to_its_trie_in_one_go(spark, monkeypatch):
    """Blocks and languages are gathered before they meet the trie; small bounds give the same counts in more runs."""

    class Frame:
        def __getattr__(self, name):
            return lambda *args: setattr(self, "run", args[0]) or self if name == "mapInArrow" else self

    texts = [("de" if i % 2 else "en", " ".join(f"w{(i * k) % 17}" for k in range(1, 60)).encode()) for i in range(80)]
    batches = [pa.RecordBatch.from_arrays([pa.array([g for g, _ in part]), pa.array([t for _, t in part], pa.binary())], names=["lang", "text"]) for part in (texts[:30], texts[30:])]
    adds, add, bounds = [], phrases.HatTrie.add, ((phrases.GATHERED, phrases.MOST_ENTRIES), (100, 50))
    monkeypatch.setattr(phrases.HatTrie, "add", lambda self, keys, counts: adds.append(len(keys)) or add(self, keys, counts))
    for n in (1, 2, 3):
        want = collections.Counter((g, " ".join(w)) for g, t in texts for w in zip(*[t.decode().split()[k:] for k in range(n)], strict=False))
        for gathered, entries in bounds:
            monkeypatch.setattr(phrases, "GATHERED", gathered)
            monkeypatch.setattr(phrases, "MOST_ENTRIES", entries)
            frame, got = Frame(), collections.Counter()
            adds.clear()
            phrases.counted(frame, n)
            for b in frame.run(iter(batches)):
                for g, p, c in zip(*(b.column(x).to_pylist() for x in ("lang", "phrase", "n")), strict=True):
                    got[g, p] += c
            assert got == want and gc.isenabled()
            assert len(adds) == 1 if gathered > 100 else len(adds) > 1
