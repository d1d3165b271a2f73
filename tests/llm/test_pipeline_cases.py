"""Every stage of the pipeline on nulls, empty and very long texts, repeated rows, empty tables and clashing names."""

import hashlib
import random

import pytest

import corpus_pipeline
from quire.llm.common import materialize

SAME = "one two three four five six seven eight nine ten eleven twelve"
LONG = "word " * 60_000 + "password=abcdef123456 end"
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, LONG, "en", "a"), (4, SAME, "en", "a"), (4, SAME, "en", "a"), (5, SAME, "de", None), (6, "   ", "en", "b"),
    (None, "null id text here", "en", "b"), (None, SAME, "en", "b"), (7, "another text of seven", "en", "b"), (7, "bad bad awful words here", "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, class_id string, p double, kept string, ids string, topic string, tok string, id string"
STAGES = dict(corpus_pipeline.STAGES)


def docs(spark, rows):
    full = [(i, t, g, s, None if t is None else len(t), "x", "x", "x", 0.5, "x", "x", "x", "x", "x") for i, t, g, s in rows]
    return materialize(spark.createDataFrame(full, SCHEMA), "documents")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('sf')}"
    rng = random.Random(1)
    words = lambda: " ".join(f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('klmnp')}{rng.randrange(40)}" for _ in range(12))
    toxic = [(100 + i, f"bad awful {words()} worst" if i % 10 == 0 else f"plain {words()}", "en", "a") for i in range(400)]
    docs(spark, ROWS + toxic).write.parquet(f"{at}/documents.parquet")
    labels = [(100 + i, 0, int(i % 10 == 0)) for i in range(400)] + [(None, 0, 1), (4, None, None), (100, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def seen(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_toxicity(spark, sf_dir):
    got = STAGES["toxicity"](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    kept = seen(got)
    gone = [(i, t and t[:40]) for i, t, _, _ in ROWS if (i, t) not in kept and (t or "")[:3] != "bad"]
    assert gone == [] and kept.count((4, SAME)) == 2
    assert sum((t or "").startswith("bad awful") for _, t in kept) <= 5 and sum((t or "").startswith("plain") for _, t in kept) >= 355


def test_near_duplicates(spark, sf_dir):
    got = STAGES["near duplicates"](spark, docs(spark, ROWS), sf_dir)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    # The least id of each class; a row without an id where nothing like it has one; each text of an id with two.
    want = [(1, None), (3, LONG), (4, SAME), (None, "null id text here"), (7, "another text of seven"), (7, "bad bad awful words here")]
    assert seen(got) == sorted(want, key=str)


def test_secrets(spark, sf_dir):
    got = STAGES["secrets"](spark, docs(spark, ROWS), sf_dir)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    clean = LONG.replace("password=abcdef123456", "[SECRET]")
    assert seen(got) == sorted([(i, clean if t == LONG else t) for i, t, _, _ in ROWS], key=str)
    assert {r.n_chars for r in got.where("doc_id = 3").collect()} == {len(clean)} and got.where("doc_id = 1").first().n_chars is None


def test_mixing(spark, sf_dir):
    got = STAGES["mixing"](spark, docs(spark, ROWS), sf_dir)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    kept, rows = seen(got), [(i, t) for i, t, _, _ in ROWS]
    assert all(rows.count(r) == kept.count(r) for r in kept)


def test_encoding(spark, sf_dir):
    got = STAGES["byte-level BPE"](spark, docs(spark, ROWS), sf_dir).collect()
    assert len(got) == len(ROWS)
    for (i, t, _, _), r in zip(sorted(ROWS, key=str), sorted(got, key=lambda r: str((r.doc_id, next(x[1] for x in ROWS if x[0] == r.doc_id)))), strict=True):
        assert r.doc_id == i and r.n_tokens == len(r.ids)
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _, _ in ROWS)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, sf_dir, name):
    assert STAGES[name](spark, docs(spark, []), sf_dir).count() == 0
