"""Personal data: base spans by the contract's own patterns, the trees by a plain version, texts of all kinds."""

import hashlib
import random

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

from quire.llm import personal, queries, spans

MORE = "/root/testdata/sf0.01"
BASE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_base(t):
    digits = lambda m: regex.sub("[^0-9]", "", m)
    good = (
        lambda m: True,
        lambda m: all(int(p) <= 255 for p in m.split(".")),
        lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)),
        lambda m: 9 <= len(digits(m)) <= 15,
    )
    return sorted((m.start(), k, m.end()) for k, p in enumerate(BASE) for m in regex.finditer(p, t) if good[k](m[0]))


def plain_features(kind, hit, before, after):
    left, right = before[-1:], after[:1]
    digits, groups = regex.sub("[^0-9]", "", hit), [g for g in regex.split("[^0-9]+", hit) if g]
    seps = set(regex.findall("[ ./:-]", hit))
    sep = 0 if not seps else 6 if len(seps) > 1 else "- ./:".index(min(seps)) + 1
    first = lambda c, *ps: next((k for k, p in enumerate(ps) if regex.search(p, c)), len(ps))
    plain, check = hit.replace(" ", ""), 0
    if regex.search("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$", plain):
        check = 2 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else 1
    size = lambda i: min(len(groups[i]), 9) if groups else 0
    return (
        kind, min(len(digits), 20), min(len(groups), 9), sep, int(bool(regex.search(r"[\[({]", hit))), int(bool(regex.search(personal.WELCOME, before))), int(bool(regex.search(personal.WARNING, before))),
        first(left, r"^\s?$", "[A-Za-z0-9_]", r"\p{Sc}", r"[\"'(\[]", "[:=]", "[-/.,]"), first(right, r"^\s?$", "[.,;:!?]", "[A-Za-z0-9_]", r"[%\p{Sc}]"), check, size(0), size(-1), int(bool(regex.search(personal.DATE, hit))),
    )


def plain_spans(t, model):
    base = plain_base(t)
    apart = lambda s, taken: all(s[2] <= b[0] or b[2] <= s[0] for b in taken)
    good = []
    for k, p in enumerate(personal.GENERATORS, personal.BASE):
        ms = list(regex.finditer(p, t))
        for i, m in enumerate(ms):
            if k == personal.KINDS.index("tel") and not 6 <= len(regex.sub("[^0-9]", "", m[0])) <= 15:
                continue
            before = t[ms[i - 1].end() if i else 0 : m.start()][-personal.CONTEXT :]
            after = t[m.end() : ms[i + 1].start() if i + 1 < len(ms) else len(t)][: personal.CONTEXT]
            s = (m.start(), k, m.end())
            if apart(s, base) and personal.plain_score(plain_features(k, m[0], before, after), model) >= model.thresholds[k - personal.BASE]:
                good.append(s)
    taken = list(base)
    for kind in map(personal.KINDS.index, personal.ORDER):
        taken += [s for s in good if s[1] == kind and apart(s, taken)]
    return sorted(taken)


@pytest.fixture(scope="module")
def model(spark):
    return personal.fit(spark.read.parquet(f"{MORE}/documents.parquet"))


def test_whole_table_against_a_plain_scan(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{MORE}/documents.parquet'").fetchall())
    got = queries.op13_personal(spark, MORE).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_base(texts[r.doc_id] or "")
        want = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in base) for x in range(4))
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert base or not r.spans  # these texts hold nothing else


ODD = [
    "a@b.c_d@e.f..g@h.i-j@k.l", "x" * 50_000 + "@", "1" * 60_000, "1.2.3.4.5.6.7.8 256.1.1.1 0001.0255.0.00", "4876 1792-6753 9117 4876179267539117", "+1 (555) 555-5555 +1 2 3 +12345678901234567", "+" * 3000 + "1 1" * 3000,
    "é😀 jane (at) example (dot) org, 😀 IBAN DE89 3704 0044 0532 0130 00; ssn 123-45-6789 tel 0171/1234567", "a@a" + ".a" * 20_000, "phone: 555-123-4567, 555-123-4568 fax 555-123-4569", "at 12:34:56 on 2024-01-02 v1.2.3.4", "", "12 34 56 78 90 12 34 56",
]


def test_spans_equal_a_plain_scan_on_odd_texts(spark, model):
    rng = random.Random(3)
    parts = ["12", " ", "-", ".", "+1", "(555)", "555", "a@b.co", ":", "DE89", " at ", "(dot)", "x", "é", "tel ", "\n", "0001", "4111111111111111", "/"]
    texts = ODD + ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(400)]
    rows = personal.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), model).collect()
    for r in rows:
        assert [tuple(s) for s in r.spans] == plain_spans(texts[r.doc_id], model), texts[r.doc_id][:300]


def test_held_out_samples(spark, model):
    made = personal.generated(spark, 20_000).where("pmod(xxhash64(text), 5) = 0").select(F.monotonically_increasing_id().alias("doc_id"), "text", "personal")
    rows = personal.scan(made, model, keep=("personal",)).select("personal", F.expr(f"exists(spans, s -> s.kind >= {personal.BASE})").alias("found"), F.expr("size(spans) > 0").alias("any")).toPandas()
    assert rows[rows.personal]["any"].mean() > 0.85 and rows[~rows.personal].found.mean() < 0.01


def test_cases(spark, model):
    schema = "doc_id long, text string, spans string, _base string, kind int"
    rows = [(1, None, "x", "x", 0), (2, "", "x", "x", 0), (3, "mail a@b.co", "x", "x", 0), (3, "mail a@b.co", "x", "x", 0), (None, "10.0.0.1", "x", "x", 0)]
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans], r.kind) for r in personal.scan(spark.createDataFrame(rows, schema), model, keep=("kind",)).collect()), key=str)
    assert got == sorted([(1, [], 0), (2, [], 0), (3, [(5, 0, 11)], 0), (3, [(5, 0, 11)], 0), (None, [(0, 1, 8)], 0)], key=str)
    empty = spark.createDataFrame([], schema)
    assert personal.scan(empty, model).count() == 0 and len(personal.fit(empty, samples=300).thresholds) == len(personal.GENERATORS)
    assert personal.fit(empty, samples=0).trees == ()
    many = spark.createDataFrame([(1, "\n".join(f"user{i}@mail.example.com from 10.0.{i % 256}.7" for i in range(30_000)))], "doc_id long, text string")
    r = personal.scan(many, model, keep=("text",)).select(F.size("spans").alias("n"), personal.redacted().alias("t")).first()
    assert r.n == 60_000 and r.t == "\n".join(["[PERSONAL] from [PERSONAL]"] * 30_000)


def test_redaction_of_overlapping_spans(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        t = "".join(rng.choices("abé😀 \n", k=rng.choice((0, 5, 300, 5000))))
        at = sorted((a, k, min(len(t), a + rng.randint(1, 40))) for a, k in ((rng.randint(0, max(0, len(t) - 1)), rng.randint(0, 3)) for _ in range(rng.randint(0, 90))) if t)
        rows.append((i, t, at))
    df = spark.createDataFrame(rows, f"id long, text string, spans {spans.SPANS}")
    for r, (_, t, at) in zip(df.select("id", F.expr(spans.redacted("text", "spans", "#")).alias("r")).orderBy("id").collect(), rows, strict=True):
        out, end = "", 0
        for a, _, b in at:
            if a >= end:
                out += t[end:a] + "#"
            end = max(end, b)
        assert r.r == out + t[end:]
