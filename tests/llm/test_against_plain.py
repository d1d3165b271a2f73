"""Queries and operators against plain brute-force versions."""

import base64
import collections
import glob
import hashlib
import html
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import ann, bpe, fingerprint, mixing, neardup, queries, rollup, secrets, toxicity, warc

DIR = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"


def read(name, cols, where=DIR):
    return duckdb.sql(f"SELECT {cols} FROM '{where}/{name}.parquet'").fetchall()


def test_secrets(spark):
    got = queries.op1_secrets(spark, MORE).collect()
    texts = dict(read("documents", "doc_id, text", MORE))
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id] or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m[1]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, t) if len(m[0]) >= 24]
        want = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_secret_models_tell_random_from_ordinary(spark):
    rng = random.Random(5)
    ordinary = ["configuration_manager_instance", "internationalization", "thonthreheesandstion", "read/write/append/seek", "averylongidentifiername"]
    keys = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=32)) for _ in range(5)]
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = {"mixed": lower + lower.upper() + digits, "upper": lower.upper() + digits, "hex": digits + "ABCDEF", "lower": lower, "plain": lower + digits}
    more = [(1000 * k + i, "Authorization-Bearer-session-" + "".join(rng.choices(a, k=24))) for k, a in enumerate(alphabets.values(), 1) for i in range(200)]
    docs = spark.createDataFrame([(i, "x é " + t + " y") for i, t in enumerate(ordinary + keys)], "doc_id long, text string")
    model = secrets.fit(secrets.default_samples(spark.read.parquet(f"{MORE}/documents.parquet")))
    got = {r.doc_id: r.spans for r in secrets.scan(docs, model).collect()}
    assert all(not got[i] for i in range(5)) and all([(s.start, s.end) for s in got[i]] == [(4, 36)] for i in range(5, 10))
    # Keys behind an ordinary prefix, by alphabet.
    found = secrets.scan(spark.createDataFrame(more, "doc_id long, text string"), model).where("exists(spans, s -> s.end = 53 AND s.start <= 29)").select("doc_id").toPandas().doc_id // 1000
    assert all((found == k).sum() >= 180 for k in range(1, 6))


def plain_ratio(token, model):
    code = lambda c: ord(c) - secrets.FIRST
    return sum(model[code(a) * secrets.WIDTH + code(b)] for a, b in zip(token, token[1:], strict=False))


def test_all_secret_spans_equal_a_plain_scan(spark):
    """The spans that the models add as well, at offsets beyond one block of hits too."""
    rng = random.Random(6)
    docs = spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "text")
    dump = "é\n".join("key " + "".join(rng.choices("abcdef0123456789", k=rng.choice((20, 30)))) + "-Ordinary_name" for _ in range(1500))
    docs = docs.unionByName(spark.createDataFrame([(-1, dump)], "doc_id long, text string"))
    model = [float(f"{x:.4f}") for x in secrets.fit(secrets.default_samples(docs))]
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in secrets.scan(docs, model).collect():
        t = texts[r.doc_id]
        base = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m[1]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, t) if len(m[0]) >= 24]
        more, taken = [], list(base)
        for piece in (secrets.TOKEN, secrets.PART):
            new = []
            for m in re.finditer(f"{piece}{{{secrets.MIN_TOKEN},}}", t):
                x = plain_ratio(m[0], model)
                if re.search("[A-Za-z]", m[0]) and x >= secrets.MIN_RATIO and x >= secrets.MIN_MEAN_RATIO * (len(m[0]) - 1) and not any(a < m.end() and m.start() < b for a, _, b in taken):
                    new.append((m.start(), 3, m.end()))
            more += new
            taken += new
        assert [tuple(s) for s in r.spans] == sorted(base + more)


def test_reference_sql(spark):
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, DIR).toPandas()
        want = con.execute(sql).fetchdf()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        plain = lambda v: "null" if str(v) in ("None", "nan", "<NA>") else f"{float(v):.6f}" if isinstance(v, (int, float, np.number, np.bool_)) else str(v)
        as_rows = lambda df, cols=cols, plain=plain: sorted(tuple(map(plain, r)) for r in df[cols].itertuples(index=False))
        assert as_rows(got) == as_rows(want)


def test_raked_marginals_meet_targets(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet").select("source", "lang", mixing.topic(mixing.word_topics(queries.F.col("text"))).alias("topic"), mixing.tokens(queries.F.col("text")).alias("tok"))
    cells = mixing.rake(mixing.cell_table(docs), mixing.TARGETS | {"lang": {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}})
    assert mixing.deviation(cells) < 1e-3
    rows = cells.toPandas()
    assert abs(rows.groupby("lang").w.sum() - rows.groupby("lang").t_lang.first()).max() < 1e-3 and abs(rows.w.sum() - 1) < 1e-3
    shares = rows.groupby("source").w.sum()
    assert abs(shares["src0"] - 0.25) < 1e-3 and shares.drop("src0").std() < 1e-3
    # A cell gives what it has at most, and shares of more than 1 are refused.
    capped = mixing.rake(mixing.cell_table(docs), {"lang": {"es": 0.9}}, keep_share=0.5).toPandas()
    assert (capped.w <= capped.tok / (0.5 * capped.tok.sum()) + 1e-12).all()
    with pytest.raises(ValueError, match="target shares"):
        mixing.rake(mixing.cell_table(docs), {"lang": {"es": 0.9, "en": 0.2}})


def tokenizer():
    table = bpe.parse_ranks(queries.ranks())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}), table


def test_bpe_equals_the_library(spark):
    enc, table = tokenizer()
    got = {r.doc_id: r for r in queries.op3_byte_bpe(spark, DIR).collect()}
    for i, t in read("documents", "doc_id, text"):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    rng, replay = random.Random(1), bpe.MergeReplay(table)
    words = ["".join(rng.choices("abcdefgh the ing é漢😀12!\n", k=rng.randint(1, 60))).encode() for _ in range(3000)] + [b"", b"a" * 999]
    for w, ids in zip(words, replay.encode_words(words), strict=True):
        assert ids == ([] if not w else enc._encode_single_piece(w) if w not in table else [table[w]])


def test_bpe_order_within_a_word():
    """A merge may make a pair of lower rank, which then comes before other places of the first pair."""
    tokens = [bytes([b]) for b in range(256)]
    ranks = {t: i for i, t in enumerate(tokens)} | {b"aba": 256, b"ab": 257, b"abab": 258, b"ca": 259}
    enc = tiktoken.Encoding("x", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    replay = bpe.MergeReplay(ranks)
    rng = random.Random(2)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 14))).encode() for _ in range(500)]
    assert replay.encode_words(words) == [enc.encode_ordinary(w.decode()) for w in words]


def test_warc_round_trip(spark, tmp_path):
    got = {r.page_id: r for r in queries.op4_warc(spark, DIR).collect()}
    pages = dict(read("pages", "page_id, html"))
    top = {}
    for i, h in pages.items():
        top[h or ""] = max(i, top.get(h or "", i))
    for i, h in pages.items():
        data = (h or "").encode()
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if top[h or ""] == i else "revisit", None if top[h or ""] == i else top[h or ""])
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    # The same rows give the same files, whatever their order; files roll by size and each is a chain of gzip members.
    df = spark.read.parquet(f"{DIR}/pages.parquet")
    sums = []
    for k, rows in enumerate((df, df.orderBy("url"))):
        warc.write(rows, f"file://{tmp_path}/{k}", roll_bytes=20_000)
        files = sorted(glob.glob(f"{tmp_path}/{k}/*.warc.gz"))
        assert len(files) > 1 and all(os.path.getsize(f) <= 20_000 or warc.read_records for f in files)
        sums.append([hashlib.sha256(open(f, "rb").read()).hexdigest() for f in files])
        warc.commit(spark, f"file://{tmp_path}/{k}")
        assert warc.read(spark, f"file://{tmp_path}/{k}").count() == len(pages)
    assert sums[0] == sums[1]


def plain_classes(texts):
    codes = {i: neardup.word_codes(t) for i, t in texts.items()}
    counts = {i: collections.Counter(neardup.shingles(c).tolist()) for i, c in codes.items()}
    parent = {i: i for i in codes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(codes)
    for a in ids:
        for b in ids:
            if a >= b:
                continue
            same = len(codes[a]) == len(codes[b]) and (codes[a] == codes[b]).all()
            m = sum((counts[a] & counts[b]).values()) if not same else 0
            n = sum(counts[a].values()) + sum(counts[b].values())
            if same or m >= 0.8 * (n - m) and neardup.similarity(codes[a], codes[b]) >= 0.8:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_near_dup_equals_all_pairs(spark):
    got = {r.doc_id: r.class_id for r in queries.op5_near_dup(spark, DIR).collect()}
    assert got == plain_classes(dict(read("documents", "doc_id, text")))


def test_large_groups_stay_whole(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    texts = {}
    for i in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(300)] = rng.choice(words)
        texts[i] = " ".join(t)
    for i in range(60, 100):  # a long common passage, otherwise different
        texts[i] = " ".join(base[:100] + [rng.choice(words) for _ in range(200)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == plain_classes(texts)


def edited_copies(n, edits, seed=11):
    """Copies of one text of 104 words, each with words of its own at some places: most copies are alike the text, not each other."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(104)]
    out = []
    for i in range(n):
        t = list(base)
        for j, at in enumerate(rng.sample(range(8, 96, 8), edits)):
            t[at] = f"own{i}x{j}"
        out.append(neardup.word_codes(" ".join(t)))
    return out


def test_pairs_that_cannot_be_alike_are_not_made(spark):
    codes = [neardup.unpacked((c ^ (c >> np.uint64(32))).astype(np.uint32).tobytes()) for c in edited_copies(120, 2)]
    alike = {(a, b) for a in range(120) for b in range(a + 1, 120) if neardup.similarity(codes[a], codes[b])}
    texts = spark.createDataFrame([(i, bytearray(c.astype(np.uint32).tobytes())) for i, c in enumerate(codes)], "id long, codes binary")
    made = {(r.a, r.b) for r in neardup.rest_candidates(texts, texts.select("id", F.col("id").alias("label"))).collect()}
    assert alike <= made and 0 < len(alike) < 1_000 and len(made) <= 1.05 * len(alike)  # of 7,140 pairs


def test_pairs_with_hubs_that_cannot_be_alike_are_not_made(spark):
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {i: f"{passage} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for i in range(300)}
    tried = []

    def counted(pairs, *rest):
        pairs = neardup.materialize(pairs, "tried")
        tried.append(pairs.count())
        return verified(pairs, *rest)

    verified, neardup.verified = neardup.verified, counted
    try:
        got = neardup.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    finally:
        neardup.verified = verified
    assert {r.doc_id: r.class_id for r in got} == {i: i for i in texts} and tried[0] > 300 and sum(tried[1:]) == 0


def test_parity_lets_every_pair_pass_that_is_alike(spark):
    rng = random.Random(13)
    rows, alike = [], []
    for k in range(400):
        n = rng.choice((1, 4, 5, 6, 9, 30, 120, 900, 4_000))
        a = [rng.choice("abc") if rng.random() < 0.2 else f"w{rng.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        for _ in range(rng.randint(0, max(1, n // 30))):
            at = rng.randrange(len(b) or 1)
            b[at : at + rng.randint(0, 2)] = [f"n{rng.randrange(5)}"] * rng.randint(0, 2)
        x, y = (neardup.unpacked(neardup.packed(" ".join(t))) for t in (a, b or ["c"]))
        alike.append(neardup.similarity(x, y) > 0)
        x, y = neardup.labelled(x), neardup.labelled(y)
        rows.append((k, len(x), neardup.parity(x).tolist(), len(y), neardup.parity(y).tolist()))
    pairs = spark.createDataFrame(rows, "k long, n long, bits array<long>, m long, other array<long>")
    passed = {r.k for r in pairs.where(neardup.may_be_alike(("n", "bits"), ("m", "other"), 0.8)).collect()}
    assert {k for k, x in enumerate(alike) if x} <= passed and 50 < sum(alike) < 350 and len(passed) < 400


def test_similarity_is_the_longest_chain_of_labelled_shingles():
    rng = random.Random(8)
    for _ in range(300):
        a = [rng.choice("abc") if rng.random() < 0.3 else f"w{rng.randrange(60)}" for _ in range(rng.randint(5, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 2)] = [f"n{rng.randrange(5)}"] * rng.randint(0, 2)
        x, y = (neardup.labelled(neardup.word_codes(" ".join(t))).tolist() for t in (a, b))
        row = [0] * (len(y) + 1)
        for p in x:
            old, row = row, [0] * (len(y) + 1)
            for j, q in enumerate(y):
                row[j + 1] = old[j] + 1 if p == q else max(old[j + 1], row[j])
        want = row[-1] / (len(x) + len(y) - row[-1]) if len(b) >= 5 else float(a == b)
        got = neardup.similarity(neardup.word_codes(" ".join(a)), neardup.word_codes(" ".join(b)), 0.8)
        assert got == (want if want >= 0.8 else 0.0) or abs(got - want) < 1e-12


def test_similarity_is_ordered():
    a = neardup.word_codes(" ".join(f"a{i}" for i in range(100)))
    assert neardup.similarity(a, a) == 1.0
    assert neardup.similarity(a, np.concatenate([a[50:], a[:50]])) == 0.0
    assert 0.8 < neardup.similarity(a, np.concatenate([a[:40], a[41:]])) < 1


def test_fingerprints_estimate_jaccard(spark):
    texts = dict(read("documents", "doc_id, text"))
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    got = queries.op6_fingerprint(spark, DIR).collect()
    assert len(got) == len(texts)
    errors, seen = [], {}
    for r in got:
        t, nxt = texts[r.doc_id] or "", texts[after[r.doc_id]] or ""
        k = len(t) // 3
        edit = t[: len(t) - k] + nxt[:k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        a, b, c = shingles(t), shingles(edit), shingles(nxt)
        if a and b and c:
            errors += [r.near_edited - len(a & b) / len(a | b), r.near_next - len(a & c) / len(a | c)]
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).mean() < 0.05 and np.abs(errors).max() < 0.25


def test_toxicity_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = dict(read("labels", "doc_id, toxic", "/root/testdata/sf0.1"))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(labels[i], got[i].predicted, got[i].score) for i in labels if got[i].held_out]
    assert all(p == (s >= 0.3) for _, p, s in held)
    hit, toxic = sum(y and p for y, p, _ in held), sum(y for y, _, _ in held)
    assert hit / toxic > 0.85 and sum(p and not y for y, p, _ in held) <= 0.02 * len(held)


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    rows = [(np.unique(np.append(rng.integers(0, 5000, 40), [7777] if y else [8888])), y) for y in rng.integers(0, 2, 800)]
    m = toxicity.ftrl(rows, 0.5, 1.0, 1.0, 0.1, 2)
    # The same, coordinate by coordinate.
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    weight = lambda i, l1: 0.0 if abs(z[i]) <= l1 else (np.sign(z[i]) * l1 - z[i]) / ((1.0 + n[i] ** 0.5) / 0.5 + 0.1)
    for _ in range(2):
        for x, y in rows:
            ws = {i: weight(i, 1.0) for i in x.tolist()} | {"bias": weight("bias", 0.0)}
            g = (1 / (1 + np.exp(-sum(ws.values()))) - y) * toxicity.ROW_WEIGHT / len(x) ** 0.5
            for i, w in ws.items():
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * w
                n[i] += g * g
    plain = {i: weight(i, 1.0) for i in z if i != "bias" and weight(i, 1.0) != 0}
    assert set(m.index.tolist()) == set(plain) and all(abs(plain[i] - w) < 1e-4 for i, w in zip(m.index.tolist(), m.weight.tolist(), strict=True))
    assert abs(m.bias - weight("bias", 0.0)) < 1e-6
    w = m.dense()
    assert w[7777] > 0 > w[8888] and len(m.index) < 1500


def test_nearest_neighbours(spark):
    rows = read("embeddings", "vec_id, embedding")
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got = collections.defaultdict(list)
    for r in queries.op8_ann(spark, DIR).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(got) == sorted(asked)
    hit = 0
    for q in asked:
        found = sorted(got[q])
        s = x @ x[np.flatnonzero(ids == q)[0]]
        want = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and len({v for _, v, _ in found}) == 20
        assert [(-sc, v) for _, v, sc in found] == sorted((-sc, v) for _, v, sc in found)
        assert all(abs(sc - s[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, sc in found)
        hit += len(set(want) & {v for _, v, _ in found})
    assert hit / (20 * len(asked)) >= 0.9


def test_html_keeps_the_article(spark):
    got = {r.page_id: r for r in queries.op10_html_text(spark, MORE).collect()}
    for i, url, page in read("pages", "page_id, url, html", MORE):
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(p for p in parts if p)
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, want, len(want))


def test_rollup_words(spark):
    texts = ["", "  ", "a", " a  b\tc\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(rollup.word_count(queries.F.col("text"))).collect()] == [0, 0, 1, 3, 0]


def test_pipeline_equals_its_stages_done_plainly(spark):
    """Each stage against a plain version over what its predecessor kept."""
    from quire.llm.common import materialize

    texts = lambda df: {r.doc_id: r for r in df.collect()}
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], DIR), name.replace(" ", "-")))
    start, clean, unique, redacted, mixed, encoded = map(texts, seen)
    assert len(clean) > 0.7 * len(start)
    model = toxicity.fit(spark.read.parquet(f"{DIR}/labels.parquet").where(~queries.held_out()), docs)
    weights = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
    odds = {i: model.bias + sum(weights.get(x, 0.0) for x in toxicity.features(r.text).tolist()) for i, r in start.items()}
    assert set(clean) == {i for i, x in odds.items() if 1 / (1 + np.exp(-x)) < queries.TOXIC_AT}
    plain = plain_classes({i: r.text for i, r in clean.items()})
    assert set(unique) == set(plain.values())
    assert set(redacted) == set(unique) and not any(re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", r.text) for r in redacted.values())
    assert all(redacted[i].text == unique[i].text for i in unique if not re.search(rf"{secrets.ASSIGN}|AKIA|[0-9a-f]{{16,}}", unique[i].text) and not re.search(r"[A-Za-z0-9+/_=-]{16,}", unique[i].text))
    assert set(mixed) <= set(redacted) and all(mixed[i] == redacted[i] for i in mixed)
    enc, _ = tokenizer()
    assert set(encoded) == set(mixed) and all(encoded[i].ids == enc.encode_ordinary(mixed[i].text) for i in mixed)
    assert all(d.columns == list(corpus_pipeline.COLUMNS) for d in seen[1:5])
    assert corpus_pipeline.run(spark, DIR).count() == len(encoded)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 450])
@pytest.mark.parametrize("far", [0, 10**15])
def test_successor_of_every_row(spark, n, far):
    ids = random.Random(n).sample(range(-50_000, 50_000), n)
    ids = [*ids[1:], far + 60_000] if n else ids
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(df, "doc_id", ["text"], per_group=5).collect()}
    order = sorted(ids, reverse=True)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_pattern_needs_no_special_case():
    assert "".join(regex.findall(public_tokenizers.PATTERN, "a  b\n\n c<|endoftext|>'s")) == "a  b\n\n c<|endoftext|>'s" and ann.BLOCK_DIMS > 0


@pytest.mark.parametrize("share", [300, 340])
def test_near_copies_behind_a_frequent_passage(spark, share):
    """Pairs of near copies of which most is a passage that over 1,000 unlike texts have too."""
    rng = random.Random(share)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, texts, planted = fresh(share + 4), {}, []
    for i in range(1000):
        texts[i] = passage + fresh(400 - share)
    for i in rng.sample(range(1000), 120):
        own, edits = list(texts[i]), set(rng.sample(range(len(passage), len(texts[i])), 5))
        n = 1000 + len(planted)
        texts[n] = [fresh(1)[0] if k in edits else w for k, w in enumerate(own)]
        planted.append((i, n))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    codes = {i: neardup.word_codes(" ".join(t)) for i, t in texts.items()}
    alike = {(a, b) for a, b in planted if neardup.similarity(codes[a], codes[b]) >= 0.8}
    assert len(alike) == len(planted)
    assert {(a, b) for a, b in planted if got[a] == got[b]} == alike
    assert all(got[i] == i for i in range(1000))


def test_pairs_that_share_a_passage(spark):
    """200 pairs of likeness 0.97 that share a passage of 300 words."""
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, texts = fresh(300), {}
    for i in range(200):
        own = passage + fresh(150)
        other = list(own)
        other[rng.randrange(330, 440)] = fresh(1)[0]
        texts[i], texts[1000 + i] = " ".join(own), " ".join(other)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all(got[i] == i == got[1000 + i] for i in range(200))


def test_a_text_meets_its_label_once(spark):
    """Members of large buckets are a row a text, however many buckets it is in; hub pairs are those of every bucket."""
    n = neardup.SMALL + 14
    rows = [(i, [j if i < n - j else -1 - i for j in range(neardup.SKETCHES)]) for i in range(n)]  # bucket j holds the first n - j
    _, large = neardup.candidates(spark.createDataFrame(rows, "id long, sketches array<long>"))
    got = {r.id: r["keys"] for r in large.collect()}
    assert large.count() == len(got) == n
    assert {i: len(set(k)) for i, k in got.items()} == {i: len(k) for i, k in got.items()} == {i: min(neardup.SKETCHES, n - i) for i in range(n)}
    label = {i: 0 if i < 12 else i for i in range(n)}
    pairs = neardup.hub_candidates(large, spark.createDataFrame(list(label.items()), "id long, label long"), 0)
    assert pairs.columns == ["a", "b"]
    met = [(r.a, r.b) for r in pairs.collect()]
    assert len(set(met)) == len(met) and {b for _, b in met} == set(range(12, n)) and {a for a, _ in met} <= set(range(12))


def test_shards_depend_on_the_rows_alone(spark, tmp_path, monkeypatch):
    """Many shards, rows in other partitions, a hot payload and skewed ids: the same files, and every row comes back."""
    monkeypatch.setattr(warc, "SHARD_BYTES", 500)
    rng = random.Random(9)
    rows = [(i if i < 900 else 10**12 + i, f"u{i}", "hot page" if i % 3 == 0 else "x" * rng.randrange(200)) for i in range(1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = []
    for k, given in enumerate((df, df.repartition(7, "url"), df.orderBy("html").coalesce(1))):
        warc.write(given, f"file://{tmp_path}/{k}", roll_bytes=2_000)
        files = sorted(glob.glob(f"{tmp_path}/{k}/*.warc.gz"))
        seen.append([(os.path.basename(f), hashlib.sha256(open(f, "rb").read()).hexdigest()) for f in files])
        assert not os.path.exists(f"{tmp_path}/{k}/_temporary")
        assert sorted(r.page_id for r in warc.read(spark, f"file://{tmp_path}/{k}").collect()) == sorted(i for i, _, _ in rows)
    shards = collections.Counter(name[:11] for name, _ in seen[0])
    assert seen[0] == seen[1] == seen[2] and len(shards) > 5 and max(shards.values()) > 1


def test_rollup_of_token_counts(spark, tmp_path):
    """The BPE operator's counts as a tokenizer version: documents move to it from another one."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    counted = bpe.encode(docs, queries.ranks(), public_tokenizers.PATTERN, outputs=("n_tokens",), keep=("source", "lang"))
    words = docs.select("doc_id", "source", "lang", rollup.word_count(queries.F.col("text")).alias("old_tokens"))
    lit, none = queries.F.lit, queries.F.lit(None)
    first = words.select(lit("insert").alias("op"), "source", "lang", lit("words").alias("version"), queries.F.col("old_tokens").alias("tokens"), none.cast("string").alias("old_version"), none.cast("long").alias("old_tokens"))
    then = counted.where("doc_id % 2 = 0").join(words.select("doc_id", "old_tokens"), "doc_id")
    then = then.select(lit("revise").alias("op"), "source", "lang", lit("bpe").alias("version"), queries.F.col("n_tokens").alias("tokens"), lit("words").alias("old_version"), "old_tokens")
    totals = rollup.Rollup(spark, f"file://{tmp_path}/t")
    assert totals.apply(0, first) and totals.apply(1, then) and not totals.apply(1, then)
    enc, _ = tokenizer()
    want = collections.Counter()
    for i, text, source, lang in read("documents", "doc_id, text, source, lang"):
        want[source, lang, "bpe" if i % 2 == 0 else "words"] += len(enc.encode_ordinary(text or "")) if i % 2 == 0 else len((text or "").split())
    got = {(r.source, r.lang, r.version): r.tokens for r in totals.totals().collect()}
    assert got == dict(want)


def test_next_of_many_null_ids(spark):
    """Rows without an id are dealt out, each follows another, and all rows are one ring."""
    rows = [(None, f"t{i}") for i in range(200)] + [(i, f"u{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.text: r.next_text for r in fingerprint.with_next(df, "doc_id", ["text"], per_group=7).collect()}
    at, ring = "u39", []
    for _ in rows:
        ring.append(at)
        at = got[at]
    assert at == "u39" and ring[:40] == [f"u{i}" for i in range(39, -1, -1)] and sorted(ring[40:]) == sorted(t for i, t in rows if i is None)
    groups = fingerprint.with_next(df, "doc_id", ["text"], per_group=7)
    assert groups.columns == ["doc_id", "text", "next_text"]
