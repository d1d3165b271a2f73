"""Defined results on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import datetime  # noqa: F401
import random
import time

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import ann, bpe, fingerprint, html_text, mixing, neardup, rollup, secrets, toxicity, warc
from quire.llm.queries import ranks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, score string, p string, class_id string, ids string, kept string"
LONG = "word " * 60_000 + "password=abcdef123456 end"


def docs(spark, rows=None):
    same = "one two three four five six seven eight nine ten eleven twelve"
    base = [(1, None, None, None), (2, "", "en", "a"), (3, LONG, "en", "a"), (4, same, "en", "a"), (4, same, "en", "a"), (5, same, "de", None), (6, "   ", "en", "b"), (None, "null id text here", "en", "b")]
    full = [(i, t, g, s, len(t or ""), "x", "x", "x", "x", "x", "x") for i, t, g, s in (base if rows is None else rows)]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def table(spark):
    return docs(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_secrets(table, empty):
    flat = [0.0] * (secrets.WIDTH**2)
    got = by_id(secrets.scan(table, flat, keep=("text",)))
    assert len(got) == 7 and got[1].spans == [] and got[2].spans == []
    assert [tuple(s) for s in got[3].spans] == [(300_000, 0, 300_021)]
    red = secrets.scan(table, flat, keep=("text",)).select("doc_id", secrets.redacted("text", "spans").alias("t"))
    assert by_id(red)[3].t.endswith("word [SECRET] end")
    assert secrets.scan(empty, flat).count() == 0 and len(secrets.fit(secrets.default_samples(empty))) == secrets.WIDTH**2


def test_mixing(table, empty):
    rows = mixing.sample(table).collect()
    assert len(rows) == 8 and all(0 <= r.p <= 1 for r in rows) and {r.kept for r in rows if r.doc_id == 4} in ({True}, {False})
    assert mixing.sample(empty).count() == 0


def test_bpe(table, empty):
    out = ("ids", "decoded", "n_tokens")
    rows = bpe.encode(table, ranks(), public_tokenizers.PATTERN, outputs=out).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 8 and got[1].ids == [] and got[2].n_tokens == 0 and got[3].decoded == LONG and got[6].decoded == "   "
    assert bpe.encode(empty, ranks(), public_tokenizers.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(table, ranks(), public_tokenizers.PATTERN), ranks())
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()}[3] == LONG


def test_near_dup(table, empty):
    got = [(r.doc_id, r.class_id) for r in neardup.classes(table).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (6, 1), (3, 3), (4, 4), (4, 4), (5, 4), (None, None)], key=str)
    # An id with two texts is in both classes; a class without ids has none.
    twice = docs(table.sparkSession, [(7, "a b c d e f g h", "en", "s"), (7, "q r s t u v w x", "en", "s"), (9, "q r s t u v w x", "en", "s"), (None, "a b c d e f g h", "en", "s"), (None, "k l m n o p", "en", "s")])
    assert sorted(((r.doc_id, r.class_id) for r in neardup.classes(twice).collect()), key=str) == sorted([(7, 7), (7, 7), (9, 7), (None, 7), (None, None)], key=str)
    assert neardup.classes(empty).count() == 0


def test_long_chains_are_one_class(spark):
    """Each version is like the next only: components of any diameter."""
    ids = random.Random(3).sample(range(1 << 40), 1_100)
    chains = [ids[:800], ids[800:1_000], ids[1_000:]]
    edges = [tuple(sorted(pair)) for chain in chains for pair in zip(chain, chain[1:], strict=False)]
    got = {r.id: r.label for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: min(chain) for chain in chains for i in chain}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rare_shingles_are_not_broadcast(spark):
    """Few bytes on disk can be many in memory, and grow with the corpus."""
    texts = spark.createDataFrame([(i, neardup.packed(" ".join(f"w{j}" for j in range(40)) + f" end{i}")) for i in range(6)], "id long, codes binary")
    found = neardup.rest_candidates(texts, texts.select("id", F.col("id").alias("label")))
    assert found.count() == 15 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_fingerprint(spark, table, empty):
    got = by_id(fingerprint.fingerprint(table, "text", "score"))
    assert got[1].score == got[2].score == got[6].score == "" and got[4].score == got[5].score and len(got[3].score) == fingerprint.BINS
    like = table.select(fingerprint.likeness(F.lit(""), F.lit("")).alias("a"), fingerprint.likeness(F.lit(""), F.lit("0" * 128)).alias("b")).first()
    assert (like.a, like.b) == (1.0, 0.0)
    nexts = fingerprint.with_next(table.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", ["text"]).collect()
    assert len(nexts) == 8 and {r.doc_id: r.next_text for r in nexts}[6] == docs(spark).where("doc_id = 5").first().text
    assert fingerprint.with_next(empty.select("doc_id", "text"), "doc_id", ["text"]).count() == 0


def test_toxicity(spark, table, empty):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(labels, table)
    got = toxicity.score(table, model).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    # An id with several texts and labels is one row to learn from; the bound on coordinates keeps the first text at least.
    twice = docs(spark, [(3, "bad bad words", "en", "a"), (3, "other words", "en", "a")])
    assert len(toxicity.fit(labels, twice, max_coordinates=1).index) >= 0
    blank = toxicity.fit(labels.limit(0), empty)
    assert toxicity.score(empty, blank).count() == 0 and {r.score for r in toxicity.score(table, blank).collect()} == {0.5}


def test_html(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", None, "x", "x"), (2, None, "", "x", "x"), (3, "u", "<p>" + "long " * 50_000, "x", "x"), (3, "u", "<nav>only</nav>", "x", "x"), (4, "u", "plain &lt;b&gt; &amp;", "x", "x")]
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, schema)).collect()]
    assert sorted((i, t) for i, t, _ in got if i != 3) == [(1, ""), (2, ""), (4, "plain <b> &")]
    assert sorted(n for i, _, n in got if i == 3) == [0, 249_999] and html_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_warc(spark, tmp_path):
    schema = "page_id long, url string, html string, mark string, refers_to string"
    rows = [(1, None, None, "m", "r"), (2, "http://a\r\nX: y", "", "m", "r"), (3, "u", "<p>same</p>", "m", "r"), (9, "u", "<p>same</p>", "m", "r"), (5, "ü", "x" * 300_000, "m", "r")]
    warc.write(spark.createDataFrame(rows, schema), f"file://{tmp_path}/a")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, r.url) for r in warc.read(spark, f"file://{tmp_path}/a").collect()}
    assert got == {
        1: (0, "revisit", 2, warc.urn(1, warc.digest(b""))), 2: (0, "response", None, "http://aX: y"), 3: (11, "revisit", 9, "u"), 9: (11, "response", None, "u"), 5: (300_000, "response", None, "ü"),
    }
    warc.write(spark.createDataFrame([], schema), f"file://{tmp_path}/e")
    assert warc.read(spark, f"file://{tmp_path}/e").count() == 0
    # Repeated rows and null ids: every row is a record, the first of equal ones is the response.
    odd = [(1, "u", "x", "m", "r")] * 3 + [(1, "u", "y", "m", "r"), (None, "u", "x", "m", "r"), (None, "u", "z", "m", "r"), (None, "v", "z", "m", "r")]
    warc.write(spark.createDataFrame(odd, schema), f"file://{tmp_path}/t")
    back = sorted(((r.page_id, r.payload_digest[:3], r.record_type, r.refers_to) for r in warc.read(spark, f"file://{tmp_path}/t").collect()), key=str)
    x, y, z = (warc.digest(t.encode())[:3] for t in "xyz")
    want = [(1, x, "response", None), (1, x, "revisit", 1), (1, x, "revisit", 1), (1, y, "response", None), (None, x, "revisit", 1), (None, z, "response", None), (None, z, "revisit", None)]
    assert back == sorted(want, key=str)


def test_ann(spark):
    schema = "vec_id long, embedding array<float>, rank string, score string"
    bad = float("nan")
    rows = [(i, v, "x", "x") for i, v in [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [bad, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.5])]]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, df.where("vec_id % 20 = 0 OR vec_id = 4"), k=3).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]
    assert ann.search(df.limit(0), df).count() == 0
    # Rows that repeat id and vector count once, a vector of another length takes no part, an id with two is two candidates.
    more = spark.createDataFrame([(0, [1.0, 0.0], "x", "x")] * 6 + [(9, [3.0, 3.0, 3.0], "x", "x"), (3, [0.5, 0.0], "x", "x")], schema).union(df)
    got = sorted((r["rank"], r.vec_id, r.score) for r in ann.search(more, more.where("vec_id = 0"), k=4).collect())
    assert got == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.5), (4, 3, 0.0)]
    # A query whose own lists hold too few goes on to the others.
    far = spark.createDataFrame([(i, [float(i % 7 == g) + i / 1e4 for g in range(7)]) for i in range(400)], "vec_id long, embedding array<double>")
    assert ann.search(far, far.where("vec_id = 20"), k=399).count() == 399


def test_rollup(spark, tmp_path):
    schema = "op string, source string, lang string, version string, tokens long, old_version string, old_tokens long, docs string"
    r = rollup.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    one = spark.createDataFrame([("insert", "a", "en", "1", 10, None, None, "x"), ("insert", None, "en", "1", None, None, None, "x")], schema)
    two = spark.createDataFrame([("revise", "a", "en", "2", 7, "1", 10, "x"), ("delete", None, "en", None, None, "1", 0, "x")], schema)
    assert r.apply(1, one) and not r.apply(1, one) and r.apply(2, two) and not r.apply(2, two)
    assert r.apply(3, two.limit(0)) and r.last() == 3
    with pytest.raises(ValueError, match="other changes"):
        r.apply(2, one)
    assert r.apply(9, two.limit(0))
    with pytest.raises(ValueError, match="never committed"):
        r.apply(5, one)
    assert sorted(map(tuple, r.totals().collect()), key=str) == [("a", "en", "2", 1, 7)]
    with pytest.raises(Exception, match="unknown op"):
        r.apply(10, spark.createDataFrame([("drop", "a", "en", "1", 1, None, None, "x")], schema))
    assert r.apply(10, one) and len(list((tmp_path / "r" / "totals").glob("v=*"))) == 2


def test_html_names_of_boilerplate():
    long = "A sentence of the page's own text that is long enough to count for a line of it. " * 2
    body = f"<p>{long}</p><p>{long}</p>"
    want = "\n".join([long.strip()] * 2)
    for name in ('class="page no-sidebar"', 'class="main with-sidebar"', 'class="site has-header-image"', 'class="social"', "id=side-effects", "id='related-work'", 'data-x="?id=menu"'):
        assert html_text.main_text(f"<body><div {name}>{body}</div></body>") == want
    assert html_text.main_text(f"<body>{body}<section id='side-effects'><p>{long}</section><div class='social-history'>{long}</div></body>") == "\n".join([long.strip()] * 4)
    # Without the optional end tag, what is named ends with its next sibling or its parent.
    assert html_text.main_text(f"<body>{body}<p class=notice>gone<p>{long}<ul><li class=share>gone<li>{long}</ul><p>{long}</body>") == "\n".join([long.strip()] * 5)
    assert html_text.main_text(f"<body>{body}<figure><img><figcaption>{long}</figcaption></figure><div class='ad-slot'>{long}</div></body>") == "\n".join([long.strip()] * 3)
    assert html_text.main_text(f"<body>{body}<article class='comment'>{long}</article></body>") == want


def test_html_windows_decide_on_every_page():
    long = "A sentence of the page's own text that is long enough to count for a line of it. " * 2
    line = long.strip()
    links = "".join(f"<p><a href=/{i}>a link of a list {i}</a></p>" for i in range(8))
    # The body stands beside several article elements, and what follows a dive is no text.
    page = f"<body><div><p>{long}</p><p>short</p><p>{long}</p></div><article><p>{long}</p></article><article><p>{long}</p></article>{links}<p>end</p></body>"
    assert html_text.main_text(page) == "\n".join([line, "short", line, line, line])
    assert html_text.main_text(f"<body><p>skip</p>{links}<div><p>{long}</p><p>x</p></div>{links}<p>{long}</p>{links}<p>end</p></body>") == "\n".join([line, "x", line])
    assert html_text.main_text(f"<body><article><p>{long}</p></article><article class='comment'><p>one comment</p></article></body>") == line


def test_html_of_readers_and_notices_is_never_the_article():
    long = "A sentence of the page's own text that is long enough to count for a line of it. " * 2
    body, want = f"<h1>Head</h1><p>{long}</p><p>{long}</p>", "\n".join(["Head", *[long.strip()] * 2])
    said = f"<p>{long * 3}</p>" * 4
    for name in ("reply", "user-reply", "comment-body", "discussion", "responses", "comments", "cookie-notice", "cookie-consent", "newsletter-signup"):
        assert html_text.main_text(f"<body><div>{body}</div><div class='{name}'>{said}</div></body>") == want
    # Names of layout: not around the article, and not where nothing else is.
    assert html_text.main_text(f"<body><div class='page-widget'><article>{body}</article></div><div class='sidebar'>{said}</div></body>") == want
    assert html_text.main_text(f"<body><div class='sidebar'>{body}</div><p>x</p></body>") == want + "\nx"
    # Without an article element nothing changes, short lines before the surge included.
    assert html_text.main_text(f"<body><nav>a menu</nav><div class='ad'>gone</div><div>{body}</div><footer>end</footer></body>") == want
    assert html_text.main_text(f"<body><section id='discussion'>{body}</section></body>") == want


def test_html_broken_markup_takes_no_more_time_than_its_length():
    broken = [
        "<a " * 300_000 + '"', '<a href="x' * 100_000, "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000, "<div class=ad>x" * 60_000, "<div class=sidebar>x" * 50_000, "<" * 1_000_000, "<p>" * 300_000,
        "<div class=menu>" * 50_000 + "<h1>x" * 50_000, "<a =" + " " * 900_000 + "<b>", "<script>" * 100_000, "<!--" * 200_000, "</p" * 300_000, "<a title='" * 90_000 + ">" * 1000,
    ]
    for page in broken:
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 8  # quadratic reading takes minutes
    assert html_text.main_text("<p>" + "x" * 100 + '<a href="never ends>link</a> and on <b>bold</b>') == "x" * 100 + "link and on bold"


def test_html_pages_without_their_article_elements():
    pages = [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    assert all(html_text.main_text(p.replace("<article>", "<div>").replace("</article>", "</div>")) == html_text.main_text(p) != "" for p in pages)
