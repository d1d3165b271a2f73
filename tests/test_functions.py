"""Column functions on literal cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from quire.functions import dates as D
from quire.functions import strings as S
from quire.functions import types as Y
from quire.operators import filters, markup


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "drop", "under"),
    [
        ("a/b\\c", "abc", "a_b_c"), ('note: <"why?"> *test*|x', "note why test" + "x", "note_ __why___ _test__x"), ("clean", "clean", "clean"), ("", "", ""), ("a\nb\rc", "abc", "a_b_c"),
        ("Ünïcode (ok)", "Ünïcode (ok)", "Ünïcode (ok)"),
    ],
)
def test_sanitize(spark, text, drop, under):
    assert one(spark, S.sanitize_drop(F.lit(text))) == drop
    assert one(spark, S.sanitize_underscore(F.lit(text))) == under


@pytest.mark.parametrize(
    ("text", "want"), [("note.md", ("note", "md")), ("my.test.file.pdf", ("my.test.file", "pdf")), ("README", ("README", "")), (".gitignore", (".gitignore", ""))]
)
def test_split_ext(spark, text, want):
    assert tuple(one(spark, S.split_ext(F.lit(text)))) == want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("acc/Notes/A.md", "acc/Notes/B.md", "B.md"), ("acc/Work/A.md", "acc/Personal/B.md", "../Personal/B.md"), ("iCloud/Notes/A.md", "OnMyMac/Other/B.md", "../../OnMyMac/Other/B.md"),
        ("acc/Notes/A.md", "acc/Notes/Subfolder/B.md", "Subfolder/B.md"), ("acc/Notes/Sub/A.md", "acc/Notes/B.md", "../B.md"), ("A.md", "x/B.md", "x/B.md"),
    ],
)
def test_relative_path(spark, a, b, want):
    assert one(spark, S.relative_path(F.lit(a), F.lit(b))) == want


def test_escapes(spark):
    assert one(spark, S.html_escape(F.lit("<a & 'b' \"c\">"))) == "&lt;a &amp; &#39;b&#39; &quot;c&quot;&gt;"
    assert one(spark, S.tex_escape(F.lit("\\{50%}_~^#&$"))) == "\\textbackslash{}\\{50\\%\\}\\_\\textasciitilde{}\\textasciicircum{}\\#\\&\\$"
    assert one(spark, S.rtf_unicode(F.lit("é漢😀a"))) == "\\u233?\\u28450?\\u-10179?\\u-8704?a"
    assert one(spark, S.json_escape(F.lit('a"b\\\n\t\x01'))) == 'a\\"b\\\\\\n\\t\\u0001'
    assert one(spark, S.html_unescape(F.lit("&lt;b&gt; &#65;&#x1F600; &amp;lt; &#xD800;"))) == "<b> A😀 &lt; &#xD800;"
    assert one(spark, S.csv_escape(F.lit('say "x"'))) == 'say ""x""'


def test_links_and_templates(spark):
    assert [one(spark, S.safe_href(F.lit(x))) for x in (" HTTPS://a?b&c ", "javascript:x", "tel:1", "")] == ["HTTPS://a?b&amp;c", "#", "tel:1", "#"]
    assert one(spark, S.template(F.lit("{title}|{body}"), F.lit("{title}"), title=F.lit("T"))) == "T|{title}"
    assert one(spark, S.path_encode(F.lit("a b/ü.md"))) == "a%20b/%C3%BC.md"
    assert one(spark, S.bare_url(F.array(F.lit("x"), F.lit("http://a")))) == "http://a"


def test_magic_and_sizes(spark):
    ext = lambda h: one(spark, Y.magic_ext(F.unhex(F.lit(h))))
    cases = ["FFD8FFE0", "89504E47", "25504446", "47494638", "0000001866747970686569630000", "00112233", "FFD8", "FFD80000", "47494600", "00000018667479"]
    assert [ext(x) for x in cases] == ["jpg", "png", "pdf", "gif", "heic", None, None, None, None, None]
    assert tuple(one(spark, Y.image_size(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452000000100000000A"))))) == (16, 10)


def test_types(spark):
    kind = lambda t: one(spark, Y.classify_type(F.lit(t)))
    assert [kind(x) for x in ("com.apple.notes.inlinetextattachment.mention", "com.apple.notes.inlinetextattachment.zzz", "public.zip", "dyn.a", "x", "", "org.webmproject.webp")] == [
        "inline_mention", "inline_unknown", "public_generic", "dynamic", "unknown", "unknown", "image",
    ]
    ids = ["public.jpeg", "com.apple.notes.table", "com.apple.drawing", "com.apple.notes.inlinehashtagattachment", "com.apple.notes.inlinementionattachment", "com.apple.notes.inlinetextattachment.link", "public.url"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ids)], "id int, type string")
    assert {r.id for r in filters.file_attachments(df).collect()} == {0, 2}


def test_dates(spark):
    at = datetime.datetime(2021, 6, 21, 22, 40, 9)
    for text in ("Monday, June 21, 2021 at 10:40:09 PM", "Jun 21, 2021, 10:40:09 PM", "June 21, 2021 at 10:40:09 PM"):
        assert one(spark, D.parse_date_multi(F.lit(text))) == at
    assert one(spark, D.parse_date_multi(F.lit("soon"))) is None
    assert one(spark, D.from_epoch(F.lit(0.0))) == datetime.datetime(2001, 1, 1)
    with pytest.raises(Exception, match="not a date"):
        one(spark, D.parse_date(F.lit("yesterday")))


HTML = "<html><body><h1>T &amp; x</h1><b>bold</b> <i>it</i> <a href='http://a'>link</a><br><ul><li>one</li><li>two</li></ul><pre>c<br>d</pre></body></html>"


def test_markup(spark):
    t = F.lit("Title")
    at = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    show = lambda f: one(spark, markup.render(f, F.lit(HTML), t, at, at))
    assert show("txt") == "T & x\nbold it link (http://a)\n• one\n• two\n\nc\nd"
    assert show("markdown") == "# T & x\n**bold** *it* [link](http://a)\n- one\n- two\n\n```\nc\nd\n```"
    when = "[2024-01-02 Tue 03:04]"
    assert show("org") == f"#+TITLE: Title\n#+DATE: {when}\n#+MODIFIED: {when}\n\n* T & x\n*bold* /it/ [[http://a][link]]\n- one\n- two\n\n#+BEGIN_SRC\nc\nd\n#+END_SRC"
    assert show("rst") == "=====\nTitle\n=====\n\nT & x\n=========\n**bold** *it* `link <http://a>`_\n- one\n- two\n\n.. code-block::\n\n   c\nd"
    assert show("adoc") == "= Title\n\n== T & x\n*bold* _it_ http://a[link]\n* one\n* two\n\n----\nc\nd\n----"
    body = "\\section{T \\& x}\n\\textbf{bold} \\textit{it} \\href{http://a}{link}\\\\\n\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}\nc\\\\\nd"
    head = "\\documentclass{article}\n\\usepackage[utf8]{inputenc}\n\\usepackage{ulem}\n\\usepackage{hyperref}\n\\title{Title}\n\\author{}\n\\date{2024-01-02}\n"
    assert show("tex") == head + "\\begin{document}\n" + body + "\n\\end{document}\n"
    rtf = "{\\rtf1\\ansi\\ansicpg1252\\deff0\n{\\fonttbl{\\f0\\fnil Helvetica;}{\\f1\\fmodern Courier;}}\n\\fs24 {\\b\\fs32 T & x}\\par\n{\\b bold} {\\i it} "
    assert show("rtf") == rtf + '{\\field{\\*\\fldinst HYPERLINK "http://a"}{\\fldrslt link}}\\line\n\\bullet one\\par\n\\bullet two\\par\nc\\line\nd\n}'
    outlines = "".join(f'    <outline text="{x}" />\n' for x in ("T &amp; x", "bold it link", "one", "two", "c", "d"))
    stamps = "".join(f"    <date{x}>Tue, 02 Jan 2024 03:04:05 +0000</date{x}>\n" for x in ("Created", "Modified"))
    assert show("opml") == f'<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0">\n  <head>\n    <title>Title</title>\n{stamps}  </head>\n  <body>\n{outlines}  </body>\n</opml>'
    assert "<en-note><h1>" in show("enex") and "<title>Title</title>" in show("html")
    iso, plain = "2024-01-02T03:04:05.000Z", "T & x\\nbold it link (http://a)\\n• one\\n• two\\n\\nc\\nd"
    assert show("ndjson") == f'{{"title":"Title","body":"{plain}","created":"{iso}","modified":"{iso}","attachment_count":0}}'
    assert show("json") == f'{{\n  "title" : "Title",\n  "body" : "{plain}",\n  "created" : "{iso}",\n  "modified" : "{iso}",\n  "attachment_count" : 0\n}}'
    text = show("txt")
    assert show("csv") == f'"Title","2024-01-02 03:04:05","2024-01-02 03:04:05","{text}","0"'
    inner = text.replace("&", "&amp;")
    assert show("xml") == f'<?xml version="1.0" encoding="UTF-8"?>\n<note>\n  <title>Title</title>\n  <created>{iso}</created>\n  <modified>{iso}</modified>\n  <body>{inner}</body>\n  <attachments count="0" />\n</note>'
    with pytest.raises(ValueError, match="unknown format"):
        markup.render("doc", t, t, at, at)


def test_data_uris(spark):
    html = "<img src='data:image/png;base64,iVBORw0K'><img src='data:image/png;base64,A=B'><img src='x.png'>"
    got = one(spark, markup.data_uris(F.lit(html)))
    assert [(x.seq, x.mime, x.ext, bytes(x.data)) for x in got] == [(1, "image/png", "png", b"\x89PNG\r\n")]
    links = one(spark, markup.hrefs(F.lit("<a href='javascript:x'>j</a><a class=q href=\"http://x?a&amp;b\"><b>T</b></a>")))
    assert [tuple(x) for x in links] == [(1, "http://x?a&b", "T")]
