"""Conversion of HTML to text formats: a table of rules for each format, compiled to one column expression.

A rule is (pattern, replacement); a pattern that starts with "~" is a regular expression in the subset that Java and
RE2 share, any other is plain text. ``sql`` writes the same rules for other SQL engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import strings as S
from quire.functions.dates import formatted
from quire.functions.strings import c

Rules = list[tuple[str, str]]

# The rules of every format, in their order.
#: Scripts and styles never are text; <br> in its three forms.
HEAD: Rules = [("~(?s)<script[^>]*>.*?</script>", ""), ("~(?s)<style[^>]*>.*?</style>", ""), ("~(?s)<!--.*?-->", "")]
BREAKS: Rules = [("~<br ?/?>", "\n")]
LINK = "~<a href=['\"]([^'\"]*)['\"][^>]*>([^<]*)</a>"
TAIL: Rules = [("~<[^>]+>", ""), ("~\n\n\n+", "\n\n"), ("~^\\s+", ""), ("~\\s+$", "")]
ENTITIES: Rules = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def _tags(open_close: dict[str, tuple[str, str]]) -> Rules:
    return [r for tag, (o, e) in open_close.items() for r in ((f"<{tag}>", o), (f"</{tag}>", e))]


def _lists(item: str) -> Rules:
    return [("~<ul[^>]*>", ""), ("</ul>", "\n"), ("<ol>", ""), ("</ol>", "\n"), ("<li>", item), ("</li>", "\n")]


TEXT: Rules = [
    ("~<table[^>]*>", "\n"), ("</table>", "\n"), ("</tr>", "\n"), ("</th>", "\t"), ("</td>", "\t"), ("~</h[1-6]>", "\n"), ("</p>", "\n"),
    *_lists("• "), *BREAKS, ("</pre>", "\n"), (LINK, "$2 ($1)"),
]
MARKDOWN: Rules = [
    ("~(?s)<pre[^>]*>(.*?)</pre>", "\n```\n$1\n```\n"), ("~<code>([^<]*)</code>", "`$1`"),
    *_tags({"h1": ("# ", "\n"), "h2": ("## ", "\n"), "h3": ("### ", "\n"), "b": ("**", "**"), "strong": ("**", "**"), "i": ("*", "*"),
            "em": ("*", "*"), "u": ("_", "_"), "s": ("~~", "~~")}),
    (LINK, "[$2]($1)"), *_lists("- "), *BREAKS, ("</p>", "\n\n"),
]
ORG: Rules = [
    *_tags({"h1": ("\n* ", "\n"), "h2": ("\n** ", "\n"), "h3": ("\n*** ", "\n"), "b": ("*", "*"), "strong": ("*", "*"), "i": ("/", "/"),
            "em": ("/", "/"), "u": ("_", "_"), "s": ("+", "+"), "code": ("~", "~")}),
    ("~<pre[^>]*>", "\n#+BEGIN_SRC\n"), ("</pre>", "\n#+END_SRC\n"), (LINK, "[[$1][$2]]"), *_lists("- "), *BREAKS, ("</p>", "\n\n"),
]
ADOC: Rules = [
    *_tags({"h1": ("\n== ", "\n"), "h2": ("\n=== ", "\n"), "h3": ("\n==== ", "\n"), "b": ("*", "*"), "strong": ("*", "*"), "i": ("_", "_"),
            "em": ("_", "_"), "u": ("[.underline]#", "#"), "s": ("[.line-through]#", "#"), "code": ("`", "`")}),
    ("~<pre[^>]*>", "\n----\n"), ("</pre>", "\n----\n"), (LINK, "$1[$2]"), *_lists("* "), *BREAKS, ("</p>", "\n\n"),
]
#: Headings become lines that start with \x01 and their underline's character; the underline is added line by line.
RST: Rules = [
    ("~<h1>([^<]*)</h1>", "\n\x01=$1\n"), ("~<h2>([^<]*)</h2>", "\n\x01-$1\n"), ("~<h3>([^<]*)</h3>", "\n\x01~$1\n"),
    *_tags({"b": ("**", "**"), "strong": ("**", "**"), "i": ("*", "*"), "em": ("*", "*"), "code": ("``", "``")}),
    ("~<pre[^>]*>", "\n.. code-block::\n\n   "), ("</pre>", "\n"), (LINK, "`$2 <$1>`_"), *_lists("- "), *BREAKS, ("</p>", "\n\n"),
    ("~`([^`<]*) <([^>]*)>`_", "`$1 \x02$2\x03`_"),  # not a tag
]
TEX: Rules = [
    *_tags({"h1": ("\\section{", "}\n"), "h2": ("\\subsection{", "}\n"), "h3": ("\\subsubsection{", "}\n"), "b": ("\\textbf{", "}"),
            "strong": ("\\textbf{", "}"), "i": ("\\textit{", "}"), "em": ("\\textit{", "}"), "u": ("\\underline{", "}"), "s": ("\\sout{", "}")}),
    (LINK, "\\\\href{$1}{$2}"), ("~<ul[^>]*>", "\\\\begin{itemize}\n"), ("</ul>", "\\end{itemize}\n"), ("<ol>", "\\begin{enumerate}\n"),
    ("</ol>", "\\end{enumerate}\n"), ("<li>", "\\item "), ("</li>", "\n"), ("~<br ?/?>", "\\\\\\\\\n"), ("</p>", "\n\n"),
]


def apply(x: Column, rules: Rules) -> Column:
    for pattern, new in rules:
        x = F.regexp_replace(x, pattern[1:], new) if pattern[0] == "~" else F.replace(x, F.lit(pattern), F.lit(new))
    return x


def sql(expr: str, rules: Rules) -> str:
    """The same rules as nested SQL with RE2 patterns (``\\1`` for groups)."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, new in rules:
        if pattern[0] == "~":
            expr = f"regexp_replace({expr}, {q(pattern[1:])}, {q(new.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
        else:
            expr = f"replace({expr}, {q(pattern)}, {q(new)})"
    return expr


def body(html: Column | str) -> Column:
    return apply(S.html_body(c(html)), HEAD)


def to_text(html: Column | str) -> Column:
    return apply(S.html_unescape(apply(body(html), TEXT + TAIL[:1])), TAIL[1:])


def to_markdown(html: Column | str) -> Column:
    return apply(S.html_unescape(apply(body(html), MARKDOWN + TAIL[:1])), TAIL[1:])


def to_org(html: Column | str, title: Column, created: Column, modified: Column) -> Column:
    head = F.concat(
        F.lit("#+TITLE: "), title, F.lit("\n#+DATE: ["), formatted(created, "org"), F.lit("]\n#+MODIFIED: ["), formatted(modified, "org"), F.lit("]\n\n")
    )
    return F.concat(head, apply(S.html_unescape(apply(body(html), ORG + TAIL[:1])), TAIL[1:]))


def to_adoc(html: Column | str, title: Column) -> Column:
    return F.concat(F.lit("= "), title, F.lit("\n\n"), apply(S.html_unescape(apply(body(html), ADOC + TAIL[:1])), TAIL[1:]))


def to_rst(html: Column | str, title: Column) -> Column:
    """Title over- and underlined, headings underlined, each as long as its text and four characters at least."""
    over = F.repeat(F.lit("="), F.greatest(F.length(title), F.lit(4)))
    text = apply(body(html), RST + TAIL[:1])

    def line(x: Column) -> Column:
        t = S.trimmed(F.substring(x, 3, 1 << 30))
        return F.when(x.startswith("\x01"), F.concat(t, F.lit("\n"), F.repeat(F.substring(x, 2, 1), F.greatest(F.length(t), F.lit(4))))).otherwise(x)

    lined = F.array_join(F.transform(F.split(text, "\n"), line), "\n")
    shown = apply(S.html_unescape(apply(lined, [("\x02", "<"), ("\x03", ">")])), TAIL[1:])
    return F.concat(over, F.lit("\n"), title, F.lit("\n"), over, F.lit("\n\n"), shown)


def tex_body(html: Column | str) -> Column:
    """Text and addresses are escaped first, then tags become commands; references are decoded last."""
    x = apply(S.tex_escape(body(html)), TEX + TAIL[:1])
    x = apply(x, [("\\&lt;", "<"), ("\\&gt;", ">"), ("\\&quot;", '"'), ("\\&\\#39;", "'"), ("\\&nbsp;", "~"), ("\\&amp;", "\\&")])
    return apply(x, TAIL[1:])


TEX_TEMPLATE = "\\documentclass{article}\n\\usepackage[utf8]{inputenc}\n\\usepackage{ulem}\n\\usepackage{hyperref}\n\\title{{title}}\n\\author{{author}}\n\\date{{created}}\n\\begin{document}\n{body}\n\\end{document}\n"


def to_tex(html: Column | str, title: Column, created: Column, modified: Column, author: Column | None = None, template: str = TEX_TEMPLATE) -> Column:
    values = {"title": S.tex_escape(title), "author": S.tex_escape(author if author is not None else F.lit("")), "created": F.date_format(created, "yyyy-MM-dd"), "modified": F.date_format(modified, "yyyy-MM-dd")}
    return S.template(F.lit(template), tex_body(html), **values)


def to_rtf(html: Column | str, font: str = "Helvetica", size: float = 12) -> Column:
    """Text is escaped before tags become control words; sizes are half points."""
    heads = {f"h{i}": (f"{{\\b\\fs{int(size * k)} ", "}\\par\n") for i, k in ((1, 2.67), (2, 2.33), (3, 2.0))}
    rules: Rules = [
        *_tags(heads | {"b": ("{\\b ", "}"), "strong": ("{\\b ", "}"), "i": ("{\\i ", "}"), "em": ("{\\i ", "}"), "u": ("{\\ul ", "}"), "s": ("{\\strike ", "}"), "code": ("{\\f1 ", "}")}),
        (LINK, '{\\\\field{\\\\*\\\\fldinst HYPERLINK "$1"}{\\\\fldrslt $2}}'), ("~<ul[^>]*>", ""), ("</ul>", ""), ("<ol>", ""), ("</ol>", ""), ("<li>", "\\bullet "),
        ("</li>", "\\par\n"), ("~<br ?/?>", "\\\\line\n"), ("</p>", "\\par\n"), ("~<[^>]+>", ""),
    ]
    text = S.rtf_unicode(S.html_unescape(apply(S.rtf_escape(body(html)), rules)))
    return F.concat(F.lit(f"{{\\rtf1\\ansi\\ansicpg1252\\deff0\n{{\\fonttbl{{\\f0\\fnil {font};}}{{\\f1\\fmodern Courier;}}}}\n\\fs{int(size * 2)} "), S.trimmed(text), F.lit("\n}"))


def to_opml(html: Column | str, title: Column, created: Column, modified: Column) -> Column:
    """One outline for each line with text; one of the whole text where there is none."""
    lines = F.transform(F.split(apply(body(html), [*BREAKS, ("</p>", "\n"), ("</li>", "\n"), ("~</h[1-6]>", "\n")]), "\n"), lambda x: S.html_unescape(S.trimmed(S.strip_tags(x))))
    lines = F.filter(lines, lambda x: x != "")
    outline = lambda x: F.concat(F.lit('    <outline text="'), S.xml_escape(x), F.lit('" />'))
    rows = F.array_join(F.transform(F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(""))), outline), "\n")
    head = [
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0">\n  <head>\n    <title>'), S.xml_escape(title), F.lit("</title>\n    <dateCreated>"),
        formatted(created, "rfc822"), F.lit("</dateCreated>\n    <dateModified>"), formatted(modified, "rfc822"), F.lit("</dateModified>\n  </head>\n  <body>\n"),
    ]
    return F.concat(*head, rows, F.lit("\n  </body>\n</opml>"))


def to_enex(html: Column | str, title: Column, created: Column, modified: Column, exported: Column | None = None, application: str = "quire") -> Column:
    """The note's body in a CDATA section; its end mark inside the body is split."""
    inner = F.replace(S.html_body(c(html)), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE en-export SYSTEM "http://xml.evernote.com/pub/evernote-export4.dtd">\n<en-export export-date="'),
        formatted(exported if exported is not None else modified, "compact"), F.lit(f'" application="{application}">\n  <note>\n    <title>'), S.xml_escape(title),
        F.lit('</title>\n    <content><![CDATA[<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE en-note SYSTEM "http://xml.evernote.com/pub/enml2.dtd">\n<en-note>'), inner,
        F.lit("</en-note>]]></content>\n    <created>"), formatted(created, "compact"), F.lit("</created>\n    <updated>"), formatted(modified, "compact"),
        F.lit("</updated>\n  </note>\n</en-export>"),
    )


def to_html_page(html: Column | str, title: Column, created: Column, modified: Column, font: str = "sans-serif", size: int = 14) -> Column:
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html>\n<head>\n<meta charset="UTF-8">\n<title>'), S.html_escape(title), F.lit('</title>\n<meta name="created" content="'), formatted(created, "iso"),
        F.lit('">\n<meta name="modified" content="'), formatted(modified, "iso"), F.lit(f'">\n<style>body {{ font-family: {font}; font-size: {size}px; }}</style>\n</head>\n<body>\n'),
        S.html_body(c(html)), F.lit("\n</body>\n</html>"),
    )


def hrefs(html: Column | str) -> Column:
    """array<struct<n, href, text>>: anchors with a usable address, decoded and numbered from 1."""
    found = F.regexp_extract_all(c(html), F.lit(r"(?is)<a\s[^>]*href=[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    parts = F.transform(
        found,
        lambda a: F.struct(
            S.trimmed(S.html_unescape(F.regexp_extract(a, r"(?is)href=[\"']([^\"']*)[\"']", 1))).alias("href"),
            S.trimmed(S.html_unescape(S.strip_tags(a))).alias("text"),
        ),
    )
    usable = F.filter(parts, lambda p: (p["href"] != "") & ~F.lower(p["href"]).startswith("javascript:"))
    return F.transform(usable, lambda p, i: F.struct((i + 1).alias("n"), p["href"].alias("href"), p["text"].alias("text")))


def data_uris(html: Column | str) -> Column:
    """array<struct<seq, mime, ext, data>>: base64 images in the text, broken ones left out."""
    from quire.functions.types import ext_of

    found = F.regexp_extract_all(c(html), F.lit(r"data:([a-zA-Z0-9.+/-]+);base64,([A-Za-z0-9+/=\s]+)"), F.lit(0))
    parts = F.transform(
        found,
        lambda u: F.struct(
            F.regexp_extract(u, "^data:([^;]+);", 1).alias("mime"),
            F.try_to_binary(F.regexp_replace(F.regexp_extract(u, r"(?s)base64,(.*)$", 1), r"\s", ""), F.lit("base64")).alias("data"),
        ),
    )
    good = F.filter(parts, lambda p: F.length(p["data"]) > 0)
    return F.transform(good, lambda p, i: F.struct((i + 1).alias("seq"), p["mime"].alias("mime"), F.coalesce(ext_of(p["mime"]), F.lit("bin")).alias("ext"), p["data"].alias("data")))


def extensions(html: Column | str) -> Column:
    """Distinct extensions of the images in a document, sorted."""
    return F.sort_array(F.array_distinct(F.transform(data_uris(html), lambda p: p["ext"])))


def _fields(html: Column, title: Column, created: Column, modified: Column) -> list[Column]:
    """A note by itself as a record: no folder, account or attachments."""
    when = lambda x: formatted(x, "iso")
    return [title.alias("title"), to_text(html).alias("body"), when(created).alias("created"), when(modified).alias("modified"), F.lit(0).alias("attachment_count")]


def to_json(html: Column, title: Column, created: Column, modified: Column, pretty: bool = True) -> Column:
    return F.to_json(F.struct(*_fields(html, title, created, modified)), {"ignoreNullFields": "false", "pretty": str(pretty).lower()})


def to_csv(html: Column, title: Column, created: Column, modified: Column) -> Column:
    """One row, every field quoted: title, created, modified, body, number of attachments."""
    when = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    fields = [title, when(created), when(modified), to_text(html), F.lit("0")]
    return F.concat_ws(",", *[F.concat(F.lit('"'), S.csv_escape(f), F.lit('"')) for f in fields])


def to_xml(html: Column, title: Column, created: Column, modified: Column) -> Column:
    tag = lambda name, x: F.concat(F.lit(f"  <{name}>"), S.xml_escape(x), F.lit(f"</{name}>\n"))
    parts = [tag("title", title), tag("created", formatted(created, "iso")), tag("modified", formatted(modified, "iso")), tag("body", to_text(html))]
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<note>\n'), *parts, F.lit('  <attachments count="0" />\n</note>'))


#: Text formats by name; each takes html, title, created, modified.
FORMATS: dict[str, Callable[[Column, Column, Column, Column], Column]] = dict(
    json=to_json, jsonl=lambda h, t, a, b: to_json(h, t, a, b, False), csv=to_csv, xml=to_xml, html=lambda h, t, a, b: to_html_page(h, t, a, b), txt=lambda h, t, a, b: to_text(h), markdown=lambda h, t, a, b: to_markdown(h),
    org=lambda h, t, a, b: to_org(h, t, a, b), rst=lambda h, t, a, b: to_rst(h, t), adoc=lambda h, t, a, b: to_adoc(h, t), tex=lambda h, t, a, b: to_tex(h, t, a, b),
    rtf=lambda h, t, a, b: to_rtf(h), opml=lambda h, t, a, b: to_opml(h, t, a, b), enex=lambda h, t, a, b: to_enex(h, t, a, b),
)
ALIASES = {"md": "markdown", "text": "txt", "plain": "txt", "latex": "tex", "asciidoc": "adoc", "evernote": "enex", "ndjson": "jsonl"}


def render(fmt: str, html: Column, title: Column, created: Column, modified: Column) -> Column:
    """Any text format by name or alias; records with folder and attachments are ``quire.sources.sinks``'."""
    name = ALIASES.get(fmt.lower(), fmt.lower())
    if name not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {sorted(FORMATS)}")
    return FORMATS[name](html, title, created, modified)
