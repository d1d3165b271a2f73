"""Column expressions on names, paths and escapes; no Python runs on rows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that may not stand in a file name.
ILLEGAL = r'[\\/:*?"<>|\p{Cc}\p{Cn}\x{2028}\x{2029}]'


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sanitize_drop(name: Column | str) -> Column:
    """Without the characters that may not stand in a file name (titles of notes)."""
    return F.regexp_replace(c(name), ILLEGAL, "")


def sanitize_underscore(name: Column | str) -> Column:
    """The same characters replaced by ``_`` (names of accounts and folders)."""
    return F.regexp_replace(c(name), ILLEGAL, "_")


def split_ext(name: Column | str) -> Column:
    """struct(name, ext): split at the last dot; a leading dot starts no extension."""
    n = c(name)
    whole = n.rlike(r"(?s)^.+\.[^.]*$")
    return F.struct(
        F.when(whole, F.regexp_extract(n, r"(?s)^(.+)\.([^.]*)$", 1)).otherwise(n).alias("name"),
        F.when(whole, F.regexp_extract(n, r"(?s)^(.+)\.([^.]*)$", 2)).otherwise(F.when(n.isNotNull(), "")).alias("ext"),
    )


def _chain(x: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def html_escape(x: Column | str) -> Column:
    return _chain(c(x), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])


def xml_escape(x: Column | str) -> Column:
    return _chain(c(x), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")])


def json_escape(x: Column | str) -> Column:
    """The inside of a JSON string, with every control character escaped as JSON needs."""
    j = F.to_json(F.struct(c(x).alias("v")))
    return F.when(c(x).isNotNull(), F.substring(j, 7, F.length(j) - 8))


def csv_escape(x: Column | str) -> Column:
    return F.replace(c(x), F.lit('"'), F.lit('""'))


#: TeX's special characters.
TEX = {
    "\\": "\\textbackslash{}", "&": "\\&", "%": "\\%", "$": "\\$", "#": "\\#", "_": "\\_", "{": "\\{", "}": "\\}",
    "~": "\\textasciitilde{}", "^": "\\textasciicircum{}",
}


def tex_escape(x: Column | str) -> Column:
    """One pass over the characters, so that no replacement is escaped again."""
    table = F.create_map(*[F.lit(v) for kv in TEX.items() for v in kv])
    chars = F.transform(F.split(c(x), ""), lambda ch: F.coalesce(F.element_at(table, ch), ch))
    return F.when(c(x).rlike(r"[\\&%$#_{}~^]"), F.array_join(chars, "")).otherwise(c(x))


def rtf_escape(x: Column | str) -> Column:
    return _chain(c(x), [("\\", "\\\\"), ("{", "\\{"), ("}", "\\}")])


def rtf_unicode(x: Column | str) -> Column:
    """Characters beyond ASCII as signed 16-bit ``\\uN?``, those beyond the first plane as two surrogates."""
    signed = lambda v: F.when(v > 32767, v - 65536).otherwise(v).cast("string")
    unit = lambda v: F.concat(F.lit("\\u"), signed(v), F.lit("?"))

    def one(ch: Column) -> Column:
        code = F.ascii(ch)
        over = code - 65536
        pair = F.concat(unit(F.shiftright(over, 10) + 0xD800), unit(over.bitwiseAND(0x3FF) + 0xDC00))
        return F.when(code < 128, ch).when(code < 65536, unit(code)).otherwise(pair)

    return F.when(c(x).rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(c(x), ""), one), "")).otherwise(c(x))


def html_unescape(x: Column | str) -> Column:
    """Seven named references and numeric ones, ``&amp;`` last so that nothing is decoded twice."""
    x = _chain(c(x), [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'")])
    refs = F.array_distinct(F.regexp_extract_all(x, F.lit("&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0)))

    def decoded(ref: Column) -> Column:
        hexed = F.lower(F.substring(ref, 3, 1)) == "x"
        code = F.when(hexed, F.conv(F.regexp_extract(ref, "([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(ref, "([0-9]+);", 1)).cast("bigint")
        good = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(ref)

    numeric = F.aggregate(refs, x, lambda a, r: F.replace(a, r, decoded(r)))
    return F.replace(F.when(x.contains("&#"), numeric).otherwise(x), F.lit("&amp;"), F.lit("&"))


def html_body(x: Column | str) -> Column:
    """What stands between ``<body>`` and ``</body>``, else the input."""
    body = F.regexp_extract(c(x), r"(?s)<body>(.*?)</body>", 1)
    return F.when(c(x).rlike(r"(?s)<body>.*?</body>"), body).otherwise(c(x))


def strip_tags(x: Column | str) -> Column:
    return F.regexp_replace(c(x), "<[^>]+>", "")


def trimmed(x: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c(x), r"^\s+|\s+$", "")


def squeeze(x: Column | str) -> Column:
    """Three and more line feeds become two; trimmed."""
    return trimmed(F.regexp_replace(c(x), "\n\n\n+", "\n\n"))


#: Schemes that a link may have.
SCHEMES = ("http://", "https://", "mailto:", "applenotes:", "tel:", "sms:", "ftp://")


def safe_href(x: Column | str) -> Column:
    t = trimmed(x)
    ok = F.lower(t).rlike("^(" + "|".join(SCHEMES) + ")")
    return F.when(c(x).isNotNull(), F.when(ok, html_escape(t)).otherwise("#"))


def relative_path(source: Column | str, target: Column | str) -> Column:
    """Path from the file ``source`` to the file ``target``, both below one root."""
    s = F.filter(F.split(c(source), "/"), lambda p: p != "")
    t = F.filter(F.split(c(target), "/"), lambda p: p != "")
    dirs = F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))
    most = F.least(F.size(dirs), F.size(t) - 1)
    # The common prefix: the first place where the two differ.
    places = F.sequence(F.lit(0), most)
    differ = F.filter(places, lambda i: (i == most) | ~F.get(dirs, i).eqNullSafe(F.get(t, i)))
    k = F.array_min(differ)
    up = F.repeat(F.lit("../"), F.size(dirs) - k)
    return F.concat(up, F.array_join(F.slice(t, k + 1, F.size(t)), "/"))


def path_encode(x: Column | str) -> Column:
    """Percent-encoded path, separators kept."""
    return F.array_join(F.transform(F.split(c(x), "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")


def template(text: Column | str, body: Column | str, **values: Column) -> Column:
    """Fill the ``{name}`` and ``{body}`` placeholders of a user's template in one pass: braces in what is filled in stay."""
    filled = {"{" + k + "}": F.coalesce(v.cast("string"), F.lit("")) for k, v in [*values.items(), ("body", c(body))]}
    pieces = F.regexp_extract_all(c(text), F.lit("|".join([*map(re.escape, filled), r"[^{]+", r"\{"])), F.lit(0))
    # An array of one, so that what is filled in is worked out once and not for each piece.
    once = F.array(F.struct(pieces.alias("pieces"), F.create_map(*[x for k, v in filled.items() for x in (F.lit(k), v)]).alias("table")))
    return F.get(F.transform(once, lambda t: F.array_join(F.transform(t["pieces"], lambda p: F.coalesce(F.element_at(t["table"], p), p)), "")), 0)


def bare_url(entries: Column | str) -> Column:
    """First text of an array that starts with http or https; null if none does."""
    return F.get(F.filter(c(entries), lambda e: e.rlike("^https?://")), 0)
