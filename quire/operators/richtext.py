"""Styled runs to HTML: one ordered fold per note, in the JVM.

``runs`` is array<struct<length, style_type, indent, done, weight, underlined, strike, link, attachment_id, type>>; lengths
count UTF-16 units of ``text``. Items of a list are flushed before their list is closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import strings as S
from quire.functions.types import INLINE

RUN = "struct<length:int,style_type:int,indent:int,done:int,weight:int,underlined:int,strike:int,link:string,attachment_id:string,type:string>"
STYLE = ("style_type", "indent", "done", "weight", "underlined", "strike", "link")
# Paragraph styles, their list tags and marks.
LISTS = {100: ("<ul>", "</ul>"), 101: ("<ul style='list-style-type: square;'>", "</ul>"), 102: ("<ol>", "</ol>"), 103: ("<ul style='list-style-type: none;'>", "</ul>")}
PRE = "<pre style='white-space: pre-wrap; font-family: monospace; background: #f5f5f5; padding: 8px; border-radius: 4px; margin: 4px 0;'>"
BLOCKS = {0: ("<h1>", "</h1>"), 1: ("<h2>", "</h2>"), 2: ("<h3>", "</h3>"), 4: (PRE, "</pre>")}
STACK = "array<struct<type:int,indent:int>>"


def utf16_slice(text: Column, start: Column, length: Column) -> Column:
    """Code units ``start`` (from 0) to ``start + length``; ``substring`` on strings would count code points."""
    return F.decode(F.substring(F.encode(text, "UTF-16BE"), start * 2 + 1, length * 2), "UTF-16BE")


def merged(runs: Column) -> Column:
    """Neighbours of one style as one run; attachment runs stay alone."""

    def step(done: Column, r: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        same = last["attachment_id"].isNull() & r["attachment_id"].isNull()
        for s in STYLE:
            same = same & last[s].eqNullSafe(r[s])
        longer = F.struct((last["length"] + r["length"]).alias("length"), *[last[f].alias(f) for f in (*STYLE, "attachment_id", "type")])
        alone = F.struct(r["length"].alias("length"), *[r[f].alias(f) for f in (*STYLE, "attachment_id", "type")])
        return F.when(same & (F.size(done) > 0), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(alone)))

    shape = f"array<{_shape()}>"
    return F.aggregate(runs.cast(f"array<{RUN}>"), F.array().cast(shape), lambda a, r: step(a, r).cast(shape))


def _shape() -> str:
    return "struct<length:int,style_type:int,indent:int,done:int,weight:int,underlined:int,strike:int,link:string,attachment_id:string,type:string>"


def _is_list(r: Column) -> Column:
    return r["style_type"].isin(*LISTS)


def _pick(kind: Column, table: dict[int, tuple[str, str]], side: int) -> Column:
    out = F.when(kind == next(iter(table)), next(iter(table.values()))[side])
    for k, v in list(table.items())[1:]:
        out = out.when(kind == k, v[side])
    return F.coalesce(out, F.lit(""))


def list_step(stack: Column, r: Column) -> tuple[Column, Column, Column]:
    """(tags that close lists, tags that open lists, the new stack) before a run."""
    level, kind = F.coalesce(r["indent"], F.lit(0)), r["style_type"]
    stays = lambda e: _is_list(r) & ((e["indent"] < level) | (e["indent"] == level) & (e["type"] == kind))
    left = F.filter(stack, stays)
    closed = F.array_join(F.transform(F.reverse(F.filter(stack, lambda e: ~F.coalesce(stays(e), F.lit(False)))), lambda e: _pick(e["type"], LISTS, 1)), "")
    first = F.when(F.size(left) == 0, 0).otherwise(F.get(left, F.size(left) - 1)["indent"] + 1)
    levels = F.when(_is_list(r) & (first <= level), F.sequence(first, level)).otherwise(F.array().cast("array<int>"))
    opened = F.array_join(F.transform(levels, lambda _: _pick(kind, LISTS, 0)), "")
    pushed = F.transform(levels, lambda i: F.struct(kind.alias("type"), i.alias("indent")))
    return closed, opened, F.concat(left, pushed).cast(STACK)


def list_levels(notes: DataFrame) -> DataFrame:
    """(note_id, levels array<struct<depth, closes, opens>>): the stack's depth after each run and the tags before it."""
    shape = f"struct<stack:{STACK},out:array<struct<depth:int,closes:string,opens:string>>>"

    def step(a: Column, r: Column) -> Column:
        closed, opened, stack = list_step(a["stack"], r)
        return F.struct(stack.alias("stack"), F.concat(a["out"], F.array(F.struct(F.size(stack).alias("depth"), closed.alias("closes"), opened.alias("opens")))).alias("out")).cast(shape)

    start = F.struct(F.array().cast(STACK).alias("stack"), F.array().cast("array<struct<depth:int,closes:string,opens:string>>").alias("out"))
    return notes.select("note_id", F.aggregate(F.col("runs").cast(f"array<{RUN}>"), start.cast(shape), step, lambda a: a["out"]).alias("levels"))


def _attachment(r: Column) -> Column:
    """Marker of an attachment run; inline text has none here and comes with ``join_inline_text``."""
    ident, kind = S.html_escape(F.coalesce(r["attachment_id"], F.lit(""))), S.html_escape(F.coalesce(r["type"], F.lit("")))
    head = F.concat(F.lit('<span data-attachment-id="'), ident, F.lit('" data-attachment-type="'), kind, F.lit('">'))
    shown = (r["type"] == "com.apple.notes.table") | r["type"].rlike(r"^public\.(image|jpeg|png|heic)")
    return (
        F.when(r["type"].startswith(INLINE[:-1]), "").when(shown, F.concat(head, F.lit("&#xFFFC;</span>")))
        .otherwise(F.concat(head, F.lit("[File: "), kind, F.lit("]</span>")))
    )


def render(notes: DataFrame) -> DataFrame:
    """(note_id, html) of (note_id, text, runs). Null texts or runs give an empty page."""
    shape = f"struct<html:string,stack:{STACK},item:string,open:boolean,at:int>"

    def flush(html: Column, a: Column) -> Column:
        return F.when(a["open"] & (F.length(S.trimmed(a["item"])) > 2), F.concat(html, F.lit("<li>"), a["item"], F.lit("</li>"))).otherwise(html)

    def step(a: Column, r: Column) -> Column:
        piece = utf16_slice(F.col("text"), a["at"], r["length"])
        text = F.when(r["attachment_id"].isNotNull(), _attachment(r)).otherwise(S.html_escape(piece))
        tags = [(r["weight"].isin(1, 3), "<b>", "</b>"), (r["weight"].isin(2, 3), "<i>", "</i>"), (r["underlined"] != 0, "<u>", "</u>"), (r["strike"] != 0, "<s>", "</s>")]
        some = lambda ok, x: F.when(ok, x).otherwise("")
        linked = F.coalesce(r["link"], F.lit("")) != ""
        o = F.concat(*[some(F.coalesce(ok, F.lit(False)), F.lit(x)) for ok, x, _ in tags], some(linked, F.concat(F.lit("<a href='"), S.safe_href(r["link"]), F.lit("'>"))))
        e = F.concat(some(linked, F.lit("</a>")), *[some(F.coalesce(ok, F.lit(False)), F.lit(x)) for ok, _, x in reversed(tags)])
        closed, opened, stack = list_step(a["stack"], r)
        # A list item: every line feed ends one.
        parts = F.split(text, "\n")
        mark = F.when(r["style_type"] == 103, F.when(F.coalesce(r["done"], F.lit(0)) != 0, "☑ ").otherwise("☐ ")).otherwise("")
        styled = lambda p: F.when(p != "", F.concat(o, p, e)).otherwise("")
        begun = F.when(a["open"], a["item"]).otherwise(mark)
        lines = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p, i: F.concat(F.lit("<li>"), F.when(i == 0, begun).otherwise(mark), styled(p), F.lit("</li>")))
        last = F.get(parts, F.size(parts) - 1)
        ends = F.size(parts) > 1
        item = F.when(last != "", F.concat(F.when(ends, mark).otherwise(begun), styled(last))).otherwise(F.when(ends, "").otherwise(a["item"]))
        still = F.when(last != "", True).otherwise(F.when(ends, False).otherwise(a["open"]))
        moved = closed != ""
        in_list = F.struct(
            F.concat(F.when(moved, flush(a["html"], a)).otherwise(a["html"]), closed, opened, F.array_join(lines, "")).alias("html"), stack.alias("stack"), item.alias("item"), still.alias("open"),
            (a["at"] + r["length"]).alias("at"),
        )
        b0, b1 = _pick(r["style_type"], BLOCKS, 0), _pick(r["style_type"], BLOCKS, 1)
        plain = F.struct(
            F.concat(flush(a["html"], a), closed, b0, o, F.replace(text, F.lit("\n"), F.lit("<br>")), e, b1).alias("html"), stack.alias("stack"), F.lit("").alias("item"), F.lit(False).alias("open"),
            (a["at"] + r["length"]).alias("at"),
        )
        return F.when(F.coalesce(_is_list(r), F.lit(False)), in_list.cast(shape)).otherwise(plain.cast(shape))

    start = F.struct(F.lit("<html><body>").alias("html"), F.array().cast(STACK).alias("stack"), F.lit("").alias("item"), F.lit(False).alias("open"), F.lit(0).alias("at")).cast(shape)
    end = lambda a: F.concat(flush(a["html"], a), F.array_join(F.transform(F.reverse(a["stack"]), lambda x: _pick(x["type"], LISTS, 1)), ""), F.lit("</body></html>"))
    rows = notes.select("note_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(merged(F.col("runs")), F.array().cast(f"array<{_shape()}>")).alias("_m"))
    return rows.select("note_id", F.aggregate("_m", start, step, end).alias("html"))


def text_and_refs(notes: DataFrame) -> DataFrame:
    """(note_id, text without attachment marks, refs array<struct<pos, attachment_id, type>> in order)."""
    refs = F.filter("runs", lambda r: r["attachment_id"].isNotNull())
    out = F.transform(refs, lambda r, i: F.struct(i.alias("pos"), r["attachment_id"].alias("attachment_id"), r["type"].alias("type")))
    return notes.select("note_id", F.replace("text", F.lit("￼"), F.lit("")).alias("text"), out.alias("refs"))
