"""Spans of pattern matches in whole texts: SQL functions only, and steps in proportion to a text and its matches.

What is given and returned is the text of SQL expressions, for ``F.expr``: the lambdas of all rules would take seconds to
put together as columns. Offsets are code points, the end exclusive. Running sums and maxima over an array go by blocks of
``BLOCK`` elements: the blocks' totals first, then each block from where the one before it ends.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

BLOCK = 64
#: Code points in a piece of a text out of which parts are cut.
PIECE = 1024
SPANS = "array<struct<start:int,kind:int,`end`:int>>"
#: Spans with the match itself and what stands beside it.
SEEN = "array<struct<start:int,kind:int,`end`:int,hit:string,before:string,after:string>>"
#: An empty array of spans.
NO_SPANS = f"cast(array() AS {SPANS})"
_numbers = count()


def _names(n: int) -> list[str]:
    return [f"v{next(_numbers)}" for _ in range(n)]


def quoted(s: str) -> str:
    """A string as a SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, use: Callable[[str], str]) -> str:
    """``use(name)`` where the name stands for ``value``, worked out once, in lambdas too."""
    (v,) = _names(1)
    return f"get(transform(array({value}), {v} -> {use(v)}), 0)"


def blocked(xs: str) -> str:
    """An array cut into arrays of BLOCK elements; one empty array for an empty one."""
    (k,) = _names(1)
    return f"transform(sequence(0, cast((greatest(size({xs}), 1) - 1) div {BLOCK} AS int)), {k} -> slice({xs}, {k} * {BLOCK} + 1, {BLOCK}))"


def _running(blocks: str, total: Callable[[str], str], add: Callable[[str, str], str]) -> str:
    """What all blocks before each one come to, from 0."""
    a, n, b = _names(3)
    return f"slice(aggregate(transform({blocks}, {b} -> {total(b)}), array(0), ({a}, {n}) -> concat({a}, array({add(f'element_at({a}, -1)', n)}))), 1, size({blocks}))"


def hits(text: str, pattern: str, kind: int, ok: Callable[[str], str] = lambda m: "true", guard: str = "true", context: int = 0) -> str:
    """Spans of the leftmost non-overlapping matches for which ``ok(match)`` holds.

    ``guard`` is a cheap condition that a text with a match meets. With ``context``, spans have the match and so many
    characters beside it (up to the matches before and after).
    """
    pat, kind_of = quoted(pattern), SEEN if context else SPANS
    a, x, b, at, g, h, p, after, q = _names(9)
    beside = f", {p}.h AS hit, substring({p}.g, -{context}, {context}) AS before, substring({after}, 1, {context}) AS after" if context else ""
    own = f", {x}.hit AS hit, {x}.before AS before, {x}.after AS after" if context else ""

    def parts(gaps: str) -> str:
        both = f"zip_with(slice({gaps}, 1, size({gaps}) - 1), regexp_extract_all({text}, {pat}, 0), ({g}, {h}) -> struct({g} AS g, {h} AS h))"
        part = f"struct(length({p}.g) AS g, length({p}.h) AS h, coalesce({ok(f'{p}.h')}, false) AS ok{beside})"
        return f"zip_with({both}, slice({gaps}, 2, size({gaps})), ({p}, {after}) -> {part})"

    def of_blocks(blocks: str) -> str:
        starts = _running(blocks, lambda s: f"aggregate({s}, 0, ({a}, {x}) -> {a} + {x}.g + {x}.h)", lambda s, n: f"{s} + {n}")
        span = f"struct({a}.pos + {x}.g AS start, {kind} AS kind, {a}.pos + {x}.g + {x}.h AS `end`{own})"
        step = f"struct({a}.pos + {x}.g + {x}.h AS pos, if({x}.ok, concat({a}.found, array({span})), {a}.found) AS found)"
        fold = f"aggregate({b}, struct({at} AS pos, cast(array() AS {kind_of}) AS found), ({a}, {x}) -> {step}, {q} -> {q}.found)"
        return f"flatten(zip_with({blocks}, {starts}, ({b}, {at}) -> {fold}))"

    spans = let(f"split({text}, {pat}, -1)", lambda gaps: let(parts(gaps), lambda ps: let(blocked(ps), of_blocks)))
    return f"CASE WHEN {guard} AND {text} RLIKE {pat} THEN {spans} ELSE cast(array() AS {kind_of}) END"


def apart(xs: str, ys: str) -> str:
    """The spans of ``xs`` that touch none of ``ys`` (sorted by start). Those are looked through by the bounds of blocks,
    and of blocks of blocks, so that a span meets few of them."""
    b, q, x, t, u, y = _names(6)
    part = lambda field, least: f"array_{least}(transform({b}, {q} -> {q}.{field}))"
    level = lambda s: f"transform({blocked(s)}, {b} -> struct({part('start', 'min')} AS start, {part('`end`', 'max')} AS `end`, {b} AS inner))"
    meets = lambda o: f"{x}.start < {o}.`end` AND {o}.start < {x}.`end`"
    free = lambda tops: f"filter({xs}, {x} -> NOT exists({tops}, {t} -> {meets(t)} AND exists({t}.inner, {u} -> {meets(u)} AND exists({u}.inner, {y} -> {meets(y)}))))"
    return f"CASE WHEN size({xs}) = 0 OR size({ys}) = 0 THEN {xs} ELSE {let(ys, lambda s: let(level(s), lambda bs: let(level(bs), free)))} END"


def _cut(pieces: str, start: str, end: str) -> str:
    """Code points from ``start`` to ``end`` of a text that is given in pieces of PIECE ones."""
    count = f"cast(greatest({end} - 1, {start}) div {PIECE} - {start} div {PIECE} + 1 AS int)"
    return f"substring(array_join(slice({pieces}, cast({start} div {PIECE} AS int) + 1, {count}), ''), {start} % {PIECE} + 1, {end} - {start})"


def redacted(text: str, spans: str, mark: str) -> str:
    """The text with every span, or run of overlapping spans, replaced by ``mark``; ``spans`` sorted by start. A text
    without spans stays as it is."""
    a, s, b, at, q, g = _names(6)

    def gaps(blocks: str) -> str:
        before = _running(blocks, lambda o: f"coalesce(array_max(transform({o}, {s} -> {s}.`end`)), 0)", lambda o, n: f"greatest({o}, {n})")
        step = f"struct(greatest({a}.pos, {s}.`end`) AS pos, if({s}.start >= {a}.pos, concat({a}.found, array(struct({a}.pos AS a, {s}.start AS b))), {a}.found) AS found)"
        fold = f"aggregate({b}, struct({at} AS pos, cast(array() AS array<struct<a:int,b:int>>) AS found), ({a}, {s}) -> {step}, {q} -> {q}.found)"
        return f"flatten(zip_with({blocks}, {before}, ({b}, {at}) -> {fold}))"

    def joined(pieces: str) -> str:
        kept = f"transform({let(blocked(spans), gaps)}, {g} -> concat({_cut(pieces, f'{g}.a', f'{g}.b')}, {quoted(mark)}))"
        rest = let(f"array_max(transform({spans}, {s} -> {s}.`end`))", lambda last: _cut(pieces, last, f"length({text})"))
        return f"concat(array_join({kept}, ''), {rest})"

    done = let(f"regexp_extract_all({text}, {quoted(f'(?s).{{1,{PIECE}}}')}, 0)", joined)
    return f"CASE WHEN size({spans}) > 0 THEN {done} ELSE {text} END"


def joined(spans: str, kinds: tuple[str, ...], base: int | None = None) -> str:
    """``kind:start:end`` of each span, comma-joined; of the first ``base`` kinds only, if given."""
    (s,) = _names(1)
    names = f"array({', '.join(map(quoted, kinds))})"
    chosen = spans if base is None else f"filter({spans}, {s} -> {s}.kind < {base})"
    return f"array_join(transform({chosen}, {s} -> concat_ws(':', get({names}, {s}.kind), {s}.start, {s}.`end`)), ',')"
