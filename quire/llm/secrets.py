"""Secret scans by two character Markov models, beside fixed rules; SQL functions only.

A first-order model of random strings and one of ordinary identifiers are counted from labelled samples as pairs of
characters. A candidate token is a secret when the log-likelihood ratio of the two models is large, in all and for
each pair. The ratio of every pair of printable characters is one small table of fixed size, a literal in the plan.
Each text is scanned in its own row: nothing is shuffled, and only the model's samples are grouped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import spans as sp

VALUE = r"[A-Za-z0-9+/_.=-]+"
# The base rules, in the order of their kinds.
ASSIGN = rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?({VALUE})"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Shortest value of an assignment, access key and hex string; what is shorter is dropped.
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

#: Characters of a token, and of the parts between its separators; least length of either.
TOKEN, PART, SEPARATORS, MIN_TOKEN = r"[A-Za-z0-9+/_=-]", r"[A-Za-z0-9+]", "/_=-", 16
#: A token is random when its ratio is at least so large, in all and on average for each pair of characters (nats).
MIN_RATIO, MIN_MEAN_RATIO = 16.0, 1.25
#: Documents and generated strings from which the models are counted.
FIT_DOCS, FIT_RANDOM = 2_000, 4_000
FIRST, WIDTH = 33, 94  # printable ASCII without the space


def base_spans(text: str) -> str:
    """Spans of the three base rules, as SQL. Runs of the access and hex rules that are too short can't hold a long one, so
    their least lengths stand in the pattern; a short assignment uses up its text and is dropped afterwards."""
    assign = sp.hits(text, ASSIGN, 0, lambda m: f"length(regexp_extract({m}, {sp.quoted(ASSIGN)}, 1)) >= {MIN_ASSIGN}")
    access = sp.hits(text, rf"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}", 1, guard=f"contains({text}, 'AKIA')")
    return f"concat({assign}, {access}, {sp.hits(text, rf'[0-9a-f]{{{MIN_HEX},}}', 2)})"


def ratio(token: str, model: list[float]) -> str:
    """Log-likelihood ratio of random against ordinary over the token's pairs of characters, as SQL."""
    cells = f"cast(split('{','.join(f'{x:.4f}' for x in model)}', ',') AS array<double>)"  # folded to a literal
    code = lambda i: f"(ascii(substring({token}, {i}, 1)) - {FIRST})"
    return f"aggregate(sequence(1, length({token}) - 1), 0D, (a, i) -> a + coalesce(get({cells}, {code('i')} * {WIDTH} + {code('i + 1')}), 0D))"


def fit(samples: DataFrame, token_col: str = "token", label_col: str = "random") -> list[float]:
    """Ratio table from labelled tokens (label true: random). Null tokens and labels take no part.

    Pairs of characters are counted on the executors; at most 94 x 94 counts come back. Pairs with a separator tell
    nothing: paths have them as keys do.
    """
    t = F.col(token_col)
    pairs = (
        samples.where((F.length(t) > 1) & F.col(label_col).isNotNull())
        .select(F.col(label_col).cast("boolean").alias("y"), F.explode(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).alias("p"))
        .where(F.col("p").rlike("^[!-~]{2}$"))
        .groupBy("p").agg(F.count_if("y").alias("r"), F.count_if(~F.col("y")).alias("o"))
    )
    counts = {p: (r, o) for p, r, o in pairs.collect()}
    chars = [chr(FIRST + i) for i in range(WIDTH)]
    out = []
    for a in chars:
        rows = [counts.get(a + b, (0, 0)) for b in chars]
        nr, no = (sum(x[k] for x in rows) for k in (0, 1))
        logs = [math.log((r + 0.1) / (nr + 0.1 * WIDTH)) - math.log((o + 0.1) / (no + 0.1 * WIDTH)) for r, o in rows]
        out += [0.0 if a in SEPARATORS or b in SEPARATORS else x for b, x in zip(chars, logs, strict=True)]
    return out


def default_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, fit_random: int = FIT_RANDOM) -> DataFrame:
    """Labelled samples (token, random): hashed counters written in seven alphabets are random; tokens of at most
    ``fit_docs`` documents, first by a hash of their id, are ordinary unless a base rule holds for the text."""
    spark = docs.sparkSession
    h = F.sha2(F.col("id").cast("string"), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(h)), "=", "")
    plain = F.regexp_replace(mixed, "[+/]", "")
    letters = F.regexp_replace(plain, "[0-9]", "")
    kinds = (F.substring(h, 1, 40), F.upper(F.substring(h, 1, 40)), mixed, F.lower(plain), F.upper(plain), F.lower(letters), F.upper(letters))
    drawn = spark.range(0, fit_random, 1, 1).select(F.explode(F.array(*kinds)).alias("token"), F.lit(True).alias("random"))
    ids = docs.select(F.col(id_col).alias("_id")).where("_id is not null").orderBy(F.xxhash64("_id"), "_id").limit(fit_docs).distinct()
    text = F.col("_text")
    words = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .join(F.broadcast(ids), "_id")  # at most fit_docs numbers
        .where(~text.rlike(ASSIGN) & ~text.rlike(f"{ACCESS}|[0-9a-f]{{{MIN_HEX},}}"))
        .select(F.explode(F.regexp_extract_all(text, F.lit(f"{TOKEN}{{4,}}"), F.lit(0))).alias("token"), F.lit(False).alias("random"))
    )
    return drawn.unionByName(words)


def scan(df: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns of ``keep`` and ``spans``: array<struct<start, kind, end>> by start, then kind.

    ``kind`` is an index into ``KINDS``; offsets are code points, the end exclusive. The Markov models add tokens of
    at least ``MIN_TOKEN`` characters, with a letter, that no base span touches, and such parts of other tokens between
    ``/ _ = -``, so that an ordinary prefix does not hide a key. Null and empty texts have no spans; repeated rows stay;
    other columns are left behind.
    """
    keep = tuple(c for c in dict.fromkeys([id_col, *keep]) if c not in ("spans", "_text"))
    rows = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    ok = lambda m: f"{m} RLIKE '[A-Za-z]' AND {ratio(m, model)} >= greatest({MIN_RATIO}D, {MIN_MEAN_RATIO}D * (length({m}) - 1))"
    more = lambda piece: sp.hits("_text", f"{piece}{{{MIN_TOKEN},}}", 3, ok)

    def chosen(x: str) -> str:
        both = f"struct({sp.apart(f'{x}.more', f'{x}.base')} AS tokens, {sp.apart(f'{x}.parts', f'{x}.base')} AS parts)"
        return sp.let(both, lambda y: f"sort_array(concat({x}.base, {y}.tokens, {sp.apart(f'{y}.parts', f'{y}.tokens')}))")

    found = f"struct(sort_array({base_spans('_text')}) AS base, {more(TOKEN)} AS more, {more(PART)} AS parts)"
    return rows.select(*keep, F.expr(sp.let(found, chosen)).alias("spans"))


def joined(spans: str = "spans", base_only: bool = False) -> Column:
    """``kind:start:end`` of each span of a column, comma-joined."""
    return F.expr(sp.joined(spans, KINDS, 3 if base_only else None))


def redacted(text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mark``; a text without spans as it is."""
    return F.expr(sp.redacted(text, spans, mark))
