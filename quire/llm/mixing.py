"""Mixing sources to target weights by iterative proportional fitting; SQL functions only.

Documents are counted into cells of source, language and topic. The cells' token weights are raked: scaled in turn so
that each of the three marginals meets its target, never beyond what a cell can give. A document is then drawn with a
probability that is its cell's raked weight over its cell's tokens, such that the expected tokens meet a budget. Only
cells are iterated over, by sums over the cells of each value; documents are read twice, once counted and once drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize

DIMS = ("source", "lang", "topic")
#: Rounds over the three marginals at most, rounds between two looks at how far the marginals are off, and when to stop.
ROUNDS, LOOK, CLOSE = 12, 4, 1e-11
#: Cells to a task: fewer are not dealt out by their values, which would be a shuffle for each marginal.
CELLS_PER_TASK = 100_000
#: Topics of texts with long words; letters of a long word; rounds that spread what full cells leave of the budget.
TOPICS, LETTERS, SPREAD = 8, 7, 3
Targets = dict[str, dict]
#: Shares of tokens by value. What the values named leave is dealt equally to the others.
TARGETS: Targets = {"source": {"src0": 0.25}, "lang": {"en": 0.48, "fr": 0.19, "de": 0.18, "es": 0.15}, "topic": {}}


def tokens(text: Column) -> Column:
    """Token estimate of a text: a token for every four bytes begun; null counts as empty."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("double")


def word_topics(text: Column) -> Column:
    """A digit for each long word of a text: the topic that a hash deals it to."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\p{{L}}{{{LETTERS},}}"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.translate(F.substring(F.md5(F.lower(w)), 1, 1), "89abcdef", "01234567")), "")


def topic(own: Column) -> Column:
    """Stand-in for a topic model: of all ``word_topics`` of a text the commonest, the smaller of equal ones; TOPICS for a
    text without long words. ``own`` should be a column, as it is read for every topic."""
    counts = F.array(*[F.length(own) - F.length(F.replace(own, F.lit(str(t)), F.lit(""))) for t in range(TOPICS)])
    return F.when(own == "", TOPICS).otherwise(F.array_position(counts, F.array_max(counts)) - 1).cast("int")


def draw(key: Column) -> Column:
    """A number of 0 to 1 that depends on the key alone."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def cell_table(docs: DataFrame, tok: str = "tok", dims: tuple[str, ...] = DIMS) -> DataFrame:
    """One row for each combination of ``dims`` with its tokens."""
    return materialize(docs.groupBy(*dims).agg(F.sum(tok).alias("tok")), "cells")


def _target(cells: DataFrame, dim: str, shares: dict) -> Column:
    """Target share of a cell's value. Values without tokens in the data have none; the rest is scaled to a sum of 1."""
    if any(x < 0 for x in shares.values()) or sum(shares.values()) > 1 + 1e-9:
        raise ValueError(f"the target shares of {dim} must be 0 or more and at most 1 in all")
    value = F.col(dim)
    named = F.lit(None).cast("double")
    for v, x in shares.items():
        named = F.when(value.eqNullSafe(F.lit(v)), float(x)).otherwise(named)
    values = cells.where("tok > 0").groupBy(dim).agg(F.count("*").alias("n")).select(named.alias("x"))
    have, others = values.agg(F.coalesce(F.sum("x"), F.lit(0.0)), F.count_if(F.col("x").isNull())).first()
    rest = max(0.0, 1 - sum(shares.values())) if others else 0.0
    whole = have + rest or 1.0
    return F.coalesce(named, F.lit(rest / others if others else 0.0)) / whole


def rake(cells: DataFrame, targets: Targets, keep_share: float = 0.0, dims: tuple[str, ...] = DIMS, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (dims, tok) with ``w``: weights of sum 1 whose marginals meet the targets, and ``t_<dim>``.

    No weight is more than its cell's tokens are of ``keep_share`` of all; where that keeps targets out of reach, the
    weights sum to less than 1. A cell without tokens weighs nothing. Null is a value like any other. Rounds end when no
    marginal is off by more than CLOSE, or after ``rounds``.
    """
    total, n = cells.agg(F.sum("tok"), F.count("*")).first()
    total, parts = total or 1.0, max(1, -(-n // CELLS_PER_TASK))
    cells = cells.coalesce(parts).select("*", *[_target(cells, d, targets.get(d, {})).alias(f"t_{d}") for d in dims], (F.col("tok") / total).alias("w"))
    cap = F.col("tok") / (keep_share * total) if keep_share else F.lit(float("inf"))
    for k in range(1, rounds + 1):
        for d in dims:
            have = F.sum("w").over(Window.partitionBy(d))
            cells = cells.withColumn("w", F.when(have > 0, F.least(F.col("w") * F.col(f"t_{d}") / have, cap)).otherwise(0.0))
        if k % LOOK == 0 or k == rounds:
            cells = materialize(cells, "cells").coalesce(parts)
            if deviation(cells, dims) <= CLOSE:
                break
    return cells


def deviation(cells: DataFrame, dims: tuple[str, ...] = DIMS) -> float:
    """How far the marginal that is farthest off is from its target."""
    off = [cells.groupBy(d).agg(F.abs(F.sum("w") - F.max(f"t_{d}")).alias("off")).select("off") for d in dims]
    out = off[0]
    for x in off[1:]:
        out = out.unionByName(x)
    return out.agg(F.max("off")).first()[0] or 0.0


def calibrate(cells: DataFrame, keep_share: float, spread: int = SPREAD) -> DataFrame:
    """Add ``p``, at most 1: the chance of each token of a cell, such that ``keep_share`` of all tokens is expected.

    What raking left of the budget, because cells are full, is spread over the others ``spread`` times.
    """
    want = keep_share * (cells.agg(F.sum("tok")).first()[0] or 0.0)
    cells = cells.withColumn("p", F.when(F.col("tok") > 0, F.least(F.col("w") * want / F.col("tok"), F.lit(1.0))).otherwise(1.0))
    for _ in range(spread):
        open_ = F.col("p") < 1
        full, rest = cells.agg(F.sum(F.when(~open_, F.col("tok")).otherwise(0.0)), F.sum(F.when(open_, F.col("tok") * F.col("p")).otherwise(0.0))).first()
        factor = max(1.0, (want - full) / rest) if rest else 1.0
        cells = cells.withColumn("p", F.least(F.col("p") * factor, F.lit(1.0)))
    return cells


def sample(
    docs: DataFrame, targets: Targets = TARGETS, keep_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Every document with ``source``, ``lang``, ``topic``, ``tok``, ``p`` (its probability), ``weight`` (tokens that
    one of its tokens stands for, 1/p) and ``kept`` (whether the draw of its id falls below p).

    ``docs`` needs ``source`` and ``lang``; null ones are cells of their own. Empty documents have no tokens, and no
    part in the targets: they keep their cell's p, 1 where the cell has no tokens. Repeated ids are drawn alike.
    """
    keep = tuple(c for c in dict.fromkeys([id_col, *keep]) if c not in (*DIMS, "tok", "p", "weight", "kept", "_own"))
    text = F.col(text_col)
    rows = docs.select(*keep, "source", "lang", word_topics(text).alias("_own"), tokens(text).alias("tok"))
    rows = rows.select(*keep, "source", "lang", topic(F.col("_own")).alias("topic"), "tok")
    cells = calibrate(rake(cell_table(rows), targets, keep_share), keep_share)
    cells = materialize(cells.select(*[F.col(d).alias(f"_{d}") for d in DIMS], "p"), "rates")
    same = [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in DIMS]
    out = rows.join(cells, same, "left").drop(*[f"_{d}" for d in DIMS])
    return out.withColumn("weight", F.when(F.col("p") > 0, 1 / F.col("p"))).withColumn("kept", draw(F.col(id_col)) < F.col("p"))


def oracle(targets: Targets = TARGETS, keep_share: float = 0.5, rounds: int = ROUNDS, spread: int = SPREAD, digits: int = 6) -> str:
    """The same as DuckDB SQL over ``documents``: one CTE for each step."""
    dims = ", ".join(DIMS)
    long = f"regexp_extract_all(coalesce(text, ''), '\\p{{L}}{{{LETTERS},}}')"
    own = f"array_to_string(list_transform({long}, lambda w: substr('0123456701234567', strpos('0123456789abcdef', substr(md5(lower(w)), 1, 1)), 1)), '')"
    counts = "[" + ", ".join(f"length(o) - length(replace(o, '{t}', ''))" for t in range(TOPICS)) + "]"
    ctes = [
        f"""rows AS (SELECT doc_id, source, lang, CASE WHEN o = '' THEN {TOPICS} ELSE list_position({counts}, list_max({counts})) - 1 END AS topic,
  ceil(coalesce(octet_length(encode(text)), 0) / 4) AS tok FROM (SELECT *, {own} AS o FROM documents))""",
        f"c AS (SELECT {dims}, sum(tok) AS tok FROM rows GROUP BY ALL)",
    ]
    for d in DIMS:
        shares = targets.get(d, {})
        named = "CASE" + "".join(f" WHEN {d} = {v!r} THEN {x}" for v, x in shares.items()) + " END" if shares else "CAST(NULL AS DOUBLE)"
        rest = max(0.0, 1 - sum(shares.values()))
        ctes.append(f"v_{d} AS (SELECT {d}, {named} AS x FROM c WHERE tok > 0 GROUP BY {d})")
        ctes.append(f"n_{d} AS (SELECT coalesce(sum(x), 0) AS have, count(*) FILTER (x IS NULL) AS others FROM v_{d})")
        ctes.append(f"t_{d} AS (SELECT {d}, coalesce({named}, {rest} / nullif(others, 0), 0) / (have + CASE WHEN others > 0 THEN {rest} ELSE 0 END) AS t FROM (SELECT DISTINCT {d} FROM c), n_{d})")
    ctes.append(f"r0 AS (SELECT *, tok / sum(tok) OVER () AS w, tok / ({keep_share} * sum(tok) OVER ()) AS cap FROM c)")
    n = 0
    for _ in range(rounds):
        for d in DIMS:
            ctes.append(
                f"r{n + 1} AS MATERIALIZED (SELECT r.source, r.lang, r.topic, r.tok, CASE WHEN sum(w) OVER (PARTITION BY r.{d}) > 0 THEN least(w * t / sum(w) OVER (PARTITION BY r.{d}), cap) ELSE 0 END AS w, cap"
                f" FROM r{n} r JOIN t_{d} x ON r.{d} IS NOT DISTINCT FROM x.{d})"
            )
            n += 1
    ctes.append(f"p0 AS (SELECT *, {keep_share} * sum(tok) OVER () AS want, CASE WHEN tok > 0 THEN least(w * {keep_share} * sum(tok) OVER () / tok, 1) ELSE 1 END AS p FROM r{n})")
    for k in range(spread):
        ctes.append(
            f"p{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tok, w, want, least(1, p * CASE WHEN sum(CASE WHEN p < 1 THEN tok * p ELSE 0 END) OVER () > 0 THEN greatest(1,"
            f" (want - sum(CASE WHEN p >= 1 THEN tok ELSE 0 END) OVER ()) / sum(CASE WHEN p < 1 THEN tok * p ELSE 0 END) OVER ()) ELSE 1 END) AS p FROM p{k})"
        )
    same = " AND ".join(f"d.{d} IS NOT DISTINCT FROM p.{d}" for d in DIMS)
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, d.source, d.lang, d.topic, CAST(d.tok AS BIGINT) AS tok, round(p.p, {digits}) AS p,
  CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < p.p AS kept
FROM rows d JOIN p{spread} p ON {same}"""
