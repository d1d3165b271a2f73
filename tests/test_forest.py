"""Trees of any shape against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import forest

SCHEMA = "folder_id long, parent_id long, name string"


def shapes():
    rng = random.Random(8)
    yield "random", [(i, rng.choice([None, *range(1, i)]) if i > 1 else None) for i in range(1, 40)]
    yield "chain of 70", [(i, i + 1 if i < 70 else None) for i in range(1, 71)]
    yield "cycles and strays", [(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 6), (7, 99), (8, 7), (9, None), (10, 6), (None, 1), (11, 9)]
    yield "empty", []


def plain(links):
    known = {i for i, _ in links if i is not None}
    parent = {i: p if p in known else None for i, p in links if i is not None}
    on = {}
    for i in parent:
        seen, at = [], i
        while at is not None and at not in seen:
            seen.append(at)
            at = parent[at]
        if at == i:
            on[i] = min(seen)
    reach = lambda i: {j for j in parent if i in walk(j, parent)}
    cut = {i: None if on.get(i) == i else p for i, p in parent.items()}
    return cut, on, reach


def walk(i, parent):
    seen = []
    while i is not None and i not in seen:
        seen.append(i)
        i = parent[i]
    return seen


@pytest.mark.parametrize(("name", "links"), list(shapes()))
def test_totals_and_tour(spark, name, links):
    cut, on, reach = plain(links)
    df = spark.createDataFrame([(i, p, "x") for i, p in links], SCHEMA)
    known = forest.rooted(df)
    assert {r.folder_id: (r.parent_id, r.cycle) for r in known.collect()} == {i: (p, on.get(i)) for i, p in cut.items()}
    rng = random.Random(1)
    notes = [(rng.choice([i for i, _ in links] or [None]), v) for v in range(200)] if links else []
    values = spark.createDataFrame(notes, "folder_id long, v long")
    got = forest.totals(df, values, {"n": forest.Carried(F.lit(1)), "top": forest.Carried(F.col("v"), "max"), "low": forest.Carried(F.col("v"), "min")}, known)
    for r in got.collect():
        below = [v for f, v in notes if f in reach(r.folder_id)]
        assert (r.n, r.top, r.low) == (len(below), max(below, default=None), min(below, default=None)), (name, r)
    # The tour of the forest that is left when cycles are cut.
    children = {}
    for i in sorted(cut):
        children.setdefault(cut[i], []).append(i)
    want, stack, order = {}, [(i, 0) for i in reversed(children.get(None, []))], []
    while stack:
        i, depth = stack.pop()
        want[i] = [cut[i], depth, len(order)]
        order.append(i)
        stack += [(c, depth + 1) for c in reversed(children.get(i, []))]
    inside = lambda i: {j for j in cut if i in walk(j, cut)}
    for hot in [name == "random"]:
        places = forest.tour(df, known, hot)
        assert {r.folder_id: (r.parent_id, r.depth, r.pre, r.last) for r in places.collect()} == {i: (*w, w[2] + len(inside(i)) - 1) for i, w in want.items()}
        chosen = rng.sample(sorted(cut), min(3, len(cut)))
        picked = spark.createDataFrame([(c,) for c in [*chosen, *chosen, -1]], "folder_id long")
        assert sorted(r.folder_id for r in forest.subtrees(places, picked, hot).collect()) == sorted(set().union(*map(inside, chosen)) if chosen else [])
