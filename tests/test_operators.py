"""Operators on small hand-written tables, and invariants."""

import datetime
import hashlib
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quire import plans, registry  # noqa: F401  plans fill the registry
from quire.operators import filters, hierarchy, links, paths, richtext, sync, tables
from quire.sources import sinks, stored, stores
from quire.streaming import feed

T0 = datetime.datetime(2024, 1, 1)


def test_cyclic_folders_end(spark):
    rows = [(1, "A", 2, 1), (2, "B", 1, 1), (3, "C", None, 1), (4, "D/x", 3, 1)]
    f = spark.createDataFrame(rows, "folder_id long, name string, parent_id long, account_id long")
    assert {r.folder_id: r.path for r in hierarchy.paths(f).collect()} == {1: "A", 2: "B", 3: "C", 4: "C/D_x"}
    assert hierarchy.closure(f).where("ancestor_id = 1").count() == 2
    assert {r.folder_id for r in hierarchy.roots(f, shared_keys=True).collect()} == {2, 3}


def test_namesakes_merge(spark):
    f = spark.createDataFrame([(1, "A", None, 1), (2, "A", None, 1), (3, "x", 1, 1), (4, "x", 2, 1), (5, "a", None, 1)], "folder_id long, name string, parent_id long, account_id long")
    notes = spark.createDataFrame([(10, 3), (11, 4), (12, 4)], "note_id long, folder_id long")
    got = {r.path: (r.folder_id, r.merged, r.notes) for r in hierarchy.merge_namesakes(f, notes).collect()}
    assert got == {"A": (1, 2, 0), "A/x": (3, 2, 3), "a": (5, 1, 0)}


def test_paths_are_unique(spark):
    rows = [(i, "f", b, T0 + datetime.timedelta(i)) for i, b in enumerate(["A", "A", "A (2)", "A", "B"])]
    got = paths.allocate(spark.createDataFrame(rows, "note_id long, folder_path string, base string, created timestamp_ntz")).collect()
    # The real title keeps its name; numbers go round it.
    assert {r.note_id: r.filename for r in got} == {0: "A.md", 1: "A (3).md", 2: "A (2).md", 3: "A (4).md", 4: "B.md"}
    assert len({r.rel_path for r in got}) == 5
    five = [(5, "F", "A", T0), (7, "F", "A", T0), (8, "F", "A (2)", T0), (9, "F", "A_7", T0)]
    got = paths.allocate(spark.createDataFrame(five, "note_id long, folder_path string, base string, created timestamp_ntz")).collect()
    assert {r.note_id: r.rel_path for r in got} == {5: "F/A.md", 7: "F/A (3).md", 8: "F/A (2).md", 9: "F/A_7.md"}


def plain_paths(rows, reserved, ext="md"):
    """First free numbers one by one, names that stand for themselves first."""
    given = {}
    for i, p in sorted(reserved):
        given.setdefault(p, i)
    mine = {}
    for p, i in sorted(given.items()):
        mine.setdefault(i, p)
    out, used, rest = {}, set(given), []
    for key in sorted(range(len(rows)), key=lambda k: (rows[k][3], rows[k][0])):
        if rows[key][0] in mine:
            out[key] = mine.pop(rows[key][0])
        else:
            rest.append(key)
    full = lambda k, name: f"{rows[k][1]}/{name}" if rows[k][1] else name
    later = []
    for k in rest:
        p = full(k, f"{rows[k][2]}.{ext}")
        if p in used:
            later.append(k)
        else:
            out[k] = p
            used.add(p)
    for k in later:
        n = 2
        while full(k, f"{rows[k][2]} ({n}).{ext}") in used:
            n += 1
        out[k] = full(k, f"{rows[k][2]} ({n}).{ext}")
        used.add(out[k])
    return sorted(out.values())


@pytest.mark.parametrize("hot", [False, True])
def test_paths_are_the_first_free_ones_on_any_names(spark, hot):
    rng = random.Random(2)
    names = ["A", "A (2)", "A (3)", "A (2) (2)", "A (02)", "A (1)", "A (12)", "B_7", "", "x/y"[0], "A (5)", "A (2) (3)", "é"]
    rows = [(i, rng.choice(["f", "f", "f", "g/h", ""]), rng.choice(names), T0 + datetime.timedelta(rng.randint(0, 5))) for i in range(700)]
    reserved = [(i, f"f/{rng.choice(names)}.md") for i in range(0, 60, 2)] + [(5000 + i, f"{rng.choice(['f/', 'g/h/', ''])}A ({i}).md") for i in range(2, 40, 3)] + [(7000, "f/A.txt")]
    schema = "note_id long, folder_path string, base string, created timestamp_ntz"
    df = spark.createDataFrame(rows, schema).repartition(3)
    res = spark.createDataFrame(reserved, "note_id long, path string")
    got = [r.rel_path for r in paths.allocate(df, reserved=res, hot=hot).collect()]
    assert len(set(got)) == 700 and sorted(got) == plain_paths(rows, reserved)
    assert sorted(r.rel_path for r in paths.allocate(df, hot=hot).collect()) == plain_paths(rows, [])


def test_paths_of_odd_rows(spark):
    schema = "note_id long, folder_path string, base string, created timestamp_ntz, filename string"
    rows = [(1, None, None, None, "x"), (1, None, None, None, "x"), (None, "", "", T0, "x"), (2, "a", "n", T0, "x"), (2, "a", "n", T0, "x")]
    got = sorted(r.rel_path for r in paths.allocate(spark.createDataFrame(rows, schema), date_prefix="yyyy").collect())
    assert got == sorted([".md", " (2).md", "2024 .md", "a/2024 n.md", "a/2024 n (2).md"])
    assert paths.allocate(spark.createDataFrame([], schema), reserved=spark.createDataFrame([], "note_id long, path string")).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_runs_of_one_note_in_many_splits(spark, hot):
    rng = random.Random(3)
    runs = [(n, i, rng.choice(["a", "a", "b", None]), rng.choice([None, None, None, "att"]), rng.randint(0, 5)) for n, size in ((1, 600), (2, 1), (None, 30), (3, 90)) for i in range(size)]
    df = spark.createDataFrame(runs, "note_id long, seq long, style string, attachment string, length long").repartition(5)
    want = []
    for n, i, s, a, size in runs:
        last = want[-1] if want else None
        if last and last[0] == n and last[2] == s and a is None and last[5] is None:
            want[-1] = (*last[:3], last[3] + size, last[4] + 1, a)
        else:
            want.append((n, i, s, size, 1, a))
    merged = paths.merge_runs(df, attachment="attachment", hot=hot)
    assert sorted(map(tuple, merged.select("note_id", "seq", "style", "length", "merged").collect()), key=str) == sorted((w[:5] for w in want), key=str)
    at, offsets = {}, []
    for n, i, _, size, _, _ in want:
        offsets.append((n, i, at.get(n, 0), at.get(n, 0) + size))
        at[n] = at.get(n, 0) + size
    got = paths.run_offsets(merged, hot=hot).select("note_id", "seq", "start", "end")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(offsets, key=str)


def test_sync_twice_is_a_noop(spark):
    n = spark.createDataFrame([(1, T0), (2, T0 + datetime.timedelta(1)), (3, T0)], "note_id long, modified timestamp_ntz")
    m = spark.createDataFrame([(2, T0, "old/2.md"), (3, T0, "old/3.md"), (9, T0, "old/9.md")], "note_id long, modified timestamp_ntz, path string")
    a = n.select("note_id", F.concat(F.lit("new/"), F.col("note_id").cast("string")).alias("path"))
    plan = {r.note_id: r.status for r in sync.plan(n, m).collect()}
    assert plan == {1: "new", 2: "changed", 3: "unchanged", 9: "deleted"}
    once = sync.apply(n, m, a)
    assert {r.note_id: r.path for r in once.collect()} == {1: "new/1", 2: "old/2.md", 3: "old/3.md"}
    assert {r.status for r in sync.plan(n, once).collect()} == {"unchanged"}
    assert sorted(map(tuple, sync.apply(n, once, a).collect())) == sorted(map(tuple, once.select("note_id", "modified", "path").collect()))


def test_delete_list(spark):
    gone = spark.createDataFrame([("a/b/x.md",), ("a/c/y.md",)], "path string")
    left = spark.createDataFrame([("a/c/z.md",)], "path string")
    assert {(r.path, r.kind) for r in sync.delete_list(gone, left).collect()} == {("a/b/x.md", "file"), ("a/c/y.md", "file"), ("a/b", "directory")}


def test_runs_keep_their_length(spark):
    runs = spark.createDataFrame([(1, i, s, n) for i, (s, n) in enumerate([("a", 2), ("a", 3), ("b", 1), ("a", 4)])], "note_id long, seq long, style string, length long")
    merged = paths.run_offsets(paths.merge_runs(runs)).orderBy("seq").collect()
    assert [(r.style, r.length, r.start, r.end) for r in merged] == [("a", 5, 0, 5), ("b", 1, 5, 6), ("a", 4, 6, 10)]


RUN = "length int, style_type int, indent int, done int, weight int, underlined int, strike int, link string, attachment_id string, type string"


def rendered(spark, text, runs):
    full = [tuple(r.get(k) for k in ("length", "style_type", "indent", "done", "weight", "underlined", "strike", "link", "attachment_id", "type")) for r in runs]
    df = spark.createDataFrame([(1, text, full)], f"note_id long, text string, runs array<struct<{RUN.replace(' ', ':').replace(',:', ',')}>>")
    return richtext.render(df).first().html


def test_render_runs(spark):
    page = lambda x: f"<html><body>{x}</body></html>"
    assert rendered(spark, "Head\nplain <b>", [{"length": 5, "style_type": 0}, {"length": 9, "style_type": -1}]) == page("<h1>Head<br></h1>plain &lt;b&gt;")
    assert rendered(spark, "a\nb\nc\n", [{"length": 2, "style_type": 100, "indent": 0}, {"length": 2, "style_type": 100, "indent": 1}, {"length": 2, "style_type": 102, "indent": 0}]) == page(
        "<ul><li>a</li><ul><li>b</li></ul></ul><ol><li>c</li></ol>"
    )
    assert rendered(spark, "x\ny\n", [{"length": 2, "style_type": 103, "done": 1, "indent": 0}, {"length": 2, "style_type": 103, "done": 0, "indent": 0}]) == page(
        "<ul style='list-style-type: none;'><li>☑ x</li><li>☐ y</li></ul>"
    )
    # Offsets count UTF-16 units; equal neighbours are one run.
    assert rendered(spark, "😀ab", [{"length": 2}, {"length": 1, "weight": 1}, {"length": 1, "weight": 1}]) == page("😀<b>ab</b>")
    assert rendered(spark, "ab", [{"length": 1, "link": "javascript:x"}, {"length": 1, "link": "https://a", "weight": 3, "strike": 1}]) == page("<a href='#'>a</a><b><i><s><a href='https://a'>b</a></s></i></b>")
    mark = rendered(spark, "￼", [{"length": 1, "attachment_id": "i<", "type": "public.jpeg"}])
    assert mark == page('<span data-attachment-id="i&lt;" data-attachment-type="public.jpeg">&#xFFFC;</span>')
    assert rendered(spark, None, []) == page("")


def test_rewrite_links(spark):
    rows = [
        (1, "acc/Notes/A.md", "<a href='applenotes:note/AAAAAAAA-1?x=1'>x</a> and applenotes:note/bbbbbbbb-2"), (2, "acc/Notes/B.md", "applenotes:note/CCCCCCCC-3"),
        (3, "acc/Notes/C.md", "none"), (4, "acc/Notes/D.md", None),
    ]
    notes = spark.createDataFrame(rows, "note_id long, path string, html string")
    known = spark.createDataFrame([("aaaaaaaa-1", "acc/Other/X y.md"), ("BBBBBBBB-2", "acc/Notes/B.md")], "key string, path string")
    got = {r.note_id: r.html for r in links.rewrite(notes, known).collect()}
    assert got == {1: "<a href='../Other/X%20y.md'>x</a> and B.md", 2: "applenotes:note/CCCCCCCC-3", 3: "none", 4: None}
    again = spark.createDataFrame([(k, "acc/Notes/A.md", v) for k, v in got.items()], "note_id long, path string, html string")
    assert {r.note_id: r.html for r in links.rewrite(again, known).collect()} == got


def test_tables_from_objects(spark):
    rows = [
        (1, "row", "r1", None, None, 0), (1, "row", "r2", None, None, 1), (1, "column", "c2", None, None, 0), (1, "column", "c1", None, None, 1), (1, "remap", "r9", None, "r2", None),
        (1, "cell", "c1", "r1", "a", None), (1, "cell", "c2", "r9", "b|<", None),
    ]
    g = tables.from_objects(spark.createDataFrame(rows, "table_id long, kind string, key string, row string, value string, ord int"))
    r = g.select("grid", tables.to_text("grid").alias("t"), tables.to_html("grid").alias("h"), tables.to_markdown("grid").alias("m")).first()
    assert r.grid == [["", "a"], ["b|<", ""]] and r.t == "\ta\nb|<\t"
    assert r.h == "<table><tr><td></td><td>a</td></tr><tr><td>b|&lt;</td><td></td></tr></table>"
    assert r.m == "|  | a |\n| --- | --- |\n| b\\|< |  |"


def test_layouts(spark):
    df = lambda cols: spark.createDataFrame([], ", ".join(f"{c} string" for c in cols.split()))
    assert stores.detect_layout({"note": df("z_pk")}) == "legacy"
    base = {"bodies": df("zdata")}
    assert stores.detect_layout(base | {"objects": df("z_pk ZACCOUNT6 zaccount5")}) == "v16"
    assert stores.detect_layout(base | {"objects": df("z_pk"), "folder_bridge": df("note")}) == "v11"
    assert stores.detect_layout(base | {"objects": df("z_pk")}) == "unknown"
    rows = spark.createDataFrame([(1, "a", None), (2, None, None)], "z_pk long, ztitle1 string, ztitle2 string")
    assert stores.resolve_by_data(rows) == "ztitle1"


def test_stream_equals_batch_and_repeats_change_nothing(spark, tmp_path):
    t = lambda n: T0 + datetime.timedelta(minutes=n)
    schema = "event_id long, note_id long, modified timestamp_ntz, tombstone boolean"
    batches = [[(1, 1, t(1), False), (2, 2, t(2), False)], [(3, 1, t(3), True), (4, 2, t(1), False)], [(5, 3, t(5), False), (6, 1, t(2), False)]]
    step = feed.upsert_batch(f"file://{tmp_path}/state")
    for n, rows in enumerate(batches):
        step(spark.createDataFrame(rows, schema), n)
        step(spark.createDataFrame(rows, schema), n)
    got = sorted((r.note_id, r.modified) for r in feed.live(feed.state(spark, f"file://{tmp_path}/state")).collect())
    assert got == [(2, t(2)), (3, t(5))]


def test_parts_that_no_index_names_go(spark, tmp_path):
    schema = "event_id long, note_id long, modified timestamp_ntz, tombstone boolean"
    path = f"file://{tmp_path}/state"
    for n in range(6):
        feed.upsert_batch(path)(spark.createDataFrame([(n, 1, T0 + datetime.timedelta(n), False)], schema), n)
    assert feed.live(feed.state(spark, path)).collect()[0].modified == T0 + datetime.timedelta(5)
    assert len(list((tmp_path / "state" / "parts").glob("batch=*"))) == 2  # as many as there are indexes


def test_keyed_state_equals_batch_after_disorder_repeats_and_restarts(spark, tmp_path):
    rng = random.Random(5)
    schema = "event_id long, note_id long, modified timestamp_ntz, tombstone boolean"
    events = [(i, rng.choice([1, 1, 1, 2, 3, 40, 41, None]), rng.choice([None, *[T0 + datetime.timedelta(minutes=m) for m in range(30)]]), rng.choice([True, False, False, None])) for i in range(300)]
    events += rng.sample(events, 60)
    rng.shuffle(events)
    src, checkpoint = f"file://{tmp_path}/in", f"file://{tmp_path}/checkpoint"
    assert feed.followed(spark, checkpoint).count() == 0
    for part in (events[:200], events[200:]):  # the second call goes on from the first's checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        feed.follow(changes, checkpoint).awaitTermination()
    best = {}
    for e, n, m, gone in events:
        if n is not None:
            best[n] = max(best.get(n, ()), (m is not None, m or T0, e, bool(gone)))
    want = sorted((n, m if known else None, e, gone) for n, (known, m, e, gone) in best.items())
    assert sorted(map(tuple, feed.followed(spark, checkpoint).select("note_id", "modified", "event_id", "tombstone").collect())) == want
    assert "spark.sql.streaming.noDataMicroBatches.enabled" not in {k for k, v in spark.conf.getAll.items() if v == "false"}


def test_two_writers_of_a_manifest(spark, tmp_path):
    path, schema = f"file://{tmp_path}/m", "note_id long, path string"
    row = lambda i: spark.createDataFrame([(i, f"p{i}")], schema)
    assert sinks.write_manifest(row(0), path) == 1
    # Both start from version 1; the one that comes second is told so, and leaves no files.
    assert sinks.write_manifest(sinks.read_manifest(spark, path, schema, 1).unionByName(row(1)), path, base=1) == 2
    with pytest.raises(sinks.Conflict):
        sinks.write_manifest(sinks.read_manifest(spark, path, schema, 1).unionByName(row(2)), path, base=1)
    assert len(list((tmp_path / "m").glob("data-*"))) == 2
    with ThreadPoolExecutor(4) as pool:  # upserts at the same time all survive
        made = list(pool.map(lambda i: sinks.update_manifest(spark, path, schema, lambda s: s.unionByName(row(i))), range(10, 14)))
    assert sorted(made) == [3, 4, 5, 6]
    assert sorted(r.note_id for r in sinks.read_manifest(spark, path, schema).collect()) == [0, 1, 10, 11, 12, 13]
    # A write that broke off is never read, and goes later.
    row(99).write.parquet(f"{path}/data-broken")
    assert sinks.read_manifest(spark, path, schema).where("note_id = 99").count() == 0
    assert sinks.vacuum(spark, path) == 0 and sinks.vacuum(spark, path, 0) == 1
    assert sinks.versions(spark, path) == [5, 6] and sinks.read_manifest(spark, path, schema).count() == 6


def test_manifest_switches_versions(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    schema = "note_id long, modified timestamp_ntz, path string"
    assert stores.manifest(spark, path).count() == 0
    for n in (1, 2, 3):
        sinks.write_manifest(spark.createDataFrame([(n, T0, "p")], schema), path)
    assert [r.note_id for r in stores.manifest(spark, path).collect()] == [3]


def test_concatenated_texts_are_never_one_row(spark, capsys, monkeypatch):
    rows = [("A", f"F{i % 3}", None if i % 7 == 3 else f"p{i * 37 % 101:03}", None if i % 5 == 4 else f"té{i}" * (i % 4)) for i in range(100)] + [(None, None, "p", "x")]
    notes = spark.createDataFrame(rows, "account string, folder_path string, rel_path string, content string")
    want = sinks.concatenated(notes).withColumn("content", F.md5("content"))
    assert sorted(sinks.concatenated_digests(notes).collect(), key=str) == sorted(want.collect(), key=str)
    assert sinks.concatenated_digests(notes.limit(0)).count() == 0
    # The text in blocks, and its digest level by level, with a folder in one window and in many splits.
    sep = sinks.SEPARATOR.encode()
    whole = {(r.account, r.folder_path): r.content.encode() for r in sinks.concatenated(notes).collect()}
    for hot, size in ((False, 7), (True, 5), (True, 1 << 16)):
        parts = sorted(sinks.concatenated_blocks(notes, hot=hot, block_bytes=size).collect(), key=lambda r: r.block)
        assert all(b"".join(bytes(r.bytes) for r in parts if (r.account, r.folder_path) == k) == t for k, t in whole.items()) and sep in whole["A", "F1"]
        monkeypatch.setattr(sinks, "FAN", 3)

        def digest(t, size=size):
            level = [hashlib.md5(t[i : i + size]).hexdigest() for i in range(0, max(len(t), 1), size)]
            for _ in range(sinks.LEVELS):
                level = [hashlib.md5("".join(level[i : i + 3]).encode()).hexdigest() for i in range(0, len(level), 3)] if len(level) > 1 else level
            return level[0] if len(level) == 1 else None

        got = {(r.account, r.folder_path): r.content for r in sinks.concatenated_digests(notes, hot=hot, block_bytes=size).collect()}
        assert all(got[k] == digest(t) for k, t in whole.items() if digest(t)) and got.keys() == whole.keys()
    registry.QUERIES["sink_concat"](spark, "/root/testdata/sf0.001").explain()
    assert "MapInArrow" not in capsys.readouterr().out


def test_stored_tables_are_joined_as_they_lie(spark, capsys):
    refs = spark.range(2000).select(F.col("id").alias("attachment_id"), (F.col("id") % 7).alias("note_id"))
    atts = spark.range(2000).select(F.col("id").alias("attachment_id"), (F.col("id") % 5).alias("note_id"), (F.col("id") % 11 == 0).alias("deleted"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = stored.store(refs, "attachment_id", 4), stored.store(atts, "attachment_id", 4)
        got, meta = stored.owned(a, b), a.join(b.select("attachment_id", "deleted"), "attachment_id", "left")
        for df in (got, meta):
            df.explain()
            plan = capsys.readouterr().out
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
        assert sorted(map(tuple, got.collect())) == sorted((i, i % 7) for i in range(2000) if i % 7 == i % 5 and i % 11)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_title_index(spark, tmp_path):
    rng = random.Random(6)
    words = ["The cat", "ÄRGER", "the", "漢字かな", "é😀x", "", "ab", "abc", "Othello"]
    rows = [(i, rng.choice([None, *[" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(8)]])) for i in range(500)]
    notes = spark.createDataFrame(rows, "note_id long, title string").repartition(3)
    path = f"file://{tmp_path}/i"
    stored.index_titles(notes, path)
    for text in ("the", "THE CAT", "ärger", "漢字か", "😀x", "zzz", "a", "", "hell", "thethe", "cat ab"):
        got = {r.note_id for r in stored.search_titles(notes, path, text).collect()}
        assert got == {i for i, t in rows if t is not None and text.lower() in t.lower()}, text
    held, every = stored.files_read(spark, path, "zzz")
    assert held == 0 and every >= 1 and stored.files_read(spark, path, "the")[0] >= 1


def test_names_by_collation(spark):
    dim = spark.createDataFrame([(1, "ÄRGER"), (2, "arger"), (3, "Straße"), (4, None)], "account_id long, name string")
    notes = spark.createDataFrame([(i, i) for i in range(1, 5)], "note_id long, account_id long")
    ids = lambda text: {r.note_id for r in filters.by_collated_name(notes, dim, "account_id", text).collect()}
    assert ids("ärger") == {1} and ids("Arger") == {2} and ids("") == {1, 2, 3, 4} and ids("STRASSE") == filters_expected(spark)
    named = spark.createDataFrame([(1, "zebra"), (2, "Äpfel"), (3, "apfel"), (4, None), (5, "Birne")], "note_id long, title string")
    assert [r.note_id for r in paths.sorted_notes(named, "collated").collect()] == [3, 2, 5, 1, 4]


def filters_expected(spark):
    """What the collation itself says of a letter that grows in upper case."""
    same = spark.sql("SELECT collate('Straße', 'UNICODE_CI') = 'STRASSE'").first()[0]
    return {3} if same else set()


def test_observed_writes(spark, tmp_path):
    log = spark.createDataFrame([("completed", 1), ("failed", 2), ("skipped", None)], "status string, failed_attachments long")
    seen = sinks.write_observed(log, f"file://{tmp_path}/log", **sync.stat_columns())
    assert seen == sync.run_stats(log).first().asDict() and spark.read.parquet(f"file://{tmp_path}/log").count() == 3
    with pytest.raises(Exception, match="broken"):
        sinks.write_observed(log.withColumn("x", F.raise_error(F.lit("broken"))), f"file://{tmp_path}/bad", n=F.count("*"))
