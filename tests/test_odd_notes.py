"""Queries on notes against their SQL, on texts that the given tables do not have."""

import datetime
import glob
import os
import shutil

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_oracles import DIR, rows

from quire import plans, registry  # noqa: F401
from quire.sources import sinks

#: The second half of the notes was made in 2025.
TEXTS = [None, "", "{author}: {year} {body} {\n{title} {x}", "plain\nbody", "a\\$1 {title", "\u00a0 wide\u3000\u2003 \nspaces\u00a0"]
TEXTS += ["  two \n lines  ", "\ttab\t", "a\r\nb\r\n", "c\rd", "\r", "\n\nx\n", 'say "x", ""\n"', '"', "\\", '\\"\n', "\\N", "#,x", "null\n", "nul\0\n\0", "\x85\x0b", "\ufeffmark", '"Title","Folder"']


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    for f in glob.glob(f"{DIR}/*.parquet"):
        if not f.endswith("/documents.parquet"):
            shutil.copy(f, at)
    ids = [*range(len(TEXTS)), *range(527_040, 527_040 + len(TEXTS))]
    texts = TEXTS * 2
    columns = {"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * len(ids), "source": ["web"] * len(ids), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    pq.write_table(pa.table(columns), at / "documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["fn_template", "sink_csv"])
def test_odd_texts(spark, odd, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{odd}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert rows(registry.QUERIES[name](spark, odd).toPandas()) == rows(con.execute(registry.ORACLES[name]).fetchdf())


def test_csv_files_begin_with_names(spark, tmp_path):
    shape = "title string, folder string, account string, created timestamp_ntz, modified timestamp_ntz, body string, attachments array<string>"
    made = datetime.datetime(2025, 1, 1)
    notes = spark.createDataFrame([(t, "f", None, made, None, t, ["x"]) for t in TEXTS], shape)
    header = '"Title","Folder","Account","Created","Modified","Body","Attachment Count"\n'
    for name, rows_ in (("many", notes.repartition(3)), ("none", notes.where("false"))):
        path = str(tmp_path / name)
        sinks.write_csv(rows_, path)
        files = [open(f, newline="").read() for f in glob.glob(f"{path}/part-*")]
        assert [f[: len(header)] for f in files if f] == [header] * (3 if name == "many" else 1)
        got = [(r.Title, r.Account, r.Modified, r.Body, r["Attachment Count"]) for r in sinks.read_csv(spark, path).collect()]
        assert sorted(got, key=str) == sorted([(t, None, None, t, "1") for t in TEXTS] if name == "many" else [], key=str)
