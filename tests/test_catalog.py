"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lattispark import __version__, catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, tables, name):
    frame = catalog.QUERIES[name](spark, SF)
    want = tables.sql(catalog.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(frame.columns) == columns
    got = sorted(map(repr, map(tuple, frame.select(*columns).collect())))
    assert got == sorted(map(repr, want.select(", ".join(columns)).fetchall()))


def test_rank_4_holds_every_event(spark):
    events = 100_000
    got = catalog.v4(spark, "/root/testdata/sf0.1").selectExpr("count(*)", "max(i0)").first()
    assert tuple(got) == (events, events // 1000 - 1)


def test_every_text_goes_through_the_vlen_codec(spark, tmp_path, monkeypatch):
    texts = [None, "", "-", "+", "é\n😀", *(f"text {k} " * 9 for k in range(300))]
    rows = [(k if k < 200 else k + 500, x) for k, x in enumerate(texts)]  # and ids that aren't there
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    sent, encoded = [], catalog.coding.encoded
    monkeypatch.setattr(catalog.coding, "encoded", lambda cells, meta: sent.append((cells.count(), meta.codecs[0]["name"])) or encoded(cells, meta))
    assert sorted(map(tuple, catalog.vlen_texts(spark, str(tmp_path)).collect())) == sorted(rows)
    got = sorted(map(tuple, catalog.QUERIES["vlen_strings"](spark, str(tmp_path)).collect()))
    assert got == [(k - 5, x) for k, x in rows if 5 <= k < 25] and sent == [(len(rows), "vlen-utf8")] * 2


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 60
    assert __version__
