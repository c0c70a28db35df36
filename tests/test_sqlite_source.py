"""SQLite stores as a data source: ranges of rows, filters in SQLite, odd stores."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from loglattice.sources import sqlite_source

SCHEMA = "file string, rowid long, name string, size long, rate double, later string"


@pytest.fixture
def stores(spark, tmp_path):
    sqlite_source.register(spark)
    for k in range(2):
        con = sqlite3.connect(tmp_path / f"{k}.db")
        con.execute('CREATE TABLE "odd ""name" (name, size, rate)')
        con.executemany('INSERT INTO "odd ""name" VALUES (?, ?, ?)', [(f"n{k}-{j}", j, j / 2) for j in range(1000)] + [(b"raw", "a text", 7), (None, None, None)])
        con.commit()
        con.close()
    (tmp_path / "no.db").write_text("no store at all")
    con = sqlite3.connect(tmp_path / "other.db")
    con.execute("CREATE TABLE other (x)")
    con.commit()
    con.close()
    return lambda push="false": spark.read.format("sqlite_rows").option("path", str(tmp_path)).option("table", 'odd "name').option("taskRows", "300").option("pushdown", push).schema(SCHEMA).load()


def test_all_rows_in_ranges(stores):
    stores = stores()
    assert stores.count() == 2004 and stores.rdd.getNumPartitions() == 8
    odd = stores.where("rowid = 1001").collect()
    assert [(r.name, r.size, r.rate, r.later) for r in odd] == [("raw", None, 7.0, None)] * 2
    assert stores.agg(F.sum("size"), F.sum("rate")).first()[:] == (999000, 499514.0)


def test_filters_are_sqlites_and_change_nothing(stores, capsys):
    plain = [tuple(r) for r in stores().collect()]
    for cond, keep in [
        ("size >= 990 and size < 995", lambda r: r[3] is not None and 990 <= r[3] < 995), ("name = 'n1-7'", lambda r: r[2] == "n1-7"), ("name in ('n0-1', 'n1-2', 'none')", lambda r: r[2] in ("n0-1", "n1-2")),
        ("size is null", lambda r: r[3] is None), ("name is not null and rate > 499.0", lambda r: r[2] is not None and r[4] is not None and r[4] > 499), ("later is null and rowid = 3", lambda r: r[1] == 3), ("later = 'x'", lambda r: False),
        ("name = 'raw'", lambda r: r[2] == "raw"),
    ]:
        assert sorted(map(tuple, stores("true").where(cond).collect()), key=str) == sorted(filter(keep, plain), key=str), cond
    stores("true").where("size >= 990 and rate * 2 < 5").explain("formatted")
    assert "PushedFilters: [" in (told := capsys.readouterr().out) and "size" in told.split("PushedFilters: ")[1].splitlines()[0]
