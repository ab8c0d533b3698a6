"""The SQLite source and sink."""

import sqlite3

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmeter.sources.sqlite_source import Range, Reader, register


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    register(spark)


def store(path, rows, log=False):
    c = sqlite3.connect(path)
    if log:
        c.execute("PRAGMA journal_mode=WAL")
        c.execute("PRAGMA wal_autocheckpoint=0")
    c.execute('CREATE TABLE "the events" (id INTEGER PRIMARY KEY, ts BIGINT, name TEXT, "a ""b" REAL, raw BLOB)')
    c.executemany('INSERT INTO "the events" VALUES (?, ?, ?, ?, ?)', rows)
    c.commit()
    return c


def read(spark, path, **options):
    return spark.read.format("sqlite").options(path=str(path), table="the events", **options).load()


ROWS = [(k, k * 10, f"n{k % 3}", k / 2, bytes([k % 256])) for k in range(1, 1001)]


def test_many_tasks_and_schema(spark, tmp_path):
    store(tmp_path / "a.db", ROWS).close()
    df = read(spark, tmp_path / "a.db", rowsPerTask="100")
    assert df.schema.simpleString() == 'struct<id:bigint,ts:bigint,name:string,a "b:double,raw:binary>'
    assert df.rdd.getNumPartitions() == 10
    assert sorted(tuple(r) for r in df.collect()) == ROWS


def test_filters_reach_the_store(spark, tmp_path):
    store(tmp_path / "a.db", ROWS).close()
    df = read(spark, tmp_path / "a.db").where("ts >= 500 and ts < 900 and name in ('n1', 'n2') and not (id = 51)").select("id")
    assert [r["id"] for r in df.orderBy("id").collect()] == [k for k in range(50, 90) if k % 3 and k != 51]
    schema = StructType.fromDDL("id BIGINT, ts BIGINT, name STRING, d DOUBLE, flag BOOLEAN")
    reader = Reader({"path": str(tmp_path / "a.db"), "table": "the events"}, schema)
    left = list(reader.pushFilters([D.GreaterThanOrEqual(("ts",), 500), D.LessThan(("ts",), 900), D.EqualTo(("flag",), True), D.StringContains(("name",), "x")]))
    assert [type(f) for f in left] == [D.EqualTo, D.StringContains]
    sql, values = reader.statement(Range("p", 1, 9))
    assert '"ts" >= ?' in sql and '"ts" < ?' in sql and values == [500, 900, 1, 9]


def test_rows_in_the_log_count(spark, tmp_path):
    held = store(tmp_path / "live.sqlite", ROWS[:5], log=True)
    held.execute("INSERT INTO \"the events\" VALUES (2000, 1, 'new', 0, NULL)")
    held.commit()
    assert read(spark, tmp_path / "live.sqlite").count() == 6
    held.close()


def test_odd_cells_and_tables(spark, tmp_path):
    c = store(tmp_path / "odd.db", [(1, "text", 5, "x", "s"), (2, None, None, None, None), (3, 7, b"\xff", 2, b"")])
    c.execute("CREATE TABLE bare (k TEXT PRIMARY KEY, v) WITHOUT ROWID")
    c.execute("INSERT INTO bare VALUES ('x', 1)")
    c.execute("CREATE TABLE none (k INTEGER)")
    c.commit()
    c.close()
    df = read(spark, tmp_path / "odd.db")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, None, "5", None, None), (2, None, None, None, None), (3, 7, None, 2.0, b"")]
    assert df.where("ts is null").count() == 2 and df.where("ts > 0").count() == 1 and df.where("name is not null").count() == 1 and df.where(F.lit(False)).count() == 0
    other = lambda t: spark.read.format("sqlite").options(path=str(tmp_path / "odd.db"), table=t).load()
    assert other("bare").select("k").collect()[0]["k"] == "x" and other("none").count() == 0
    with pytest.raises(Exception, match="has a table absent"):
        other("absent")


def test_sink_and_folder(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "id * 0.5D as half", "concat('é', id) as name", "id % 2 = 0 as even", "cast(null as string) as none").repartition(3)
    path = str(tmp_path / "out")
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        df.write.format("sqlite").options(path=path, table="t").mode(mode).save()
        back = spark.read.format("sqlite").schema(df.schema).options(path=path, table="t").load()
        assert back.rdd.getNumPartitions() == 3 * times
        assert sorted(map(tuple, back.collect()), key=str) == sorted([*map(tuple, df.collect())] * times, key=str)
