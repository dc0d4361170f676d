"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


def cell(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def multiset(rows, names):
    places = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(cell(row[i]) for i in places) for row in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    sql = entry.oracle_sql().get(name)
    if sql:
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert multiset(rows, df.columns) == multiset(cursor.fetchall(), names)


def test_every_query_has_sql():
    assert not set(QUERIES) - set(entry.oracle_sql())
    assert not set(entry.oracle_sql()) - set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def _documents(spark, path, ids):
    rows = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 2}") for i in ids], "doc_id long, text string, lang string, source string")
    rows.coalesce(1).write.parquet(f"{path}/documents.parquet")
    judged = spark.createDataFrame([(i, i % 2, 0) for i in ids if i % 3], "doc_id long, quality int, toxic int")
    judged.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_object_files_are_not_a_folder_each(spark, tmp_path, monkeypatch):
    from taskmill.sources import results

    read, given = results.read_results, []
    monkeypatch.setattr(results, "read_results", lambda spark, path, **more: given.append(path) or read(spark, path, **more))
    found = QUERIES["result_source_objects"](spark, _documents(spark, tmp_path, range(300))).collect()
    assert {(r.id, r.state) for r in found} == {(str(i), "good" if i % 3 else "corrupt") for i in range(0, 300, 10)}
    files = spark.read.text(f"{given[0]}/*", wholetext=True).inputFiles()
    assert len(files) == 30 and len({f.rsplit("/", 1)[0] for f in files}) == 1


def test_array_files_grow_in_number(spark, tmp_path):
    rows = QUERIES["record_source_array"](spark, _documents(spark, tmp_path, range(10000)))
    assert len(rows.inputFiles()) > 3 and rows.count() == 10000
