"""Lookups whose table is too large to be sent whole: heavy keys stay, the others move."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from taskmill.scale import heavy_keys, lookup

ROWS = "key string, other int, place int"


@pytest.fixture(scope="module")
def rows(spark):
    hot = [("hot", 1, 0)] * 6000 + [(None, 1, i) for i in range(3000)]
    return spark.createDataFrame(hot + [(f"k{i % 500}", i % 2, i) for i in range(4000)], ROWS).repartition(6).checkpoint()


@pytest.fixture(scope="module")
def table(spark):
    keys = [("hot", 1), ("hot", 0), (None, 1), *((f"k{i}", 0) for i in range(0, 500, 2)), ("never", 0)]
    return spark.createDataFrame([(k, o, f"{k}-{o}") for k, o in keys], "key string, other long, found string")


def rest(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_same_rows_as_a_broadcast(rows, table, how, null_safe):
    sent = lookup(rows, table, ["key", "other"], how, null_safe)
    moved = lookup(rows, table, ["key", "other"], how, null_safe, limit=-1)
    assert moved.columns == sent.columns
    assert rest(moved) == rest(sent)


def test_the_sketch_finds_heavy_keys_only(spark, rows):
    found = {r[0] for r in heavy_keys(rows, ["key"], 0.1).collect()}
    want = {r[0] for r in spark.createDataFrame([("hot",), (None,)], "key string").select(F.xxhash64("key")).collect()}
    assert found == want
    assert heavy_keys(rows.limit(0), ["key"], 0.1).collect() == []


def test_rows_of_a_heavy_key_do_not_move(spark, rows, table):
    joined = lookup(rows, table, ["key", "other"], limit=-1)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", plan)) <= 2
    for heavy in ("key = 'hot'", "key is null"):
        spread = [r["count"] for r in joined.where(heavy).groupBy(F.spark_partition_id()).count().collect()]
        assert len(spread) == 6 and max(spread) < sum(spread) / 4


def test_nothing_to_look_up(rows, table):
    assert lookup(rows.limit(0), table.drop("other"), ["key"], limit=-1).collect() == []
    empty = lookup(rows, table.limit(0), ["key", "other"], limit=-1)
    assert empty.where("found is null").count() == 13000
