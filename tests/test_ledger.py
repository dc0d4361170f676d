"""The ledger of answered records: keys, repeated and broken batches, compaction."""

from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskmill.plans import scoring
from taskmill.sources import results
from taskmill.sources.ledger import Ledger, record_key

DDL = "id string, lang string, dataset string, task string, instruction string, input string, n long"


def frame(spark, ids, dataset="d"):
    return spark.createDataFrame([(i, "en", dataset, "t", "Do.", f"text {k}", k) for k, i in enumerate(ids)], DDL)


def answer(mark, seen=None):
    def predict(batches):
        for messages in batches:
            yield pd.Series([f"{mark} {m[1]['content'][-6:]}" for m in messages], dtype=object)

    return predict


def stored(spark, path):
    schema = T.StructType([*T._parse_datatype_string(DDL).fields, T.StructField("response", T.StringType())])
    return sorted(((r.id, r.n, r.response.split()[0]) for r in results.read_responses(spark, path, schema).collect()), key=str)


def test_keys_tell_nulls_from_empty_texts_and_rows_without_id_by_content(spark):
    rows = spark.createDataFrame(
        [("1", "d"), ("1", ""), ("1", None), ("", "1"), (None, "1"), (None, "2"), (None, None), ('1","x":"', "d")],
        "id string, dataset string",
    ).withColumn("lang", F.lit("en"))
    keys = [r[0] for r in rows.select(record_key(rows.columns)).collect()]
    assert len(set(keys)) == 8 and None not in keys
    again = [r[0] for r in rows.select(record_key(rows.columns)).collect()]
    assert keys == again


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "out")
    scoring.score(frame(spark, ["a", "b"]), answer("one"), path, batch="1")
    scoring.score(frame(spark, ["a", "b", "c"]), answer("two"), path, batch="2")
    assert stored(spark, path) == [("a", 0, "one"), ("b", 1, "one"), ("c", 2, "two")]
    scoring.score(frame(spark, ["a", "b", "c"]), answer("three"), path, batch="2")
    assert stored(spark, path) == [("a", 0, "one"), ("b", 1, "one"), ("c", 2, "three")]
    assert Ledger(spark, path).done() == {"1", "2"}


def test_a_batch_that_died_before_it_was_entered(spark, tmp_path):
    path = str(tmp_path / "out")
    scoring.score(frame(spark, ["a"]), answer("one"), path, batch="1")
    Path(path, "_done", "1").unlink()
    scoring.score(frame(spark, ["a", "b"]), answer("two"), path)
    assert stored(spark, path) == [("a", 0, "one"), ("b", 1, "two")]
    # Results whose job did not end have no marker of success, and are not taken for answers.
    scoring.score(frame(spark, ["c"]), answer("half"), path, batch="3")
    for name in ("_done/3", "of_batch=3/_SUCCESS"):
        Path(path, name).unlink()
    assert "3" not in results.batches_of(spark, path)


def test_a_failing_predictor_leaves_nothing_behind(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="predictor"):
        scoring.score(frame(spark, ["a"]), lambda batches: iter(()), path)
    scoring.score(frame(spark, ["a"]), answer("one"), path)
    assert stored(spark, path) == [("a", 0, "one")]


def test_rows_without_id_are_told_apart_by_content(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = frame(spark, [None, None, None, "a"]).unionByName(frame(spark, [None])).coalesce(1)
    for _ in range(2):
        scoring.score(rows, answer("one"), path)
    assert stored(spark, path) == [("a", 3, "one"), (None, 0, "one"), (None, 1, "one"), (None, 2, "one")]


def test_compaction_keeps_the_keys(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in range(1, 4):
        scoring.score(frame(spark, "abc"[:n]), answer(str(n)), path)
    ledger = Ledger(spark, path)
    ledger.compact()
    files = [p for p in Path(path, "_ledger").rglob("*.parquet")]
    assert len(files) <= ledger.buckets and all("gen-1" in str(p) for p in files)
    again = Ledger(spark, path)
    assert (again.generation, again.answered().count()) == (1, 3)
    scoring.score(frame(spark, "abcd"), answer("4"), path)
    assert [x[2] for x in stored(spark, path)] == ["1", "2", "3", "4"]


def test_nothing_to_score(spark, tmp_path):
    path = str(tmp_path / "out")
    scoring.score(frame(spark, ["a"]).limit(0), answer("one"), path)
    assert stored(spark, path) == []


def test_another_number_of_shuffle_partitions(spark, tmp_path):
    path = str(tmp_path / "out")
    scoring.score(frame(spark, ["a", "b"]), answer("one"), path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        scoring.score(frame(spark, ["a", "b", "c"]), answer("two"), path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert stored(spark, path) == [("a", 0, "one"), ("b", 1, "one"), ("c", 2, "two")]
