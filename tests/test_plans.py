import re

import pytest
from pyspark.sql import functions as F

from taskmill.operators import ordering, packing, records, rouge, sampling
from taskmill.plans import scoring
from taskmill.sources import ledger
from workload import queries as q
from workload import records as data

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"(?<!Broadcast)Exchange (\w+)", plan(df))


def test_a_sample_does_not_move_the_rows(spark):
    rows = data.documents(spark, SF).select("id", "lang", "dataset", "output", "input")
    stored = rows.checkpoint()
    assert exchanges(sampling.stratified_sample(stored, 10)) == []


def test_a_shuffle_moves_the_rows_once(spark):
    rows = data.documents(spark, SF).select("id", "lang", "dataset", "task", "input").checkpoint()
    for mode in ordering.MODES:
        assert exchanges(ordering.shuffle(rows, mode)) == ["shufflepartitionidpassthrough"]


def test_scoring_moves_only_the_rows_and_trims_hot_keys_first(spark, tmp_path):
    rows = data.documents(spark, SF).checkpoint().withColumn("position", F.monotonically_increasing_id())
    book = ledger.Ledger(spark, str(tmp_path))
    book.enter(rows.where("output is null").select(ledger.record_key(rows.drop("position").columns).alias("record")), "one")
    todo = scoring.unscored(rows, book)
    assert exchanges(todo) == ["hashpartitioning"]
    assert re.search(r"WindowGroupLimit .* Partial", plan(todo))
    (scan,) = re.findall(r"FileScan parquet [^\n]*", plan(todo))
    assert "ReadSchema: struct<record:string>" in scan and "Bucketed: true" in scan
    assert todo.count() == rows.where("output is not null").count()


def test_packing_moves_the_rows_once(spark):
    rows = spark.range(100).select(F.col("id").alias("position"), F.lit(3).alias("n")).checkpoint()
    assert exchanges(packing.pack(rows, "n", 10)) == ["hashpartitioning"]


def test_rouge_stays_in_place_and_without_python_for_ngrams(spark):
    rows = data.replies(spark, SF).checkpoint()
    scored = rouge.rouge_scores(rows, ["rouge1", "rouge2"])
    assert exchanges(scored) == [] and "Python" not in plan(scored)
    assert plan(rouge.rouge_scores(rows)).count("ArrowEvalPython") == 1


def test_scans_read_what_they_need(spark):
    report = q.class_report(spark, SF)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(report))
    assert schemas == ["o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string"]
    counted = records.counts(data.documents(spark, SF))
    assert "text" not in re.findall(r"ReadSchema: struct<([^>]*)>", plan(counted))[0]


@pytest.mark.parametrize("name", ["single_label_metrics", "multi_label_report", "confusion_matrix", "label_encoding",
                                  "stratified_sample", "shuffle_none", "instruction_assignment", "rouge_all"])
def test_no_cross_joins(spark, name):
    text = plan(q.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
