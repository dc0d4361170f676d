import json
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskmill import schema
from taskmill.operators import records
from taskmill.plans import corpus as corpus_plan
from taskmill.plans import evaluation, scoring
from taskmill.sources import corpus, results, tables
from taskmill.streaming.scoring import score_arriving

LANGS = ("ar", "en", "hi")


def entry(i, lang, dataset, **values):
    row = dict(id=f"{lang}-{dataset}-{i}", original_id=f"{i}", input=f"text {i}\nмир", output="ab"[i % 2],
               dataset=dataset, task="Detection", lang=lang, instruction="Say.")
    row.update(values)
    return row


@pytest.fixture
def base(tmp_path):
    for lang in LANGS:
        for dataset in ("news set", "a+b"):
            folder = tmp_path / "corpus" / lang / dataset
            folder.mkdir(parents=True)
            for split, n in (("train", 12), ("test", 3)):
                rows = [entry(i, lang, dataset) for i in range(n)]
                (folder / f"{split}.json").write_text(json.dumps(rows, ensure_ascii=False, indent=2), "utf-8")
    return tmp_path / "corpus"


def test_corpus_arrays_by_language_and_split(spark, base):
    train = corpus.read_corpus(spark, str(base))
    assert train.count() == 72
    assert {(r.folder_lang, r.folder) for r in train.select("folder_lang", "folder").distinct().collect()} == {
        (lang, d) for lang in LANGS for d in ("news set", "a+b")
    }
    row = train.where("id = 'hi-news set-3'").first()
    assert (row.input, row.dataset, row.output_en) == ("text 3\nмир", "news set", None)
    assert corpus.read_corpus(spark, str(base), "test", ["en"]).count() == 6


def test_ids_and_labels_stay_text(spark, tmp_path):
    (tmp_path / "records.json").write_text(
        json.dumps([{"id": 7, "original_id": "0012", "output": True, "input": None}, {"id": "8"}])
    )
    got = corpus.read_records(spark, str(tmp_path / "records.json")).orderBy("position").collect()
    assert [(r.id, r.original_id, r.output, r.input) for r in got] == [("7", "0012", "true", None), ("8", None, None, None)]
    with pytest.raises(ValueError):
        corpus.read_records(spark, "x", layout="csv")


def test_build_corpus_end_to_end(spark, base, tmp_path):
    target = str(tmp_path / "prepared")
    corpus_plan.build_corpus(spark, str(base), target, samples=5, shuffling="by_language")
    saved = corpus.read_prepared(spark, target).orderBy("position").collect()
    assert Counter((r.lang, r.dataset) for r in saved) == {(lang, d): 5 for lang in LANGS for d in ("news set", "a+b")}
    assert [r.lang for r in saved] == sorted(r.lang for r in saved)
    assert [r.position for r in saved] == list(range(30))
    assert saved[0].text.endswith("<|end_of_text|>")
    chats = corpus_plan.training_chats(corpus.read_prepared(spark, target), "native")
    assert "None\nInput: text" in chats.first().Text


def test_write_corpus_lays_files_out_by_position(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("position")).orderBy(F.xxhash64("position"))
    corpus.write_corpus(rows, str(tmp_path / "out"), files=4)
    got = corpus.read_prepared(spark, str(tmp_path / "out")).withColumn("file", F.input_file_name())
    spans = got.groupBy("file").agg(F.min("position"), F.max("position"), F.count("position")).collect()
    assert sorted((a, b, n) for _, a, b, n in spans) == [(0, 24, 25), (25, 49, 25), (50, 74, 25), (75, 99, 25)]


def test_results_skip_and_report_bad_files(spark, tmp_path):
    for dataset in ("Arabic set", "d2"):
        folder = tmp_path / dataset
        folder.mkdir()
        for i in range(3):
            row = entry(i, "ar", dataset, response=" A\n" if i else None)
            (folder / f"{i}.json").write_text(json.dumps(row, ensure_ascii=False, indent=4), "utf-8")
    (tmp_path / "d2" / "cut.json").write_text('{"id": "9", "output": "a"')
    (tmp_path / "d2" / "notes.txt").write_text("ignored")
    good, bad = results.read_results(spark, str(tmp_path))
    assert Counter(r.experiment for r in good.collect()) == {"Arabic set": 3, "d2": 3}
    assert [(r.experiment, r.text) for r in bad.collect()] == [("d2", '{"id": "9", "output": "a"')]
    assert bad.count() == 1 and good.where("response is null").count() == 2
    cleaned = records.clean_answers(good)
    assert Counter(r.response for r in cleaned.collect()) == {"a": 4, "none": 2}


def test_experiment_to_metrics_files(spark, tmp_path):
    for dataset, outputs in (("plain", ["a", "b", "a"]), ("Hostility x", ["a,b", "a", "b"]), ("xlsum", ["a b", "c", "d"])):
        folder = tmp_path / "exp" / dataset
        folder.mkdir(parents=True)
        for i, output in enumerate(outputs):
            row = entry(i, "en", dataset, output=output, response=output.upper())
            (folder / f"{i}.json").write_text(json.dumps(row))
    (tmp_path / "exp" / "plain" / "bad.json").write_text("{")
    bad = evaluation.evaluate_experiment(spark, str(tmp_path / "exp"), str(tmp_path / "scores"))
    assert bad.count() == 1
    stored = spark.read.schema("value string, experiment string").text(str(tmp_path / "scores")).collect()
    got = {r.experiment: json.loads(r.value) for r in stored}
    assert set(got) == {"plain", "Hostility x", "xlsum"}
    assert got["plain"]["accuracy"] == got["Hostility x"]["accuracy"] == 1.0
    assert got["plain"]["confusion_matrix"] == [[2, 0], [0, 1]]
    assert got["xlsum"] == {"rouge1": 100.0, "rouge2": pytest.approx(100 / 3), "rougeL": 100.0, "rougeLsum": 100.0}


def test_support_tables(spark, tmp_path):
    (tmp_path / "r.tsv").write_text(
        "dataset\ttask\ttask_definition\tlang\tlabels\n"
        "xlsum\tSummarization\tSay it \"short\".\tHindi, English\tNone\n"
        "h set\tHostility\tFind it.\tArabic\t['a,b', 'not it']\n", "utf-8"
    )
    registry = tables.read_registry(spark, str(tmp_path / "r.tsv"))
    assert {(r.dataset, r.lang, tuple(r.labels or ())) for r in registry.collect()} == {
        ("xlsum", "hi", ()), ("xlsum", "en", ()), ("h set", "ar", ("a,b", "not it")),
    }
    assert {r.label for r in tables.registry_labels(registry).collect()} == {"a,b", "not it"}
    (tmp_path / "m.json").write_text(json.dumps({"True": "yes", "true": "no", "لا": "no"}, indent=1), "utf-8")
    pairs = {tuple(r) for r in tables.read_label_map(spark, str(tmp_path / "m.json")).collect()}
    assert pairs == {("True", "yes"), ("true", "no"), ("لا", "no")}
    (tmp_path / "i.json").write_text(json.dumps({"d": ["one", "two"], "e": ["three"]}, indent=1))
    bank = {tuple(r) for r in tables.read_instructions(spark, str(tmp_path / "i.json")).collect()}
    assert bank == {("d", 0, "one"), ("d", 1, "two"), ("e", 0, "three")}


@pytest.fixture
def echo():
    def predict(batches):
        for messages in batches:
            yield pd.Series([m[1]["content"][-6:] + m[2]["content"] for m in messages], dtype=object)

    return predict


def to_score(spark, n=30):
    rows = [entry(i, "en", f"set {i % 3}", task="Summarization" if i % 2 else "Detection") for i in range(n)]
    rows += [entry(0, "en", "set 0", instruction="Later.")]
    frame = [tuple(r[f.name] for f in schema.INSTRUCTION) for r in rows]
    return spark.createDataFrame(frame, schema.INSTRUCTION).coalesce(2)


def test_scoring_resumes_and_adds_nothing_twice(spark, tmp_path, echo):
    path, rows = str(tmp_path / "out"), to_score(spark)
    assert results.read_responses(spark, path).count() == 0
    scoring.score(rows.where("id like '%-1_'"), echo, path)
    assert results.read_responses(spark, path).count() == 10
    for parallelism in (None, 3, None):
        scoring.score(rows, echo, path, parallelism=parallelism)
        got = results.read_responses(spark, path).collect()
        assert len(got) == len({r.id for r in got}) == 30
    by_id = {r.id: r for r in got}
    assert by_id["en-set 0-0"].instruction == "Say.", "the first of two rows with one key is kept"
    assert by_id["en-set 1-1"].response == " 1\nмирSummary: "
    assert by_id["en-set 2-2"].response.endswith("Label: ")


def test_stream_of_record_files(spark, tmp_path, echo):
    source, path, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    to_score(spark).limit(20).write.json(source)
    score_arriving(spark, source, path, echo, progress, files_per_batch=1).awaitTermination()
    assert results.read_responses(spark, path).count() == 20
    to_score(spark).write.mode("append").json(source)
    score_arriving(spark, source, path, echo, progress).awaitTermination()
    score_arriving(spark, source, path, echo, progress).awaitTermination()
    got = [r.id for r in results.read_responses(spark, path).collect()]
    assert len(got) == len(set(got)) == 30


def test_map_batches_binds_arguments(spark):
    def add(batches, amount):
        for batch in batches:
            yield batch.assign(id=batch["id"] + amount)

    got = records.map_batches(spark.range(5), add, "id bigint", amount=10)
    assert sorted(r.id for r in got.collect()) == [10, 11, 12, 13, 14]


def test_first_of_duplicates_and_pending(spark):
    rows = spark.createDataFrame(
        [("en", "d", "1", "b", 5), ("en", "d", "1", "a", 2), ("ar", "d", "1", "c", 9)],
        "lang string, dataset string, id string, input string, place bigint",
    )
    first = records.first_of_duplicates(rows, "place")
    assert {r.input for r in first.collect()} == {"a", "c"}
    done = rows.where("lang = 'ar'")
    assert {r.input for r in records.pending(first, done).collect()} == {"a"}


def test_predictor_has_to_answer_everything(spark):
    rows = spark.range(10).select(
        F.col("id").cast("string").alias("id"), F.lit("en").alias("lang"), F.lit("d").alias("dataset"), F.lit("t").alias("task"),
        F.lit("Do.").alias("instruction"), F.lit("x").alias("input"),
        F.when(F.col("id") > 0, F.col("id") + 2**60).alias("large"),
    ).coalesce(1)
    got = scoring.with_responses(rows, lambda batches: (b.map(lambda m: m[-1]["role"]) for b in batches)).collect()
    assert [r.large for r in got] == [None, *(i + 2**60 for i in range(1, 10))] and {r.response for r in got} == {"assistant"}
    for lazy in (lambda batches: iter(()), lambda batches: (b.iloc[:3].map(str) for b in batches)):
        with pytest.raises(Exception, match="predictor"):
            scoring.with_responses(rows, lazy).collect()


def test_empty_and_missing_keys_are_scored_once(spark, tmp_path):
    rows = spark.createDataFrame(
        [("1", "", "en"), ("1", None, "en"), ("1", "d", None), (None, "d", "en")], "id string, dataset string, lang string"
    ).select("*", F.lit("t").alias("task"), F.lit("Do.").alias("instruction"), F.lit("x").alias("input"))
    path = str(tmp_path / "out")
    for _ in range(2):
        scoring.score(rows, lambda batches: (b.map(len).map(str) for b in batches), path)
    schema = T.StructType(rows.schema.fields + [T.StructField("response", T.StringType())])
    got = results.read_responses(spark, path, schema).select("id", "dataset", "lang").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, rows.select("id", "dataset", "lang").collect()), key=str)


def test_records_that_do_not_parse_fail(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "input": "x"}\n{"id": "2", "inp')
    with pytest.raises(Exception):
        corpus.read_records(spark, str(tmp_path / "a.json"), "lines").collect()


def test_text_after_a_result_is_quarantined(spark, tmp_path):
    folder = tmp_path / "exp" / "d"
    folder.mkdir(parents=True)
    texts = ['{"id":"1","response":"a"} trailing garbage {', '{"id":"2","response":"b"}\n', '{"id":"3"},{"id":"4"}', "[]", " "]
    for i, text in enumerate(texts):
        (folder / f"{i}.json").write_text(text)
    good, bad = results.read_results(spark, str(tmp_path / "exp"))
    assert [(r.id, r.response) for r in good.collect()] == [("2", "b")] and bad.count() == 4


def test_folders_order_a_corpus_and_absent_columns_get_defaults(spark, tmp_path):
    for lang in LANGS:
        for dataset in ("one", "two"):
            folder = tmp_path / "corpus" / lang / dataset
            folder.mkdir(parents=True)
            rows = [{"id": "same", "input": f"{lang} {dataset} {i}", "output": "a", "task": "Detection", "lang": None} for i in range(9)]
            (folder / "train.json").write_text(json.dumps(rows + rows[:1]))
    target = str(tmp_path / "prepared")
    corpus_plan.build_corpus(spark, str(tmp_path / "corpus"), target)
    saved = corpus.read_prepared(spark, target).orderBy("position").collect()
    assert len(saved) == 60 and {(r.lang, r.dataset, r.task) for r in saved} == {("en", "", "Detection")}
    folders = [(r.folder_lang, r.folder) for r in saved]
    assert folders == sorted(folders) and len(set(folders)) == 6
    assert [r.input for r in saved[:10]] != sorted(r.input for r in saved[:10])


def test_a_broken_array_fails_the_job(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "input": "x"}, {"id": "2", "inp')
    with pytest.raises(Exception, match="does not parse"):
        corpus.read_records(spark, str(tmp_path / "a.json")).collect()


def test_the_first_file_by_name_counts(spark, tmp_path):
    for name, ids in (("a.json", "xy"), ("b.json", "xyz" * 300), ("c.json", "wxyz")):
        rows = [{"id": i, "lang": "en", "dataset": "d", "input": f"{name} {k}"} for k, i in enumerate(ids)]
        (tmp_path / name).write_text(json.dumps(rows))
        (tmp_path / name.replace(".json", ".jsonl")).write_text("\n".join(map(json.dumps, rows)))
    for layout, pattern in (("array", "*.json"), ("lines", "*.jsonl")):
        read = corpus.read_records(spark, str(tmp_path / pattern), layout)
        first = {r.id: r.input.split()[0][0] + r.input.split()[1] for r in records.first_of_duplicates(read, "position").collect()}
        assert first == {"x": "a0", "y": "a1", "z": "b2", "w": "c0"}


def test_results_read_once_outlive_their_files(spark, tmp_path):
    folder = tmp_path / "exp" / "d s"
    folder.mkdir(parents=True)
    for i, text in enumerate(['{"id": "1",\n "response": "a"}', '{"id": "2"', '{"id":"3"}{"id":"4"}', " ", '{"id": "5"}']):
        (folder / f"{i}.json").write_text(text)
    twice = [sorted(map(str, part.collect())) for part in results.read_results(spark, str(tmp_path / "exp"))]
    once = results.read_results(spark, str(tmp_path / "exp"), once=True)
    for file in folder.iterdir():
        file.write_text("{}")
    assert [sorted(map(str, part.collect())) for part in once] == twice
    assert [len(part) for part in twice] == [2, 3]
