import json
import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from taskmill import scale
from taskmill.operators import labels, metrics, records
from taskmill.plans import evaluation
from test_sampling_and_ordering import key

ANSWERS = "id string, lang string, dataset string, output string, response string"


def div(a, b):
    return a / b if b else 0.0


def score_single(pairs):
    classes = sorted({t for t, _ in pairs} | {p for _, p in pairs})
    table = {}
    for c in classes:
        tp = sum(t == p == c for t, p in pairs)
        support = sum(t == c for t, _ in pairs)
        predicted = sum(p == c for _, p in pairs)
        table[c] = (div(tp, predicted), div(tp, support), div(2 * tp, support + predicted), support)
    n = len(pairs)
    right = sum(t == p for t, p in pairs) / n
    wide = {"accuracy": right}
    for i, m in enumerate(("precision", "recall", "f1")):
        wide[f"{m}_macro"] = sum(r[i] for r in table.values()) / len(classes)
        wide[f"{m}_micro"] = right
        wide[f"{m}_weighted"] = sum(r[i] * r[3] for r in table.values()) / n
    return table, wide


def answers(spark, seed=1, n=400):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        dataset = draw.choice(["d1", "d2"])
        output = draw.choice("abcd" if dataset == "d1" else "xy")
        response = output if draw.random() < 0.6 else draw.choice(["a", "b", "x", "junk"])
        rows.append((f"r{i}", "en", dataset, output, response))
    return rows, spark.createDataFrame(rows, ANSWERS).repartition(4)


def repaired(rows, seed=42):
    known = defaultdict(set)
    for r in rows:
        known[r[2]].add(r[3])
    fixed = {}
    for id_, _, dataset, _, response in rows:
        choices = sorted(known[dataset])
        fixed[id_] = response if response in choices else choices[key(seed, id_) % len(choices)]
    return fixed


@pytest.mark.parametrize("limit", [None, -1])
def test_repair_is_seeded_and_valid(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(scale, "BROADCAST_BYTES", limit)
    rows, df = answers(spark)
    fixed = labels.repair_answers(df)
    assert fixed.columns == df.columns
    assert {r.id: r.response for r in fixed.collect()} == repaired(rows)
    assert {r.id: r.response for r in labels.repair_answers(df, seed=7).collect()} == repaired(rows, 7)


def test_codes_follow_code_points(spark):
    rows = [("1", "en", "d", o, r) for o, r in (("b", "é"), ("Z", "b"), ("é", "none"), ("b", "Z"))]
    df = spark.createDataFrame(rows, ANSWERS)
    got = labels.encode_labels(df).select("output", "output_code", "response_code").collect()
    assert {(r.output, r.output_code, r.response_code) for r in got} == {
        ("b", 1, 2), ("Z", 0, 1), ("é", 2, None), ("b", 1, 0),
    }


def test_single_label_metrics(spark):
    rows, df = answers(spark)
    fixed = repaired(rows)
    counts = metrics.confusion_counts(labels.repair_answers(df))
    assert counts.agg(F.sum("n")).first()[0] == len(rows)
    wide = {r.dataset: r for r in metrics.single_label_metrics(counts).collect()}
    report = metrics.full_report(metrics.class_report(metrics.class_counts(counts))).collect()
    for dataset in ("d1", "d2"):
        table, expected = score_single([(r[3], fixed[r[0]]) for r in rows if r[2] == dataset])
        for name, value in expected.items():
            assert wide[dataset][name] == pytest.approx(value), name
        mine = {(r.kind, r.label): r for r in report if r.dataset == dataset}
        assert {label for kind, label in mine if kind == "class"} == set(table)
        for label, (p, r, f, support) in table.items():
            row = mine["class", label]
            assert (row.precision, row.recall, row.f1, row.support) == pytest.approx((p, r, f, support))
        assert mine["summary", "macro avg"].f1 == pytest.approx(expected["f1_macro"])
        assert mine["summary", "weighted avg"].recall == pytest.approx(expected["recall_weighted"])
        assert mine["summary", "accuracy"].f1 == pytest.approx(expected["accuracy"])


def test_a_class_that_is_never_predicted_scores_zero(spark):
    rows = [("1", "en", "d", "a", "a"), ("2", "en", "d", "b", "a")]
    counts = metrics.confusion_counts(spark.createDataFrame(rows, ANSWERS))
    report = {r.label: r for r in metrics.class_report(metrics.class_counts(counts)).collect()}
    assert (report["b"].precision, report["b"].recall, report["b"].f1) == (0.0, 0.0, 0.0)
    cells = {(r.label, r.predicted): r.n for r in metrics.confusion_matrix(counts).collect()}
    assert cells == {("a", "a"): 1, ("a", "b"): 0, ("b", "a"): 1, ("b", "b"): 0}
    nested = metrics.confusion_matrix(counts, nested=True).first()
    assert nested.labels == ["a", "b"] and nested.confusion_matrix == [[1, 0], [1, 0]]


def test_translation_passes_unknown_labels(spark):
    table = spark.createDataFrame([("لا", "no"), ("True", "yes"), ("true", "TRUE")], "native string, english string")
    rows = spark.createDataFrame([("لا",), ("True",), ("true",), ("other",), (None,)], "output string")
    got = labels.translate_labels(rows, table).collect()
    assert {r.output: r.output_en for r in got} == {
        "لا": "no", "True": "yes", "true": "TRUE", "other": "other", None: None,
    }


@pytest.mark.parametrize("limit", [None, -1])
def test_instruction_assignment(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(scale, "BROADCAST_BYTES", limit)
    bank = spark.createDataFrame(
        [("d", 0, "first"), ("d", 1, "second"), ("e", 0, "only")], "dataset string, variant int, instruction string"
    )
    rows = [(str(i), "def"[i % 3], "own") for i in range(60)]
    got = labels.assign_instructions(spark.createDataFrame(rows, "id string, dataset string, instruction string"), bank)
    for row in got.collect():
        want = {"d": ["first", "second"][key(42, row.id) % 2], "e": "only", "f": "own"}[row.dataset]
        assert row.instruction == want


def test_registry_needs_dataset_and_language(spark):
    registry = spark.createDataFrame(
        [("x", "en", "Summarization", "Sum up.", None), ("x", "ar", "Other", "Tell.", ["a"])],
        "dataset string, lang string, task string, task_definition string, labels array<string>",
    )
    rows = spark.createDataFrame([("1", "x", "ar"), ("2", "x", "hi")], "id string, dataset string, lang string")
    got = {r.id: r for r in labels.enrich(rows, registry).collect()}
    assert (got["1"].task, got["1"].labels) == ("Other", ["a"])
    assert (got["2"].task, got["2"].labels) == (None, None)


def score_multi(rows):
    classes = sorted({x for t, _ in rows for x in t})
    known = [(set(t), set(p) & set(classes)) for t, p in rows]
    table = {}
    for c in classes:
        tp = sum(c in t and c in p for t, p in known)
        support, predicted = sum(c in t for t, _ in known), sum(c in p for _, p in known)
        table[c] = (div(tp, predicted), div(tp, support), div(2 * tp, support + predicted), support, tp, predicted)
    total = sum(r[3] for r in table.values())
    tp, predicted = sum(r[4] for r in table.values()), sum(r[5] for r in table.values())
    n = len(rows)
    return table, {
        "micro avg": (div(tp, predicted), div(tp, total), div(2 * tp, total + predicted)),
        "macro avg": tuple(sum(r[i] for r in table.values()) / len(table) for i in range(3)),
        "weighted avg": tuple(sum(r[i] * r[3] for r in table.values()) / total for i in range(3)),
        "samples avg": (
            sum(div(len(t & p), len(p)) for t, p in known) / n,
            sum(div(len(t & p), len(t)) for t, p in known) / n,
            sum(div(2 * len(t & p), len(t) + len(p)) for t, p in known) / n,
        ),
    }, sum(t == p for t, p in known) / n


def test_multi_label_metrics(spark):
    draw = random.Random(3)
    rows = []
    for i in range(200):
        truth = draw.sample(["hate", "fake", "abuse", "none"], draw.randint(1, 3))
        answer = draw.sample(["hate", "fake", "abuse", "junk", ""], draw.randint(1, 3))
        rows.append((str(i), "hi", "Hostility", truth, answer))
    df = spark.createDataFrame(
        [(i, lang, d, " , ".join(t), ",".join(a)) for i, lang, d, t, a in rows], ANSWERS
    )
    counts = evaluation.multi_counts(records.clean_answers(df), ["lang", "dataset"])
    table, summary, exact = score_multi([(t, a) for *_, t, a in rows])
    wide = metrics.multi_label_metrics(counts).first()
    assert wide.accuracy == pytest.approx(exact)
    assert (wide.f1_micro, wide.f1_macro, wide.f1_weighted) == pytest.approx(
        (summary["micro avg"][2], summary["macro avg"][2], summary["weighted avg"][2])
    )
    report = {(r.kind, r.label): r for r in metrics.multi_label_report(counts).collect()}
    assert {label for kind, label in report if kind == "class"} == set(table)
    for label, expected in table.items():
        row = report["class", label]
        assert (row.precision, row.recall, row.f1, row.support) == pytest.approx(expected[:4])
    for label, expected in summary.items():
        row = report["summary", label]
        assert (row.precision, row.recall, row.f1) == pytest.approx(expected), label


def test_unknown_labels_vanish_and_order_does_not_matter(spark):
    rows = [("1", "hi", "Hostility", "hate", "hate,junk"), ("2", "hi", "Hostility", "a,b", "b, a, a"),
            ("3", "hi", "Hostility", "a", "")]
    df = spark.createDataFrame(rows, ANSWERS)
    counts = evaluation.multi_counts(records.clean_answers(df), ["lang", "dataset"])
    assert metrics.multi_label_metrics(counts).first().accuracy == pytest.approx(2 / 3)


def test_routing(spark):
    names = ["Hostility xlsum", "hostility", "my-xlsum", "ArPro"]
    rows = spark.createDataFrame([(n,) for n in names], "dataset string")
    got = [r.k for r in rows.select(metrics.metric_kind().alias("k")).collect()]
    assert got == ["multi_label", "single_label", "rouge", "single_label"]


def test_evaluate_covers_every_dataset_and_documents_agree(spark):
    single, df = answers(spark)
    more = spark.createDataFrame(
        [("m1", "hi", "Hostility 2", "a, b", "a"), ("m2", "hi", "Hostility 2", "a", "a"),
         ("s1", "en", "xlsum", "the cat sat", "the cat"), ("s2", "en", "xlsum", "x", None)], ANSWERS
    )
    both = df.unionByName(more)
    long = {(r.dataset, r.metric): r.value for r in evaluation.evaluate(both).collect()}
    assert len({d for d, _ in long}) == 4 and len(long) == 10 + 10 + 4 + 4
    assert long["xlsum", "rouge1"] == pytest.approx(40.0) and long["xlsum", "rougeL"] == pytest.approx(40.0)
    assert long["d1", "f1_micro"] == pytest.approx(long["d1", "accuracy"])
    documents = {
        r.dataset: json.loads(r.text)
        for r in evaluation.metrics_documents(both).select("dataset", F.to_json("document").alias("text")).collect()
    }
    assert set(documents) == {"d1", "d2", "Hostility 2", "xlsum"}
    for (dataset, metric), value in long.items():
        assert documents[dataset][metric] == pytest.approx(value), (dataset, metric)
    d1 = documents["d1"]
    assert set(d1["classification_report"]) == {"a", "b", "c", "d", "accuracy", "macro avg", "weighted avg"}
    assert d1["classification_report"]["a"].keys() == {"precision", "recall", "f1-score", "support"}
    assert sum(map(sum, d1["confusion_matrix"])) == sum(r[2] == "d1" for r in single)
    assert {"a", "b", "micro avg", "macro avg", "weighted avg", "samples avg"} < set(documents["Hostility 2"])


def test_cells_are_bounded_by_what_is_observed(spark):
    counts = spark.range(10_000).select(
        F.lit("en").alias("lang"), F.lit("d").alias("dataset"), F.col("id").cast("string").alias("label"),
        F.when(F.col("id") % 2 == 0, "0").alias("predicted"), F.lit(3).cast("bigint").alias("n"),
    )
    got = metrics.confusion_cells(counts).collect()
    assert len(got) == 10_000 and {r.of_label for r in got} == {3}
    assert {(r.predicted, r.of_predicted) for r in got} == {("0", 15_000), (None, 15_000)}


def test_binarizing_looks_labels_up_one_by_one(spark):
    rows = [("en", "d", ["a", "b"], ["b", "x", "a"]), ("en", "d", ["c"], ["a", "c", "y", "x"]), ("en", "e", ["x"], ["x", "a"]),
            (None, "d", ["x"], ["a", "x"]), ("en", "d", ["a"], [])]
    df = spark.createDataFrame(rows, "lang string, dataset string, output array<string>, response array<string>")
    got = metrics.binarize(df)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert [tuple(r) for r in sorted(got.collect(), key=str)] == sorted([
        ("en", "d", ["a", "b"], ["b", "a"]), ("en", "d", ["c"], ["a", "c"]), ("en", "e", ["x"], ["x"]), (None, "d", ["x"], ["x"]),
        ("en", "d", ["a"], []),
    ], key=str)


def test_an_evaluation_reads_its_input_once(spark):
    """Rows are counted as they leave the input; whatever comes after reads thin rows."""
    rows = [(str(i), "en", "plain", "a" if i % 2 else "b", "a" if i % 3 else "junk") for i in range(40)]
    rows += [(str(i), "en", "Hostility", "a,b" if i % 2 else "a", "a, x" if i % 3 else "b,zz") for i in range(40)]
    rows += [(str(i), "en", "xlsum", "one two", "two one") for i in range(20)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        seen.add(1)
        return value

    df = spark.createDataFrame(rows, "id string, lang string, dataset string, output string, response string")
    got = evaluation.evaluate(df.withColumn("response", counted.asNondeterministic()("response"))).collect()
    assert seen.value == 100
    values = {(r.dataset, r.metric): r.value for r in got}
    counts = metrics.confusion_counts(labels.repair_answers(records.clean_answers(df.where("dataset = 'plain'"))))
    assert values["plain", "accuracy"] == metrics.single_label_metrics(counts).first().accuracy
    many = evaluation.multi_counts(records.clean_answers(df.where("dataset = 'Hostility'")), ["lang", "dataset"])
    wide = metrics.multi_label_metrics(many).first()
    for name in evaluation.MULTI:
        assert values["Hostility", name] == pytest.approx(wide[name])
    assert values["xlsum", "rouge1"] == 100.0


def test_facts_of_groups_that_are_null_and_of_nothing(spark):
    ddl = "id string, lang string, dataset string, output string, response string"
    rows = [("1", None, "Hostility", "a,b", "a,c"), ("2", None, "Hostility", "c", None), (None, "en", "plain", None, "x")]
    got = evaluation.evaluate(spark.createDataFrame(rows, ddl)).collect()
    assert {(r.lang, r.dataset) for r in got} == {(None, "Hostility"), ("en", "plain")}
    values = {(r.dataset, r.metric): r.value for r in got}
    # True a, b against a, c; true c against the answer "none", which no row has.
    assert values["Hostility", "f1_micro"] == pytest.approx(2 * 1 / (3 + 2))
    assert evaluation.evaluate(spark.createDataFrame([], ddl)).collect() == []


def test_each_kind_is_summed_from_its_own_rows(spark, monkeypatch):
    """Only summaries reach the step in Python, once their rows are staged; no row is expanded into all sums."""
    ddl = "id string, lang string, dataset string, output string, response string"
    rows = [(str(i), "en", "plain", "a" if i % 2 else "b", "a" if i % 3 else "junk") for i in range(12)]
    rows += [("m1", "en", "Hostility", "a,b", "b, zz"), ("m2", "en", "Hostility", "b", "b,a"), ("m3", "en", "Hostility", "c", None)]
    rows += [("s1", "en", "xlsum", "one two", "two one"), ("s2", "en", "xlsum", None, "one"), (None, None, "xlsum", "", "")]
    scored, plans = [], []
    scores, settle = evaluation.rouge.rouge_scores, evaluation.settle
    monkeypatch.setattr(evaluation.rouge, "rouge_scores", lambda df, *a, **k: scored.append(df) or scores(df, *a, **k))
    monkeypatch.setattr(evaluation, "settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or settle(df))
    staged = evaluation.routed(spark.createDataFrame(rows, ddl))
    found = evaluation.facts(staged).collect()
    assert {r.kind for df in scored for r in df.collect()} == {"rouge"}
    assert "inline" not in plans[-1]
    texts = staged.where("kind = 'rouge'").select("reference", "candidate").collect()
    assert sorted(map(tuple, texts)) == [("", ""), ("none", "one"), ("one two", "two one")]
    keyed = {(r.lang, r.dataset, r.label, r.answer): r for r in found}
    assert len(keyed) == len(found)
    assert sum(r.n for r in found if r.kind == "single_label") == 12
    b = keyed["en", "Hostility", "b", None]
    assert (b.n, b.predicted, b.tp) == (2, 2, 2)
    a = keyed["en", "Hostility", "a", None]
    assert (a.n, a.predicted, a.tp) == (1, 1, 0)
    own = keyed["en", "Hostility", None, None]
    assert (own.n, own.exact, own.row_precision, own.row_recall) == (3, 0, 1.5, 1.5)
    assert keyed["en", "xlsum", None, None].rouge1 == 100.0 and keyed[None, "xlsum", None, None].n == 1


def test_staged_answers_are_removed_once_they_are_summed(spark, monkeypatch):
    kept, stage = [], evaluation.stage
    monkeypatch.setattr(evaluation, "stage", lambda *a: kept.append(stage(*a)) or kept[-1])
    rows = [("1", "en", "plain", "a", "a"), ("2", "en", "xlsum", "one two", "one")]
    got = evaluation.evaluate(spark.createDataFrame(rows, ANSWERS))
    files = kept[0].inputFiles()
    assert files and not any(Path(f.removeprefix("file:").replace("///", "/")).exists() for f in files)
    assert {(r.dataset, r.metric): r.value for r in got.collect()}["xlsum", "rouge1"] == pytest.approx(66.67)
