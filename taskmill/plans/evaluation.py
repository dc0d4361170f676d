"""Evaluate every dataset of an experiment in one go."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskmill.functions.text import label_set
from taskmill.operators import metrics, rouge
from taskmill.operators.labels import label_codes, repair_answers
from taskmill.operators.records import clean_answers, split_labels
from taskmill.scale import cleared, discard, lookup, settle, stage
from taskmill.schema import DATASET_KEY
from taskmill.sources.results import read_results, write_metrics

SINGLE = ("accuracy",) + tuple(
    f"{m}_{a}" for a in ("macro", "micro", "weighted") for m in ("precision", "recall", "f1")
)
MULTI = ("f1_micro", "f1_macro", "f1_weighted", "accuracy")
# Names of the summary rows of a report; a class of the same name gives way to them.
SINGLE_SUMMARY = ("accuracy", "macro avg", "weighted avg")
MULTI_SUMMARY = ("micro avg", "macro avg", "weighted avg", "samples avg", *MULTI)
# What is summed per group, kind, label and answer; all metrics follow from these sums.
SUMS = ("n", "predicted", "tp", "exact", "row_precision", "row_recall", "row_f1", *rouge.KEYS)
COUNTS = ("n", "predicted", "tp", "exact")


def multi_counts(cleaned: DataFrame, by: Sequence[str]) -> DataFrame:
    """Class and row sums of multi-label datasets."""
    rows = cleaned.where(metrics.metric_kind() == "multi_label").select(*by, "output", "response")
    return metrics.multi_label_counts(metrics.binarize(split_labels(rows), by), by)


def routed(df: DataFrame, by: Sequence[str] = tuple(DATASET_KEY)) -> DataFrame:
    """The one pass over the answers: each row with what the metrics of its dataset need, staged.

    Single-label rows keep their cleaned labels and id, multi-label rows their label sets, summaries their
    texts. Each in columns of its own, so what comes after reads the rows and columns of one kind.
    """
    kind = metrics.metric_kind()

    def of(name: str, value: Column) -> Column:
        return F.when(kind == name, value)

    answers = {"output": F.col("output"), "response": F.col("response")}
    rows = clean_answers(df).select(
        *by, kind.alias("kind"),
        of("single_label", F.col("id").cast("string")).alias("id"),
        *[of("single_label", c).alias(n) for n, c in answers.items()],
        of("multi_label", F.monotonically_increasing_id()).alias("row"),
        *[of("multi_label", label_set(c)).alias(n) for n, c in zip(("truths", "guesses"), answers.values())],
        *[of("rouge", c).alias(n) for n, c in zip(("reference", "candidate"), answers.values())],
    )
    return stage(rows, "routed")


def facts(rows: DataFrame, by: Sequence[str] = tuple(DATASET_KEY), seed: int = 42) -> DataFrame:
    """Sums per group, kind, label and answer of all kinds, each kind in an aggregation of its own rows.

    A single-label row counts at its true label and its answer, repaired if it is none of the labels. A
    multi-label row counts at each of its true labels, and at each further label it names that some row
    of its dataset truly has; under a null label it adds its own scores. So does a summary.
    """
    by = list(by)
    single, multi, summaries = (rows.where(F.col("kind") == name) for name in ("single_label", "multi_label", "rouge"))
    labelled = single.select(*by, "output").unionByName(multi.select(*by, F.explode("truths").alias("output")))
    codes = settle(label_codes(labelled, by))

    # Further labels of a row, if their dataset knows them: most rows have none, and do not move.
    others = multi.select(*by, "row", F.explode(F.array_except("guesses", "truths")).alias("label"))
    others = settle(lookup(others, codes.select(*by, "label"), [*by, "label"], "left_semi", null_safe=True))
    more = settle(others.groupBy("row").agg(F.count(F.lit(1)).alias("more")))

    one, no = F.lit(1), F.lit(0)
    repaired = repair_answers(single, seed, by, labels=codes)
    pairs = repaired.groupBy(*by, F.col("output").alias("label"), F.col("response").alias("answer")).agg(F.count(one).alias("n"))

    of_class = multi.select(*by, "guesses", F.explode("truths").alias("label"))
    hit = F.array_contains("guesses", F.col("label")).cast("int")
    classes = of_class.select(*by, "label", one.alias("n"), hit.alias("predicted"), hit.alias("tp")).unionByName(
        others.select(*by, "label", no.alias("n"), one.alias("predicted"), no.alias("tp"))
    ).groupBy(*by, "label").agg(*[F.sum(n).alias(n) for n in ("n", "predicted", "tp")])

    sizes = lookup(multi, more, ["row"]).select(
        *by, F.size("truths").alias("true"), F.size(F.array_intersect("truths", "guesses")).alias("hits"),
        F.coalesce("more", no).alias("more"),
    )
    true, hits, named = F.col("true"), F.col("hits"), F.col("hits") + F.col("more")
    scores = sizes.groupBy(*by).agg(
        F.count(one).alias("n"), F.sum(((hits == true) & (hits == named)).cast("int")).alias("exact"),
        F.sum(metrics.ratio(hits, named)).alias("row_precision"), F.sum(metrics.ratio(hits, true)).alias("row_recall"),
        F.sum(metrics.ratio(2 * hits, true + named)).alias("row_f1"),
    )

    scored = rouge.rouge_scores(summaries, reference="reference", candidate="candidate")
    overlaps = scored.groupBy(*by).agg(F.count(one).alias("n"), *[F.sum(k).alias(k) for k in rouge.KEYS])

    def wide(found: DataFrame, kind: str) -> DataFrame:
        none = {n: F.lit(None).cast("string") for n in ("label", "answer")}
        zero = {n: no.cast("bigint") if n in COUNTS else F.lit(0.0) for n in SUMS}
        absent = {n: c for n, c in {**none, **zero}.items() if n not in found.columns}
        return found.withColumns({"kind": F.lit(kind), **absent}).select(*by, "kind", "label", "answer", *SUMS)

    found = [wide(pairs, "single_label"), wide(classes, "multi_label"), wide(scores, "multi_label"), wide(overlaps, "rouge")]
    return settle(reduce(DataFrame.unionByName, found))


def _sums(df: DataFrame, by: list[str], seed: int) -> DataFrame:
    """The facts of the answers; what was staged for them, texts among it, is removed."""
    rows = routed(df, by)
    found = facts(rows, by, seed)
    discard(rows)
    return found


def _single(found: DataFrame, by: list[str]) -> DataFrame:
    """Confusion counts."""
    return found.where("kind = 'single_label'").select(*by, "label", F.col("answer").alias("predicted"), "n")


def _multi(found: DataFrame, by: list[str]) -> DataFrame:
    """Class sums and, under a null label, row sums."""
    of_class = F.col("label").isNotNull()
    return found.where("kind = 'multi_label'").select(
        *by, "label", F.when(of_class, F.col("n")).otherwise(0).alias("support"), "predicted", "tp",
        F.when(of_class, 0).otherwise(F.col("n")).alias("rows"), "exact", "row_precision", "row_recall", "row_f1",
    )


def _summaries(found: DataFrame, by: list[str]) -> DataFrame:
    return found.where("kind = 'rouge'").select(*by, *[(F.col(k) / F.col("n")).alias(k) for k in rouge.KEYS])


def evaluate(df: DataFrame, by: Sequence[str] = tuple(DATASET_KEY), seed: int = 42) -> DataFrame:
    """All metrics of all datasets in long form: the group, ``metric`` and ``value``. The input is read once."""
    by = list(by)
    found = _sums(df, by, seed)
    frames = [
        _long(metrics.single_label_metrics(_single(found, by), by), by, SINGLE),
        _long(metrics.multi_label_metrics(_multi(found, by), by), by, MULTI),
        _long(_summaries(found, by), by, rouge.KEYS),
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def _long(wide: DataFrame, by: list[str], names: Sequence[str]) -> DataFrame:
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]
    return wide.select(*by, F.inline(F.array(*pairs)))


def _member(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _numbers(names: Sequence[str]) -> Column:
    """Some columns as members of a document."""
    return F.array(*[_member(F.lit(n), F.col(n).cast("variant")) for n in names])


def _report(report: DataFrame, by: list[str], summary: Sequence[str]) -> DataFrame:
    """Report rows as members of a document, ``report``: classes first, then the summary rows."""
    report = report.where((F.col("kind") != "class") | ~F.coalesce(F.col("label").isin(*summary), F.lit(False)))
    row = F.struct("precision", "recall", F.col("f1").alias("f1-score"), "support")
    ordered = F.sort_array(F.collect_list(F.struct("kind", "label", row.alias("row"))))
    members = F.transform("rows", lambda r: _member(r["label"], F.to_variant_object(r["row"])))
    return report.groupBy(*by).agg(ordered.alias("rows")).select(*by, members.alias("report"))


def metrics_documents(df: DataFrame, by: Sequence[str] = tuple(DATASET_KEY), seed: int = 42) -> DataFrame:
    """One metrics document per dataset: columns of the group and ``document``, a map of variants.

    Single-label documents hold the averages, ``confusion_matrix`` (rows are true labels, sorted) and
    ``classification_report``; multi-label documents the report rows and the averages beside each other;
    summaries the ROUGE scores.
    """
    by = list(by)
    found = _sums(df, by, seed)

    counts = _single(found, by)
    report = metrics.full_report(metrics.class_report(metrics.class_counts(counts, by)), by).where("label <> 'accuracy'")
    matrix = metrics.confusion_matrix(counts, by, nested=True).select(*by, "confusion_matrix")
    wide = metrics.single_label_metrics(counts, by).join(matrix, by).join(_report(report, by, SINGLE_SUMMARY), by)
    nested = F.map_from_entries(F.concat("report", F.array(_member(F.lit("accuracy"), F.col("accuracy").cast("variant")))))
    single = wide.select(*by, F.map_from_entries(F.concat(_numbers(SINGLE), F.array(
        _member(F.lit("confusion_matrix"), F.to_variant_object("confusion_matrix")),
        _member(F.lit("classification_report"), F.to_variant_object(nested)),
    ))).alias("document"))

    many = _multi(found, by)
    rows = _report(metrics.multi_label_report(many, by), by, MULTI_SUMMARY)
    multi = metrics.multi_label_metrics(many, by).join(rows, by).select(
        *by, F.map_from_entries(F.concat("report", _numbers(MULTI))).alias("document")
    )
    summaries = _summaries(found, by).select(*by, F.map_from_entries(_numbers(rouge.KEYS)).alias("document"))
    return single.unionByName(multi).unionByName(summaries)


def evaluate_experiment(
    spark: SparkSession, experiment_dir: str, output_dir: str, layout: str = "objects", seed: int = 42
) -> DataFrame:
    """Read an experiment, write a metrics document per dataset; returns the quarantined records.

    The JSON is parsed once, for one pass that stages what the metrics need; all of them come from that.
    """
    good, bad = read_results(spark, experiment_dir, layout)
    with cleared(spark):
        documents = metrics_documents(good, ["experiment", "lang", "dataset"], seed)
        write_metrics(documents, output_dir)
    return bad
