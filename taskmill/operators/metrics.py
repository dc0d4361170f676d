"""Single-label and multi-label metrics of many datasets in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskmill.operators.labels import distinct_labels
from taskmill.scale import at_rest, lookup, settle, stage
from taskmill.schema import DATASET_KEY

# The parts of a dataset name that decide its metrics, case-sensitive.
MULTI_LABEL_NAME = "Hostility"
ROUGE_NAME = "xlsum"


def metric_kind(dataset: str = "dataset") -> Column:
    """Which metrics a dataset gets, by its name."""
    return (
        F.when(F.col(dataset).contains(MULTI_LABEL_NAME), "multi_label")
        .when(F.col(dataset).contains(ROUGE_NAME), "rouge")
        .otherwise("single_label")
    )


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """A quotient that is 0 where the denominator is 0."""
    top = F.col(numerator) if isinstance(numerator, str) else numerator
    bottom = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def confusion_counts(df: DataFrame, by: Sequence[str] = tuple(DATASET_KEY)) -> DataFrame:
    """Rows per true and predicted label: all single-label metrics follow from this table."""
    return df.groupBy(
        *by, F.col("output").alias("label"), F.col("response").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    counts: DataFrame, by: Sequence[str] = tuple(DATASET_KEY), nested: bool = False
) -> DataFrame:
    """Counts for every true and predicted label of a dataset, zeros included, labels sorted.

    Long format, or with ``nested`` one matrix per dataset (rows are true labels).
    """
    by = list(by)
    counts = settle(counts)
    zero = F.lit(0).cast("bigint")
    sides = F.array("label", "predicted")
    labels = counts.select(*by, F.explode(sides).alias("label")).distinct()
    classes = labels.groupBy(*by).agg(F.sort_array(F.collect_set("label")).alias("classes"))
    cells = counts.groupBy(*by, "label").agg(
        F.map_from_entries(F.collect_list(F.struct("predicted", "n"))).alias("cells")
    )
    rows = labels.join(cells, by + ["label"], "left").join(classes, by)

    def value(p: Column) -> Column:
        return F.coalesce(F.try_element_at("cells", p), zero)

    if not nested:
        pairs = F.transform("classes", lambda p: F.struct(p.alias("predicted"), value(p).alias("n")))
        return rows.select(*by, "label", F.inline(pairs))
    row = F.struct("label", F.transform("classes", value).alias("counts"))
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("rows")).select(
        *by,
        F.transform("rows", lambda r: r["label"]).alias("labels"),
        F.transform("rows", lambda r: r["counts"]).alias("confusion_matrix"),
    )


def confusion_cells(counts: DataFrame, by: Sequence[str] = tuple(DATASET_KEY)) -> DataFrame:
    """The confusion matrix as its observed cells, with the sums of their row and column.

    As many rows as pairs of labels occur together, however many labels a dataset has.
    """
    by = list(by)
    counts = counts if at_rest(counts) else settle(counts)
    of_label = counts.groupBy(*by, "label").agg(F.sum("n").alias("of_label"))
    of_predicted = counts.groupBy(*by, "predicted").agg(F.sum("n").alias("of_predicted"))
    cells = lookup(counts, of_label, [*by, "label"], null_safe=True)
    return lookup(cells, of_predicted, [*by, "predicted"], null_safe=True)


def class_counts(counts: DataFrame, by: Sequence[str] = tuple(DATASET_KEY)) -> DataFrame:
    """True, predicted and correct counts per class, in one aggregation of the confusion counts."""
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    correct = F.when(F.col("label") == F.col("predicted"), n).otherwise(zero)
    sides = F.array(
        F.struct(F.col("label"), n.alias("support"), zero.alias("predicted"), correct.alias("tp")),
        F.struct(F.col("predicted").alias("label"), zero.alias("support"), n.alias("predicted"), zero.alias("tp")),
    )
    return (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    )


def class_report(classes: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class."""
    return classes.withColumns(
        {
            "precision": ratio("tp", "predicted"),
            "recall": ratio("tp", "support"),
            "f1": ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")),
        }
    )


def averages(report: DataFrame, by: Sequence[str] = tuple(DATASET_KEY)) -> DataFrame:
    """Macro, micro and support-weighted precision, recall and F1 of each dataset."""
    tp, support, predicted = F.sum("tp"), F.sum("support"), F.sum("predicted")
    measures = ("precision", "recall", "f1")
    return report.groupBy(*by).agg(
        *[F.avg(m).alias(f"{m}_macro") for m in measures],
        ratio(tp, predicted).alias("precision_micro"),
        ratio(tp, support).alias("recall_micro"),
        ratio(2 * tp, support + predicted).alias("f1_micro"),
        *[ratio(F.sum(F.col(m) * F.col("support")), support).alias(f"{m}_weighted") for m in measures],
        support.alias("support"),
    )


def single_label_metrics(counts: DataFrame, by: Sequence[str] = tuple(DATASET_KEY)) -> DataFrame:
    """Accuracy and the nine averaged measures, one row per dataset."""
    wide = averages(class_report(class_counts(counts, by)), by)
    # Every row has one true and one predicted label, so recall over all rows is the accuracy.
    return wide.withColumn("accuracy", F.col("recall_micro"))


def full_report(report: DataFrame, by: Sequence[str] = tuple(DATASET_KEY)) -> DataFrame:
    """The class rows with the summary rows ``accuracy``, ``macro avg`` and ``weighted avg``."""
    report = settle(report)
    wide = averages(report, by)
    columns = ["kind", "label", "precision", "recall", "f1", "support"]

    def summary(name: str, suffix: str) -> Column:
        return F.struct(
            F.lit("summary").alias("kind"),
            F.lit(name).alias("label"),
            *[F.col(f"{m}_{suffix}").alias(m) for m in ("precision", "recall", "f1")],
            F.col("support"),
        )

    rows = [summary("accuracy", "micro"), summary("macro avg", "macro"), summary("weighted avg", "weighted")]
    summaries = wide.select(*by, F.inline(F.array(*rows)))
    classes = report.withColumn("kind", F.lit("class")).select(*by, *columns)
    return classes.unionByName(summaries)


def binarize(df: DataFrame, by: Sequence[str] = tuple(DATASET_KEY)) -> DataFrame:
    """Reduce the label sets of a row to the classes of its dataset.

    Classes are the labels of the true sets; a predicted label outside them is dropped. The
    rows stay sparse: two label arrays instead of one column per class. Only predicted labels that are not
    true in their own row are looked up, one by one, and only rows with unknown ones are changed.
    """
    by = list(by)
    rows = stage(df.withColumn("__row", F.monotonically_increasing_id()), "labels")
    classes = settle(distinct_labels(rows.select(*by, F.explode("output").alias("output")), by))
    others = rows.select(*by, "__row", F.explode(F.array_except("response", "output")).alias("label"))
    unknown = lookup(others, classes, [*by, "label"], "left_anti", null_safe=True)
    of_row = unknown.groupBy("__row").agg(F.collect_set("label").alias("__unknown"))
    none = F.array().cast("array<string>")
    response = F.array_except("response", F.coalesce("__unknown", none))
    return lookup(rows, of_row, ["__row"]).withColumn("response", response).select(*df.columns)


def multi_label_counts(df: DataFrame, by: Sequence[str] = tuple(DATASET_KEY)) -> DataFrame:
    """Counts per class and, under a null label, sums over the rows; one pass, one aggregation."""
    true, answer = F.col("output"), F.col("response")
    df = df.withColumn("__hits", F.size(F.array_intersect(true, answer)))
    hits = F.col("__hits")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    none = F.lit(0.0)

    def entry(label, support, predicted, tp, rows=zero, exact=zero, p=none, r=none, f=none):
        return F.struct(
            label.alias("label"), support.alias("support"), predicted.alias("predicted"),
            tp.alias("tp"), rows.alias("rows"), exact.alias("exact"),
            p.alias("row_precision"), r.alias("row_recall"), f.alias("row_f1"),
        )

    entries = F.concat(
        F.transform(
            true,
            lambda x: entry(
                x, one, F.array_contains(answer, x).cast("bigint"), F.array_contains(answer, x).cast("bigint")
            ),
        ),
        F.transform(F.array_except(answer, true), lambda x: entry(x, zero, one, zero)),
        F.array(
            entry(
                F.lit(None).cast("string"), zero, zero, zero, one,
                ((hits == F.size(true)) & (hits == F.size(answer))).cast("bigint"),
                ratio(hits, F.size(answer)), ratio(hits, F.size(true)),
                ratio(2 * hits, F.size(true) + F.size(answer)),
            )
        ),
    )
    sums = ("support", "predicted", "tp", "rows", "exact", "row_precision", "row_recall", "row_f1")
    return (
        df.select(*by, F.inline(entries))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )


def multi_label_report(counts: DataFrame, by: Sequence[str] = tuple(DATASET_KEY)) -> DataFrame:
    """Class rows with ``micro avg``, ``macro avg``, ``weighted avg`` and ``samples avg``."""
    counts = settle(counts)
    report = class_report(counts.where("label is not null"))
    wide = _multi_label_wide(counts, by)
    measures = ("precision", "recall", "f1")

    def summary(suffix: str) -> Column:
        return F.struct(
            F.lit("summary").alias("kind"),
            F.lit(f"{suffix} avg").alias("label"),
            *[F.col(f"{m}_{suffix}").alias(m) for m in measures],
            F.col("support"),
        )

    rows = [summary(s) for s in ("micro", "macro", "weighted", "samples")]
    summaries = wide.select(*by, F.inline(F.array(*rows)))
    classes = report.withColumn("kind", F.lit("class")).select(
        *by, "kind", "label", *measures, "support"
    )
    return classes.unionByName(summaries)


def multi_label_metrics(counts: DataFrame, by: Sequence[str] = tuple(DATASET_KEY)) -> DataFrame:
    """F1 micro, macro and weighted, and subset accuracy, one row per dataset."""
    wide = _multi_label_wide(counts, by)
    return wide.select(*by, "f1_micro", "f1_macro", "f1_weighted", "accuracy")


def _multi_label_wide(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    report = class_report(counts).withColumns(
        {m: F.when(F.col("label").isNotNull(), F.col(m)) for m in ("precision", "recall", "f1")}
    )
    tp, support, predicted, rows = F.sum("tp"), F.sum("support"), F.sum("predicted"), F.sum("rows")
    measures = ("precision", "recall", "f1")
    return report.groupBy(*by).agg(
        *[F.avg(m).alias(f"{m}_macro") for m in measures],
        ratio(tp, predicted).alias("precision_micro"),
        ratio(tp, support).alias("recall_micro"),
        ratio(2 * tp, support + predicted).alias("f1_micro"),
        *[
            ratio(F.sum(F.col(m) * F.col("support")), support).alias(f"{m}_weighted")
            for m in measures
        ],
        *[ratio(F.sum(f"row_{m}"), rows).alias(f"{m}_samples") for m in measures],
        ratio(F.sum("exact"), rows).alias("accuracy"),
        support.alias("support"),
    )
