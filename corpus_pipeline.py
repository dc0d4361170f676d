"""From raw documents to token ids: language, copies, repeated passages, benchmark passages, encoding.

Every stage takes the documents its predecessor wrote and returns documents again, the last one ids. A
document is a row: ids may be null or repeat, and documents are told apart by a number that a stage gives
them itself. Null and empty texts have no language and go in the first stage; an empty table stays empty;
other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskmill.llm import language_spans
from taskmill.llm.common import MODEL, free_names
from taskmill.llm.dart_minhash import near_duplicates
from taskmill.llm.decontamination import contaminated, decontaminate
from taskmill.llm.repeats import remove_repeats
from taskmill.llm.sentencepiece_lattice import encode, load_pieces
from taskmill.scale import cleared, lookup, scratch, stage

# A text whose leading language has fewer words than this share, or loses to another overall, goes.
LEAST_SCORE = 0.2


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number each, written so that every reader sees the same numbers."""
    (row,) = free_names(docs, "row")
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _without(rows: DataFrame, row: str, found: Callable[[], DataFrame]) -> DataFrame:
    """The documents whose number is not among those found; what finding them left on disk is removed at once."""
    spark = rows.sparkSession
    path = scratch(spark, "gone")
    with cleared(spark):
        found().select(row).write.parquet(path)
    return lookup(rows, spark.read.schema(rows.select(row).schema).parquet(path), [row], "left_anti").drop(row)


def _packed(docs: DataFrame, *names: str) -> tuple[DataFrame, str]:
    """Some columns, and all of them but the text in one whose name is none of theirs."""
    (whole,) = free_names(docs, "document")
    return docs.select(*names, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias(whole)), whole


def _unpacked(docs: DataFrame, whole: str, **new: Column) -> list[Column]:
    """The columns of documents in their order, some of them anew."""
    return [new.get(c, F.col(f"`{whole}`.`{c}`")).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language; a missing language is filled in."""
    model = language_spans.fit(docs)
    packed, whole = _packed(docs, "text")
    kept = language_spans.identify(packed, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    lang = F.coalesce(F.col(f"`{whole}`.lang"), "lang_pred")
    return kept.select(*_unpacked(docs, whole, text=F.col("text"), lang=lang))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each class of near copies the document with the smallest id, the first of several; no id comes last.

    Documents with one id but different texts are different documents.
    """
    rows, row = _numbered(docs)

    def copies() -> DataFrame:
        classes = stage(near_duplicates(rows, doc_id=row), "classes")
        known = classes.join(rows.select(row, F.col("doc_id").alias("id")), row)
        first = known.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", row)).alias("first"))
        return classes.join(first.select(F.col(f"first.{row}").alias(row)), row, "left_anti")

    return _without(rows, row, copies)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages out; a document of which nothing is left goes."""
    packed, whole = _packed(docs, "doc_id", "text")
    cut = remove_repeats(packed, keep=(whole,), unchanged=True)
    kept = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    size = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col(f"`{whole}`.n_chars"))
    return kept.select(*_unpacked(docs, whole, text=F.col("kept_text"), n_chars=size))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark windows cover five percent of the words or more."""
    rows, row = _numbered(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(rows, row, lambda: decontaminate(rows, items, doc_id=row).where(contaminated()))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    encoded = encode(docs, load_pieces(MODEL), keep=("doc_id", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", "n_ids", "ids", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

# Trained models, signatures and a tokenizer are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        path = scratch(spark, f"stage-{name}")
        with cleared(spark):
            function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
