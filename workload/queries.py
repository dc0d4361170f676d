"""The registered queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskmill import scale, schema
from taskmill.functions import prompts
from taskmill.functions.hashing import hash_key
from taskmill.operators import labels, metrics, ordering, packing, records, rouge, sampling
from taskmill.plans import corpus as corpus_plan
from taskmill.plans import evaluation, scoring
from taskmill.sources import corpus, results, tables
from taskmill.streaming.scoring import score_arriving
from workload import records as data
from workload.records import LANGS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BY = schema.DATASET_KEY
CHAT_KEY = ["id", "lang", "dataset"]


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, places) for c in doubles})


def _single_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_counts(labels.repair_answers(data.orders_cleaned(spark, sf)))


# ---- single-label evaluation


@query
def single_label_metrics(spark, sf):
    return rounded(metrics.single_label_metrics(_single_counts(spark, sf)).drop("support"))


@query
def class_report(spark, sf):
    report = metrics.class_report(metrics.class_counts(_single_counts(spark, sf)))
    return rounded(report.select(*BY, "label", "precision", "recall", "f1", "support"))


@query
def report_with_averages(spark, sf):
    report = metrics.class_report(metrics.class_counts(_single_counts(spark, sf)))
    return rounded(metrics.full_report(report))


@query
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_single_counts(spark, sf))


@query
def confusion_cells(spark, sf):
    """Thousands of labels: parts, answered by themselves, by the next one, or by one for all."""
    rows = table(spark, sf, "lineitem").select(
        F.lit("en").alias("lang"), F.col("l_returnflag").alias("dataset"), F.col("l_partkey").cast("string").alias("output"),
        F.when(F.col("l_linenumber") == 7, "none").otherwise(
            (F.col("l_partkey") + F.col("l_linenumber") % 2).cast("string")
        ).alias("response"),
    )
    return metrics.confusion_cells(metrics.confusion_counts(rows))


@query
def confusion_matrix_nested(spark, sf):
    nested = metrics.confusion_matrix(_single_counts(spark, sf), nested=True)
    rows = F.transform("confusion_matrix", lambda r: F.array_join(r.cast("array<string>"), " "))
    return nested.select(
        *BY, F.array_join("labels", "|").alias("labels"), F.array_join(rows, "|").alias("matrix")
    )


@query
def answer_cleaning(spark, sf):
    return data.orders_cleaned(spark, sf).select("id", "output", "response")


@query
def answer_repair(spark, sf):
    return labels.repair_answers(data.orders_cleaned(spark, sf)).select("id", "response")


@query
def label_encoding(spark, sf):
    cleaned = data.orders_cleaned(spark, sf)
    codes = scale.settle(labels.label_codes(cleaned))
    repaired = labels.repair_answers(cleaned, labels=codes)
    encoded = labels.encode_labels(repaired, labels=codes)
    return encoded.select("id", "output_code", "response_code")


@query
def distinct_labels(spark, sf):
    return labels.distinct_labels(data.orders(spark, sf))


@query
def document_quality_eval(spark, sf):
    """Every dataset of two kinds at once: document quality per source and order flags."""
    judged = data.documents(spark, sf)
    answer = F.when(hash_key(5, "id") < F.lit(7 << 57), F.upper("output")).otherwise("bad")
    single = judged.withColumn("response", answer).select("id", *BY, "output", "response")
    return rounded(evaluation.evaluate(single.unionByName(data.flags(spark, sf))))


@query
def experiment_evaluation(spark, sf):
    """Single-label, multi-label and summarization datasets of one experiment."""
    frames = [data.orders(spark, sf), data.flags(spark, sf), data.replies(spark, sf)]
    return rounded(evaluation.evaluate(records.union(frames)))


@query
def metrics_sink(spark, sf):
    """Metrics documents written one per dataset and read back."""
    both = data.orders(spark, sf).unionByName(data.flags(spark, sf))
    documents = evaluation.metrics_documents(both).withColumn("experiment", F.col("dataset"))
    path = scale.scratch(spark, "metrics")
    results.write_metrics(documents, path)
    stored = spark.read.schema("value string, experiment string").text(path)
    names = ["accuracy", "f1_micro", "f1_macro", "f1_weighted"]
    return rounded(
        stored.select(
            "experiment",
            *[F.get_json_object("value", f"$.{n}").cast("double").alias(n) for n in names],
        )
    )


@query
def metrics_sink_documents(spark, sf):
    """The whole documents of three kinds of datasets, stored and taken apart: averages, reports, matrices."""
    frames = [data.orders(spark, sf), data.flags(spark, sf), data.replies(spark, sf)]
    documents = evaluation.metrics_documents(records.union(frames)).withColumn("experiment", F.col("dataset"))
    path = scale.scratch(spark, "documents")
    results.write_metrics(documents, path)
    members = lambda column: F.explode(F.col(column).cast("map<string,variant>")).alias("label", "value")
    top = results.read_metrics(spark, path).select("experiment", members("document"))
    report = top.where("label = 'classification_report'").select("experiment", members("value"))
    entries = top.where("label not in ('classification_report', 'confusion_matrix')").unionByName(report)
    fields = {"": "$", **{name: f"$['{name}']" for name in ("precision", "recall", "f1-score", "support")}}
    numbers = entries.select("experiment", "label", F.inline(F.array(*[
        F.struct(F.lit(name).alias("field"), F.try_variant_get("value", place, "double").alias("number"))
        for name, place in fields.items()
    ]))).where("number is not null")
    matrix = top.where("label = 'confusion_matrix'").select(
        "experiment", F.posexplode(F.col("value").cast("array<array<bigint>>")).alias("i", "row")
    ).select("experiment", F.format_string("row %d", "i").alias("label"), F.posexplode("row").alias("field", "number"))
    matrix = matrix.withColumns({"field": F.col("field").cast("string"), "number": F.col("number").cast("double")})
    return rounded(numbers.unionByName(matrix))


# ---- multi-label evaluation


@query
def label_sets(spark, sf):
    split = records.split_labels(records.clean_answers(data.flags(spark, sf)))
    return split.select("id", *[F.array_join(F.sort_array(c), "|").alias(c) for c in ("output", "response")])


@query
def multi_label_binarization(spark, sf):
    split = records.split_labels(records.clean_answers(data.flags(spark, sf)))
    known = metrics.binarize(split)
    return known.select("id", *[F.array_join(F.sort_array(c), "|").alias(c) for c in ("output", "response")])


def _multi_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.multi_counts(records.clean_answers(data.flags(spark, sf)), BY)


@query
def multi_label_metrics(spark, sf):
    return rounded(metrics.multi_label_metrics(_multi_counts(spark, sf)))


@query
def multi_label_report(spark, sf):
    return rounded(metrics.multi_label_report(_multi_counts(spark, sf)))


# ---- sampling and ordering


@query
def stratified_sample(spark, sf):
    rows = data.orders(spark, sf).drop("response")
    return sampling.stratified_sample(rows, 1000)


@query
def stratified_sample_of_documents(spark, sf):
    rows = data.documents(spark, sf).select("id", "lang", "dataset", "output", "input")
    return sampling.stratified_sample(rows, 40, within=["lang"])


@query
def uniform_sample(spark, sf):
    rows = data.documents(spark, sf).select("id", "lang", "dataset", "input")
    return sampling.uniform_sample(rows, 5)


@query
def full_sample(spark, sf):
    rows = data.documents(spark, sf).select("id", "lang", "dataset", "output", "input")
    return sampling.stratified_sample(rows, -1)


@query
def corpus_sample(spark, sf):
    """Summarization datasets uniformly, the others by label."""
    rows = data.documents(spark, sf)
    rows = rows.withColumn("dataset", F.coalesce("task", F.lit("untasked")))
    return sampling.sample_corpus(rows, 20).select("id", "lang", "dataset", "output")


def _ordered(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    rows = data.documents(spark, sf).select("id", "lang", "dataset", "task", "input")
    return ordering.shuffle(rows, mode, langs=LANGS)


@query
def shuffle_none(spark, sf):
    return _ordered(spark, sf, "none")


@query
def shuffle_fully(spark, sf):
    return _ordered(spark, sf, "fully")


@query
def shuffle_by_language(spark, sf):
    return _ordered(spark, sf, "by_language")


@query
def shuffle_by_task(spark, sf):
    return _ordered(spark, sf, "by_task")


@query
def seeded_permutation(spark, sf):
    rows = data.documents(spark, sf).select("id", "lang", "dataset", "input")
    return ordering.permute(rows)


@query
def shuffle_fully_repeated_ids(spark, sf):
    """Rows that share ids or have none, and German rows that are there three times."""
    few = F.when(F.col("original_id") % 7 > 0, (F.col("original_id") % 10).cast("string"))
    rows = data.documents(spark, sf).select(few.alias("id"), "lang", "dataset", "input")
    copies = F.when(F.col("lang") == "de", 3).otherwise(1)
    return ordering.shuffle(rows.withColumn("n", F.explode(F.array_repeat(F.lit(1), copies))).drop("n"), "fully", id_col=None)


# ---- unions and counts


@query
def union_missing_columns(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("input"), "lang",
        F.col("source").alias("dataset"),
    )
    items = table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("input")
    )
    return records.union([docs, items])


@query
def union_languages(spark, sf):
    rows = data.documents(spark, sf)
    frames = [rows.where(F.col("lang") == lang).select("id", "lang", "input") for lang in LANGS]
    return records.union(frames)


@query
def record_counts(spark, sf):
    return records.counts(data.documents(spark, sf))


# ---- prompts and chats


@query
def id_cast(spark, sf):
    return records.cast_ids(data.documents(spark, sf)).select("id", "original_id")


@query
def prompt_classification(spark, sf):
    rows = data.documents(spark, sf).withColumn("task", F.lit("Quality Detection"))
    return records.render_prompt(rows).select("id", "text")


@query
def prompt_summarization(spark, sf):
    """Spanish stands in for Hindi: two languages have a summary prompt, the others fall back."""
    rows = data.documents(spark, sf).withColumn("lang", F.when(F.col("lang") == "es", "hi").otherwise(F.col("lang")))
    return records.render_prompt(rows).select("id", "text")


@query
def prompt_defaults(spark, sf):
    rows = data.documents(spark, sf).drop("lang", "dataset", "task")
    return records.render_prompt(rows).select("id", "lang", "dataset", "task", "text")


@query
def summarization_rules(spark, sf):
    rows = data.documents(spark, sf)
    tests = [prompts.is_summarization(rule).alias(rule) for rule in prompts.RULES]
    return rows.groupBy("task", *tests).agg(F.count(F.lit(1)).alias("n"))


@query
def metric_routing(spark, sf):
    frames = [data.orders(spark, sf), data.flags(spark, sf), data.replies(spark, sf)]
    rows = records.union([f.select("id", *BY) for f in frames])
    return rows.groupBy("dataset", metrics.metric_kind().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _training(spark: SparkSession, sf: str) -> DataFrame:
    rows = data.documents(spark, sf)
    native = F.concat(F.lit("["), "lang", F.lit("] "), "instruction")
    return rows.withColumns({"native_instruction": native, "output_en": F.upper("output")})


def _flat(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode("messages").alias("place", "m")).select(
        "id", "place", F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )


@query
def chat_native(spark, sf):
    return _flat(records.to_messages(_training(spark, sf), "native"))


@query
def chat_english(spark, sf):
    return _flat(records.to_messages(_training(spark, sf), "english"))


@query
def chat_scoring(spark, sf):
    return _flat(records.to_messages(_training(spark, sf), "score"))


@query
def chat_text(spark, sf):
    return corpus_plan.training_chats(_training(spark, sf)).select("id", "Text")


@query
def chat_text_open(spark, sf):
    """Scoring chats, with the turn of the answer left open."""
    return records.render_chat(records.to_messages(_to_score(spark, sf), "score"), open_turn=True).select("id", "Text")


@query
def chat_text_of_turns(spark, sf):
    """Each question of a conversation with the reply to it, as a chat."""
    rows = data.replies(spark, sf).select(
        "id",
        F.col("output").alias("input"),
        F.col("response").alias("output"),
        F.lit("Reply").alias("native_instruction"),
        F.lit("Dialogue").alias("task"),
        F.lit("").alias("dataset"),
    )
    return corpus_plan.training_chats(rows).select("id", "Text")


# ---- lookups


@query
def label_translation(spark, sf):
    customers = table(spark, sf, "customer")
    rows = customers.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("output")
    )
    known = customers.select(F.col("c_mktsegment").alias("native")).where("native <> 'MACHINERY'")
    table_ = known.distinct().withColumn("english", F.lower("native"))
    return labels.translate_labels(rows, table_)


@query
def instruction_assignment(spark, sf):
    """Benchmark texts serve as the instruction variants of the document sources."""
    bank = table(spark, sf, "benchmark").select(
        F.concat(F.lit("src"), F.expr("item_id % 20")).alias("dataset"),
        F.expr("item_id div 20").alias("variant"),
        F.col("text").alias("instruction"),
    )
    rows = data.documents(spark, sf).select("id", "dataset")
    return labels.assign_instructions(rows, bank)


@query
def registry_enrichment(spark, sf):
    docs = data.documents(spark, sf)
    registry = docs.groupBy("dataset", "lang").agg(
        F.concat(F.lit("Task of "), "dataset").alias("task"),
        F.concat(F.lit("Defined for "), "lang").alias("task_definition"),
        F.sort_array(F.collect_set("output")).alias("labels"),
    )
    rows = labels.enrich(docs.select("id", "dataset", "lang"), scale.settle(registry))
    return rows.withColumn("labels", F.array_join("labels", "|"))


@query
def registry_parse(spark, sf):
    """Registry lines made of customers: one or two languages, a label list or none."""
    raw = table(spark, sf, "customer").select(
        F.col("c_name").alias("dataset"),
        F.col("c_mktsegment").alias("task"),
        F.lit("A task.").alias("task_definition"),
        F.when(F.col("c_nationkey") < 10, "Hindi, English").when(F.col("c_nationkey") < 20, "Arabic")
        .otherwise("French").alias("lang"),
        F.when(F.col("c_nationkey") % 5 == 0, "None")
        .otherwise(F.concat(F.lit("['"), "c_mktsegment", F.lit("', 'other']"))).alias("labels"),
    )
    registry = tables.parse_registry(raw)
    return registry.withColumn("labels", F.array_join("labels", "|"))


@query
def registry_source(spark, sf):
    """The same lines written as a tab-separated file and read as a registry."""
    raw = table(spark, sf, "customer").select(
        F.col("c_name").alias("dataset"), F.col("c_mktsegment").alias("task"),
        F.lit("A \"task\".").alias("task_definition"), F.lit("Arabic").alias("lang"),
        F.concat(F.lit("['"), "c_mktsegment", F.lit("', 'other']")).alias("labels"),
    )
    path = scale.scratch(spark, "registry")
    raw.write.option("sep", "\t").option("header", True).option("quote", "\u0000").csv(path)
    return tables.registry_labels(tables.read_registry(spark, path))


@query
def label_map_parse(spark, sf):
    pair = F.to_json(F.create_map("p_name", "p_type")).alias("value")
    path = scale.scratch(spark, "labelmap")
    table(spark, sf, "part").select(pair).write.text(path)
    pairs = tables.parse_label_map(spark.read.text(path))
    return pairs.groupBy("native", "english").agg(F.count(F.lit(1)).alias("n"))


@query
def instruction_bank_parse(spark, sf):
    variants = F.array("p_name", "p_type", F.concat("p_name", F.lit(" "), "p_type"))
    path = scale.scratch(spark, "bank")
    table(spark, sf, "part").select(
        F.to_json(F.create_map("p_brand", variants)).alias("value")
    ).write.text(path)
    rows = tables.parse_instructions(spark.read.text(path))
    return rows.groupBy("dataset", "variant", "instruction").agg(F.count(F.lit(1)).alias("n"))


# ---- scoring


@query
def pending_rows(spark, sf):
    """Judged documents count as answered."""
    rows = data.documents(spark, sf).select("id", *BY, "output")
    return records.pending(rows.drop("output"), rows.where("output is not null"))


@query
def first_of_duplicates(spark, sf):
    """The first order of each customer in each status."""
    rows = table(spark, sf, "orders").select(
        F.lit("en").alias("lang"),
        F.col("o_orderstatus").alias("dataset"),
        F.col("o_custkey").cast("string").alias("id"),
        "o_orderkey",
    )
    return records.first_of_duplicates(rows, "o_orderkey")


def count_characters(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A deterministic stand-in for a model: the size of the question and the opening words."""
    for messages in batches:
        yield pd.Series([f"{len(m[1]['content'])} {m[2]['content']}" for m in messages], dtype=object)


def _to_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = data.documents(spark, sf)
    return rows.withColumn("original_id", F.col("original_id").cast("string"))


@query
def batch_scoring(spark, sf):
    """The judged documents are scored first, then everything, then everything again."""
    rows, path = _to_score(spark, sf), scale.scratch(spark, "scored")
    for part in (rows.where("output is not null"), rows, rows):
        scoring.score(part, count_characters, path)
    return results.read_responses(spark, path).select("id", *BY, "response")


@query
def stream_scoring(spark, sf):
    """Record files scored as a stream, and once more after a restart without checkpoint."""
    source, path = scale.scratch(spark, "arriving"), scale.scratch(spark, "scored")
    _to_score(spark, sf).write.json(source)
    for _ in range(2):
        checkpoint = scale.scratch(spark, "progress")
        score_arriving(spark, source, path, count_characters, checkpoint).awaitTermination()
    return results.read_responses(spark, path).select("id", *BY, "response")


@query
def stream_scoring_batches(spark, sf):
    """Record files in several micro-batches, after a batch that is run twice and one that was cut short."""
    source, path = scale.scratch(spark, "arriving"), scale.scratch(spark, "scored")
    rows = _to_score(spark, sf)
    rows.repartition(4, "id").write.json(source)
    for _ in range(2):
        scoring.score(rows.where("lang = 'en'"), count_characters, path, batch="again")
    rest = scoring.with_responses(rows.where("lang = 'de'"), count_characters)
    results.write_responses(rest, results.batch_folder(path, "cut-short"))
    scoring.score(rows.where("lang = 'fr'"), count_characters, path)
    progress = scale.scratch(spark, "progress")
    score_arriving(spark, source, path, count_characters, progress, files_per_batch=1).awaitTermination()
    return results.read_responses(spark, path).select("id", *BY, "response")


@query
def batch_map(spark, sf):
    def lengths(batches: Iterator[pd.DataFrame], unit: str) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(size=batch["text"].str.len().astype(str) + unit)[["doc_id", "size"]]

    rows = table(spark, sf, "documents").select("doc_id", "text")
    return records.map_batches(rows, lengths, "doc_id bigint, size string", unit=" chars")


# ---- ROUGE


@query
def rouge1(spark, sf):
    return rouge.rouge_scores(data.neighbours(spark, sf), ["rouge1"]).select("id", "rouge1")


@query
def rouge2(spark, sf):
    return rouge.rouge_scores(data.neighbours(spark, sf), ["rouge2"]).select("id", "rouge2")


@query
def rouge_l(spark, sf):
    return rouge.rouge_scores(data.neighbours(spark, sf), ["rougeL"]).select("id", "rougeL")


@query
def rouge_lsum(spark, sf):
    return rouge.rouge_scores(data.neighbours(spark, sf), ["rougeLsum"]).select("id", "rougeLsum")


@query
def rouge_mean(spark, sf):
    return rounded(rouge.rouge_metrics(data.neighbours(spark, sf), keys=["rouge1", "rouge2"]))


@query
def rouge_all(spark, sf):
    return rounded(rouge.rouge_metrics(data.replies(spark, sf)))


# ---- packing


@query
def pack_blocks(spark, sf):
    rows = table(spark, sf, "documents").select("lang", F.col("doc_id").alias("position"), "n_chars")
    return packing.pack(rows, "n_chars", 4096, ["lang"])


@query
def pack_shuffled(spark, sf):
    """All documents in one permuted order, laid end to end."""
    rows = data.documents(spark, sf).select("id", F.length("input").alias("n_chars"))
    return packing.pack(ordering.shuffle(rows, "fully"), "n_chars", 4096, stretch=1 << 10)


# ---- sources and sinks


@query
def corpus_roundtrip(spark, sf):
    """A sampled, ordered and rendered corpus, saved and reloaded."""
    prepared = corpus_plan.prepare(data.documents(spark, sf), 10, "by_language", langs=LANGS)
    path = scale.scratch(spark, "prepared")
    corpus.write_corpus(prepared, path)
    return corpus.read_prepared(spark, path).select("id", "original_id", "lang", "dataset", "position", "text")


@query
def corpus_source(spark, sf):
    """Language, dataset and split folders of JSON Lines, read for one split."""
    split = F.when(F.col("output").isNull(), "test.json").otherwise("train.json")
    rows = _to_score(spark, sf).withColumns(
        {"l": F.col("lang"), "d": F.col("dataset"), "f": split}
    )
    path = scale.scratch(spark, "corpus")
    rows.write.partitionBy("l", "d", "f").json(path)
    langs = [f"l={lang}" for lang in LANGS]
    read = corpus.read_corpus(spark, path, "f=train", langs, "lines", schema.INSTRUCTION)
    return read.select("id", "input", "output", "folder", "folder_lang")


@query
def record_source(spark, sf):
    path = scale.scratch(spark, "records")
    _to_score(spark, sf).write.json(path)
    return corpus.read_records(spark, path, "lines").drop("position")


def _arrays(df: DataFrame, *folders: str) -> DataFrame:
    """JSON arrays of up to 200 records each, one or several to a file."""
    rows = df.withColumn("part", F.expr("cast(original_id as bigint) div 200"))
    record = F.struct(*[c for c in df.columns if c not in folders])
    return rows.groupBy(*folders, "part").agg(F.to_json(F.collect_list(record)).alias("value")).drop("part")


@query
def corpus_source_array(spark, sf):
    """The same folders with JSON arrays, read for the split without a judgement."""
    split = F.when(F.col("output").isNull(), "test.json").otherwise("train.json")
    rows = _to_score(spark, sf).withColumns({"l": F.col("lang"), "d": F.col("dataset"), "f": split})
    path = scale.scratch(spark, "corpus")
    _arrays(rows, "l", "d", "f").write.partitionBy("l", "d", "f").text(path)
    langs = [f"l={lang}" for lang in LANGS]
    read = corpus.read_corpus(spark, path, "f=test", langs, "array", schema.INSTRUCTION)
    return read.select("id", "input", "instruction", "folder", "folder_lang")


@query
def record_source_array(spark, sf):
    path = scale.scratch(spark, "records")
    # Several files, and as many as there are partitions, so that a task writes no more of a larger table.
    _arrays(_to_score(spark, sf)).repartition(max(3, scale.partitions(spark)), "value").write.text(path)
    return corpus.read_records(spark, path, "array").drop("position")


@query
def first_of_files(spark, sf):
    """Records of three files of unequal size with keys in common: those of the first file by name count."""
    path = scale.scratch(spark, "files")
    rows = _to_score(spark, sf)
    number = F.col("original_id").cast("bigint")
    for name, of in (("b-large", F.lit(True)), ("c-middle", number % 3 > 0), ("a-small", number % 10 == 0)):
        part = rows.where(of).withColumn("instruction", F.concat(F.lit(f"{name} "), F.pmod(number, F.lit(4)).cast("string")))
        part.withColumn("id", F.concat((number % 500).cast("string"), F.lit("-"), "lang")).write.json(f"{path}/{name}")
    read = corpus.read_records(spark, f"{path}/*", "lines")
    first = records.first_of_duplicates(read, "position")
    return first.select("id", *BY, F.substring_index("instruction", " ", 1).alias("file"))


@query
def corpus_build(spark, sf):
    """A corpus of JSON arrays without languages and datasets in its records: folders tell them apart."""
    rows = _to_score(spark, sf).withColumns({"l": F.col("lang"), "d": F.col("dataset"), "f": F.lit("train.json")})
    base, target = scale.scratch(spark, "corpus"), scale.scratch(spark, "prepared")
    _arrays(rows.drop("lang", "dataset"), "l", "d", "f").write.partitionBy("l", "d", "f").text(base)
    langs = [f"l={lang}" for lang in LANGS]
    corpus_plan.build_corpus(spark, base, target, 10, "f=train", "by_language", langs=langs)
    built = corpus.read_prepared(spark, target)
    return built.select("id", "folder_lang", "folder", "lang", "dataset", "position", "text")


@query
def result_source_objects(spark, sf):
    """One JSON object per file, over several lines, some of them cut off."""
    rows = _to_score(spark, sf).where("cast(original_id as bigint) % 10 = 0").withColumn("response", F.upper("output"))
    text = F.to_json(F.struct(*rows.columns), {"pretty": "true"})
    cut = F.when(F.col("output").isNull(), F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text)
    path = scale.scratch(spark, "objects")
    # Rows with one id share a file. Many tasks, since files cost more than their bytes; each adds its own to the folders.
    files = rows.select(F.col("dataset").alias("experiment"), "id", cut.alias("value")).repartition(
        scale.partitions(spark), "experiment", "id"
    )
    files = files.groupBy("experiment", "id").agg(F.array_join(F.collect_list("value"), "\n").alias("value"))
    files.drop("id").write.partitionBy("experiment").options(
        **{"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}
    ).text(path)
    good, bad = results.read_results(spark, path, pattern="*.txt", once=True)
    found = good.select("id", "response", F.lit("good").alias("state"))
    spoiled = bad.select(F.regexp_extract("text", r'^\{\s*"id" : "([^"]*)"', 1).alias("id"), F.lit(None).cast("string").alias("response"),
                         F.lit("corrupt").alias("state"))
    return found.unionByName(spoiled)


@query
def response_sink(spark, sf):
    path = scale.scratch(spark, "responses")
    rows = _to_score(spark, sf).withColumn("response", F.concat(F.lit("Ünï "), "id"))
    results.write_responses(rows, path)
    return results.read_responses(spark, path)


@query
def result_source(spark, sf):
    """Results of an experiment, read back by dataset folder with nothing to quarantine."""
    path = scale.scratch(spark, "experiment")
    rows = _to_score(spark, sf).withColumns({"response": F.upper("output"), "folder": F.col("dataset")})
    rows.write.partitionBy("folder").json(path)
    good, bad = results.read_results(spark, path, "lines")
    found = good.groupBy("experiment").agg(F.count(F.lit(1)).alias("n"), F.count("response").alias("answered"))
    spoiled = bad.groupBy("experiment").agg(F.count(F.lit(1)).alias("corrupt"))
    return found.join(spoiled, "experiment", "left").withColumn("corrupt", F.coalesce("corrupt", F.lit(0)))


@query
def corrupt_quarantine(spark, sf):
    """Results of unjudged documents are cut off half-way and must not spoil the others."""
    rows = _to_score(spark, sf).withColumn("response", F.col("output"))
    line = F.to_json(F.struct(*rows.columns))
    cut = F.when(F.col("output").isNull(), F.substring(line, F.lit(1), F.length(line) - 9)).otherwise(line)
    path = scale.scratch(spark, "spoiled")
    rows.select(F.col("dataset").alias("experiment"), cut.alias("value")).write.partitionBy("experiment").text(path)
    good, bad = results.read_results(spark, path, "lines", pattern="*.txt")
    found = good.select("experiment", F.lit("good").alias("state"))
    spoiled = bad.select("experiment", F.lit("corrupt").alias("state"))
    return found.unionByName(spoiled).groupBy("experiment", "state").agg(F.count(F.lit(1)).alias("n"))
