"""The registered queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskmill.llm import compression_quality, language_spans
from taskmill.llm.centroids import cluster_vectors
from taskmill.llm.common import MODEL, table
from taskmill.llm.dart_minhash import near_duplicates
from taskmill.llm.decontamination import contaminated, decontaminate
from taskmill.llm.prefix_trie import prefix_nodes
from taskmill.llm.quality_rules import apply_quality_rules
from taskmill.llm.quotations import format_chats, link_quotes, parse_quotes
from taskmill.llm.repeats import remove_repeats
from taskmill.llm.sentencepiece_lattice import encode, load_pieces
from taskmill.llm.token_counts import count_tokens, load_pre_tokens
from taskmill.llm.url_templates import filter_urls
from taskmill.llm.warc import assemble, read_warc, with_referred, write_warc
from taskmill.scale import scratch, stage


def _remainder(modulus: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = _remainder(4) == 2
    model = language_spans.fit(docs.where(~held_out))
    found = language_spans.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents"), load_pieces(MODEL), keep=("doc_id",))
    return encoded.select("doc_id", "n_ids", "ids", "round_trip")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_quality_rules(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), archive)
    captures = stage(assemble(stage(read_warc(spark, archive, with_payload=False), "records")), "captures")
    return with_referred(captures, "page_id").select(
        F.element_at("metadata.fields", F.lit("page_id")).try_cast("long").alias("page_id"),
        "payload_bytes",
        F.coalesce("computed_digest", "payload_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", F.col("referred").try_cast("long")).alias("refers_to"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _remainder(5) == 0
    model = compression_quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = compression_quality.score_quality(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = format_chats(table(spark, sf_dir, "conversations"))
    replies = F.filter("messages", lambda m: m["reply_to"].isNotNull())
    pair = lambda m: F.concat_ws(":", m["turn"].cast("string"), m["reply_to"].cast("string"))
    return chats.select(
        "conv_id", "segment", "n_messages", "n_quotes", "n_linked",
        F.array_join(F.transform(replies, pair), ",").alias("replies"), "chat",
    )


def planted_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of quotes planted by rule: a whole message, its first line, or that below a quote of the one before."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("last"))
    sooner = turns.select("conv_id", (F.col("turn") + 2).alias("turn"), F.split("text", "\n")[0].alias("first"))
    rows = turns.join(before, ["conv_id", "turn"], "left").join(sooner, ["conv_id", "turn"], "left")
    line = F.split("last", "\n")[0]
    quote = F.element_at(F.array(
        F.regexp_replace("last", r"(?m)^", "> "), F.concat(F.lit(">"), line),
        F.concat(F.lit(">> "), "first", F.lit("\n> "), F.replace(line, F.lit(" "), F.lit("  "))),
    ), F.nullif(F.pmod(F.col("turn") + F.col("conv_id"), F.lit(4)), F.lit(0)).cast("int"))
    quoted = rows.withColumn("text", F.concat_ws("\n", quote, "text"))
    return link_quotes(parse_quotes(quoted)).select("conv_id", "turn", "passage", "level", "origin")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(table(spark, sf_dir, "conversations"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), load_pre_tokens(MODEL), keep=("doc_id",))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_minhash_dedup, op3_sentencepiece, op4_quality_rules, op5_url_filters, op6_warc, op7_decontamination,
    op8_quality_classifier, op9_substring_dedup, op10_chat_formatting, planted_quotes, op11_centroid_clustering, op12_prefix_trie,
    op13_token_counts,
)}
