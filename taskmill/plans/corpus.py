"""Build a prepared corpus and its chat records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskmill.functions.prompts import ChatTemplate
from taskmill.operators.ordering import LANGS, shuffle
from taskmill.operators.records import cast_ids, render_chat, render_prompt, to_messages, with_defaults
from taskmill.operators.sampling import sample_corpus
from taskmill.scale import cleared, stage
from taskmill.sources.corpus import read_corpus, write_corpus


def prepare(
    records: DataFrame,
    samples: int = -1,
    shuffling: str = "none",
    seed: int = 42,
    langs: Sequence[str] = LANGS,
    within: Sequence[str] = ("lang", "dataset"),
    id_col: str | None = "id",
) -> DataFrame:
    """Sample every dataset, order the corpus and render the prompts; ``within`` names language and dataset."""
    sampled = sample_corpus(records, samples, within=within, seed=seed)
    lang, dataset = within
    ordered = shuffle(sampled, shuffling, seed, id_col, langs, lang=lang, dataset=dataset)
    return render_prompt(cast_ids(ordered) if "original_id" in records.columns else ordered)


def build_corpus(
    spark: SparkSession,
    base: str,
    target: str,
    samples: int = -1,
    split: str = "train",
    shuffling: str = "none",
    seed: int = 42,
    langs: Sequence[str] = LANGS,
    layout: str = "array",
) -> None:
    """Read a split, prepare it and save it.

    The JSON is parsed once: sampling and ordering read a few columns several times, which
    the staged parquet serves without parsing again. A dataset is a folder, in samples and in the order,
    whatever its records say. Rows are ordered by all they hold, so ids may repeat or be missing. Language,
    dataset or task get their defaults if no record has them.
    """
    with cleared(spark):
        records = stage(read_corpus(spark, base, split, langs, layout), "corpus")
        optional = ("lang", "dataset", "task")
        present = records.agg(*[F.count(c).alias(c) for c in optional]).first()
        known = with_defaults(records.drop(*[c for c in optional if not present[c]]))
        write_corpus(prepare(known, samples, shuffling, seed, langs, ("folder_lang", "folder"), None), target)


def training_chats(
    df: DataFrame, variant: str = "native", template: ChatTemplate = ChatTemplate()
) -> DataFrame:
    """Chat messages of a prepared corpus and their text."""
    return render_chat(to_messages(df, variant), template)
