"""Prompt and chat rendering as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording and control tokens of the prompts.
SYSTEM = "You are a social media expert providing accurate analysis and insights."
BEGIN_OF_TEXT = "<|begin_of_text|>"
END_OF_TEXT = "<|end_of_text|>"
START_HEADER = "<|start_header_id|>"
END_HEADER = "<|end_header_id|>"
END_OF_TURN = "<|eot_id|>"
SUMMARY_LANGUAGES = {"ar": "Arabic", "hi": "Hindi", "en": "English"}
NULL_TEXT = "None"

# The four tests for a summarization row disagree on purpose and stay apart; their words are fixed values.
RULES = ("render", "sample", "train", "score")


def is_summarization(rule: str, task: str = "task", dataset: str = "dataset") -> Column:
    name = F.coalesce(F.col(task), F.lit(""))
    if rule == "render":
        return name.contains("Summarization") | F.coalesce(F.col(dataset), F.lit("")).contains("Summarization")
    if rule == "sample":
        return name.contains("ummariz")
    if rule == "train":
        return F.lower(name).contains("summ")
    if rule == "score":
        return F.lower(name).contains("sum")
    raise ValueError(f"unknown rule {rule!r}, expected one of {RULES}")


def slot(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NULL_TEXT))


def _turn(role: str, *content: Column) -> Column:
    return F.concat(F.lit(f"{START_HEADER}{role}{END_HEADER}"), *content, F.lit(END_OF_TURN))


def prompt(
    instruction: str = "instruction", text: str = "input", output: str = "output"
) -> Column:
    """The training prompt of a row: a label prompt, or a summary prompt in the row's language."""
    labelling = F.concat(slot(instruction), F.lit("\ninput: "), slot(text), F.lit("\nlabel: "))
    languages = F.create_map(*[F.lit(x) for pair in SUMMARY_LANGUAGES.items() for x in pair])
    language = F.when(F.col("lang").isNotNull(), F.try_element_at(languages, F.col("lang")))
    summarizing = F.concat(
        slot(instruction), F.lit(": "), slot(text), F.lit("\nsummary in "), language, F.lit(": ")
    )
    user = F.coalesce(F.when(is_summarization("render"), summarizing), labelling)
    return F.concat(
        F.lit(BEGIN_OF_TEXT),
        _turn("system", F.lit(SYSTEM)),
        _turn("user", user),
        _turn("assistant", slot(output)),
        F.lit(END_OF_TEXT),
    )


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(instruction: str, rule: str, text: str = "input", output: str | None = None) -> Column:
    """System, user and assistant messages; without ``output`` the assistant only opens its turn."""
    prefix = F.when(is_summarization(rule), F.lit("Summary: ")).otherwise(F.lit("Label: "))
    answer = prefix if output is None else F.concat(prefix, slot(output))
    return F.array(
        message("system", F.lit(SYSTEM)),
        message("user", F.concat(slot(instruction), F.lit("\nInput: "), slot(text))),
        message("assistant", answer),
    )


@dataclass(frozen=True)
class ChatTemplate:
    """How messages become one string; a model brings its own."""

    begin: str = BEGIN_OF_TEXT
    before_role: str = START_HEADER
    after_role: str = END_HEADER
    after_content: str = END_OF_TURN
    end: str = ""


def chat_text(column: str | Column, template: ChatTemplate = ChatTemplate(), open_turn: bool = False) -> Column:
    """The messages as one string; ``open_turn`` leaves the last turn to be gone on with by a model."""
    turns = F.transform(
        column,
        lambda m: F.concat(F.lit(template.before_role), m["role"], F.lit(template.after_role), m["content"]),
    )
    last = "" if open_turn else template.after_content + template.end
    return F.concat(F.lit(template.begin), F.array_join(turns, template.after_content), F.lit(last))
