from pyspark.sql import functions as F

from taskmill.functions import prompts, text
from taskmill.operators import records

HEADER = "<|begin_of_text|><|start_header_id|>system<|end_header_id|>" + prompts.SYSTEM + "<|eot_id|>"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()[0]


def test_strip_takes_what_python_strips(spark):
    for value in ("  yes　\n", "\x1c\x1d a b \x1f", " x ", "   ", ""):
        assert one(spark, value, text.strip) == value.strip()


def test_clean_answers(spark):
    rows = spark.createDataFrame([(" ΟΔΟΣ ", None)], "response string, output string")
    row = records.clean_answers(rows).first()
    assert (row.response, row.output) == ("οδος", "none")
    assert records.clean_answers(rows, null_token="?").first().output == "?"


def test_label_sets(spark):
    assert one(spark, "a, b ,a, c", text.label_set) == ["a", "b", "c"]
    assert one(spark, "", text.label_set) == [""]


def test_tokens_keep_combining_marks(spark):
    assert one(spark, "हिन्दी, कِتَاب! X_1", text.tokens) == ["हिन्दी", "कِتَاب", "x", "1"]
    assert one(spark, "...", text.tokens) == []
    assert one(spark, "A b.\nC", text.token_lines) == "a b \nc"


def record(spark, **values):
    base = dict(instruction="Do", input="text", output="out", lang="en", dataset="d", task="t")
    base.update(values)
    schema = ", ".join(f"{k} string" for k in base)
    return spark.createDataFrame([tuple(base.values())], schema)


def test_label_prompt(spark):
    got = records.render_prompt(record(spark)).first().text
    assert got == (
        HEADER
        + "<|start_header_id|>user<|end_header_id|>Do\ninput: text\nlabel: <|eot_id|>"
        + "<|start_header_id|>assistant<|end_header_id|>out<|eot_id|><|end_of_text|>"
    )


def test_summary_prompts_follow_the_language(spark):
    for lang, name in (("ar", "Arabic"), ("hi", "Hindi"), ("en", "English")):
        got = records.render_prompt(record(spark, lang=lang, task="News Summarization")).first().text
        assert f"user<|end_header_id|>Do: text\nsummary in {name}: <|eot_id|>" in got
    for lang in ("fr", None):
        got = records.render_prompt(record(spark, lang=lang, dataset="Summarization set")).first().text
        assert "Do\ninput: text\nlabel: " in got
    lower = records.render_prompt(record(spark, task="news summarization")).first().text
    assert "\nlabel: " in lower


def test_null_slots_print_none(spark):
    got = records.render_prompt(record(spark, input=None, output=None, task=None)).first().text
    assert "input: None\n" in got and got.endswith("<|end_header_id|>None<|eot_id|><|end_of_text|>")


def test_defaults_fill_absent_columns_only(spark):
    rows = record(spark, lang=None).drop("dataset", "task")
    row = records.with_defaults(rows).first()
    assert (row.lang, row.dataset, row.task) == (None, "", "")


def test_summarization_rules_differ(spark):
    tasks = ["News Summarization", "Text summary", "Summer", "consumer", None]
    rows = spark.createDataFrame([(t, "d") for t in tasks], "task string, dataset string")
    got = rows.select(*[prompts.is_summarization(r).alias(r) for r in prompts.RULES]).collect()
    assert [tuple(r) for r in got] == [
        (True, True, True, True),
        (False, False, True, True),
        (False, False, True, True),
        (False, False, False, True),
        (False, False, False, False),
    ]


def test_chats(spark):
    rows = record(spark, task="summing up", native_instruction="افعل", output_en="OUT")
    native = records.to_messages(rows, "native").first().messages
    assert [(m.role, m.content) for m in native] == [
        ("system", prompts.SYSTEM),
        ("user", "افعل\nInput: text"),
        ("assistant", "Summary: out"),
    ]
    english = records.to_messages(rows, "english").first().messages
    assert english[1].content == "Do\nInput: text" and english[2].content == "Summary: OUT"
    asked = records.to_messages(record(spark, task="consumer"), "score").first().messages
    assert asked[2].content == "Summary: "
    assert records.to_messages(record(spark), "score").first().messages[2].content == "Label: "


def test_chat_text_takes_a_template(spark):
    chat = records.to_messages(record(spark), "score")
    assert records.render_chat(chat).first().Text.startswith(HEADER)
    plain = prompts.ChatTemplate("", "", ": ", "\n", "END")
    assert records.render_chat(chat, plain).first().Text == (
        f"system: {prompts.SYSTEM}\nuser: Do\nInput: text\nassistant: Label: \nEND"
    )


def test_union_aligns_by_name(spark):
    a = spark.createDataFrame([("1", "x")], "id string, input string")
    b = spark.createDataFrame([("y", "2")], "output string, id string")
    got = records.union([a, b]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", "x", None), ("2", None, "y")]


def test_cast_ids_keep_nulls(spark):
    rows = spark.createDataFrame([(7,), (None,)], "original_id bigint")
    assert [r[0] for r in records.cast_ids(rows).collect()] == ["7", None]
