"""Quality rules with cutoffs that adapt to each language and source."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskmill.llm.common import SPACES, free_names, let, words_of
from taskmill.scale import lookup, settle, stage

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# A bin of the sketch is this much wider than the one below it, so quantiles are right to 2 %.
GAMMA = 1.04
# The cutoffs of a group of so many judged documents count as much as those of its language, and theirs as
# much as those of everything; larger groups go by their own more and more.
SHRINK = 100
# A document may lie this many quartile distances outside the quartiles, plus the margin of the rule.
REACH = 3.0
# Rule: (numerator, denominator, margin below or None, margin above).
RULES = {
    "symbols": ("n_symbols", "n_words", None, 0.1),
    "dup_lines": ("n_dup_lines", "n_lines", None, 0.3),
    "repeats": ("n_repeat_words", "n_words", None, 0.2),
    "word_length": ("word_chars", "n_words", 1.5, 1.5),
}


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight that occur twice or more in the text."""

    def count(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
        keys = F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
        return F.when(F.size(hashes) < 2 * WINDOW - 7, F.lit(0)).otherwise(let(keys, covered))

    def covered(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(
            let(F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), repeated)
        )

    def repeated(pairs: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            beside = [F.get(pairs, i - 1)["k"], F.get(pairs, i + 1)["k"]]
            return reduce(lambda a, b: a | b, [F.coalesce(x["k"] == k, F.lit(False)) for k in beside])

        starts = F.array_sort(F.transform(F.filter(pairs, twice), lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct(
            (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")
        )
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    return let(F.transform(words, lambda w: F.xxhash64(w)), count)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts the rules use. A null text counts as empty; the row itself stays.

    Windows are compared by a 64-bit hash within one text. A new column replaces an old one of its name.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(
        words_of(F.col(text)),
        lambda words: F.struct(
            F.size(words).alias("n_words"),
            F.length(F.array_join(words, "")).alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"),
        ),
    )
    lined = let(
        lines,
        lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")),
    )
    words, parts = free_names(docs, "counted", "lined")
    out = docs.withColumns({words: counted, parts: lined})
    return out.withColumns({
        "n_words": F.col(f"{words}.n_words").cast("long"),
        "word_chars": F.col(f"{words}.word_chars").cast("long"),
        "n_symbols": F.regexp_count(value, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": F.col(f"{parts}.dup").cast("long"),
        "n_repeat_words": F.col(f"{words}.n_repeat_words").cast("long"),
        "n_lines": F.col(f"{parts}.n").cast("long"),
    }).drop(words, parts)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def _value(rule: str) -> Column:
    above, below = RULES[rule][:2]
    return F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(F.lit(0.0))


def sketch(counted: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per group, rule and bin with its count. Sketches merge by adding counts.

    Bin 0 holds zero, other bins grow by a constant factor, so a group has a few hundred bins at most
    and is combined before it is shuffled, however many rows it has.
    """
    bins = F.array(*[
        F.struct(
            F.lit(rule).alias("rule"),
            F.when(_value(rule) <= 0, F.lit(-(2**31))).otherwise(
                F.ceil(F.log(_value(rule)) / math.log(GAMMA))
            ).cast("long").alias("bin"),
        )
        for rule in RULES
    ])
    each = counted.select(*by, F.explode(bins).alias("b"))
    return each.groupBy(*by, F.col("b.rule").alias("rule"), F.col("b.bin").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def cutoffs(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per group and rule the lowest and highest value allowed, from the quartiles of its sketch."""
    merged = sketches.groupBy(*by, "rule", "bin").agg(F.sum("n").alias("n"))
    # A group has a bounded number of bins, so its sketch is one small row.
    value = lambda b: F.when(b == -(2**31), F.lit(0.0)).otherwise(
        2 * F.pow(F.lit(GAMMA), b.cast("double")) / (GAMMA + 1)
    )
    rows = merged.groupBy(*by, "rule").agg(
        F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins")
    )

    def quantile(q: float) -> Column:
        rank = F.ceil(F.col("rows") * q)
        zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin"))
        return value(F.aggregate(
            "bins", zero,
            lambda a, b: F.struct(
                (a["seen"] + b["n"]).alias("seen"),
                F.when(a["bin"].isNull() & (a["seen"] + b["n"] >= rank), b["bin"]).otherwise(a["bin"]).alias("bin"),
            ),
            lambda a: a["bin"],
        ))

    rows = rows.withColumns({"q1": quantile(0.25), "q3": quantile(0.75)})
    low = high = F.lit(None).cast("double")
    for rule, (_, _, below, above) in RULES.items():
        here, reach = F.col("rule") == rule, REACH * (F.col("q3") - F.col("q1"))
        high = F.when(here, F.col("q3") + reach + above).otherwise(high)
        if below is not None:
            low = F.when(here, F.col("q1") - reach - below).otherwise(low)
    return rows.select(*by, "rule", "rows", low.alias("low"), high.alias("high"))


def shrunk(fine: DataFrame, middle: DataFrame, whole: DataFrame) -> DataFrame:
    """One row per language and source: the cutoffs of each rule, drawn to those of the language and of everything.

    How far follows from the number of documents they come from, so no group is judged in another way
    for having one document more.
    """
    def named(table: DataFrame, name: str, *keys: str) -> DataFrame:
        return table.select(*[F.col(k).alias(f"{k}_{name}") for k in keys], F.col("rule").alias(f"rule_{name}"),
                            F.struct("rows", "low", "high").alias(name))

    same = F.col("rule") == F.col("rule_all")
    of_lang = F.col("__lang").eqNullSafe(F.col("__lang_middle")) & (F.col("rule") == F.col("rule_middle"))
    # Tables of one row per language and rule, and per rule.
    rows = fine.join(F.broadcast(named(middle, "middle", "__lang")), of_lang).join(F.broadcast(named(whole, "all")), same)

    def drawn(own: Column, rows: Column, other: Column) -> Column:
        return (rows * own + SHRINK * other) / (rows + SHRINK)

    def limit(side: str) -> Column:
        middle = drawn(F.col(f"middle.{side}"), F.col("middle.rows"), F.col(f"all.{side}"))
        return drawn(F.col(side), F.col("rows"), middle).alias(side)

    return rows.groupBy("__lang", "__source").agg(F.map_from_entries(
        F.collect_list(F.struct("rule", F.struct(limit("low"), limit("high"))))
    ).alias("limits"))


def apply_quality_rules(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """Judge every document by fixed base rules, then by the spread of its own group.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines``, ``base_failed``,
    ``failed_rules`` (names, sorted as in RULES) and ``kept``. Quantile sketches are taken per language
    and source of the documents that pass the base rules, and merged for each language and for everything.
    The cutoffs of a group are drawn to those of its language, and these to those of everything, the more
    the smaller the group is (``SHRINK``). Null languages and sources are groups of their own. Null or empty
    texts fail the base rules; with no document passing them there are no cutoffs and nothing else to judge.
    A very long text is one row and is counted whole. A value on a cutoff passes. Repeated rows are judged
    alike, each for itself; old columns of the new names are replaced, all others but the text stay.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "base_failed", "failed_rules", "kept")]
    narrow = docs.select(*columns)
    counted = stage(features(narrow, text).drop(text), "quality")
    judged = judge(counted, lang, source)
    return judged


def judge(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """The verdicts on rows that already have their counts."""
    passed = counted.where(~base_failed()).select(
        F.col(lang).alias("__lang"), F.col(source).alias("__source"),
        *dict.fromkeys(c for rule in RULES.values() for c in rule[:2]),
    )
    sketches = settle(sketch(passed, ("__lang", "__source")))
    fine, middle = cutoffs(sketches, ("__lang", "__source")), cutoffs(sketches, ("__lang",))
    of_lang, of_source, limits = free_names(counted, "lang", "source", "limits")
    groups = settle(shrunk(fine, middle, cutoffs(sketches))).toDF(of_lang, of_source, limits)
    keyed = counted.withColumns({of_lang: F.col(lang), of_source: F.col(source)})
    joined = lookup(keyed, groups, [of_lang, of_source], null_safe=True)
    failed = []
    for rule in RULES:
        low, high = (F.col(limits)[rule][side] for side in ("low", "high"))
        outside = F.coalesce(_value(rule) < low, F.lit(False)) | F.coalesce(_value(rule) > high, F.lit(False))
        failed.append(F.when(outside, F.lit(rule)))
    return joined.withColumns({
        "base_failed": base_failed(), "failed_rules": F.array_compact(F.array(*failed)),
    }).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop(of_lang, of_source, limits)
