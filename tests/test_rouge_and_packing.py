import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from taskmill.functions import rouge as R
from taskmill.operators import packing, rouge


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t


def traced(a, b):
    t, i, j, found = table(a, b), len(a), len(b), set()
    while i > 0 and j > 0:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            found.add(i)
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return found


def test_subsequences_match_the_full_table():
    draw = random.Random(5)
    for _ in range(400):
        a = [draw.choice("abcdef") for _ in range(draw.randint(0, 14))]
        b = [draw.choice("abcdxy") for _ in range(draw.randint(0, 14))]
        assert R.lcs_length(a, b) == table(a, b)[-1][-1]
        assert R.lcs_positions(a, b, R.places(b)) == traced(a, b)


def test_long_texts_stay_exact():
    draw = random.Random(6)
    a = [str(draw.randint(0, 50)) for _ in range(700)]
    b = [str(draw.randint(0, 50)) for _ in range(650)]
    assert R.lcs_length(a, b) == table(a, b)[-1][-1]
    assert R.lcs_positions(a, b, R.places(b)) == traced(a, b)


def words(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def f(hits, m, n):
    return round(200 * hits / (m + n), 6) if m + n else 0.0


def brute(ref, cand):
    out = {}
    for n in (1, 2):
        grams = [Counter(zip(*[words(t)[k:] for k in range(n)])) for t in (ref, cand)]
        out[f"rouge{n}"] = f((grams[0] & grams[1]).total(), grams[0].total(), grams[1].total())
    a, b = words(ref), words(cand)
    out["rougeL"] = f(table(a, b)[-1][-1], len(a), len(b))
    ours, theirs = [words(s) for s in ref.split("\n")], [words(s) for s in cand.split("\n")]
    left, right, hits = Counter(a), Counter(b), 0
    for s in ours:
        for place in sorted(set().union(*[traced(s, o) for o in theirs])):
            if left[s[place]] > 0 and right[s[place]] > 0:
                left[s[place]] -= 1
                right[s[place]] -= 1
                hits += 1
    out["rougeLsum"] = f(hits, len(a), len(b))
    return out


def test_scores_match_brute_force(spark):
    draw = random.Random(9)
    text = lambda: draw.choice(["", " "]).join(
        draw.choice(["the ", "cat", " sat. ", "on\n", "a ", "mat,", "\n", "Él "]) for _ in range(draw.randint(0, 25))
    )
    pairs = [(text(), text()) for _ in range(150)] + [("a", "a"), ("", ""), ("a b", "c d"), ("x", ""), ("one", "one two")]
    df = spark.createDataFrame([(str(i), *p) for i, p in enumerate(pairs)], "id string, output string, response string")
    for row in rouge.rouge_scores(df).collect():
        expected = brute(*pairs[int(row.id)])
        for name, value in expected.items():
            assert row[name] == pytest.approx(value, abs=0.0051), (name, pairs[int(row.id)])


def test_identical_disjoint_and_empty(spark):
    rows = [("same", "a b a", "a b a"), ("none", "a b", "c d"), ("empty", "", "a"), ("null", None, None)]
    df = spark.createDataFrame(rows, "id string, output string, response string")
    got = {r.id: [r[k] for k in rouge.KEYS] for r in rouge.rouge_scores(df).collect()}
    assert got["same"] == [100.0] * 4
    assert got["none"] == got["empty"] == got["null"] == [0.0] * 4


def test_repeated_words_count_as_often_as_in_both(spark):
    df = spark.createDataFrame([("a a a b", "a a c")], "output string, response string")
    assert rouge.rouge_scores(df, ["rouge1"]).first().rouge1 == pytest.approx(57.14)


def test_sentence_union_differs_from_whole_text(spark):
    df = spark.createDataFrame([("w1 w2\nw3 w4", "w3 w4\nw1 w2")], "output string, response string")
    row = rouge.rouge_scores(df, ["rougeL", "rougeLsum"]).first()
    assert (row.rougeL, row.rougeLsum) == (50.0, 100.0)


def test_mean_of_rounded_scores(spark):
    rows = [("en", "xlsum", "a b c", "a"), ("en", "xlsum", "a", "a")]
    df = spark.createDataFrame(rows, "lang string, dataset string, output string, response string")
    assert rouge.rouge_metrics(df).first().rouge1 == pytest.approx(75.0)


@pytest.mark.parametrize("stretch", [3, 1 << 20])
def test_packing_matches_a_running_sum(spark, stretch):
    draw = random.Random(2)
    rows = [(g, i, draw.randint(0, 30)) for g in ("a", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, position bigint, n int").repartition(6)
    got = {(r.g, r.position): r for r in packing.pack(df, "n", 16, ["g"], stretch=stretch).collect()}
    assert len(got) == len(rows)
    for group in ("a", None):
        start = 0
        for g, i, n in (r for r in rows if r[0] == group):
            row = got[g, i]
            assert (row.start, row.first_block) == (start, start // 16)
            assert row.last_block == max(start, start + n - 1) // 16
            start += n


def test_packing_one_global_order(spark):
    df = spark.range(100).select(F.col("id").alias("position"), F.lit(10).alias("n"))
    last = packing.pack(df, "n", 64, stretch=7).orderBy("position").collect()[-1]
    assert (last.start, last.first_block, last.last_block) == (990, 15, 15)


def test_overlap_counts_as_often_as_in_both():
    draw = random.Random(4)
    for _ in range(200):
        a, b = ([draw.choice("abcde") for _ in range(draw.randint(0, 20))] for _ in range(2))
        assert R.overlap(a, b) == (Counter(a) & Counter(b)).total()
        assert R.overlap(zip(a, a[1:]), zip(b, b[1:])) == (Counter(zip(a, a[1:])) & Counter(zip(b, b[1:]))).total()


def test_ngrams_by_built_ins_and_by_batches_agree(spark):
    draw = random.Random(11)
    text = lambda: " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 60)))
    pairs = [(str(i), text(), text()) for i in range(300)] + [("one", "a", "a"), ("null", None, "a b")]
    df = spark.createDataFrame(pairs, "id string, output string, response string")
    for key in ("rouge1", "rouge2"):
        alone = rouge.rouge_scores(df, [key])
        assert "struct" not in alone._jdf.queryExecution().optimizedPlan().toString()
        beside = rouge.rouge_scores(df, [key, "rougeL"])
        assert sorted(alone.select("id", key).collect()) == sorted(beside.select("id", key).collect())


def test_keys_that_are_not_asked_for_cost_nothing(monkeypatch):
    def never(*_):
        raise AssertionError

    monkeypatch.setattr(R, "lcs_sum_hits", never)
    assert R._hits("a b\nc", "c\na b", False, False, True, False) == (3, 3, 0, 0, 2, 2)
    monkeypatch.setattr(R, "lcs_length", never)
    assert R._hits("a b\nc", "c\na b", True, True, False, False) == (3, 3, 3, 1, 0, 0)


def test_long_sides_and_repeated_sentences(monkeypatch):
    draw = random.Random(8)
    long, short = [[str(draw.randint(0, 40)) for _ in range(n)] for n in (900, 60)]
    assert R.lcs_length(long, short) == R.lcs_length(short, long) == table(long, short)[-1][-1]
    calls, traced_once = [], R.lcs_positions
    monkeypatch.setattr(R, "lcs_positions", lambda *a: calls.append(a) or traced_once(*a))
    assert R.lcs_sum_hits([["a", "b", "c"]] * 50, [["a", "b"]] * 40) == 80
    assert len(calls) == 1


def test_rows_of_other_kinds_are_passed_over(monkeypatch):
    import pandas as pd

    seen, counted = [], R._hits
    monkeypatch.setattr(R, "_hits", lambda *a: seen.append(a) or counted(*a))
    batch = (pd.Series(["", "a b", "", "c"]), pd.Series(["", "a", "d", ""]))
    (found,) = R.hits_of(R.KEYS).func(iter([batch]))
    assert found[["reference", "candidate", "rouge1"]].to_numpy().tolist() == [[0, 0, 0], [2, 1, 1], [0, 1, 0], [1, 0, 0]]
    assert len(seen) == 3
