import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taskmill import scale
from taskmill.operators import ordering, sampling

SCHEMA = "id string, lang string, dataset string, task string, output string"


def key(seed, id_):
    return int(hashlib.md5(f"{seed}|{id_}".encode()).hexdigest()[:15], 16)


def corpus(spark, sizes, task="Detection"):
    rows, i = [], 0
    for (lang, dataset, output), n in sizes.items():
        for _ in range(n):
            rows.append((f"r{i}", lang, dataset, task, output))
            i += 1
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def expected_takes(counts, samples):
    total = sum(counts.values())
    if total <= samples:
        return dict(counts)
    share = {k: samples * n // total for k, n in counts.items()}
    order = sorted(counts, key=lambda k: (-(samples * counts[k] % total), k is not None, k or ""))
    for k in order[: samples - sum(share.values())]:
        share[k] += 1
    return share


def expected_sample(rows, samples, seed=42):
    strata = defaultdict(list)
    for row in rows:
        strata[row[1:3], row[4]].append(row[0])
    chosen = set()
    for group in {g for g, _ in strata}:
        counts = {s: len(v) for (g, s), v in strata.items() if g == group}
        for stratum, take in expected_takes(counts, samples).items():
            ids = sorted(strata[group, stratum], key=lambda i: (key(seed, i), i))
            chosen.update(ids[:take])
    return chosen


def test_hash_key_is_the_stated_one(spark):
    from taskmill.functions.hashing import hash_key

    got = spark.createDataFrame([("a",), ("é",)], "id string").select(hash_key(42, "id")).collect()
    assert [r[0] for r in got] == [key(42, "a"), key(42, "é")]


def test_stratified_sample_matches_brute_force(spark):
    sizes = {("en", "d", "a"): 700, ("en", "d", "b"): 201, ("en", "d", None): 99, ("ar", "d", "a"): 30,
             ("en", "e", "x"): 10, ("en", "e", "y"): 10, ("en", "e", "z"): 10}
    rows, df = corpus(spark, sizes)
    for samples in (1, 16, 30, 100, 5000):
        got = {r.id for r in sampling.stratified_sample(df, samples).collect()}
        assert got == expected_sample(rows, samples)
    assert sampling.stratified_sample(df, 0) is df


def test_sample_does_not_depend_on_partitions_or_broadcast(spark, monkeypatch):
    _, df = corpus(spark, {("en", "d", "a"): 90, ("en", "d", "b"): 30})
    want = {r.id for r in sampling.stratified_sample(df, 40).collect()}
    monkeypatch.setattr(scale, "BROADCAST_BYTES", -1)
    shuffled = sampling.stratified_sample(df.repartition(1), 40)
    assert {r.id for r in shuffled.collect()} == want
    assert "__heavy" in shuffled._jdf.queryExecution().toString()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 60), min_size=1, max_size=5), st.integers(1, 150))
def test_allocation_is_exact_and_within_strata(spark, counts, samples):
    sizes = spark.createDataFrame([("d", f"s{i}", n) for i, n in enumerate(counts)],
                                  "dataset string, stratum string, size bigint")
    got = {r.stratum: r.take for r in sampling.allocate(sizes, samples, ["dataset"]).collect()}
    assert sum(got.values()) == min(samples, sum(counts))
    assert all(got[f"s{i}"] <= n for i, n in enumerate(counts))
    assert got == expected_takes({f"s{i}": n for i, n in enumerate(counts)}, samples)


def test_equal_fractions_go_by_name(spark):
    sizes = spark.createDataFrame([("d", s, 10) for s in "cab"], "dataset string, stratum string, size bigint")
    got = {r.stratum: r.take for r in sampling.allocate(sizes, 20, ["dataset"]).collect()}
    assert got == {"a": 7, "b": 7, "c": 6}


def test_copies_of_an_id_still_give_the_exact_size(spark):
    rows = [("same", "en", "d", "t", "a")] * 50 + [(f"x{i}", "en", "d", "t", "a") for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    for samples in (1, 30, 60, 99):
        got = sampling.stratified_sample(df, samples).collect()
        assert len(got) == samples
        assert not Counter(got) - Counter(df.collect())


def test_strict_sampling_names_the_dataset(spark):
    _, df = corpus(spark, {("en", "lonely", "a"): 20, ("en", "lonely", "b"): 1})
    with pytest.raises(ValueError, match="lonely"):
        sampling.stratified_sample(df, 10, strict=True)
    assert sampling.stratified_sample(df, 10).count() == 10
    _, even = corpus(spark, {("en", "even", "a"): 5, ("en", "even", "b"): 5, ("en", "even", "c"): 5})
    for samples in (2, 13):
        with pytest.raises(ValueError, match="even"):
            sampling.stratified_sample(even, samples, strict=True)
    assert sampling.stratified_sample(even, 15, strict=True).count() == 15


def test_uniform_sample(spark):
    rows, df = corpus(spark, {("en", "d", "a"): 40, ("ar", "e", "b"): 8})
    got = sampling.uniform_sample(df, 10).collect()
    assert Counter(r.dataset for r in got) == {"d": 10, "e": 8}
    best = sorted((r[0] for r in rows if r[2] == "d"), key=lambda i: (key(42, i), i))[:10]
    assert {r.id for r in got if r.dataset == "d"} == set(best)
    with pytest.raises(ValueError, match="'dataset': 'e'"):
        sampling.uniform_sample(df, 10, on_short="error")


def test_corpus_sample_treats_summaries_uniformly(spark):
    _, labelled = corpus(spark, {("en", "d", "a"): 60, ("en", "d", "b"): 20})
    rows, summaries = corpus(spark, {("en", "s", f"text {i}"): 1 for i in range(30)}, "Summarization")
    both = labelled.unionByName(summaries.withColumn("id", F.concat(F.lit("s"), "id")))
    got = sampling.sample_corpus(both, 20).collect()
    assert Counter((r.dataset, r.output if r.dataset == "d" else None) for r in got) == {
        ("d", "a"): 15, ("d", "b"): 5, ("s", None): 20,
    }
    with pytest.raises(ValueError):
        sampling.sample_corpus(both, 40, strict=True).count()


def expected_order(rows, group):
    return [r[0] for r in sorted(rows, key=lambda r: (*group(r), key(42, r[0]), r[0]))]


@pytest.mark.parametrize("parts", ["3", "8"])
def test_shuffles_number_every_row(spark, parts):
    sizes = {("hi", "z", "a"): 40, ("ar", "b", "a"): 5, ("ar", "a", "a"): 300, ("en", "c", "a"): 1, ("xx", "q", "a"): 3}
    rows, df = corpus(spark, sizes)
    rank = {"ar": 0, "en": 1, "hi": 2}
    groups = {
        "none": lambda r: (rank.get(r[1], 3), r[1], r[2]),
        "by_language": lambda r: (rank.get(r[1], 3), r[1]),
        "fully": lambda r: (),
    }
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for mode, group in groups.items():
            got = ordering.shuffle(df, mode).collect()
            assert [r.id for r in sorted(got, key=lambda r: r.position)] == expected_order(rows, group)
            assert sorted(r.position for r in got) == list(range(len(rows)))
            assert [r.position for r in got] == list(range(len(rows))), "laid out in order"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shuffle_by_task_drops_rows_without_a_task(spark):
    rows = [(f"r{i}", "en", "d", [None, "b", "A"][i % 3], "o") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ordering.shuffle(df, "by_task").orderBy("position").collect()
    assert [r.id for r in got] == expected_order([r for r in rows if r[3]], lambda r: (r[3],))
    with pytest.raises(ValueError):
        ordering.shuffle(df, "sideways")


def test_permutation_within_groups(spark):
    rows, df = corpus(spark, {("en", "d", "a"): 50, ("en", None, "a"): 20})
    got = ordering.permute(df).collect()
    for dataset in ("d", None):
        mine = sorted((r for r in got if r.dataset == dataset), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(mine)))
        assert [r.id for r in mine] == expected_order([r for r in rows if r[2] == dataset], lambda r: ())
    other = ordering.permute(df, seed=7).orderBy("dataset", "position").collect()
    assert [r.id for r in other] != [r.id for r in sorted(got, key=lambda r: (r.dataset or "", r.position))]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sampling.stratified_sample(empty, 5).count() == 0
    assert ordering.shuffle(empty, "fully").count() == 0
    assert "position" in ordering.shuffle(empty, "by_task").columns


def test_rows_without_id_are_sampled_like_others(spark):
    rows = [(None if i % 3 == 0 else str(i), "en", "d", f"l{i % 2}") for i in range(12)]
    df = spark.createDataFrame(rows, "id string, lang string, dataset string, output string")
    for n in range(1, 12):
        for seed in (42, 7):
            assert sampling.uniform_sample(df, n, seed=seed).count() == n
            assert sampling.stratified_sample(df, n, seed=seed).count() == n


def whole_rows(n=400):
    rng = random.Random(9)
    rows = [(rng.choice(["1", "2", None, ""]), "en", "d", f"text {i % 90}" if i % 3 else None) for i in range(n)]
    return rows + [("1", "en", "d", "the same")] * 150


def test_whole_rows_order_alike_however_they_are_dealt(spark):
    rows, ddl = whole_rows(), "id string, lang string, dataset string, input string"
    orders = []
    for seed, parts in ((1, 1), (2, 7), (3, 16)):
        shuffled = random.Random(seed).sample(rows, len(rows))
        got = ordering.shuffle(spark.createDataFrame(shuffled, ddl).repartition(parts), "fully", id_col=None).collect()
        assert sorted(r.position for r in got) == list(range(len(rows)))
        assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
        orders.append([tuple(r)[:4] for r in sorted(got, key=lambda r: r.position)])
    assert orders[0] == orders[1] == orders[2]
    beside = sum(a == b for a, b in zip(orders[0], orders[0][1:]))
    # 150 equal rows of 550 lie beside each other about 41 times by chance.
    assert beside < 90


def test_copies_are_made_again_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(ordering, "COPIES", 7)
    rows = spark.createDataFrame(whole_rows(), "id string, lang string, dataset string, input string")
    got = ordering.with_copies(rows).collect()
    numbers = {}
    for r in got:
        numbers.setdefault(r["__digest"], []).append(r["__copy"])
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values())
    assert sum(map(len, numbers.values())) == 550 and max(map(len, numbers.values())) >= 150


def test_rows_without_id_are_spread_over_the_slices(spark):
    rows = spark.range(4000).select(F.lit(None).cast("string").alias("id"), F.lit("en").alias("lang"), F.col("id").cast("string").alias("input"))
    slices = ordering.shuffle(rows, "fully", id_col=None).groupBy(F.spark_partition_id()).count().collect()
    assert len(slices) == 8 and max(r["count"] for r in slices) < 700
