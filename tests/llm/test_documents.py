"""Operators on texts against plain versions, with the odd cases of each."""

import random

import pytest
from brute import contamination, folded, near_classes, quality, repeats, sha, words

from taskmill.llm import compression_quality, language_spans
from taskmill.llm.dart_minhash import near_duplicates, shingles, signature
from taskmill.llm.decontamination import decontaminate
from taskmill.llm.quality_rules import apply_quality_rules
from taskmill.llm.repeats import remove_repeats

random.seed(5)
VOCABULARY = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(300)]


def prose(n, seed=None):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def frame(spark, rows, ddl="doc_id long, text string"):
    return spark.createDataFrame(rows, ddl)


PASSAGE = prose(60, 1)
ODD = [
    (1, PASSAGE + " one two three"), (2, prose(20, 2) + " " + PASSAGE + "\n" + prose(30, 3)),
    (3, None), (4, ""), (5, " \t\n\x0b\x0c\r "), (6, "single"), (7, prose(5000, 4) + " " + PASSAGE),
    (8, PASSAGE.upper()), (9, "same line\nsame line\nsame line\n\n\n"), (10, "a b c d e f g h " * 30),
    (None, PASSAGE), (None, prose(40, 2)), (2, prose(20, 2) + " " + PASSAGE + "\n" + prose(30, 3)),
    (11, "NBSP joined   Ünï-code 漢字\U0001F600 # $ % <b>|</b>"), (12, prose(13, 9)), (13, prose(13, 9)),
    (14, "x\x00y\u0085z ​ w"), (0, prose(12, 9)),
]


@pytest.mark.parametrize("chunk_bytes", [8 << 20, 3000])
def test_repeats_equal_brute_force(spark, chunk_bytes):
    docs = frame(spark, [(i, t, "clash", 5) for i, t in ODD], "doc_id long, text string, kept_text string, __id2 int")
    got = remove_repeats(docs, chunk_bytes=chunk_bytes)
    assert got.columns == ["doc_id", "text", "__id2", "n_words", "n_removed", "kept_text", "removed"]
    rows = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()), key=str)
    assert rows == sorted(repeats(ODD), key=str)
    for r in got.collect():
        assert sum(s["len"] for s in r.removed) == r.n_removed


def test_repeats_random_texts_and_windows(spark):
    rng = random.Random(3)
    small = ["a", "b", "c"]
    rows = [(i, " ".join(rng.choice(small) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    for window in (3, 4, 13):
        got = remove_repeats(frame(spark, rows), window=window, chunk_bytes=700).select("doc_id", "n_words", "n_removed", "kept_text")
        assert sorted(map(tuple, got.collect())) == sorted(repeats(rows, window))
    with pytest.raises(ValueError):
        remove_repeats(frame(spark, rows), window=2)


def test_repeats_of_nothing(spark):
    assert remove_repeats(frame(spark, [])).count() == 0


ITEMS = [(1, PASSAGE), (2, "Hello, World"), (3, None), (4, "..."), (5, prose(13, 9)), (6, prose(13, 9)), (7, "漢字"), (None, prose(14, 77)),
         (8, "a b c d e f g"), (2, "Hello, World"), (9, "x")]


@pytest.mark.parametrize("options", [{}, {"exact_shingles": 3, "filter_bits": 64}, {"exact_shingles": 0}])
def test_decontamination_equals_brute_force(spark, options):
    docs = ODD + [(20, "Say HELLO world! hello-world"), (21, prose(9, 5) + " " + " ".join(PASSAGE.split()[20:40]) + " 漢字。漢字"),
                  (22, prose(14, 77)), (23, "a b c d e f g a b c d e f g")]
    got = decontaminate(
        frame(spark, [(i, t, 1) for i, t in docs], "doc_id long, text string, row int"),
        frame(spark, [(i, t, "z") for i, t in ITEMS], "item_id long, text string, items string"), **options,
    )
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=str)
    assert rows == sorted(contamination(docs, ITEMS), key=str)


def test_decontamination_of_and_by_nothing(spark):
    assert decontaminate(frame(spark, []), frame(spark, ITEMS, "item_id long, text string")).count() == 0
    got = decontaminate(frame(spark, ODD), frame(spark, [], "item_id long, text string")).collect()
    assert len(got) == len(ODD) and all(r.n_hit == 0 and r["items"] == [] for r in got)


def test_quality_counts_and_verdicts(spark):
    clean = [(100 + i, prose(120, 1000 + i), "en", f"s{i % 2}") for i in range(300)]
    junk = [(500 + i, " ".join(w + "%%%" for w in prose(60, i).split()), "en", "s0") for i in range(6)]
    rows = [(i, t, None if i == 7 else "en", "s1") for i, t in ODD] + clean + junk
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, lang string, source string, kept string")
    got = apply_quality_rules(docs).collect()
    counts = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str)
    assert counts == sorted(((i, *quality(t)) for i, t, _, _ in rows), key=str)
    verdict = {r.doc_id: r for r in got}
    assert all(verdict[i].kept for i, *_ in clean)
    assert all("symbols" in verdict[i].failed_rules and not verdict[i].kept for i, *_ in junk)
    assert not verdict[4].kept and verdict[4].base_failed


def test_quality_rules_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert apply_quality_rules(empty).count() == 0
    short = spark.createDataFrame([(1, "too short", None, None)], "doc_id long, text string, lang string, source string")
    assert [r.kept for r in apply_quality_rules(short).collect()] == [False]


def changed(text, n, seed):
    rng, w = random.Random(seed), text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


def test_near_duplicates_equal_brute_force(spark):
    base = [prose(150, i) for i in range(12)]
    rows = [(i * 100, t) for i, t in enumerate(base, 1)]
    rows += [(i * 100 + k, changed(t, k % 9, i * 50 + k)) for i, t in enumerate(base, 1) for k in range(1, 18)]
    rows += [(5000 + i, PASSAGE + " " + prose(25, 300 + i)) for i in range(30)]
    rows += [(i, t) for i, t in ODD if i not in (None, 2)] + [(None, PASSAGE), (None, None)]
    rows += [(7000, "three words only"), (7001, "Three words, ONLY!"), (7002, "ha " * 500), (7003, "ha " * 490), (7003, prose(150, 3))]
    got = near_duplicates(frame(spark, [(i, t, 0) for i, t in rows], "doc_id long, text string, class_id int")).collect()
    assert len(got) == len(rows)
    want = near_classes(rows)
    assert {(r.doc_id, r.class_id) for r in got if r.doc_id is not None} == set(want.items())
    assert all(r.class_id is None for r in got if r.doc_id is None)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    got = near_duplicates(frame(spark, [(1, None), (2, ""), (3, "...")])).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(1, 1), (2, 2), (3, 3)]


def test_signatures_agree_as_often_as_the_weighted_similarity():
    import numpy as np

    rng = np.random.default_rng(2)
    elements = rng.integers(1, 2**63, 400).astype(np.uint64)
    a = rng.integers(1, 4, 400).astype(float) * 0.7
    b = np.where(rng.random(400) < 0.3, rng.integers(0, 5, 400) * 0.7, a)
    same = (signature(elements, a, 3000) == signature(elements[b > 0], b[b > 0], 3000)).mean()
    assert abs(same - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    assert (signature(*shingles([b"only"]), 64) != 0).all()


LANGUAGES = {"aa": "bcdfa", "ee": "klmne", "oo": "prsto", "ru": "бвгда"}


def speech(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(LANGUAGES[lang]) for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    rows = [(speech(k, 60, i), k) for k in LANGUAGES for i in range(40)] + [(None, "aa"), ("text", None), ("", "aa")]
    return language_spans.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_languages_and_spans(spark, languages):
    rows = [(f"{k}{i}", speech(k, 30, 100 + i)) for k in LANGUAGES for i in range(20)]
    rows += [("mix", speech("aa", 40, 7) + ". " + speech("ee", 25, 8)), ("null", None), ("empty", ""), ("digits", "12 345 --"),
             ("strange", "漢字 漢字"), ("long", speech("oo", 30000, 1)), ("rus", "БВГ " * 5)]
    docs = spark.createDataFrame([(*r, "old") for r in rows], "id string, text string, lang_pred string")
    got = {r.id: r for r in language_spans.identify(docs, languages).collect()}
    assert len(got) == len(rows)
    right = [got[f"{k}{i}"].lang_pred == k for k in LANGUAGES for i in range(20)]
    assert all(right) and all(0 <= r.score <= 1 for r in got.values())
    assert [(s.lang, s.begin) for s in got["mix"].spans] == [("aa", 0), ("ee", 40)] and got["mix"].lang_pred == "aa"
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in ("null", "empty", "digits"))
    assert got["strange"].lang_pred in languages.languages and got["long"].lang_pred == "oo" and got["rus"].lang_pred == "ru"


def test_no_language_is_known(spark):
    model = language_spans.fit(spark.createDataFrame([], "text string, lang string"))
    got = language_spans.identify(spark.createDataFrame([("some text",)], "text string"), model).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_the_way_through_languages_is_the_best():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(60):
        scores = rng.normal(size=(7, 3)) * 3
        cost = lambda way: sum(scores[i, s] for i, s in enumerate(way)) - 4.0 * sum(a != b for a, b in zip(way, way[1:]))  # noqa: E731, B023
        best = max(map(cost, itertools.product(range(3), repeat=7)))
        assert abs(cost(language_spans.label_words(scores, 4.0)) - best) < 1e-9


def test_compression_quality(spark):
    good = [(i, prose(80, i), 1) for i in range(120)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(60, 900 + i).split()), 0) for i in range(60)]
    rows = good + bad + [(2000, None, 1), (2001, "", 0), (None, "x", 1), (2002, prose(10, 1), None), (2003, prose(10, 1), 7)]
    docs = spark.createDataFrame([(i, t, "old") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, 1)], "doc_id long, quality int")
    model = compression_quality.fit(docs.where("pmod(doc_id, 3) <> 0"), labels)
    scored = compression_quality.score_quality(docs, model)
    right = compression_quality.accuracy(scored.where("pmod(doc_id, 3) = 0 and text <> ''"), labels)
    assert right[1] > 0.95 and right[0] > 0.95
    got = scored.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1


def test_compression_quality_without_labels(spark):
    docs = frame(spark, [(1, "text"), (2, None)])
    model = compression_quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in compression_quality.score_quality(docs, model).collect()] == [0.5, 0.5]


def test_word_rules():
    assert words("a b c\x0bd") == ["a b", "c", "d"] and folded("A-b É") == ["a", "b", "É"] and sha("") .startswith("e3b0")


def test_quality_keeps_the_columns_of_the_user(spark):
    docs = spark.createDataFrame(
        [(i, prose(30, i), "en", "s", 1, 2, 3, 4) for i in range(5)],
        "doc_id long, text string, lang string, source string, __limits int, __lang int, __counted int, __lined int",
    )
    got = apply_quality_rules(docs).collect()
    assert {(r["__limits"], r["__lang"], r["__counted"], r["__lined"]) for r in got} == {(1, 2, 3, 4)} and len(got) == 5


def test_cutoffs_move_smoothly_with_the_size_of_a_group(spark):
    """A group of 99 and one of 101 documents that are spread alike have nearly the same cutoffs."""
    from taskmill.llm.quality_rules import cutoffs, features, shrunk, sketch

    rows = [(n, prose(30, i) + " #" * (i % 4), "en", f"s{n}") for n in (99, 101) for i in range(n)]
    rows += [(0, prose(30, i) + " #" * 6, "fr", "other") for i in range(300)]
    counted = features(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).drop("text")
    named = counted.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    sketches = sketch(named, ("__lang", "__source"))
    tables = [cutoffs(sketches, by) for by in (("__lang", "__source"), ("__lang",), ())]
    got = {r["__source"]: r.limits["symbols"]["high"] for r in shrunk(*tables).collect()}
    own = {r["__source"]: r.high for r in tables[0].where("rule = 'symbols'").collect()}
    assert abs(got["s99"] - got["s101"]) < 0.02
    assert own["s99"] < got["s99"] and abs(got["other"] - own["other"]) < abs(got["s99"] - own["s99"])


def test_repeats_and_ids_keep_the_columns_of_the_user(spark):
    from taskmill.llm.sentencepiece_lattice import encode, make_pieces

    docs = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, __chunk int, __id int, __text int")
    row = remove_repeats(docs).first()
    assert (row["__chunk"], row["__id"], row["__text"], row.kept_text) == (5, 6, 7, "a b")
    pieces = make_pieces("bpe", [("\u2581", -1.0), ("a", -2.0), ("b", -3.0)])
    row = encode(docs, pieces).first()
    assert (row["__text"], row.text, row.n_ids) == (7, "a b", 4)


def test_size_differences_equal_plain_compression(spark):
    import zstandard

    good, bad = prose(3000, 1).encode(), prose(3000, 2).encode()

    def size(text, dictionary):
        data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        frame = zstandard.ZstdCompressor(
            level=3, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        return sum(len(frame.compress(text[i : i + 1024])) for i in range(0, len(text), 1024))

    texts = [prose(n, n).encode() for n in (0, 1, 30, 5000)] + [good[:900], bad[-900:], None]
    got = list(compression_quality.size_differences(texts, good, bad))
    want = [(size(t or b"", bad) - size(t or b"", good)) / max(1, len(t or b"")) ** 0.5 for t in texts]
    assert got == pytest.approx(want) and got[4] > 5 and got[5] < -5 and got[6] == 0


def test_dictionaries_have_equal_sizes_and_come_from_whole_texts(spark):
    rows = [(i, prose(2000 if i % 2 else 60, i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = compression_quality.fit(docs, labels)
    assert len(model.good) == len(model.bad) > 5000 and len(model.weights) == 2
    texts = {t for _, t in rows}
    assert any(model.good[:500].decode() in t for t in texts)


def test_the_filter_lets_every_wanted_shingle_through(spark):
    import numpy as np

    from taskmill.llm import decontamination as d

    items = frame(spark, [(i, prose(40, i)) for i in range(200)], "item_id long, text string")
    known = d.item_shingles(items)
    exact, bloom = d.shingle_filter(known), d.shingle_filter(known, 10)
    assert exact.bits is None and bloom.exact is None and exact.sizes == bloom.sizes == (5,)
    strange = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    assert exact.passes(exact.exact).all() and bloom.passes(exact.exact).all()
    assert not exact.passes(strange).any() and bloom.passes(strange).mean() < 0.03
    empty = d.shingle_filter(known.limit(0))
    assert empty.sizes == () and not empty.passes(strange).any()


def test_texts_are_read_once_however_many_items(spark):
    from taskmill.llm import decontamination as d

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = frame(spark, [(i, prose(60, i)) for i in range(50)]).mapInArrow(counted, "doc_id long, text string")
    items = frame(spark, [(i, prose(30, 40 + i)) for i in range(20)], "item_id long, text string")
    d.decontaminate(docs, items, exact_shingles=10).collect()
    assert seen.value == 50


def test_a_bucket_of_repeats_takes_little_memory():
    import tracemalloc

    import numpy as np

    from taskmill.llm import repeats
    from taskmill.llm.common import pack_sorted, unpack_sorted

    draw = np.random.default_rng(3)
    hashes = [np.unique(draw.integers(0, 2**20, 50000, dtype=np.uint64)) for _ in range(8)]
    marks = [draw.integers(0, 4, len(h), dtype=np.uint64) for h in hashes]
    table = repeats._blobs([
        {"chunk": 10 + i, "bucket": 1, "keys": pack_sorted((h << np.uint64(2)) | m)} for i, (h, m) in enumerate(zip(hashes, marks))
    ])
    tracemalloc.start()
    found = repeats._shared_anchors((None,), table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    holders, marked = {}, {}
    for h, m in zip(hashes, marks):
        for x, y in zip(h.tolist(), m.tolist()):
            holders[x], marked[x] = holders.get(x, 0) + 1, marked.get(x, 0) | y
    shared = {x for x, n in holders.items() if marked[x] & 2 and (n > 1 or marked[x] & 1)}
    got = {c: set(unpack_sorted(k).tolist()) for c, k in zip(found.column("chunk").to_pylist(), found.column("keys").to_pylist())}
    assert got == {10 + i: shared & set(h.tolist()) for i, h in enumerate(hashes)}
    assert most < 48 * sum(map(len, hashes))
