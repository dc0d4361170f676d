"""Encoding against the public library and a plain Viterbi, and the pipeline on planted documents."""

import itertools
import random

import corpus_pipeline
import pytest
import sentencepiece

from taskmill.llm.sentencepiece_lattice import (
    SPACE, Lattice, decode, encode, encoded, load_pieces, make_pieces, merged, segment_units,
)

MODEL = corpus_pipeline.MODEL
TEXTS = [
    None, "", " ", "   two  spaces ", "Hello, World!\n\nNew\tline\r\n", "漢字 mixed Ünïcode \U0001F600\U0001F9D1‍\U0001F680", "a" * 200,
    "word " * 3000, "\n" * 90, "x\x00y", "éé ﬀ Ａ", "supercalifragilisticexpialidocious" * 5, "1234567890 3.14 -- ##",
]


@pytest.fixture(scope="module")
def pieces():
    return load_pieces(MODEL)


def test_ids_equal_the_library(spark, pieces):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate([*TEXTS, "Hello"] * 2)], "doc_id long, text string, ids string")
    for batch_bytes in (1 << 22, 100):
        got = {r.doc_id: r for r in encode(docs, pieces, batch_bytes=batch_bytes).collect()}
        assert len(got) == 2 * len(TEXTS) + 2
        for i, text in enumerate([*TEXTS, "Hello"] * 2):
            assert got[i].ids == (library.encode(text) if text else []) and got[i].n_ids == len(got[i].ids)
            assert got[i].round_trip and got[i].text == text
    back = decode(encode(docs, pieces).drop("text"), pieces).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate([*TEXTS, "Hello"] * 2)}


def test_an_escaped_space_does_not_come_back(spark, pieces):
    got = encode(spark.createDataFrame([(SPACE + "a",)], "text string"), pieces).first()
    assert not got.round_trip
    assert decode(spark.createDataFrame([(None,)], "ids array<int>"), pieces).first().text is None


def test_nothing_to_encode(spark, pieces):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), pieces).count() == 0


def toy():
    rng = random.Random(8)
    made = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(60)}
    return [("<unk>", 0.0), *((p, -rng.random() * 9 - 1) for p in [SPACE, "a", "b", *sorted(made)])]


def best_score(word, scores, unknown):
    best = None
    for cut in itertools.product([0, 1], repeat=len(word) - 1):
        parts, last = [], 0
        for i, c in enumerate([*cut, 1], 1):
            if c:
                parts.append(word[last:i])
                last = i
        if all(p in scores or len(p) == 1 for p in parts):
            total = sum(scores.get(p, unknown) for p in parts)
            best = total if best is None else max(best, total)
    return best


def test_unigram_ways_are_the_best(spark):
    table = toy()
    model = make_pieces("unigram", table, special=1)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    unknown = min(model.scores.values()) - 10
    lattice = Lattice(model)
    ids, ends = lattice.cut(words)
    score_of = {i: s for i, (_, s) in enumerate(table)} | {0: unknown}
    for k, word in enumerate(words):
        best = best_score(word, model.scores, unknown)
        assert abs(sum(model.scores.get(p, unknown) for p in merged(word, model)) - best) < 1e-9
        assert abs(sum(score_of[i] for i in ids[ends[k] : ends[k + 1]]) - best) < 1e-9
    relational(spark, sorted(set(words)), model)


def test_joined_pairs_are_those_of_the_relational_lattice(spark, pieces):
    words = [SPACE + w for w in ("Hello", "international", "aaaaaaa", "Ünïcode", "lexicographically", "zq")]
    relational(spark, words, pieces)


def relational(spark, words, model):
    """The arrays and the tables cut alike."""
    frame = spark.createDataFrame([(w,) for w in words], "unit string")
    for row in segment_units(frame, model).collect():
        begins = [0]
        for part in merged(row.unit, model)[:-1]:
            begins.append(begins[-1] + len(part))
        assert [i for i in range(len(row.unit)) if row.bounds >> i & 1] == begins


def test_slices_of_words_make_no_difference(pieces, monkeypatch):
    lattice = Lattice(pieces)
    whole = encoded(TEXTS, lattice)
    monkeypatch.setattr("taskmill.llm.sentencepiece_lattice.WORDS_AT_ONCE", 2)
    parts = encoded(TEXTS, lattice)
    assert all((a == b).all() for a, b in zip(whole, parts))


SYLLABLES = {"en": "the ing ion ter ent", "xx": "qua vra zho mli kre"}


def speech(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(2, 5))) for _ in range(n))


def test_pipeline_on_planted_documents(spark, tmp_path):
    passage, item = speech("en", 70, "passage"), speech("en", 40, "item")
    rows = [(i, speech(lang, 120, i), lang) for i, lang in enumerate(["en", "xx"] * 20, 1)]
    copy = rows[0][1]
    rows += [(100, copy, "en"), (101, copy + " " + speech("en", 3, 5), None), (102, speech("en", 60, 102) + " " + passage, "en"),
             (103, passage + " " + speech("en", 60, 103), None), (104, speech("en", 50, 104) + " " + item, "en"), (105, None, "en"),
             (106, "", "xx"), (107, "12 34 --", "en"), (2, rows[1][1], "xx"), (None, speech("xx", 90, 108), "xx")]
    path = str(tmp_path)
    spark.createDataFrame(
        [(i, t, lang, "web", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, path).collect()
    ids = [r.doc_id for r in got]
    assert sorted(ids, key=str) == sorted([*range(1, 41), 102, 103, None], key=str)
    pieces = load_pieces(MODEL)
    texts = {r.doc_id: r.text for r in decode(spark.createDataFrame([(r.doc_id, r.ids) for r in got], "doc_id long, ids array<int>"), pieces).collect()}
    want = dict((i, t) for i, t, _ in rows[:40]) | {102: dict((i, t) for i, t, _ in rows)[102], 103: speech("en", 60, 103)}
    assert {i: t for i, t in texts.items() if i} == want
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in got)
    assert {r.doc_id: r.lang for r in got}[103] == "en"


def test_pipeline_of_nothing(spark, tmp_path):
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_dedup", "substring_dedup", "benchmark_decontamination", "sentencepiece"]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, __row int, score string, n_words int"


def stage_rows(spark, stage, rows, sf_dir="", ddl=DOCUMENTS):
    docs = spark.createDataFrame([(i, t, None, "s", len(t or ""), k, "kept", 3) for k, (i, t) in enumerate(rows)], ddl)
    got = stage(spark, docs.repartition(3), sf_dir)
    assert got.columns == docs.columns
    return sorted((r["__row"] for r in got.collect()))


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_near_copies_go_but_texts_that_share_an_id_stay(spark):
    rows = [(1, prose(1)), (1, prose(2)), (2, prose(1)), (None, prose(1)), (None, prose(3)), (None, prose(3)),
            (7, prose(4)), (7, prose(4)), (8, None), (8, ""), (None, None), (0, prose(2) + " one")]
    # Of three copies of the first text the one with id 1 stays, of the second and its near copy that with id 0.
    assert stage_rows(spark, corpus_pipeline.near_dedup, rows) in ([0, 4, 6, 8, 9, 10, 11], [0, 4, 7, 8, 9, 10, 11],
                                                                   [0, 5, 6, 8, 9, 10, 11], [0, 5, 7, 8, 9, 10, 11])


def test_contaminated_rows_without_id_go(spark, tmp_path):
    spark.createDataFrame([(1, prose(9, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, prose(9, 30)), (None, prose(5)), (3, "x " + prose(9, 30)), (3, prose(6)), (None, None), (4, "")]
    assert stage_rows(spark, corpus_pipeline.benchmark_decontamination, rows, str(tmp_path)) == [1, 3, 4, 5]


def test_repeats_go_from_texts_and_the_rest_stays_as_it_is(spark):
    shared = prose(11, 30)
    rows = [(1, f"{shared}  left \n as"), (2, f"it  {shared}\n is"), (2, shared), (None, shared), (5, " a  b\n"), (6, None), (None, "")]
    docs = spark.createDataFrame([(i, t, None, "s", len(t or ""), k, "kept", 3) for k, (i, t) in enumerate(rows)], DOCUMENTS)
    got = {r["__row"]: (r.text, r.n_chars, r.n_words) for r in corpus_pipeline.substring_dedup(spark, docs, "").collect()}
    assert got == {0: (rows[0][1], len(rows[0][1]), 3), 1: ("it is", 5, 3), 4: (" a  b\n", 6, 3), 5: (None, 0, 3), 6: ("", 0, 3)}


def test_language_stage_keeps_columns_of_the_same_names(spark):
    rows = [(i, prose(i)) for i in range(4)] + [(9, None), (9, "123 456")]
    ddl = DOCUMENTS.replace("n_words int", "lang_pred int")
    docs = spark.createDataFrame([(i, t, None if k else "xx", "s", 0, k, "kept", 3) for k, (i, t) in enumerate(rows)], ddl)
    got = corpus_pipeline.language_id(spark, docs, "").collect()
    assert {(r["__row"], r.lang, r.score, r.lang_pred) for r in got} == {(k, "xx", "kept", 3) for k in range(4)}


def test_nothing_is_left_in_the_shared_folder_but_the_stages(spark, tmp_path):
    from pathlib import Path

    from taskmill.scale import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    sf = "/root/testdata/sf0.001"
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, sf).count() > 0
    made = [p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before]
    assert sorted(made) == sorted(f"stage-{name}" for name, _ in corpus_pipeline.STAGES)
