"""JSON arrays read in blocks of any size."""

import json
import random

import pytest
from pyspark.sql import types as T

from taskmill.sources.arrays import read_array

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "input", "note")])
TEXT = ['plain', 'a } brace', '{ open', '"quoted"', 'back\\slash', 'end\\', '\\"}', 'мир 漢字 \U0001F600', '}{}{"}', '', 'x' * 300, '}, {"id": "no"}']


def records(n, seed):
    rng = random.Random(seed)
    return [
        {"id": str(i), "input": " ".join(rng.choice(TEXT) for _ in range(rng.randint(0, 5))), "note": rng.choice([None, "n", {"a": {"b": "}"}}])}
        for i in range(n)
    ]


def written(folder, styles, n=60):
    want = {}
    for k, style in enumerate(styles):
        rows = records(n + k, k)
        path = folder / f"{k}.json"
        if style == "lines":
            text = "\n".join(json.dumps(r, ensure_ascii=False) for r in rows)
        else:
            text = json.dumps(rows, ensure_ascii=style == "ascii", indent=2 if style == "indent" else None)
        path.write_text({"bom": "﻿", "blank": " \n"}.get(style, "") + text + ("\n" if style != "ascii" else ""), "utf-8")
        want[f"{k}.json"] = [
            (r["id"], r["input"], r["note"] if r["note"] is None or isinstance(r["note"], str) else json.dumps(r["note"], separators=(",", ":")))
            for r in rows
        ]
    return want


@pytest.fixture
def blocks(spark):
    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [97, 1500, 1 << 27])
def test_rows_and_their_order_do_not_depend_on_the_blocks(spark, tmp_path, blocks, size):
    want = written(tmp_path, ["plain", "indent", "ascii", "lines", "bom", "blank"])
    blocks(size)
    good, bad = read_array(spark, str(tmp_path / "*.json"), SCHEMA)
    rows = sorted(good.collect(), key=lambda r: (r.file, r.block, r.place))
    got = {}
    for r in rows:
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.id, r.input, r.note))
    assert got == want
    assert bad.count() == 0


@pytest.mark.parametrize("size", [40, 1 << 27])
def test_broken_records_are_told_by_file_and_offset(spark, tmp_path, blocks, size):
    (tmp_path / "cut.json").write_text('[{"id": "1", "input": "a"},\n {"id": "2", "inp')
    (tmp_path / "bad.json").write_text('[{"id": "1", "input": nonsense}, {"id": "2", "input": "b"}]')
    (tmp_path / "between.json").write_text('[{"id": "1"}, oops {"id": "2"}, {"id": "3"}] trailing')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text(" [ ]\n")
    blocks(size)
    good, bad = read_array(spark, str(tmp_path / "*.json"), SCHEMA)
    name = lambda r: r.file.rsplit("/", 1)[1]
    assert sorted((name(r), r.id) for r in good.collect()) == [
        ("bad.json", "2"), ("between.json", "1"), ("between.json", "3"), ("cut.json", "1")
    ]
    assert sorted((name(r), r.text) for r in bad.collect()) == [
        ("bad.json", '{"id": "1", "input": nonsense}'), ("between.json", 'oops {"id": "2"}'), ("between.json", "trailing"),
        ("cut.json", '{"id": "2", "inp'),
    ]
    for r in bad.collect():
        text = (tmp_path / name(r)).read_text()
        assert 0 <= r.offset <= text.index(r.text)


def test_one_record_over_many_blocks(spark, tmp_path, blocks):
    big = {"id": "big", "input": "} { \" \\ " * 500}
    (tmp_path / "a.json").write_text(json.dumps([{"id": "0"}, big, {"id": "2"}]))
    blocks(64)
    good, bad = read_array(spark, str(tmp_path / "a.json"), SCHEMA)
    assert sorted((r.id, r.input) for r in good.collect()) == [("0", None), ("2", None), ("big", big["input"])]
    assert bad.count() == 0
