"""JSON objects of files of any size, read in parallel wherever their boundaries lie.

A file is an array of objects, or objects one after the other. It is read as text cut at every closing
brace, which Spark does in parallel for any file system. Whether such a brace ends an object depends on
all text before it, but only through two numbers: whether a string is open, and how many objects are.
A first pass sums up for each block of a file what it does to these, a running sum over the blocks gives
the state at each begin, and a second pass puts the objects together. Those that reach over the end of a
block are joined from their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskmill.scale import settle

CORRUPT = "_corrupt"
# The bytes of a byte order mark, which the reader takes off.
BOM = 3
PLACE = ("file", "block", "place")
_ESCAPED = re.compile(r"\\.", re.DOTALL)
_BETWEEN = " \t\r\n,[]﻿"
_STATES = "file string, block long, size long, bytes long, quotes long, depth_outside long, depth_inside long"
_FOUND = "file string, block long, place long, kind string, text string"


def _outside(text: str) -> list[str]:
    """The text between quotation marks, which outside and inside parts take turns in."""
    return (_ESCAPED.sub("", text) if "\\" in text else text).split('"')


def _braces(parts: Sequence[str]) -> int:
    return sum(p.count("{") for p in parts)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block does: its bytes and quotes, and the change of depth if it begins outside or inside a string."""
    now, row = None, []
    for batch in batches:
        done = []
        for file, block, size, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (file, block) != now:
                if now is not None:
                    done.append(row)
                now, row = (file, block), [file, block, size, 0, 0, 0, 0]
            parts = _outside(text)
            row[3] += len(text.encode()) + 1
            for begins in (0, 1):
                inside = (begins + row[4]) % 2
                row[5 + begins] += _braces(parts[inside::2]) - ((inside + len(parts) - 1) % 2 == 0)
            row[4] += len(parts) - 1
        if done:
            yield _table(done, _STATES)
    if now is not None:
        yield _table([row], _STATES)


def _table(rows: list, ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _states(pieces: DataFrame) -> DataFrame:
    """The state at the begin of every block, and whether the file's last piece has no brace after it."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    sums = pieces.select("file", "block", "size", "text").mapInArrow(_sums, _STATES)

    # With a brace counted after every piece, one too many means that the last had none.
    beyond = F.sum("bytes").over(whole) - F.col("size")

    def running(column: Column) -> Column:
        return F.coalesce(F.sum(column).over(before), F.lit(0))

    inside = sums.withColumns({
        "inside": (running(F.col("quotes")) % 2).cast("int"), "offset": running(F.col("bytes")),
        "open_end": beyond.isin(1, 1 - BOM) & (F.col("block") == F.max("block").over(whole)),
    })
    return inside.withColumn(
        "depth", running(F.when(F.col("inside") == 0, F.col("depth_outside")).otherwise(F.col("depth_inside"))).cast("int")
    ).select("file", "block", "inside", "depth", "open_end", "offset")


class _Block:
    """The pieces of one block, put together to objects."""

    def __init__(self, inside: int, depth: int) -> None:
        self.inside, self.depth = inside, depth
        # The first object may have begun in an earlier block.
        self.kind = "head" if inside or depth else "whole"
        self.parts: list[str] = []

    def add(self, text: str, closed: bool = True) -> tuple[str, str] | None:
        """Take a piece, with the brace after it if there is one; the object that it ends, with its kind."""
        if not self.parts and not self.inside and not self.depth:
            text = text.lstrip(_BETWEEN)
        found = _outside(text)
        self.depth += _braces(found[self.inside :: 2])
        self.inside = (self.inside + len(found) - 1) % 2
        self.parts.append(text + "}" if closed else text)
        if not closed or self.inside:
            return None
        self.depth -= 1
        if self.depth > 0:
            return None
        self.depth = 0
        return self._taken()

    def _taken(self) -> tuple[str, str]:
        kind, text = self.kind, "".join(self.parts)
        self.kind, self.parts = "whole", []
        return kind, text

    def rest(self) -> tuple[str, str] | None:
        """What is left open: a part of an object, or what stands after the last one of a file."""
        between = not self.inside and not self.depth and self.kind == "whole"
        kind, text = self._taken()
        if between:
            text = text.strip(_BETWEEN)
        return ("tail" if kind == "whole" else kind, text) if text else None


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The objects of each block, and the parts of those that begin before it or end after it."""
    now, block, held, open_end, place = None, None, None, False, 0
    done: list[tuple] = []

    def keep(found: tuple[str, str] | None) -> None:
        nonlocal place
        if found is not None:
            done.append((*now, place, *found))
            place += 1

    def finish() -> None:
        if now is not None:
            # Only the last piece of a file may have no brace after it.
            keep(block.add(held, not open_end))
            keep(block.rest())

    for batch in batches:
        for file, begin, text, inside, depth, end in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if (file, begin) == now:
                keep(block.add(held))
            else:
                finish()
                now, block, open_end, place = (file, begin), _Block(inside, depth), end, 0
            held = text
        if done:
            yield _table(done, _FOUND)
            done.clear()
    finish()
    if done:
        yield _table(done, _FOUND)


def _joined(parts: DataFrame) -> DataFrame:
    """Objects over several blocks: a part that begins one, and those that follow it. Two parts a block at most."""
    order = Window.partitionBy("file").orderBy("block", "place")
    numbered = parts.withColumn("number", F.sum((F.col("kind") == "tail").cast("int")).over(order))
    ordered = F.array_sort(F.collect_list(F.struct("block", "place", "text")))
    return numbered.groupBy("file", "number").agg(ordered.alias("parts")).select(
        "file", F.get("parts", F.lit(0))["block"].alias("block"), F.get("parts", F.lit(0))["place"].alias("place"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"),
    )


def read_objects(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(file, block, place, text) of every object, and the state of every block with its ``offset``.

    ``file``, ``block`` (where its block begins) and ``place`` order the objects as the files have them.
    What stands between objects, other than commas, brackets and white space, begins the next one's text.
    """
    raw = spark.read.option("lineSep", "}").text(paths)
    file = F.col("_metadata")
    pieces = raw.select(
        file["file_path"].alias("file"), file["file_block_start"].alias("block"), file["file_size"].alias("size"),
        F.col("value").alias("text"),
    )
    states = settle(_states(pieces))
    # Most blocks begin outside of everything; the others are few enough for every task, one row a block.
    special = states.where("inside = 1 or depth <> 0 or open_end").select(
        F.col("file").alias("__file"), F.col("block").alias("__block"), "inside", "depth", "open_end"
    )
    same = (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block"))
    begun = pieces.join(F.broadcast(special), same, "left").select(
        "file", "block", "text", F.coalesce("inside", F.lit(0)).alias("inside"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("open_end", F.lit(False)).alias("open_end"),
    )
    found = begun.mapInArrow(_objects, _FOUND)
    whole = found.where("kind = 'whole'").select(*PLACE, "text")
    return whole.unionByName(_joined(found.where("kind <> 'whole'"))), states


def _parsed(objects: DataFrame, schema: T.StructType) -> DataFrame:
    """The objects as records, with their text and what did not parse."""
    parsed = F.from_json(
        "text", T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    # Unpacked by a generator, so a filter on the outcome does not parse the text again.
    return objects.select(*PLACE, F.col("text").alias("__text"), F.inline(F.array(parsed)))


def strict_array(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """The records of JSON files with their ``file``, ``block`` and ``place``; a broken one fails the job."""
    objects, _ = read_objects(spark, paths)
    broken = F.raise_error(F.concat(F.lit("a record does not parse in "), "file", F.lit(": "), F.substring("__text", 1, 200)))
    rows = _parsed(objects, schema)
    return rows.where(F.when(F.col(CORRUPT).isNull(), F.lit(True)).otherwise(broken.cast("boolean"))).select(*schema.names, *PLACE)


def read_array(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """The records of JSON files with their ``file``, ``block`` and ``place``, and the broken ones.

    Broken records, among them what is left of a file that is cut off, come back in the second frame with
    their text, their file and the ``offset`` of the block that they begin in. The rows do not depend on
    how the files are split; empty files have none.
    """
    objects, states = read_objects(spark, paths)
    rows = _parsed(objects, schema)
    good = rows.where(F.col(CORRUPT).isNull()).select(*schema.names, *PLACE)
    offsets = states.select("file", "block", "offset")
    bad = rows.where(F.col(CORRUPT).isNotNull()).join(offsets, ["file", "block"]).select(
        "file", "offset", "place", F.col("__text").alias("text")
    )
    return good, bad
