"""Token counts from the distinct pre-tokens of a corpus."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from taskmill.llm.common import free_names
from taskmill.scale import stage

SPACE = "▁"
LIMIT = 4096
# The most frequent pre-tokens up to this size are broadcast; the others are joined by a shuffle.
HEAD_BYTES = 24 * 1024 * 1024
# What a pre-token takes beside its text.
ENTRY_BYTES = 40
# Texts are split and pre-tokens counted about so many bytes and rows at a time.
SLICE_BYTES = 1 << 20
UNITS_AT_ONCE = 1 << 14


class PreTokens:
    """How texts fall apart into pre-tokens that the pieces of a SentencePiece model never reach across.

    Pieces hold spaces in front only, so a run of characters that occur in longer pieces is a pre-token
    with the spaces before it, and any other character is one alone. Where that does not hold (a
    normalising model, one without byte pieces, pieces with a space inside), the whole text is one.
    """

    def __init__(self, model: bytes) -> None:
        self.model = model
        library = self.library()
        ids = range(library.get_piece_size())
        closed = {i for i in ids if library.is_control(i) or library.is_unknown(i) or library.is_byte(i)}
        longer = [p for i in ids if i not in closed and len(p := library.id_to_piece(i)) > 1]
        joined = {c for p in longer for c in p} - {SPACE}
        probe = " a  b\t\nﬁ Ａé "
        self.whole = (
            not any(library.is_byte(i) for i in ids)
            or any(SPACE in p.lstrip(SPACE) for p in longer)
            or library.normalize(probe) != self.escaped(probe)
            or "\n" in joined
        )
        run = "[" + "".join(map(re.escape, sorted(joined))) + "]"
        self.pattern = f"{SPACE}*{run}+|{SPACE}+|." if joined else f"{SPACE}+|."

    @staticmethod
    def escaped(text: str) -> str:
        return SPACE + text.replace(" ", SPACE)

    def library(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    def splitter(self) -> Callable[[str], Counter]:
        """Pre-tokens of a text with their frequencies."""
        if self.whole:
            return lambda text: Counter([text] if text else [])
        pattern = re.compile(self.pattern, re.DOTALL)

        def split(text: str) -> Counter:
            if not text:
                return Counter()
            if len(text) > SLICE_BYTES:
                return Counter(m[0] for m in pattern.finditer(self.escaped(text)))
            return Counter(pattern.findall(self.escaped(text)))

        return split

    def counter(self) -> Callable[[list[str]], list[int]]:
        """The number of pieces of each pre-token inside a text.

        The library puts a space before a text, so the pre-token stands after a line feed, which joins
        with nothing; what the two take by themselves is subtracted.
        """
        library = self.library()
        before = "" if self.whole else "\n"
        extra = len(library.encode(before))
        return lambda units: [len(x) - extra for x in library.encode([before + u for u in units], num_threads=1)]


def load_pre_tokens(model_file: str) -> PreTokens:
    """From a SentencePiece model file, which only the driver reads."""
    with open(model_file, "rb") as file:
        return PreTokens(file.read())


def _frequencies(pre_tokens: PreTokens, text: str, unit: str, times: str, schema: pa.Schema):
    """Per text one row with the other columns, then one per distinct pre-token with its frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokens.splitter()

        def rows(first: pa.RecordBatch, units: list[str], times_: list[int], of: list[int]) -> pa.RecordBatch:
            n, m = first.num_rows, len(units)
            columns = []
            for field in schema:
                if field.name == unit:
                    columns.append(pa.concat_arrays([pa.nulls(n, field.type), pa.array(units, field.type)]))
                elif field.name == times:
                    columns.append(pa.concat_arrays([pa.nulls(n, field.type), pa.array(times_, field.type)]))
                else:
                    column = first.column(first.schema.get_field_index(field.name)).cast(field.type)
                    more = column.take(pa.array(of, pa.int32())) if field.name == schema[0].name else pa.nulls(m, field.type)
                    columns.append(pa.concat_arrays([column, more]))
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            begin, size = 0, 0
            units, times_, of = [], [], []
            for i, value in enumerate(batch.column(batch.schema.get_field_index(text))):
                data = value.as_py()
                if data:
                    found = split(data.decode("utf-8", "replace"))
                    units.extend(found.keys())
                    times_.extend(found.values())
                    of.extend([i - begin] * len(found))
                    size += len(data)
                if size >= SLICE_BYTES:
                    yield rows(batch.slice(begin, i + 1 - begin), units, times_, of)
                    begin, size, units, times_, of = i + 1, 0, [], [], []
            if begin < batch.num_rows:
                yield rows(batch.slice(begin), units, times_, of)

    return run


def _pieces_of(pre_tokens: PreTokens):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = pre_tokens.counter()
        for batch in batches:
            for at in range(0, batch.num_rows, UNITS_AT_ONCE):
                part = batch.slice(at, UNITS_AT_ONCE)
                n = pa.array(count(part.column(0).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, n], ["unit", "freq", "n_pieces"])

    return run


def vocabulary(pairs: DataFrame, pre_tokens: PreTokens, unit: str = "unit", times: str = "times") -> DataFrame:
    """(unit, freq, n_pieces): every distinct pre-token with its frequency, cut by the library once."""
    units = pairs.where(F.col(unit).isNotNull()).groupBy(F.col(unit).alias("unit")).agg(F.sum(times).alias("freq"))
    return units.mapInArrow(_pieces_of(pre_tokens), "unit string, freq long, n_pieces long")


def _head(units: DataFrame, limit: int) -> int | None:
    """The least frequency (a power of two) from which on all pre-tokens fit the limit; None if all fit."""
    level = F.floor(F.log2("freq")).cast("int")
    sizes = units.groupBy(level.alias("level")).agg(F.sum(F.octet_length("unit") + ENTRY_BYTES).alias("bytes"))
    total, least = 0, None
    for level, size in sorted(map(tuple, sizes.collect()), reverse=True):
        total += size
        if total > limit:
            return least if least is not None else 2 ** (level + 1)
        least = 2**level
    return None


def count_tokens(
    docs: DataFrame,
    pre_tokens: PreTokens,
    text: str = "text",
    limit: int = LIMIT,
    keep: tuple[str, ...] | None = None,
    head_bytes: int = HEAD_BYTES,
) -> DataFrame:
    """The number of tokens of every text, as the model's library gives them, without any ids of a text.

    Adds ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens); of the other
    columns ``keep`` stay, or all. A column that has one of these three names is replaced.

    Every distinct pre-token of the corpus is cut into pieces once. Every text becomes its pre-tokens with
    their frequencies; these are joined to the counts and summed. The most frequent pre-tokens, up to
    ``head_bytes``, are broadcast, so that no frequent one is ever a join key; the rare others, if there
    are any, are joined by a shuffle of their pairs alone.

    Null and empty texts have no token. Repeated rows and ids each keep a row of their own. A text of any
    length is one row; one without spaces may be one pre-token. Bytes that are not UTF-8 count as U+FFFD
    in tokens. An empty table gives an empty result.
    """
    new = ("n_bytes", "n_tokens", "over_limit")
    kept = tuple(c for c in (docs.columns if keep is None else keep) if c not in new)
    row, body, unit, times, size, rare = free_names(docs, "row", "body", "unit", "times", "size", "rare")
    rows = docs.select(
        F.monotonically_increasing_id().alias(row), *[F.col(f"`{c}`") for c in kept],
        F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long").alias(size),
        F.col(f"`{text}`").cast("binary").alias(body),
    )
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != body]
    schema = T.StructType([*fields, T.StructField(unit, T.StringType()), T.StructField(times, T.LongType())])
    split = _frequencies(pre_tokens, body, unit, times, to_arrow_schema(schema))
    pairs = rows.mapInArrow(split, schema)
    bare = docs.select(F.lit(0).cast("long").alias("row"), F.col(f"`{text}`").cast("binary").alias("body"))
    small = T.StructType.fromDDL("row long, unit string, times long")
    bare_pairs = bare.mapInArrow(_frequencies(pre_tokens, "body", "unit", "times", to_arrow_schema(small)), small)

    units = stage(vocabulary(bare_pairs, pre_tokens), "units")
    least = _head(units, head_bytes)
    head = units if least is None else units.where(F.col("freq") >= least)
    head = head.select(F.col("unit").alias(rare), F.col("n_pieces").alias("n_tokens"))
    joined = pairs.join(F.broadcast(head), F.col(f"`{unit}`") == F.col(f"`{rare}`"), "left")
    tokens = F.col(f"`{times}`") * F.col("n_tokens")

    def per_row(df: DataFrame, by: tuple[str, ...], tokens) -> DataFrame:
        """Of each text the columns that its first row carries, and the sum."""
        carried = [F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in (*kept, size)]
        return df.groupBy(*by).agg(*carried, F.sum(tokens).alias("n_tokens"))

    if least is None:
        counted = per_row(joined, (row,), tokens)
    else:
        missing = F.when(F.col(f"`{rare}`").isNull(), F.col(f"`{unit}`"))
        joined = joined.select(row, *kept, size, tokens.alias("n_tokens"), F.col(f"`{times}`"), missing.alias(rare))
        partial = stage(joined, "pairs")
        known = per_row(partial.where(F.col(f"`{rare}`").isNull()), (row,), F.col("n_tokens"))
        others = units.where(F.col("freq") < least).select(F.col("unit").alias(unit), "n_pieces")
        found = partial.where(F.col(f"`{rare}`").isNotNull()).select(row, times, F.col(f"`{rare}`").alias(unit)).join(others, unit)
        blank = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in (*kept, size)]
        found = found.select(row, *blank, (F.col(f"`{times}`") * F.col("n_pieces")).alias("n_tokens"))
        counted = per_row(known.unionByName(found), (row,), F.col("n_tokens"))
    n = F.coalesce("n_tokens", F.lit(0)).cast("long")
    return counted.select(
        *[F.col(f"`{c}`") for c in kept], F.col(f"`{size}`").alias("n_bytes"), n.alias("n_tokens"),
        (n > limit).alias("over_limit"),
    )
