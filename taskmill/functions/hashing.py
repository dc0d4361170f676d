"""Seeded keys: the one source of randomness, equal on every cluster and partitioning."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_BITS = 60


def hash_key(seed: int, id_col: str | Column) -> Column:
    """A uniform bigint in [0, 2^60): the first 15 hex digits of md5("seed|id")."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col) if isinstance(id_col, str) else id_col))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")



def record_digest(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The MD5 of whole records: every column's length and text in turn, null apart from empty."""

    def part(name: str) -> Column:
        column = F.col(f"`{name}`")
        nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType))
        text = F.to_json(F.struct(column)) if nested else column.cast("string")
        return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.md5(F.concat(*[part(c) for c in (columns or df.columns)]))
