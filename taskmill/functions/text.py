"""Text cleaning and tokens with Spark built-ins."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace in Unicode-aware stripping.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# A token is a run of letters, combining marks and digits, so vowel signs stay in their word.
NON_TOKEN = r"[^\p{L}\p{M}\p{N}]+"
NON_TOKEN_IN_LINE = r"[^\p{L}\p{M}\p{N}\n]+"


def strip(column: Column) -> Column:
    """Trim Unicode whitespace, where Spark's trim takes U+0020 only."""
    return F.btrim(column, F.lit(WHITESPACE))


def clean(column: Column, null_token: str = "none") -> Column:
    """Lower-case and strip an answer; a null answer becomes ``null_token``."""
    return strip(F.lower(F.coalesce(column.cast("string"), F.lit(null_token))))


def label_set(column: Column) -> Column:
    """The distinct labels of a comma-separated answer."""
    return F.array_distinct(F.transform(F.split(column, ","), strip))


def tokens(column: Column) -> Column:
    return F.filter(F.split(F.lower(column), NON_TOKEN), lambda t: t != "")


def token_lines(column: Column) -> Column:
    """Tokens separated by blanks, with the line breaks of the text kept."""
    return F.regexp_replace(F.lower(column), NON_TOKEN_IN_LINE, " ")
