"""Text and JSON forms of rows and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_text(column: str, separator: str = ",") -> Column:
    """Separated text to an array of trimmed, non-empty items."""
    literal = "\\Q" + separator + "\\E"
    return F.filter(F.transform(F.split(F.col(column), literal), lambda item: F.trim(item)), lambda item: item != "")


def join_text(column: str, separator: str = ",") -> Column:
    """Array of text to separated text."""
    return F.concat_ws(separator, F.col(column))


def row_text(columns: Sequence[str]) -> Column:
    """Row as ``[v1,v2,...]``, with the word null for nulls."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    return F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]"))


def result_json(columns: Sequence[str]) -> Column:
    """JSON object of the named columns, escaped, with numbers as numbers and nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
