"""A 64-bit FNV-1a hash as a column, where names depend on its very bits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of FNV-1a.
OFFSET, PRIME = 14695981039346656037, 1099511628211


def fnv(data: bytes) -> int:
    state = OFFSET
    for byte in data:
        state = (state ^ byte) * PRIME & 0xFFFFFFFFFFFFFFFF
    return state


def fnv64(column: str | Column) -> Column:
    """16 hex digits of a string and the end mark 0xFF that keeps neighbours apart; null of null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else f"{fnv(x.encode() + bytes([255])):016x}")

    return run(F.col(column) if isinstance(column, str) else column)


def content_name(content: Column, extension: Column) -> Column:
    """A content's file name: 20 hex digits of its SHA-256 and the extension."""
    return F.concat(F.substring(F.sha2(content, 256), 1, 20), extension)


def content_url(content: Column, extension: Column, query: Column, fragment: Column) -> Column:
    """The file name with the request's own query and fragment, which keep their ? and #."""
    return F.concat(content_name(content, extension), F.coalesce(query, F.lit("")), F.coalesce(fragment, F.lit("")))
