"""Scalar functions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_match(text: Column, pattern: Column) -> Column:
    """Whether a pattern matches a text as a whole."""
    return F.call_function("rlike", text, F.concat(F.lit("^(?:"), pattern, F.lit(")$")))


def same_line(a: Column, b: Column) -> Column:
    """Whether two positions are on one line of one file; columns don't matter."""
    return F.coalesce((a["path"] == b["path"]) & (a["line"] == b["line"]), F.lit(False))


def position_text(p: Column) -> Column:
    """path:line:col"""
    return F.concat_ws(":", p["path"], p["line"].cast("string"), p["col"].cast("string"))


def type_class(type_: Column) -> Column:
    """null, bool, array or plain, by how a type is spelt."""
    return (
        F.when(type_ == "()", "null")
        .when(type_ == "Builtin.Int1", "bool")
        .when(type_.startswith("Array") | type_.startswith("["), "array")
        .otherwise("plain")
    )
