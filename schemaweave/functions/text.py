"""Expressions over SQL text. Patterns are Java's; (?U) makes \\w and \\b cover all scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemaweave.functions import scanners
from schemaweave.functions.words import RESERVED

#: A name with or without quotes.
NAME = r"[`\"\[]?(\w+)[`\"\]]?"


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, in one pass; null if it is empty or there is no match."""
    return F.nullif(F.regexp_extract(text, "(?iUs)" + pattern, group), F.lit(""))


def strip(text: Column) -> Column:
    """Without white space at both ends, line ends too; text may be a column's name."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_comments(ddl: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(ddl, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")


def normal_type(text: Column) -> Column:
    """Upper case, one space between words, none around brackets and commas."""
    return F.regexp_replace(F.upper(F.regexp_replace(strip(text), r"\s+", " ")), r"\s*([(),])\s*", "$1")


def unwrapped(text: Column) -> Column:
    """Without the same quote at both ends."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when((F.length(text) > 1) & ends.isin("''", '""'), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def reserved(name: Column) -> Column:
    return scanners.one_of(name, RESERVED)


def expression_name(expr: Column, ordinal: Column) -> Column:
    """The name of a select item: its alias, its last word, or column_N."""
    e = F.regexp_replace(strip(expr), r"[;\s]+$", "")
    last = first(e, rf"\S\s+{NAME}$")
    named = F.coalesce(first(e, rf"\bAS\s+{NAME}$"), F.when(~reserved(last), last), first(e, rf"^(?:{NAME}\.)?{NAME}$", 2))
    return F.coalesce(F.lower(named), F.concat(F.lit("column_"), ordinal.cast("string")))


def expression_source(expr: Column) -> Column:
    """A select item without its alias."""
    return strip(F.regexp_replace(expr, rf"(?iU)\s+(?:AS\s+)?{NAME}\s*;?$", ""))
