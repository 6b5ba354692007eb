"""Searching, listing and choosing options; checking names against a dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import parse_int, spaced_title

SHOWN = 25


def search(df: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose column holds the query, case aside; an empty query passes all."""
    return df if query == "" else df.where(F.contains(F.lower(column), F.lit(query.lower())))


def shown(df: DataFrame, order: str, n: int = SHOWN) -> DataFrame:
    return df.orderBy(order).limit(n)


def numbered(df: DataFrame, order: str, n: int = SHOWN) -> DataFrame:
    """The options displayed, numbered from 1; at most n rows reach the window."""
    return shown(df, order, n).withColumn("number", F.row_number().over(W.orderBy(order)))


def more(count: Column, n: int = SHOWN) -> Column:
    """How many options a display leaves out."""
    return count - F.least(count, F.lit(n))


def selected_summary(names: Column, n: int = 5) -> Column:
    """The first n names in title case, and how many more there are."""
    text = F.array_join(F.transform(F.slice(names, 1, n), spaced_title), ", ")
    return F.when(F.size(names) > n, F.concat(text, F.lit(" ... (+"), (F.size(names) - n).cast("string"), F.lit(" more)"))).otherwise(text)


def pick(options: Column, typed: Column, n: int = SHOWN) -> Column:
    """The option of the typed number, from 1 to the number displayed; else null."""
    at = parse_int(typed)
    return F.when((at >= 1) & (at <= F.least(F.size(options), F.lit(n))), F.get(options, at - 1))


def pick_or_search(options: Column, typed: Column) -> Column:
    """The option of the typed number; the first for an empty answer; else the only option that holds the text."""
    hit = F.filter(options, lambda o: F.contains(F.lower(o), F.lower(typed)))
    return F.coalesce(pick(options, typed), F.when(typed == "", F.get(options, F.lit(0))), F.when(F.size(hit) == 1, F.get(hit, F.lit(0))))


def kept_defaults(defaults: Column, options: Column) -> Column:
    return F.array_intersect(defaults, options)


def remaining(options: Column, chosen: Column) -> Column:
    return F.array_except(options, chosen)


def unknown(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested names that the dimension doesn't have; any row is an error."""
    return requested.join(known.select(key), key, "left_anti")


def enabled(tools: DataFrame, requested: DataFrame) -> DataFrame:
    """Known tools that are requested, in the dimension's order."""
    return tools.join(requested.select("key").distinct(), "key", "left_semi").orderBy("pos")
