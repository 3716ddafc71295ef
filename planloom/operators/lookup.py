"""Keyed lookups, membership checks, stated predicates and the notebook of retrieved rows."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Operators of a stated predicate, in the order in which they are looked for.
OPERATORS = ("~contains", "contains", "<=", ">=", "=")


def member(df: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    """Rows whose value is in the list. No hint: Spark broadcasts the list if its size allows."""
    return df.join(values.select(F.col(value).alias("_member")), F.col(column) == F.col("_member"), "left_semi")


def not_member(df: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    """Rows whose value is not in the list, with the message they are refused with."""
    listed = values.select(F.col(value).alias("_member"))
    return df.join(listed, F.col(column) == F.col("_member"), "left_anti").withColumn(
        "message", F.concat(F.col(column).cast("string"), F.lit(" is not valid")))


def lookup(requests: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Answer requests from a table by one or more equal keys; unanswered requests stay, with nulls."""
    return requests.join(reference, list(keys), "left")


def stated_predicates(text: str) -> dict[str, tuple[str, str]]:
    """``a<=5, b contains x`` as {column: (operator, value)}; the last statement on a column counts."""
    found: dict[str, tuple[str, str]] = {}
    for segment in text.split(","):
        op = next((o for o in OPERATORS if o in segment), None)
        if op is None:
            continue
        sides = segment.split(op)
        if len(sides) != 2:
            raise ValueError(f"more than one {op!r} in {segment!r}")
        found[sides[0].strip()] = (op, sides[1].strip().strip("'"))
    return found


def predicate(statements: Mapping[str, tuple[str, str]], df: DataFrame | None = None) -> Column:
    """The statements as one condition that Spark can push into the scan; the columns' types are those of ``df``."""
    types = None if df is None else dict(df.dtypes)
    compare = {"<=": operator.le, ">=": operator.ge, "=": operator.eq}
    def one(name: str, op: str, value: str) -> Column:
        column = F.col(name)
        if op == "contains":
            return F.contains(column, F.lit(value))
        if op == "~contains":
            return ~F.contains(column, F.lit(value))
        # a number is compared with what the column reads as a number, so that no value stops the job; text columns compare as text
        number = value.replace(".", "", 1).lstrip("+-").isdigit() and (types is None or types.get(name) != "string")
        return compare[op](column, F.lit(float(value))) if number else compare[op](column.cast("string"), F.lit(value))
    return reduce(operator.and_, [one(name, *rest) for name, rest in statements.items()], F.lit(True))


def notebook(query: str, **retrieved: DataFrame) -> DataFrame:
    """All retrieved sets in one long table: query, label, and the row as JSON.

    One row per note. A query's bundle is its rows; they are never gathered into one value, as a query may
    have retrieved any number of them.
    """
    notes = [df.select(F.col(query), F.lit(label).alias("label"),
                       F.to_json(F.struct(*[c for c in df.columns if c != query])).alias("note"))
             for label, df in retrieved.items()]
    return reduce(DataFrame.unionByName, notes)
