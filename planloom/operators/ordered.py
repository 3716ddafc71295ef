"""Running aggregates over ordered groups of any size.

A plain window puts one group into one task. That is right for the usual plan or conversation of a few
dozen rows, and wrong when one key holds a third of the table. ``arrange`` looks for such keys first:

* no oversized key (the usual case): every scan is a plain window, one shuffle on the keys;
* otherwise the rows of the oversized keys alone are range-partitioned by key *and* order, so that one
  group spans many tasks. The range partition is the ``_slice``. A scan then runs inside each slice, and the
  result carried over from the earlier slices, one small row per slice, is joined on.

Results are the same either way; only the way to get them differs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from planloom.session import staged

MAX_GROUP_ROWS = 1_000_000
#: A task sorts about as many rows in memory, also if each becomes a few; Spark's advisory size counts compressed bytes.
ROWS_PER_TASK = 100_000
_SAMPLE_HITS = 1000
_SLICE = "_slice"


@dataclass(frozen=True)
class Scan:
    """A running aggregate: ``kind`` of ``value``, with or without the current row."""

    kind: str
    value: Column
    inclusive: bool


def total(value: Column | int, inclusive: bool = True) -> Scan:
    """Running sum; 0 where there is nothing to add yet."""
    return Scan("total", F.lit(value) if isinstance(value, int) else value, inclusive)


def latest(value: Column, inclusive: bool = True) -> Scan:
    """Most recent non-null value."""
    return Scan("latest", value, inclusive)


def highest(value: Column, inclusive: bool = True) -> Scan:
    """Running maximum."""
    return Scan("highest", value, inclusive)


def oversized_keys(df: DataFrame, keys: Sequence[str], max_rows: int) -> DataFrame:
    """Keys with more than about ``max_rows`` rows.

    The count is taken on a row sample that holds about a thousand rows of every such key, so the shuffle is
    small. A key near the limit may fall on either side, which changes the plan and never the result.
    """
    fraction = min(1.0, _SAMPLE_HITS / max_rows)
    seen = df.select(*keys)
    if fraction < 1.0:
        seen = seen.sample(fraction=fraction, seed=7)
    limit = max_rows if fraction == 1.0 else max_rows * fraction / 2
    return seen.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit)


def sort_tasks(measure: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> int | None:
    """Over how many tasks to deal a table with the rows of ``measure``; null if Spark's own dealing will do."""
    rows = measure.count()
    if rows <= rows_per_task:
        return None
    return max(-(-rows // rows_per_task), measure.sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame, keys: Sequence[str], tasks: int | None) -> DataFrame:
    """Rows of a key in one of ``tasks`` partitions, which adaptive execution does not put together; windows and joins on the keys keep it."""
    return df if tasks is None else df.repartition(tasks, *keys)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right["_r_" + n]) for n in names])


def _renamed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({n: "_r_" + n for n in names})


class Ordered:
    """A DataFrame whose groups (``keys``) are read in the order of ``order`` (ascending columns)."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], sliced: bool):
        self.df, self.keys, self.order, self.sliced = df, list(keys), list(order), sliced

    def derive(self, df: DataFrame, order: Sequence[str] | None = None,
               keys: Sequence[str] | None = None) -> "Ordered":
        """The same groups over rows made from these row by row (``order`` must refine the old one)."""
        return Ordered(df, keys or self.keys, order or self.order, self.sliced)

    def with_columns(self, **columns: Column) -> "Ordered":
        return self.derive(self.df.withColumns(columns))

    def derive_without(self, *columns: str) -> "Ordered":
        return self.derive(self.df.drop(*columns))

    def rows(self) -> DataFrame:
        return self.df.drop(_SLICE)

    def running(self, by: Sequence[str] = (), **scans: Scan) -> "Ordered":
        """Add running aggregates per group, or per sub-group if ``by`` names further columns."""
        group = [*self.keys, *by]
        local = [*group, _SLICE] if self.sliced else group
        spec = Window.partitionBy(*local).orderBy(*self.order)
        df = self.df.withColumns({name: _local(scan, spec) for name, scan in scans.items()})
        if self.sliced:
            df = self._carry(df, group, scans)
        return self.derive(df)

    def _carry(self, df: DataFrame, group: list[str], scans: dict[str, Scan]) -> DataFrame:
        """Combine the scans inside a slice with what the earlier slices of its group add up to."""
        at = F.struct(*self.order)
        slices = (self.df.where(F.col(_SLICE) > 0).groupBy(*group, _SLICE)
                  .agg(*[_whole(scan, at).alias("_c_" + name) for name, scan in scans.items()]))
        before = Window.partitionBy(*group).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carried = {"_c_" + name: _over(scan.kind, F.col("_c_" + name), before)
                   for name, scan in scans.items()}
        first = F.row_number().over(Window.partitionBy(*group).orderBy(_SLICE))
        carry = slices.withColumns({**carried, "_first": first}).where("_first > 1").drop("_first")
        carry = staged(_renamed(carry, [*group, _SLICE]), "carry")
        joined = df.join(carry, _same(df, carry, [*group, _SLICE]), "left")
        merged = {name: _merge(scan.kind, F.col(name), F.col("_c_" + name)) for name, scan in scans.items()}
        return joined.withColumns(merged).drop(*carry.columns)


def _over(kind: str, value: Column, spec) -> Column:
    if kind == "total":
        return F.coalesce(F.sum(value).over(spec), F.lit(0))
    if kind == "highest":
        return F.max(value).over(spec)
    return F.last(value, ignorenulls=True).over(spec)


def _local(scan: Scan, spec) -> Column:
    frame = spec.rowsBetween(Window.unboundedPreceding, 0 if scan.inclusive else -1)
    return _over(scan.kind, scan.value, frame)


def _whole(scan: Scan, at: Column) -> Column:
    if scan.kind == "total":
        return F.sum(scan.value)
    if scan.kind == "highest":
        return F.max(scan.value)
    return F.max_by(scan.value, F.when(scan.value.isNotNull(), at))


def _merge(kind: str, here: Column, earlier: Column) -> Column:
    if kind == "total":
        return here + F.coalesce(earlier, F.lit(0))
    if kind == "highest":
        return F.greatest(here, earlier)
    return F.coalesce(here, earlier)


def arrange(df: DataFrame, keys: Sequence[str], order: Sequence[str], measure: DataFrame | None = None,
            max_rows: int = MAX_GROUP_ROWS, tasks: int | None = None) -> Ordered:
    """Prepare ``df`` for running aggregates per ``keys`` in ``order``.

    ``measure`` may name a cheaper table with the same rows per key, to look for oversized keys in. A caller that has dealt its rows
    by the keys over ``tasks`` partitions names them, so that the slices are dealt alike.
    With no ``keys`` the whole table is one ordered group, which is always sliced.
    """
    if not keys:
        return Ordered(_slices(df, [], order, -(-df.count() // max_rows) + 1), [], order, True)
    big = oversized_keys(df if measure is None else measure, keys, max_rows)
    if big.isEmpty():
        return Ordered(df, keys, order, False)
    big = staged(_renamed(big, keys), "oversized")
    parts = big.agg(F.sum("_rows")).first()[0]
    parts = int(parts / min(1.0, _SAMPLE_HITS / max_rows) / max_rows) + 2
    same = _same(df, big, keys)
    usual = df.join(big, same, "left_anti").withColumn(_SLICE, F.lit(0))
    large = _slices(df.join(big, same, "left_semi"), keys, order, parts)
    return Ordered(dealt(usual.unionByName(large), [*keys, _SLICE], tasks), keys, order, True)


def _slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int) -> DataFrame:
    """Range-partition by key and order; written once, so that a slice never changes on a recomputation."""
    ranged = df.repartitionByRange(parts, *keys, *order)
    return staged(ranged.withColumn(_SLICE, F.spark_partition_id() + 1), "slices")
