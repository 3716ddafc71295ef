"""Positional ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from planloom.operators.ordered import arrange, total


SLICE_ROWS = 1_000_000


def with_positional_id(df: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """Fill missing ids with ``index_{i}``, the row's 0-based place in the whole table's ``order``.

    The place is counted over range partitions of about ``SLICE_ROWS`` rows, so the table is never sorted in one task. For the
    order of the input files use ``with_input_order`` and ``INPUT_ORDER``.
    """
    seq = arrange(df, [], order, max_rows=SLICE_ROWS).running(_at=total(1))
    place = F.concat(F.lit("index_"), (F.col("_at") - 1).cast("string"))
    return seq.rows().withColumn(id_col, F.coalesce(F.col(id_col), place)).drop("_at")
