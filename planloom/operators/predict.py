"""Answers of a caller's responder as a new column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from planloom.functions.clock import strip
from planloom.functions.plan_text import ERROR
from planloom.functions.templates import MISSING_PROMPT
from planloom.session import staged

Responder = Callable[[str], str | None]


def prediction_column(prompt_key: str, model: str) -> str:
    """Name of the answer column for a prompt column and a model; dots stay, so quote it in expressions."""
    return f"pred_{prompt_key.replace('prompt_', '')}_{model.lower().replace('-', '_')}"


def _answers(prompt: Column, responder: Responder) -> Column:
    """Call the responder per prompt, in Arrow batches of the prompt column alone. A failure is an answer."""
    def ask(text: str) -> str:
        try:
            answer = responder(text)
        except Exception as problem:  # noqa: BLE001 - any failure of the responder is recorded, no row is lost
            return f"ERROR: {problem}"
        if answer is None or not answer.strip():
            return "ERROR: Received empty or blocked response (Reason: empty)"
        return answer.strip()

    def ask_batch(texts: pd.Series) -> pd.Series:
        return texts.map(ask, na_action="ignore")

    return F.pandas_udf(ask_batch, T.StringType()).asNondeterministic()(prompt)


def with_predictions(df: DataFrame, prompt: str, responder: Responder, out: str,
                     drop_missing: bool = False) -> DataFrame:
    """Append answers; other columns and types stay.

    Rows without a prompt get an error answer, or are left out with ``drop_missing`` (reasoning rows).
    """
    text = F.col(f"`{prompt}`")
    if drop_missing:
        df = df.where(text.isNotNull() & (text != ""))
    usable = F.when(text != "", text)
    answer = F.when(usable.isNull(), MISSING_PROMPT).otherwise(_answers(usable, responder))
    kind = df.schema[out].dataType if out in df.columns else T.StringType()
    return df.withColumn(out, answer.cast(kind))


def with_retries(df: DataFrame, prompt: str, responder: Responder, out: str, attempts: int = 3) -> DataFrame:
    """Ask again for rows whose answer is an error, up to ``attempts`` times in all.

    Each round is written before the next reads it: a lost executor must not ask the responder again.
    """
    answered = staged(with_predictions(df, prompt, responder, out), "answers")
    text, answer = F.col(f"`{prompt}`"), F.col(f"`{out}`")
    for _ in range(attempts - 1):
        failed = F.startswith(answer, F.lit(ERROR)) & (answer != MISSING_PROMPT)
        if answered.where(failed).isEmpty():
            break
        again = _answers(F.when(failed, text), responder)
        answered = staged(answered.withColumn(out, F.coalesce(again, answer)), "answers")
    return answered


def with_ledger(df: DataFrame, key: str, prompt: str, responder: Callable[[str, int], str | None], out: str, ledger: str,
                attempts: int = 3) -> DataFrame:
    """Answers with every attempt on record: rows (``key``, ``attempt``, ``answer``) are appended to the table at ``ledger``.

    ``responder`` gets the prompt and the number of the attempt, from 1. Only rows without a good answer in the ledger are asked, so
    a run that was broken off, or one with more attempts, goes on where the last one ended. The answer of a row is its
    last attempt's. Rows without a prompt are not asked and have the usual error. ``key`` must tell the rows apart.
    """
    text = F.col(f"`{prompt}`")
    asked = df.where(text.isNotNull() & (text != "")).select(F.col(key).alias("_key"), text.alias("_text"))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("attempt", T.IntegerType()), T.StructField("answer", T.StringType())])
    spark = df.sparkSession
    told = lambda: spark.read.schema(schema).parquet(ledger).select(F.col(key).alias("_told"), "attempt", "answer")
    spark.createDataFrame([], schema).write.mode("append").parquet(ledger)
    for attempt in range(1, attempts + 1):
        # a key is done with a good answer, or with as many attempts as this round is
        done = told().groupBy("_told").agg(F.max("attempt").alias("tried"), F.bool_or(~is_error(F.col("answer"))).alias("good")).where(
            F.col("good") | (F.col("tried") >= attempt))
        open_rows = asked.join(done, asked["_key"].eqNullSafe(done["_told"]), "left_anti")
        answer = _answers(F.col("_text"), lambda t, n=attempt: responder(t, n))
        open_rows.select(F.col("_key").alias(key), F.lit(attempt).alias("attempt"), answer.alias("answer")).write.mode("append").parquet(ledger)
    final = told().groupBy("_told").agg(F.max_by("answer", "attempt").alias("_answer"), F.max("attempt").alias("attempts"))
    joined = df.join(final, df[key].eqNullSafe(final["_told"]), "left")
    return joined.withColumn(out, F.coalesce("_answer", F.lit(MISSING_PROMPT))).withColumn(
        "attempts", F.coalesce("attempts", F.lit(0))).drop("_told", "_answer")


def two_stages(df: DataFrame, prompt: str, first: Responder, second: Responder,
               between: str = "information_and_constraints", out: str = "step_by_step_plan") -> DataFrame:
    """Feed the answers of one responder to another; both columns stay. Rows without a prompt are left out."""
    # written, so that a later action or a lost task does not ask the first responder again
    return with_predictions(staged(with_predictions(df, prompt, first, between, drop_missing=True), "first_stage"), between, second, out)


def map_rows(df: DataFrame, function: Callable[[dict], dict], fields: str, needed: Sequence[str] = ()) -> DataFrame:
    """Add the fields that ``function`` returns for each row (``fields`` as DDL), replacing equal names.

    For what column expressions cannot say. Only the ``needed`` columns (all, if none are named) go to Python, in Arrow batches with
    their exact values, and only the new fields come back: the columns of ``df`` stay on the JVM as they are.
    """
    added = T.StructType.fromDDL(fields)
    names = list(needed or df.columns)
    kind = pa.struct(list(to_arrow_schema(added)))

    @F.arrow_udf(added)
    def mapped(rows: pa.Array) -> pa.Array:
        found = [function(row) for row in rows.to_pylist()]
        return pa.array([{name: row.get(name) for name in added.names} for row in found], kind)

    kept = [F.col(f"`{c}`") for c in df.columns if c not in added.names]
    made = df.withColumn("_made", mapped(F.struct(*[F.col(f"`{c}`") for c in names])))
    return made.select(*kept, *[F.col("_made")[name].alias(name) for name in added.names])


def is_error(answer: Column) -> Column:
    return F.startswith(strip(answer), F.lit(ERROR))
