"""Rules over recorded agent trajectories: numbering, halts and outcomes.

A trajectory is a group of actions in an order. Every rule reads only running aggregates, so a trajectory of
any length is spread over tasks where needed (``planloom.operators.ordered``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from planloom.functions.text import action, is_date, is_observation, mask, short_line, word_count
from planloom.operators.ordered import MAX_GROUP_ROWS, Ordered, arrange, highest, latest, total
from planloom.session import staged

# Tool of each action name, and the shared counter of everything else.
TOOLS = {
    "FlightSearch": "flights", "AttractionSearch": "attractions", "GoogleDistanceMatrix": "googleDistanceMatrix",
    "AccommodationSearch": "accommodations", "RestaurantSearch": "restaurants", "Planner": "planner",
    "NotebookWrite": "notebook", "CitySearch": "cities"}
INVALID = "invalidAction"
FINAL = "Planner"
# Limits of a run, and the states that a step can end in.
MAX_REPEATS, MAX_RETRIES, MAX_STEPS, MAX_TOKENS = 3, 3, 30, 15_000
SUCCESSFUL, DATE_ERROR = "Successful", "Illegal args. DateError"
CITY_ERROR, OTHER_ERROR = "Illegal args. City Error", "Illegal args. Other Error"
REPEATED = "same action 3 times repeated"


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str],
             max_rows: int = MAX_GROUP_ROWS, measure: DataFrame | None = None) -> Ordered:
    """Rows with their ``step``, counted from 1 within the trajectory. ``measure``: a cheaper table with as many rows for each key."""
    return arrange(df, keys, order, measure=measure, max_rows=max_rows).running(step=total(1))


def tool_of(name: Column, tools: Mapping[str, str] = TOOLS) -> Column:
    known = F.create_map(*[F.lit(x) for pair in tools.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), F.lit(INVALID))


def step_state(name: Column, dates: Sequence[Column], cities_known: Column, failed: Column,
               tools: Mapping[str, str] = TOOLS) -> Column:
    """How a step ends, in the order in which its arguments are checked."""
    bad_date = F.lit(False)
    for date in dates:
        bad_date = bad_date | F.coalesce(~is_date(date), F.lit(False))
    return (F.when(~F.coalesce(name, F.lit("")).isin(*tools), INVALID).when(bad_date, DATE_ERROR)
            .when(~cities_known, CITY_ERROR).when(failed, OTHER_ERROR).otherwise(SUCCESSFUL))


def repeats(seq: Ordered, act: str, limit: int = MAX_REPEATS) -> Ordered:
    """Add ``run_length``, how often the action occurred in a row up to here, and ``repeat_halt``."""
    seq = seq.running(_before=latest(F.struct(F.col(act).alias("act")), inclusive=False))
    fresh = F.col("_before").isNull() | ~F.col(act).eqNullSafe(F.col("_before")["act"])
    seq = seq.with_columns(_fresh=F.when(fresh, F.col("step"))).running(_since=latest(F.col("_fresh")))
    length = F.col("step") - F.col("_since") + 1
    return seq.with_columns(run_length=length, repeat_halt=length >= limit).derive_without(
        "_before", "_fresh", "_since")


def retries(seq: Ordered, act: str, success: str, limit: int = MAX_RETRIES,
            tools: Mapping[str, str] = TOOLS) -> Ordered:
    """Add ``epoch`` (successes so far), ``tool``, its ``failures`` since the last success, and ``retry_halt``.

    An attempt is refused once its tool has ``limit`` failures. Unknown names share one counter. The final
    action is exempt; an empty action counts as a failure but is never refused.
    """
    name = action(F.col(act))["type"]
    seq = seq.with_columns(tool=tool_of(name, tools))
    seq = seq.running(epoch=total(F.col(success).cast("int"), inclusive=False))
    seq = seq.running(by=["epoch", "tool"], failures=total((~F.col(success)).cast("int"), inclusive=False))
    return seq.with_columns(retry_halt=is_guarded(F.col(act)) & (F.col("failures") >= limit))


def is_guarded(act: Column) -> Column:
    """Actions whose retries are limited: all but the empty and the final one."""
    return ~F.coalesce(act.isin("", "\n"), F.lit(True)) & ~action(act)["type"].eqNullSafe(F.lit(FINAL))


def budgets(seq: Ordered, tokens: Column, max_steps: int = MAX_STEPS, max_tokens: int = MAX_TOKENS) -> Ordered:
    """Add ``tokens_before`` and ``budget_halt``: too many steps, or too long a context before this one."""
    seq = seq.running(tokens_before=total(tokens, inclusive=False))
    return seq.with_columns(
        budget_halt=(F.col("step") > max_steps) | (F.col("tokens_before") > max_tokens))


def halts(seq: Ordered, flag: str) -> DataFrame:
    """First step at which a rule holds, per trajectory (null: never), and the number of steps."""
    return seq.rows().groupBy(*seq.keys).agg(
        F.count("*").alias("steps"), F.min(F.when(F.col(flag), F.col("step"))).alias("halt_step"))


def outcomes(df: DataFrame, state: str = "state") -> DataFrame:
    return df.groupBy(state).agg(F.count("*").alias("steps"))


def masked_pads(seq: Ordered, pad: str, observation: str, success: str) -> Ordered:
    """Add ``masked``: each step's ``pad`` with the output of the latest successful step before it replaced by a notice.

    A step whose own call failed replaces nothing, as its tool has not run. A null or blank output replaces nothing.
    """
    stale = F.when(F.col(success), F.coalesce(F.col(observation), F.lit("")))
    seq = seq.running(_stale=latest(stale, inclusive=False))
    masked = F.when(F.col(success), mask(F.col(pad), F.col("_stale"))).otherwise(F.col(pad))
    return seq.with_columns(masked=masked).derive_without("_stale")


def truncated_pads(df: DataFrame, keys: Sequence[str], pos: str, line: str, limit: int, tokens=word_count,
                   max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Scratchpads whose lines are rows: the lines with the largest ``Observation`` lines cut until at most ``limit`` tokens are left.

    The rule of ``truncate_scratchpad``, for pads of any number of lines: observations are ranked by size, of equal ones the last
    goes first, and one is cut if the pad was too long before each cut up to it. Adds ``cut``; ``pos`` tells the lines of a pad apart.
    """
    short = short_line(F.col(line))
    sized = df.withColumn("_size", F.coalesce(tokens(F.col(line)), F.lit(0)).cast("long"))
    # one number for each pad, from partial sums
    whole = staged(sized.groupBy(*keys).agg(F.sum("_size").alias("_whole")).withColumnsRenamed({k: "_w_" + k for k in keys}), "pads")
    same = reduce(lambda a, b: a & b, [sized[k].eqNullSafe(whole["_w_" + k]) for k in keys])
    observed = F.coalesce(is_observation(F.col(line)), F.lit(False))
    rows = sized.join(whole, same).drop(*["_w_" + k for k in keys]).withColumns({
        "_late": ~observed, "_less": -F.col("_size"), "_back": -F.col(pos)})
    seq = arrange(rows, keys, ["_late", "_less", "_back"], measure=df.select(*keys), max_rows=max_rows)
    saved = F.when(~F.col("_late"), F.col("_size") - tokens(short)).otherwise(0).cast("long")
    seq = seq.with_columns(_saved=saved).running(_gone=total(F.col("_saved"), inclusive=False))
    fits = F.col("_late") | (F.col("_whole") - F.col("_gone") <= limit)
    seq = seq.with_columns(_fits=fits.cast("int")).running(_stopped=highest(F.col("_fits")))
    cut = F.col("_stopped") == 0
    return seq.rows().withColumns({"cut": cut, line: F.when(cut, short).otherwise(F.col(line))}).drop(
        "_size", "_whole", "_late", "_less", "_back", "_saved", "_gone", "_fits", "_stopped")


def row_text(*columns: str) -> Column:
    """A row as one line of text, nulls as ``None``. A table is its rows' lines, never one big value."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns])
