"""Replay of step tables: one row per step, scored with running aggregates.

A replay reads its steps in order and keeps a place and a clock. Both follow from earlier rows in closed
form, so no per-plan loop is needed:

* place before a step: the latest earlier destination, else the start;
* ``spent``: running sum of travel and meeting minutes;
* clock with waits that *set* it (strict, lenient): ``spent + latest(wait - spent)``;
* clock with waits that only move it *forward* (clamped): ``spent + highest(wait - spent)``;
* a plan stops at its first error; whatever the columns say after it is not used.

Rules: ``strict`` waits must be later than now; ``lenient`` waits may go back; ``clamped`` traces the state
and checks neither windows nor repeats.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from planloom.functions.plan_text import MEET, TRAVEL, UNKNOWN, WAIT
from planloom.operators.ordered import Ordered, highest, latest, total

STRICT, LENIENT, CLAMPED = "strict", "lenient", "clamped"


def _exact(df: DataFrame, name: str) -> Column:
    """Whole numbers as they are; fractions and texts of numbers as decimals, so that running sums are exact in any order."""
    whole = df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.col(name).cast("long") if whole else F.col(name).try_cast("decimal(18,6)")


def with_travel(seq: Ordered, edges: DataFrame, edge_keys: Sequence[str] = ()) -> Ordered:
    """Add ``loc``, the place before each step, and ``travel_min`` to its destination (null: no such edge).

    ``edges`` has (origin, dest, minutes), for all plans or, with ``edge_keys``, per problem; minutes may be fractions. The join is on
    equality only; Spark broadcasts the edges if its own size check allows.
    """
    seq = seq.running(loc=latest(F.col("dest"), inclusive=False))
    df = seq.df.withColumn("loc", F.coalesce("loc", "start_location"))
    edges = edges.select(*[F.col(k).alias("_e_" + k) for k in edge_keys], F.col("origin").alias("_origin"),
                         F.col("dest").alias("_dest"), _exact(edges, "minutes").alias("travel_min"))
    match = (df["loc"] == edges["_origin"]) & (df["dest"] == edges["_dest"])
    for key in edge_keys:
        match = match & (df[key] == edges["_e_" + key])
    joined = df.join(edges, match, "left").drop("_origin", "_dest", *["_e_" + k for k in edge_keys])
    return seq.derive(joined)


def with_people(steps: DataFrame, people: DataFrame, people_keys: Sequence[str] = ()) -> DataFrame:
    """Add the constraint of each step's person: ``place, open_min, close_min, dur_min`` (nulls: unknown)."""
    return steps.join(people.withColumnRenamed("name", "person"), [*people_keys, "person"], "left")


def _reasons(rule: str) -> dict[str, Column]:
    """Why a step fails, by name. Only window and place checks may apply together."""
    travel, wait, meet = F.col("kind") == TRAVEL, F.col("kind") == WAIT, F.col("kind") == MEET
    known = F.col("dur_min").isNotNull()
    sound = ~F.col("malformed")
    found = {
        "unknown_step": F.col("kind") == UNKNOWN,
        "malformed_travel": travel & F.col("malformed"),
        "malformed_wait": wait & F.col("malformed"),
        "malformed_meet": meet & F.col("malformed"),
        "missing_distance": travel & sound & F.col("travel_min").isNull(),
        "bad_wait_time": wait & sound & F.col("wait_min").isNull(),
    }
    if rule == STRICT:
        found["backwards_wait"] = wait & sound & (F.col("wait_min") <= F.col("now"))
    if rule == CLAMPED:
        return found | {"unknown_person": meet & sound & ~known}
    fresh = meet & sound & (F.col("times_met") == 0)
    check = fresh & known
    return found | {
        "already_met": meet & sound & (F.col("times_met") > 0),
        "unknown_person": fresh & ~known,
        "wrong_location": check & ~F.col("loc").eqNullSafe(F.col("place")),
        "too_early": check & (F.col("now") < F.col("open_min")),
        "too_late": check & (F.col("now") + F.col("dur_min") > F.col("close_min")),
    }


def _stopped(seq: Ordered, reasons: dict[str, Column]) -> Ordered:
    """Mark errors, and the steps before which none occurred."""
    failed = reduce(lambda a, b: a | b, [F.coalesce(hit, F.lit(False)) for hit in reasons.values()])
    seq = seq.with_columns(error=failed.cast("int"))
    seq = seq.running(errors_before=total(F.col("error"), inclusive=False))
    # named last, so that a filter on the steps that fail comes first
    named = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in reasons.items()]))
    return seq.with_columns(alive=F.col("errors_before") == 0, reasons=named)


def _with_times_met(seq: Ordered, meets: Column) -> Ordered:
    """Add ``times_met``, the earlier meetings with the step's person.

    It is the only scan in another sort order, and comes first. Destinations pass through it (the count is never negative), or
    Spark would move the scan for the place before it and sort all steps a third time.
    """
    seq = seq.running(by=["person"], times_met=total(meets.cast("int"), inclusive=False))
    return seq.with_columns(dest=F.when(F.col("times_met") >= 0, F.col("dest")))


def replay(seq: Ordered, edges: DataFrame, rule: str = LENIENT, edge_keys: Sequence[str] = ()) -> Ordered:
    """Add to each step ``loc`` and ``now`` (before it), ``reasons``, ``error``, ``alive`` and ``scored``.

    ``seq`` has ``kind, dest, wait_min, person, malformed`` per step, ``start_location, start_min`` of its
    plan, and ``dur_min, place, open_min, close_min`` of its person (nulls if unknown).
    """
    if rule != CLAMPED:
        seq = _with_times_met(seq, F.col("kind") == MEET)
    seq = with_travel(seq, edges, edge_keys)
    spend = F.when(F.col("kind") == TRAVEL, F.coalesce("travel_min", F.lit(0))).when(
        F.col("kind") == MEET, F.coalesce("dur_min", F.lit(0))).otherwise(0)
    spend = spend.cast("long") if seq.df.schema["travel_min"].dataType.typeName() == "long" else spend.cast("decimal(18,6)")
    seq = seq.with_columns(spend=spend).running(spent=total(F.col("spend")))
    ahead = F.col("wait_min") - F.col("spent")
    if rule == CLAMPED:
        seq = seq.running(ahead=highest(ahead, inclusive=False))
        base = F.greatest(F.col("ahead"), F.col("start_min"))
    else:
        seq = seq.running(ahead=latest(ahead, inclusive=False))
        base = F.coalesce(F.col("ahead"), F.col("start_min"))
    seq = seq.with_columns(now=F.col("spent") - F.col("spend") + base)
    seq = _stopped(seq, _reasons(rule))
    scored = F.col("alive") & (F.col("error") == 0) & (F.col("kind") == MEET)
    return seq.with_columns(scored=scored).derive_without("spend", "spent", "ahead", "errors_before")


def replay_structured(seq: Ordered, edges: DataFrame, edge_keys: Sequence[str] = ()) -> Ordered:
    """Replay plans given as elements of ``location, person, start_at`` (the first element is skipped).

    An element moves to its location if that is another one, must not start before the arrival, sets the
    clock to its start, and meets its person if the problem knows that person.
    """
    seq = seq.derive(seq.df.where("pos > 1").withColumn("dest", F.nullif("location", F.lit(""))))
    known = F.col("dur_min").isNotNull()
    seq = _with_times_met(seq, known)
    seq = with_travel(seq, edges, edge_keys)
    end = F.col("start_at") + F.coalesce("dur_min", F.lit(0))
    seq = seq.running(ended=latest(end, inclusive=False))
    moves = F.col("dest").isNotNull() & (F.col("dest") != F.col("loc"))
    arrived = F.coalesce("ended", "start_min") + F.when(moves, F.col("travel_min")).otherwise(0)
    fresh = known & (F.col("times_met") == 0)
    seq = _stopped(seq, {
        "missing_distance": moves & F.col("travel_min").isNull(),
        "bad_start_time": F.col("start_at").isNull(),
        "starts_too_early": F.col("start_at") < arrived,
        "already_met": known & (F.col("times_met") > 0),
        "wrong_location": fresh & ~F.coalesce("dest", "loc").eqNullSafe(F.col("place")),
        "too_early": fresh & (F.col("start_at") < F.col("open_min")),
        "too_late": fresh & (F.col("start_at") + F.col("dur_min") > F.col("close_min")),
    })
    scored = F.col("alive") & (F.col("error") == 0) & known
    return seq.with_columns(scored=scored).derive_without("ended", "errors_before")


def plan_scores(seq: Ordered, *measures: Column) -> DataFrame:
    """One row per plan: score, position of the first error (null if none), and further aggregates.

    Grouping follows the windows' partitioning, so a plain replay needs no further shuffle.
    """
    return seq.rows().groupBy(*seq.keys).agg(
        F.sum(F.col("scored").cast("long")).alias("score"),
        F.min(F.when(F.col("error") == 1, F.col("pos"))).alias("first_error"), *measures)


def first_failures(seq: Ordered) -> DataFrame:
    """The step at which each failed plan stops, one row per reason."""
    stop = seq.rows().where("alive and error = 1")
    return stop.select(*seq.keys, "pos", F.explode("reasons").alias("reason"))
