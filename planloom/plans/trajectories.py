"""Agent trajectories derived from events: one user is one trajectory, each event an action."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from planloom.functions.text import action, clean_step, is_date
from planloom.operators.ordered import MAX_GROUP_ROWS, Ordered, latest
from planloom.operators.trajectory import (SUCCESSFUL, budgets, halts, masked_pads, numbered, outcomes, repeats, retries, step_state,
                                           truncated_pads)
from planloom.plans.tables import table
from planloom.session import scratch_path
from planloom.streaming.guard import live_halts, run_guard


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions; some are empty or name no tool, some dates and cities are no such thing."""
    city = F.concat(F.lit("NATION_"), (F.col("user_id") % 27).cast("string"))
    date = F.when(F.col("event_id") % 7 == 0, "March 3rd").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    kind = F.col("event_type")
    text = (F.when(kind == "view", F.concat(F.lit("AttractionSearch["), city, F.lit("]")))
            .when(kind == "click", F.concat(F.lit("RestaurantSearch["), city, F.lit("]")))
            .when(kind == "signup", F.concat(F.lit("FlightSearch["), city, F.lit(", NATION_1, "), date, F.lit("]")))
            .when(kind == "purchase", F.concat(F.lit("NotebookWrite[note "), (F.col("event_id") % 2).cast("string"), F.lit("]")))
            .when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.lit("look around")))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query_id"), "ts", "event_id", text.alias("action"), "value", F.col("props").alias("observation"))


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions with their parsed parts and the state they end in."""
    parsed = actions(spark, sf_dir).withColumn("parsed", action(F.col("action")))
    parsed = parsed.select("*", F.col("parsed.type").alias("type"), F.split("parsed.arg", ", ").alias("args")).drop("parsed")
    parsed = parsed.withColumn("city", F.when(F.col("type") != "NotebookWrite", F.get("args", F.lit(0))))
    cities = table(spark, sf_dir, "nation").select(F.col("n_name").alias("known_city"))
    joined = parsed.join(cities, F.col("city") == F.col("known_city"), "left")
    known = F.col("city").isNull() | F.col("known_city").isNotNull()
    state = step_state(F.col("type"), [F.when(F.col("type") == "FlightSearch", F.get("args", F.lit(2)))], known,
                       F.col("value") < 35)
    return joined.withColumn("state", state).drop("known_city", "args")


def trajectories(spark: SparkSession, sf_dir: str, max_rows: int = MAX_GROUP_ROWS) -> Ordered:
    return numbered(assessed(spark, sf_dir), ["query_id"], ["ts", "event_id"], max_rows, _keys(spark, sf_dir))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows of each trajectory, to look for oversized ones, without the work on their texts."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"))


def action_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions(spark, sf_dir).select("event_id", clean_step(F.concat(F.lit("\n "), F.col("action"), F.lit("\n"))).alias("act")
                                         ).select("event_id", action(F.col("act")).alias("p")).select("event_id", "p.type", "p.arg")


def date_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).where("type = 'FlightSearch'").select(
        "event_id", is_date(F.element_at(F.split(F.col("action"), "[,\\]] ?"), -2)).alias("valid"))


def repeat_halt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return halts(repeats(trajectories(spark, sf_dir), "action"), "repeat_halt")


def retry_halt(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = trajectories(spark, sf_dir).with_columns(success=F.col("state") == SUCCESSFUL)
    return halts(retries(seq, "action", "success"), "retry_halt")


def budget_halt(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.length("action") + F.length("observation")
    return halts(budgets(trajectories(spark, sf_dir), tokens, 60, 1200), "budget_halt")


def trajectory_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(assessed(spark, sf_dir))


def trajectory_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a table: one row per step."""
    return trajectories(spark, sf_dir).rows().select("query_id", "step", "action", "observation", "state")


def pads(spark: SparkSession, sf_dir: str, max_rows: int = MAX_GROUP_ROWS) -> Ordered:
    """Steps with the end of their scratchpad: the two outputs before, a thought that quotes its own, and the action."""
    seq = trajectories(spark, sf_dir, max_rows).with_columns(success=F.col("state") == SUCCESSFUL, observation=F.concat(
        F.lit(" "), F.coalesce("observation", F.lit("")), F.lit(" of "), F.col("event_id").cast("string"), F.lit("\n")))
    seq = seq.running(_one=latest(F.col("observation"), inclusive=False))
    seq = seq.running(_two=latest(F.col("_one"), inclusive=False))
    line = lambda back, text: F.concat(F.lit("Observation "), (F.col("step") - back).cast("string"), F.lit(":"), text)
    return seq.with_columns(pad=F.concat_ws("\n", line(2, F.col("_two")), line(1, F.col("_one")), F.concat(
        F.lit("Action "), F.col("step").cast("string"), F.lit(": "), F.col("action"))))


def masked_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step's pad without the output of the latest step before it that succeeded."""
    return masked_pads(pads(spark, sf_dir), "pad", "observation", "success").rows().select("query_id", "step", F.md5("masked").alias("masked_md5"))


def pad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories as lines: actions, and observations of as many words as their value says."""
    acts = actions(spark, sf_dir)
    words = F.repeat(F.lit("w "), F.col("value").cast("int") % 7)
    both = F.array(F.struct(F.lit(0).alias("part"), F.concat(F.lit("Action: "), F.col("action")).alias("line")), F.struct(F.lit(1).alias("part"), F.concat(
        F.lit("Observation "), F.col("event_id").cast("string"), F.lit(": "), words, F.col("observation")).alias("line")))
    return acts.select("query_id", F.col("event_id").alias("_event"), F.inline(both)).select("query_id", (F.col("_event") * 2 + F.col("part")).alias("pos"), "line")


def truncated_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scratchpads of rows cut to 150 words."""
    found = truncated_pads(pad_lines(spark, sf_dir), ["query_id"], "pos", "line", 150)
    return found.select("query_id", "pos", "cut", F.md5("line").alias("line_md5"))


def live_halted(spark: SparkSession, sf_dir: str, batches: int = 3) -> DataFrame:
    """The three rules over the events as a stream of files that come in the order of time; each run takes what has come and goes on from the last."""
    rows = assessed(spark, sf_dir).select("query_id", "ts", "event_id", "action", "observation",
                                          (F.col("state") == SUCCESSFUL).alias("success"))
    root = scratch_path(spark, "live")
    last = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] + 1
    for part in range(batches):
        rows.where(F.floor(F.col("event_id") * batches / last) == part).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        run_guard(live_halts(stream, ["query_id"], ["ts", "event_id"], F.length("action") + F.length("observation"), max_steps=60, max_tokens=1200), root)
    return spark.read.parquet(f"{root}/halts")


QUERIES = {
    "action_parse": action_parse,
    "date_check": date_check,
    "repeat_halt": repeat_halt,
    "retry_halt": retry_halt,
    "budget_halt": budget_halt,
    "trajectory_outcomes": trajectory_outcomes,
    "trajectory_log": trajectory_log,
    "masked_observation": masked_observation,
    "truncated_trajectories": truncated_trajectories,
    "live_guard": live_halted,
}

_TRAJECTORIES = """WITH base AS (SELECT user_id AS query_id, ts, event_id, value, props AS observation, event_type AS kind,
    'NATION_' || (user_id % 27) AS city, user_id % 27 < 25 AS known,
    CASE WHEN event_id % 7 = 0 THEN 'March 3rd' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events),
  acts AS (SELECT *, CASE kind WHEN 'view' THEN 'AttractionSearch[' || city || ']' WHEN 'click' THEN 'RestaurantSearch[' || city || ']'
      WHEN 'signup' THEN 'FlightSearch[' || city || ', NATION_1, ' || day || ']'
      WHEN 'purchase' THEN 'NotebookWrite[note ' || (event_id % 2) || ']'
      ELSE CASE WHEN event_id % 3 = 0 THEN '' ELSE 'look around' END END AS action,
    CASE WHEN kind = 'error' THEN 'invalidAction' WHEN kind = 'signup' AND event_id % 7 = 0 THEN 'Illegal args. DateError'
      WHEN kind <> 'purchase' AND NOT known THEN 'Illegal args. City Error' WHEN value < 35 THEN 'Illegal args. Other Error'
      ELSE 'Successful' END AS state FROM base),
  steps AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ts, event_id) AS step FROM acts)"""
_HALT = " SELECT query_id, count(*) AS steps, min(CASE WHEN halt THEN step END) AS halt_step FROM ruled GROUP BY query_id"

SQL = {
    "action_parse": _TRAJECTORIES + """ SELECT event_id, CASE WHEN kind <> 'error' THEN split_part(action, '[', 1) END AS type,
        CASE WHEN kind <> 'error' THEN rtrim(split_part(action, '[', 2), ']') END AS arg FROM acts""",
    "date_check": "SELECT event_id, event_id % 7 <> 0 AS valid FROM events WHERE event_type = 'signup'",
    "repeat_halt": _TRAJECTORIES + """, ruled AS (SELECT *, coalesce(action = lag(action, 1) OVER w AND action = lag(action, 2) OVER w,
        false) AS halt FROM steps WINDOW w AS (PARTITION BY query_id ORDER BY step))""" + _HALT,
    "retry_halt": _TRAJECTORIES + """, epochs AS (SELECT *, CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3
          WHEN 'purchase' THEN 4 ELSE 5 END AS tool, coalesce(sum(CASE WHEN state = 'Successful' THEN 1 ELSE 0 END) OVER
          (PARTITION BY query_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM steps),
        ruled AS (SELECT *, action <> '' AND coalesce(sum(CASE WHEN state <> 'Successful' THEN 1 ELSE 0 END) OVER
          (PARTITION BY query_id, epoch, tool ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 3
          AS halt FROM epochs)""" + _HALT,
    "budget_halt": _TRAJECTORIES + """, ruled AS (SELECT *, step > 60 OR coalesce(sum(length(action) + length(observation)) OVER
          (PARTITION BY query_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 1200 AS halt
          FROM steps)""" + _HALT,
    "live_guard": _TRAJECTORIES + """, epochs AS (SELECT *, CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3
          WHEN 'purchase' THEN 4 ELSE 5 END AS tool, coalesce(sum(CASE WHEN state = 'Successful' THEN 1 ELSE 0 END) OVER
          (PARTITION BY query_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM steps),
        ruled AS (SELECT query_id, step, CASE WHEN step > 60 OR coalesce(sum(length(action) + length(observation)) OVER
            (PARTITION BY query_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 1200 THEN 'budget exceeded'
          WHEN coalesce(action = lag(action, 1) OVER w AND action = lag(action, 2) OVER w, false) THEN 'same action 3 times repeated'
          WHEN action <> '' AND coalesce(sum(CASE WHEN state <> 'Successful' THEN 1 ELSE 0 END) OVER
          (PARTITION BY query_id, epoch, tool ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 3
          THEN 'early stop after retries' END AS reason FROM epochs WINDOW w AS (PARTITION BY query_id ORDER BY step))
        SELECT query_id, min(step) AS halt_step, arg_min(reason, step) AS reason FROM ruled WHERE reason IS NOT NULL GROUP BY query_id""",
    "masked_observation": _TRAJECTORIES + """, seen AS (SELECT query_id, step, action, state = 'Successful' AS ok,
          props.t AS observation FROM (SELECT *, {'t': ' ' || coalesce(observation, '') || ' of ' || event_id || chr(10)} AS props FROM steps)),
        told AS (SELECT *, lag(observation, 1) OVER w AS one, lag(observation, 2) OVER w AS two,
          trim(last_value(CASE WHEN ok THEN observation END IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY step
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ' ' || chr(10)) AS stale FROM seen WINDOW w AS (PARTITION BY query_id ORDER BY step)),
        shown AS (SELECT *, coalesce('Observation ' || (step - 2) || ':' || two || chr(10), '') || coalesce('Observation ' || (step - 1) || ':'
          || one || chr(10), '') || 'Action ' || step || ': ' || action AS pad FROM told)
        SELECT query_id, step, md5(CASE WHEN ok AND stale <> '' THEN replace(pad, stale,
          'Masked due to limited length. Make sure the data has been written in Notebook.') ELSE pad END) AS masked_md5 FROM shown""",
    "truncated_trajectories": _TRAJECTORIES + """, parts AS (SELECT query_id, event_id * 2 AS pos, 'Action: ' || action AS line FROM acts
        UNION ALL SELECT query_id, event_id * 2 + 1, 'Observation ' || event_id || ': ' || repeat('w ', CAST(trunc(value) AS INTEGER) % 7) || observation FROM acts),
        sized AS (SELECT *, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) AS size, starts_with(line, 'Observation') AS seen,
          split_part(line, ':', 1) || ': [truncated wikipedia excerpt]' AS short FROM parts),
        ranked AS (SELECT *, sum(size) OVER (PARTITION BY query_id) - coalesce(sum(CASE WHEN seen THEN size - len(string_split(short, ' ')) ELSE 0 END)
          OVER (PARTITION BY query_id ORDER BY seen DESC, size DESC, pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 150 AS wanted FROM sized),
        done AS (SELECT *, bool_and(wanted AND seen) OVER (PARTITION BY query_id ORDER BY seen DESC, size DESC, pos DESC) AS cut FROM ranked)
        SELECT query_id, pos, cut, md5(CASE WHEN cut THEN short ELSE line END) AS line_md5 FROM done""",
    "trajectory_outcomes": _TRAJECTORIES + " SELECT state, count(*) AS steps FROM acts GROUP BY state",
    "trajectory_log": _TRAJECTORIES + " SELECT query_id, step, action, observation, state FROM steps",
}
