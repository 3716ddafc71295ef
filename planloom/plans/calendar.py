"""Calendar slots derived from orders: a golden text and the answers of two models per order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from planloom.functions.clock import slot
from planloom.operators.score import model_comparison, paired, same_slot, solve_rate, transitions
from planloom.plans.tables import table
from planloom.session import spread

MODEL_A, MODEL_B = "pred_5shot_a", "pred_5shot_b_1.0"


def key() -> Column:
    return F.col("o_orderkey")


def _proposal(hour: Column) -> Column:
    day = F.element_at(F.array(*map(F.lit, ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday"))),
                       (key() % 5 + 1).cast("int"))
    minute = F.when(F.col("o_custkey") % 2 == 0, ":00").otherwise(":30")
    return F.concat(F.lit("Here is the proposed time: "), day, F.lit(", "), hour.cast("string"), minute, F.lit(" - "),
                    (hour + 1).cast("string"), minute, F.lit(" "))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = 9 + key() % 7
    lost = key() % 77 == 0
    none = F.lit("No time works for everyone. \n")
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select(
        key().alias("id"), (2 + F.col("o_custkey") % 6).cast("string").alias("num_people"),
        (1 + key() % 12).cast("string").alias("num_days"),
        F.when(lost, none).otherwise(_proposal(hour)).alias("golden_plan"),
        F.when(lost | (key() % 11 == 0), none).when(key() % 3 == 0, _proposal(hour + 1)).otherwise(_proposal(hour)).alias(MODEL_A),
        F.when(lost, none).otherwise(F.concat(F.lit("SOLUTION: "), F.when(key() % 4 == 0, _proposal(hour + 2)).otherwise(
            _proposal(hour)))).alias(MODEL_B))


def slot_solve_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solve_rate(slots(spark, sf_dir), MODEL_A, "golden_plan")


def slot_solve_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solve_rate(slots(spark, sf_dir), MODEL_A, "golden_plan", ["num_people", "num_days"])


def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_comparison(slots(spark, sf_dir), "id", "golden_plan", [MODEL_A, MODEL_B], ["num_people"])


def self_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first model's answers to the second's, per number of people and in all."""
    hit = lambda c: same_slot(F.col(f"`{c}`"), F.col("golden_plan"))
    return transitions(slots(spark, sf_dir), hit(MODEL_A), hit(MODEL_B), ["num_people"])


def paired_solve_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and golden texts in two tables, some golden texts missing, paired by id."""
    rows = slots(spark, sf_dir)
    goldens = rows.where("id % 10 <> 4").select("id", "golden_plan")
    both = paired(rows.select("id", "num_people", MODEL_A), goldens, "id").na.fill("", ["golden_plan"])
    return solve_rate(both, MODEL_A, "golden_plan", ["num_people"])


def slot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and hours found in the answers of the second model."""
    found = slots(spark, sf_dir).select(slot(F.col(f"`{MODEL_B}`")).alias("slot")).select("slot.*")
    return found.groupBy("day", "start_hour", "end_hour").agg(F.count("*").alias("answers"))


QUERIES = {
    "slot_solve_rate": slot_solve_rate,
    "slot_solve_by_group": slot_solve_by_group,
    "model_comparison": compare_models,
    "slot_values": slot_values,
    "self_correction": self_correction,
    "paired_solve_rate": paired_solve_rate,
}

_SLOTS = """WITH slots AS (SELECT o_orderkey AS id, CAST(2 + o_custkey % 6 AS VARCHAR) AS num_people,
    CAST(1 + o_orderkey % 12 AS VARCHAR) AS num_days, o_orderkey % 5 AS day, 9 + o_orderkey % 7 AS hour,
    CASE WHEN o_custkey % 2 = 0 THEN 0.0 ELSE 0.5 END AS half, o_orderkey % 77 = 0 AS lost,
    o_orderkey % 77 = 0 OR (o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0) AS hit_a,
    o_orderkey % 77 = 0 OR o_orderkey % 4 <> 0 AS hit_b FROM orders)"""
_RATE = "count(*) AS samples, count(*) FILTER ({0}) AS solved, round(count(*) FILTER ({0}) / count(*)::DOUBLE, 6) AS solve_rate"

SQL = {
    "paired_solve_rate": f"""{_SLOTS}, found AS (SELECT num_people, CASE WHEN id % 10 = 4 THEN lost OR id % 11 = 0 ELSE hit_a END AS hit
        FROM slots) SELECT num_people, {_RATE.format('hit')} FROM found GROUP BY num_people""",
    "slot_solve_rate": f"{_SLOTS} SELECT {_RATE.format('hit_a')} FROM slots",
    "slot_solve_by_group": f"""{_SLOTS} SELECT num_people, num_days, {_RATE.format('hit_a')} FROM slots
        GROUP BY num_people, num_days ORDER BY num_people, num_days""",
    "model_comparison": f"""{_SLOTS}, long AS (SELECT '{MODEL_A}' AS model, num_people, hit_a AS hit FROM slots
        UNION ALL SELECT '{MODEL_B}', num_people, hit_b FROM slots)
        SELECT model, num_people, {_RATE.format('hit')} FROM long GROUP BY GROUPING SETS ((model, num_people), (model))""",
    "self_correction": f"""{_SLOTS}, cells AS (SELECT num_people, count(*) FILTER (hit_a AND hit_b) AS stayed_right,
        count(*) FILTER (hit_a AND NOT hit_b) AS right_to_wrong, count(*) FILTER (hit_b AND NOT hit_a) AS wrong_to_right,
        count(*) FILTER (NOT hit_a AND NOT hit_b) AS stayed_wrong FROM slots GROUP BY GROUPING SETS ((num_people), ()))
        SELECT *, round(wrong_to_right / nullif(wrong_to_right + stayed_wrong, 0)::DOUBLE, 6) AS corrected,
        round(right_to_wrong / nullif(right_to_wrong + stayed_right, 0)::DOUBLE, 6) AS broken FROM cells""",
    "slot_values": f"""{_SLOTS}, found AS (SELECT CASE WHEN lost THEN '' ELSE
        list_element(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday'], CAST(day + 1 AS INTEGER)) END AS day,
        CASE WHEN lost THEN -1 ELSE hour + half + CASE WHEN id % 4 = 0 THEN 2 ELSE 0 END END::DOUBLE AS start_hour,
        CASE WHEN lost THEN -1 ELSE hour + half + 1 + CASE WHEN id % 4 = 0 THEN 2 ELSE 0 END END::DOUBLE AS end_hour
        FROM slots) SELECT day, start_hour, end_hour, count(*) AS answers FROM found GROUP BY ALL""",
}
