"""Accuracy of predictions, by group and by model. All groupings aggregate before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from planloom.functions.clock import slot
from planloom.functions.let import let
from planloom.functions.whole import whole_json

# Fixed value: size of the groups that the fixed-denominator report assumes.
SAMPLES_PER_SIZE = 100
# Money adds up exactly, so that its sum does not depend on the order of rows.
MONEY = "decimal(28,4)"


def rate(hits: Column, of: Column) -> Column:
    """Share rounded to 6 digits; null for an empty group."""
    return F.round(F.try_divide(hits.cast("double"), of.cast("double")), 6)


def same_slot(prediction: Column, golden: Column) -> Column:
    """Equal day, start and end. Two texts without a slot count as equal."""
    return slot(prediction) == slot(golden)


def paired(predictions: DataFrame, goldens: DataFrame, id_col: str) -> DataFrame:
    """Predictions with the golden text of the same id. A prediction without one stays, and counts."""
    return predictions.join(goldens, id_col, "left")


def solve_rate(df: DataFrame, prediction: str, golden: str, by: Sequence[str] = ()) -> DataFrame:
    """Records, solved records and solve rate, over all or per group (in the order of the group's texts)."""
    solved = df.select(*by, same_slot(F.col(f"`{prediction}`"), F.col(golden)).alias("hit"))
    hits = F.count_if("hit")
    out = solved.groupBy(*by).agg(F.count("*").alias("samples"), hits.alias("solved"),
                                  rate(hits, F.count("*")).alias("solve_rate"))
    return out.orderBy(*by) if by else out


def in_size_range(size: Column, largest: int | None = None) -> Column:
    """True where the number of people is a whole number from 1 on, up to ``largest`` if one is given."""
    number = size.try_cast("int")
    return F.coalesce(number >= 1 if largest is None else number.between(1, largest), F.lit(False))


def accuracy_by_size(df: DataFrame, size: str, correct: str, largest: int | None = None,
                     denominator: int | None = None, counted: Column | None = None) -> DataFrame:
    """Accuracy for every size that occurs, or for every size from 1 to ``largest``, also without records (null rate).

    Divides by the records of the size, or by a fixed ``denominator``. Only ``counted`` records count; naming
    them here instead of filtering spares the evaluation of a costly condition a second time.
    """
    counted = F.lit(True) if counted is None else counted
    size_n = F.col(size).try_cast("int")
    counts = (df.where(in_size_range(F.col(size), largest)).groupBy(size_n.alias("n"))
              .agg(F.count_if(counted).alias("evaluated"), F.count_if(counted & F.col(correct)).alias("correct")))
    out = counts
    if largest is not None:
        sizes = df.sparkSession.range(1, largest + 1).select(F.col("id").cast("int").alias("n"))
        out = sizes.join(counts, "n", "left").na.fill(0, ["evaluated", "correct"])
    of = F.col("evaluated") if denominator is None else F.lit(denominator)
    return out.withColumn("accuracy", rate(F.col("correct"), of)).orderBy("n")


def overall_accuracy(df: DataFrame, evaluated: Column, correct: Column) -> DataFrame:
    """Accuracy whose denominator also counts the records that were skipped."""
    hits = F.count_if(evaluated & correct)
    return df.agg(F.count("*").alias("processed"), F.count_if(evaluated).alias("evaluated"),
                  hits.alias("correct"), rate(hits, F.count("*")).alias("accuracy"))


def model_comparison(df: DataFrame, id_col: str, golden: str, predictions: Sequence[str],
                     by: Sequence[str] = ()) -> DataFrame:
    """Solve rate of several prediction columns side by side, with a total over the groups (nulls)."""
    long = df.unpivot([id_col, golden, *by], [F.col(f"`{p}`") for p in predictions], "model", "prediction")
    solved = long.select("model", *by, same_slot(F.col("prediction"), F.col(golden)).alias("hit"))
    hits = F.count_if("hit")
    aggregates = (F.count("*").alias("samples"), hits.alias("solved"),
                  rate(hits, F.count("*")).alias("solve_rate"))
    parts = solved.groupBy("model", *by).agg(*aggregates[:2])
    if not by:
        return parts.withColumn("solve_rate", rate(F.col("solved"), F.col("samples")))
    # the total adds up the small per-group counts instead of reading the records again
    total = F.grouping_id() == 0
    cubed = parts.rollup("model", *by).agg(
        F.sum("samples").alias("samples"), F.sum("solved").alias("solved"), F.grouping_id().alias("level"))
    keep = cubed.where((F.col("level") == 0) | (F.col("level") == 2 ** len(by) - 1))
    return keep.drop("level").withColumn("solve_rate", rate(F.col("solved"), F.col("samples")))


def transitions(df: DataFrame, before: Column, after: Column, by: Sequence[str] = ()) -> DataFrame:
    """How a second answer changes the outcome of a first one: paired counts per group, with a total over the groups (nulls).

    ``corrected`` is the share of wrong first answers that the second one mends, ``broken`` that of right ones that it spoils; null
    where there is none. A null outcome is a wrong one. The total adds up the groups' counts.
    """
    first, second = F.coalesce(before, F.lit(False)), F.coalesce(after, F.lit(False))
    cells = {"stayed_right": first & second, "right_to_wrong": first & ~second, "wrong_to_right": ~first & second, "stayed_wrong": ~first & ~second}
    counts = df.groupBy(*by).agg(*[F.count_if(hit).alias(name) for name, hit in cells.items()])
    if by:
        summed = counts.rollup(*by).agg(*[F.sum(name).alias(name) for name in cells], F.grouping_id().alias("_level"))
        counts = summed.where(F.col("_level").isin(0, 2 ** len(by) - 1)).drop("_level")
    return counts.withColumns({
        "corrected": rate(F.col("wrong_to_right"), F.col("wrong_to_right") + F.col("stayed_wrong")),
        "broken": rate(F.col("right_to_wrong"), F.col("right_to_wrong") + F.col("stayed_right"))})


def within_budget(steps: DataFrame, plan: str, cost: Column, budget: Column) -> DataFrame:
    """Sum of the numeric step costs of each plan against its budget; other costs are ignored."""
    amount = F.coalesce(F.sum(cost.try_cast(MONEY)), F.lit(0).cast(MONEY))
    return steps.groupBy(plan).agg(amount.alias("total_cost"), F.max(budget.cast(MONEY)).alias("budget")).withColumn(
        "within", F.col("total_cost") <= F.col("budget")).withColumn("total_cost", F.col("total_cost").cast("double"))


def listed_budget(plan_json: Column, budget: Column) -> Column:
    """The same for a plan in one JSON text: a list of steps with ``parameters.cost``; no list gives false."""
    plan = whole_json(plan_json)
    steps = F.try_variant_get(plan, "$", "array<variant>")
    listed = F.startswith(F.schema_of_variant(plan), F.lit("ARRAY"))
    cost = lambda s: F.coalesce(F.try_variant_get(s, "$.parameters.cost", "string").try_cast(MONEY), F.lit(0).cast(MONEY))
    spent = F.aggregate(steps, F.lit(0).cast(MONEY), lambda total, s: (total + cost(s)).cast(MONEY))
    return F.when(listed, spent <= budget.cast(MONEY)).otherwise(False)


# The fields of a day of a plan; "-" stands for not needed.
DAY_PLAN = ("people_number int, day int, current_city string, transportation string, breakfast string, attraction string, "
            "lunch string, dinner string, accommodation string")


def day_plan(text: Column) -> Column:
    """One day of a plan from its JSON text; fields that are not needed are null."""
    return let(F.from_json(text, DAY_PLAN), lambda d: F.struct(*[
        (F.nullif(d[name], F.lit("-")) if kind == "string" else d[name]).alias(name)
        for name, kind in (field.split() for field in DAY_PLAN.split(", "))]))


def day_costs(items: DataFrame, plan: str, day: str, price: Column, quantity: Column) -> DataFrame:
    """Cost of a plan's items per day: price times number of people."""
    return items.groupBy(plan, day).agg(
        F.count("*").alias("items"), F.round(F.sum(price.cast(MONEY) * quantity), 2).cast("double").alias("cost"))
