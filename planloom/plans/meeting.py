"""Meeting plans as step tables, derived from the order tables, and their reports.

An order is a plan, its lines are visits: travel to the supplier's nation, on even lines wait, meet the
supplier. The sentences are written out and parsed back; some are spoilt on purpose by supplier number.
The golden plan of an order has the same visits unspoilt and without waits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from planloom.functions.clock import clock_text
from planloom.functions.plan_text import MEET, TRAVEL, WAIT, step
from planloom.operators.ordered import MAX_GROUP_ROWS, Ordered, arrange, dealt, sort_tasks, total
from planloom.operators.replay import (CLAMPED, LENIENT, STRICT, first_failures, plan_scores, replay,
                                       replay_structured, with_people)
from planloom.operators.score import SAMPLES_PER_SIZE, accuracy_by_size, in_size_range, overall_accuracy, rate
from planloom.plans.tables import table

VISIT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def s() -> Column:
    return F.col("l_suppkey")


def distance_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nation with its distances as a nested map; a distance of 7 keys is left out."""
    nation = table(spark, sf_dir, "nation")
    last = nation.agg(F.max("n_nationkey").cast("int")).first()[0]
    others = F.filter(F.sequence(F.lit(0), F.lit(last or 0)), lambda b: F.abs(F.col("n_nationkey") - b) != 7)
    return nation.select(F.col("n_name").alias("origin"), F.map_from_entries(F.transform(
        others, lambda b: F.struct(F.concat(F.lit("NATION_"), b.cast("string")),
                                   5 + F.abs(F.col("n_nationkey") - b)))).alias("to"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distances as an edge table."""
    return distance_records(spark, sf_dir).select("origin", F.explode("to").alias("dest", "minutes"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as people to meet: where, from when, until when, for how long."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    s = F.col("s_suppkey")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey"), F.col("s_name").alias("name"), F.col("n_name").alias("place"),
        (480 + 60 * (s % 5)).alias("open_min"), (960 + 60 * (s % 5)).alias("close_min"),
        (15 * (1 + s % 6)).alias("dur_min"), F.col("s_nationkey"))


def visits(spark: SparkSession, sf_dir: str, max_rows: int = MAX_GROUP_ROWS,
           lookup: bool = False) -> Ordered:
    """Lines with their person and start place, numbered ``k`` within the order."""
    line = table(spark, sf_dir, "lineitem")
    order, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    # both sides of the join by order are dealt alike: windows over the orders' steps keep that, without a further shuffle
    tasks = sort_tasks(line)
    start = (order.join(customer, F.col("o_custkey") == F.col("c_custkey"))
             .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
             .select("o_orderkey", F.col("n_name").alias("start_location")))
    start = dealt(start, ["o_orderkey"], tasks)
    person = people(spark, sf_dir)
    if lookup:
        # structured plans: the person is named by text, some of them unknown, and looked up by name
        person = person.select("s_suppkey", "name", F.col("place").alias("s_place"))
    met = line.select("l_orderkey", *VISIT_ORDER).join(person, F.col("l_suppkey") == F.col("s_suppkey"))
    df = dealt(met, ["l_orderkey"], tasks).join(start, F.col("l_orderkey") == F.col("o_orderkey")).drop("s_suppkey", "o_orderkey")
    if lookup:
        df = df.withColumn("person", F.when(s() % 7 == 0, "Nobody").otherwise(F.col("name"))).drop("name")
        df = with_people(df, people(spark, sf_dir).drop("s_suppkey", "s_nationkey"))
    seq = arrange(df.withColumnRenamed("l_orderkey", "pid"), ["pid"], VISIT_ORDER,
                  measure=line.select(F.col("l_orderkey").alias("pid")), max_rows=max_rows, tasks=tasks)
    return seq.running(k=total(1)).with_columns(start_min=F.lit(540))


def _sentences(golden: bool) -> Column:
    """The visit's sentences with their positions."""
    place = F.concat(F.lit("NATION_"), (F.col("s_nationkey") if golden else F.when(
        s() % 13 == 4, (F.col("s_nationkey") + 1) % 25).otherwise(F.col("s_nationkey"))).cast("string"))
    verb, name = F.lit("You travel to "), F.col("name")
    if not golden:
        verb = F.when(s() % 13 == 2, "You fly to ").when(s() % 13 == 3, "You travel ").otherwise(verb)
        name = F.when(s() % 13 == 1, "Nobody").otherwise(name)
    k = F.col("k")
    until = clock_text(540 + 70 * k + s() % 60)
    def row(pos: Column, text: Column) -> Column:
        return F.struct(F.lit("golden" if golden else "pred").alias("variant"), pos.alias("pos"), text.alias("text"))
    travel = row(3 * k, F.concat(verb, place, F.lit(" in 10 minutes")))
    meet = row(3 * k + 2, F.concat(F.lit("You meet "), name, F.lit(" for "), F.col("dur_min").cast("string"),
                                   F.lit(" minutes")))
    if golden:
        return F.array(travel, meet)
    wait = row(3 * k + 1, F.concat(F.lit("You wait until "), until))
    return F.array_compact(F.array(travel, F.when(F.col("l_linenumber") % 2 == 0, wait), meet))


def plan_steps(spark: SparkSession, sf_dir: str, golden: bool = False,
               max_rows: int = MAX_GROUP_ROWS) -> Ordered:
    """Step table of the predicted plans, and of the golden ones if asked for."""
    seq = visits(spark, sf_dir, max_rows)
    rows = F.concat(_sentences(False), _sentences(True)) if golden else _sentences(False)
    slice_col = ["_slice"] if seq.sliced else []
    df = seq.df.select("pid", *slice_col, "start_location", "start_min", "name", "place", "open_min",
                       "close_min", "dur_min", F.explode(rows).alias("row"))
    df = df.select("*", "row.*", step(F.col("row.text")).alias("step")).drop("row", "text").select("*", "step.*")
    known = (F.col("kind") == MEET) & (F.col("person") == F.col("name"))
    df = df.withColumns({c: F.when(known, F.col(c)) for c in ("place", "open_min", "close_min", "dur_min")})
    return seq.derive(df.drop("step", "name"), order=["pos"], keys=["pid", "variant"] if golden else ["pid"])


def replayed(spark: SparkSession, sf_dir: str, rule: str, golden: bool = False,
             max_rows: int = MAX_GROUP_ROWS) -> Ordered:
    return replay(plan_steps(spark, sf_dir, golden, max_rows), edges(spark, sf_dir), rule)


def plan_results(spark: SparkSession, sf_dir: str, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Per plan: number of people, predicted and golden score, and whether they agree."""
    seq = replayed(spark, sf_dir, LENIENT, True, max_rows)
    pred = F.col("variant") == "pred"
    first = (F.col("kind") == MEET) & (F.col("times_met") == 0)
    scores = seq.rows().groupBy("pid").agg(
        F.count_if(first & ~pred).alias("num_people"), F.count_if(F.col("scored") & pred).alias("pred_score"),
        F.count_if(F.col("scored") & ~pred).alias("golden_score"))
    return scores.withColumn("correct", F.col("pred_score") == F.col("golden_score"))


def plan_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy_by_size(plan_results(spark, sf_dir), "num_people", "correct")


def accuracy_fixed_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy_by_size(plan_results(spark, sf_dir), "num_people", "correct", denominator=SAMPLES_PER_SIZE)


def overall_with_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overall_accuracy(plan_results(spark, sf_dir), in_size_range(F.col("num_people"), 4), F.col("correct"))


def scores_of(rule: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        seq = replayed(spark, sf_dir, rule)
        return plan_scores(seq, F.max(F.when(F.col("alive"), F.col("now"))).alias("last_now"))
    return run


def replay_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = replayed(spark, sf_dir, CLAMPED)
    return seq.rows().groupBy("pid").agg(
        F.count_if("alive").alias("steps_emitted"),
        F.min(F.when(F.col("error") == 1, F.col("pos"))).alias("first_error"),
        F.max(F.when(F.col("alive"), F.col("now"))).alias("last_now"))


def structured_steps(spark: SparkSession, sf_dir: str, max_rows: int = MAX_GROUP_ROWS) -> Ordered:
    """Visits as elements of (location, person, start); a leading element is there to be skipped."""
    seq = visits(spark, sf_dir, max_rows, lookup=True)
    k = F.col("k")
    return seq.derive(seq.df.withColumns({
        "pos": k + 1, "location": F.when(s() % 9 == 0, F.lit("")).otherwise(F.col("s_place")),
        "start_at": 540 + 10 * (s() % 4) + 75 * k}), order=["pos"])


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_scores(replay_structured(structured_steps(spark, sf_dir), edges(spark, sf_dir)))


def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (first_failures(replayed(spark, sf_dir, STRICT)).groupBy("reason")
            .agg(F.count("*").alias("plans"), F.sum("pos").alias("pos_sum")))


def plan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraint satisfaction, full success, length and tool calls of plans by number of people."""
    seq = replayed(spark, sf_dir, LENIENT)
    meet = F.col("kind") == MEET
    plans = plan_scores(seq, F.count("*").alias("length"), F.count_if(meet & (F.col("times_met") == 0)).alias("goals"),
                        F.count_if(F.col("kind") != WAIT).alias("calls"))
    return plans.groupBy("goals").agg(
        F.count("*").alias("plans"), F.sum("score").alias("goals_met"),
        rate(F.sum("score"), F.sum("goals")).alias("satisfaction"),
        F.count_if(F.col("score") == F.col("goals")).alias("successes"),
        F.sum("length").alias("steps"), F.sum("calls").alias("calls"))


def verifier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans worth training on: as good as the golden plan, and not trivial."""
    good = F.col("correct") & (F.col("num_people") >= 2) & (F.col("golden_score") >= 1)
    return plan_results(spark, sf_dir).where(good).select("pid", "num_people", "golden_score")


def step_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps before the first error of each plan, counted by kind."""
    return (replayed(spark, sf_dir, LENIENT).rows().where("alive and error = 0").groupBy("kind")
            .agg(F.count("*").alias("steps"), F.sum("pos").alias("pos_sum"), F.sum("now").alias("now_sum")))


def travel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Travel steps by whether the distance is known."""
    seq = replayed(spark, sf_dir, LENIENT)
    travel = seq.rows().where((F.col("kind") == TRAVEL) & ~F.col("malformed"))
    return travel.groupBy(F.col("travel_min").isNotNull().alias("known")).agg(
        F.count("*").alias("steps"), F.sum("travel_min").alias("minutes"))


QUERIES = {
    "plan_accuracy": plan_accuracy,
    "accuracy_fixed_denominator": accuracy_fixed_denominator,
    "overall_with_skipped": overall_with_skipped,
    "replay_strict": scores_of(STRICT),
    "replay_lenient": scores_of(LENIENT),
    "replay_clamped": replay_clamped,
    "replay_structured": structured,
    "failure_reasons": failure_reasons,
    "plan_metrics": plan_metrics,
    "verifier_filter": verifier_filter,
    "step_filter": step_filter,
    "travel_lookup": travel_lookup,
}

_VISITS = """
visits AS (
  SELECT l_orderkey AS pid, l_linenumber AS ln, l_suppkey AS s, s_name, sn.n_name AS s_place,
         'NATION_' || ((s_nationkey + 1) % 25) AS next_place, cn.n_name AS start_location, 540 AS start_min,
         480 + 60 * (l_suppkey % 5) AS s_open, 960 + 60 * (l_suppkey % 5) AS s_close,
         15 * (1 + l_suppkey % 6) AS s_dur,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS k
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey),
edges AS (
  SELECT a.n_name AS origin, b.n_name AS dest, 5 + abs(a.n_nationkey - b.n_nationkey) AS minutes
  FROM nation a, nation b WHERE abs(a.n_nationkey - b.n_nationkey) <> 7)"""

_STEPS = """
steps AS (
  SELECT pid, 'pred' AS variant, 3 * k AS pos, CASE WHEN s % 13 = 2 THEN 'unknown' ELSE 'travel' END AS kind,
         CASE s % 13 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN next_place ELSE s_place END AS dest,
         NULL::BIGINT AS wait_min, NULL::VARCHAR AS person, s % 13 = 3 AS malformed, start_location, start_min,
         NULL::VARCHAR AS place, NULL::BIGINT AS open_min, NULL::BIGINT AS close_min, NULL::BIGINT AS dur_min
  FROM visits
  UNION ALL SELECT pid, 'pred', 3 * k + 1, 'wait', NULL, (540 + 70 * k + s % 60) % 1440, NULL, false,
         start_location, start_min, NULL, NULL, NULL, NULL FROM visits WHERE ln % 2 = 0
  UNION ALL SELECT pid, 'pred', 3 * k + 2, 'meet', NULL, NULL, CASE WHEN s % 13 = 1 THEN 'Nobody' ELSE s_name END,
         false, start_location, start_min, CASE WHEN s % 13 <> 1 THEN s_place END,
         CASE WHEN s % 13 <> 1 THEN s_open END, CASE WHEN s % 13 <> 1 THEN s_close END,
         CASE WHEN s % 13 <> 1 THEN s_dur END FROM visits
  UNION ALL SELECT pid, 'golden', 3 * k, 'travel', s_place, NULL, NULL, false, start_location, start_min,
         NULL, NULL, NULL, NULL FROM visits
  UNION ALL SELECT pid, 'golden', 3 * k + 2, 'meet', NULL, NULL, s_name, false, start_location, start_min,
         s_place, s_open, s_close, s_dur FROM visits)"""

_BEFORE = "OVER (PARTITION BY pid, variant ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def replay_sql(rule: str) -> str:
    """The replay over a CTE ``steps``, as further CTEs that end in ``replayed``."""
    base = (f"coalesce(last_value(wait_min - spent IGNORE NULLS) {_BEFORE}, start_min)" if rule != CLAMPED
            else f"greatest(max(wait_min - spent) {_BEFORE}, start_min)")
    meet = "kind = 'meet' AND NOT malformed"
    checks = [("unknown_step", "kind = 'unknown'"), ("malformed_travel", "kind = 'travel' AND malformed"),
              ("missing_distance", "kind = 'travel' AND NOT malformed AND travel_min IS NULL")]
    if rule == STRICT:
        checks.append(("backwards_wait", "kind = 'wait' AND wait_min <= now"))
    if rule == CLAMPED:
        checks.append(("unknown_person", f"{meet} AND dur_min IS NULL"))
    else:
        known = f"{meet} AND times_met = 0 AND dur_min IS NOT NULL"
        checks += [("already_met", f"{meet} AND times_met > 0"),
                   ("unknown_person", f"{meet} AND times_met = 0 AND dur_min IS NULL"),
                   ("wrong_location", f"{known} AND loc <> place"), ("too_early", f"{known} AND now < open_min"),
                   ("too_late", f"{known} AND now + dur_min > close_min")]
    reasons = ", ".join(f"CASE WHEN {hit} THEN '{name}' END" for name, hit in checks)
    return f"""
located AS (SELECT *, coalesce(last_value(dest IGNORE NULLS) {_BEFORE}, start_location) AS loc FROM steps),
travelled AS (SELECT l.*, e.minutes AS travel_min,
    CASE kind WHEN 'travel' THEN coalesce(e.minutes, 0) WHEN 'meet' THEN coalesce(dur_min, 0) ELSE 0 END AS spend
  FROM located l LEFT JOIN edges e ON l.loc = e.origin AND l.dest = e.dest),
spent AS (SELECT *, sum(spend) OVER (PARTITION BY pid, variant ORDER BY pos) AS spent,
    count(CASE WHEN kind = 'meet' THEN 1 END) OVER (PARTITION BY pid, variant, person ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS times_met FROM travelled),
timed AS (SELECT *, spent - spend + {base} AS now FROM spent),
checked AS (SELECT *, list_filter([{reasons}], lambda x: x IS NOT NULL) AS reasons FROM timed),
replayed AS (SELECT *, CASE WHEN len(reasons) > 0 THEN 1 ELSE 0 END AS error,
    coalesce(sum(len(reasons)) {_BEFORE}, 0) = 0 AS alive,
    coalesce(sum(len(reasons)) {_BEFORE}, 0) + len(reasons) = 0 AND kind = 'meet' AS scored FROM checked)"""


def _with(rule: str, variants: str = "pred") -> str:
    steps = _STEPS if variants == "both" else _STEPS[:_STEPS.index("  UNION ALL SELECT pid, 'golden', 3 * k,")].rstrip() + ")"
    return f"WITH {_VISITS.strip()}, {steps.strip()}, {replay_sql(rule).strip()}"


_RESULTS = f"""{_with(LENIENT, "both")},
results AS (SELECT pid, count(*) FILTER (kind = 'meet' AND times_met = 0 AND variant = 'golden') AS num_people,
    count(*) FILTER (scored AND variant = 'pred') AS pred_score,
    count(*) FILTER (scored AND variant = 'golden') AS golden_score FROM replayed GROUP BY pid)"""

_BY_SIZE = """, counts AS (SELECT num_people AS n, count(*) AS evaluated,
    count(*) FILTER (pred_score = golden_score) AS correct FROM results GROUP BY num_people)
SELECT CAST(r.n AS INTEGER) AS n, coalesce(evaluated, 0) AS evaluated, coalesce(correct, 0) AS correct,
       {rate} AS accuracy
FROM (SELECT DISTINCT num_people AS n FROM results WHERE num_people >= 1) r LEFT JOIN counts c ON r.n = c.n ORDER BY r.n"""

_SCORES = """ SELECT pid, CAST(count(*) FILTER (scored) AS BIGINT) AS score, min(pos) FILTER (error = 1) AS first_error,
  CAST(max(now) FILTER (alive) AS BIGINT) AS last_now FROM replayed GROUP BY pid"""

_STRUCTURED = f"""WITH {_VISITS.strip()},
elements AS (SELECT pid, 'pred' AS variant, k + 1 AS pos, nullif(CASE WHEN s % 9 = 0 THEN '' ELSE s_place END, '') AS dest,
    CASE WHEN s % 7 = 0 THEN 'Nobody' ELSE s_name END AS person, 540 + 10 * (s % 4) + 75 * k AS start_at,
    CASE WHEN s % 7 <> 0 THEN s_place END AS place, CASE WHEN s % 7 <> 0 THEN s_open END AS open_min,
    CASE WHEN s % 7 <> 0 THEN s_close END AS close_min, CASE WHEN s % 7 <> 0 THEN s_dur END AS dur_min,
    start_location, start_min FROM visits),
located AS (SELECT *, coalesce(last_value(dest IGNORE NULLS) {_BEFORE}, start_location) AS loc,
    last_value(start_at + coalesce(dur_min, 0)) {_BEFORE} AS ended,
    row_number() OVER (PARTITION BY pid, person ORDER BY pos) AS nth FROM elements),
moved AS (SELECT l.*, coalesce(l.dest <> loc, false) AS moves, e.minutes FROM located l
    LEFT JOIN edges e ON loc = e.origin AND l.dest = e.dest),
checked AS (SELECT *, (moves AND minutes IS NULL)
    OR coalesce(start_at < coalesce(ended, start_min) + CASE WHEN moves THEN minutes ELSE 0 END, false)
    OR (dur_min IS NOT NULL AND (nth > 1 OR coalesce(dest, loc) <> place OR start_at < open_min
        OR start_at + dur_min > close_min)) AS error FROM moved),
stopped AS (SELECT *, min(CASE WHEN error THEN pos END) OVER (PARTITION BY pid) AS first_error FROM checked)
SELECT pid, count(*) FILTER (dur_min IS NOT NULL AND (first_error IS NULL OR pos < first_error)) AS score,
       max(first_error) AS first_error FROM stopped GROUP BY pid"""

SQL = {
    "plan_accuracy": _RESULTS + _BY_SIZE.format(rate="round(correct / evaluated::DOUBLE, 6)"),
    "accuracy_fixed_denominator": _RESULTS + _BY_SIZE.format(rate="round(coalesce(correct, 0) / 100.0, 6)::DOUBLE"),
    "overall_with_skipped": _RESULTS + """ SELECT count(*) AS processed,
        count(*) FILTER (num_people BETWEEN 1 AND 4) AS evaluated,
        count(*) FILTER (num_people BETWEEN 1 AND 4 AND pred_score = golden_score) AS correct,
        round(count(*) FILTER (num_people BETWEEN 1 AND 4 AND pred_score = golden_score) / count(*)::DOUBLE, 6)
          AS accuracy FROM results""",
    "replay_strict": _with(STRICT) + _SCORES,
    "replay_lenient": _with(LENIENT) + _SCORES,
    "replay_clamped": _with(CLAMPED) + """ SELECT pid, count(*) FILTER (alive) AS steps_emitted,
        min(pos) FILTER (error = 1) AS first_error, CAST(max(now) FILTER (alive) AS BIGINT) AS last_now
        FROM replayed GROUP BY pid""",
    "replay_structured": _STRUCTURED,
    "failure_reasons": _with(STRICT) + """ SELECT reason, count(*) AS plans, CAST(sum(pos) AS BIGINT) AS pos_sum
        FROM (SELECT pos, unnest(reasons) AS reason FROM replayed WHERE alive AND error = 1) GROUP BY reason""",
    "plan_metrics": _with(LENIENT) + """, plans AS (SELECT pid, count(*) FILTER (scored) AS score, count(*) AS length,
        count(*) FILTER (kind = 'meet' AND times_met = 0) AS goals, count(*) FILTER (kind <> 'wait') AS calls
        FROM replayed GROUP BY pid)
        SELECT goals, count(*) AS plans, CAST(sum(score) AS BIGINT) AS goals_met,
        round(sum(score) / sum(goals)::DOUBLE, 6) AS satisfaction, count(*) FILTER (score = goals) AS successes,
        CAST(sum(length) AS BIGINT) AS steps, CAST(sum(calls) AS BIGINT) AS calls FROM plans GROUP BY goals""",
    "verifier_filter": _RESULTS + """ SELECT pid, num_people, golden_score FROM results
        WHERE pred_score = golden_score AND num_people >= 2 AND golden_score >= 1""",
    "step_filter": _with(LENIENT) + """ SELECT kind, count(*) AS steps, CAST(sum(pos) AS BIGINT) AS pos_sum,
        CAST(sum(now) AS BIGINT) AS now_sum FROM replayed WHERE alive AND error = 0 GROUP BY kind""",
    "travel_lookup": _with(LENIENT) + """ SELECT travel_min IS NOT NULL AS known, count(*) AS steps,
        CAST(sum(travel_min) AS BIGINT) AS minutes FROM replayed WHERE kind = 'travel' AND NOT malformed GROUP BY 1""",
}
