"""Lookups, membership and stated predicates over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from planloom.operators.lookup import lookup, member, not_member, notebook, predicate, stated_predicates
from planloom.operators.score import day_costs, day_plan, within_budget
from planloom.plans.tables import table
from planloom.session import scratch_path
from planloom.sources.files import read_lines

STATED = "p_size<=20, p_retailprice>=905, p_name contains ring, p_type~contains ECO, ignored"


def predicate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    part = part.where(predicate(stated_predicates(STATED), part))
    return part.select("p_partkey", "p_name", "p_type", "p_size")


def _cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' names as a list file, read back: its first 20 are valid cities."""
    path = scratch_path(spark, "cities")
    names = table(spark, sf_dir, "nation").where("n_nationkey < 20").select("n_name")
    names.coalesce(1).write.text(path)
    return read_lines(spark, path, "city")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as requests for a city."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("city"))


def city_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, cities = _requests(spark, sf_dir), _cities(spark, sf_dir)
    valid = member(requests, "city", cities, "city").withColumn("message", F.lit(None).cast("string"))
    return valid.unionByName(not_member(requests, "city", cities, "city"))


def batch_lookup_1key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by city, per requesting customer's city."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    offers = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("city")).agg(
        F.count("*").alias("offers"), F.min("s_name").alias("first_offer"))
    return lookup(_requests(spark, sf_dir), offers, ["city"])


def batch_lookup_3key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights by origin, destination and date: requests from lines, answers from other orders' totals."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    requests = line.select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 25).alias("origin"),
                           (F.col("l_partkey") % 25).alias("dest"), F.to_date("l_shipdate").alias("day"))
    flights = order.groupBy((F.col("o_custkey") % 25).alias("origin"), (F.col("o_orderkey") % 25).alias("dest"),
                            F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("flights"),
                                                                      F.min("o_orderkey").alias("first_flight"))
    found = lookup(requests, flights, ["origin", "dest", "day"])
    return found.groupBy("origin", F.col("flights").isNotNull().alias("answered")).agg(
        F.count("*").alias("requests"), F.sum("flights").alias("flights"), F.min("first_flight").alias("first_flight"))


def notebook_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and cities retrieved per customer, as notes."""
    order = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    notes = notebook("c_custkey", Cities=_requests(spark, sf_dir), Orders=order)
    return notes.groupBy("c_custkey", "label").agg(F.count("*").alias("notes"), F.min("note").alias("first_note"))


def budget_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line prices (some of them no numbers) against the order's total."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    steps = line.select(F.col("l_orderkey").alias("plan"), F.when(F.col("l_linenumber") == 5, "unknown").otherwise(
        F.col("l_extendedprice").cast("string")).alias("cost"))
    joined = steps.join(order, F.col("plan") == F.col("o_orderkey"))
    return within_budget(joined, "plan", F.col("cost"), F.col("o_totalprice")).groupBy("within").agg(
        F.count("*").alias("plans"), F.round(F.sum("total_cost"), 0).alias("cost"))


def day_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost per order and ship year. A line is a day's plan in JSON; its quantity is the number of people."""
    plan = F.to_json(F.struct(F.col("l_quantity").cast("int").alias("people_number"), F.year("l_shipdate").alias("day"),
                              F.lit("-").alias("dinner"), F.col("l_returnflag").alias("lunch")))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", day_plan(plan).alias("plan"))
    items = line.select("l_orderkey", "l_extendedprice", "plan.*")
    return day_costs(items, "l_orderkey", "day", F.col("l_extendedprice"), F.col("people_number"))


QUERIES = {
    "predicate_filter": predicate_filter,
    "city_membership": city_membership,
    "batch_lookup_1key": batch_lookup_1key,
    "batch_lookup_3key": batch_lookup_3key,
    "notebook_bundle": notebook_bundle,
    "budget_check": budget_check,
    "day_cost": day_cost,
}

_REQUESTS = "requests AS (SELECT c_custkey, 'NATION_' || c_nationkey AS city FROM customer)"
SQL = {
    "predicate_filter": """SELECT p_partkey, p_name, p_type, p_size FROM part WHERE p_size <= 20
        AND p_retailprice >= 905 AND contains(p_name, 'ring') AND NOT contains(p_type, 'ECO')""",
    "city_membership": f"""WITH {_REQUESTS} SELECT c_custkey, city, CASE WHEN n_name IS NULL THEN city || ' is not valid'
        END AS message FROM requests LEFT JOIN nation ON city = n_name AND n_nationkey < 20""",
    "batch_lookup_1key": f"""WITH {_REQUESTS}, offers AS (SELECT n_name AS city, count(*) AS offers, min(s_name) AS first_offer
        FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
        SELECT r.city, c_custkey, offers, first_offer FROM requests r LEFT JOIN offers o ON r.city = o.city""",
    "batch_lookup_3key": """WITH flights AS (SELECT o_custkey % 25 AS origin, o_orderkey % 25 AS dest, o_orderdate::DATE AS day,
        count(*) AS flights, min(o_orderkey) AS first_flight FROM orders GROUP BY ALL)
        SELECT l_suppkey % 25 AS origin, f.flights IS NOT NULL AS answered, count(*) AS requests,
        CAST(sum(flights) AS BIGINT) AS flights, min(first_flight) AS first_flight FROM lineitem
        LEFT JOIN flights f ON l_suppkey % 25 = f.origin AND l_partkey % 25 = f.dest AND l_shipdate::DATE = f.day GROUP BY 1, 2""",
    "notebook_bundle": f"""WITH {_REQUESTS}, notes AS (SELECT c_custkey, 'Cities' AS label, '{{"city":"' || city || '"}}' AS note
        FROM requests UNION ALL SELECT o_custkey, 'Orders', '{{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"'
        || o_orderstatus || '"}}' FROM orders)
        SELECT c_custkey, label, count(*) AS notes, min(note) AS first_note FROM notes GROUP BY 1, 2""",
    "budget_check": """WITH plans AS (SELECT l_orderkey, round(coalesce(sum(CASE WHEN l_linenumber <> 5 THEN l_extendedprice END), 0), 2)
        AS cost, max(o_totalprice) AS budget FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
        SELECT cost <= budget AS within, count(*) AS plans, round(sum(cost), 0) AS cost FROM plans GROUP BY 1""",
    "day_cost": """SELECT l_orderkey, CAST(year(l_shipdate) AS INTEGER) AS day, count(*) AS items,
        round(sum(l_extendedprice * l_quantity), 2) AS cost FROM lineitem GROUP BY 1, 2""",
}
