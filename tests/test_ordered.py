"""Scans over oversized groups give what a plain window gives."""

import random

from pyspark.sql import functions as F

from planloom.operators.ordered import arrange, dealt, highest, latest, sort_tasks, total


def _table(spark):
    rng = random.Random(3)
    rows = [(key, pos, rng.randint(-5, 9) if rng.random() < 0.7 else None, rng.choice("xyz"))
            for key, size in (("big", 700), ("small", 5), ("other", 90), (None, 300)) for pos in range(size)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "key string, pos int, value int, kind string")


def _scanned(seq):
    seq = seq.running(n=total(1), before=total(F.coalesce("value", F.lit(0)), inclusive=False),
                      seen=latest(F.col("value"), inclusive=False), top=highest(F.col("value")))
    seq = seq.running(by=["kind"], of_kind=total(1, inclusive=False))
    return sorted(seq.running(again=latest(F.col("n") - F.col("value"))).rows().collect(), key=str)


def test_sliced_equals_plain(spark):
    df = _table(spark)
    plain, sliced = arrange(df, ["key"], ["pos"]), arrange(df, ["key"], ["pos"], max_rows=60)
    assert not plain.sliced and sliced.sliced
    assert sliced.df.select("_slice").distinct().count() > 4
    assert _scanned(plain) == _scanned(sliced)


def test_against_loop(spark):
    df = _table(spark)
    got = {(r["key"], r["pos"]): r for r in arrange(df, ["key"], ["pos"], max_rows=60).running(
        n=total(1), top=highest(F.col("value")), seen=latest(F.col("value"), inclusive=False)).rows().collect()}
    groups = {}
    for r in sorted(df.collect(), key=lambda r: r["pos"]):
        n, top, seen = groups.get(r["key"], (0, None, None))
        n, top = n + 1, r["value"] if top is None else max(top, r["value"]) if r["value"] is not None else top
        row = got[r["key"], r["pos"]]
        assert (row["n"], row["top"], row["seen"]) == (n, top, seen)
        groups[r["key"]] = (n, top, r["value"] if r["value"] is not None else seen)


def test_whole_table_as_one_group(spark):
    df = spark.range(1000).withColumn("at", F.col("id") * 7 % 1000)
    rows = arrange(df, [], ["at"]).running(n=total(1)).rows().collect()
    assert all(r["n"] == r["at"] + 1 for r in rows)


def test_large_tables_are_dealt_by_rows(spark):
    df = _table(spark)
    assert sort_tasks(df) is None and sort_tasks(df, rows_per_task=10) == -(-df.count() // 10)
    many = dealt(df, ["key"], 40)
    seq = arrange(many, ["key"], ["pos"], tasks=40).running(n=total(1)).running(by=["kind"], of_kind=total(1))
    plan = seq.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 1
    sliced = arrange(many, ["key"], ["pos"], max_rows=60, tasks=40)
    assert sliced.sliced and sliced.df.rdd.getNumPartitions() == 40
    assert _scanned(sliced) == _scanned(arrange(df, ["key"], ["pos"]))
