"""Replays by scans and by folds against a plain loop, on random plans."""

import random

import pytest
from pyspark.sql import functions as F

from planloom.operators.ordered import arrange
from planloom.operators.record_replay import MINUTE, replay_record
from planloom.operators.records import next_step_rows, scored
from planloom.operators.replay import (CLAMPED, LENIENT, STRICT, first_failures, plan_scores, replay, replay_structured,
                                       with_people)
from planloom.functions.plan_text import text_steps, typed_steps

PLACES = "ABCD"
EDGES = {(a, b): 5 + 3 * abs(PLACES.index(a) - PLACES.index(b)) for a in PLACES for b in PLACES if (a, b) != ("A", "D")}
PEOPLE = {f"p{i}": (PLACES[i % 4], 480 + 20 * i, 900 + 30 * i, 10 + 5 * (i % 3)) for i in range(8)}


def _plans(count, longest, seed):
    rng = random.Random(seed)
    plans = []
    for pid in range(count):
        size, now, people = rng.randint(1, longest), 540, rng.sample(sorted(PEOPLE), 8)
        steps = [("start", None, None, None, False)]
        for _ in range(size):
            roll = rng.random()
            if roll < 0.4 and people:
                who = people.pop()
                steps.append(("travel", PEOPLE[who][0], None, None, False))
                steps.append(("meet", None, None, who if rng.random() < 0.95 else "nobody", False))
            elif roll < 0.6:
                now += rng.randint(-20, 60)
                steps.append(("wait", None, now if rng.random() < 0.97 else None, None, False))
            elif roll < 0.95:
                steps.append(("travel", rng.choice(PLACES), None, None, rng.random() < 0.03))
            elif roll < 0.97:
                steps.append(("unknown", None, None, None, False))
            elif roll < 0.99:
                steps.append(("meet", None, None, rng.choice(sorted(PEOPLE)), False))
        plans.append((pid, rng.choice("ABC"), steps))
    return plans


def _loop(start, steps, rule):
    """(score, position of the first error, state before each step that is reached)"""
    place, now, met, seen = start, 540, set(), []
    for pos, (kind, dest, wait, person, malformed) in enumerate(steps):
        seen.append((place, now))
        if kind == "unknown" or malformed:
            return len(met), pos, seen
        if kind == "travel":
            if (place, dest) not in EDGES:
                return len(met), pos, seen
            now, place = now + EDGES[place, dest], dest
        elif kind == "wait":
            if wait is None or (rule == STRICT and wait <= now):
                return len(met), pos, seen
            now = max(now, wait) if rule == CLAMPED else wait
        elif kind == "meet":
            if person not in PEOPLE:
                return len(met), pos, seen
            where, opens, closes, minutes = PEOPLE[person]
            if rule != CLAMPED and (person in met or place != where or now < opens or now + minutes > closes):
                return len(met), pos, seen
            met.add(person)
            now += minutes
    return len(met), None, seen


def _step_table(spark, plans):
    rows = [(pid, start, 540, pos, *step) for pid, start, steps in plans for pos, step in enumerate(steps)]
    df = spark.createDataFrame(rows, "pid int, start_location string, start_min int, pos int, kind string, dest string, "
                                     "wait_min int, person string, malformed boolean")
    people = spark.createDataFrame([(n, *p) for n, p in PEOPLE.items()],
                                   "name string, place string, open_min int, close_min int, dur_min int")
    return with_people(df, people)


def _edges(spark):
    return spark.createDataFrame([(a, b, m) for (a, b), m in EDGES.items()], "origin string, dest string, minutes int")


@pytest.mark.parametrize("rule", [STRICT, LENIENT, CLAMPED])
@pytest.mark.parametrize("max_rows", [1_000_000, 40])
def test_scans_equal_loop(spark, rule, max_rows):
    plans = _plans(60, 12, 5) + [(1000 + p, s, steps) for p, s, steps in _plans(2, 300, 6)]
    seq = arrange(_step_table(spark, plans), ["pid"], ["pos"], max_rows=max_rows)
    assert seq.sliced == (max_rows == 40)
    done = replay(seq, _edges(spark), rule)
    rows = done.rows().collect()
    scores = {r["pid"]: r for r in plan_scores(done).collect()}
    for pid, start, steps in plans:
        score, stop, seen = _loop(start, steps, rule)
        if rule != CLAMPED:
            assert scores[pid]["score"] == score
        assert scores[pid]["first_error"] == stop
        reached = sorted((r["pos"], r["loc"], r["now"]) for r in rows if r["pid"] == pid and r["alive"])
        assert reached == [(pos, *state) for pos, state in enumerate(seen)]
    failed = {r["pid"] for r in first_failures(done).collect()}
    assert failed == {pid for pid, start, steps in plans if _loop(start, steps, rule)[1] is not None}


def test_steps_are_sorted_in_two_orders_only(spark):
    done = replay(arrange(_step_table(spark, _plans(20, 12, 5)), ["pid"], ["pos"]), F.broadcast(_edges(spark)), LENIENT)
    plan = done.rows()._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") == 5
    orders = done.rows()._jdf.queryExecution().executedPlan().toString().split("+- Sort [")[1:]
    assert sum("pid#" in order.split("]")[0] for order in orders) == 2


def _sentence(kind, dest, wait, person, malformed):
    clock = "soon" if wait is None else f"{(wait // 60 + 11) % 12 + 1}:{wait % 60:02d}{'AM' if wait % 1440 < 720 else 'PM'}"
    return {"start": "You start at A at 9:00AM", "travel": f"You travel {'' if malformed else 'to '}{dest} in 5 minutes",
            "wait": f"You wait until {clock}", "meet": f"You meet {person} for 10 minutes", "unknown": "You fly"}[kind]


@pytest.mark.parametrize("rule", [STRICT, LENIENT, CLAMPED])
def test_fold_over_texts_equals_loop(spark, rule):
    plans = _plans(150, 12, 8)
    rows = [(pid, start, "Well. SOLUTION: " + ". \n".join(_sentence(*s) for s in steps) + ".") for pid, start, steps in plans]
    df = spark.createDataFrame(rows, "pid int, start string, text string")
    people = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p[0]).alias("place"), F.lit(p[1]).alias("open_min"),
                                F.lit(p[2]).alias("close_min"), F.lit(p[3]).alias("dur_min")) for n, p in PEOPLE.items()])
    problem = F.struct(F.col("start").alias("start_location"), F.lit(540).alias("start_min"), people.alias("people"))
    matrix = F.create_map(*[x for a in PLACES for x in (F.lit(a), F.create_map(*[
        F.lit(y) for b in PLACES if (a, b) in EDGES for y in (b, EDGES[a, b])]))])
    steps = typed_steps(text_steps(F.col("text")))
    got = {r["pid"]: r["s"] for r in df.select("pid", replay_record(steps, problem, matrix, rule).alias("s")).collect()}
    for pid, start, plan in plans:
        score, stop, _ = _loop(start, plan, rule)
        assert got[pid]["first_error"] == (None if stop is None else stop + 1)
        if rule != CLAMPED:
            assert got[pid]["score"] == score
        assert bool(got[pid]["reasons"]) == (stop is not None)


def test_fractions_of_a_minute(spark):
    """Travel times are added as they are, shown as they are written, and a cell that is no number is no edge."""
    cells = '{"A": {"B": 5.5, "C": 0.1, "D": "soon", "A": 7.25}, "B": {"A": 4.5}, "C": {"B": 59.9, "A": None}}'
    constraints = "[['A', '9:00AM'], ['p', 'A', '9:00AM to 9:20AM', 10], ['q', 'B', '9:00AM to 11:00AM', 60]]"
    def plan(*places):
        return "SOLUTION: You start at A at 9:00AM. " + " ".join(f"You travel to {x} in 1 minutes." for x in places)
    rows = [("there and back", plan("B", "A") + " You meet p for 10 minutes."), ("too late", plan("B", "A", "A", "A") + " You meet p for 10 minutes."),
            ("exact", plan("C", "B") + " You meet q for 60 minutes."), ("no number", plan("D")), ("null", plan("C", "A"))]
    df = spark.createDataFrame([(k, p, constraints, cells, p, "2") for k, p in rows],
                               "id string, pred string, constraints string, dist_matrix string, golden_plan string, num_people string")
    got = {r["id"]: r for r in scored(df, "pred").collect()}
    minutes = {k: r["state"]["now"] / MINUTE for k, r in got.items()}
    assert minutes == {"there and back": 560, "too late": 564.5, "exact": 660, "no number": 540, "null": 540.1}
    assert got["too late"]["state"]["reasons"] == ["too_late"] and got["exact"]["pred_score"] == 1
    assert {k for k, r in got.items() if r["state"]["reasons"] == ["missing_distance"]} == {"no number", "null"}
    shown = next_step_rows(df.where("id = 'there and back'").withColumn("golden_plan", F.lit("['You travel to B in', 'You travel to A in', 'You meet p']")),
                           "id").orderBy("pos").collect()
    assert ("Distances (minutes):\n- A to B: 5.5\n- A to C: 0.1\n- A to D: soon\n- A to A: 7.25\n- B to A: 4.5\n- C to B: 59.9\n"
            "- C to A: None\n\n") in shown[0]["prompt"]
    assert ["Time: 9:00AM\n" in shown[0]["prompt"], "Time: 9:05AM\n" in shown[1]["prompt"], "Time: 9:10AM\n" in shown[2]["prompt"]] == [True] * 3


def test_scans_add_fractions(spark):
    steps = spark.createDataFrame([(1, "A", 540, p, k, d, w, None, False) for p, (k, d, w) in enumerate(
        [("travel", "B", None), ("travel", "A", None), ("wait", None, 600), ("travel", "C", None), ("start", None, None)])],
        "pid int, start_location string, start_min int, pos int, kind string, dest string, wait_min int, person string, malformed boolean")
    people = spark.createDataFrame([], "name string, place string, open_min int, close_min int, dur_min int")
    edges = spark.createDataFrame([("A", "B", "5.5"), ("B", "A", "4.25"), ("A", "C", "0.1")], "origin string, dest string, minutes string")
    rows = replay(arrange(with_people(steps, people), ["pid"], ["pos"]), edges, STRICT).rows().orderBy("pos").collect()
    assert [float(r["now"]) for r in rows] == [540, 545.5, 549.75, 600, 600.1] and all(r["alive"] for r in rows)


def _structured_loop(start, elements):
    place, now, met = start, 540, set()
    for pos, (location, person, at) in list(enumerate(elements, 1))[1:]:
        if location and location != place:
            if (place, location) not in EDGES:
                return len(met), pos
            now, place = now + EDGES[place, location], location
        if at is None or at < now:
            return len(met), pos
        now = at
        if person not in PEOPLE:
            continue
        where, opens, closes, minutes = PEOPLE[person]
        if person in met or place != where or now < opens or now + minutes > closes:
            return len(met), pos
        met.add(person)
        now += minutes
    return len(met), None


@pytest.mark.parametrize("max_rows", [1_000_000, 40])
def test_structured_equals_loop(spark, max_rows):
    rng = random.Random(11)
    plans = []
    for pid in range(80):
        at, elements = 540, []
        for _ in range(rng.randint(1, 10) if pid else 200):
            at += rng.randint(5, 70)
            who = rng.choice([*sorted(PEOPLE), "N/A"])
            where = PEOPLE[who][0] if who in PEOPLE and rng.random() < 0.8 else rng.choice(["A", "B", "", None])
            elements.append((where, who, at))
        plans.append((pid, rng.choice("ABC"), elements))
    rows = [(pid, start, 540, pos, *e) for pid, start, es in plans for pos, e in enumerate(es, 1)]
    df = spark.createDataFrame(rows, "pid int, start_location string, start_min int, pos int, location string, person string, start_at int")
    people = spark.createDataFrame([(n, *p) for n, p in PEOPLE.items()],
                                   "name string, place string, open_min int, close_min int, dur_min int")
    seq = arrange(with_people(df, people), ["pid"], ["pos"], max_rows=max_rows)
    got = {r["pid"]: (r["score"], r["first_error"]) for r in plan_scores(replay_structured(seq, _edges(spark))).collect()}
    for pid, start, elements in plans:
        if len(elements) > 1:
            assert got[pid] == _structured_loop(start, elements)
