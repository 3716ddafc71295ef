"""Sources, lookups, responders, trajectories and the live guard."""

import json

import pytest
from pyspark.sql import functions as F

from planloom.operators.lookup import not_member, predicate, stated_predicates
from planloom.operators.ordered import total
from planloom.operators.predict import prediction_column, with_ledger, with_predictions, with_retries
from planloom.operators.records import with_verdict
from planloom.operators.score import accuracy_by_size, solve_rate, transitions
from planloom.operators.selection import best_and_worst, turn_pairs
from planloom.operators.trajectory import budgets, halts, numbered, repeats, retries
from planloom.plans import trajectories as recorded
from planloom.session import scratch_path
from planloom.sources.files import first_rows, read_lines, read_split, require_columns, require_rows, upsert, write_dataset
from planloom.sources.ids import with_positional_id
from planloom.sources.keyed_json import read_keyed_json, write_keyed_json
from planloom.streaming.guard import live_halts, run_guard

DATA = "/root/testdata/sf0.001"
RECORDS = {"k1": {"num": "3", "text": "a {b}\n  }, \"q\"", "nested": {"x": [1, 2]}}, "k2": {"num": "4", "id": None, "text": "c"},
           "k3": 5, "k4": {"num": "1", "id": "own", "text": "d"}}


@pytest.mark.parametrize("indent, layout", [(None, "whole"), (2, "whole"), (2, "indented"), (4, "indented")])
def test_read_keyed_json(spark, tmp_path, indent, layout):
    (tmp_path / "in.json").write_text(json.dumps(RECORDS, indent=indent))
    options = {"layout": layout} | ({"indent": indent} if layout == "indented" else {})
    rows = {r["id"]: r["record"] for r in read_keyed_json(spark, str(tmp_path), **options).collect()}
    assert rows.keys() == {"k1", "k2", "k4"} and rows["k1"]["text"] == RECORDS["k1"]["text"]
    assert json.loads(rows["k1"]["nested"]) == {"x": [1, 2]}
    kept = read_keyed_json(spark, str(tmp_path), keep_id=True, **options).collect()
    assert sorted(str(r["id"]) for r in kept) == ["None", "k1", "own"]


def test_write_keyed_json(spark):
    df = spark.createDataFrame([(f"r{i % 40}" if i % 50 else None, i, None if i % 3 else "x\ny") for i in range(400)],
                               "id string, at int, text string").repartition(3)
    path = scratch_path(spark, "keyed")
    write_keyed_json(df, path, "id", order="at")
    last = {r["id"]: r["at"] for r in sorted(df.collect(), key=lambda r: r["at"]) if r["id"] is not None}
    for layout in ("whole", "lines"):
        back = read_keyed_json(spark, path, spark.createDataFrame([], "at int, text string").schema, layout=layout)
        assert {r["id"]: r["at"] for r in back.collect()} == last
    files = spark.read.text(path, wholetext=True).collect()
    assert sum(len(json.loads(f["value"])) for f in files) == 40


@pytest.mark.parametrize("layout, indent, text", [
    ("whole", None, '{"a": {"x": 1}, "b": {"x"'), ("whole", None, "[1]"), ("whole", 2, '{"a": {"x": 1}'),
    ("lines", None, '{\n"a": {"x": 1},\n"b": {"x"\n}\n'), ("lines", None, '{\n"a": {"x": 1},\n'), ("lines", None, '{"a": {"x": 1}}'),
    ("lines", 2, '{\n  "a": {\n    "x": 1\n  }\n}'), ("indented", 2, '{\n  "a": {\n    "x": 1\n  },\n  "b": {\n    "x": 1'),
    ("indented", 2, '{\n  "a": {\n    "x": 1\n  },\n  "b": {\n    "x": nul\n  }\n}'), ("indented", 2, '{\n  "a": {\n    "x": 1\n  }'),
])
def test_damaged_keyed_json_is_an_error(spark, tmp_path, layout, indent, text):
    (tmp_path / "good.json").write_text({"whole": '{"g": {"x": 1}}', "lines": '{\n"g": {"x": 1}\n}\n', "indented": json.dumps({"g": {"x": 1}}, indent=2)}[layout])
    assert [r["id"] for r in read_keyed_json(spark, str(tmp_path), layout=layout).collect()] == ["g"]
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="keyed JSON"):
        read_keyed_json(spark, str(tmp_path), layout=layout).count()


def test_keyed_json_splits_by_default(spark, tmp_path):
    (tmp_path / "in.json").write_text("{\n" + ",\n".join(f'"k{i}": {{"x": {i}}}' for i in range(5000)) + "\n}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = read_keyed_json(spark, str(tmp_path))
        assert rows.count() == 5000 and rows.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_list_files_of_many_splits(spark, tmp_path):
    """Equal to stripping each file as a whole, also where its blank ends and its lines lie in several splits."""
    texts = {"a.txt": "\n \n  first \n\n" + "".join(f" city {i} \n" for i in range(400)) + "last \t\n\n  \n" * 2, "b.txt": "one", "c.txt": " \n\n", "d.txt": "x\r\n\r\ny\r\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        lines = read_lines(spark, str(tmp_path), "c")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        want = [w for text in texts.values() for w in text.replace("\r\n", "\n").strip().split("\n")]
        assert sorted(r["c"] for r in lines.collect()) == sorted(want)
        (tmp_path / "none").mkdir()
        (tmp_path / "none" / "e.txt").write_text("")
        assert read_lines(spark, str(tmp_path / "none"), "c").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files(spark, tmp_path):
    (tmp_path / "cities.txt").write_text("\nOslo\n\nRome\n\n")
    assert [r["c"] for r in read_lines(spark, str(tmp_path / "cities.txt"), "c").collect()] == ["Oslo", "", "Rome"]
    path = scratch_path(spark, "set")
    write_dataset(spark.range(10).withColumn("split", F.when(F.col("id") < 3, "test").otherwise("train")), path, "split")
    assert read_split(spark, path, "test").count() == 3
    for bad in (lambda: read_split(spark, path, "none"), lambda: require_columns(spark.range(1), "x"),
                lambda: require_rows(spark.range(0))):
        with pytest.raises(ValueError):
            bad()
    assert first_rows(spark.range(9), [F.desc("id")], 2).count() == 2 and first_rows(spark.range(9), ["id"], 0).count() == 9
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "q string, v int, m1 string")
    new = spark.createDataFrame([("b", 2, "z"), ("c", 2, "w")], "q string, v int, m2 string")
    assert sorted(map(tuple, upsert(old, new, ["q"], "v").collect()), key=str) == [
        ("a", 1, "x", None), ("b", 2, "y", "z"), ("c", 2, None, "w")]


def test_positional_id(spark):
    df = spark.createDataFrame([(i, None if i % 2 else f"own{i}") for i in range(200)], "at int, id string").repartition(5)
    assert {r["at"]: r["id"] for r in with_positional_id(df, "id", ["at"]).collect()} == {
        i: f"index_{i}" if i % 2 else f"own{i}" for i in range(200)}


def test_predicates(spark):
    stated = stated_predicates("a<=5, b contains x, c~contains 'y', a>=2, none, d='z'")
    assert stated == {"a": (">=", "2"), "b": ("contains", "x"), "c": ("~contains", "y"), "d": ("=", "z")}
    with pytest.raises(ValueError):
        stated_predicates("a=b=c")
    df = spark.createDataFrame([(2, "ax", "b", "z"), (1, "ax", "b", "z"), (3, "x", "yy", "z")], "a int, b string, c string, d string")
    assert [r["a"] for r in df.where(predicate(stated)).collect()] == [2]
    cities = spark.createDataFrame([("A",)], "c string")
    assert [r["message"] for r in not_member(spark.createDataFrame([("A",), ("B",)], "x string"), "x", cities, "c").collect()] == [
        "B is not valid"]


def test_predictions(spark):
    assert prediction_column("prompt_5shot", "Some-Model-2.0") == "pred_5shot_some_model_2.0"
    def responder(text):
        if text == "bad":
            raise RuntimeError("no")
        return {"blank": "  ", "none": None}.get(text, " " + text + "! ")
    df = spark.createDataFrame([("bad",), ("blank",), ("none",), ("hi",), ("",), (None,)], "p string").coalesce(1)
    assert [r["pred_1.0"] for r in with_predictions(df, "p", responder, "pred_1.0").collect()] == [
        "ERROR: no", *["ERROR: Received empty or blocked response (Reason: empty)"] * 2, "hi!", *["ERROR: Prompt key missing or empty"] * 2]
    assert with_retries(df, "p", responder, "o", 2).where("o LIKE 'ERROR%'").count() == 5


def test_scores(spark):
    df = spark.createDataFrame([("x", "y"), ("Mon, 9:00 - 9:30", "Mon, 9:00 - 9:30"), ("Mon, 9:00 - 9:30", "x")], "p string, g string")
    assert tuple(solve_rate(df, "p", "g").first()) == (3, 2, round(2 / 3, 6))
    assert solve_rate(df.limit(0), "p", "g").first()["solve_rate"] is None
    sizes = spark.createDataFrame([("1", True), ("1", False), (" 3 ", True), ("3.0", True), ("12", True), ("x", True)], "n string, ok boolean")
    rows = [tuple(r) for r in accuracy_by_size(sizes, "n", "ok", 3).collect()]
    assert rows == [(1, 2, 1, 0.5), (2, 0, 0, None), (3, 1, 1, 1.0)]
    assert [r["accuracy"] for r in accuracy_by_size(sizes, "n", "ok", 3, 100).collect()] == [0.01, 0.0, 0.01]


def test_pairs(spark):
    df = spark.createDataFrame([("a", 1, 5, "p1"), ("a", 2, 5, "p2"), ("a", 3, 1, "p3"), ("b", 4, 2, "p4")], "q string, id int, s int, plan string")
    row, = best_and_worst(df, ["q"], F.col("plan"), F.col("s"), F.col("id")).collect()
    assert (row["chosen"]["plan"], row["rejected"]["plan"]) == ("p1", "p3")
    turns = [("c", t, role, f"t{t}") for t, role in enumerate(["system", "user", "assistant", "assistant", "user", "user", "assistant"] * 20)]
    df = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string")
    expected = sorted((turns[i][1], turns[i - 1][3], turns[i][3]) for i in range(1, len(turns))
                      if turns[i][2] == "assistant" and turns[i - 1][2] == "user")
    for max_rows in (1_000_000, 20):
        assert sorted(tuple(r)[1:] for r in turn_pairs(df, max_rows=max_rows).collect()) == expected


def _halt_loop(actions):
    """First step at which each rule holds: repeats, retries, budget of 40 steps."""
    run, failures, first = [], {}, {}
    for step, (act, ok) in enumerate(actions, 1):
        tool = act.split("[")[0] if "[" in act else "?"
        run = run + [act] if run and run[-1] == act else [act]
        if len(run) >= 3:
            first.setdefault("repeat", step)
        if act and tool != "Planner" and failures.get(tool, 0) >= 3:
            first.setdefault("retry", step)
        if step > 40:
            first.setdefault("budget", step)
        failures = {} if ok else failures | {tool: failures.get(tool, 0) + 1}
    return first


def _trajectories(spark):
    import random
    rng = random.Random(4)
    names = ["FlightSearch[a]", "CitySearch[b]", "Planner[q]", "look", "", "NotebookWrite[n]"]
    runs = {q: [(rng.choice(names), rng.random() < 0.3) for _ in range(rng.randint(1, 60) if q else 500)] for q in range(25)}
    # an unknown name and an empty action share the counter of everything that is no tool
    rows = [(q, i, act, ok) for q, run in runs.items() for i, (act, ok) in enumerate(run)]
    return runs, spark.createDataFrame(rows, "q int, at int, action string, success boolean")


@pytest.mark.parametrize("max_rows", [1_000_000, 50])
def test_halts(spark, max_rows):
    runs, df = _trajectories(spark)
    seq = numbered(df, ["q"], ["at"], max_rows)
    assert seq.sliced == (max_rows == 50)
    def found(marked, flag):
        return {r["q"]: r["halt_step"] for r in halts(marked, flag).collect() if r["halt_step"] is not None}
    for name, marked in (("repeat", repeats(seq, "action")), ("retry", retries(seq, "action", "success")),
                         ("budget", budgets(seq, F.lit(1), 40, 10 ** 6))):
        assert found(marked, name + "_halt") == {q: _halt_loop(run)[name] for q, run in runs.items() if name in _halt_loop(run)}


@pytest.mark.parametrize("idle", [None, 10_000_000])
def test_guard_continues_over_batches(spark, tmp_path, idle):
    """Each run goes on from the states of the last one; rows within a run come in any order."""
    runs, df = _trajectories(spark)
    df = df.withColumn("time", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("at"))).repartition(3)
    for part in range(4):
        df.where(f"floor(at / 7) % 4 = {part} AND at < 28").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        stream = stream if idle is None else stream.withWatermark("time", "1 hour")
        run_guard(live_halts(stream, ["q"], ["time", "at"], F.lit(1), max_steps=20, idle=idle), str(tmp_path))
    found = spark.read.parquet(f"{tmp_path}/halts").collect()
    got = {r["q"]: r["halt_step"] for r in found}
    assert len(got) == len(found)
    for q, run in runs.items():
        first = _halt_loop(run[:28])
        steps = [first[n] for n in ("repeat", "retry") if n in first] + ([21] if len(run[:28]) > 20 else [])
        assert got.get(q) == (min(steps) if steps else None)


def test_ledger_asks_only_what_is_open(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def answer(text, attempt):
        asked.add(1)
        if text == "never" or text == "later" and attempt < 3:
            raise ValueError(f"no {attempt}")
        return f"{text} {attempt}"
    rows = spark.createDataFrame([(1, "now"), (2, "later"), (3, "never"), (4, None), (5, ""), (None, "now")], "k int, p string")
    path = str(tmp_path / "ledger")
    first = {r["k"]: (r["a"], r["attempts"]) for r in with_ledger(rows, "k", "p", answer, "a", path, 2).collect()}
    assert first[2] == ("ERROR: no 2", 2) and first[1] == first[None] == ("now 1", 1) and first[4][1] == first[5][1] == 0
    assert asked.value == 6
    again = {r["k"]: (r["a"], r["attempts"]) for r in with_ledger(rows, "k", "p", answer, "a", path, 4).collect()}
    assert again[2] == ("later 3", 3) and again[3] == ("ERROR: no 4", 4) and again[1] == ("now 1", 1)
    assert asked.value == 6 + 3 and spark.read.parquet(path).count() == 9


def test_transitions_and_verdicts(spark):
    rows = spark.createDataFrame([("x", True, True), ("x", True, False), ("y", False, True), ("y", None, True), (None, False, None)], "g string, a boolean, b boolean")
    found = {(r["g"], r["stayed_wrong"]): tuple(r)[1:] for r in transitions(rows, F.col("a"), F.col("b"), ["g"]).collect()}
    assert found == {("x", 0): (1, 1, 0, 0, None, 0.5), ("y", 0): (0, 0, 2, 0, 1.0, None), (None, 1): (1, 1, 2, 1, 0.666667, 0.5)} or len(found) == 3
    assert tuple(transitions(rows, F.col("a"), F.col("b")).collect()[0]) == (1, 1, 2, 1, 0.666667, 0.5)
    good = ("[['A', '9:00AM'], ['p', 'A', '9:00AM to 9:20AM', 10]]", "{'A': {'B': 5}}", "['You start']")
    cases = {"accepted": good, "constraints_null": (None, *good[1:]), "constraints_empty": ("[]", *good[1:]), "constraints_unreadable": ("[['A'", *good[1:]),
             "no_people": ("[['A', '9:00AM']]", *good[1:]), "dist_matrix_null": (good[0], None, good[2]), "dist_matrix_empty": (good[0], " {} ", good[2]),
             "dist_matrix_unreadable": (good[0], "[5]", good[2]), "golden_plan_null": (*good[:2], None), "golden_plan_empty": (*good[:2], ""),
             "golden_plan_unreadable": (*good[:2], "5")}
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()], "k string, constraints string, dist_matrix string, golden_plan string")
    assert {r["k"]: r["verdict"] for r in with_verdict(df).collect()} == {k: k for k in cases}


def test_sliced_queries(spark):
    """The registered trajectories give the same halts when every user is spread over slices."""
    few, many = (halts(repeats(recorded.trajectories(spark, DATA, rows), "action"), "repeat_halt") for rows in (1_000_000, 20))
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
    assert total(1).inclusive


def test_records_are_read_and_replayed_once(spark, monkeypatch):
    """No filter on decoded columns: it would decode and replay every record a second time."""
    from planloom.plans import records
    rows = spark.createDataFrame([(1, "1", "[]", "{}", "5", "x")], f"id bigint, num_people string, constraints string, dist_matrix string, "
                                 f"golden_plan string, {records.PREDICTION} string")
    monkeypatch.setattr(records, "records", lambda spark, sf_dir: rows)
    for name in ("record_failures", "score_records_strict"):
        plan = records.QUERIES[name](spark, "")._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter" not in plan, name
