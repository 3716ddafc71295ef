"""Text columns, rule by rule."""

import pytest
from pyspark.sql import functions as F

from planloom.functions import clock, plan_text, templates, text
from planloom.functions.literals import with_literals
from planloom.functions.problem import complete, constraint_block, distance_block, distances, problem
from planloom.functions.whole import is_whole_json, json_opens, whole_json
from planloom.operators.records import decoded, next_step_rows, scored
from planloom.operators.selection import cut, cut_pair, pack, words


def values(spark, column, rows, schema="t string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.coalesce(1).select(column.alias("x")).collect()]


def test_clock(spark):
    texts = ["9:05AM", " 12:00pm\n", "12:30AM", "1:5PM", "0:10AM", "13:00PM", "9:60AM", "9:15 AM", "noon", None, "09:00am\xa0"]
    assert values(spark, clock.clock_minutes(F.col("t")), texts) == [545, 720, 30, 785, None, None, None, None, None, None, 540]
    assert values(spark, clock.clock_text(F.col("t")), [0, 545, 720, 1439, 1500, None], "t int") == [
        "12:00AM", "9:05AM", "12:00PM", "11:59PM", "1:00AM", "Invalid Time"]
    spans = values(spark, clock.range_minutes(F.col("t")), ["9:00AM to 1:30PM", "9:00AM", "9:00AM to 1:00PM to 2:00PM", "9 to 5"])
    assert spans[0] == (540, 810) and spans[1:] == [None, None, None]


def test_slot(spark):
    texts = ["SOLUTION: Here is: Monday, 14:30 - 15:00 \n", "Monday, 9:15 - 10:45 or Friday, 9:00 - 9:30", "none", "Monday 9:00 - 9:30"]
    assert values(spark, clock.slot(F.col("t")), texts) == [
        ("Monday", 14.5, 15.0), ("Monday", 9.0, 10.0), ("", -1.0, -1.0), ("", -1.0, -1.0)]


def test_plan_steps(spark):
    texts = ["Sure. SOLUTION: You start at A.  You wait until 9:00AM. \n", "no mark. here", " ERROR: x. y", None, "SOLUTION:"]
    assert values(spark, plan_text.text_steps(F.col("t")), texts) == [
        ["You start at A", "You wait until 9:00AM"], ["no mark", "here"], [], [], []]
    steps = values(spark, plan_text.step(F.col("t")), [
        "You travel to Marina in Bay in 5 minutes", "You wait until 9:00AM", "You meet Bob for 5 minutes and meet Al", "You traveled",
        "You wait", "You fly", "You start at A", "You wait until late"])
    assert [tuple(s) for s in steps] == [
        ("travel", "Marina", None, None, False), ("wait", None, 540, None, False), ("meet", None, None, "Bob", False),
        ("travel", None, None, None, True), ("wait", None, None, None, True), ("unknown", None, None, None, False),
        ("start", None, None, None, False), ("wait", None, None, None, False)]


def test_golden_steps(spark):
    rows = [(["a.", " ", "b"], "x"), (None, "a.\nb. "), (None, " . "), ([], "x"), (None, None)]
    both = "l array<string>, t string"
    assert values(spark, plan_text.golden_steps(F.col("l"), F.col("t"), False), rows, both) == [["a.", "b"], ["a", "b"], None, [], None]
    assert values(spark, plan_text.golden_steps(F.col("l"), F.col("t"), True), rows, both) == [["a.", " ", "b"], ["a", "b"], [], [], None]


def test_literals(spark):
    texts = ["['a', ('b', 1)]", "{'a': {'b': 3}}", "[('x')]", "[None, True, 'None']", '["O\'B", "x"]', "hello", "{1: 2}", "[null]",
             "['a\\n']", "['a' 'b']", "[1, 2", "()", "'(x)'"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    import ast, json
    def expected(t):
        try:
            return json.loads(json.dumps(ast.literal_eval(t)))
        except (ValueError, SyntaxError):
            return "not a literal"
    got = [r["j"] for r in with_literals(df, {"j": F.col("t")}).collect()]
    assert [json.loads(g) if g is not None else "not a literal" for g in got] == [expected(t) for t in texts]
    assert with_literals(df, {"j": F.col("t")}, limit=3).where("j IS NOT NULL").count() == 1


CONSTRAINTS = ('[["M", "9:00AM"], ["S", "Mi", "10:30AM to 1:30PM", 120], ["T", "U", "9:00AM to 10:00AM", "30"], '
               '["T", "V", "9:00AM to 11:00AM", 31.7], ["bad"], ["X", "U", "9:00AM - 10:00AM", 5], ["Y", "U", "9:00AM to 9:30AM", "5.5"]]')


def test_problem(spark):
    found, = values(spark, problem(F.col("t")), [CONSTRAINTS])
    assert found["start_location"] == "M" and found["start_min"] == 540
    assert [tuple(p) for p in found["people"]] == [("S", "Mi", 630, 810, 120), ("T", "V", 540, 660, 31)]
    broken = ['[["M", "9:00"]]', '[["M"], ["S", "Mi", "10:30AM to 1:30PM", 120]]', '{"a": 1}', "x", None, '[["M", "9:00AM"]]']
    assert values(spark, problem(F.col("t")), broken) == [None] * 6
    assert values(spark, problem(F.col("t"), False), broken)[-1]["people"] == []
    assert values(spark, constraint_block(problem(F.col("t"))), [CONSTRAINTS, "x"]) == [
        "Start: M at 9:00AM\nConstraints:\n- S: At Mi from 10:30AM to 1:30PM, for 120 minutes.\n"
        "- T: At V from 9:00AM to 11:00AM, for 31 minutes.", "No constraints available."]
    assert values(spark, distance_block(distances(F.col("t"))), ['{"B": {"A": 1}, "A": {"B": 2, "C": 3}}', "{}", "[1]"]) == [
        "Distances (minutes):\n- B to A: 1\n- A to B: 2\n- A to C: 3", "No distance information available.",
        "No distance information available."]
    assert values(spark, complete(F.col("t")), ["[1]", "[]", "{ }", "", None]) == [True, False, False, False, False]


RECORD = ("[['Pier', '9:00AM'], ['Ann', 'Hill', '10:30AM to 1:30PM', 120]]", "{'Pier': {'Hill': 20}, 'Hill': {'Pier': 19}}",
          "['You start at Pier at 9:00AM.', 'You travel to Hill in 20 minutes and arrive at 9:20AM.', 'You wait until 10:30AM.', "
          "'You meet Ann for 120 minutes from 10:30AM to 12:30PM.']")


def test_next_step_rows(spark):
    plans = [("ok", *RECORD), ("stops", RECORD[0], RECORD[1], "You start at Pier. You swim. You wait until 10:30AM."),
             ("empty", "[]", *RECORD[1:]), ("unread", "x", *RECORD[1:])]
    df = spark.createDataFrame(plans, "id string, constraints string, dist_matrix string, golden_plan string")
    rows = {(r["id"], r["pos"]): r for r in next_step_rows(df, "id").collect()}
    assert sorted(rows) == [("ok", 1), ("ok", 2), ("ok", 3), ("ok", 4), ("stops", 1), ("stops", 2)]
    assert rows["ok", 3]["completion"] == "You wait until 10:30AM."
    assert rows["ok", 3]["prompt"] == (
        "Start: Pier at 9:00AM\nConstraints:\n- Ann: At Hill from 10:30AM to 1:30PM, for 120 minutes.\n\n"
        "Distances (minutes):\n- Pier to Hill: 20\n- Hill to Pier: 19\n\nCurrent State:\nLocation: Hill\nTime: 9:20AM\n\n"
        "Plan History:\n- You start at Pier at 9:00AM.\n- You travel to Hill in 20 minutes and arrive at 9:20AM.\n\n"
        "What is the next single step in the plan?")
    assert "Plan History:\n (None)\n" in rows["stops", 1]["prompt"]


def test_scored(spark):
    plans = [("same", "1", *RECORD, "SOLUTION: You travel to Hill in 20 minutes. You wait until 10:30AM. You meet Ann for 120 minutes."),
             ("early", "1", *RECORD, "You travel to Hill in 20 minutes. You meet Ann for 120 minutes."),
             ("error", "1", *RECORD, "ERROR: quota"), ("null", "1", *RECORD, None), ("many", "11", *RECORD, "x"), ("size", "n", *RECORD, "x")]
    df = spark.createDataFrame(plans, "id string, num_people string, constraints string, dist_matrix string, golden_plan string, p string")
    got = {r["id"]: r for r in scored(df, "p", largest=10).collect()}
    assert scored(df, "p").where("id = 'many'").first()["usable"]
    assert {k: (r["usable"], r["golden_score"], r["pred_score"], r["correct"]) for k, r in got.items()} == {
        "same": (True, 1, 1, True), "early": (True, 1, 0, False), "error": (True, 1, 0, False), "null": (True, 1, 0, False),
        "many": (False, None, None, False), "size": (False, None, None, False)}
    assert got["early"]["state"]["reasons"] == ["too_early"]


def test_answers(spark):
    assert values(spark, text.normal_answer(F.col("t")), ["The  cost: a l’a USD, Café!", None, "an_a the"]) == [
        "cost l’ café", "none", "ana"]
    assert values(spark, text.action(F.col("t")), ["Foo[bar]", "Fé[a]b]", "Foo", "Foo[]", "Foo[a\nb]"]) == [
        ("Foo", "bar"), ("Fé", "a]b"), (None, None), (None, None), (None, None)]
    assert values(spark, text.is_date(F.col("t")), ["2022-99-99", "2022-1-1", "x2022-01-01"]) == [True, False, False]


def test_judged(spark):
    texts = ['x ```json\n{"issues": ["a", {"b":1}], "overall_accuracy_score": 6}\n``` y', '{"issues": [], "overall_accuracy_score": "no"}',
             "nah", ' {"issues": [], "relevance_score": true}\n', '{"issues": {}, "relevance_score": 1}', '{"issues": [], "relevance_score": 1.5}']
    got = values(spark, text.judged(F.col("t")), texts)
    assert [tuple(g) for g in got] == [
        (['"a"', '{"b":1}'], 6, None, None, True), ([], None, None, None, False), ([], None, None, None, False),
        ([], None, None, 1, True), ([], None, None, None, False), ([], None, None, None, False)]


def test_observations(spark):
    pad = "Thought 1: a b\nObservation 1: a b c d e f g h i\nObservation 12: x y\nAction b"
    assert values(spark, text.drop_observations(F.col("t"), 1), [pad]) == ["Thought 1: a b\n\n\nAction b"]
    assert values(spark, text.mask(F.col("t"), F.lit(" x y\n"), "-"), [pad, None]) == [pad.replace("x y", "-"), None]
    cuts = [values(spark, text.truncate_scratchpad(F.col("t"), n), [pad])[0] for n in (40, 19, 3)]
    short = pad.replace(" a b c d e f g h i", " [truncated wikipedia excerpt]")
    assert cuts == [pad, short, short.replace(" x y", " [truncated wikipedia excerpt]")]


def test_templates(spark):
    rendered = templates.render("{{x}} {a}-{b}{a}", {"a": F.col("t"), "b": F.lit(1)})
    assert values(spark, rendered, ["q", None]) == ["{x} q-1q", "{x} -1"]
    assert values(spark, templates.instruction(F.col("t"), F.lit("c</s>")), ["p"]) == ["### Instruction:\np\n\n### Response:\nc</s>"]
    with pytest.raises(KeyError):
        templates.render("{missing}", {})


def test_packing(spark):
    rows = [(d, " ".join(f"{d}.{i}" for i in range(n))) for d, n in enumerate((5, 0, 3, 17, 1, 4))]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("shard", F.lit(0))
    stream = [w for _, t in rows for w in t.split()]
    for max_rows in (1_000_000, 2):
        got = sorted(pack(df, "shard", ["id"], words(F.col("t")), 7, max_rows).collect(), key=lambda r: r["seq"])
        assert [r["text"].split() for r in got] == [stream[i:i + 7] for i in range(0, len(stream), 7)]
    assert values(spark, cut(F.col("t"), 2), [" a  b c", ""]) == ["a b", ""]
    prompt, completion = cut_pair(F.col("t"), F.lit("x y z"), 2, 4)
    assert values(spark, F.concat_ws("|", prompt, completion), ["a b c", "a"]) == ["a b|x y", "a|x y z"]


def test_a_step_is_looked_at_once(spark):
    from planloom.functions.plan_text import step
    rows = spark.createDataFrame([("You travel to A in 5 minutes",), ("You travel home",), ("You wait until 9:05AM.",), ("You wait",),
                                  ("You meet Bo for 5 minutes",), ("You start at A",), ("You fly",), (None,)], "t string").select(step(F.col("t")).alias("s"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StartsWith") + plan.count("startswith") == 4
    assert [tuple(r["s"]) for r in rows.collect()] == [
        ("travel", "A", None, None, False), ("travel", None, None, None, True), ("wait", None, 545, None, False),
        ("wait", None, None, None, True), ("meet", None, None, "Bo", False), ("start", None, None, None, False),
        ("unknown", None, None, None, False), ("unknown", None, None, None, False)]


def test_literals_without_special_words_are_rewritten_alike(spark):
    import ast
    import json
    from planloom.functions.literals import with_literals
    texts = ["['a', 1, {'b': 2.5}]", '["a\'s", 1]', "fal'x'e", "['None', 'true']", "[None, True]", "('a', 'b')", "('a')", "[true]", "['a\\n']",
             "['a'], ['b']", "{'a': 1}, 'b'", "", "5", "'x'", "['(a)']", "[1,\n2]"]
    rows = with_literals(spark.createDataFrame([(t,) for t in texts], "t string"), {"j": F.col("t")}).collect()
    def read(text):
        try:
            return ast.literal_eval(text)
        except (ValueError, SyntaxError):
            return None
    as_json = lambda v: json.loads(json.dumps(v))
    for r in rows:
        assert (None if r["j"] is None else json.loads(r["j"])) == as_json(read(r["t"])), r["t"]


ODD_JSON = ["1", "", " ", "1,2", "1],[2", "1}, {", "[1] [2]", '"a", "b', '"a"', " [1, 2] ", "\n{\"a\": 1}", '{"a": 1, "a": 2}', "[1", "1,", ",1", "null", "[null]", "1, null",
            '"abc', "]", "}", '{"a": [1, {"b": "]}"}]}', "\t'x'", "01", "NaN", '1 "', '1,"', '{"a": 1} x', "\u00a0[1]", "[]", "{}", '""', None]


def test_whole_json_by_one_parse(spark):
    df = spark.createDataFrame([(t,) for t in ODD_JSON], "t string")
    rows = df.select("t", is_whole_json(F.col("t")).alias("one"), whole_json(F.col("t")).isNotNull().alias("two")).collect()
    assert [r["t"] for r in rows if r["one"] != r["two"]] == [] and sum(r["one"] for r in rows) == 10


def test_kinds_of_json_without_its_schema(spark):
    kind = F.coalesce(F.schema_of_variant(F.try_parse_json("t")), F.lit(""))
    df = spark.createDataFrame([(t,) for t in ODD_JSON], "t string")
    for mark, name in (("[", "ARRAY"), ("{", "OBJECT"), ('"', "STRING")):
        rows = df.select("t", json_opens(F.col("t"), mark).alias("is"), F.startswith(kind, F.lit(name)).alias("was")).collect()
        assert [r["t"] for r in rows if r["is"] != r["was"]] == [] and any(r["is"] for r in rows)


def test_a_literal_is_parsed_once_to_check_it(spark):
    """And what it holds is not described to learn its kind; words that only look special change nothing."""
    df = spark.createDataFrame([(i, t, t, t) for i, t in enumerate(["['true grue', 1]", "[('a', 'halse')]", "[True, 'rue']", "{'a': {'b': 5}}"])],
                               "id int, constraints string, dist_matrix string, golden_plan string")
    once = with_literals(df, {"json": F.col("constraints")})
    assert [r["json"] for r in once.orderBy("id").collect()] == ['["true grue", 1]', '[["a", "halse"]]', '[true, "rue"]', '{"a": {"b": 5}}']
    assert once._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    kinds = decoded(df).select("matrix", "golden_list", "golden_text")
    assert kinds._jdf.queryExecution().optimizedPlan().toString().count("schemaOfVariant") == 0
