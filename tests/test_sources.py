"""Readers and writers that find their own borders, types and partitions."""

import json
import random

import pytest
from pyspark.sql import functions as F, types as T

from planloom.functions.text import judged, mask, truncate_scratchpad
from planloom.functions.whole import whole_json
from planloom.operators.ordered import arrange
from planloom.operators.trajectory import masked_pads, truncated_pads
from planloom.sources.files import inferred_schema, read_inferred, upsert, upsert_in_place
from planloom.sources.keyed_json import json_text, read_keyed_json, write_entries
from planloom.sources.keyed_ranges import read_entries

RECORDS = {
    "plain": {"a": 1, "text": 'he said "{" and \\ then }, {"x": 1}, '}, "own": {"id": "mine", "a": 2}, "null": {"id": None, "a": 3},
    "nested": {"a": {"b": [1, {"c": "]}"}], "id": 9}, "text": "\\\\\\\\" * 40}, "list": [1, {"a": 2}], "number": 5, "nothing": None,
    "braces": '{"a": 4}', "spaced": "  {", "": {"a": 5}, 'quo"te\\': {"a": 6, "text": "line\nbreak\té"}, "empty": {}, "yes": True,
    "long": {"a": 7, "text": "\\\"" * 300 + "{" * 50},
}
LAYOUTS = [dict(), dict(indent=2), dict(indent=7), dict(separators=(",", ":")), dict(separators=(" ,\n", " :\t")), dict(ensure_ascii=False)]


def expected(keep):
    return sorted(((r["id"] if keep and "id" in r else k) or "", json.dumps(r.get("a")), r.get("text")) for k, r in RECORDS.items() if isinstance(r, dict))


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1 << 20])
def test_ranges_find_every_record(spark, tmp_path, range_bytes):
    """Any layout, cut anywhere: within texts, escapes, keys and nested objects."""
    schema = T.StructType.fromDDL("id string, a string, text string")
    layouts = LAYOUTS if range_bytes > 1 else LAYOUTS[:2]
    for i, how in enumerate(layouts):
        (tmp_path / f"{i}.json").write_text(" \n" * i + json.dumps(RECORDS, **how) + "\n" * i)
    (tmp_path / "blank.json").write_text(" \n ")
    (tmp_path / "none.json").write_text("{\n}")
    for keep in (False, True):
        rows = read_keyed_json(spark, str(tmp_path), schema, keep_id=keep, layout="any", range_bytes=range_bytes).collect()
        show = lambda v: json.dumps(json.loads(v)) if v is not None else "null"
        assert sorted((r["id"] or "", show(r["a"]), r["text"]) for r in rows) == sorted(expected(keep) * len(layouts))


def test_ranges_of_random_documents(spark, tmp_path):
    rng = random.Random(4)
    pieces = ['"', "\\", "{", "}", ",", ":", "[", "]", "é", "x", "\n"]
    texts = {f"k{i}": {"t": "".join(rng.choices(pieces, k=rng.randrange(40)))} for i in range(300)}
    (tmp_path / "a.json").write_text(json.dumps(texts, indent=1))
    found = read_keyed_json(spark, str(tmp_path), T.StructType.fromDDL("t string"), layout="any", range_bytes=33).collect()
    assert {r["id"]: r["t"] for r in found} == {k: v["t"] for k, v in texts.items()} and len(found) == 300
    offsets = [r["offset"] for r in read_entries(spark, str(tmp_path), 33).collect()]
    assert len(set(offsets)) == 300


@pytest.mark.parametrize("text", ['{"a": {"b": 1}', '{"a": {"b": "1}}', '[{"a": 1}]', '{"a": {"b": 1}}}', '{"a": 1 "b": 2}', '{"a"}'])
def test_ranges_refuse_damaged_files(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="keyed JSON"):
        read_keyed_json(spark, str(tmp_path), layout="any", range_bytes=5).collect()


@pytest.mark.parametrize("layout, how", [("whole", {}), ("whole", dict(indent=2)), ("indented", dict(indent=2))])
def test_texts_that_look_like_objects_are_none(spark, tmp_path, layout, how):
    records = RECORDS if layout == "whole" else {k: v for k, v in RECORDS.items() if isinstance(v, dict) and v}
    (tmp_path / "a.json").write_text(json.dumps(records, **how))
    rows = read_keyed_json(spark, str(tmp_path), layout=layout).collect()
    assert sorted(r["id"] for r in rows) == sorted(k for k, v in records.items() if isinstance(v, dict))


def test_written_entries_are_json(spark, tmp_path):
    """Also of partitions without rows."""
    entries = spark.range(5).repartition(3).where("id < 2").select(F.concat(json_text(F.col("id").cast("string")), F.lit(": "), F.lit('{"a": "é\\n"}')))
    write_entries(entries, str(tmp_path / "out"))
    found = [json.loads(f.read_text()) for f in (tmp_path / "out").glob("part-*")]
    assert sorted(k for f in found for k in f) == ["0", "1"] and {} in found


def test_types_are_merged_over_all_lines(spark, tmp_path):
    lines = [{"a": 1}, {"a": 2.5, "b": None, "we`ird, n: x": 1}, {"b": [1, 2]}, {"b": [0.5], "c": {"d": True}}, {"c": {"d": False, "e": "x"}, "f": "t"},
             {"f": 3, "g": {}}, {"h": [{"i": 1}, {"j": "y"}], "k": 10 ** 25, "l": None}]
    text = "\n".join(json.dumps(x) for x in lines) + "\nnot json\n"
    (tmp_path / "a.json").write_text(text)
    schema = inferred_schema(spark.read.text(str(tmp_path)), "value")
    assert {f.name: f.dataType.simpleString() for f in schema} == {
        "a": "double", "b": "array<double>", "c": "struct<d:boolean,e:string>", "f": "string", "g": "struct<>", "h": "array<struct<i:bigint,j:string>>",
        "k": "double", "l": "string", "we`ird, n: x": "bigint"}
    rows = [r.asDict(True) for r in read_inferred(spark, str(tmp_path)).collect()]
    assert [r["a"] for r in rows] == [1.0, 2.5, None, None, None, None, None, None] and rows[5]["f"] == "3" and rows[4]["f"] == "t"
    assert rows[3]["b"] == [0.5] and rows[6]["h"] == [{"i": 1, "j": None}, {"i": None, "j": "y"}] and set(rows[7].values()) == {None}
    with pytest.raises(ValueError, match="no table"):
        inferred_schema(spark.createDataFrame([("[1]",), ("[2]",)], "v string"), "v")


def test_upsert_in_place_touches_its_partitions_only(spark, tmp_path):
    path = str(tmp_path / "results")
    def put(version, *rows):
        new = spark.createDataFrame([(s, q, version, v) for s, q, v in rows], f"set_type string, query int, version int, m{version % 2}_results string")
        upsert_in_place(new, path, ["set_type", "query"], "version", "set_type")

    def files(part):
        return {(f.name, f.stat().st_mtime_ns) for f in (tmp_path / "results" / f"set_type={part}").glob("*.parquet")}
    put(1, ("test", 1, "a"), ("test", 2, "b"), ("train", 1, "c"), (None, 1, "n"))
    before = files("train")
    put(2, ("test", 2, "B"), ("test", 3, "D"), (None, 1, "N"))
    put(3, ("test", 2, "E"))
    found = {(r["set_type"], r["query"]): (r["version"], r["m1_results"], r["m0_results"]) for r in spark.read.parquet(path).collect()}
    assert found == {("test", 1): (1, "a", None), ("test", 2): (3, "E", "B"), ("test", 3): (2, None, "D"), ("train", 1): (1, "c", None),
                     (None, 1): (2, "n", "N")}
    assert files("train") == before and files("test") != before


# ---- scratchpads of rows

@pytest.mark.parametrize("max_rows", [1_000_000, 8])
def test_pads_of_rows_equal_pads_in_a_row(spark, max_rows):
    rng = random.Random(7)
    rows = []
    for pad in [None, *range(40)]:
        for pos in range(60 if pad == 3 else rng.randrange(1, 14)):
            words = " ".join("w" * rng.randrange(3) for _ in range(rng.randrange(9)))
            rows.append((pad, pos, rng.choice(["Observation", "Observation 1: ", "Thought: ", "Observation 2:x: ", ""]) + words, "clash"))
    df = spark.createDataFrame(rows, "pad int, pos int, line string, _x string")
    for limit in (5, 30):
        cut = truncated_pads(df, ["pad"], "pos", "line", limit, max_rows=max_rows)
        assert cut.count() == len(rows) and cut.columns == ["pad", "pos", "line", "_x", "cut"]
        by_rows = {r["pad"]: r["t"] for r in cut.groupBy("pad").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("t")).collect()}
        whole = df.groupBy("pad").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("t"))
        assert by_rows == {r["pad"]: r["t"] for r in whole.select("pad", truncate_scratchpad(F.col("t"), limit).alias("t")).collect()}


@pytest.mark.parametrize("max_rows", [1_000_000, 9])
def test_pads_lose_the_output_before(spark, max_rows):
    rng = random.Random(3)
    rows, want = [], {}
    for q in [None, *range(12)]:
        last = None
        for step in range(70 if q == 2 else rng.randrange(1, 12)):
            ok, seen = rng.random() < 0.6, rng.choice(["", " \n", None, f" out {rng.randrange(4)} ", "table"])
            pad = f"Observation: {last or ''} and out 1, table"
            stale = (last or "").strip()
            want[q, step] = pad.replace(stale, "Masked due to limited length. Make sure the data has been written in Notebook.") if ok and stale else pad
            rows.append((q, step, pad, seen, ok))
            if ok:
                last = seen or ""
    df = spark.createDataFrame(rows, "q int, step int, pad string, seen string, ok boolean")
    seq = arrange(df, ["q"], ["step"], max_rows=max_rows)
    assert seq.sliced == (max_rows == 9)
    assert {(r["q"], r["step"]): r["masked"] for r in masked_pads(seq, "pad", "seen", "ok").rows().collect()} == want
    assert df.select(mask(F.col("pad"), F.lit(None).cast("string")) == F.col("pad")).distinct().collect()[0][0] is True


def test_judgements_are_read_from_whole_objects(spark):
    texts = ["null", "1", "{}", '{"issues": []}', '{"issues": [null], "relevance_score": true}', 'a ```json\n{"issues": [1]}\n``` b ```json {} ```', "```json {] ```",
             '```json\n{"issues": {}}```', '{"issues": [], "relevance_score": 1.5}', '{"issues": []} {"issues": []}', None, "", '1}{"v":2', "[1,2", '"x"']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", whole_json(F.col("t")).isNotNull().alias("whole"), judged(F.col("t")).alias("j")).orderBy("i").collect()
    assert [r["i"] for r in rows if r["whole"]] == [0, 1, 2, 3, 4, 8, 14]
    assert [r["i"] for r in rows if r["j"]["accepted"]] == [3, 4, 5] and rows[4]["j"]["relevance_score"] == 1 and rows[5]["j"]["issues"] == ["1"]


def test_entries_are_framed_over_many_batches(spark, tmp_path):
    entries = spark.range(2000).select(F.concat(F.lit('"k'), F.col("id").cast("string"), F.lit('": {"v": '), F.col("id").cast("string"), F.lit("}"))).coalesce(1)
    write_entries(entries, str(tmp_path / "entries"))
    text = "".join(r[0] + "\n" for r in spark.read.text(str(tmp_path / "entries")).collect())
    assert json.loads(text) == {f"k{i}": {"v": i} for i in range(2000)}
    empty = spark.createDataFrame([(None,)], "v string")
    with pytest.raises(Exception, match="without a text"):
        write_entries(empty, str(tmp_path / "none"))


def test_upsert_deals_large_datasets_by_key(spark):
    new = spark.range(200).select((F.col("id") % 50).alias("q"), F.col("id").alias("version"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("m"))
    done = upsert(None, new, ["q"], "version", tasks=40)
    assert done._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and done.rdd.getNumPartitions() == 40
    assert {tuple(r) for r in done.collect()} == {tuple(r) for r in upsert(None, new, ["q"], "version").collect()}
