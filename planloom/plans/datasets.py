"""Loading, saving and answering records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from planloom.functions.text import judged
from planloom.operators.predict import is_error, map_rows, prediction_column, two_stages, with_ledger, with_predictions, with_retries
from planloom.plans.tables import table
from planloom.session import scratch_path
from planloom.sources.files import (INPUT_ORDER, first_rows, profile, read_jsonl, read_preferences, read_split, require_columns, require_rows,
                                    upsert_in_place, with_input_order, write_dataset, write_jsonl)
from planloom.sources.ids import with_positional_id
from planloom.sources.keyed_json import json_text, read_keyed_json, write_entries, write_keyed_json


def keyed_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents out to keyed JSON (some without id, some ids repeated) and back."""
    docs = table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 10 != 3, F.concat(F.lit("doc_"), (F.col("doc_id") - F.col("doc_id") % 10 % 2).cast("string"))
               ).alias("id"), "doc_id", "lang", "text")
    path = scratch_path(spark, "keyed")
    write_keyed_json(docs, path, "id", order="doc_id")
    back = require_rows(read_keyed_json(spark, path, layout="lines"))
    return back.select("id", F.col("record")["doc_id"].cast("bigint").alias("doc_id"),
                       F.col("record")["lang"].alias("lang"), F.md5(F.col("record")["text"]).alias("text_md5"))


def keyed_json_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as indented keyed JSON, read by ranges of bytes: some values are no objects, some records have an id of their own, or a null one."""
    field = lambda name, value: F.concat(F.lit(f'    "{name}": '), value)
    number = F.col("doc_id").cast("string")
    own = F.when(F.col("doc_id") % 4 == 0, field("id", F.concat(F.lit('"own_'), number, F.lit('"')))).when(
        F.col("doc_id") % 4 == 1, field("id", F.lit("null")))
    record = F.concat(F.lit("{\n"), F.concat_ws(",\n", own, field("doc_id", number), field("lang", json_text(F.col("lang"))), field(
        "text", json_text(F.col("text")))), F.lit("\n  }"))
    other = F.when(F.col("doc_id") % 20 == 7, '[{"a": "}, {"}]').otherwise(json_text(F.concat(F.lit('{"no": "object", \\'), number, F.lit("\\"))))
    value = F.when(F.col("doc_id") % 10 == 7, other).otherwise(record)
    entries = table(spark, sf_dir, "documents").select(F.concat(F.lit('  "doc_'), number, F.lit('": '), value))
    path = scratch_path(spark, "keyed")
    write_entries(entries, path)
    schema = T.StructType.fromDDL("id string, doc_id bigint, lang string, text string")
    back = read_keyed_json(spark, path, schema, keep_id=True, layout="any", range_bytes=256 << 10)
    return back.select("id", "doc_id", "lang", F.md5("text").alias("text_md5"))


def inferred_schema_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as lines without a schema: a field that the first rows lack, one that is whole or not, one that is a number or a text."""
    k = F.get_json_object("props", "$.k")
    number = F.col("event_id").cast("string")
    weight = F.when((F.col("event_id") >= 100) & (F.col("event_id") % 3 == 0), F.concat(
        F.lit(', "weight": '), number, F.when(F.col("event_id") % 2 == 0, ".5").otherwise("")))
    size = F.concat(F.lit(', "size": '), F.when(F.col("event_id") % 5 == 0, '"large"').otherwise(k))
    lines = table(spark, sf_dir, "events").select("event_id", F.concat(
        F.lit('{"event_id": '), number, F.lit(', "props": '), F.col("props"), F.coalesce(weight, F.lit("")), size, F.lit(', "none": null}')).alias("value"))
    path = scratch_path(spark, "lines")
    lines.repartitionByRange(F.col("event_id")).sortWithinPartitions("event_id").select("value").write.text(path)
    return read_jsonl(spark, path).select("event_id", F.col("props.k").alias("k"), "weight", "size", "none")


def preference_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference rows saved as lines with further columns, read back with the three that training needs."""
    made = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        F.md5("text").alias("prompt"), F.concat(F.lit("Answer: "), F.col("text")).alias("chosen"), F.col("role").alias("rejected"), "conv_id")
    path = scratch_path(spark, "preferences")
    write_jsonl(made, path)
    return read_preferences(read_jsonl(spark, path)).select("prompt", F.md5("chosen").alias("chosen_md5"), "rejected")


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    path = scratch_path(spark, "jsonl")
    write_jsonl(turns, path)
    back = require_columns(read_jsonl(spark, path, turns.schema), "conv_id", "turn", "role", "text")
    return back.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def columnar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents saved by language, one language read back by partition pruning."""
    path = scratch_path(spark, "dataset")
    write_dataset(table(spark, sf_dir, "documents"), path, split="lang")
    return read_split(spark, path, "en", split="lang").groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


def result_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of two models over the same queries, each into the same dataset; the second run updates only some of one set."""
    order = table(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("validation")
    def run(version: int, model: str, rows: DataFrame) -> DataFrame:
        return rows.select(key.alias("set_type"), F.col("o_orderkey").alias("query"), F.lit(version).alias("version"),
                           F.concat(F.lit(f"{model}:{version}:"), F.col("o_orderstatus")).alias(f"{model}_results"))
    path, keys = scratch_path(spark, "results"), ["set_type", "query"]
    for part in (run(1, "m1", order), run(1, "m2", order), run(2, "m1", order.where("o_orderkey % 3 = 0 and o_orderkey % 5 <> 0"))):
        upsert_in_place(part, path, keys, "version", "set_type")
    return spark.read.parquet(path).select(*keys, "version", "m1_results", "m2_results")


def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 records examined; those without enough text are dropped afterwards."""
    return first_rows(table(spark, sf_dir, "documents"), ["doc_id"], 50).where("n_chars >= 500").select("doc_id", "n_chars")


def positional_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("id"),
        "ts", "event_id")
    return with_positional_id(event, "id", ["ts", "event_id"]).select("event_id", "id")


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as several files of lines, in the order of their ids, read with the order of the input."""
    event = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("id"), "event_id", "event_type")
    path = scratch_path(spark, "lines")
    write_jsonl(event.repartitionByRange(3, F.col("event_id")).sortWithinPartitions("event_id"), path)
    return with_input_order(read_jsonl(spark, path, event.schema))


def input_order_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing ids by the number of the line over all files."""
    return with_positional_id(_event_lines(spark, sf_dir), "id", INPUT_ORDER).select("event_id", "id")


def first_examined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 lines examined; those of other kinds are dropped afterwards."""
    return first_rows(_event_lines(spark, sf_dir), INPUT_ORDER, 500).where("event_type = 'click'").select("event_id", "id")


def predict_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A responder that recovers: some prompts fail at first, some never succeed; a second run asks only what is still open."""
    def unsteady(text: str, attempt: int) -> str:
        kind = len(text) % 5
        if kind == 0 or kind == 1 and attempt < 2 or kind == 2 and attempt < 4:
            raise ValueError(f"try {attempt}")
        return f"answer {attempt}"
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), F.when(F.col("turn") != 2, F.translate("text", "\n", " ")).alias("prompt"))
    path = scratch_path(spark, "ledger")
    with_ledger(turns, "turn_id", "prompt", unsteady, "answer", path, attempts=2)
    return with_ledger(turns, "turn_id", "prompt", unsteady, "answer", path, attempts=4).select("turn_id", "answer", "attempts")


def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(table(spark, sf_dir, "conversations"), ["conv_id", "turn"]).select(
        "rows", "columns", "types", F.get_json_object("first_record", "$.role").alias("first_role"))


def local_responder():
    """A local stand-in for a responder: refuses long prompts, has no answer to some."""
    def answer(text: str) -> str:
        if len(text) > 400:
            raise ValueError("too long")
        return "" if text.startswith("E") else "answer to " + text[:20]
    return answer


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") != 2, F.translate("text", "\n", " ")).alias("prompt_5shot"))


ANSWER = prediction_column("prompt_5shot", "Local-1.0")


def predict_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = with_predictions(_prompts(spark, sf_dir), "prompt_5shot", local_responder(), ANSWER)
    return answered.select("conv_id", "turn", F.col(f"`{ANSWER}`").alias("answer"))


def predict_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = with_retries(_prompts(spark, sf_dir), "prompt_5shot", local_responder(), ANSWER, attempts=2)
    return answered.groupBy(is_error(F.col(f"`{ANSWER}`")).alias("failed")).agg(F.count("*").alias("rows"))


def two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = two_stages(_prompts(spark, sf_dir), "prompt_5shot",
                      lambda t: t[:10], lambda t: f"plan for {t}")
    return done.select("conv_id", "turn", "information_and_constraints", "step_by_step_plan")


def mapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row function in Python that adds two fields; a nullable number that no double holds stays as it is."""
    big = F.when(F.col("turn") % 2 == 0, F.lit(9007199254740993) + F.col("conv_id"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", big.alias("big"))
    vowels = lambda r: {"label": f"{r['role']}#{r['turn']}", "vowels": sum(c in "aeiou" for c in r["text"])}
    done = map_rows(turns, vowels, "label string, vowels int", needed=["role", "turn", "text"])
    return done.select("conv_id", "turn", "big", "label", "vowels")


def judged_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged responses saved as JSON lines and read back."""
    score = F.when(F.col("event_type") == "view", F.get_json_object("props", "$.k")).otherwise('"?"')
    text = F.concat(F.lit('{"issues": ["'), F.col("event_type"), F.lit('"], "relevance_score": '), score, F.lit("}"))
    found = table(spark, sf_dir, "events").select("event_id", judged(text).alias("j")).select("event_id", "j.*")
    path = scratch_path(spark, "judged")
    write_jsonl(found, path)
    back = read_jsonl(spark, path, found.schema)
    return back.select("event_id", "relevance_score", "accepted", F.size("issues").alias("issues"))


QUERIES = {
    "map_rows": mapped_rows,
    "judged_saved": judged_saved,
    "keyed_json_roundtrip": keyed_json_roundtrip,
    "keyed_json_any": keyed_json_any,
    "inferred_schema": inferred_schema_scan,
    "preference_scan": preference_scan,
    "jsonl_roundtrip": jsonl_roundtrip,
    "columnar_roundtrip": columnar_roundtrip,
    "result_upsert": result_upsert,
    "first_n": first_n,
    "positional_id": positional_id,
    "dataset_profile": dataset_profile,
    "predict_append": predict_append,
    "predict_retry": predict_retry,
    "input_order_id": input_order_id,
    "first_examined": first_examined,
    "predict_ledger": predict_ledger,
    "two_stage": two_stage,
}

_PROMPTS = """WITH prompts AS (SELECT conv_id, turn, CASE WHEN turn <> 2 THEN replace(text, chr(10), ' ') END AS p
  FROM conversations), answered AS (SELECT conv_id, turn, CASE WHEN p IS NULL OR p = ''
    THEN 'ERROR: Prompt key missing or empty' WHEN length(p) > 400 THEN 'ERROR: too long'
    WHEN starts_with(p, 'E') THEN 'ERROR: Received empty or blocked response (Reason: empty)'
    ELSE trim('answer to ' || substr(p, 1, 20)) END AS answer FROM prompts)"""

SQL = {
    "map_rows": """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 9007199254740993 + conv_id END AS big, role || '#' || turn AS label,
        CAST(length(text) - length(translate(text, 'aeiou', '')) AS INTEGER) AS vowels FROM conversations""",
    "judged_saved": """SELECT event_id, CASE WHEN event_type = 'view' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END
        AS relevance_score, event_type = 'view' AS accepted, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS issues FROM events""",
    "keyed_json_roundtrip": """
        WITH d AS (SELECT CASE WHEN doc_id % 10 <> 3 THEN 'doc_' || (doc_id - doc_id % 10 % 2) END AS id, * FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id DESC) AS n FROM d WHERE id IS NOT NULL)
        SELECT id, doc_id, lang, md5(text) AS text_md5 FROM r WHERE n = 1""",
    "keyed_json_any": """SELECT CASE doc_id % 4 WHEN 0 THEN 'own_' || doc_id WHEN 1 THEN NULL ELSE 'doc_' || doc_id END AS id, doc_id, lang,
        md5(text) AS text_md5 FROM documents WHERE doc_id % 10 <> 7""",
    "inferred_schema": """SELECT event_id, k, CASE WHEN event_id >= 100 AND event_id % 3 = 0 THEN event_id + CASE WHEN event_id % 2 = 0
        THEN 0.5::DOUBLE ELSE 0 END END AS weight, CASE WHEN event_id % 5 = 0 THEN 'large' ELSE k::VARCHAR END AS size, NULL::VARCHAR AS none
        FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "preference_scan": """SELECT md5(text) AS prompt, md5('Answer: ' || text) AS chosen_md5, role AS rejected FROM conversations
        WHERE role = 'assistant'""",
    "jsonl_roundtrip": "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations",
    "columnar_roundtrip": """SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents
        WHERE lang = 'en' GROUP BY source""",
    "result_upsert": """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'validation' END AS set_type,
        o_orderkey AS query, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 2 ELSE 1 END AS version,
        CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 'm1:2:' ELSE 'm1:1:' END || o_orderstatus AS m1_results,
        'm2:1:' || o_orderstatus AS m2_results FROM orders""",
    "first_n": """SELECT doc_id, n_chars FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 50) WHERE n_chars >= 500""",
    "positional_id": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id
        ELSE 'index_' || (row_number() OVER (ORDER BY ts, event_id) - 1) END AS id FROM events""",
    "dataset_profile": """SELECT count(*) AS rows, 'conv_id,turn,role,text' AS columns, 'bigint,bigint,string,string' AS types,
        arg_min(role, conv_id * 1000 + turn) AS first_role FROM conversations""",
    "input_order_id": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id
        ELSE 'index_' || (row_number() OVER (ORDER BY event_id) - 1) END AS id FROM events""",
    "first_examined": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id END AS id
        FROM (SELECT * FROM events ORDER BY event_id LIMIT 500) WHERE event_type = 'click'""",
    "predict_ledger": """WITH p AS (SELECT conv_id * 1000 + turn AS turn_id, CASE WHEN turn <> 2 AND text <> '' THEN length(text) % 5 END AS kind FROM conversations)
        SELECT turn_id, CASE WHEN kind IS NULL THEN 'ERROR: Prompt key missing or empty' WHEN kind = 0 THEN 'ERROR: try 4'
          WHEN kind = 1 THEN 'answer 2' WHEN kind = 2 THEN 'answer 4' ELSE 'answer 1' END AS answer,
        CAST(CASE WHEN kind IS NULL THEN 0 WHEN kind = 0 OR kind = 2 THEN 4 WHEN kind = 1 THEN 2 ELSE 1 END AS INTEGER) AS attempts FROM p""",
    "predict_append": _PROMPTS + " SELECT conv_id, turn, answer FROM answered",
    "predict_retry": _PROMPTS + """ SELECT starts_with(answer, 'ERROR:') AS failed, count(*) AS rows
        FROM answered GROUP BY 1""",
    "two_stage": """SELECT conv_id, turn, trim(substr(replace(text, chr(10), ' '), 1, 10)) AS information_and_constraints,
        'plan for ' || trim(substr(replace(text, chr(10), ' '), 1, 10)) AS step_by_step_plan FROM conversations
        WHERE turn <> 2""",
}
