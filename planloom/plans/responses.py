"""Texts that models and judges return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from planloom.functions.clock import clock_minutes, clock_text
from planloom.functions.text import judged, normal_answer, plan_response, same_answer, truncate_scratchpad, drop_observations, mask
from planloom.operators.score import listed_budget
from planloom.operators.trajectory import row_text
from planloom.plans.tables import table


def k_number() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def structured_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as judgements: fenced, bare, in prose, or with a score of another type."""
    k = k_number().cast("string")
    body = F.concat(F.lit('{"issues": ["late", {"k": '), k, F.lit('}], "overall_accuracy_score": '),
                    F.when(F.col("event_id") % 5 == 0, '"high"').otherwise(k), F.lit(', "relevance_score": null}'))
    text = (F.when(F.col("event_type") == "click", F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone.")))
            .when(F.col("event_type") == "view", F.concat(F.lit("  "), body, F.lit("\n")))
            .when(F.col("event_type") == "signup", F.concat(body, F.lit(" "), body))
            .otherwise(F.concat(F.lit("The result is "), body)))
    found = table(spark, sf_dir, "events").select("event_id", judged(text).alias("j"))
    return found.select("event_id", F.size("j.issues").alias("issues"), F.get("j.issues", F.lit(1)).alias("second_issue"),
                        "j.overall_accuracy_score", "j.target_audience_score", "j.relevance_score")


def plan_json_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (F.when(F.col("event_type") == "error", F.concat(F.lit("Sorry: "), F.col("props")))
            .when(F.col("event_type") == "signup", F.concat(F.col("props"), F.lit(" is the plan"))).otherwise(F.col("props")))
    found = table(spark, sf_dir, "events").select("event_id", plan_response(text).alias("r"))
    return found.select("event_id", "r.status", "r.message", F.get_json_object("r.plan", "$.k").alias("k"))


def listed_plan_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans in one JSON text against a budget; every fifth is no list, some costs are no numbers."""
    k = k_number().cast("string")
    step = lambda n, cost: F.concat(F.lit(f'{{"step": {n}, "parameters": {{"cost": '), cost, F.lit("}}"))
    plan = F.concat(F.lit("["), step(1, k), F.lit(", "), step(2, F.lit('"free"')), F.lit(", "),
                    step(3, F.concat(F.lit('"'), k, F.lit('.5"'))), F.lit(', {"step": 4}]'))
    text = F.when(F.col("event_id") % 5 == 0, step(1, k)).otherwise(plan)
    return table(spark, sf_dir, "events").groupBy(
        "event_type", listed_budget(text, F.lit(100.0)).alias("within")).agg(F.count("*").alias("plans"))


def answer_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a copy in capitals with extra articles and punctuation; every seventh differs."""
    copy = F.concat(F.lit("THE "), F.col("text"), F.lit(" !? a\n"), F.when(F.col("doc_id") % 7 == 0, "usd 5").otherwise("USD"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", same_answer(copy, F.col("text")).alias("equal"))
    return docs.groupBy("lang", "equal").agg(F.count("*").alias("docs"))


def normal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", normal_answer(F.col("text")).alias("normal"))


def clock_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times to clock text and back."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    shown = table(spark, sf_dir, "events").select("event_id", clock_text(minute).alias("clock"))
    return shown.withColumn("minute", clock_minutes(F.concat(F.lit(" "), F.lower("clock"), F.lit("\n"))))


def _scratchpad():
    """A document's lines as a scratchpad: every second line is an observation."""
    return F.array_join(F.transform(F.split("text", "\n"), lambda line, at: F.when(at % 2 == 0, line).otherwise(
        F.concat(F.lit("Observation "), at.cast("string"), F.lit(": "), line))), "\n")


def scratchpad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", truncate_scratchpad(_scratchpad(), 100).alias("pad"))
    return docs.select("doc_id", F.md5("pad").alias("pad_md5"), F.length("pad").alias("chars"))


def drop_observation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", drop_observations(_scratchpad(), 1).alias("pad"))
    return docs.select("doc_id", F.md5("pad").alias("pad_md5"), F.length("pad").alias("chars"))


def observation_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third line of each document is the stale output."""
    stale = F.get(F.split("text", "\n"), F.lit(2))
    docs = table(spark, sf_dir, "documents").select("doc_id", mask(F.col("text"), stale).alias("masked"))
    return docs.select("doc_id", F.md5("masked").alias("masked_md5"))


def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents as lines of text; documents without labels show ``None``."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", row_text("lang", "quality", "toxic").alias("line"))


QUERIES = {
    "structured_extract": structured_extract,
    "plan_json_status": plan_json_status,
    "listed_plan_budget": listed_plan_budget,
    "answer_exact_match": answer_exact_match,
    "normal_text": normal_text,
    "clock_roundtrip": clock_roundtrip,
    "scratchpad_truncate": scratchpad_truncate,
    "drop_observation_lines": drop_observation_lines,
    "observation_mask": observation_mask,
    "table_text": table_text,
}

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def _normal(text: str) -> str:
    bare = f"regexp_replace(lower({text}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    listed = f"list_filter(regexp_split_to_array({bare}, '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the', 'usd'))"
    return f"array_to_string({listed}, ' ')"


_LINES = """lines AS (SELECT doc_id, pos, CASE WHEN pos % 2 = 0 THEN line ELSE 'Observation ' || pos || ': ' || line END AS line
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
          generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))"""
_WORDS = "len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> ''))"

SQL = {
    "structured_extract": f"""WITH e AS (SELECT event_id, {_K} AS k, event_type IN ('click', 'view') AND event_id % 5 <> 0 AS ok
        FROM events) SELECT event_id, CASE WHEN ok THEN 2 ELSE 0 END AS issues,
        CASE WHEN ok THEN '{{"k":' || k || '}}' END AS second_issue, CASE WHEN ok THEN CAST(k AS BIGINT) END AS overall_accuracy_score,
        CAST(NULL AS BIGINT) AS target_audience_score, CAST(NULL AS BIGINT) AS relevance_score FROM e""",
    "plan_json_status": """SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN 'error' ELSE 'success' END AS status,
        CASE event_type WHEN 'error' THEN 'Sorry: ' || props WHEN 'signup' THEN props || ' is the plan' END AS message,
        CASE WHEN event_type NOT IN ('error', 'signup') THEN json_extract_string(props, '$.k') END AS k FROM events""",
    "listed_plan_budget": f"""SELECT event_type, event_id % 5 <> 0 AND {_K} + ({_K} + 0.5) <= 100.0 AS within,
        count(*) AS plans FROM events GROUP BY 1, 2""",
    "answer_exact_match": f"""WITH d AS (SELECT lang, {_normal("text")} AS a, {_normal(
        "'THE ' || text || ' !? a' || chr(10) || CASE WHEN doc_id % 7 = 0 THEN 'usd 5' ELSE 'USD' END")} AS b FROM documents)
        SELECT lang, a = b AS equal, count(*) AS docs FROM d GROUP BY 1, 2""",
    "normal_text": f"SELECT item_id, {_normal('text')} AS normal FROM benchmark",
    "clock_roundtrip": """SELECT event_id, strftime(ts, '%-I:%M%p') AS clock,
        CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute FROM events""",
    "scratchpad_truncate": f"""WITH {_LINES}, sized AS (SELECT *, {_WORDS} AS size,
        starts_with(line, 'Observation') AS observed,
        split_part(line, ':', 1) || ': [truncated wikipedia excerpt]' AS short FROM lines),
        ranked AS (SELECT *, sum(size) OVER (PARTITION BY doc_id) AS whole,
          len(string_split(short, ' ')) AS short_size,
          sum(CASE WHEN observed THEN size - len(string_split(short, ' ')) ELSE 0 END) OVER (PARTITION BY doc_id
            ORDER BY observed DESC, size DESC, pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS saved FROM sized),
        flagged AS (SELECT *, observed AND whole - coalesce(saved, 0) > 100 AS wanted FROM ranked),
        cut AS (SELECT *, bool_and(wanted) OVER (PARTITION BY doc_id ORDER BY observed DESC, size DESC, pos DESC) AS cut FROM flagged),
        pads AS (SELECT doc_id, string_agg(CASE WHEN cut THEN short ELSE line END, chr(10) ORDER BY pos) AS pad FROM cut GROUP BY 1)
        SELECT doc_id, md5(pad) AS pad_md5, CAST(length(pad) AS INTEGER) AS chars FROM pads""",
    "drop_observation_lines": f"""WITH {_LINES}, pads AS (SELECT doc_id, string_agg(CASE WHEN starts_with(line, 'Observation 1')
        THEN '' ELSE line END, chr(10) ORDER BY pos) AS pad FROM lines GROUP BY 1)
        SELECT doc_id, md5(pad) AS pad_md5, CAST(length(pad) AS INTEGER) AS chars FROM pads""",
    "observation_mask": """WITH d AS (SELECT doc_id, text, trim(string_split(text, chr(10))[3]) AS stale FROM documents)
        SELECT doc_id, md5(CASE WHEN stale IS NULL OR stale = '' THEN text ELSE replace(text, stale,
        'Masked due to limited length. Make sure the data has been written in Notebook.') END) AS masked_md5 FROM d""",
    "table_text": """SELECT d.doc_id, lang || ' ' || coalesce(CAST(quality AS VARCHAR), 'None') || ' '
        || coalesce(CAST(toxic AS VARCHAR), 'None') AS line FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}
