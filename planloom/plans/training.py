"""Training rows from conversations and labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from planloom.functions.templates import (chat, instruction, nested_request, open_chat, preference, reasoning_request,
                                          render, tagged)
from planloom.operators.selection import best_and_worst, cut_pair, held_out, pack, turn_pairs, words
from planloom.plans.tables import table

SHARD_DOCS = 64
PACK_TOKENS = 512
TEMPLATE = "Given information: {text}\nQuery: {query}{scratchpad} {{done}}"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(table(spark, sf_dir, "conversations"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"),
                                        F.md5("completion").alias("completion_md5"))


def _formatted(text):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        row = _pairs(spark, sf_dir).select("conv_id", "turn", text(F.col("prompt"), F.col("completion")).alias("text"))
        return row.select("conv_id", "turn", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))
    return run


def _ended(prompt, completion):
    """Some completions already carry the end mark."""
    return instruction(prompt, F.when(F.col("conv_id") % 2 == 0, F.concat(completion, F.lit("</s>"))).otherwise(completion))


def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"text": F.col("text"), "query": F.col("role"), "scratchpad": F.when(F.col("turn") > 0, F.col("turn"))}
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", render(TEMPLATE, values).alias("rendered"), reasoning_request(F.col("text")).alias("request"),
        nested_request(F.col("role"), F.struct("conv_id", "turn"), F.struct("role")).alias("nested"))
    return rows.select("conv_id", "turn", F.md5("rendered").alias("rendered_md5"), F.md5("request").alias("request_md5"),
                       F.md5("nested").alias("nested_md5"))


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and worst labelled document per language and source."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = docs.join(labels, "doc_id").withColumn("score", F.col("quality") * 2 - F.col("toxic"))
    ends = best_and_worst(scored, ["lang", "source"], F.col("text"), F.col("score"), F.col("doc_id"))
    row = preference(F.concat_ws(" ", "lang", "source"), F.col("chosen.plan"), F.col("rejected.plan"))
    return ends.select("lang", "source", F.col("chosen.tie").alias("chosen_id"), F.col("rejected.tie").alias("rejected_id"),
                       row.alias("row")).select("lang", "source", "chosen_id", "rejected_id", "row.prompt",
                                                F.md5("row.chosen").alias("chosen_md5"), F.md5("row.rejected").alias("rejected_md5"))


def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed per shard of neighbouring ids; the number of shards grows with the data."""
    docs = table(spark, sf_dir, "documents").withColumn("shard", F.floor(F.col("doc_id") / SHARD_DOCS))
    packed = pack(docs, "shard", ["doc_id"], words(F.col("text")), PACK_TOKENS)
    return packed.select("shard", "seq", "tokens", "rows", F.md5("text").alias("text_md5"))


def truncate_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    prompt, completion = cut_pair(F.col("prompt"), F.col("completion"), 16, 48)
    return rows.select("conv_id", "turn", prompt.alias("prompt"), completion.alias("completion"))


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 10, integer=True))
    return docs.groupBy("lang", "held_out").agg(F.count("*").alias("docs"), F.sum("doc_id").alias("id_sum"))


QUERIES = {
    "turn_pairs": pairs,
    "chat_format": _formatted(chat),
    "inference_format": _formatted(lambda prompt, completion: open_chat(prompt)),
    "instruction_format": _formatted(_ended),
    "tagged_format": _formatted(tagged),
    "template_render": template_render,
    "preference_pairs": preference_pairs,
    "pack_sequences": pack_sequences,
    "truncate_lengths": truncate_lengths,
    "holdout_split": holdout_split,
}

_PAIRS = """WITH turns AS (SELECT *, lag(role) OVER w AS before_role, lag(text) OVER w AS prompt FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  pairs AS (SELECT conv_id, turn, prompt, text AS completion FROM turns WHERE role = 'assistant' AND before_role = 'user')"""


def _text(expression: str) -> str:
    expression = expression.replace("\n", "' || chr(10) || '")
    return f"""{_PAIRS}, texts AS (SELECT conv_id, turn, {expression} AS text FROM pairs)
        SELECT conv_id, turn, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS chars FROM texts"""


_USER = "'<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n' || prompt || " \
        "'<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n'"
_ASK = ("Given the following meeting planning problem, please provide a detailed step-by-step reasoning process and the "
        "final plan to satisfy the constraints. Think carefully about travel times, meeting durations, and "
        "availability windows.")
_SPLIT = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"

SQL = {
    "turn_pairs": f"{_PAIRS} SELECT conv_id, turn, md5(prompt) AS prompt_md5, md5(completion) AS completion_md5 FROM pairs",
    "chat_format": _text(_USER + " || completion || '<|eot_id|>'"),
    "inference_format": _text(_USER),
    "instruction_format": _text("'### Instruction:\n' || prompt || '\n\n### Response:\n' || completion || '</s>'"),
    "tagged_format": _text("'<s> Generate a detailed plan for the following request: ' || prompt || ' ' || completion || ' </s>'"),
    "template_render": f"""SELECT conv_id, turn,
        md5('Given information: ' || text || chr(10) || 'Query: ' || role || CASE WHEN turn > 0 THEN CAST(turn AS VARCHAR)
          ELSE '' END || ' {{done}}') AS rendered_md5,
        md5('{_ASK}' || chr(10) || chr(10) || 'Problem:' || chr(10) || text || chr(10) || chr(10) || 'Reasoning and Plan:') AS request_md5,
        md5('User Request: "' || role || '"' || chr(10) || chr(10) || 'Current State:' || chr(10) || '{{"conv_id":' || conv_id
          || ',"turn":' || turn || '}}' || chr(10) || chr(10) || 'Constraints:' || chr(10) || '{{"role":"' || role || '"}}')
          AS nested_md5 FROM conversations""",
    "preference_pairs": """WITH scored AS (SELECT d.*, quality * 2 - toxic AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY score DESC, doc_id) AS best,
          row_number() OVER (PARTITION BY lang, source ORDER BY score, doc_id) AS worst FROM scored)
        SELECT c.lang, c.source, c.doc_id AS chosen_id, r.doc_id AS rejected_id,
          ' Generate a detailed plan for the following request: ' || c.lang || ' ' || c.source AS prompt,
          md5(c.text || ' </s>') AS chosen_md5, md5(r.text || ' </s>') AS rejected_md5
        FROM ranked c JOIN ranked r ON c.lang = r.lang AND c.source = r.source AND c.best = 1 AND r.worst = 1 AND c.score > r.score""",
    "pack_sequences": f"""WITH d AS (SELECT doc_id // {SHARD_DOCS} AS shard, doc_id,
          {_SPLIT.format("text")} AS toks FROM documents),
        placed AS (SELECT *, coalesce(sum(len(toks)) OVER (PARTITION BY shard ORDER BY doc_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d WHERE len(toks) > 0),
        tokens AS (SELECT shard, doc_id, unnest(toks) AS tok, start + generate_subscripts(toks, 1) - 1 AS at_pos FROM placed)
        SELECT shard, CAST(at_pos // {PACK_TOKENS} AS BIGINT) AS seq, CAST(count(*) AS INTEGER) AS tokens,
          count(DISTINCT doc_id) AS rows, md5(string_agg(tok, ' ' ORDER BY at_pos)) AS text_md5 FROM tokens GROUP BY 1, 2""",
    "truncate_lengths": f"""{_PAIRS}, split AS (SELECT conv_id, turn, {_SPLIT.format("prompt")}[1:16] AS p,
          {_SPLIT.format("completion")} AS c FROM pairs)
        SELECT conv_id, turn, array_to_string(p, ' ') AS prompt, array_to_string(c[1:48 - len(p)], ' ') AS completion FROM split""",
    "holdout_split": """SELECT lang, doc_id % 10 = 0 AS held_out, count(*) AS docs, CAST(sum(doc_id) AS BIGINT) AS id_sum
        FROM documents GROUP BY 1, 2""",
}
