"""Text columns: answers, actions, observations, structured responses."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

from planloom.functions.clock import BLANK, strip
from planloom.functions.let import let
from planloom.functions.whole import whole_json

# Words that answer matching ignores.
IGNORED_WORDS = ("a", "an", "the", "usd")
# Action and date shapes, and notices put in place of observations.
ACTION = r"^([\p{L}\p{N}_]+)\[(.+)\]$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
MASKED = "Masked due to limited length. Make sure the data has been written in Notebook."
TRUNCATED = ": [truncated wikipedia excerpt]"
FENCED = r"(?s)```json\s*(\{.*?\})\s*```"


def normal_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no ignored words, single blanks."""
    text = F.translate(F.lower(F.coalesce(text, F.lit("None"))), string.punctuation, "")
    edge = r"[\p{L}\p{N}_]"
    text = F.regexp_replace(text, rf"(?<!{edge})({'|'.join(IGNORED_WORDS)})(?!{edge})", " ")
    return strip(F.regexp_replace(text, f"{BLANK}+", " "))


def same_answer(answer: Column, key: Column) -> Column:
    return normal_answer(answer) == normal_answer(key)


def action(text: Column) -> Column:
    """``Tool[argument]`` as a struct of type and argument; nulls if it is not of that shape."""
    part = lambda i: F.when(text.rlike(ACTION), F.regexp_extract(text, ACTION, i))
    return F.struct(part(1).alias("type"), part(2).alias("arg"))


def is_date(text: Column) -> Column:
    """Digits and dashes of a date; the values are not checked."""
    return text.rlike(DATE)


def clean_step(text: Column) -> Column:
    """Blanks at the ends and line breaks removed."""
    return F.translate(strip(text), "\n", "")


def drop_observations(text: Column, number: int) -> Column:
    """Blank every line that starts with ``Observation {number}``; the line break stays."""
    return F.regexp_replace(text, rf"(?m)(?-u)^Observation {number}[^\n]*", "")


def mask(text: Column, observation: Column, notice: str = MASKED) -> Column:
    """Replace an earlier tool output within a text by a notice."""
    stale = strip(observation)
    return F.when(stale.isNull() | (stale == ""), text).otherwise(F.replace(text, stale, F.lit(notice)))


def word_count(text: Column) -> Column:
    """Blank-separated words: the default token count of every budget here."""
    words = strip(text)
    return F.when(words == "", 0).otherwise(F.size(F.split(words, f"{BLANK}+")))


def is_observation(line: Column) -> Column:
    return F.startswith(line, F.lit("Observation"))


def short_line(line: Column) -> Column:
    """An observation line as a notice, which keeps its text up to its first colon."""
    return F.concat(F.substring_index(line, ":", 1), F.lit(TRUNCATED))


def truncate_scratchpad(text: Column, limit: int, tokens=word_count) -> Column:
    """Replace the largest ``Observation`` lines by a notice until at most ``limit`` tokens are left.

    ``tokens`` counts a line; the text counts as the sum of its lines. Of equal lines the last one goes first.
    """
    def size_at(x: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["at"].alias("at"))

    def cut(lines: Column) -> Column:
        """Largest and last first; gives (size, at) of the last line that must go."""
        ranked = F.reverse(F.array_sort(F.transform(F.filter(lines, lambda x: x["observed"]), lambda x: F.struct(
            size_at(x).alias("place"), (x["size"] - tokens(short_line(x["line"]))).alias("saved")))))
        start = F.struct(F.aggregate(lines, F.lit(0), lambda s, x: s + x["size"]).alias("left"),
                         F.lit(None).cast("struct<size:int,at:int>").alias("until"))
        return F.aggregate(ranked, start, lambda s, x: F.when(s["left"] <= limit, s).otherwise(F.struct(
            (s["left"] - x["saved"]).alias("left"), x["place"].alias("until"))))["until"]

    def shortened(bound: Column) -> Column:
        return F.array_join(F.transform(bound["lines"], lambda x: F.when(
            x["observed"] & (size_at(x) >= bound["until"]), short_line(x["line"])).otherwise(x["line"])), "\n")

    lines = F.transform(F.split(text, "\n"), lambda line, at: F.struct(
        at.alias("at"), line.alias("line"), tokens(line).alias("size"),
        is_observation(line).alias("observed")))
    return let(lines, lambda found: let(F.struct(found.alias("lines"), cut(found).alias("until")), shortened))


def _response_json(text: Column) -> Column:
    """The first fenced object, else a text that is one in braces."""
    def chosen(found: Column) -> Column:
        body = strip(text)
        whole = F.when(F.startswith(body, F.lit("{")) & F.endswith(body, F.lit("}")), body)
        return F.when(found != "", found).otherwise(whole)
    # a fence is rare, and looking for three characters is cheaper than the pattern; a match is never empty
    return let(F.when(F.contains(text, F.lit("```json")), F.regexp_extract(text, FENCED, 1)).otherwise(""), chosen)


def _score(value: Column) -> Column:
    """(fits, number) of a score: whole numbers, truth values and nothing are acceptable."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    number = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint")).otherwise(
        F.try_variant_get(value, "$", "bigint"))
    return let(kind, lambda k: F.struct(k.isin("BIGINT", "BOOLEAN", "VOID").alias("fits"), number.alias("number")))


# The fields of a judged response.
SCORES = ("overall_accuracy_score", "target_audience_score", "relevance_score")


def judged(text: Column) -> Column:
    """Issues and scores of a judge's response; the empty default if it holds no such object."""
    def found(data: Column) -> Column:
        issues = F.try_variant_get(data, "$.issues", "variant")
        return F.struct(F.startswith(F.schema_of_variant(issues), F.lit("ARRAY")).alias("listed"), issues.alias("issues"),
                        *[_score(F.try_variant_get(data, f"$.{name}", "variant")).alias(name) for name in SCORES])

    def checked(x: Column) -> Column:
        valid = F.coalesce(x["listed"], F.lit(False))
        for name in SCORES:
            valid = valid & x[name]["fits"]
        return let(valid, lambda ok: F.struct(
            F.when(ok, F.transform(F.try_variant_get(x["issues"], "$", "array<variant>"), lambda i: F.to_json(i))).otherwise(
                F.array().cast("array<string>")).alias("issues"),
            *[F.when(ok, x[name]["number"]).alias(name) for name in SCORES], ok.alias("accepted")))
    # each value is bound once: a column that is referred to again is evaluated again
    return let(let(let(_response_json(text), whole_json), found), checked)


def plan_response(text: Column) -> Column:
    """A response as plan JSON with a status; a text that is no JSON gives an error with its message."""
    plan = whole_json(text)
    return F.struct(
        F.when(plan.isNotNull(), F.to_json(plan)).alias("plan"),
        F.when(plan.isNotNull(), "success").otherwise("error").alias("status"),
        F.when(plan.isNull(), text).alias("message"))
