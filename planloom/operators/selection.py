"""Choosing, pairing, splitting, packing and cutting training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from planloom.functions.clock import BLANK, strip
from planloom.operators.ordered import MAX_GROUP_ROWS, arrange, latest, total


def best_and_worst(df: DataFrame, problem: Sequence[str], plan: Column, score: Column, tie: Column) -> DataFrame:
    """Best and worst candidate of each problem, where they differ in score; ties go to the lowest ``tie``.

    Both ends are partial aggregates, so a problem with very many candidates is reduced before the shuffle.
    """
    entry = F.struct(tie.alias("tie"), plan.alias("plan"))
    ends = df.groupBy(*problem).agg(
        F.max_by(entry, F.struct(score, -tie)).alias("chosen"), F.min_by(entry, F.struct(score, tie)).alias("rejected"),
        F.max(score).alias("_best"), F.min(score).alias("_worst"))
    return ends.where("_best > _worst").drop("_best", "_worst")


def turn_pairs(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn",
               max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """(prompt, completion) of each assistant turn that directly follows a user turn."""
    before = F.struct("role", "text")
    seq = arrange(turns, [conversation], [turn], max_rows=max_rows).running(before=latest(before, inclusive=False))
    pairs = seq.rows().where((F.col("role") == "assistant") & (F.col("before.role") == "user"))
    return pairs.select(conversation, turn, F.col("before.text").alias("prompt"), F.col("text").alias("completion"))


def held_out(key: Column, parts: int, integer: bool = False) -> Column:
    """True for about one in ``parts`` rows, always the same ones; ``integer`` keys are used as they are."""
    return F.pmod(key if integer else F.xxhash64(key), F.lit(parts)) == 0


def words(text: Column) -> Column:
    """Blank-separated words, the default tokens of packing and cutting."""
    stripped = strip(text)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, f"{BLANK}+"))


def cut(text: Column, limit: int) -> Column:
    """The first ``limit`` words."""
    return F.array_join(F.slice(words(text), 1, limit), " ")


def cut_pair(prompt: Column, completion: Column, max_prompt: int = 512, max_total: int = 1024) -> tuple[Column, Column]:
    """Prompt of at most ``max_prompt`` words, completion of what is left of ``max_total``."""
    kept = F.slice(words(prompt), 1, max_prompt)
    answer = words(completion)
    room = F.greatest(F.lit(0), F.lit(max_total) - F.size(kept))
    return F.array_join(kept, " "), F.array_join(F.slice(answer, F.lit(1), room), " ")


def pack(df: DataFrame, shard: str, order: Sequence[str], tokens: Column, max_len: int,
         max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Concatenate the token lists of each shard and cut them into sequences of ``max_len``.

    Rows may span sequences. A row is exploded into its pieces, one per sequence that it touches, not into
    tokens; a sequence never gathers more than ``max_len`` tokens. Gives (shard, seq, text, tokens, rows).
    """
    sized = df.select(shard, *order, tokens.alias("_tokens")).withColumn("_n", F.size("_tokens"))
    seq = arrange(sized.where("_n > 0"), [shard], order, measure=df, max_rows=max_rows)
    seq = seq.running(_from=total(F.col("_n"), inclusive=False))
    begin, size = F.col("_from"), F.col("_n").cast("long")
    def piece(at: Column) -> Column:
        first = F.greatest(F.lit(0).cast("long"), at * max_len - begin)
        until = F.least(size, (at + 1) * max_len - begin)
        return F.struct(at.alias("seq"), F.slice("_tokens", (first + 1).cast("int"), (until - first).cast("int")).alias("piece"))
    touched = F.sequence(F.floor(begin / max_len), F.floor((begin + size - 1) / max_len))
    # cut within the row, so that the explode does not copy the whole token list per piece
    parts = seq.rows().select(shard, "_from", F.inline(F.transform(touched, piece)))
    ordered = F.array_sort(F.collect_list(F.struct("_from", "piece")))
    return (parts.groupBy(shard, "seq").agg(ordered.alias("parts"), F.count("*").alias("rows"))
            .select(shard, "seq", F.array_join(F.flatten(F.transform("parts", lambda p: p["piece"])), " ").alias("text"),
                    F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["piece"])).alias("tokens"), "rows"))
