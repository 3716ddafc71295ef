"""Live guard over a stream of agent actions: who has to be halted, at which step, and why.

Spark keeps one small state per trajectory and hands it to the rule with the trajectory's new rows, so the work of a batch follows its rows,
not the trajectories ever seen. A halted trajectory keeps a mark only. On a stream with a watermark every state goes when nothing has come
for ``idle`` of event time.
A trajectory is halted after ``max_steps`` steps at the latest, so no more than that many of its rows are held, however many a batch has.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from planloom.functions.text import action
from planloom.operators.trajectory import MAX_REPEATS, MAX_RETRIES, MAX_STEPS, MAX_TOKENS, REPEATED, is_guarded, tool_of

_STATE = "steps long, last_action string, run_length long, tokens long, failures string, halted boolean"
OVER_BUDGET, REFUSED = "budget exceeded", "early stop after retries"


class Watch:
    """The rules over one trajectory, step by step."""

    def __init__(self, limits: tuple[int, int, int, int], state: tuple | None = None):
        self.max_repeats, self.max_retries, self.max_steps, self.max_tokens = limits
        self.steps, self.last, self.run, self.tokens, failures, self.halted = state or (0, None, 0, 0, "{}", False)
        self.failures: dict[str, int] = json.loads(failures)

    def state(self) -> tuple:
        if self.halted:
            return self.steps, None, 0, 0, "{}", True
        return self.steps, self.last, self.run, self.tokens, json.dumps(self.failures), False

    def step(self, act: str | None, tool: str, limited: bool, size: int, success: bool | None) -> str | None:
        """Why the trajectory stops before this step, if it does."""
        self.steps += 1
        self.run = self.run + 1 if self.steps > 1 and act == self.last else 1
        reason = (OVER_BUDGET if self.steps > self.max_steps or self.tokens > self.max_tokens else REPEATED if self.run >= self.max_repeats
                  else REFUSED if limited and self.failures.get(tool, 0) >= self.max_retries else None)
        self.last, self.tokens, self.halted = act, self.tokens + size, reason is not None
        if success:
            self.failures = {}
        elif success is not None:
            self.failures[tool] = self.failures.get(tool, 0) + 1
        return reason


def live_halts(stream: DataFrame, keys: Sequence[str], order: Sequence[str], tokens: Column, max_repeats: int = MAX_REPEATS,
               max_retries: int = MAX_RETRIES, max_steps: int = MAX_STEPS, max_tokens: int = MAX_TOKENS, idle: int | None = None) -> DataFrame:
    """``keys``, ``halt_step`` and ``reason`` of each trajectory, once it has to be halted.

    Rows have ``action`` and ``success``. What arrives of a trajectory in one batch is taken in ``order``; from batch to batch it must
    arrive in order. With ``idle`` (milliseconds) the first column of ``order`` is the event time, with a watermark. Null keys are a trajectory; a null action is an empty one, a null success neither; rows of equal order may come in any.
    """
    limits = (max_repeats, max_retries, max_steps, max_tokens)
    names = [f"_o{i}" for i in range(len(order))]
    known = stream.select(*keys, *[F.col(c).alias(n) for c, n in zip(order, names)], F.col("action").alias("_act"),
                          tool_of(action(F.col("action"))["type"]).alias("_tool"), F.coalesce(is_guarded(F.col("action")), F.lit(False)).alias("_limited"),
                          F.coalesce(tokens.cast("long"), F.lit(0)).alias("_size"), F.col("success").cast("int").alias("_success"),
                          (F.lit(0) if idle is None else F.unix_millis(F.col(order[0]))).alias("_ms"))

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = Watch(limits, state.get if state.exists else None)
        latest = 0

        def rows() -> Iterator[tuple]:
            nonlocal latest
            for batch in batches:
                latest = max(latest, int(batch["_ms"].max()))
                if not seen.halted:
                    yield from zip(zip(*(batch[n] for n in names)), *(batch[c] for c in ("_act", "_tool", "_limited", "_size", "_success")))
        first = heapq.nsmallest(max(1, max_steps + 1 - seen.steps), rows(), key=lambda r: r[0])
        for _, act, tool, limited, size, success in first:
            reason = seen.step(act, tool, bool(limited), int(size), None if pd.isna(success) else bool(success))
            if reason is not None:
                yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "halt_step": [seen.steps], "reason": [reason]})
                break
        state.update(seen.state())
        if idle is not None:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle)

    out = T.StructType([*[T.StructField(k, stream.schema[k].dataType) for k in keys], T.StructField("halt_step", T.LongType()),
                        T.StructField("reason", T.StringType())])
    # a timeout of processing time would keep a run over what is there from ending
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout
    return known.groupBy(*keys).applyInPandasWithState(watch, out, _STATE, "append", timeout)


def run_guard(halts: DataFrame, root: str) -> None:
    """Take all that has come since the last run; halts go to ``root/halts``, offsets and states to ``root/offsets``, from which a run continues."""
    (halts.writeStream.format("parquet").option("path", f"{root}/halts").option("checkpointLocation", f"{root}/offsets")
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
