"""Training and inference texts."""

from __future__ import annotations

import string as _string
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# Tags and fixed sentences of the training formats.
END = "</s>"
USER_OPEN = "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n"
ASSISTANT_OPEN = "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"
TURN_END = "<|eot_id|>"
REQUEST = " Generate a detailed plan for the following request: "
REASONING = ("Given the following meeting planning problem, please provide a detailed step-by-step reasoning "
             "process and the final plan to satisfy the constraints. Think carefully about travel times, "
             "meeting durations, and availability windows.")
MISSING_PROMPT = "ERROR: Prompt key missing or empty"


def render(template: str, values: Mapping[str, Column]) -> Column:
    """Fill ``{name}`` places of a template; ``{{`` and ``}}`` are literal braces, a null counts as empty."""
    pieces: list[Column] = []
    for literal, name, _, _ in _string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            pieces.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def instruction(prompt: Column, completion: Column, end: str = END) -> Column:
    text = F.concat(F.lit("### Instruction:\n"), prompt, F.lit("\n\n### Response:\n"), completion)
    return F.when(F.endswith(text, F.lit(end)), text).otherwise(F.concat(text, F.lit(end)))


def open_chat(prompt: Column) -> Column:
    """A user turn with the assistant's turn left open, for inference."""
    return F.concat(F.lit(USER_OPEN), prompt, F.lit(ASSISTANT_OPEN))


def chat(prompt: Column, completion: Column) -> Column:
    return F.concat(open_chat(prompt), completion, F.lit(TURN_END))


def tagged(request: Column, plan: Column) -> Column:
    return F.concat(F.lit("<s>" + REQUEST), request, F.lit(" "), plan, F.lit(" " + END))


def preference(request: Column, chosen: Column, rejected: Column) -> Column:
    """A struct of prompt, chosen and rejected text."""
    return F.struct(F.concat(F.lit(REQUEST), request).alias("prompt"),
                    F.concat(chosen, F.lit(" " + END)).alias("chosen"),
                    F.concat(rejected, F.lit(" " + END)).alias("rejected"))


def reasoning_request(problem_text: Column) -> Column:
    return F.concat(F.lit(REASONING + "\n\nProblem:\n"), problem_text, F.lit("\n\nReasoning and Plan:"))


def nested_request(request: Column, state: Column, constraints: Column) -> Column:
    """A request with its state and constraints as JSON text."""
    return F.concat(F.lit('User Request: "'), request, F.lit('"\n\nCurrent State:\n'), F.to_json(state),
                    F.lit("\n\nConstraints:\n"), F.to_json(constraints))
