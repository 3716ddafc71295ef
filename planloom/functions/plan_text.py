"""Plan texts as arrays of typed steps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from planloom.functions.clock import clock_minutes, strip

# Markers and sentence openings of plan texts.
SOLUTION = "SOLUTION:"
ERROR = "ERROR:"
START, TRAVEL, WAIT, MEET, UNKNOWN = "start", "travel", "wait", "meet", "unknown"
OPENING = {START: "You start", TRAVEL: "You travel", WAIT: "You wait", MEET: "You meet"}


def _sentences(text: Column) -> Column:
    # an escaped character is split at without compiling a pattern per row
    return F.filter(F.transform(F.split(text, r"\."), strip), lambda s: s != "")


def text_steps(text: Column, drop_errors: bool = True) -> Column:
    """Sentences of a plan text, after its first ``SOLUTION:`` mark.

    A null text gives no steps; so does an ``ERROR:`` answer, unless ``drop_errors`` is off.
    """
    mark = F.instr(text, SOLUTION)
    body = F.when(mark > 0, F.substring(text, mark + len(SOLUTION), F.length(text))).otherwise(text)
    none = text.isNull()
    if drop_errors:
        none = none | F.startswith(strip(text), F.lit(ERROR))
    return F.when(none, F.array().cast("array<string>")).otherwise(_sentences(body))


def golden_steps(listed: Column, text: Column, keep_blank: bool) -> Column:
    """Steps of a reference plan: ``listed`` if it was a list, else the sentences of ``text``.

    With ``keep_blank`` (scoring) blank items stay and stop the replay, and a text is read like an answer;
    without (row generation) blank items go, a text also splits at line ends, and no step at all gives null.
    """
    if keep_blank:
        return F.coalesce(listed, F.when(text.isNotNull(), text_steps(text)))
    steps = F.coalesce(F.filter(listed, lambda s: strip(s) != ""), _sentences(F.translate(text, "\n", ".")))
    return F.when(listed.isNotNull() | (F.size(steps) > 0), steps)


def _after(text: Column, mark: str) -> Column:
    """The text between the first and the second ``mark``; null if there is no mark.

    ``substring_index`` searches bytes; ``split`` and ``split_part`` would compile a pattern per row.
    """
    at = F.instr(text, mark)
    rest = F.substring(text, at + len(mark), F.length(text))
    return F.when(at > 0, F.substring_index(rest, mark, 1))


def _upto(text: Column, mark: str) -> Column:
    return strip(F.substring_index(text, mark, 1))


def step(sentence: Column, strict: bool = False) -> Column:
    """One sentence as a struct of kind, destination, wait target, person and a malformed flag.

    The openings exclude each other, and each kind has a branch of its own: within an array function nothing is shared.
    """
    def typed(kind: str, mark: str | None = None, **found: Column) -> Column:
        at = lambda name, kind: found.get(name, F.lit(None)).cast(kind).alias(name)
        malformed = F.lit(False) if mark is None else F.instr(sentence, mark) == 0
        return F.struct(F.lit(kind).alias("kind"), at("dest", "string"), at("wait_min", "int"), at("person", "string"),
                        malformed.alias("malformed"))
    def opens(kind: str) -> Column:
        return F.startswith(sentence, F.lit(OPENING[kind]))
    to, until, met = "travel to " if strict else " travel to ", "wait until ", "meet "
    return (F.when(opens(START), typed(START))
            .when(opens(TRAVEL), typed(TRAVEL, to, dest=_upto(_after(sentence, to), " in")))
            .when(opens(WAIT), typed(WAIT, until, wait_min=clock_minutes(_upto(_after(sentence, until), "."))))
            .when(opens(MEET), typed(MEET, met, person=_upto(_after(sentence, met), " for")))
            .otherwise(typed(UNKNOWN)))


def typed_steps(sentences: Column, strict: bool = False) -> Column:
    """An array of sentences as an array of step structs."""
    return F.transform(sentences, lambda s: step(s, strict))
