"""Conversation structure repair: the cheapest edits that make the roles of a conversation an optional system turn and user-assistant pairs.

The edits of a conversation are found by depth-first branch and bound with an explicit stack. The bound of a suffix is what its rows
cost at least, by one pass from behind that forgets the audits. A node is (rows done, last role); its dominance table holds the best
prefix so far, as (cost, audit), and a worse one is not followed. The search ends when no open prefix can beat the incumbent, which proves it
cheapest and, among the cheapest, the least audit.

A conversation of at most ``BLOCK_ROWS`` rows is one row of a grouped table. Longer ones are cut into blocks of that many rows
by their running number (in slices, if one conversation is a large part of the table). A block is searched from each last role before it to each
last role after it, and the blocks' tables are composed, so no group grows with the conversation; only its audit does.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from planloom.llm.packing import handed, tidy
from planloom.operators.ordered import arrange, latest, total
from planloom.session import staged

BLOCK_ROWS = 1024
USER, ASSISTANT = "user", "assistant"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
#: What the last role was: none yet, system, user, assistant. ``_END``: the last roles that a conversation may end with.
_NONE, _S, _U, _A = range(4)
_END = (_NONE, _A)
_SOUND = ("su", "ua", "au")
#: Faults of a row; the first that holds counts.
BLANK, DUPLICATE, TRUNCATED, FINE = 1, 2, 3, 0
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_CUT = re.compile(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\Z")
_Row = tuple[str, int]  # a role's initial, and the fault
Found = tuple[int, str] | None


def damaged(rows: DataFrame) -> DataFrame:
    """Damage ``rows`` (conv_id, turn, role, text) by a checksum of id and turn: a row without ``present`` stands for one that was dropped."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    role = F.when(how == 4, F.lit(USER)).otherwise(blank("role"))
    text = F.when(how == 1, F.lit("")).when(how == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    copies = F.when(how == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(how != 0))
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
                       text.alias("text"), F.explode(copies).alias("present"))


def _next_role(last: int) -> int:
    """The role that has to follow, of user and assistant."""
    return _A if last == _U else _U


def _kept(last: int, initial: str) -> int | None:
    """The last role after a row that is kept; None if it may not follow."""
    if initial == "s":
        return _S if last == _NONE else None
    wanted = _next_role(last)
    return wanted if initial == "ua"[wanted - _U] else None


def _edits(last: int, row: _Row) -> Iterator[tuple[str, int, int]]:
    """Edits that use up a row: letter, last role after it, cost."""
    initial, fault = row
    yield DELETE, last, COST[DELETE]
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED_COST if fault == TRUNCATED else 0
    kept = _kept(last, initial)
    if kept is not None:
        yield KEEP, kept, COST[KEEP] + more
    if kept != (wanted := _next_role(last)):
        yield REROLE, wanted, COST[REROLE] + more


def suffix_bounds(rows: Sequence[_Row], goals: Sequence[int] = _END, trailing: bool = True) -> list[list[float]]:
    """For each place and last role, what the rows from there on cost at least; infinite where no goal can be reached."""
    end = [0 if last in goals else math.inf for last in range(4)]
    if trailing:
        end = [min(end[last], COST[INSERT] + end[_next_role(last)]) for last in range(4)]
    bounds: list[list[float]] = [end]
    for row in reversed(rows):
        after = bounds[-1]
        here = [min(cost + after[to] for _, to, cost in _edits(last, row)) for last in range(4)]
        # an insertion before this row; two in a row would only lead back
        bounds.append([min(here[last], COST[INSERT] + here[_next_role(last)]) for last in range(4)])
    return bounds[::-1]


def search(rows: Sequence[_Row], entry: int = _NONE, goals: Sequence[int] = _END, trailing: bool = True) -> Found:
    """The cheapest (cost, audit) from the last role ``entry`` to one of ``goals``, with insertions after the last row if ``trailing``."""
    bounds, n = suffix_bounds(rows, goals, trailing), len(rows)
    best: Found = None
    table: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    stack: list[tuple[int, int, int, str]] = [(0, entry, 0, "")]
    while stack:
        at, last, cost, audit = stack.pop()
        if table[at, last] != (cost, audit):
            continue  # a better prefix came to this node meanwhile
        least = cost + bounds[at][last]
        if best is not None and (least > best[0] or least == best[0] and audit > best[1][:len(audit)]):
            continue
        if at == n and last in goals and (best is None or (cost, audit) < best):
            best = cost, audit
        after = [] if at == n else [(at + 1, to, cost + more, audit + letter) for letter, to, more in _edits(last, rows[at])]
        if at < n or trailing:
            after.append((at, _next_role(last), cost + COST[INSERT], audit + INSERT))
        # the most promising one is looked at first, so it goes on the stack last
        for child in sorted(after, key=lambda c: (c[2] + bounds[c[0]][c[1]], c[3]), reverse=True):
            node, prefix = child[:2], child[2:]
            if bounds[child[0]][child[1]] < math.inf and (node not in table or prefix < table[node]):
                table[node] = prefix
                stack.append(child)
    return best


def applied(audit: str, turns: Sequence[tuple[str, str]], last: int = _NONE) -> list[str]:
    """The repaired turns as ``role:text``, given roles and texts."""
    out, at = [], 0
    for letter in audit:
        wanted = _next_role(last)
        if letter == INSERT:
            out.append((USER if wanted == _U else ASSISTANT) + ":")
            last = wanted
            continue
        role, text = turns[at]
        at += 1
        if letter == KEEP:
            last = _kept(last, role[:1])
            out.append(f"{role}:{text}")
        elif letter == REROLE:
            out.append((USER if wanted == _U else ASSISTANT) + ":" + text)
            last = wanted
    return out


def fault_of(text: str, seen: bool) -> int:
    if not _WORD.search(text):
        return BLANK
    return DUPLICATE if seen else TRUNCATED if _CUT.search(text) else FINE


_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SCHEMA = "conv_id bigint, " + ", ".join(f"{c} bigint" for c in _RESULT) + ", audit string, repaired_sha256 string"
_ARROW = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _RESULT], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def repair(turns: list[tuple[int | None, str, str]]) -> tuple:
    """The result columns of a conversation, given (turn, role, text) in order."""
    seen: set[tuple[str, str]] = set()
    rows: list[_Row] = []
    for _, role, text in turns:
        rows.append((role[:1], fault_of(text, (role, text) in seen)))
        seen.add((role, text))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    faults = [sum(f == kind for _, f in rows) for kind in (BLANK, DUPLICATE, TRUNCATED)]
    illegal = sum(a[0] + b[0] not in _SOUND for a, b in zip(rows, rows[1:]))
    cost, audit = search(rows)
    text = "\n".join(applied(audit, [(role, text) for _, role, text in turns]))
    return gaps, *faults, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def _of_short(rows: DataFrame) -> DataFrame:
    """Conversations of a bounded number of rows: one row each, repaired where it stands."""
    listed = F.collect_list(F.when(F.col("present"), F.struct("turn", "role", "text")))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(listed).alias("turns"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(key, *repair([(t["turn"], t["role"], t["text"]) for t in turns])) for key, turns in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*made) if made else [[]] * len(_ARROW), _ARROW)], schema=_ARROW)
    return handed(grouped).mapInArrow(run, _SCHEMA)


def _same(left: DataFrame, right: DataFrame, name: str) -> Column:
    return left[name].eqNullSafe(right["_" + name])


def _of_long(rows: DataFrame, ids: DataFrame, block_rows: int) -> DataFrame:
    """Conversations of any number of rows, block by block. ``ids`` are theirs, as ``_conv_id``."""
    shown = rows.where("present").withColumn("_row", F.monotonically_increasing_id()).drop("present")
    seq = arrange(shown, ["conv_id"], ["turn", "role", "text", "_row"], measure=shown.select("conv_id"))
    seq = seq.with_columns(initial=F.substring("role", 1, 1)).running(
        step=total(1), _before=latest(F.struct("initial"), inclusive=False)).running(by=["role", "text"], _seen=total(1, inclusive=False))
    fault = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("_seen") > 0, DUPLICATE)
             .when(F.col("text").rlike(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(FINE))
    sound = F.concat(F.col("_before.initial"), F.col("initial")).isin(*_SOUND)
    flagged = staged(seq.rows().select("conv_id", "turn", "role", "text", "initial", "step", F.floor((F.col("step") - 1) / block_rows).alias("block"),
                                       fault.cast("int").alias("fault"), (F.col("_before").isNotNull() & ~sound).alias("illegal")), "flagged")
    count = lambda hit: F.sum(hit.cast("bigint"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum("new"), F.lit(0))
    # distinct turns are counted by a first aggregate per turn
    stats = flagged.groupBy("conv_id", "turn").agg(
        *[count(F.col("fault") == kind).alias(name) for kind, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))],
        count(F.col("illegal")).alias("illegal")).withColumn("new", F.col("turn").isNotNull().cast("int")).groupBy("conv_id").agg(
        gaps.cast("bigint").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    listed = F.array_sort(F.collect_list(F.struct("step", "initial", "fault", "role", "text")))
    blocks = staged(flagged.groupBy("conv_id", "block").agg(listed.alias("rows")), "blocks")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for taken in batch.column(2).to_pylist():
                at = [(r["initial"], r["fault"]) for r in taken]
                found = [search(at, a, [b], trailing=False) for a in range(4) for b in range(4)]
                out.append([None if f is None else {"cost": f[0], "audit": f[1]} for f in found])
            kind = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, kind)], ["conv_id", "block", "ways"])
    light = F.transform("rows", lambda r: F.struct(r["initial"].alias("initial"), r["fault"].alias("fault")))
    ways = blocks.select("conv_id", "block", light.alias("rows")).mapInArrow(
        tables, "conv_id bigint, block bigint, ways array<struct<cost: bigint, audit: string>>")
    ways = ways.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "ways"))).alias("blocks"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for key, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cost, pieces = composed([[None if w is None else (w["cost"], w["audit"]) for w in p["ways"]] for p in parts])
                made += [(key, p["block"], cost, entry, audit) for p, (entry, audit) in zip(parts, pieces)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*made) if made else [[]] * 5, kinds)],
                                  ["_conv_id", "_block", "cost", "entry", "audit"])
    pieces = staged(ways.mapInArrow(compose, "_conv_id bigint, _block bigint, cost bigint, entry int, audit string"), "pieces")
    joined = blocks.join(pieces, _same(blocks, pieces, "conv_id") & (blocks["block"] == pieces["_block"])).select(
        "conv_id", "block", "rows", "entry", "audit")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hash of each conversation's repaired turns, as a stream of its blocks."""
        key, digest, started = object(), None, False

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array([key], pa.int64()), pa.array([digest.hexdigest()])], ["_conv_id", "repaired_sha256"])
        for batch in batches:
            for conv, taken, entry, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rows", "entry", "audit"))):
                if digest is None or conv != key:
                    if digest is not None:
                        yield told()
                    key, digest, started = conv, hashlib.sha256(), False
                for line in applied(audit, [(r["role"], r["text"]) for r in taken], entry):
                    digest.update((("\n" if started else "") + line).encode())
                    started = True
        if digest is not None:
            yield told()
    hashes = handed(joined).repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
        hashed, "_conv_id bigint, repaired_sha256 string")
    audits = pieces.groupBy("_conv_id").agg(F.max("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("_block", "audit"))), lambda p: p["audit"]), "").alias("audit"))
    ids = ids.select(F.col("_conv_id").alias("conv_id"))
    for part in (stats.withColumnRenamed("conv_id", "_conv_id"), audits, hashes):
        ids = ids.join(part, _same(ids, part, "conv_id"), "left").drop("_conv_id")
    nothing = hashlib.sha256(b"").hexdigest()
    return ids.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in _RESULT], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def composed(blocks: list[list[Found]]) -> tuple[int, list[tuple[int, str]]]:
    """The cheapest way through blocks, given for each pair of last roles: its cost, and each block's entry and audit.

    Audits of one block use up the same rows and end with one of them, so that none is the beginning of another, and of two ways of
    equal cost the one with the lesser audit is that with the lesser audit in the first block where they differ.
    """
    # from behind: what is left to pay from each last role on, and the exit of the next block that the best way takes
    left: list[int | None] = [0 if last in _END else COST[INSERT] if last == _U else None for last in range(4)]
    chosen: list[list[int | None]] = []
    for ways in reversed(blocks):
        here: list[int | None] = [None] * 4
        to: list[int | None] = [None] * 4
        for entry in range(4):
            found = [(w[0] + left[b], w[1], b) for b in range(4) if (w := ways[entry * 4 + b]) is not None and left[b] is not None]
            if found:
                here[entry], _, to[entry] = min(found)
        left = here
        chosen.append(to)
    pieces, last = [], _NONE
    for ways, to in zip(blocks, reversed(chosen)):
        pieces.append((last, ways[last * 4 + to[last]][1]))
        last = to[last]
    if last == _U:
        pieces[-1] = (pieces[-1][0], pieces[-1][1] + INSERT)
    return left[_NONE], pieces


def repaired(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, present): faults, the cheapest edits, and a hash of what they give.

    * Rows are taken by turn, null turns first; rows of one turn by role and text. Equal rows are rows of their own, the later ones duplicates.
    * Rows without ``present`` only name their conversation; one without any other has zeros, an empty audit and the empty text's hash.
    * A null ``conv_id`` is a conversation of its own. Texts of any length; an empty table gives no rows; further columns are not looked at.
    """
    rows = rows.select("conv_id", "turn", "role", "text", "present")
    long = staged(rows.groupBy(F.col("conv_id").alias("_conv_id")).agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select("_conv_id"), "long")
    if long.isEmpty():
        return _of_short(rows)
    short = rows.join(long, _same(rows, long, "conv_id"), "left_anti")
    rest = rows.join(long, _same(rows, long, "conv_id"), "left_semi")
    return _of_short(short).unionByName(_of_long(rest, long, block_rows))
