"""Document fingerprints by locally consistent parsing.

A text is a string of symbols (bytes at level 0). Runs of one symbol become one symbol each. Deterministic coin tossing then shrinks
symbols to labels below six that differ between neighbours: a label is the lowest bit in which a symbol differs from its left
neighbour, with that bit's value. Each local maximum of the labels starts a phrase, so that a boundary depends on a few
neighbours only and equal substrings are cut alike inside, wherever they stand. A phrase's name is a hash of its symbols;
names are the symbols of the next level. The fingerprint keeps, for each of ``SLOTS`` classes of names, the least one, over the names of the
levels from ``FIRST_LEVEL`` on; the share of equal slots estimates how much of the phrases two texts have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from planloom.llm.dealing import pieces, text_bytes
from planloom.llm.packing import U64, handed, mixed, tidy
from planloom.session import staged

SLOTS = 64
FIRST_LEVEL = 2
PART_BYTES = 16 << 20
_CHUNK_BYTES = 1 << 18
_STEP = 0x9E3779B97F4A7C15
_EMPTY = 0xFFFF
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
_NAMES = mixed(np.arange(1, 257, dtype=U64))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse (mod 2**64), ``n`` or more of them."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS


def _toss_table(symbols: int) -> np.ndarray:
    """Labels of (left, symbol) pairs of small symbols: the lowest bit that differs, and the symbol's value there."""
    left, own = np.meshgrid(np.arange(symbols), np.arange(symbols), indexing="ij")
    apart = left ^ own
    bit = np.bitwise_count((apart & -apart) - (apart > 0)).astype(np.int64)
    return (bit << 1 | own >> bit & 1).astype(np.uint8).ravel()


_BYTES, _SEVEN_BITS, _FOUR_BITS = _toss_table(256), _toss_table(128), _toss_table(16)


def _by_table(symbol: np.ndarray, heads: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    pair = symbol.astype(np.uint16)
    pair[1:] |= symbol[:-1].astype(np.uint16) << np.uint16(width)
    out = table[pair]
    out[heads] = symbol[heads] & 1  # the first symbol of a text has no left neighbour
    return out


def _labels(symbol: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Labels below six, different for neighbours."""
    if symbol.dtype == np.uint8:
        label = _by_table(symbol, heads, _BYTES, 8)
    else:
        apart = symbol.copy()
        apart[1:] ^= symbol[:-1]
        bit = np.bitwise_count((apart & (U64(0) - apart)) - U64(1))
        label = bit << np.uint8(1) | (symbol >> bit.astype(U64) & U64(1)).astype(np.uint8)
        label[heads] = (symbol[heads] & U64(1)).astype(np.uint8)
        label = _by_table(label, heads, _SEVEN_BITS, 7)
    for _ in range(2):
        label = _by_table(label, heads, _FOUR_BITS, 4)
    return label


def _level(symbol: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases, and the place of each text's first; ``heads`` are those of the symbols."""
    new = np.empty(len(symbol), bool)
    np.not_equal(symbol[1:], symbol[:-1], out=new[1:])
    new[heads] = True
    runs = None
    if not new.all():
        start = np.flatnonzero(new)
        length = np.diff(start, append=len(symbol))
        symbol, heads = symbol[start], np.searchsorted(start, heads)
        runs = np.flatnonzero(length > 1)
    name = _NAMES[symbol] if symbol.dtype == np.uint8 else symbol
    if runs is not None:
        name = name.copy()
        name[runs] = mixed(name[runs] ^ length[runs].astype(U64) * U64(_STEP))
    n = len(symbol)
    label = _labels(symbol, heads)
    rises = label[1:] > label[:-1]
    start = np.zeros(n, bool)
    start[1:-1] = rises[:-1] & ~rises[1:]
    start[heads[1:] - 1] = False  # the last symbol of a text never starts a phrase, nor does its second
    start[heads[heads + 1 < n] + 1] = False
    start[heads] = True
    first = np.flatnonzero(start)
    power, inverse = _powers(n)
    summed = np.add.reduceat(name * power[:n], first) * inverse[first]
    size = np.diff(first, append=n).astype(U64)
    return mixed(summed ^ size), np.searchsorted(first, heads)


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """One row of ``SLOTS`` 16-bit values per text; equal texts have equal rows."""
    least = np.full(len(texts) * SLOTS, np.iinfo(np.uint64).max, U64)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    of = np.flatnonzero(lens)  # texts that still have symbols
    symbol = np.frombuffer(b"".join(texts), np.uint8)
    heads = (np.cumsum(lens) - lens)[of]
    level = 0
    while len(of):
        symbol, heads = _level(symbol, heads)
        level += 1
        size = np.diff(heads, append=len(symbol))
        # a text of a single phrase is named by it, whatever the level
        kept = np.repeat((size == 1) | (level >= FIRST_LEVEL), size)
        name = mixed(symbol[kept] + U64(level))
        slot = np.repeat(of, size)[kept] * SLOTS + (name >> U64(58)).astype(np.int64)
        np.minimum.at(least, slot, name)
        more = size > 1
        symbol, of, size = symbol[np.repeat(more, size)], of[more], size[more]
        heads = np.cumsum(size) - size
    out = np.minimum((least & U64(0xFFFF)).astype(np.uint16), _EMPTY - 1)
    return np.where(least == np.iinfo(np.uint64).max, _EMPTY, out).astype(np.uint16).reshape(-1, SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among those that either fingerprint fills; two empty ones are alike."""
    filled = (a != _EMPTY) | (b != _EMPTY)
    size = filled.sum(1)
    return np.where(size == 0, 1.0, ((a == b) & filled).sum(1) / np.maximum(size, 1))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text's first."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_DONE = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()),
                   ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                   ("part", pa.int64()), ("edge", pa.int32()), ("text", pa.string())])
_DDL = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, "
        "near_next double, part bigint, edge int, text string")


def _done(ids: list, texts: list[str], following: list[str], fps: np.ndarray, following_fps: np.ndarray) -> pa.RecordBatch:
    """Finished rows; ``fps`` are the texts' fingerprints, ``following_fps`` those of the next documents."""
    new = [edited(t, f).encode() for t, f in zip(texts, following)]
    edited_fps = fingerprints_of(new)
    n = len(ids)
    return pa.record_batch([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in new], pa.string()),
        pa.array([x.tobytes() for x in fps], pa.binary()), pa.array([x.tobytes() for x in edited_fps], pa.binary()),
        pa.array(likeness(fps, edited_fps)), pa.array(likeness(fps, following_fps)),
        pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], schema=_DONE)


def _edge(doc_id: int | None, part: int, edge: int, text: str) -> pa.RecordBatch:
    values = {"doc_id": doc_id, "part": part, "edge": edge, "text": text}
    return pa.RecordBatch.from_pylist([{name: values.get(name) for name in _DONE.names}], schema=_DONE)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= _CHUNK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def edit_fingerprints(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint`` (binary) ``, near_edited, near_next``, one row per row of ``docs``.

    Documents are taken in descending order of ``doc_id``; the next one of the last is the first. They are dealt into ranges of that order and
    each is read as a stream. Only the first and the last document of a range need another range's, and are finished afterwards.

    * A null text is empty. A null ``doc_id`` comes last. Rows with one ``doc_id`` follow each other by a hash of the text, then the text.
    * A single row is its own next. Two empty texts are alike (1.0). An empty table gives no rows. Other columns are not looked at.
    """
    rows = handed(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranges = rows.repartitionByRange(pieces(text_bytes(docs), part_bytes), *order).sortWithinPartitions(*order, "text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        held = None  # the last document so far: its successor is still to come
        for ids, texts in _chunks(batches):
            fps = fingerprints_of([t.encode() for t in texts])
            if held is None:
                yield _edge(ids[0], part, 0, texts[0])
            else:
                ids, texts, fps = [held[0], *ids], [held[1], *texts], np.concatenate([held[2][None], fps])
            if len(ids) > 1:
                yield _done(ids[:-1], texts[:-1], texts[1:], fps[:-1], fps[1:])
            held = ids[-1], texts[-1], fps[-1]
        if held is not None:
            yield _edge(held[0], part, 1, held[1])

    found = staged(ranges.mapInArrow(run, _DDL), "parsed")
    return found.where("edge is null").drop("part", "edge", "text").unionByName(_at_edges(found))


def _at_edges(found: DataFrame) -> DataFrame:
    """The last document of each range with the first of the next one; the ranges are a ring."""
    parts = staged(found.where("edge = 0").select("part"), "parts")
    pairs = parts.alias("a").select(F.col("a.part"))
    following = staged(_following(pairs), "following")
    last = found.where("edge = 1").select("part", "doc_id", "text")
    first = found.where("edge = 0").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    joined = last.join(following, "part").join(first, "next_part").select("doc_id", "text", "next_text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, after in zip(*(batch.column(c).to_pylist() for c in range(3))):
                fps = fingerprints_of([text.encode(), after.encode()])
                yield _done([i], [text], [after], fps[:1], fps[1:])

    return joined.mapInArrow(run, _DDL).drop("part", "edge", "text")


def _following(parts: DataFrame) -> DataFrame:
    """Each range's number with that of the next range that holds rows; one small row per range, in blocks of numbers."""
    from pyspark.sql.window import Window
    blocks = parts.withColumn("block", F.floor(F.col("part") / 4096))
    inside = blocks.withColumn("next_part", F.lead("part").over(Window.partitionBy("block").orderBy("part")))
    firsts = blocks.groupBy("block").agg(F.min("part").alias("first"))
    after = firsts.select("block", F.lead("first").over(Window.orderBy("block")).alias("after"))
    start = parts.agg(F.min("part")).first()[0]
    return inside.join(after, "block").select("part", F.coalesce("next_part", "after", F.lit(start).cast("bigint")).alias("next_part"))
