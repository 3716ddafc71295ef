"""Entries of keyed JSON files of any layout, read by ranges of bytes.

A range that begins anywhere in a file does not know whether it begins within a text, nor how deep. A first pass counts, for each
range and either case, how it ends: the parity of its quotes and the change of depth. Running sums over the ranges of a file then tell
every range how it begins. The second pass parses: a range owns the entries whose separator (the brace that opens
the file's object, or a comma directly within it) lies in it, and reads on past its end for the last one. No file is one task's, and only structural
bytes are looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

RANGE_BYTES = 32 << 20
_TASK_BYTES = 8 << 20
_BLOCK = 1 << 20
_QUOTE, _COMMA, _BACKSLASH = b'"'[0], b","[0], b"\\"[0]
_STEP = np.zeros(256, np.int64)
_STEP[[*b"{["]] = 1
_STEP[[*b"}]"]] = -1
_MARKS = np.zeros(256, bool)
_MARKS[[*b'"{}[],']] = True


def opened(path: str) -> pa.NativeFile:
    """A file in any file system that Arrow knows, for reading at offsets."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


def _run_before(data: bytes, at: int) -> int:
    """Number of backslashes directly before a place."""
    return at - len(data[:at].rstrip(b"\\"))


def _odd_before(file: pa.NativeFile, at: int) -> bool:
    """Whether an odd number of backslashes stands directly before a place in a file."""
    run, size = 0, 64
    while at > run:
        lo = max(0, at - run - size)
        file.seek(lo)
        data = file.read(at - run - lo)
        found = _run_before(data, len(data))
        run += found
        if found < len(data):
            break
        size *= 2
    return run % 2 == 1


def marks(data: bytes, odd: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and bytes of brackets, commas and unescaped quotes; ``odd``: an odd run of backslashes stands before the data."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(_MARKS[raw])
    kind = raw[at]
    behind = (kind == _QUOTE) & (at > 0) & (raw[np.maximum(at - 1, 0)] == _BACKSLASH)
    keep = np.ones(len(at), bool)
    for i in np.flatnonzero(behind).tolist():
        run = _run_before(data[max(0, at[i] - 64):at[i]], min(64, int(at[i])))
        if run == min(64, at[i]):  # as far as looked: count the whole run
            run = _run_before(data, int(at[i]))
        keep[i] = (run + (odd and run == at[i])) % 2 == 0
    if odd and len(at) and at[0] == 0 and kind[0] == _QUOTE:
        keep[0] = False
    return at[keep], kind[keep]


def depths(kind: np.ndarray, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each mark: whether it is outside of texts, and the depth after it."""
    outside = (np.cumsum(kind == _QUOTE) + inside) % 2 == 0
    return outside, depth + np.cumsum(np.where(outside, _STEP[kind], 0))


def _ranges(spark: SparkSession, path: str, range_bytes: int) -> tuple[DataFrame, int]:
    """Ranges of the files, and over how many tasks they are dealt: ranges are so few bytes that adaptive execution would use one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).where("length > 0").select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint")))
    found = files.select("path", "length", starts.alias("start"))
    tasks = files.agg(F.sum(F.ceil(F.col("length") / range_bytes)), F.sum("length")).first()
    n = max(1, min(int(tasks[0] or 0), -(-int(tasks[1] or 0) // _TASK_BYTES)))
    return found.repartition(n), n


def _counted(batches: Iterator[pa.RecordBatch], range_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, start in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            with opened(path) as file:
                odd = _odd_before(file, start)
                file.seek(start)
                _, kind = marks(file.read(range_bytes), odd)
            changes = [int(depths(kind, inside, 0)[1][-1]) if len(kind) else 0 for inside in (False, True)]
            rows.append((path, start, int((kind == _QUOTE).sum() % 2), *changes))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), *[pa.int64()] * 4))],
                              ["path", "start", "quotes", "outside", "inside"])


def _bad(path: Column, what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"keyed JSON: {what}: "), path))


def _begun(ranges: DataFrame, range_bytes: int) -> DataFrame:
    """Ranges with the state they begin in. A file that ends within a text or an object ends the query."""
    counted = ranges.mapInArrow(
        lambda batches: _counted(batches, range_bytes), "path string, start bigint, quotes bigint, outside bigint, inside bigint")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    last = F.lead("start").over(Window.partitionBy("path").orderBy("start")).isNull()
    rows = counted.withColumns({"_in": F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2, "_last": last})
    rows = rows.withColumn("_change", F.when(F.col("_in") == 0, F.col("outside")).otherwise(F.col("inside")))
    rows = rows.withColumn("_depth", F.coalesce(F.sum("_change").over(before), F.lit(0)))
    whole = ((F.col("_in") + F.col("quotes")) % 2 == 0) & (F.col("_depth") + F.col("_change") == 0)
    depth = F.when(F.col("_last") & ~whole, _bad(F.col("path"), "cut off, or no object").cast("bigint")).otherwise(F.col("_depth"))
    return rows.select("path", "start", F.col("_in").cast("boolean").alias("inside"), depth.alias("depth"))


def _owned(file: pa.NativeFile, path: str, start: int, inside: bool, depth: int, range_bytes: int) -> Iterator[tuple[int, str]]:
    """Offset and text of the entries whose separator lies in a range."""
    odd = _odd_before(file, start)
    file.seek(start)
    data = file.read(range_bytes)
    if start == 0 and not data.lstrip()[:1] in (b"{", b""):
        raise ValueError(f"keyed JSON: no object: {path}")
    own, base, held, begin = len(data), 0, data, None
    while data:
        at, kind = marks(data, odd)
        outside, after = depths(kind, inside, depth)
        opens = outside & (after == 1) & ((kind == _COMMA) | (kind == b"{"[0]) & (np.concatenate([[depth], after[:-1]])[:len(after)] == 0))
        closes = outside & ((after == 1) & (kind == _COMMA) | (after == 0) & (kind == b"}"[0]))
        for i in np.flatnonzero(opens | closes).tolist():
            place = base + int(at[i])
            if begin is not None and closes[i]:
                text = held[begin:place].decode()
                if text.strip():
                    yield start + begin, text
                begin = None
            if opens[i] and place < own:
                begin = place + 1
        if begin is None:
            return
        odd = (_run_before(data, len(data)) + (odd and not data.rstrip(b"\\"))) % 2 == 1
        inside, depth = (bool((kind == _QUOTE).sum() + inside & 1), int(after[-1])) if len(kind) else (inside, depth)
        base += len(data)
        data = file.read(_BLOCK)
        held += data


def _parsed(batches: Iterator[pa.RecordBatch], range_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, inside, depth in zip(*(c.to_pylist() for c in batch.columns)):
            rows: list[tuple[str, int, str]] = []
            size = 0
            with opened(path) as file:
                for offset, text in _owned(file, path, start, inside, depth, range_bytes):
                    rows.append((path, offset, text))
                    size += len(text)
                    if size > _TASK_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
            yield _batch(rows)


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string()))],
                           ["path", "offset", "entry"])


def read_entries(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, offset, entry``: each entry ``"key": value`` of the objects in the files of ``path``, whatever their layout.

    Blank files and empty objects have no entries. Files that are cut off, or hold no object, raise an error. The
    files must lie where Arrow can open them.
    """
    ranges, tasks = _ranges(spark, path, range_bytes)
    return _begun(ranges, range_bytes).repartition(tasks).mapInArrow(lambda batches: _parsed(batches, range_bytes), "path string, offset bigint, entry string")
