"""Helpers on arrays inside tasks: packed columns, buffers of a string column, words and window hashes."""

from __future__ import annotations

import ctypes
import json
import re
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

U64 = np.uint64
_BLOCK = 1 << 14
_STEP = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


#: Most bytes of rows that are handed to a Python worker at once, unless the session asks for less. The JVM holds a batch outside its heap
#: and the worker holds it again, for each running task.
HANDED_BYTES = 8 << 20
_HANDED = "spark.sql.execution.arrow.maxBytesPerBatch"


def handed(rows: DataFrame, nbytes: int = HANDED_BYTES) -> DataFrame:
    """The same rows; from now on their session hands rows to Python in batches of at most ``nbytes`` (one row at least)."""
    conf = rows.sparkSession.conf
    number, unit = re.fullmatch(r"(-?\d+)([bkmgt]?)b?", conf.get(_HANDED).strip().lower()).groups()
    if not 0 < int(number) << 10 * "bkmgt".index(unit or "b") <= nbytes:
        conf.set(_HANDED, f"{nbytes}b")
    return rows


def give_back() -> None:
    """Return freed memory of this worker process to the machine: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Batches) -> Batches:
    """A function for ``mapInArrow`` that gives memory back at the end of its task."""
    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def pack(**arrays: np.ndarray) -> bytes:
    """Named arrays as one value of a binary column."""
    head = json.dumps([(name, a.dtype.str, len(a)) for name, a in arrays.items()]).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays.values())


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    at = 4 + int.from_bytes(blob[:4], "little")
    out = {}
    for name, kind, n in json.loads(blob[4:at]):
        out[name] = np.frombuffer(blob, np.dtype(kind), n, at)
        at += out[name].nbytes
    return out


def column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    """One column as a single array."""
    values = table.column(name)
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def buffer_of(values: pa.Array) -> tuple[np.ndarray, bytes]:
    """Offsets (from zero) and bytes of a binary or string column; nulls are empty."""
    values = pc.fill_null(values.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    if len(values) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(len(values) + 1, np.int64), b""
    data = values.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()
    return offsets - offsets[0], data


def words_of(offsets: np.ndarray, data: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: the first word of each text (and their total), the distinct words, each word's index."""
    kind = pa.large_binary()
    texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1,
                                  [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)])
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten().cast(kind)
    bounds = np.asarray(split.offsets, np.int64)
    full = np.asarray(pc.greater(pc.binary_length(flat), 0)) if len(flat) else np.zeros(0, bool)
    first = np.concatenate([[0], np.cumsum(full)])[bounds - bounds[0]]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return first, coded.dictionary, np.asarray(coded.indices).astype(np.int64)


def hashes_of(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each value."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words.to_pylist()), U64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def rolled(values: np.ndarray, width: int, step: int = _STEP) -> np.ndarray:
    """Polynomial hash (mod 2**64) of each run of ``width`` values; mixed. Block by block, as blocks fit into a core's cache."""
    n = max(0, len(values) - width + 1)
    out = np.empty(n, U64)
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        out[lo:hi] = mixed(_polynomial(values[lo:hi + width - 1], width, step))
    return out


def _polynomial(values: np.ndarray, width: int, step: int) -> np.ndarray:
    """The hashes of one block, by doubling."""
    h, levels, size = values.astype(U64), {}, 1
    while size <= width:
        if width & size:
            levels[size] = h
        if size * 2 <= width:
            h = h[:-size] + U64(pow(step, size, 1 << 64)) * h[size:]
        size *= 2
    out, done, n = None, 0, len(values) - width + 1
    for size in sorted(levels, reverse=True):
        if width - done >= size:
            part = levels[size][done:done + n]
            out = part.copy() if out is None else out + U64(pow(step, done, 1 << 64)) * part
            done += size
    return out


def sliding(values: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """``best`` (minimum or maximum) of each run of ``width`` values, block by block."""
    n = max(0, len(values) - width + 1)
    out = np.empty(n, values.dtype)
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        part, size = values[lo:hi + width - 1], 1
        while size * 2 <= width:
            part = best(part[:-size], part[size:])
            size *= 2
        out[lo:hi] = best(part[:len(part) - (width - size)], part[width - size:]) if width > size else part
    return out


def lowest(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs of ``width`` hashes: each run's minimum, and the places that are the minimum of some run."""
    if len(h) < width:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    least = sliding(h, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, U64), least, np.zeros(width - 1, U64)])
    return least, np.flatnonzero(sliding(padded, width, np.maximum) == h)


def parts_of(batch: pa.RecordBatch, at: int, size: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Parts of a batch of at most about ``size`` bytes in column ``at`` (one row at least), with their bytes."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0)).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(lo, hi - lo), int(ends[hi - 1]) - before
        lo = hi


def joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``size`` bytes or more (but the last), for work that is the cheaper the more rows share it."""
    held: list[pa.RecordBatch] = []
    weight = 0
    for batch in batches:
        held.append(batch)
        weight += batch.nbytes
        if weight >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, weight = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def in_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int, nbytes: int = 1 << 62) -> Iterator[pa.Table]:
    """Tables of whole groups of a stream that is sorted by ``key``, about ``rows`` rows each, or fewer that take ``nbytes`` bytes."""
    held: list[pa.RecordBatch] = []
    size = weight = 0
    for batch in batches:
        held.append(batch)
        size, weight = size + batch.num_rows, weight + batch.nbytes
        if size < rows and weight < nbytes:
            continue
        table = pa.Table.from_batches(held)
        keys = np.asarray(column(table, key))
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut)
            table = table.slice(cut)
        held, size, weight = table.combine_chunks().to_batches(), table.num_rows, table.nbytes
    if held:
        yield pa.Table.from_batches(held)


def spans_to_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching spans, sorted by start, as maximal runs."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])
    return starts[new], reach[last]
