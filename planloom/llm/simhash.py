"""SimHash near-duplicates: 64-bit fingerprints, every pair within a radius by bit-sliced comparison, components.

Candidates: the 64 bits are cut into ``PIECES`` pieces; two fingerprints with at most ``RADIUS`` differing bits agree on at least
``PIECES - RADIUS`` of them, so that each choice of so many pieces is a table in which the pair meets. Inside a bucket of
a table fingerprints lie as bit planes, 64 of them in a word; a fingerprint is compared with 64 others at a time, plane by plane, by
carry-save counters, and a word is abandoned once all its counters exceed the radius. Only distinct fingerprints are
compared, a bucket gives a spanning forest of its links, and a bucket of more than ``BLOCK_ROWS`` is dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from planloom.llm.components import components
from planloom.llm.packing import U64, column, handed, in_groups, tidy
from planloom.session import staged

WORDS = 4
RADIUS = 4
PIECES = 6
SEED = 42
BLOCK_ROWS = 4096
_ROWS_AT_ONCE = 65_536
_LANES = 64


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """SimHash of the lower-cased shingles of a text; without words 0."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = (ends[:n] - np.fromiter(map(len, found[:n]), np.int64, n) - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())], U64)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at:at + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view(U64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``fp`` (bigint): one row per row of ``docs``. A null text has no words."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), U64, batch.num_rows)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])
    return handed(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id bigint, fp bigint")


def _masks(pieces: int, radius: int) -> list[int]:
    cuts = [64 * i // pieces for i in range(pieces + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(part[i] for i in kept) for kept in combinations(range(pieces), pieces - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of words of 64 fingerprints: one row per bit, one 64-bit word per 64 fingerprints."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, _LANES, 8), axis=2, bitorder="little")
    # of a single word packbits may return another order
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(U64)[:, :, 0]


def near_links(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of one group whose fingerprints differ in at most ``radius`` (below 8) bits; ``group`` is sorted."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(group)]]))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # lanes: each group begins a new word
    words = -(-sizes // _LANES)
    word0 = np.cumsum(words) - words
    of = np.repeat(np.arange(len(starts)), sizes)
    rank = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = starts[of] + rank
    lane = word0[of] * _LANES + rank
    place = np.full(words.sum() * _LANES, -1, np.int64)
    place[lane] = row
    filled = np.packbits((place >= 0).reshape(-1, _LANES), axis=1, bitorder="little").view(U64)[:, 0]
    laid = np.zeros(len(place), U64)
    laid[lane] = fps[row]
    planes = _planes(laid)
    # tasks: a fingerprint against its own word and the later ones of its group
    own = word0[of] + rank // _LANES
    count = word0[of] + words[of] - own
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends = np.cumsum(count)
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _ROWS_AT_ONCE)))
        n = count[at:to]
        query = np.repeat(np.arange(at, to), n)
        word = own[query] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found, lanes = _compare(planes, fps[row[query]], word, filled, radius)
        t, j = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, j = row[query[found[t]]], place[word[found[t]] * _LANES + j]
        left.append(i[i < j])
        right.append(j[i < j])
        at = to
    return np.concatenate(left), np.concatenate(right)


def _compare(planes: np.ndarray, fps: np.ndarray, word: np.ndarray, filled: np.ndarray, radius: int):
    """Tasks with a link and the lanes that link; counters in carry-save form: ones, twos, fours and eight or more."""
    live = np.arange(len(fps))
    ones, twos, fours, over = (np.zeros(len(fps), U64) for _ in range(4))
    for bit in range(64):
        x = planes[bit][word] ^ (U64(0) - ((fps >> U64(bit)) & U64(1)))
        carry = ones & x
        ones ^= x
        x = twos & carry
        twos ^= carry
        over |= fours & x
        fours ^= x
        if bit % 8 == 7:
            keep = np.flatnonzero(_within(ones, twos, fours, over, radius) & filled[word])
            if len(keep) < len(live):
                live, fps, word = live[keep], fps[keep], word[keep]
                ones, twos, fours, over = ones[keep], twos[keep], fours[keep], over[keep]
    return live, _within(ones, twos, fours, over, radius) & filled[word]


def _within(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is at most the radius: compared with it digit by digit from above."""
    less, same = np.zeros_like(ones), ~over
    for digit, plane in ((4, fours), (2, twos), (1, ones)):
        if radius & digit:
            less |= same & ~plane
            same = same & plane
        else:
            same = same & ~plane
    return less | same


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The lowest place that each of ``n`` places reaches over the links."""
    label = np.arange(n)
    while True:
        a, b = label[left], label[right]
        if (a == b).all():
            return label
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while not np.array_equal(label, label[label]):
            label = label[label]


def dealt_blocks(rows: DataFrame, key: str, member: str) -> DataFrame:
    """The rows, but a key of more than ``BLOCK_ROWS`` is dealt out as keys of their own: pairs of blocks of members."""
    zero = F.lit(0).cast("bigint")
    crowded = staged(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS).select(
        key, F.ceil(F.col("n") / BLOCK_ROWS).cast("bigint").alias("_blocks")), "crowded")
    dealt = rows.join(crowded, key, "left").withColumn("_mine", F.pmod(F.xxhash64(member), F.coalesce("_blocks", F.lit(1))))
    other = F.explode(F.when(F.col("_blocks").isNull(), F.array(zero)).otherwise(F.sequence(zero, F.col("_blocks") - 1)))
    block = F.xxhash64(key, F.least("_mine", "_other"), F.greatest("_mine", "_other"))
    return dealt.withColumn("_other", other).withColumn(key, F.when(F.col("_blocks").isNull(), F.col(key)).otherwise(block)).select(rows.columns)


def near_pairs(classes: DataFrame, radius: int = RADIUS, pieces: int = PIECES) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all within the radius: a spanning forest per bucket."""
    masks = _masks(pieces, radius)
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)])
    rows = classes.select("fp", F.explode(keys).alias("key"))
    rows = dealt_blocks(rows, "key", "fp")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_groups(batches, "key", _ROWS_AT_ONCE):
            fps, group = np.asarray(column(table, "fp")), np.asarray(column(table, "key"))
            label = forest(len(fps), *near_links(fps.view(U64), group, radius))
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield pa.record_batch([pa.array(fps[label[moved]]), pa.array(fps[moved])], ["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, pieces: int = PIECES) -> DataFrame:
    """``doc_id``, ``fp`` (bigint) and ``component_id``, the lowest ``doc_id`` reachable over links, one row per row of ``docs``.

    * Null and empty texts, and texts of white space, have the fingerprint 0 and link like any other.
    * Equal rows and equal texts share a fingerprint and so a component; a null ``doc_id`` stays null and is never the lowest
      (a component of null ids only has a null ``component_id``). An empty table gives no rows.
    * Other columns are not looked at.
    """
    fps = staged(fingerprints(docs), "fingerprints")
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    linked = staged(components(near_pairs(classes, radius, pieces), "a", "b"), "linked")
    lowest = (linked.join(classes, linked.node == classes.fp).groupBy("root").agg(F.min("first").alias("lowest")))
    lowest = staged(linked.join(lowest, "root").select(F.col("node").alias("fp"), "lowest"), "lowest")
    named = classes.join(lowest, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
