"""Benchmark decontamination: pigeonhole pieces, exact hits, and Myers' bit-parallel distance.

Texts are read as lower-cased words, ASCII marks being white space. An item of ``m`` words may differ in ``floor(m * RATE)`` words (put in,
left out or changed). Cut into one piece more than that, an item within its budget leaves one piece untouched: every occurrence has an
exact hit of some piece. Pieces are found by the hash of their first words; a bit map of those hashes, of fixed size, keeps
nearly all other words from the join with the pieces. A document with hits is kept once, whatever their number; around the diagonals
of its hits with an item the distance decides, with words as letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from planloom.llm.packing import U64, buffer_of, handed, hashes_of, parts_of, rolled, tidy, words_of
from planloom.session import staged

RATE = 0.125
ANCHOR_WORDS = 4
MAP_BITS = 26
#: So many bytes of texts are cut into words at a time.
_CHUNK_BYTES = 1 << 20
_MARKS = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not (chr(b).isalnum()) else b for b in range(256))


def plain(text: str | None) -> list[bytes]:
    """The words of a text as they are compared; lower-cased as the documents are."""
    return pc.utf8_lower(pa.scalar(text or "")).as_py().encode().translate(_MARKS).split()


def budget(words: int, rate: float = RATE) -> int:
    """Edits allowed: one piece more must still hold ``ANCHOR_WORDS`` words each, or there is no edit at all."""
    return max(0, min(int(words * rate), words // ANCHOR_WORDS - 1))


def item_pieces(words: list[bytes], rate: float = RATE) -> list[tuple[int, int]]:
    """``(first word, words)`` of each piece."""
    parts = budget(len(words), rate) + 1
    cuts = [len(words) * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def distance(pattern: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """Least number of word edits between the pattern and any run of the text, and where (words) the first such run ends."""
    m = len(pattern)
    places: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        places[w] = places.get(w, 0) | 1 << i
    whole, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = whole, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = places.get(w, 0)
        x = eq | down
        diagonal = ((((eq & up) + up) ^ up) | eq) & whole
        plus, minus = down | ~(diagonal | up) & whole, up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & whole, minus << 1 & whole
        up, down = minus | ~(x | plus) & whole, plus & x
        if score < best:
            best, end = score, j + 1
    return best, end


def _pieces(items: DataFrame, rate: float) -> DataFrame:
    """One row per piece: the hash and number of its first words, and where it stands in its item."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = plain(text)
                hashed = hashes_of(pa.array(words, pa.binary()))
                rows = []
                for first, n in item_pieces(words, rate):
                    width = min(n, ANCHOR_WORDS)
                    rows.append((int(rolled(hashed[first:first + width], width)[0].view(np.int64)), width, item, first))
                yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["anchor", "width", "item_id", "first"])
    return items.select(F.col("item_id").cast("bigint"), "text").mapInArrow(run, "anchor bigint, width int, item_id bigint, first int")


def _bit_map(pieces: DataFrame) -> np.ndarray:
    """A bit map of the pieces' hashes: 2**MAP_BITS bits (8 MB) whatever the number of pieces; only its full words are collected."""
    place = F.shiftrightunsigned("anchor", 64 - MAP_BITS)
    words = pieces.select(place.alias("p")).select(
        F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[row["word"]] = row["bits"]
    return out.view(U64)


_HITS = "array<struct<anchor:bigint,width:int,at:int>>"


def _hits(docs: DataFrame, pieces: DataFrame, widths: list[int]) -> DataFrame:
    """Documents with words whose hash is in the map: ``doc_id``, their words, and the places."""
    shared = docs.sparkSession.sparkContext.broadcast(_bit_map(pieces))
    hit_kind = pa.list_(pa.struct([("anchor", pa.int64()), ("width", pa.int32()), ("at", pa.int32())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for part, _ in parts_of(batch, 1, _CHUNK_BYTES):
                yield from found(part.column(0), pc.fill_null(part.column(1), ""), bits)

    def found(ids: pa.Array, texts: pa.Array, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        offsets, data = buffer_of(pc.utf8_lower(texts))
        first, distinct, index = words_of(offsets, data.translate(_MARKS))
        hashed = hashes_of(distinct)[index] if len(index) else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(ids)), np.diff(first))
        hits: dict[int, list[dict]] = {}
        for width in widths:
            h = rolled(hashed, width)
            place = h >> U64(64 - MAP_BITS)
            hit = np.flatnonzero((bits[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1))
            hit = hit[owner[hit] == owner[hit + width - 1]]
            for doc, anchor, at in zip(owner[hit].tolist(), h[hit].view(np.int64).tolist(), (hit - first[owner[hit]]).tolist()):
                hits.setdefault(doc, []).append({"anchor": anchor, "width": width, "at": at})
        rows = sorted(hits)
        words = [b" ".join(distinct.take(pa.array(index[first[i]:first[i + 1]])).to_pylist()) for i in rows]
        yield pa.record_batch([ids.take(pa.array(rows, pa.int64())), pa.array(words, pa.binary()), pa.array([hits[i] for i in rows], hit_kind)],
                              ["doc_id", "words", "hits"])

    return handed(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, f"doc_id bigint, words binary, hits {_HITS}")


def _spans(diagonals: list[int], words: int, most: int, size: int) -> list[tuple[int, int]]:
    """Parts of a text of ``size`` words around the diagonals of hits, merged where they overlap."""
    out: list[tuple[int, int]] = []
    for d in sorted(diagonals):
        lo, hi = max(0, d - most), min(size, d + words + most)
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        elif lo < hi:
            out.append((lo, hi))
    return out


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, distance, budget, end_word``: one row per document and benchmark item that it holds within the item's budget.

    ``distance`` is the least over all places of the document, ``end_word`` where the first such place ends. ``items`` has
    ``item_id`` and ``text``.

    * Null and empty texts, and items without words, match nothing. An item of fewer than ``2 * ANCHOR_WORDS`` words must occur as it is.
    * A null ``doc_id`` (or ``item_id``) is a key like any other; rows that share one are one document (or item).
    * Empty tables give no rows; other columns are not looked at.
    """
    pieces = staged(_pieces(items, rate), "pieces")
    widths = pieces.agg(F.collect_set("width")).first()[0]
    found = staged(_hits(docs, pieces, sorted(widths)).withColumn("row", F.xxhash64("doc_id", "words")), "hits")
    places = found.select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    near = places.join(pieces, ["anchor", "width"]).groupBy("row", "item_id").agg(F.collect_set(F.col("at") - F.col("first")).alias("diagonals"))
    texts = items.select(F.col("item_id").cast("bigint"), F.col("text").alias("item")).dropDuplicates()
    held = found.select("row", "doc_id", "words").dropDuplicates(["row"])
    pairs = near.join(held, "row").alias("n").join(texts.alias("t"), F.col("n.item_id").eqNullSafe(F.col("t.item_id"))).select(
        "n.doc_id", "n.item_id", "n.words", "n.diagonals", "t.item")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        for batch in batches:
            rows = []
            for doc, item, words, diagonals, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                pattern, words = plain(text), words.split()
                most = budget(len(pattern), rate)
                for lo, hi in _spans(diagonals, len(pattern), most, len(words)):
                    best, end = distance(pattern, words[lo:hi])
                    if best <= most:
                        rows.append((doc, item, best, most, lo + end))
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                  ["doc_id", "item_id", "distance", "budget", "end_word"])

    checked = pairs.mapInArrow(run, "doc_id bigint, item_id bigint, distance int, budget int, end_word bigint")
    return checked.groupBy("doc_id", "item_id").agg(
        F.min(F.struct("distance", "end_word", "budget")).alias("best")).select("doc_id", "item_id", "best.distance", "best.budget", "best.end_word")
