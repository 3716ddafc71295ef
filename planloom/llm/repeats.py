"""Substring dedup by seed and extend, over words.

Seeds are winnowed anchors: in every window of ``WINDOW`` words the least hash of its ``SEED_WORDS``-word shingles. Equal
windows have equal seeds, so a seed that only one document has rules its windows out. Seeds that documents share are joined,
by buckets of hashes, and extended both ways to the windows around them; extended windows are joined in the same way, with the
lowest document that holds each. Windows that an earlier document holds are merged into maximal repeats, which are removed.
No pair of documents is ever written: a seed or window is one entry per batch of documents, whatever number of them hold it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from planloom.llm.dealing import (ASKED, BATCH_BYTES, BUCKET_BYTES, Shared, answer, ask, asked, bits, by_bucket, dealt, doc_numbers,
                                  pieces, text_bytes, unbits)
from planloom.llm.packing import U64, buffer_of, column, hashes_of, rolled, sliding, spans_to_runs, words_of

WINDOW = 13
SEED_WORDS = 5
_OTHER_STEP = 0xD6E8FEB86659FD93
_ENTRY = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<i8")])


class _Batch:
    """The words of a batch of documents and the seeds of its windows."""

    def __init__(self, table: pa.Table, window: int, seed_words: int, buckets: int):
        self.window, self.buckets = window, buckets
        self.doc = doc_numbers(table)
        self.first, self.words, self.index = words_of(*buffer_of(column(table, "text")))
        of = np.repeat(np.arange(len(self.doc)), np.diff(self.first))
        self.hash = hashes_of(self.words)[self.index] if len(self.words) else np.zeros(0, U64)
        n = max(0, len(self.hash) - window + 1)
        self.at = np.flatnonzero(of[:n] == of[window - 1:]) if n else np.zeros(0, np.int64)
        self.of = self.doc[of[self.at]] if n else np.zeros(0, np.int64)
        least = sliding(rolled(self.hash, seed_words), window - seed_words + 1, np.minimum)[self.at] if n else np.zeros(0, U64)
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (self.of[1:] != self.of[:-1])]) if len(least) else np.zeros(0, bool)
        self.run = np.cumsum(new) - 1
        self.seeds = Shared(least[new], self.of[new], buckets)

    def extended(self, told: dict[int, bytes]) -> "_Batch":
        """Windows around the shared seeds: each distinct one with the lowest document of the batch that holds it."""
        keep = self.seeds.told(told)[self.run] if len(self.at) else np.zeros(0, bool)
        self.at, self.of = self.at[keep], self.of[keep]
        a = rolled(self.hash, self.window)[self.at]
        b = rolled(self.hash, self.window, _OTHER_STEP)[self.at].astype(np.uint32)
        order = np.lexsort((b, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]) if len(a) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        self.entry = np.zeros(len(starts), _ENTRY)
        self.entry["a"], self.entry["b"] = a[order][starts], b[order][starts]
        if len(a):
            self.entry["doc"] = np.minimum.reduceat(self.of[order], starts)
        self.group = np.empty(len(a), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.bucket_of = ((self.entry["a"] >> U64(32)) % U64(self.buckets)).astype(np.int64)
        return self

    def removed(self, told: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of words that are covered by a window of an earlier document."""
        earlier = np.zeros(len(self.entry), bool)
        for bucket, at in by_bucket(self.bucket_of, self.buckets):
            earlier[at] = unbits(told[bucket], len(at))
        gone = earlier[self.group] | (self.of > self.entry["doc"][self.group])
        return spans_to_runs_in(self.at[gone], self.window, self.first)


def spans_to_runs_in(starts: np.ndarray, width: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``width`` at ``starts`` as maximal runs; runs of different documents stay apart."""
    if not len(starts):
        return starts, starts
    of = np.searchsorted(first, starts, side="right")
    shift = of * (width + 1)  # keeps the last run of a document from touching the next one's first
    a, b = spans_to_runs(starts + shift, starts + width + shift)
    back = of[np.searchsorted(starts + shift, a)] * (width + 1)
    return a - back, b - back


def _earlier(blobs: list[bytes]) -> list[bytes]:
    """For each window of each batch, whether a document below the batch's lowest holds it."""
    parts = [np.frombuffer(b, _ENTRY) for b in blobs]
    entry = np.concatenate(parts)
    order = np.lexsort((entry["b"], entry["a"]))
    a, b = entry["a"][order], entry["b"][order]
    starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    sizes = np.diff(np.concatenate([starts, [len(a)]]))
    below = np.empty(len(a), bool)
    below[order] = np.repeat(np.minimum.reduceat(entry["doc"][order], starts), sizes) < entry["doc"][order]
    return [bits(x) for x in np.split(below, np.cumsum([len(p) for p in parts])[:-1])]


def drop_repeats(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, spans array<struct<start,end>>, kept``: one row per row of ``docs``.

    A word goes if it lies in a window of ``window`` words that also starts in a document with a smaller ``doc_id``, judged on the
    input. ``spans`` are the maximal runs of removed words (places of words, end exclusive), ``kept`` the other words joined by a space.

    * Null text: no words. Texts shorter than a window keep all.
    * A null ``doc_id`` counts as larger than all others. Rows with one ``doc_id`` never remove from each other.
    * Texts of any length; an empty table gives no rows; other columns are not looked at.
    """
    total = text_bytes(docs)
    batches, buckets = pieces(total, batch_bytes), pieces(total, BUCKET_BYTES)
    rows = dealt(docs, batches)

    def seeds(batch: int, table: pa.Table, _) -> pa.Table:
        return _Batch(table, window, seed_words, buckets).seeds.questions(batch)

    def windows(batch: int, table: pa.Table, told) -> pa.Table:
        b = _Batch(table, window, seed_words, buckets).extended(told.get(1, {}))
        return asked(batch, b.bucket_of, buckets, lambda at: b.entry[at].tobytes())

    def finish(batch: int, table: pa.Table, told) -> pa.Table:
        b = _Batch(table, window, seed_words, buckets).extended(told.get(1, {}))
        return _without(table, b, *b.removed(told.get(2, {})))

    shared = answer(ask(rows, None, seeds, ASKED), 1, Shared.answers)
    earlier = answer(ask(rows, shared, windows, ASKED), 2, _earlier)
    return ask(rows, shared.unionByName(earlier), finish,
               "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string")


def _without(table: pa.Table, b: _Batch, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
    n = len(b.doc)
    cut = np.searchsorted(starts, b.first)
    kept, spans, removed = [], [], []
    for i, text in enumerate(column(table, "text")):
        words = (text.as_py() or b"").split()
        runs = [(int(s - b.first[i]), int(e - b.first[i])) for s, e in zip(starts[cut[i]:cut[i + 1]], ends[cut[i]:cut[i + 1]])]
        for s, e in reversed(runs):
            del words[s:e]
        kept.append(b" ".join(words))
        spans.append([{"start": s, "end": e} for s, e in runs])
        removed.append(sum(e - s for s, e in runs))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": column(table, "doc_id"), "n_words": pa.array(np.diff(b.first)[:n]), "n_removed": pa.array(removed, pa.int64()),
                     "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary()).cast(pa.string())})
