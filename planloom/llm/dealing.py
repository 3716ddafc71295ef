"""Asking questions about what a document shares with all others, without a row per position.

Documents are dealt into batches of a set number of bytes. A batch asks: one packed value per bucket of hashes,
holding each hash once. A bucket gets what all batches ask about its hashes and answers each of them with a packed
value of its own. Batches and buckets are counted from the bytes of the table, so that either stays of one size
however large the table is; a hash in a third of all documents is one entry per batch, not one per document.
The shuffle of the texts is written once: every later use of the dealt documents in a plan reuses it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from planloom.llm.packing import give_back, handed

BATCH_BYTES = 16 << 20
BUCKET_BYTES = 4 << 20
ASKED = "_batch int, _bucket int, payload binary"
ASKED_ARROW = pa.schema([("_batch", pa.int32()), ("_bucket", pa.int32()), ("payload", pa.binary())])


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def pieces(total: int, size: int) -> int:
    """Into how many parts of about ``size`` bytes a total is dealt."""
    return max(1, -(-total // size))


def dealt(docs: DataFrame, batches: int) -> DataFrame:
    """``doc_id`` and ``text`` (bytes) by batch; the batch follows from the row, so a lost task finds it again."""
    rows = handed(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.withColumn("_batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int")).repartition(
        max(2, batches), "_batch")


def asked(batch: int, bucket_of: np.ndarray, buckets: int, blob: Callable[[np.ndarray], bytes]) -> pa.Table:
    """One packed value per bucket; ``blob`` packs the entries of a bucket, given their order."""
    order = np.argsort(bucket_of, kind="stable")
    cuts = np.searchsorted(bucket_of[order], np.arange(buckets + 1))
    full = np.flatnonzero(cuts[1:] > cuts[:-1])
    return pa.table([pa.array(np.full(len(full), batch, np.int32)), pa.array(full.astype(np.int32)),
                     pa.array([blob(order[cuts[b]:cuts[b + 1]]) for b in full], pa.binary())], schema=ASKED_ARROW)


def by_bucket(bucket_of: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The same order as in ``asked``: each full bucket with the places of its entries."""
    order = np.argsort(bucket_of, kind="stable")
    cuts = np.searchsorted(bucket_of[order], np.arange(buckets + 1))
    for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
        yield int(b), order[cuts[b]:cuts[b + 1]]


Asker = Callable[[int, pa.Table, dict[int, dict[int, bytes]]], pa.Table]


def _answers_of(table: pa.Table) -> dict[int, dict[int, bytes]]:
    """Answers by round and bucket."""
    out: dict[int, dict[int, bytes]] = {}
    for kind, bucket, payload in zip(*(table.column(c).to_pylist() for c in ("_round", "_bucket", "payload"))):
        out.setdefault(kind, {})[bucket] = payload
    return out


def ask(docs: DataFrame, answers: DataFrame | None, fn: Asker, schema: str) -> DataFrame:
    """Run ``fn(batch, its documents, answers so far by round and bucket)`` for every batch."""
    if answers is None:
        def alone(rows: pa.Table) -> pa.Table:
            give_back()  # what the group before has left
            return fn(rows.column("_batch")[0].as_py(), rows, {})

        return docs.groupBy("_batch").applyInArrow(alone, schema)

    def both(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            raise RuntimeError("answers to a batch without documents")
        give_back()
        return fn(rows.column("_batch")[0].as_py(), rows, _answers_of(told))

    return docs.groupBy("_batch").cogroup(answers.groupBy("_batch")).applyInArrow(both, schema)


def answer(questions: DataFrame, number: int, fn: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Run ``fn`` for every bucket on what the batches ask; it returns one answer for each question, in their order."""
    def one(table: pa.Table) -> pa.Table:
        give_back()
        order = np.argsort(np.asarray(table.column("_batch")), kind="stable")
        table = table.take(pa.array(order))
        told = fn(table.column("payload").to_pylist())
        return pa.table({"_batch": table.column("_batch"), "_bucket": table.column("_bucket"),
                         "_round": pa.array(np.full(table.num_rows, number, np.int32)), "payload": pa.array(told, pa.binary())})
    return questions.groupBy("_bucket").applyInArrow(one, "_batch int, _bucket int, _round int, payload binary")


def bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask, bitorder="little").tobytes()


def unbits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n, bitorder="little").astype(bool)


class Shared:
    """Which hashes of a batch occur in more than one document of the table: a question per bucket, a bit per hash.

    A question holds 31 bits of each distinct hash (the bucket holds others) and whether two documents of the batch
    already have it. Two hashes that agree in those bits count as one: the answer may say "shared" too often, never too seldom.
    """

    def __init__(self, hashes: np.ndarray, doc: np.ndarray, buckets: int):
        """``hashes`` with the ``doc`` each occurs in; equal neighbours may be merged before."""
        order = np.argsort(hashes)
        h, d = hashes[order], doc[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        self.distinct = h[starts]
        self.many = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts) if len(h) else np.zeros(0, bool)
        self.index = np.empty(len(h), np.int64)
        self.index[order] = np.cumsum(new) - 1
        self.buckets = buckets
        self.bucket_of = ((self.distinct >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)

    def questions(self, batch: int) -> pa.Table:
        entry = (self.distinct.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | self.many.astype(np.uint32)
        return asked(batch, self.bucket_of, self.buckets, lambda at: entry[at].tobytes())

    def told(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each of the hashes, in the order they were given, whether another document has it too."""
        shared = np.zeros(len(self.distinct), bool)
        for bucket, at in by_bucket(self.bucket_of, self.buckets):
            shared[at] = unbits(answers[bucket], len(at))
        return shared[self.index]

    @staticmethod
    def answers(blobs: list[bytes]) -> list[bytes]:
        parts = [np.frombuffer(b, np.uint32) for b in blobs]
        entry = np.concatenate(parts)
        key = entry >> np.uint32(1)
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        many = np.logical_or.reduceat((entry[order] & np.uint32(1)).astype(bool), starts) | (sizes > 1)
        shared = np.empty(len(key), bool)
        shared[order] = np.repeat(many, sizes)
        return [bits(x) for x in np.split(shared, np.cumsum([len(p) for p in parts])[:-1])]


def doc_numbers(table: pa.Table) -> np.ndarray:
    """The documents' ids as numbers to compare; a null id is above all others."""
    ids = table.column("doc_id")
    return np.asarray(ids.fill_null(np.iinfo(np.int64).max).combine_chunks() if ids.num_chunks else pa.array([], pa.int64()))
