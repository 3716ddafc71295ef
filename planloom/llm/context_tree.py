"""Byte language model by context-tree weighting, trained and applied with documents, contexts and words in buckets.

A text is lower-cased (A-Z) and closed by the byte 0xFF, which UTF-8 has not. Each byte is eight binary decisions; a decision's
node is (the last ``d`` bytes, the bits so far) for each depth ``d`` up to ``DEPTH``. Nodes hold counts of training documents, their
Krichevsky-Trofimov estimates are mixed over all depths by the weighting recursion, and a byte's probability is the product
of its eight mixed predictions.

1. Counts of all (context, byte) strings of all documents, per bucket of their last two context bytes.
2. Each such bucket builds its part of the tree, depth 2 and deeper. Depths 0 and 1 (at most 257 contexts of 255 nodes) are summed up
   from those.
3. Each bucket gives the log probability of each of its strings, dealt out again by hash.
4. Batches of documents ask for their distinct strings and words and add up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from planloom.llm.dealing import ASKED, ASKED_ARROW, answer, ask, asked, by_bucket, dealt, pieces, text_bytes
from planloom.llm.packing import U64, buffer_of, column, handed, hashes_of, mixed, pack, parts_of, unpack, words_of
from planloom.session import staged

DEPTH = 5
BATCH_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
TREE_BUCKETS = 256
END = 255
_KEY_BITS = 8 * (DEPTH + 1)
_TOP = 2  # depths below this are summed up over all buckets
_CHUNK_BYTES = 6 << 20
_LN2, _LOG10 = np.log(2.0), np.log(10.0)


def string_keys(offsets: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text and its end: context and byte as one number, latest context byte first; the text of each."""
    n = len(offsets) - 1
    pad = np.full(DEPTH, END, np.uint8)
    lens = np.diff(offsets)
    low = np.frombuffer(data.lower(), np.uint8)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # DEPTH end marks stand before each text; the first of those after a text is its end
    stream = np.full(len(low) + DEPTH * (n + 1), END, np.uint8)
    of = np.repeat(np.arange(n), lens)
    stream[np.arange(len(low)) + DEPTH * (of + 1)] = low
    full = len(stream)
    two = stream[1:].astype(np.int64) << 8 | stream[:-1]  # two[i]: bytes i + 1, i
    key = np.zeros(full - DEPTH, np.int64)
    for j in range(0, DEPTH - 1, 2):
        key = key << 16 | two[DEPTH - 2 - j:full - 2 - j]
    if DEPTH % 2:
        key = key << 8 | stream[:full - DEPTH]
    key = key << 8 | stream[DEPTH:]
    owner = np.repeat(np.arange(n, dtype=np.int32), lens + 1)
    place = np.arange(len(owner), dtype=np.int32) + (DEPTH - 1) * owner if full < 1 << 31 else (
        np.arange(len(owner)) + (DEPTH - 1) * owner.astype(np.int64))
    return key[place], owner


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """ln(Gamma(n + 1/2) / Gamma(1/2))."""
    return _stirling(n + 0.5) - 0.5 * np.log(np.pi)


def _stirling(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0: raised above 8 first."""
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift = np.where(small, shift + np.log(x), shift)
        x = np.where(small, x + 1, x)
    inv = 1 / x
    series = inv / 12 - inv ** 3 / 360 + inv ** 5 / 1260 - inv ** 7 / 1680
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability."""
    a, b = zeros.astype(float), ones.astype(float)
    return _log_gamma_half(a) + _log_gamma_half(b) - _stirling(a + b + 1)


def _bits_of(symbol: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The eight decisions of a byte: node and bit."""
    for j in range(8):
        yield (1 << j) | (symbol >> (8 - j)), (symbol >> (7 - j)) & 1


class _Level:
    """The nodes of one depth: key (context, node), counts, and the log of the weighted probability."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        """``below``: sum of the logs of the children, NaN at the deepest level."""
        self.key, self.zeros, self.ones = key, zeros, ones
        here = log_kt(zeros, ones)
        deepest = np.isnan(below)
        self.log = np.where(deepest, here, np.logaddexp(here, np.where(deepest, 0.0, below)) - _LN2)
        self.weight = np.where(deepest, 1.0, np.exp(here - _LN2 - self.log))
        self.one = (ones + 0.5) / (zeros + ones + 1.0)


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[order][starts], *(np.add.reduceat(v[order], starts) if len(key) else v for v in values))


def _levels(key: np.ndarray, count: np.ndarray) -> dict[int, _Level]:
    """The tree over strings with counts, from the deepest level up to depth ``_TOP``."""
    out: dict[int, _Level] = {}
    for depth in range(DEPTH, _TOP - 1, -1):
        context, symbol = key >> (8 * (DEPTH - depth) + 8), key & 255
        pair, n = _summed(context << 8 | symbol, count)
        nodes, zeros, ones = [], [], []
        for node, bit in _bits_of(pair & 255):
            nodes.append((pair >> 8) << 8 | node)
            zeros.append(np.where(bit == 0, n, 0))
            ones.append(np.where(bit == 1, n, 0))
        at, zero, one = _summed(np.concatenate(nodes), np.concatenate(zeros), np.concatenate(ones))
        if depth == DEPTH:
            below = np.full(len(at), np.nan)
        else:
            child = out[depth + 1]
            parent = (child.key >> 16) << 8 | child.key & 255
            below = np.bincount(np.searchsorted(at, parent), child.log, len(at))
        out[depth] = _Level(at, zero, one, below)
    return out


def _one(levels: dict[int, _Level], context: np.ndarray, node: np.ndarray, depth: int) -> np.ndarray:
    """Probability of a 1 at (context, node), mixed over the depths from ``depth`` down; a node never seen gives 1/2."""
    p = np.full(len(context), 0.5)
    for d in range(DEPTH, depth - 1, -1):
        level = levels[d]
        if not len(level.key):
            continue
        want = (context >> (8 * (DEPTH - d))) << 8 | node
        at = np.minimum(np.searchsorted(level.key, want), len(level.key) - 1)
        mix = level.weight[at] * level.one[at] + (1 - level.weight[at]) * p
        p = np.where(level.key[at] == want, mix, 0.5)
    return p


def _top(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """For (last byte, node): a and b such that ``a + b * p`` is the mixed probability, ``p`` being that of depth 2 and below."""
    key = np.array([r[0] for r in rows], np.int64)
    zeros, ones = (np.array([r[i] for r in rows], float) for i in (1, 2))
    below = np.array([r[3] for r in rows], float)
    one = _Level(key, zeros, ones, below)
    at, z, o, sums = _summed(key & 255, zeros, ones, one.log)
    root = _Level(at, z, o, sums)
    a, b = np.zeros(65536), np.ones(65536)
    a[key], b[key] = one.weight * one.one, 1 - one.weight
    w, k = np.full(256, 0.5), np.full(256, 0.5)
    w[root.key], k[root.key] = root.weight, root.one
    w, k = np.tile(w, 256), np.tile(k, 256)
    return w * k + (1 - w) * a, (1 - w) * b


def _logs(levels: dict[int, _Level], key: np.ndarray, top: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of the byte of each string."""
    context, symbol = key >> 8, key & 255
    last = key >> (_KEY_BITS - 8)
    out = np.zeros(len(key))
    for node, bit in _bits_of(symbol):
        at = last << 8 | node
        p = top[0][at] + top[1][at] * _one(levels, context, node, _TOP)
        out += np.log(np.where(bit == 1, p, 1 - p))
    return out / _LOG10


def held_out(doc_id: int | None, folds: int = 7, fold: int = 2) -> bool:
    """Whether a document is kept out of training: by the crc32 of its id as text; a null id is trained on."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def _packed_keys(key: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(key.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BITS // 8]).ravel()


def _unpacked_keys(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) * 8 // _KEY_BITS, 8), np.uint8)
    wide[:, :_KEY_BITS // 8] = raw.reshape(-1, _KEY_BITS // 8)
    return wide.view("<i8").ravel()


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order (packed, they compress), and the index of each."""
    coded = pa.array(key).dictionary_encode()
    found = np.asarray(coded.dictionary)
    order = np.argsort(found)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return found[order], rank[np.asarray(coded.indices)]


def _tree_bucket(key: np.ndarray) -> np.ndarray:
    return (mixed((key >> (_KEY_BITS - 16)).astype(U64)) % U64(TREE_BUCKETS)).astype(np.int64)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(hashes.astype(U64)) % U64(buckets)).astype(np.int64)


def _counted(table: pa.Table, train: np.ndarray, buckets: int) -> Iterator[pa.Table]:
    """Strings and words of some documents with their training counts, packed by bucket; round 0 strings, round 1 words."""
    offsets, data = buffer_of(column(table, "text"))
    key, owner = string_keys(offsets, data)
    distinct, index = _distinct(key)
    count = np.bincount(index[train[owner]], minlength=len(distinct))
    bucket = _tree_bucket(distinct)
    yield _kind(0, asked(0, bucket, TREE_BUCKETS, lambda at: pack(key=_packed_keys(distinct[at]), n=count[at].astype(np.uint32))))
    first, words, at = words_of(offsets, data.lower())
    names = hashes_of(words)
    of = np.repeat(np.arange(len(train)), np.diff(first))
    count = np.bincount(at[train[of]], minlength=len(words))
    names, count = names[count > 0], count[count > 0]
    yield _kind(1, asked(0, _bucket(names, buckets), buckets, lambda at: pack(key=names[at], n=count[at].astype(np.uint32))))


def _kind(number: int, questions: pa.Table) -> pa.Table:
    return questions.append_column("_round", pa.array(np.full(questions.num_rows, number, np.int32)))


_COUNTED = "_batch int, _bucket int, payload binary, _round int"


def _merged(blobs: list[bytes], strings: bool) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(b) for b in blobs]
    key = np.concatenate([_unpacked_keys(p["key"]) if strings else p["key"] for p in parts])
    return _summed(key, np.concatenate([p["n"] for p in parts]).astype(np.int64))


class Trained:
    """The model: tables of string probabilities and of word counts by bucket, and the word totals."""

    def __init__(self, strings: DataFrame, words: DataFrame, buckets: int, tokens: int, kinds: int):
        self.strings, self.words, self.buckets, self.tokens, self.kinds = strings, words, buckets, tokens, kinds


def trained(docs: DataFrame, total: int) -> Trained:
    """Count, build the tree and tabulate the probabilities of all strings that occur in ``docs``; held-out texts count nothing."""
    buckets = pieces(total, BUCKET_BYTES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part, n in parts_of(batch, 1, _CHUNK_BYTES):
                if held and size + n > _CHUNK_BYTES:
                    yield from flush(held)
                    held, size = [], 0
                held.append(part)
                size += n
        if held:
            yield from flush(held)

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        train = np.fromiter((not held_out(i) for i in table.column("doc_id").to_pylist()), bool, table.num_rows)
        for out in _counted(table, train, buckets):
            yield from out.combine_chunks().to_batches()

    rows = handed(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counted = rows.mapInArrow(count, _COUNTED)

    def merge(table: pa.Table) -> pa.Table:
        number, bucket = table.column("_round")[0].as_py(), table.column("_bucket")[0].as_py()
        key, n = _merged(table.column("payload").to_pylist(), number == 0)
        blob = pack(key=_packed_keys(key) if number == 0 else key, n=n)
        return pa.table({"_round": pa.array([number], pa.int32()), "_bucket": pa.array([bucket], pa.int32()),
                         "tokens": pa.array([int(n.sum()) if number else 0]), "kinds": pa.array([len(n) if number else 0]),
                         "payload": pa.array([blob], pa.binary())})

    counts = staged(counted.groupBy("_round", "_bucket").applyInArrow(
        merge, "_round int, _bucket int, tokens bigint, kinds bigint, payload binary"), "counts")
    ids = rows.select("doc_id").mapInArrow(_count_trained, "n bigint").agg(F.sum("n")).first()[0] or 0
    tokens, kinds = counts.agg(F.sum("tokens"), F.sum("kinds")).first()
    top = _top_of(counts)

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                p = unpack(blob)
                key = _unpacked_keys(p["key"])
                seen = p["n"] > 0
                logs = _logs(_levels(key[seen], p["n"][seen]), key, top)
                out = asked(0, _bucket(key, buckets), buckets, lambda at: pack(key=_packed_keys(key[at]), value=logs[at].astype(np.float32)))
                yield from out.to_batches()

    strings = staged(counts.where("_round = 0").select("payload").repartition(TREE_BUCKETS // 4, F.xxhash64("payload")).mapInArrow(tabulate, ASKED), "strings")
    # the end of each training document is a token of its own
    return Trained(strings, counts.where("_round = 1").select(F.lit(0).alias("_batch"), "_bucket", "payload"), buckets,
                   (tokens or 0) + ids, (kinds or 0) + (1 if ids else 0))


def _count_trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array([sum(not held_out(i) for i in batch.column(0).to_pylist())], pa.int64())], ["n"])


def _top_of(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Depths 0 and 1: sums over the contexts of depth 2, at most 256 x 255 rows."""
    def depth_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                p = unpack(blob)
                seen = p["n"] > 0
                level = _levels(_unpacked_keys(p["key"])[seen], p["n"][seen])[_TOP]
                parent = (level.key >> 16) << 8 | level.key & 255
                key, zeros, ones, logs = _summed(parent, level.zeros, level.ones, level.log)
                yield pa.record_batch([pa.array(key), pa.array(zeros), pa.array(ones), pa.array(logs)], ["key", "zeros", "ones", "log"])
    rows = counts.where("_round = 0").select("payload").mapInArrow(depth_two, "key bigint, zeros bigint, ones bigint, log double")
    return _top(rows.groupBy("key").agg(F.sum("zeros"), F.sum("ones"), F.sum("log")).orderBy("key").collect())


class _Batch:
    def __init__(self, table: pa.Table, buckets: int):
        offsets, data = buffer_of(column(table, "text"))
        self.n, self.buckets = len(offsets) - 1, buckets
        self.sizes = np.diff(offsets)
        key, self.owner = string_keys(offsets, data)
        self.key, self.index = _distinct(key)
        self.first, words, word = words_of(offsets, data.lower())
        # in an order of their own: a batch is read anew for its answers, and its rows may then come in another order
        self.names, place = np.unique(hashes_of(words), return_inverse=True)
        self.word = place[word]
        self.key_bucket, self.name_bucket = _bucket(self.key, buckets), _bucket(self.names, buckets)

    def questions(self, batch: int) -> pa.Table:
        strings = asked(batch, self.key_bucket, self.buckets, lambda at: _packed_keys(self.key[at]).tobytes())
        words = asked(batch, self.name_bucket, self.buckets, lambda at: self.names[at].tobytes())
        return pa.concat_tables([_kind(0, strings), _kind(1, words)])

    def scores(self, told: dict[int, dict[int, bytes]], tokens: int, kinds: int, trained_docs: int) -> list[np.ndarray]:
        logs = np.zeros(len(self.key))
        for bucket, at in by_bucket(self.key_bucket, self.buckets):
            logs[at] = np.frombuffer(told[0][bucket], np.float32)
        score = np.bincount(self.owner, logs[self.index], self.n)
        count = np.zeros(len(self.names), np.int64)
        for bucket, at in by_bucket(self.name_bucket, self.buckets):
            count[at] = np.frombuffer(told[1][bucket], np.int64)
        of = np.repeat(np.arange(self.n), np.diff(self.first))
        whole = tokens + kinds + 1
        base = np.bincount(of, np.log10((count + 1.0) / whole)[self.word], self.n) + np.log10((trained_docs + 1.0) / whole)
        known = np.bincount(of[count[self.word] > 0], minlength=self.n) + (trained_docs > 0)
        return [np.diff(self.first) + 1, known, base, score]


def scored(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``: one row per row of ``docs``.

    ``score`` is the model's log10 probability of the lower-cased text and its end; ``bits_per_byte`` is the code length of both per byte,
    where the end counts as one. ``base_score`` is that of single words with add-one counts.

    * Null and empty texts are an end alone. A null ``doc_id`` is trained on (``held_out`` false).
    * Repeated rows count as often as they occur. Without training documents every decision has probability 1/2.
    * Texts of any length; an empty table gives no rows; other columns are not looked at.
    """
    total = text_bytes(docs)
    model = trained(docs, total)
    rows = dealt(docs, pieces(total, BATCH_BYTES))
    ends = rows.select("doc_id").mapInArrow(_count_trained, "n bigint").agg(F.sum("n")).first()[0] or 0
    tokens, kinds, buckets = model.tokens, model.kinds, model.buckets

    def questions(batch: int, table: pa.Table, _) -> pa.Table:
        return _Batch(table, buckets).questions(batch)

    def finish(batch: int, table: pa.Table, told) -> pa.Table:
        b = _Batch(table, buckets)
        n, known, base, score = b.scores(told, tokens, kinds, ends)
        ids = table.column("doc_id")
        return pa.table({"doc_id": ids, "held_out": pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()),
                         "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)),
                         "train_tokens": pa.array(np.full(b.n, tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(score),
                         "bits_per_byte": pa.array(-score / np.log10(2) / (b.sizes + 1))})

    asks = ask(rows, None, questions, _COUNTED)
    told = _told(asks, model)
    return ask(rows, told, finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                                   "base_score double, score double, bits_per_byte double")


def _told(asks: DataFrame, model: Trained) -> DataFrame:
    """Values of the strings and words that the batches ask for; a word that was never trained on has the count 0."""
    table = model.strings.withColumn("_round", F.lit(0)).unionByName(model.words.withColumn("_round", F.lit(1)))

    def look_up(questions: pa.Table, values: pa.Table) -> pa.Table:
        number = (questions if questions.num_rows else values).column("_round")[0].as_py()
        name = "n" if number else "value"
        kind = np.int64 if number else np.float32
        parts = [unpack(b) for b in values.column("payload").to_pylist()]
        key = np.concatenate([p["key"] if number else _unpacked_keys(p["key"]) for p in parts] or [np.zeros(0, U64 if number else np.int64)])
        value = np.concatenate([p[name] for p in parts] or [np.zeros(0, kind)]).astype(kind)
        order = np.argsort(key)
        key, value = key[order], value[order]
        told = []
        for blob in questions.column("payload").to_pylist():
            want = np.frombuffer(blob, U64) if number else _unpacked_keys(np.frombuffer(blob, np.uint8))
            at = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
            told.append((np.where(key[at] == want, value[at], 0) if len(key) else np.zeros(len(want))).astype(kind).tobytes())
        return pa.table({"_batch": questions.column("_batch"), "_bucket": questions.column("_bucket"),
                         "_round": questions.column("_round"), "payload": pa.array(told, pa.binary())})

    return asks.groupBy("_round", "_bucket").cogroup(table.groupBy("_round", "_bucket")).applyInArrow(
        look_up, "_batch int, _bucket int, _round int, payload binary")
