"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word (and the space after it) forwards and backwards and gives every position a
distribution over the learned languages; its state starts anew with each word, so that a position's label depends on its word
alone and each distinct word of a batch is read once, however often it occurs. A document's probabilities are the mean over all its
positions. Training is backpropagation through time in numpy on a bounded sample of words of labelled documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from planloom.llm.packing import buffer_of, give_back, handed, joined, tidy, words_of
from planloom.session import staged

#: Bounds of the sample that the network is fitted on, for each language: labelled documents, and distinct words of those.
SAMPLE_DOCS = 3000
SAMPLE_WORDS = 6000
HIDDEN = 20
EMBEDDED = 12
EPOCHS = 6
BATCH = 128
RATE = 0.01
SEGMENT = 48
UNKNOWN = "und"
_CHUNK_BYTES = 4 << 20
_AT_ONCE = 2048
_SEED = 11


def held_out(doc_id: int | None, folds: int = 3, fold: int = 1) -> bool:
    """Whether a document is kept out of training: by the crc32 of its id as text; a null id may be trained on."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def segments(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words with the space that ends them, cut at ``SEGMENT`` bytes; the word of each segment."""
    out, of = [], []
    for i, w in enumerate(words):
        w += b" "
        for at in range(0, len(w), SEGMENT):
            out.append(w[at:at + SEGMENT])
            of.append(i)
    return out, np.array(of, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """One gated recurrent layer in each direction, and a softmax on both states of each position."""

    def __init__(self, languages: list[str]):
        rng, h, n = np.random.default_rng(_SEED), HIDDEN, len(languages)
        self.languages = languages
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": normal(256, EMBEDDED) * 4, "out": normal(2 * h, n), "out_bias": np.zeros(n, np.float32)}
        for d in "fb":
            self.p |= {f"{d}_in": normal(EMBEDDED, 3 * h), f"{d}_bias": np.zeros(3 * h, np.float32), f"{d}_gates": normal(h, 2 * h),
                       f"{d}_new": normal(h, h)}

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States at each position of byte rows ``x`` (rows, length); ``keep`` gets what the way back needs."""
        p, h = self.p, HIDDEN
        table = p["embed"] @ p[f"{d}_in"] + p[f"{d}_bias"]
        state = np.zeros((len(x), h), np.float32)
        out = np.empty((x.shape[1], len(x), h), np.float32)
        steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        for t in steps:
            a = table[x[:, t]]
            gates = _sigmoid(a[:, :2 * h] + state @ p[f"{d}_gates"])
            update, reset = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h:] + (reset * state) @ p[f"{d}_new"])
            if keep is not None:
                keep.append((t, state, update, reset, new))
            state = state + update * (new - state)
            out[t] = state
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(length, rows, languages) of byte rows."""
        return _softmax(np.concatenate([self._run(x, "f"), self._run(x, "b")], axis=2) @ self.p["out"] + self.p["out_bias"])

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean cross entropy of all positions, by backpropagation through time."""
        p, h, g = self.p, HIDDEN, {}
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, d, kept[d]) for d in "fb"], axis=2)
        error = _softmax(both @ p["out"] + p["out_bias"])
        error[:, np.arange(len(y)), y] -= 1
        error *= (weight / weight.sum() / x.shape[1])[None, :, None]
        flat = error.reshape(-1, error.shape[2])
        g["out"], g["out_bias"] = both.reshape(len(flat), -1).T @ flat, flat.sum(0)
        back = error @ p["out"].T
        g["embed"] = np.zeros_like(p["embed"])
        for side, d in enumerate("fb"):
            table = np.zeros((256, 3 * h), np.float32)
            gates_g, new_g = np.zeros_like(p[f"{d}_gates"]), np.zeros_like(p[f"{d}_new"])
            carry = np.zeros((len(x), h), np.float32)
            for t, state, update, reset, new in reversed(kept[d]):
                ds = carry + back[t, :, side * h:(side + 1) * h]
                dn = ds * update * (1 - new * new)
                du = ds * (new - state) * update * (1 - update)
                through = dn @ p[f"{d}_new"].T
                dr = through * state * reset * (1 - reset)
                dg = np.concatenate([du, dr], axis=1)
                new_g += (reset * state).T @ dn
                gates_g += state.T @ dg
                carry = ds * (1 - update) + through * reset + dg @ p[f"{d}_gates"].T
                np.add.at(table, x[:, t], np.concatenate([dg, dn], axis=1))
            g |= {f"{d}_gates": gates_g, f"{d}_new": new_g, f"{d}_bias": table.sum(0), f"{d}_in": p["embed"].T @ table}
            g["embed"] += table @ p[f"{d}_in"].T
        return g


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def _rows(parts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Segments of one length at a time: their places and their bytes as rows."""
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    for n in np.unique(lens).tolist():
        at = np.flatnonzero(lens == n)
        for lo in range(0, len(at), _AT_ONCE):
            some = at[lo:lo + _AT_ONCE]
            yield some, np.frombuffer(b"".join([parts[i] for i in some.tolist()]), np.uint8).reshape(-1, n)


def fit(sample: list[tuple[str, bytes, int]]) -> Network | None:
    """A network for (language, word, count) rows; None without any."""
    languages = sorted({r[0] for r in sample})
    if not languages:
        return None
    net = Network(languages)
    # every third word once more in capitals, which short samples hardly show
    sample = sample + [(r[0], r[1].decode(errors="replace").upper().encode(), 1) for r in sample[::3]]
    parts, of = segments([r[1] for r in sample])
    y = np.array([languages.index(sample[i][0]) for i in of])
    seen = np.sqrt(np.array([sample[i][2] for i in of], float))
    weight = seen / np.bincount(y, seen)[y]  # languages weigh the same
    rng = np.random.default_rng(_SEED)
    batches = [(x[lo:lo + BATCH], at[lo:lo + BATCH]) for at, x in _rows(parts) for lo in range(0, len(at), BATCH)]
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, steps = 0, EPOCHS * len(batches)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(batches)):
            x, at = batches[i]
            step += 1
            rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k, grad in net.gradients(x, y[at], weight[at].astype(np.float32)).items():
                mean[k] = 0.9 * mean[k] + 0.1 * grad
                square[k] = 0.999 * square[k] + 0.001 * grad * grad
                net.p[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    return net


def _chosen(train: DataFrame) -> DataFrame:
    """At most ``SAMPLE_DOCS`` distinct rows of each language, by a hash of id and text; only about so many are shuffled."""
    keyed = train.withColumn("_key", F.xxhash64("doc_id", "text"))
    share = staged(keyed.groupBy("lang").agg((F.lit(1.5 * SAMPLE_DOCS) / F.approx_count_distinct("_key")).alias("_share")), "shares")
    # the language of the largest number of rows would else be one task's
    some = keyed.join(share, "lang").where(F.shiftrightunsigned("_key", 11) / float(1 << 53) < F.col("_share"))
    ranked = some.dropDuplicates(["lang", "_key"]).withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_key")))
    return ranked.where(F.col("_rank") <= SAMPLE_DOCS).select("doc_id", "text", "lang")


def trained(docs: DataFrame) -> Network | None:
    """Fit on the training fold: words of at most ``SAMPLE_DOCS`` documents of each language, taken by a hash of their ids and texts."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    train = labelled.where("doc_id is null or pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1")
    words = _chosen(train).select("lang", F.explode(F.array_distinct(F.split("text", r"[\x20\x09-\x0D]+"))).alias("word")).where("word <> ''")
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    # frequent words first, the others by a hash
    order = Window.partitionBy("lang").orderBy(F.when(F.col("n") > 2, 0).otherwise(1), F.xxhash64("word", "lang"), "word")
    rows = counted.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= SAMPLE_WORDS)
    net = fit(sorted((r["lang"], r["word"].encode(), r["n"]) for r in rows.collect()))
    give_back()  # the driver lives on
    return net


def _pooled(net: Network, texts: pa.Array) -> np.ndarray:
    """(texts, languages): mean of the probabilities of all positions."""
    offsets, data = buffer_of(texts)
    first, distinct, index = words_of(offsets, data)
    parts, of = segments(distinct.to_pylist())
    k = len(net.languages)
    total = np.zeros((len(distinct), k + 1))
    for at, x in _rows(parts):
        p = net.probabilities(x).sum(0)
        for c in range(k):
            total[:, c] += np.bincount(of[at], p[:, c], len(distinct))
        total[:, k] += np.bincount(of[at], np.full(len(at), x.shape[1]), len(distinct))
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    sums = np.stack([np.bincount(owner, total[index, c], len(texts)) for c in range(k + 1)], axis=1)
    return sums[:, :k] / np.maximum(sums[:, k:], 1)


def predicted(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: one row per row of ``docs``; the network is fitted on their training fold if none is given.

    * ``und`` with score 0 for null texts, texts without a letter, and if no language could be learned.
    * Ties go to the first language by code point. A null ``doc_id`` is not held out. ``lang`` is read for training only.
    * Texts and words of any length; repeated rows are predicted alike; an empty table gives no rows; other columns are not looked at.
    """
    net = net or trained(docs)
    rows = handed(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches, _CHUNK_BYTES):
            ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHUNK_BYTES)))
                yield part(batch.slice(at, to - at))
                at = to

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, lettered = batch.column(0), np.asarray(batch.column(2))
        names, score = [UNKNOWN] * len(ids), np.zeros(len(ids))
        if net is not None:
            pooled = _pooled(net, batch.column(1))
            best = pooled.argmax(1)
            names = [net.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())]
            score = np.where(lettered, pooled[np.arange(len(ids)), best], 0.0)
        return pa.record_batch([ids, pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(names, pa.string()),
                                pa.array(np.clip(score, 0, 1))], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
