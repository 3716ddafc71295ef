"""Quality classification by co-training of two views.

The text view sees hashed words and measures of form (capitals, marks, digits, repetition, lengths); the metadata view sees source,
language and recorded length. Both are logistic regressions that begin on a bounded labelled sample. The features of all rows are
written once. In each round one pass over them scores every document outside that sample with both views, labelled or not; those that a view is sure of become
evidence for the other view, all of them: they are summed by cells of how sure either view is, and the other view learns from the mean
of each cell, weighted by its documents. Sums are whole numbers, so that reruns agree. Both views are then calibrated and joined on
labelled documents that neither has learned from; the joined score is given to every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from planloom.llm.packing import U64, buffer_of, handed, hashes_of, tidy, words_of
from planloom.session import staged

#: Bound of the labelled sample that the views begin with.
LABELLED = 4000
ROUNDS = 4
#: A view hands on documents whose probability of a class is at least so much.
SURE = 0.95
#: What the documents handed on weigh in all, as a share of the labelled ones of their class, whatever their number.
TRUST = 0.5
#: Borders of the cells of a view's probability.
EDGES = np.array([1 - 0.99, 1 - SURE, 0.2, 0.5, 0.8, SURE, 0.99])
WORD_BITS = 10
META_BITS = 12
_FORM = 10
_STEPS = 120
_CHUNK_BYTES = 8 << 20
_TEXT, _META, _SLOTS = (1 << WORD_BITS) + _FORM, 1 << META_BITS, 3
#: Feature values are summed as multiples of one in so many.
_UNIT = 1 << 16
#: A half-precision number holds no more; only the mean length of words of some 400,000 bytes comes near.
_MOST = 60_000
#: Partial sums of a cell meet in so many tasks before they meet in one.
_SALTS = 64


def _share(hit: np.ndarray, owner: np.ndarray, n: int, whole: np.ndarray) -> np.ndarray:
    return np.bincount(owner[hit], minlength=n) / np.maximum(whole, 1)


def text_features(texts: pa.Array) -> np.ndarray:
    """Rows of hashed word shares and measures of form."""
    offsets, data = buffer_of(texts)
    n = len(texts)
    first, distinct, index = words_of(offsets, data)
    size = np.diff(offsets)
    words = np.diff(first)
    raw = np.frombuffer(data, np.uint8)
    owner = np.repeat(np.arange(n), size)
    of = np.repeat(np.arange(n), words)
    lowered = hashes_of(pa.array([w.lower() for w in distinct.to_pylist()], pa.binary()))
    slot = (lowered >> U64(64 - WORD_BITS)).astype(np.int64)[index] if len(index) else np.zeros(0, np.int64)
    hashed = np.bincount(of << WORD_BITS | slot, minlength=n << WORD_BITS).reshape(n, 1 << WORD_BITS)
    hashed = np.sqrt(hashed / np.maximum(words, 1)[:, None])
    upper = (raw >= 65) & (raw <= 90)
    digit = (raw >= 48) & (raw <= 57)
    letter = upper | (raw >= 97) & (raw <= 122) | (raw >= 128)
    mark = ~letter & ~digit & (raw > 32)
    again = np.zeros(len(index), bool)
    if len(index):
        again[1:] = (index[1:] == index[:-1]) & (of[1:] == of[:-1])
    pair = np.unique(of * max(1, len(distinct)) + index) // max(1, len(distinct)) if len(index) else np.zeros(0, np.int64)
    variety = np.bincount(pair, minlength=n) / np.maximum(words, 1)
    form = [_share(x, owner, n, size) for x in (upper, digit, mark, raw == 10)]
    form += [_share(again, of, n, words), variety, np.log1p(size) / 10, np.log1p(words) / 10, size / np.maximum(words, 1) / 20,
             (words == 0).astype(float)]
    return np.concatenate([hashed, np.stack(form, axis=1) * 3], axis=1).astype(np.float32)


def meta_slots(source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Rows of three slots: hashed source, language and length class; nulls are classes of their own."""
    n = len(source)
    length = np.asarray(pc.fill_null(n_chars.cast(pa.int64()), -1))
    classes = np.where(length < 0, -1, np.log2(np.maximum(length, 0) + 1.0).astype(np.int64))
    out = np.zeros((n, _SLOTS), np.int32)
    for seed, values in enumerate((source, lang, pa.array(classes.astype(str)))):
        names = pc.fill_null(values.cast(pa.string()), "\0null").cast(pa.binary()).dictionary_encode()
        slot = (hashes_of(names.dictionary, seed + 1) >> U64(64 - META_BITS)).astype(np.int32)
        if n:
            out[:, seed] = slot[np.asarray(names.indices)]
    return out


def meta_features(slots: np.ndarray) -> np.ndarray:
    """The slots as counts."""
    out = np.zeros((len(slots), _META), np.float32)
    np.add.at(out, (np.arange(len(slots))[:, None], slots), 1)
    return out


class Regression:
    """Logistic regression with classes of equal weight, fitted by full-batch Adam; features are centred. Rows may carry weights."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1e-3):
        weight = np.ones(len(y)) if weight is None else weight
        used = np.flatnonzero(x.any(0))  # a column without a value learns nothing
        mean = np.average(x[:, used], axis=0, weights=weight).astype(np.float32)
        width, x = x.shape[1], x[:, used] - mean
        of_class = np.array([max(1e-9, weight[y == c].sum()) for c in (0, 1)])
        weight = (0.5 * weight / of_class[y]).astype(np.float32)
        w, b = np.zeros(x.shape[1], np.float32), 0.0
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for step in range(1, _STEPS + 1):
            error = weight * (_sigmoid(x @ w + b) - y)
            g = np.append(x.T @ error + penalty * w, error.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = 0.15 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
            w, b = (w - move[:-1]).astype(np.float32), b - move[-1]
        self.w, self.b = np.zeros(width, np.float32), b - float(mean @ w)
        self.w[used] = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _line(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (and a constant, the last) of a small logistic regression by Newton steps, slightly penalized."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _sigmoid(x @ w)
        slope = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(slope, x.T @ (p - y) + 1e-2 * w)
    return w


def handed_on(cells: dict[int, tuple[int, np.ndarray]], view: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """What ``view`` (0 text, 1 metadata) teaches the other one: mean features of the other view, classes, and documents per cell.

    None unless the view is sure of some documents of either class, so that the shares of the classes do not drift.
    """
    rows = []
    for cell, (n, sums) in sorted(cells.items()):
        own = cell // (len(EDGES) + 1) if view == 0 else cell % (len(EDGES) + 1)
        p = np.append(EDGES, 1.0)[own]  # the upper border
        label = 0 if p <= 1 - SURE else 1 if own and EDGES[own - 1] >= SURE else None
        if label is not None:
            rows.append((label, n, (sums[_TEXT:] if view == 0 else sums[:_TEXT]) / (_UNIT * n)))
    if {label for label, _, _ in rows} != {0, 1}:
        return None
    return (np.array([x for _, _, x in rows], np.float32), np.array([label for label, _, _ in rows]),
            np.array([n for _, n, _ in rows], float))


def cells_of(text: np.ndarray, meta: np.ndarray, views: list[Regression]) -> np.ndarray:
    """The cell of each row: how sure the text view is, then the metadata view."""
    a, b = (np.searchsorted(EDGES, _sigmoid(view.logit(x).astype(float)), "right") for view, x in zip(views, (text, meta)))
    return a * (len(EDGES) + 1) + b


class CoTrained:
    """Both views, their calibrations and the weights of their sum."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, spare: np.ndarray,
                 pool: Callable[[list[Regression]], dict[int, tuple[int, np.ndarray]]]):
        """``spare`` marks labelled rows kept for calibration; ``pool`` gives the sums of the unlabelled rows by cells of two views."""
        learn = ~spare
        views = [text, meta]
        self.views = [Regression(v[learn], y[learn]) for v in views]
        for _ in range(ROUNDS):
            cells = pool(self.views)
            taught = [handed_on(cells, 1 - own) for own in (0, 1)]
            if taught == [None, None]:
                break
            self.views = [self._fitted(v[learn], y[learn], more) for v, more in zip(views, taught)]
        logits = [view.logit(v[spare]) for view, v in zip(self.views, views)]
        self.lines = [_line(z[:, None], y[spare]) for z in logits]
        self.joint = _line(np.stack([z * w[0] + w[1] for z, w in zip(logits, self.lines)], axis=1), y[spare])

    @staticmethod
    def _fitted(x: np.ndarray, y: np.ndarray, more: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> Regression:
        if more is None:
            return Regression(x, y)
        means, label, n = more
        share = np.array([TRUST * (y == c).sum() / n[label == c].sum() for c in (0, 1)])
        return Regression(np.concatenate([x, means]), np.concatenate([y, label]), np.concatenate([np.ones(len(y)), n * share[label]]))

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view and the metadata view, and the joint one."""
        a, b = (view.logit(v) * w[0] + w[1] for view, v, w in zip(self.views, (text, meta), self.lines))
        return _sigmoid(a), _sigmoid(b), _sigmoid(a * self.joint[0] + b * self.joint[1] + self.joint[2])


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHUNK_BYTES)))
        to = min(to, at + 2000)
        yield batch.slice(at, to - at)
        at = to


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of written features."""
    return (_unpacked(batch.column("text"), np.float16, _TEXT).astype(np.float32),
            meta_features(_unpacked(batch.column("meta"), np.int32, _SLOTS)))


def featured(docs: DataFrame) -> DataFrame:
    """``doc_id, text, meta``: both views of each row of ``docs``, packed; written once, by one scan."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                       F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                       F.col("n_chars").cast("bigint").alias("n_chars"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                yield pa.record_batch([part.column("doc_id"), _packed(np.minimum(text_features(part.column("text")), _MOST).astype(np.float16)),
                                       _packed(meta_slots(*(part.column(c) for c in ("source", "lang", "n_chars"))))],
                                      ["doc_id", "text", "meta"])
    return staged(handed(rows).mapInArrow(run, "doc_id bigint, text binary, meta binary"), "features")


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``cell, salt, n, at, sums`` (packed places and whole numbers) added up by keys; a task holds one sum per cell and salt."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held = total.setdefault(tuple(row[k] for k in keys), [row["cell"], row["salt"], 0, np.zeros(_TEXT + _META, np.int64)])
                held[2] += row["n"]
                held[3][np.frombuffer(row["at"], np.int32)] += np.frombuffer(row["sums"], np.int64)
        yield _cell_rows(total.values())
    return rows.repartition(*keys).mapInArrow(run, _CELL)


_CELL = "cell int, salt int, n bigint, at binary, sums binary"


def _cell_rows(held) -> pa.RecordBatch:
    held = list(held)
    places = [np.flatnonzero(sums).astype(np.int32) for *_, sums in held]
    return pa.record_batch([pa.array([h[0] for h in held], pa.int32()), pa.array([h[1] for h in held], pa.int32()),
                            pa.array([h[2] for h in held], pa.int64()), pa.array([p.tobytes() for p in places], pa.binary()),
                            pa.array([h[3][p].tobytes() for h, p in zip(held, places)], pa.binary())], ["cell", "salt", "n", "at", "sums"])


def cell_sums(features: DataFrame, views: list[Regression], learned: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """Number and summed features of all documents by cell, but for the ids ``learned``; for the cells in which a view is sure."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                text, meta = _views(part.filter(pa.array(~np.isin(np.asarray(part.column("doc_id")), learned))))
                cell = cells_of(text, meta, views)
                for c in np.unique(cell).tolist():
                    if {c // (len(EDGES) + 1), c % (len(EDGES) + 1)} & _SURE_BINS:
                        held = total.setdefault(c, [c, 0, 0, np.zeros(_TEXT + _META, np.int64)])
                        mine = cell == c
                        held[2] += int(mine.sum())
                        held[3][:_TEXT] += np.rint(text[mine].astype(float) * _UNIT).astype(np.int64).sum(0)
                        held[3][_TEXT:] += np.rint(meta[mine].sum(0, dtype=float)).astype(np.int64) * _UNIT
        yield _cell_rows(total.values())
    parts = handed(features.where("doc_id is not null")).mapInArrow(run, _CELL).withColumn(
        "salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
    out = {}
    for r in _summed(_summed(parts, "cell", "salt"), "cell").collect():  # at most one row per cell
        sums = np.zeros(_TEXT + _META, np.int64)
        sums[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["sums"], np.int64)
        out[r["cell"]] = (r["n"], sums)
    return out


#: Bins of a probability that are sure.
_SURE_BINS = {i for i in range(len(EDGES) + 1) if i < len(EDGES) and EDGES[i] <= 1 - SURE or i and EDGES[i - 1] >= SURE}


def trained(features: DataFrame, labels: DataFrame) -> CoTrained | None:
    """Fit on at most ``LABELLED`` labelled documents, taken by a hash of the id, and all others; None without both classes."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.col("quality").cast("int")).alias("quality"))
    # at most so many are sent to where the features are
    some = staged(features.select("doc_id").distinct().join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED), "chosen")
    found = staged(features.join(F.broadcast(some), "doc_id").select("doc_id", "quality", "text", "meta").orderBy(
        F.xxhash64("doc_id"), F.xxhash64("text", "meta")).limit(LABELLED), "labelled").collect()
    found.sort(key=lambda r: (r["doc_id"], r["text"], r["meta"]))
    y = np.array([r["quality"] for r in found], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    text, meta = _views(pa.record_batch([pa.array([r[c] for r in found], pa.binary()) for c in ("text", "meta")], ["text", "meta"]))
    del found
    learned = np.unique([r["doc_id"] for r in some.select("doc_id").collect()])
    pool = lambda views: cell_sums(features, views, learned)
    spare = np.arange(len(y)) % 4 == 0
    if len(set(y[spare].tolist())) < 2 or len(set(y[~spare].tolist())) < 2:  # too few to keep some apart
        return CoTrained(np.tile(text, (2, 1)), np.tile(meta, (2, 1)), np.tile(y, 2), np.repeat([True, False], len(y)), pool)
    return CoTrained(text, meta, y, spare, pool)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text_score, meta_score, score, keep``: one row per row of ``docs`` (doc_id, text, source, lang, n_chars).

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad); of several labels of a document the better one counts. ``keep``: the joint
    score is one half or more.

    * Null texts are empty; null metadata are classes of their own; documents without id are scored but not learned from.
    * Without labels of both classes every score is one half, and all is kept.
    * Ties: a score of exactly one half is kept; a document on the border of a cell belongs to the higher one.
    * Texts of any length; repeated rows are scored alike; an empty table gives no rows; other columns are not looked at.
    """
    features = featured(docs)
    model = trained(features, labels)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                a, b, c = model.scores(*_views(part)) if model is not None else (np.full(part.num_rows, 0.5),) * 3
                yield pa.record_batch([part.column("doc_id"), *(pa.array(x.astype(float)) for x in (a, b, c)), pa.array(c >= 0.5)],
                                      ["doc_id", "text_score", "meta_score", "score", "keep"])

    return handed(features).mapInArrow(run, "doc_id bigint, text_score double, meta_score double, score double, keep boolean")
