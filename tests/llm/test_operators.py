"""Operators against brute force on small tables: clean rows, and the awkward ones of ``AWKWARD``."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from planloom.llm import context_tree, decontaminate, language, mixing, phrases, quality, repeats, run_index, simhash, token_store
from planloom.llm.components import components
from planloom.llm.packing import pack
from planloom.llm.queries import QUERIES, tokenizer_path

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _batch string, fp string, payload int"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew a very strong potion at night"
AWKWARD = [
    (1, PASSAGE, "en", "a"), (2, PASSAGE, "en", "a"), (2, PASSAGE, "en", "a"), (3, "", "en", None), (4, None, None, "b"),
    (5, " \t\n", "de", "b"), (None, PASSAGE + " and then some more", "en", "a"), (None, None, None, None), (6, LONG, "en", "c"),
    (7, LONG[5000:], "fr", "c"), (8, "ab" * 40_000, "fr", "c"), (9, "Ça va? 42 &^%  x", "fr", "c"), (10, "12 34 56", "es", "d"),
    (11, "x " + PASSAGE.upper(), "en", "d"), (2, "another text under the same id", "en", "d"), (12, "<|endoftext|> a  b\r\n", "en", "d"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, l, s, None, "clash", "clash", 1) for i, t, l, s in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_rows(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def rank(i):
    return 1 << 63 if i is None else i


def brute_windows(rows, width, cut):
    """Which units of each row go, given how a text is cut into units."""
    cut_rows = [(i, cut(t)) for i, t in rows]
    low = {}
    for i, units in cut_rows:
        for p in range(len(units) - width + 1):
            k = units[p:p + width] if isinstance(units, bytes) else tuple(units[p:p + width])
            low[k] = min(low.get(k, rank(i)), rank(i))
    out = []
    for i, units in cut_rows:
        gone = np.zeros(len(units), bool)
        for p in range(len(units) - width + 1):
            k = units[p:p + width] if isinstance(units, bytes) else tuple(units[p:p + width])
            if low[k] < rank(i):
                gone[p:p + width] = True
        out.append((i, units, gone))
    return out


@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_op1_reads_back_every_document(request, spark, table):
    df = request.getfixturevalue(table)
    got = Counter(tuple(r) for r in token_store.stored_tokens(df, tokenizer_path(), shard_bytes=100_000, bucket_keys=20).collect())
    whole = Tokenizer.from_file(tokenizer_path())  # the library's own settings
    kept = [[i, np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4")] for i, t in plain_rows(df)]
    assert Counter((i, len(n), c) for i, _, n, c in ((r[0], r[1], range(r[2]), r[3]) for r in got.elements())) == Counter(
        (i, len(ids), zlib.crc32(ids.tobytes())) for i, ids in kept)
    at = 0
    for i, start, n, _ in sorted(got.elements(), key=lambda r: r[1]):
        assert start == at
        at += n
    keys = [rank(i) if i is not None else -1 for i, *_ in sorted(got.elements(), key=lambda r: r[1])]
    assert keys == sorted(keys)  # ascending, the null key first


def test_op1_refuses_unknown_keys(spark, docs, tmp_path):
    store = token_store.TokenStore.write(docs, f"file://{tmp_path}/store", tokenizer_path(), bucket_keys=20)
    asked = spark.createDataFrame([(5,), (10 ** 9,), (None,)], "doc_id bigint")
    assert [r["doc_id"] for r in store.read(asked).collect()] == [5]


def test_op1_encoder_equals_the_library():
    e = token_store.Encoder(tokenizer_path())
    rng = np.random.default_rng(2)
    letters = list("ab  \t\n\r\x0b\x1c\x85\xa0 　'sré1²!ñ中́\x02")
    texts = ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(3000)] + [LONG, "", "a\nb c", " a", "a "]
    texts += ["<|endoftext|>", "<|endoftext|> a", "a <|endoftext|>\nb  c", "a<|endoftext|", "x<|endoftext|><|endoftext|>y"]
    library = Tokenizer.from_file(tokenizer_path())
    assert library.encode("<|endoftext|> a", add_special_tokens=False).ids == [50256, 257]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, e.kind).tolist() for x in e.encode_all(pa.array(texts))] == want


def test_op1_perfect_hash_is_minimal():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    assert sorted(token_store.PerfectHash.of(values).slots(values).tolist()) == list(range(len(values)))


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    import xxhash
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_op2_components(request, table):
    df = request.getfixturevalue(table)
    rows = plain_rows(df)
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    low = defaultdict(list)
    for r, (i, _) in zip(root, rows):
        low[r] += [i] if i is not None else []
    want = Counter((i, format(f, "016x"), min(low[r], default=None)) for (i, _), f, r in zip(rows, fps, root))
    found = simhash.near_duplicates(df).select("doc_id", simhash.as_hex().alias("f"), "component_id")
    assert Counter(tuple(r) for r in found.collect()) == want


def test_op2_kernel_finds_all_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2 ** 64, 40, dtype=np.uint64)
    fps = np.concatenate([base ^ np.uint64(m) for m in (0, 1, 0b111, 0b1111 << 9, 0b11111 << 20)] * 3)
    fps ^= np.repeat(np.arange(3, dtype=np.uint64) << np.uint64(60), len(fps) // 3)
    group = np.sort(rng.integers(0, 3, len(fps)))
    got = set(zip(*(x.tolist() for x in simhash.near_links(fps, group))))
    assert got and got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps))
                           if group[i] == group[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}


def test_op2_crowded_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 3)
    classes = spark.createDataFrame([(1 << b,) for b in range(40)] + [((1 << 40) - 1,)], "fp bigint")
    roots = {r["node"]: r["root"] for r in components(simhash.near_pairs(classes), "a", "b").collect()}
    assert len(roots) == 40 and set(roots.values()) == {1}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(101)}, 400: 400, 500: 400}


@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_op3_against_a_plain_tree(request, table):
    df = request.getfixturevalue(table)
    df = df.where("doc_id < 12 or doc_id is null").where(F.coalesce(F.length("text"), F.lit(0)) < 3000)
    rows, got = plain_rows(df), context_tree.scored(df).collect()
    count, words, total = defaultdict(lambda: [0, 0]), Counter(), 0

    def nodes(text):
        s = b"\xff" * 5 + text.encode().lower() + b"\xff"
        for p in range(5, len(s)):
            for j in range(8):
                yield s[p - 5:p], (1 << j) | (s[p] >> (8 - j)), s[p] >> (7 - j) & 1
    for i, t in rows:
        if not context_tree.held_out(i):
            units = [*t.encode().lower().split(), None]
            words.update(units)
            total += len(units)
            for context, node, bit in nodes(t):
                for d in range(6):
                    count[context[5 - d:], node][bit] += 1
    children = defaultdict(list)
    for context, node in list(count):
        if context:
            children[context[1:], node].append((context, node))
    log, weight = {}, {}
    for k in sorted(count, key=lambda k: -len(k[0])):
        a, b = count[k]
        here = math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
        log[k], weight[k] = here, 1.0
        if len(k[0]) < 5:
            log[k] = float(np.logaddexp(here, sum(log[c] for c in children[k]))) - math.log(2)
            weight[k] = math.exp(here - math.log(2) - log[k])

    def score(text):
        out = 0.0
        for context, node, bit in nodes(text):
            p = 0.5
            for d in range(5, -1, -1):
                k = context[5 - d:], node
                p = weight[k] * (count[k][1] + .5) / (sum(count[k]) + 1) + (1 - weight[k]) * p if k in count else 0.5
            out += math.log10(p if bit else 1 - p)
        return out
    want = []
    for i, t in rows:
        units = [*t.encode().lower().split(), None]
        base = sum(math.log10((words[u] + 1) / (total + len(words) + 1)) for u in units)
        want.append((rank(i), context_tree.held_out(i), len(units), sum(words[u] > 0 for u in units), total, round(base, 5), score(t)))
    found = sorted((rank(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), r.score) for r in got)
    for a, b in zip(found, sorted(want), strict=True):
        assert a[:6] == b[:6] and abs(a[6] - b[6]) <= 1e-5 * abs(b[6]) + 1e-9
    bits = sorted((rank(r.doc_id), r.score, r.bits_per_byte) for r in got)
    size = defaultdict(set)
    for i, t in rows:
        size[rank(i)].add(len(t.encode()) + 1)
    assert all(any(abs(b * n * math.log10(2) + s) <= 1e-9 * abs(s) for n in size[i]) for i, s, b in bits)


def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_op4_distance():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = ([bytes([x]) for x in rng.integers(97, 100, rng.integers(1, 12)).tolist()] for _ in range(2))
        assert decontaminate.distance(a, b)[0] == slow_distance(a, b)


def test_op4_finds_edited_items(spark, awkward):
    words = PASSAGE.split()
    changed = [*words[:4], "purple", *words[5:11], *words[12:]]  # one changed, one left out
    extra = spark.createDataFrame([(20, "intro " + " ".join(changed) + " outro"), (21, " ".join(words[:9])), (None, " ".join(words).upper() + "!")],
                                  "doc_id bigint, text string")
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "12 34"), (5, LONG)], "item_id bigint, text string")
    rows = awkward.select("doc_id", "text").unionByName(extra)
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(rows, items).collect()}
    want = {}
    for i, t in plain_rows(rows):
        for j, item in ((1, PASSAGE), (4, "12 34")):
            p, w = decontaminate.plain(item), decontaminate.plain(t)
            if len(w) < 1000 and (d := slow_distance(p, w)) <= decontaminate.budget(len(p)):
                want[i, j] = min(d, want.get((i, j), 99))
    assert {k: v for k, v in got.items() if k[1] != 5} == want and (20, 1) in want and (21, 1) not in want
    assert got[6, 5] == 0 and (None, 1) in want


def test_op5_learns_and_handles_awkward_rows(spark, docs, awkward):
    net = language.trained(docs)
    found = language.predicted(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.9 * len(found)
    rows = language.predicted(awkward, net).collect()
    assert len(rows) == len(AWKWARD)
    assert all((r.lang_pred == "und") == (r.doc_id in (3, 4, 5, 10) or r.doc_id is None and r.score == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_op5_gradients():
    net = language.Network(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.random.default_rng(0).integers(0, 256, (3, 5))
    y, w = np.array([0, 1, 0]), np.ones(3)

    def loss():
        p = net.probabilities(x)
        return -np.log(p[:, np.arange(3), y]).mean()
    grad = net.gradients(x, y, w)
    for name in ("embed", "out", "f_gates", "b_new", "f_in", "b_bias"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-4
        high = loss()
        net.p[name][at] = keep - 1e-4
        low = loss()
        net.p[name][at] = keep
        assert abs((high - low) / 2e-4 - grad[name][at]) < 1e-3 * max(0.01, abs(grad[name][at]))


def test_op6_separates_labels(spark, docs, awkward):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality.scored(docs, labels).join(labels, "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in rows) >= 0.9 * len(rows)
    assert quality.scored(awkward, labels).count() == len(AWKWARD)
    assert all(r.keep and r.score == 0.5 for r in quality.scored(awkward, labels.limit(0)).collect())


def test_op6_cells_are_sums_over_all_other_rows(spark, docs, awkward):
    learned = np.array([2, 6, 40, 41, 42])
    features = quality.featured(docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        awkward.select("doc_id", "text", "lang", "source", "n_chars")))
    text, meta = (quality.Regression(np.eye(3, w, dtype=np.float32), np.array([0, 1, 1])) for w in (quality._TEXT, quality._META))
    rng = np.random.default_rng(1)
    text.w, meta.w = (rng.normal(0, 3, len(v.w)).astype(np.float32) for v in (text, meta))
    found = quality.cell_sums(features, [text, meta], learned)
    borders = quality.EDGES.tolist()
    want = {}
    for r in features.collect():
        if r["doc_id"] is None or r["doc_id"] in learned:
            continue
        x = np.frombuffer(r["text"], np.float16).astype(np.float32)
        z = np.zeros(quality._META, np.float32)
        for slot in np.frombuffer(r["meta"], np.int32):
            z[slot] += 1
        bins = [sum(b <= 1 / (1 + math.exp(-float(v.logit(q)))) for b in borders) for v, q in ((text, x), (meta, z))]
        if any(b <= 1 or b >= 6 for b in bins):
            n, sums = want.setdefault(bins[0] * 8 + bins[1], (0, np.zeros(quality._TEXT + quality._META)))
            want[bins[0] * 8 + bins[1]] = n + 1, sums + np.concatenate([x, z])
    assert {c: n for c, (n, _) in found.items()} == {c: n for c, (n, _) in want.items()}
    for c, (n, sums) in want.items():
        assert np.abs(found[c][1] / quality._UNIT - sums).max() <= n / quality._UNIT


def test_op6_a_round_teaches_the_other_view(spark):
    good, bad = "meadow river calm evening light", "click cheap offer winner prize"
    rng = random.Random(4)
    body = lambda words: " ".join(rng.choices(words.split(), k=40))
    rows = [(i, body(good if i % 2 else bad), "en", "seen", 200) for i in range(80)]
    rows += [(i, body(good), "en", "shelf", 200) for i in range(100, 160)] + [(i, body(bad), "en", "heap", 200) for i in range(200, 260)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id bigint, quality int")
    first, again = ([tuple(r) for r in quality.scored(docs, labels).orderBy("doc_id").collect()] for _ in range(2))
    assert first == again
    view = quality.trained(quality.featured(docs), labels).views[1]
    meta = {s: view.logit(quality.meta_features(quality.meta_slots(pa.array([s]), pa.array(["en"]), pa.array([200]))))[0]
            for s in ("seen", "shelf", "heap")}
    assert meta["shelf"] > 1 and meta["heap"] < -1 and abs(meta["seen"]) < 1  # no label names shelf or heap
    assert all(r[-1] == (r[0] % 2 == 1 if r[0] < 80 else r[0] < 200) for r in first)


def test_op6_weights_are_repetitions_and_calibration_is_the_minimum():
    rng = np.random.default_rng(2)
    x, y, times = rng.normal(size=(30, 4)).astype(np.float32), np.arange(30) % 2, rng.integers(1, 4, 30)
    one, other = quality.Regression(x, y, times.astype(float)), quality.Regression(np.repeat(x, times, axis=0), np.repeat(y, times))
    assert np.allclose(one.w, other.w, atol=1e-3) and abs(one.b - other.b) < 1e-3
    z = rng.normal(size=50) + (np.arange(50) % 2)
    t = np.arange(50) % 2

    def loss(w):
        return sum(math.log1p(math.exp(-(2 * k - 1) * (w[0] * v + w[1]))) for v, k in zip(z, t)) + 0.005 * (w[0] ** 2 + w[1] ** 2)
    best = quality._line(z[:, None], t)
    assert all(loss(best) <= loss(best + np.array(d)) for d in [(1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3), (1e-3, -1e-3)])


@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_op7_removes_repeated_bytes(request, table):
    df = request.getfixturevalue(table)
    if table == "docs":
        df = df.where("doc_id < 60")
    want = Counter()
    for i, raw, gone in brute_windows(plain_rows(df), 50, str.encode):
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = run_index.drop_repeated_bytes(df, batch_bytes=50_000, bucket_bytes=30_000)
    got = got.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert Counter(tuple(r) for r in got.collect()) == want


def test_op7_index_answers_every_window():
    rng = np.random.default_rng(7)
    for _ in range(10):
        base = rng.integers(97, 99, 500).astype(np.uint8).tobytes()
        cut = {base[a:a + n] for a, n in zip(rng.integers(0, 450, 40).tolist(), rng.integers(20, 50, 40).tolist())}
        cut = [s for s in cut if len(s) >= 20]
        low = rng.integers(0, 9, len(cut))
        index = run_index.RunIndex(np.frombuffer(b"".join(cut), np.uint8), np.array([len(s) for s in cut]), low, 20)
        first = {}
        for s, d in zip(cut, low.tolist()):
            for p in range(len(s) - 19):
                first[s[p:p + 20]] = min(d, first.get(s[p:p + 20], 99))
        assert index.lowest_documents().tolist() == [first[s[p:p + 20]] for s in cut for p in range(len(s) - 19)]


def _around_a_line(count):
    """Distinct passages that all hold a part of one line: whatever the string that deals them, many hold the line's."""
    rng = np.random.default_rng(11)
    line = rng.integers(97, 123, 60, dtype=np.uint8).tobytes()
    told = [rng.integers(97, 123, 60, dtype=np.uint8).tobytes() for _ in range(count)]
    cut = [(line[:12 + i % 49] + t)[:68] if i % 2 else (t + line[-12 - i % 49:])[-68:] for i, t in enumerate(told)]
    return [p for p in cut for _ in range(2)]


@pytest.mark.parametrize("window", [50, 20, 47])
def test_op7_crowded_bucket_gets_indexes_of_a_set_size(monkeypatch, window):
    monkeypatch.setattr(run_index, "INDEX_BYTES", 20_000)
    cut, built, index = _around_a_line(3000), [], run_index.RunIndex
    monkeypatch.setattr(run_index, "RunIndex", lambda data, *more: built.append(len(data)) or index(data, *more))
    docs = np.random.default_rng(12).integers(0, 500, len(cut))
    blobs = [pack(lens=np.array([len(p) for p in cut[k::4]], np.uint16), docs=docs[k::4], data=np.frombuffer(b"".join(cut[k::4]), np.uint8)) for k in range(4)]
    first = {}
    for p, d in zip(cut, docs.tolist()):
        for a in range(len(p) - window + 1):
            first[p[a:a + window]] = min(d, first.get(p[a:a + window], 500))
    for k, bits in enumerate(run_index._earlier(blobs, window)):
        want = [first[p[a:a + window]] < d for p, d in zip(cut[k::4], docs[k::4].tolist()) for a in range(len(p) - window + 1)]
        assert run_index.unbits(bits, len(want)).tolist() == want
    assert max(built) < 40_000


def test_op8_meets_targets(docs, awkward):
    for df in (docs, awkward):
        rows = mixing.mixed_copies(df).collect()
        assert len(rows) == df.count() and all(0 <= r.copies <= 2 for r in rows)
        texts = df.select("source", "text").collect()
        sizes = Counter()
        for r in texts:
            sizes[r["source"]] += len((r["text"] or "").encode().split())
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weights = dict(zip(names, [3, 1, 2] * len(names)))
        left, stopped = 1.5 * sum(sizes.values()), set()
        while True:
            level = left / max(1, sum(weights[s] for s in names if s not in stopped))
            over = [s for s in names if s not in stopped and weights[s] * level > 2 * sizes[s]]
            if not over:
                break
            for s in over:
                stopped.add(s)
                left -= 2 * sizes[s]
        want = Counter(round(2.0 * sizes[s] if s in stopped else weights[s] * level, 3) for s in names)
        got = {(r.source_size, round(r.target, 3)) for r in rows}
        assert {t for _, t in got} == set(want)
        taken = defaultdict(int)
        for r in rows:
            taken[r.source_size, r.target] += r.copies * r.size
        largest = max(r.size for r in rows)
        if df is docs:
            assert all(abs(v - t) <= 0.02 * t + 5 for (_, t), v in taken.items())
        else:
            assert all(abs(v - t) <= largest for (_, t), v in taken.items())
    again = mixing.mixed_copies(docs).select("doc_id", "copies").collect()
    assert Counter(again) == Counter(mixing.mixed_copies(docs).select("doc_id", "copies").collect())


@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_op9_removes_repeated_words(request, table):
    df = request.getfixturevalue(table)
    want = Counter()
    for i, words, gone in brute_windows(plain_rows(df), 13, lambda t: t.encode().split()):
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        want[i, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = repeats.drop_repeats(df, batch_bytes=100_000).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))
    assert Counter(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_op10_against_single_texts(request, table):
    df = request.getfixturevalue(table)
    got = phrases.edit_fingerprints(df, part_bytes=40_000).collect()
    hashed = {(r["doc_id"], r["text"] or ""): r["h"] for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    rows = sorted(plain_rows(df), key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r], r[1]))
    want = Counter()
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        e = phrases.edited(t, u)
        a, b, c = (phrases.fingerprints_of([x.encode()]) for x in (t, e, u))
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), a.tobytes(), b.tobytes(), float(phrases.likeness(a, b)[0]),
             float(phrases.likeness(a, c)[0])] += 1
    assert Counter((r[0], r[1], r[2], bytes(r[3]), bytes(r[4]), r[5], r[6]) for r in got) == want


def test_op10_equal_substrings_share_phrases():
    shared = LONG[:4000]
    a, b = phrases.fingerprints_of([("prefix " + shared).encode(), ("quite another start, " + shared).encode()])
    c = phrases.fingerprints_of([LONG[20_000:24_000].encode()])[0]
    assert phrases.likeness(a[None], b[None])[0] > 0.8 > 0.5 > phrases.likeness(a[None], phrases.fingerprints_of([PASSAGE.encode()]))[0]
    assert len(c) == phrases.SLOTS


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    for other in ("benchmark", "labels", "pages", "conversations"):
        spark.read.parquet(f"{DATA}/{other}.parquet").limit(0).write.parquet(f"{tmp_path}/{other}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


def test_language_of_few_documents_is_learned(spark):
    """A language of one or two documents has its own places in the sample, however many words another one has."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(13_000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=60)), "aa") for i in range(5000)]
    rows += [(i, " ".join("".join(rng.choices("uvwxyz", k=6)) for _ in range(40)), "zz") for i in range(5000, 5006)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = language.trained(docs)
    assert net.languages == ["aa", "zz"]
    found = {r["doc_id"]: r["lang_pred"] for r in language.predicted(docs.where("doc_id >= 4990"), net).collect()}
    assert all(name == ("zz" if i >= 5000 else "aa") for i, name in found.items())


def test_decontaminate_lowers_items_and_documents_alike(spark):
    """Capitals whose lower case depends on the function: a sigma that ends a word, an I with a dot."""
    items = [(1, "ΟΔΟΣ ΛΟΓΟΣ ΜΕΓΑΣ"), (2, "İSTANBUL İZMİR İKİ")]
    docs = [(i, f"some words {t} and more") for i, t in items] + [(3, "some words and more")]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in found.collect()) == [(1, 1, 0), (2, 2, 0)]


def _shuffled(texts: list[bytes], ids: list[int]) -> tuple[pa.Table, pa.Table]:
    """A batch as it is read for its questions, and again, in another order, for its answers."""
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.binary())})
    return table, table.take(pa.array(range(len(ids))[::-1]))


def test_context_tree_questions_do_not_depend_on_the_order_of_rows():
    asked, again = (context_tree._Batch(t, 3).questions(0).to_pylist() for t in _shuffled([b"one two three", b"two four", b"five one"], [1, 2, 3]))
    assert asked == again


def test_run_index_questions_do_not_depend_on_the_order_of_rows():
    rng = random.Random(3)
    shared = [bytes(rng.choice(b"abcdefgh ") for _ in range(90)) for _ in range(4)]
    texts = [shared[i % 4] + bytes([65 + i]) + shared[(i + 1) % 4] for i in range(6)]
    both = _shuffled(texts, list(range(6)))

    def asked(table):
        b = run_index._Batch(table, run_index.WINDOW, 2)
        q = b.seeds.questions(0).to_pylist()
        told = {r["_bucket"]: run_index.Shared.answers([r["payload"]])[0] for r in q}
        b = b.passages(told)
        return q, run_index.asked(0, b.bucket_of, 2, b.question).to_pylist()

    first, again = map(asked, both)
    assert first[1] and first == again


def test_near_links_of_one_word():
    """Buckets that fill no more than one word of 64 fingerprints."""
    fps = np.random.default_rng(12).integers(0, 1 << 62, 64).astype(np.uint64)
    fps[1] = fps[0] ^ np.uint64(5)
    for n in (2, 5, 64):
        assert [x.tolist() for x in simhash.near_links(fps[:n], np.zeros(n, np.int64))] == [[0], [1]]
