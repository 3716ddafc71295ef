"""Each stage against plain rules on a small table, and the whole."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from planloom.llm import decontaminate, near_copies, packing, simhash

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [decontaminate.plain(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        kept = stage(spark, docs, DATA)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert all(before[r["doc_id"]] == r for r in rows)
        ids = Counter(r["doc_id"] for r in rows)
        if name == "language":
            assert len(ids) >= 0.97 * len(before)
        if name == "near_duplicates":
            texts = Counter(r["text"] for r in before.values())
            assert len({r["text"] for r in rows}) == len(rows) >= 0.9 * len(texts)
        if name == "decontamination":
            def holds(r):
                words = decontaminate.plain(r["text"])
                return any(decontaminate.distance(p, words)[0] <= decontaminate.budget(len(p)) for p in items)
            assert set(ids) == {i for i, r in before.items() if not holds(r)}
        if name == "mixing":
            assert set(ids.values()) == {1, 2}
        else:
            assert set(ids.values()) == {1}
        docs = spark.createDataFrame(rows, docs.schema)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert Counter(r["doc_id"] for r in tokens) == Counter(r["doc_id"] for r in docs.collect())


def test_awkward_rows(spark):
    rows = [(None, "same words here again", "en", None, 1, "x"), (None, "same words here again", "en", None, 1, "x"), (1, None, None, None, None, None),
            (2, "", "en", "a", 0, "y"), (2, "Some other words under one id", "en", "a", 0, "y"), (2, "Some other words under one id", "en", "a", 0, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _found string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
    assert all(r["text"] for r in docs.collect())


def _shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _kept_by_force(rows):
    """Ids of the lowest document of each component of texts with equal sets or a Jaccard similarity of 0.8 or more."""
    sets, root = [_shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s or {()}:
            holders.setdefault(g, []).append(i)
    pairs = {(i, j) for h in holders.values() for n, i in enumerate(h) for j in h[n + 1:]}
    for i, j in pairs:
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)), key=lambda k: rows[k][0])
            root[b] = a
    return sorted(rows[i][0] for i in range(len(rows)) if top(i) == i)


def test_near_duplicates_by_force(spark):
    """Edited copies about the border of 0.8, of short and long texts, and shared phrases."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    phrase = rng.choices(vocabulary, k=12)
    rows = []
    for n in (1, 3, 5, 9, 14, 30, 60, 61, 150, 400):
        for _ in range(4):
            words = rng.choices(vocabulary, k=n)
            if n >= 30:
                words[5:17] = phrase
            rows.append(words)
            for edits in (1, 1, 2, 3, 5, n // 50 + 1, n // 40 + 1):
                copy = list(words)
                for _ in range(edits):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                rows.append(copy)
            rows += [words + [w] for w in rng.choices(vocabulary, k=3)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(9001, None), (9002, ""), (9003, " \n")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, DATA)
    assert sorted(r["doc_id"] for r in kept.collect()) == _kept_by_force(rows)


def test_prefixes_meet():
    """Whatever the order, two sets at the border share a shingle of their prefixes."""
    rng = np.random.default_rng(3)
    for n in range(1, 80):
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        for m in range(-(-4 * len(a) // 5), len(a) + 1):
            b = np.sort(rng.choice(a, m, replace=False))
            often = np.sort(rng.choice(a, len(a) // 2, replace=False))
            times = rng.integers(2, 9, len(often))
            if near_copies.similar(a, b):
                assert set(near_copies.prefix(a, often, times).tolist()) & set(near_copies.prefix(b, often, times).tolist())


def test_sketches_exclude_no_near_copy():
    """Pairs at the border, of equal and of unlike numbers of slots, pass; unrelated ones do not."""
    rng = np.random.default_rng(4)
    for n in (*range(1, 70), 129, 500, 513, 3000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        for m in {-(-8 * len(a) // 9), -(-4 * len(a) // 5), len(a)}:
            fresh = len(a) // 10
            b = np.union1d(rng.choice(a, m, replace=False), rng.integers(0, 1 << 62, fresh).astype(np.uint64))
            may = near_copies.may_be_similar(near_copies.sketch(a), len(a), near_copies.sketch(b), len(b))
            assert may or not near_copies.similar(a, b)
        other = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        if n >= 40:
            assert not near_copies.may_be_similar(near_copies.sketch(a), len(a), near_copies.sketch(other), len(other))
    none = np.zeros(0, np.uint64)
    assert near_copies.may_be_similar(near_copies.sketch(none), 0, near_copies.sketch(none), 0)


def test_near_duplicates_of_repeated_ids(spark):
    """Rows decide, not ids: texts that share an id are different documents, and a row that occurs twice is one."""
    one, other, third = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue black white grey")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    for rows, kept in (
        ([(1, one), (2, one), (2, other)], [(1, one), (2, other)]),
        ([(2, one), (2, other)], [(2, one), (2, other)]),
        ([(2, one), (2, one), (2, other), (3, other), (None, third), (None, third), (None, one)], [(2, one), (2, other), (None, third)]),
    ):
        found = stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), DATA).collect()
        assert Counter((r["doc_id"], r["text"]) for r in found) == Counter(kept)


def test_near_fingerprints_come_first(spark):
    """Pairs by SimHash of the same shingles: a long text, its copy with one word changed, equal sets in another form; they are checked like all others."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:1500], "other", *words[1501:]])), (3, "\n".join(words)), (4, " ".join(words[::-1]))]
    pairs = near_copies._near_prints(spark.createDataFrame(rows, "key bigint, text string")).collect()
    found = {frozenset(p) for p in pairs}
    assert all(p["a"] < p["b"] for p in pairs) and {frozenset((1, 3))} <= found and any(2 in p for p in found) and not any(4 in p for p in found)


def test_sketches_of_many_sets_exclude_the_same_pairs():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (1, 3, 60, 70, 130, 600, 0)]
    sets += [s[len(s) // 8:] for s in sets] + [s[len(s) // 4:] for s in sets]
    bits, n = [near_copies.sketch(s) for s in sets], np.array([len(s) for s in sets])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    found = near_copies._Sketches(near_copies.pa.array(bits, near_copies.pa.binary())).may_be_similar(a, b, n)
    assert found.tolist() == [near_copies.may_be_similar(bits[i], n[i], bits[j], n[j]) for i, j in zip(a, b)]


def test_pairs_that_are_no_near_copies_do_not_leave_their_bucket(spark):
    """A bucket of texts that share a phrase and little else gives no pairs, whatever its size."""
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 62, 100).astype(np.uint64)) for _ in range(60)]
    rows = [(1, i, 100, 0, i, bytearray(near_copies.sketch(s)), 1, [1]) for i, s in enumerate(sets)]
    entries = spark.createDataFrame(rows, "h bigint, key bigint, n int, at int, root bigint, bits binary, shingle bigint, shared array<bigint>")
    assert near_copies._candidates(entries, False).count() == 0


def test_pairs_are_given_in_the_bucket_of_their_lowest_shared_shingle():
    shared = [[1, 3, 5], [1, 3, 5], [3, 5], [7]]
    a, b = np.array([0, 0, 1, 2]), np.array([1, 2, 2, 3])
    given = [near_copies._lowest_shared([h] * 4, shared, a, b).tolist() for h in (1, 3, 5)]
    assert given == [[True, True, True, True], [False, True, True, True], [False, False, False, True]]


def test_only_entries_with_a_partner_are_described(spark, monkeypatch):
    """Texts put together from the same passages meet in many buckets; what is many times an entry is added to none of theirs."""
    rng = random.Random(9)
    passages = [[f"p{i}w{j}" for j in range(40)] for i in range(12)]
    rows = [(i, " ".join(w for p in rng.sample(passages, 3) for w in p)) for i in range(40)]
    rows += [(100 + i, text + " more") for i, text in rows[:5]]
    met, given, described = [], [], near_copies._described
    entries_of = near_copies._entries
    monkeypatch.setattr(near_copies, "_entries", lambda rows: met.append(entries_of(rows).count()) or entries_of(rows))
    monkeypatch.setattr(near_copies, "_described", lambda entries, sketches: given.append(entries.count()) or described(entries, sketches))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, DATA)
    assert sorted(r["doc_id"] for r in kept.collect()) == _kept_by_force(rows)
    assert met[0] > 5 * len(rows) and given == [0]


def test_near_copies_are_partners_in_all_their_buckets(spark):
    rng = np.random.default_rng(10)
    a, other = (np.unique(rng.integers(0, 1 << 62, 200).astype(np.uint64)) for _ in range(2))
    sets = {1: a, 2: a[5:], 3: other, 4: a[3:]}
    root = {1: 1, 2: 2, 3: 3, 4: 1}
    rows = [(h, k, len(sets[k]), 0, root[k], 50 + h) for h, keys in ((5, (1, 2, 3)), (7, (1, 2)), (8, (1, 3)), (9, (1, 4)), (10, (2,))) for k in keys]
    entries = spark.createDataFrame(rows, "h bigint, key bigint, n int, at int, root bigint, shingle bigint")
    sketches = spark.createDataFrame([(k, len(s), bytearray(near_copies.sketch(s))) for k, s in sets.items()], "key bigint, n int, bits binary")
    found = near_copies._partnered(entries, sketches).collect()
    assert sorted((r["h"], r["key"], r["shingle"]) for r in found) == [(5, 1, 55), (5, 2, 55), (7, 1, 57), (7, 2, 57)]


def test_groups_are_held_by_bytes():
    """Wide rows: whole groups in order, no table of much more than the bytes asked for."""
    keys = np.repeat(np.arange(100), 10)
    batch = pa.record_batch([pa.array(keys), pa.array([b"x" * 1000] * len(keys))], ["k", "v"])
    tables = list(packing.in_groups((batch.slice(lo, 7) for lo in range(0, len(keys), 7)), "k", 1 << 20, 50_000))
    assert np.concatenate([np.asarray(packing.column(t, "k")) for t in tables]).tolist() == keys.tolist()
    assert sum(len(set(t.column("k").to_pylist())) for t in tables) == 100 and max(t.nbytes for t in tables) < 60_000


def _largest_handed(rows):
    """Bytes of the largest batch that a worker gets of a table."""
    def run(batches):
        yield pa.record_batch([pa.array([max(b.nbytes for b in batches)])], ["n"])
    return rows.mapInArrow(run, "n bigint").agg({"n": "max"}).first()[0]


def test_stages_hand_over_few_bytes_at_a_time(spark):
    batch_bytes = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 6000, 1, 1).selectExpr("id doc_id", "repeat(concat('word', id, ' '), 200) text", "'en' lang", "'a' source", "1 n_chars")
    before = spark.conf.get(batch_bytes)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(batch_bytes, "64m")
            stage(spark, docs.limit(20), DATA)
            assert 1 << 20 < _largest_handed(docs) < 5 << 19, name
    finally:
        spark.conf.set(batch_bytes, before)


def test_contamination_does_not_depend_on_batches(spark):
    items = spark.range(0, 40).selectExpr("id item_id", "concat_ws(' ', transform(sequence(1, 20), i -> concat('w', id, 'x', i))) text")
    filled = "repeat(concat('filler', id, ' '), 300)"
    docs = spark.range(0, 3000, 1, 1).selectExpr("id doc_id", f"concat({filled}, concat_ws(' ', transform(sequence(1, if(id % 50 = 7, 20, 9)), i -> concat('w', id % 40, 'x', i)))) text")
    batch_bytes = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(batch_bytes)
    try:
        for size in ("64m", "300k"):
            spark.conf.set(batch_bytes, size)
            found = decontaminate.contaminated(docs, items).collect()
            assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in found) == [(i, i % 40, 0) for i in range(7, 3000, 50)]
    finally:
        spark.conf.set(batch_bytes, before)


def test_batches_are_joined():
    batch = pa.record_batch([pa.array(range(1000)), pa.array(["some text"] * 1000)], ["k", "t"])
    parts = [batch.slice(lo, 10) for lo in range(0, 1000, 10)]
    out = list(packing.joined(iter(parts), 5000))
    assert pa.Table.from_batches(out).combine_chunks() == pa.Table.from_batches([batch])
    assert len(out) < 50 and all(5000 <= b.nbytes < 6000 for b in out[:-1])
    assert [b.num_rows for b in packing.joined(iter(parts[:3]), 1)] == [10, 10, 10]
    assert list(packing.joined(iter([]), 1)) == []


def test_components_of_a_large_group_are_whole(spark, monkeypatch):
    """Pairs that others connect already need no comparison: with crowded buckets and few named shingles the components are those of all pairs."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    monkeypatch.setattr(near_copies, "_NAMED", 3)
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []
    for n, size in ((110, 90), (60, 30)):
        words = rng.choices(vocabulary, k=n)
        for _ in range(size):
            copy = list(words)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(n)] = rng.choice(vocabulary)
            rows.append(copy)
        rows += [words[:30] + rng.choices(vocabulary, k=n - 30) for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    rng.shuffle(rows)
    found = near_copies.near_copies(spark.createDataFrame(rows, "key bigint, text string")).collect()
    assert sorted(r["key"] for r in found) == list(range(len(rows)))
    lowest = {}
    for r in found:
        lowest[r["root"]] = min(r["key"], lowest.get(r["root"], len(rows)))
    kept = _kept_by_force(rows)
    assert sorted(lowest.values()) == kept and 30 < len(kept) < len(rows) - 60
