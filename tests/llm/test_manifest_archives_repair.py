"""Merkle manifests, WARC archives and conversation repair against plain re-writings, on given and on awkward rows."""

import base64
import hashlib
import io
import random
import re
import zlib

import pytest
import zstandard as zstd
from pyspark.sql import functions as F

from planloom.llm import merkle, repair, warc

DATA = "/root/testdata"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """All result rows of the manifest, by lists."""
    def show(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, more=0):
        return H(*[show(r[c] + more if c == "n_chars" and r[c] is not None else r[c]) for c in merkle.FIELDS])

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    def proof(levels, i):
        for level in levels[:-1]:
            yield i % 2, level[i ^ 1:][:1] if i ^ 1 < len(level) else []
            i //= 2
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    langs = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    for k in langs:
        by[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {k: climb([leaf(r) for r in by[k]]) for k in langs}
    top = climb([trees[k][-1][0] for k in langs])
    out = []
    for j, k in enumerate(langs):
        for i, r in enumerate(by[k]):
            way = [*proof(trees[k], i), *proof(top, j)]
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            x = leaf(r, int(hit))
            for odd, near in way:
                x = H(*near, x) if odd else H(x, *near)
            root = top[-1][0]
            out.append((r["doc_id"], leaf(r), trees[k][-1][0], root, H(*[s for _, near in way for s in near]), x, x == root))
    return sorted(out, key=str)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, path int"


def test_manifest_of_several_tiers(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    found = [tuple(r) for r in merkle.verified(docs).collect()]
    assert sorted(found, key=str) == plain_manifest(docs.collect())
    assert 0 < sum(not r[-1] for r in found) < len(found)


def test_manifest_of_awkward_rows(spark):
    rows = [(1, "a", "en", "s", 1, "clash", 1), (1, "a", "en", "s", 1, "clash", 1), (None, None, None, None, None, None, None),
            (2, "", "", None, None, "x", 0), (3, "é" * 300_000, "ü", "s", 9223372036854775807, "x", 0), (None, "b", "en", "t", 3, "x", 0),
            *((i, f"text {i % 3}", "en", "s", i, "x", 0) for i in range(40, 90))]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted((tuple(r) for r in merkle.verified(docs).collect()), key=str) == plain_manifest(docs.collect())
    assert merkle.verified(docs.where("doc_id > 1000")).collect() == []
    alone = merkle.verified(docs.where("doc_id = 3")).collect()
    assert len(alone) == 1 and alone[0]["leaf"] == alone[0]["root"] and alone[0]["proof_sha256"] == H()


def test_manifest_nodes_cover_their_leaves(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").where("lang = 'en'")
    below, above, _ = merkle.dataset_manifest(docs)
    nodes = below.nodes().collect()
    n = docs.count()
    for level in range(14):
        spans = sorted((r["lo"], r["hi"]) for r in nodes if r["level"] == level)
        assert spans == [(lo, min(n, lo + 2 ** level)) for lo in range(0, n, 2 ** level)]
    assert len({(r["level"], r["lo"]) for r in nodes}) == len(nodes) and above.nodes().count() == 1


# ---- archives

PAGES = "page_id bigint, url string, html string, sha1 string, keeper bigint, size int"


def plain_archive(rows, least=0):
    raw = [(r["page_id"], (r["html"] or "").encode()) for r in rows]
    most = {}
    for i, p in raw:
        if len(p) >= least and i is not None:
            most[p] = max(i, most.get(p, i))
    out = []
    for i, p in raw:
        again = p in most and most[p] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", most[p] if again else None))
    return sorted(out, key=str)


AWKWARD_PAGES = [(1, None, "a", "x", 3, 0), (2, "u", "a", "x", 3, 0), (None, "u", None, None, 1, 0), (3, "x\r\nWARC-Type: y", "", "", 1, 1),
                 (None, None, None, None, None, None), (2, "v", "a", "a", 1, 0), (5, "é", "é" * 200_000, "b", 0, 0), (7, "z", "\r\n\r\nHTTP/1.1\r\n", "b", 0, 0)]


@pytest.mark.parametrize("least", [0, 2])
def test_archives_of_awkward_pages(spark, least):
    pages = spark.createDataFrame(AWKWARD_PAGES * 2, PAGES)
    found = warc.archived(pages, least=least).drop("url").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_archive(pages.collect(), least)
    assert warc.archived(pages.where("page_id > 100")).collect() == []


def test_payloads_and_targets_come_back(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").repartition(3)
    warc.write_archives(pages, str(tmp_path / "out"))
    back = warc.read_archives(spark, str(tmp_path / "out")).collect()
    assert sorted((r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in back) == sorted(map(tuple, pages.collect()))
    # the archives are plain zstandard for any reader that is given the leading dictionary
    files = [f for f in (tmp_path / "out").glob("part-*") if f.stat().st_size]
    stored = sum(f.stat().st_size for f in files)
    assert stored < sum(len(r["html"].encode()) for r in pages.collect()) / 2
    for file in files:
        raw = file.read_bytes()
        size = int.from_bytes(raw[4:8], "little")
        assert int.from_bytes(raw[:4], "little") == warc.DICT_MAGIC
        dictionary = zstd.ZstdCompressionDict(zstd.ZstdDecompressor().decompress(raw[8:8 + size]))
        with zstd.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(raw[8 + size:]), read_across_frames=True) as reader:
            assert reader.read().count(b"WARC/1.1\r\n") == len(list(warc.archive_records(io.BytesIO(raw))))


def record(page=1, payload=b"<p>text</p>", **kind):
    return warc.record_of(page, "http://a.example/", payload, kind.get("refers_to"), kind.get("revisit", False))


def archive(records, dictionary=b""):
    used = {"dict_data": zstd.ZstdCompressionDict(dictionary)} if dictionary else {}
    packer = zstd.ZstdCompressor(write_checksum=True, **used)
    return warc.leading_frame(dictionary) + b"".join(packer.compress(r) for r in records)


def test_dictionaries_compressed_plain_and_missing():
    records = [record(i, f"<html><body><p class='a'>number {i * 7919 % 997} of many</p></body></html>".encode() * 3) for i in range(400)]
    dictionary = warc.dictionary_of(records, 4096)
    assert dictionary
    packed = archive(records, dictionary)
    plain = warc.DICT_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
    body = packed[8 + int.from_bytes(packed[4:8], "little"):]
    for raw in (packed, plain + body, archive(records), archive(records)[8:], b"".join(warc.archive_frames(iter(records)))):
        assert list(warc.archive_records(io.BytesIO(raw))) == records
    with pytest.raises(ValueError, match="damaged"):
        list(warc.archive_records(io.BytesIO(body)))  # frames that need a dictionary, without it
    with pytest.raises(ValueError, match="no dictionary"):
        list(warc.archive_records(io.BytesIO(warc.DICT_MAGIC.to_bytes(4, "little") + b"\4\0\0\0junk" + body)))


def test_damaged_archives_are_refused():
    raw = archive([record(1), record(2)])
    for cut in (len(raw) - 1, len(raw) - 20, 6):
        with pytest.raises(ValueError):
            list(warc.archive_records(io.BytesIO(raw[:cut])))
    with pytest.raises(ValueError, match="no frame"):
        list(warc.archive_records(io.BytesIO(raw + b"tail")))
    flipped = bytearray(raw)
    flipped[-6] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(warc.archive_records(io.BytesIO(bytes(flipped))))


@pytest.mark.parametrize("change, said", [
    (lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), "version"), (lambda r: r.replace(b"WARC-Date", b"WARC-Dote"), "warc-date"),
    (lambda r: r + b"x", "Content-Length"), (lambda r: r[:-5] + b"\r\n\r\n", "Content-Length"), (lambda r: r[:-4] + b"\r\nxy", "Content-Length"),
    (lambda r: r.replace(b"text</p>", b"tent</p>"), "block has another digest"),
    (lambda r: re.sub(rb"WARC-Block-Digest: \S+\r\n", b"", r).replace(b"text</p>", b"tent</p>"), "payload has another digest"),
    (lambda r: re.sub(rb"WARC-Block-Digest: \S+\r\n", b"", r).replace(b"Content-Length: 11", b"Content-Length: 12"), "its header says 12"),
    (lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: request"), "unexpected type"),
    (lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: revisit"), "revisit"), (lambda r: r.replace(b"urn:page:1", b"urn:page:x"), "record id"),
    (lambda r: r.replace(b"WARC-Date: ", b"WARC-Date "), "header line|warc-date|lower"), (lambda r: r.replace(b"\r\n\r\n", b"\r\n"), "no end"),
    (lambda r: r.replace(b"WARC-Type", b"WARC-Type: response\r\nWARC-Type"), "twice"), (lambda r: r.replace(b"HTTP/1.1", b"HTTX/1.1"), "digest|HTTP"),
])
def test_records_that_contradict_themselves_are_refused(change, said):
    assert warc.parsed(record())["payload"] == b"<p>text</p>"
    with pytest.raises(ValueError, match=said):
        warc.parsed(change(record()))


def test_a_revisit_keeps_digest_and_length():
    found = warc.parsed(record(4, b"abc" * 50, revisit=True, refers_to=9))
    assert (found["refers_to"], found["payload_bytes"], found["payload"]) == (9, 150, None)
    assert found["payload_digest"] == warc.base32_sha1(b"abc" * 50)


# ---- repair

def exhaustive(rows):
    """The cheapest edits among all, with at most two insertions."""
    best = None

    def follow(i, roles, cost, audit, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = cost, audit
        if inserted < 2:
            for x in "ua":
                follow(i, roles + x, cost + 5, audit + "I", inserted + 1)
        if i < len(rows):
            initial, fault = rows[i]
            follow(i + 1, roles, cost + 2, audit + "D", inserted)
            if fault not in (repair.BLANK, repair.DUPLICATE):
                more = 5 if fault == repair.TRUNCATED else 0
                follow(i + 1, roles + (initial or "?"), cost + more, audit + "K", inserted)
                for x in "ua":
                    follow(i + 1, roles + x, cost + 1 + more, audit + "R", inserted)
    follow(0, "", 0, "", 0)
    return best


def by_prefixes(rows):
    """The cheapest edits by the best prefix for each last role."""
    def wider(best):
        for _ in range(3):
            for last, (cost, audit) in list(best.items()):
                to = repair._next_role(last)
                best[to] = min(best.get(to, (1 << 60, "")), (cost + 5, audit + "I"))
        return best
    best = {0: (0, "")}
    for row in rows:
        following = {}
        for last, (cost, audit) in wider(best).items():
            for letter, to, more in repair._edits(last, row):
                following[to] = min(following.get(to, (1 << 60, "")), (cost + more, audit + letter))
        best = following
    best = wider(best)
    return min(best[last] for last in (0, 3) if last in best)


def test_search_finds_the_cheapest_edits():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(rng.choice(["s", "u", "a", "x", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(6))]
        assert repair.search(rows) == exhaustive(rows) == by_prefixes(rows)


def test_blocks_compose_to_the_same_edits():
    rng = random.Random(2)
    for kinds in ("suax", "uuu", "a", "s", "ua"):
        for _ in range(40):
            rows = [(rng.choice(kinds), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 200))]
            size = rng.randrange(1, 50)
            blocks = [rows[i:i + size] for i in range(0, len(rows), size)]
            cost, pieces = repair.composed([[repair.search(b, x, [y], False) for x in range(4) for y in range(4)] for b in blocks])
            assert (cost, "".join(a for _, a in pieces)) == by_prefixes(rows)


TURNS = "conv_id bigint, turn bigint, role string, text string, step int, _seen string"


def plain_repair(rows):
    """Result rows by loops, with damage."""
    by = {}
    for r in rows:
        show = lambda v: " " if v is None else str(v)
        how = zlib.crc32(f"{show(r['conv_id'])}:{show(r['turn'])}".encode()) % 20
        role = "user" if how == 4 else show(r["role"])
        text = "" if how == 1 else re.sub("[.!?]", "", show(r["text"])) if how == 2 else show(r["text"])
        by.setdefault(r["conv_id"], []).extend([(r["turn"], role, text)] * {0: 0, 3: 2}.get(how, 1))
    out = []
    for key, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
            seen.add((role, text))
        known = {t for t, _, _ in turns if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        cost, audit = by_prefixes([(role[:1], f) for (_, role, _), f in zip(turns, faults)])
        lines = repair.applied(audit, [(r, t) for _, r, t in turns])
        out.append((key, max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(f) for f in (1, 2, 3)),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, H("\n".join(lines))))
    return sorted(out, key=str)


def test_applied_edits_fit():
    turns = [("system", "be kind."), ("assistant", "hi."), ("", "x."), ("assistant", "y")]
    assert repair.applied("KRKK"[:2] + "RD", turns) == ["system:be kind.", "user:hi.", "assistant:x."]
    assert repair.applied("KIKDD", turns) == ["system:be kind.", "user:", "assistant:hi."]
    assert repair.applied("", []) == []


@pytest.mark.parametrize("block_rows", [repair.BLOCK_ROWS, 7])
def test_repair_of_awkward_conversations(spark, block_rows):
    rng = random.Random(block_rows)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "a b.  ", ".", "é " * 50_000 + "."]
    roles = ["system", "user", "assistant", "tool", "", None, "user", "assistant"]
    rows = [(c, rng.choice([None, *range(-3, 12)]), rng.choice(roles), rng.choice(texts[:-1] if n else texts), 1, "clash")
            for c in [None, *range(-4, 30)] for n in range(rng.randrange(1, 12))]
    rows += [(100, t, roles[1 + t % 2] if rng.random() < 0.8 else rng.choice(roles), f"{rng.choice(texts[:-1])} {rng.randrange(40)}", 1, "") for t in range(300)]
    found = repair.repaired(repair.damaged(spark.createDataFrame(rows, TURNS)), block_rows)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_repair(spark.createDataFrame(rows, TURNS).collect())


def test_repair_of_nothing(spark):
    dropped = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    rows = spark.createDataFrame([(c, 0, "user", "gone.", 1, "") for c in dropped], TURNS)
    for block_rows in (repair.BLOCK_ROWS, 0):
        found = [tuple(r) for r in repair.repaired(repair.damaged(rows), block_rows).collect()]
        assert sorted(found) == [(c, 0, 0, 0, 0, 0, 0, "", H()) for c in dropped]
    assert repair.repaired(repair.damaged(rows.where(F.lit(False)))).collect() == []
