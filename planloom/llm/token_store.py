"""Token ids as binary shards, with a minimal perfect hash index for keyed access.

Shards. Documents are tokenized in ascending ``doc_id`` order and written as raw binary files, one per range of ids. A record is the
key (8 bytes, little-endian), the number of ids (4 bytes, the highest bit marks a null key), then the ids, 2 bytes each (4 if the
vocabulary needs it); the last id is the end id. Spark's own writer commits the files: each record is a row,
and the end id is the separator that the writer puts after it, so that a lost executor leaves no half shard.

Index. Keys are dealt by hash into buckets of about ``BUCKET_KEYS``. A bucket is a minimal perfect hash (levels of bit arrays: a key
settles on the first level where no other key hits its bit; its slot is the rank of that bit), and per slot a fingerprint of the key and
the places of its records (shard, offset, records, ids before). A lookup costs a few bit tests, one rank, one comparison, and one
seek into the shard; a key that was never stored is refused by its fingerprint, or in the end by the key in the record.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from planloom.llm.dealing import pieces, text_bytes
from planloom.llm.packing import U64, give_back, handed, joined, mixed, pack, tidy, unpack
from planloom.session import scratch_path, staged

END_ID = 2
SHARD_BYTES = 16 << 20
BUCKET_KEYS = 4096
#: Pieces whose ids a worker remembers in each of two generations: about 100 MB in all.
MEMO_PIECES = 250_000
#: So many bytes of texts, or a batch that has more, are looked up together: what repeats among them is looked up once.
_ENCODED_BYTES = 4 << 20
_HEAD = "<qI"
_HEAD_BYTES = struct.calcsize(_HEAD)
_NULL = 1 << 31
_LONG = 256
_LEVELS = 64
_GAMMA = 1.5
_PREFIX_ROWS = 4096
#: White space of the pre-tokenizer's pattern; a chunk is a run of it and the text up to the next run.
_CHUNK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]*"
                    "[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+|\\s+")
#: White space that is not one space between words, or one line break.
_ODD_SPACE = "  | \\n|\\n[ \\n]|[\x02\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_START = "\x02"
#: Fixed value: the public pattern by which byte-level tokenizers of this kind cut a text before merging.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class Encoder:
    """Ids of whole texts by a tokenizer file, as the library gives them.

    A byte-level tokenizer cuts a text into pieces before it merges, so that equal pieces have equal ids. The ids of pieces are
    remembered, and the library's model runs on new pieces only. When ``MEMO_PIECES`` are new, those that were not
    met since the last time are forgotten. A text that holds a special token's string, and any other tokenizer's text, goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        first = made.get("pre_tokenizer") or {}
        self.by_piece = (first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
                         and made.get("normalizer") is None and made["model"]["type"] == "BPE")
        self.model, self.young, self.old = self.tokenizer.model, {}, {}
        self.letters = _byte_letters()
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content)

    def piece(self, text: str) -> bytes:
        found = self.young.get(text)
        if found is None:
            found = self.old.get(text)
            if found is None:
                ids = [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]
                found = struct.pack(f"<{len(ids)}{'I' if self.wide else 'H'}", *ids)
            if len(text) <= _LONG:
                if len(self.young) >= MEMO_PIECES:
                    self.old, self.young = self.young, {}
                self.young[text] = found
        return found

    def chunk(self, text: str) -> bytes:
        if text[:1] == " " and text[1:].isalpha():  # one piece, or one and a mark
            return self.piece(text)
        if text[:1] == " " and text[-1] in ".,!" and text[1:-1].isalpha():
            return self.piece(text[:-1]) + self.piece(text[-1])
        return b"".join([self.piece(p) for p in _PIECE.findall(text)])

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian, without an end id."""
        if not self.by_piece or self.special and re.search(self.special, text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join([self.chunk(c) for c in _CHUNK.findall(text)])

    def named(self, part: str) -> bytes:
        """Ids of what follows a space; of a line break and what follows it; or of a text's start, marked ``_START``."""
        return self.chunk(part[1:] if part[0:1] == _START else part if part[0:1] == "\n" else " " + part)

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text. Texts with single spaces and line breaks only are cut at them, and each part is looked up once."""
        odd = np.asarray(pc.match_substring_regex(texts, f"{_ODD_SPACE}|{self.special}" if self.special else _ODD_SPACE)) if self.by_piece else np.ones(len(texts), bool)
        plain = np.flatnonzero(~odd)
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.encode(texts[i].as_py())
        if len(plain):
            marked = pc.binary_join_element_wise(pa.scalar(_START), pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), "")
            split = pc.split_pattern(marked, " ")
            coded = split.flatten().dictionary_encode()
            known = [self.named(p) for p in coded.dictionary.to_pylist()]
            size = 4 if self.wide else 2
            lens = np.fromiter(map(len, known), np.int64, len(known)) // size
            ids = np.frombuffer(b"".join(known), self.kind)
            code = np.asarray(coded.indices)
            n = lens[code]
            ends = np.cumsum(n)
            stream = ids[np.repeat((np.cumsum(lens) - lens)[code] - (ends - n), n) + np.arange(ends[-1])].tobytes()
            cuts = (np.concatenate([[0], ends])[np.asarray(split.offsets)] * size).tolist()
            for i, lo, hi in zip(plain.tolist(), cuts, cuts[1:]):
                out[i] = stream[lo:hi]
        return out


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def separator(end_id: int, wide: bool) -> str:
    """The end id as the writer's line separator."""
    raw = end_id.to_bytes(4 if wide else 2, "little")
    if max(raw) > 127:
        raise ValueError("each byte of the end id must be below 128")
    return raw.decode("ascii")


def small(batch: pa.RecordBatch, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``size`` bytes of its second column, of one row at least."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(1))))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
        yield batch.slice(at, to - at)
        at = to


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the shards of ``docs`` (doc_id, text) to ``path``. A null text has no ids but the end; null keys come first."""
    wide = encoder(tokenizer).wide
    rows = handed(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    ranged = rows.repartitionByRange(pieces(text_bytes(docs), shard_bytes), *order[:2]).sortWithinPartitions(*order)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = encoder(tokenizer).encode_all, 4 if wide else 2
        for batch in joined(batches, _ENCODED_BYTES):
            for part in small(batch):
                records = [struct.pack(_HEAD, key or 0, len(ids) // size + 1 | (_NULL if key is None else 0)) + ids
                           for key, ids in zip(part.column(0).to_pylist(), encode(part.column(1)))]
                yield pa.record_batch([pa.array(records, pa.binary())], ["record"])

    (ranged.mapInArrow(run, "record binary").select(F.col("record").cast("string")).write
     .option("lineSep", separator(end_id, wide)).option("compression", "none").text(path))


def open_shard(path: str) -> pa.NativeFile:
    """A shard in any file system that Arrow knows, for reading at offsets."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


def shard_paths(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, path)`` of the files; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(
        F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "path", "length").where("length > 0")


def _records(raw: memoryview, size: int) -> Iterator[tuple[int | None, int, int]]:
    """Key, offset of the record and number of ids, record by record."""
    at = 0
    while at < len(raw):
        key, n = struct.unpack_from(_HEAD, raw, at)
        yield None if n & _NULL else key, at, n & ~_NULL
        at += _HEAD_BYTES + (n & ~_NULL) * size


def scan_shards(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """``(doc_id, shard, offset, records, before, ids)`` for each run of equal keys; ``before``: ids of the shard before the run."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_shard(file) as f:
                    raw = memoryview(f.read())
                rows, before = [], 0
                for key, at, n in _records(raw, 4 if wide else 2):
                    if rows and rows[-1][0] == key:
                        rows[-1][3] += 1
                        rows[-1][5] += n
                    else:
                        rows.append([key, shard, at, 1, before, n])
                    before += n
                yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                    (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "shard", "offset", "records", "before", "ids"])
    files = shard_paths(spark, path).select("shard", "path")
    return files.repartition("shard").mapInArrow(run, "doc_id bigint, shard int, offset bigint, records bigint, before bigint, ids bigint")


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit values: levels of bits; the slot of a value is the rank of its bit."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.starts = np.cumsum(sizes) - sizes

    @staticmethod
    def _bit(value: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(value + U64((level + 1) * 0xA0761D6478BD642F % (1 << 64))) % U64(size)).astype(np.int64)

    @classmethod
    def of(cls, values: np.ndarray) -> "PerfectHash":
        sizes, sets = [], []
        left = values
        for level in range(_LEVELS):
            if not len(left):
                break
            size = -(-int(len(left) * _GAMMA + 1) // 64) * 64
            bit = cls._bit(left, level, size)
            alone = np.bincount(bit, minlength=size) == 1
            sizes.append(size)
            sets.append(alone)
            left = left[~alone[bit]]
        if len(left):
            raise ValueError("keys must be distinct")
        words = np.packbits(np.concatenate(sets) if sets else np.zeros(0, bool), bitorder="little").view(U64)
        counts = np.bitwise_count(words).astype(np.int64)
        return cls(np.array(sizes, np.int64), words, (np.cumsum(counts) - counts).astype(np.uint32))

    def slots(self, values: np.ndarray) -> np.ndarray:
        """The slot of each value; -1 for values that no level settles. A value that was not stored may get any slot."""
        out = np.full(len(values), -1, np.int64)
        left = np.arange(len(values))
        for level, (start, size) in enumerate(zip(self.starts.tolist(), self.sizes.tolist())):
            bit = start + self._bit(values[left], level, size)
            word, inside = bit >> 6, (bit & 63).astype(U64)
            hit = (self.words[word] >> inside) & U64(1) == 1
            low = self.words[word] & ((U64(1) << inside) - U64(1))
            out[left[hit]] = (self.ranks[word].astype(np.int64) + np.bitwise_count(low))[hit]
            left = left[~hit]
        return out


def _value(keys: pa.Array) -> np.ndarray:
    """Keys as 64-bit values; the null key has one of its own."""
    raw = np.asarray(keys.fill_null(0)).astype(np.int64).view(U64)
    return mixed(np.where(np.asarray(keys.is_null()), mixed(raw ^ U64(0x5851F42D4C957F2D)), raw))


def build_index(entries: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, index)``: one packed index per bucket of keys."""
    def run(table: pa.Table) -> pa.Table:
        value = _value(table.column("doc_id").combine_chunks())
        columns = {c: np.asarray(table.column(c)) for c in ("shard", "offset", "records", "before")}
        order = np.lexsort((columns["offset"], columns["shard"], value))
        keys, first, runs = np.unique(value[order], return_index=True, return_counts=True)
        hashed = PerfectHash.of(keys)
        slot = hashed.slots(keys)
        back = np.argsort(slot)  # keys in the order of their slots
        places = order[np.repeat(first[back], runs[back]) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs[back]) - runs[back], runs[back])]
        blob = pack(sizes=hashed.sizes, words=hashed.words, ranks=hashed.ranks, mark=(mixed(keys[back]) >> U64(32)).astype(np.uint32),
                    run=np.concatenate([[0], np.cumsum(runs[back])]).astype(np.uint32), **{c: v[places] for c, v in columns.items()})
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "index": pa.array([blob], pa.binary())})
    return entries.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInArrow(run, "bucket int, index binary")


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


class TokenStore:
    """Shards and index at a path, for distributed keyed reads."""

    def __init__(self, spark: SparkSession, path: str, index: DataFrame, shards: DataFrame, buckets: int, wide: bool):
        self.spark, self.path, self.index, self.shards, self.buckets, self.wide = spark, path, index, shards, buckets, wide

    @classmethod
    def write(cls, docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES,
              bucket_keys: int = BUCKET_KEYS) -> "TokenStore":
        spark = docs.sparkSession
        wide = encoder(tokenizer).wide
        write_shards(docs, path + "/shards", tokenizer, end_id, shard_bytes)
        entries = staged(scan_shards(spark, path + "/shards", wide), "entries")
        buckets = pieces(entries.count(), bucket_keys)
        build_index(entries, buckets).write.parquet(path + "/index")
        sums = entries.groupBy("shard").agg(F.sum("ids").cast("bigint").alias("ids"))
        _with_first(sums).join(shard_paths(spark, path + "/shards"), "shard").write.parquet(path + "/shard_table")
        return cls(spark, path, spark.read.parquet(path + "/index"), spark.read.parquet(path + "/shard_table"), buckets, wide)

    def find(self, keys: DataFrame) -> DataFrame:
        """``(doc_id, shard, offset, records, before)`` for the distinct ``doc_id`` of ``keys`` that the index knows."""
        def probe(asked: pa.Table, index: pa.Table) -> pa.Table:
            names = ["shard", "offset", "records", "before"]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            ids = asked.column("doc_id").combine_chunks() if asked.num_rows else pa.array([], pa.int64())
            if not index.num_rows or not asked.num_rows:
                return pa.table([pa.array([], k) for k in [pa.int64(), *kinds]], names=["doc_id", *names])
            x = unpack(index.column("index")[0].as_py())
            value = _value(ids)
            slot = PerfectHash(x["sizes"], x["words"], x["ranks"]).slots(value)
            known = (slot >= 0) & (x["mark"][np.maximum(slot, 0)] == (mixed(value) >> U64(32)).astype(np.uint32))
            at = np.flatnonzero(known)
            first, n = x["run"][slot[at]].astype(np.int64), np.diff(x["run"].astype(np.int64))[slot[at]]
            place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            return pa.table([ids.take(pa.array(np.repeat(at, n))), *[pa.array(x[c][place], k) for c, k in zip(names, kinds)]],
                            names=["doc_id", *names])
        wanted = keys.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().withColumn("bucket", bucket_of(self.buckets))
        return wanted.groupBy("bucket").cogroup(self.index.groupBy("bucket")).applyInArrow(
            probe, "doc_id bigint, shard int, offset bigint, records bigint, before bigint")

    def read(self, keys: DataFrame) -> DataFrame:
        """``(doc_id, start, n_tokens, ids binary)`` of all records of the keys; ``ids`` as stored, ``start`` counts all ids before."""
        size = 4 if self.wide else 2

        def fetch(table: pa.Table) -> pa.Table:
            rows = sorted(zip(*(table.column(c).to_pylist() for c in ("offset", "records", "before", "doc_id", "first"))), key=lambda r: r[0])
            out: list[list] = [[], [], [], []]
            with open_shard(table.column("path")[0].as_py()) as f:
                for offset, records, before, key, first in rows:
                    f.seek(offset)
                    for _ in range(records):
                        stored, n = struct.unpack(_HEAD, f.read(_HEAD_BYTES))
                        ids = f.read((n & ~_NULL) * size)
                        if (None if n & _NULL else stored) != key:
                            break  # a key that was never stored but shares slot and fingerprint
                        for to, value in zip(out, (key, first + before, n & ~_NULL, ids)):
                            to.append(value)
                        before += n & ~_NULL
            give_back()
            return pa.table([pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                            names=["doc_id", "start", "n_tokens", "ids"])

        places = self.find(keys).join(self.shards.select("shard", "path", "first"), "shard")
        return places.groupBy("shard").applyInArrow(fetch, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _with_first(sums: DataFrame) -> DataFrame:
    """Ids before each shard: running sums inside blocks of shards, and over the blocks."""
    blocks = sums.withColumn("block", F.floor(F.col("shard") / _PREFIX_ROWS))
    inside = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("block").agg(F.sum("ids").alias("total"))
    earlier = totals.select("block", F.coalesce(F.sum("total").over(
        Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    return blocks.withColumn("first", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(earlier, "block").select(
        "shard", (F.col("first") + F.col("earlier")).alias("first"))


def crc32(kind: str):
    """Column function: crc32 of stored ids as little-endian unsigned 32-bit integers."""
    @F.pandas_udf("bigint")
    def of(ids):
        return ids.map(lambda raw: zlib.crc32(np.frombuffer(raw, kind).astype("<u4").tobytes()))
    return of


def stored_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID, path: str | None = None, shard_bytes: int = SHARD_BYTES,
                  bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Write ``docs`` as shards with an index, and read every document back by key: ``doc_id, start, n_tokens, ids_crc32``.

    * A null text is empty (the end id alone); the null ``doc_id`` is a key of its own and comes first.
    * Rows that share a ``doc_id`` are records of one key, in the order of their texts; the index keeps one place per shard for them.
    * Texts of any length; an empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    store = TokenStore.write(docs, path or scratch_path(spark, "tokens"), tokenizer, end_id, shard_bytes, bucket_keys)
    kind = "<u4" if store.wide else "<u2"
    return store.read(docs).select("doc_id", "start", "n_tokens", crc32(kind)("ids").alias("ids_crc32"))
