"""Merkle manifest of a dataset: nodes labelled with the interval of leaf ranks they cover, inclusion proofs, and their verification.

A tree per group of rows (a language) has one leaf per row, and a tree over the groups' roots has the root of the dataset. A node is a
row ``(tree, level, lo, hi, digest)``: it covers the leaves of ranks ``lo`` to ``hi - 1``. Levels are bucketed: a bucket is
``TIER`` levels above one block of at most ``2 ** TIER`` nodes, so that whatever Spark puts together is bounded, also where one group
holds nearly all rows. A containment join within a bucket attaches a node's ancestors, level by level; what a
parent's interval has besides the node's own is the sibling's interval. A block's path to the root is found once and shared by its nodes.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from planloom.llm.packing import handed, tidy
from planloom.session import staged

#: Levels in a bucket.
TIER = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 7
_NODE = "tree string, n bigint, level int, lo bigint, hi bigint, digest binary"
_NODES = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()),
                    ("digest", pa.binary())])
#: Steps of a path: no sibling, a sibling on the left, one on the right. A digest follows the last two.
_ALONE, _LEFT, _RIGHT = b"\x00", b"\x01", b"\x02"
_TOP = "*"


def field(value: Column) -> Column:
    """A value as the leaf hash takes it: ``-`` for null, else its UTF-8 byte count, a colon and its text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def tree_of(group: Column) -> Column:
    """A key of a group that is never null, in the order of the groups' bytes with null first."""
    return F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), group))


def leaves_of(docs: DataFrame) -> DataFrame:
    """``doc_id, tree, leaf`` and ``tampered``, the leaf of the row with one more in ``n_chars`` where the id's checksum says so, else null."""
    plain = {c: field(F.col(c).cast("bigint") if c in ("doc_id", "n_chars") else F.col(c)) for c in FIELDS}
    more = plain | {"n_chars": field(F.col("n_chars").cast("decimal(20,0)") + 1)}
    digest = lambda parts: F.unhex(F.sha2(F.concat(*parts.values()), 256))
    hit = (F.crc32(F.col("doc_id").cast("bigint").cast("string")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), tree_of(F.col("lang")).alias("tree"), digest(plain).alias("leaf"),
                       F.when(hit, digest(more)).alias("tampered"), F.monotonically_increasing_id().alias("_row"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``lo``, the row's rank within its ``tree``, and ``n``, the rows of the tree.

    Ranks are counted over range partitions, so neither a tree nor a repeated row is one task's; ``order`` must end in a
    column that tells repeated rows apart.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranged = staged(rows.repartitionByRange(F.col("tree").asc(), *keys).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = staged(ranged.groupBy("tree", "_part").agg(F.count("*").alias("_rows")), "counts")
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("tree", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
                           F.sum("_rows").over(Window.partitionBy("tree")).alias("n"))
    inside = Window.partitionBy("_part", "tree").orderBy(*keys)
    return (ranged.withColumn("_at", F.row_number().over(inside) - 1).join(staged(counts, "starts"), ["tree", "_part"])
            .withColumn("lo", (F.col("_at") + F.col("_before")).cast("bigint")).drop("_at", "_before", "_part", *[c for c in order if c == "_row"]))


def _height(n: int) -> int:
    return max(0, n - 1).bit_length()


def _hash(*digests: bytes) -> bytes:
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def _grow(table: pa.Table) -> pa.Table:
    """All nodes of a bucket above its lowest level, from those of that level."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("lo", "hi", "digest"))))
    tree, n, level = (table.column(c)[0].as_py() for c in ("tree", "n", "level"))
    made: list[tuple] = []
    for k in range(level + 1, min(level + TIER, _height(n)) + 1):
        # two consecutive nodes have one parent; the last one may be alone
        rows = [(pair[0][0], pair[-1][1], _hash(*(p[2] for p in pair))) for pair in (rows[i:i + 2] for i in range(0, len(rows), 2))]
        made += [(tree, n, k, *r) for r in rows]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*made), _NODES)] if made else [[] for _ in _NODES], schema=_NODES)


def _block(level: int) -> Column:
    """Number of the bucket of a node at ``level`` or up to ``TIER`` above."""
    return F.shiftright("lo", level + TIER).alias("block")


class Manifest:
    """The nodes of a forest of trees, one staged table for each bucket of levels; ``tiers[0]`` begins with the leaves."""

    def __init__(self, tiers: list[DataFrame]):
        self.tiers = tiers

    @classmethod
    def of(cls, leaves: DataFrame) -> "Manifest":
        """From ``(tree, n, lo, leaf)``; other columns are not looked at."""
        base = leaves.select("tree", "n", F.lit(0).alias("level"), "lo", (F.col("lo") + 1).alias("hi"), F.col("leaf").alias("digest"))
        height = _height(leaves.agg(F.max("n")).first()[0] or 0)
        tiers = []
        for level in range(0, max(1, height), TIER):
            grown = base.withColumn("block", _block(level)).groupBy("tree", "block").applyInArrow(_grow, _NODE)
            tiers.append(staged(base.unionByName(grown), "nodes"))
            base = tiers[-1].where(F.col("level") == level + TIER)
        return cls(tiers)

    def nodes(self) -> DataFrame:
        """``tree, n, level, lo, hi, digest`` of all nodes."""
        out = self.tiers[0]
        for i, tier in enumerate(self.tiers[1:], 1):
            out = out.unionByName(tier.where(F.col("level") > i * TIER))
        return out

    def roots(self) -> DataFrame:
        """``tree, digest`` of the node that covers all leaves of its tree."""
        # of a lone leaf, the leaf; of a tree of several, the one node as long as the tree
        return self.nodes().where((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).select("tree", "digest")

    def paths(self, leaves: DataFrame) -> DataFrame:
        """``leaves`` with ``path``: sides and digests of the siblings, from the leaf to the root of its tree."""
        upper: DataFrame | None = None
        for i in reversed(range(len(self.tiers))):
            level, tier = i * TIER, self.tiers[i]
            below = leaves if i == 0 else tier.where(F.col("level") == level).select("tree", "n", "lo")
            told = tier.select("tree", _block(level), "level", "lo", "hi", "digest")
            if upper is not None:  # one row for each block: the way from its top to the root
                told = told.unionByName(upper.select("tree", F.shiftright("lo", level + TIER).alias("block"), F.lit(-1).alias("level"),
                                                     "lo", F.col("lo").alias("hi"), F.col("path").alias("digest")))
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in below.schema) + ", path binary"
            found = below.withColumn("block", _block(level)).groupBy("tree", "block").cogroup(
                told.groupBy("tree", "block")).applyInArrow(_attached(level, below.columns), schema)
            upper = staged(found, "paths")
        return upper


def _attached(level: int, names: list[str]):
    def attach(rows: pa.Table, told: pa.Table) -> pa.Table:
        at, lo, hi = (np.asarray(told.column(c)).astype(np.int64) for c in ("level", "lo", "hi"))
        digest = told.column("digest").to_pylist()
        leaf = np.asarray(rows.column("lo")).astype(np.int64)
        steps: list[list[bytes]] = [[] for _ in range(rows.num_rows)]
        # intervals of each level, by their starts
        by_level = {k: (p := np.flatnonzero(at == k))[np.argsort(lo[p], kind="stable")] for k in np.unique(at[at >= 0]).tolist()}

        def holder(k: int) -> np.ndarray:
            """Of the nodes at a level, the one that contains each leaf."""
            found = by_level[k][np.searchsorted(lo[by_level[k]], leaf, side="right") - 1]
            if (leaf < lo[found]).any() or (leaf >= hi[found]).any():
                raise RuntimeError("a leaf that no node contains")
            return found

        k, own = level, holder(level) if len(leaf) else np.zeros(0, np.int64)
        while k + 1 in by_level and len(leaf):
            parent, starts = holder(k + 1), lo[by_level[k]]
            left, right = lo[parent] < lo[own], hi[own] < hi[parent]  # what the parent has besides: before, or after
            sibling = by_level[k][np.minimum(np.searchsorted(starts, np.where(left, lo[parent], hi[own])), len(starts) - 1)]
            for i, (a, b, s) in enumerate(zip(left.tolist(), right.tolist(), sibling.tolist())):
                steps[i].append(_LEFT + digest[s] if a else _RIGHT + digest[s] if b else _ALONE)
            k, own = k + 1, parent
        above = next((d for d, x in zip(digest, at.tolist()) if x == -1), b"")
        return rows.select(names).append_column("path", pa.array([b"".join(s) + above for s in steps], pa.binary()))
    return attach


def steps_of(path: bytes):
    """``(side, digest)`` of each step of a path, from below."""
    at = 0
    while at < len(path):
        side, size = path[at:at + 1], 0 if path[at:at + 1] == _ALONE else 32
        yield side, path[at + 1:at + 1 + size]
        at += 1 + size


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for side, digest in steps_of(path):
        leaf = _hash(leaf) if side == _ALONE else _hash(digest, leaf) if side == _LEFT else _hash(leaf, digest)
    return leaf


def _checked(rows: DataFrame) -> DataFrame:
    """Digests as hex, the proof's hash, and the root recomputed from the tampered leaf, or else the leaf."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    kinds = [pa.int64(), *[pa.string()] * 5]

    @tidy
    def run(batches):
        for batch in batches:
            made: list[tuple] = []
            for key, leaf, tampered, path, subroot, root in zip(*(batch.column(c).to_pylist() for c in (
                    "doc_id", "leaf", "tampered", "path", "subroot", "root"))):
                proof = sha256("".join(d.hex() for _, d in steps_of(path)).encode()).hexdigest()
                made.append((key, leaf.hex(), subroot.hex(), root.hex(), proof, folded(tampered or leaf, path).hex()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*made) if made else [[]] * 6, kinds)], names)
    schema = "doc_id bigint, " + ", ".join(f"{c} string" for c in names[1:])
    return handed(rows).mapInArrow(run, schema).withColumn("verified", F.col("folded_root") == F.col("root"))


def dataset_manifest(docs: DataFrame) -> tuple[Manifest, Manifest, DataFrame]:
    """The manifest of all rows by language, that of the languages' roots, and the ranked leaves with their paths to the dataset's root.

    * Null fields hash as ``-``, so null and empty texts differ; a null language is a tree of its own, the first one.
    * Rows of one ``doc_id`` are ordered by their leaf; equal rows are leaves of their own, and which of them comes first makes
      no difference to any digest. A null ``doc_id`` comes first.
    * Texts of any length; an empty table has no nodes and no leaves; further columns are not looked at.
    """
    leaves = staged(ranked(staged(leaves_of(docs), "hashed"), ["doc_id", "leaf", "_row"]), "leaves")
    below = Manifest.of(leaves)
    subroots = staged(below.roots().select(F.lit(_TOP).alias("tree"), F.col("tree").alias("group"), F.col("digest").alias("leaf")), "subroots")
    tops = staged(ranked(subroots, ["group"]), "groups")
    above = Manifest.of(tops)
    # the root's tree is read from both tables: as a literal it would be folded, and the join with it a cross join
    ways = above.paths(tops).select(F.col("tree").alias("_top"), F.col("group").alias("tree"), F.col("leaf").alias("subroot"), F.col("path").alias("_above"))
    ends = staged(ways.join(above.roots().select(F.col("tree").alias("_top"), F.col("digest").alias("root")), "_top").drop("_top"), "ends")
    proofs = below.paths(leaves).join(ends, "tree").withColumn("path", F.concat("path", "_above")).drop("_above")
    return below, above, proofs


def verified(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: each row's proof, checked after tampering with some rows.

    Cases as in ``dataset_manifest``. A null ``doc_id`` or ``n_chars`` is never tampered with.
    """
    return _checked(dataset_manifest(docs)[2].select("doc_id", "leaf", "tampered", "path", "subroot", "root"))
