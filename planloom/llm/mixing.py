"""Mixing sources to target weights: entropy balancing of documents under token constraints, in DataFrame operations only.

Among all document rates between 0 and ``cap`` whose expected words meet each source's target, the one nearest to
"every document once" in relative entropy is ``min(cap, exp(lambda_source * tilt))``. The dual is convex and separates by
source; Newton steps on it (bracketed, and several at once) are distributed aggregates over a
histogram of (source, size), which holds all that the rates depend on. Rates become whole copies by
systematic rounding in the order of size, and the few words that rounding leaves are settled by single documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from planloom.session import staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
STEPS = 40
TOLERANCE = 1e-7
CELL_ROWS = 100_000
SETTLE_ROUNDS = 4
_REACH = 1000.0


def word_count(text: str) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``(source, source_size, target)`` of ``(source, size)`` rows.

    Sources take ``weights`` in turn, by code point, null last, and share ``share`` times all words by weight. A target
    stops at ``cap`` times its source's words; what that leaves is shared again by weight among the others until
    none is above. Closed form: with sources in ascending order of ``cap * size / weight``, exactly a prefix is
    stopped. Sources are ranked by a range partition's counts, not in one task.
    """
    totals = staged(sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")), "sources")
    ranked = _ranked(totals.withColumn("_last", F.col("source").isNull()), ["_last", "source"])
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.withColumn("_w", F.element_at(turn, (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
                                ).drop("_rank", "_last")
    weighed = weighed.withColumns({"_most": F.col("source_size") * float(cap), "_key": F.col("source_size") * cap / F.col("_w")})
    filled = staged(_ranked(weighed, ["_key", "source"], {"_w_to": F.col("_w"), "_most_to": F.col("_most")}), "filled")
    w_all, most_all = filled.agg(F.sum("_w"), F.sum("_most")).first()
    budget = min((most_all or 0.0) / cap * share, most_all or 0.0)
    left = F.lit(budget) - F.col("_most_to") + F.col("_most")
    w_left = F.lit(w_all or 0.0) - F.col("_w_to") + F.col("_w")
    # the first source in this order that is not stopped sets the level, which is the highest of all that hold
    level = filled.agg(F.max(F.when(F.col("_key") * w_left >= left, left / w_left))).first()[0]
    share_of = F.col("_most") if level is None else F.least(F.col("_most"), F.lit(level) * F.col("_w"))
    return filled.select("source", "source_size", share_of.alias("target"))


def _ranked(rows: DataFrame, order: Sequence[str], running: dict[str, Column] | None = None) -> DataFrame:
    """Rank (and running sums) in a global order: per range partition, plus what the earlier partitions hold."""
    ranged = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = {"_rank": F.lit(1), **(running or {})}
    parts = ranged.groupBy("_part").agg(*[F.sum(c).alias("_p" + name) for name, c in sums.items()])
    # one row per partition of the range, which is all that this window holds
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *[F.coalesce(F.sum("_p" + name).over(before), F.lit(0)).alias("_p" + name) for name in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.withColumns({name: F.sum(c).over(inside) for name, c in sums.items()}).join(parts, "_part")
            .withColumns({name: F.col(name) + F.col("_p" + name) for name in sums}).drop("_part", *["_p" + n for n in sums]))


def _rate(lam: Column, tilt: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(lam * tilt))


#: Lambdas that every source begins with, within the bounds; further ones are tried around each Newton step.
_FIRST = (0.0, *(sign * x for x in (0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 16.0, 128.0) for sign in (-1.0, 1.0)))
_AROUND = (0.0, *(sign * x for x in (1e-8, 1e-5, 1e-3, 1e-1) for sign in (-1.0, 1.0)))
_WITHIN = (0.25, 0.5, 0.75)
#: Sums are of decimals, so that they, and all that follows from them, are the same in whatever order rows come.
_EXACT = "decimal(28,8)"


def balanced_rates(cells: DataFrame, targets: DataFrame, cap: int = CAP, power: float = 0.5, steps: int = STEPS) -> DataFrame:
    """``lambda`` per source such that the expected words of ``cells`` (source, size, docs) meet the targets.

    A document's entropy counts ``mean * (size / mean) ** power`` times, so that its tilt is ``(size / mean) ** (1 - power)``:
    with power 1 all documents of a source have one rate, with power 0 the rate follows the plain size. Each step is one aggregate over
    the cells that tries several lambdas of every source: the Newton step from the best one so far, some about it, and some that divide
    what is left of the bracket. Few steps are needed, and each is written before the next. A source at its cap
    has no finite lambda and takes the bound.
    """
    same = lambda a, b: F.col(a + ".source").eqNullSafe(F.col(b + ".source"))
    mean = (F.col("t.source_size") / F.greatest(F.col("t.docs"), F.lit(1)))
    counted = targets.alias("t").join(cells.groupBy("source").agg(F.sum("docs").alias("docs")).alias("c"), same("t", "c")).select(
        "t.*", "c.docs")
    tilted = staged(cells.where("size > 0").alias("c").join(counted.alias("t"), same("c", "t")).select(
        "c.source", "c.size", F.col("c.docs"), "t.target", F.pow(F.col("c.size") / mean, F.lit(1.0 - power)).alias("tilt")), "cells")
    state = staged(targets.where("source_size > 0").select(
        "source", "target", F.lit(-_REACH).alias("lo"), F.lit(_REACH).alias("hi"), F.lit(0.0).alias("lambda"),
        F.array(*map(F.lit, _FIRST)).alias("tried"), F.lit(False).alias("done")), "lambda")
    for _ in range(steps):
        asked = state.where("not done").select("source", "target", F.explode("tried").alias("at"))
        rate = _rate(F.col("s.at"), F.col("c.tilt"), cap)
        words = F.col("c.docs") * F.col("c.size")
        sums = tilted.alias("c").join(asked.alias("s"), same("c", "s")).groupBy(
            F.col("c.source").alias("source"), F.col("s.at").alias("at"), F.col("s.target").alias("target")).agg(
            F.sum((words * rate).cast(_EXACT)).cast("double").alias("met"),
            F.sum(F.when(rate < cap, words * F.col("c.tilt") * rate).otherwise(0.0).cast(_EXACT)).cast("double").alias("slope"))
        gap = F.col("met") - F.col("target")
        best = sums.groupBy("source").agg(
            F.max(F.when(gap < 0, F.col("at"))).alias("_lo"), F.min(F.when(gap >= 0, F.col("at"))).alias("_hi"),
            F.min_by(F.struct("at", "slope", gap.alias("gap")), F.struct(F.abs(gap), "at")).alias("best"))
        both = state.alias("s").join(best.alias("g"), same("s", "g"), "left").select(
            "s.*", F.greatest("s.lo", "g._lo").alias("_lo"), F.least("s.hi", "g._hi").alias("_hi"), "g.best")
        near = (F.abs("best.gap") <= TOLERANCE * F.col("target") + 1e-9) | (F.col("_hi") - F.col("_lo") < 1e-12)
        newton = F.col("best.at") - F.when(F.col("best.slope") > 0, F.col("best.gap") / F.col("best.slope")).otherwise(0.0)
        width = F.greatest(F.abs(newton - F.col("best.at")), F.lit(1e-9))
        tried = F.array(*[newton + width * x for x in _AROUND], *[F.col("_lo") + (F.col("_hi") - F.col("_lo")) * x for x in _WITHIN])
        tried = F.array_distinct(F.filter(tried, lambda x: (x > F.col("_lo")) & (x < F.col("_hi"))))
        ended = F.col("done") | F.coalesce(near, F.lit(True)) | (F.size(tried) == 0)
        state = staged(both.select(
            "source", "target", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.coalesce(F.when(~F.col("done"), F.col("best.at")), "lambda").alias("lambda"),
            F.when(~ended, tried).alias("tried"), ended.alias("done")), "lambda")
        if state.where("not done").isEmpty():
            break
    return tilted.alias("c").join(state.alias("s"), same("c", "s"), "left").select(
        "c.source", "c.size", F.coalesce(_rate(F.col("s.lambda"), F.col("c.tilt"), cap), F.lit(0.0)).alias("rate"))


def mixed_copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP,
                 power: float = 0.5) -> DataFrame:
    """``(doc_id, size, source_size, target, copies)``, one row per row of ``docs`` (doc_id, text, source).

    * A null text has size 0; rows without words are kept once. A null source is a source of its own, the last.
    * Repeated rows are rows of their own; among rows with equal ``doc_id`` the order is by a hash of the text, and
      fully equal rows are alike, so that it does not matter which of them comes first.
    * Rounding: in each source, documents in the order of size take ``floor`` differences of the running sum of rates. Rows of
      one (source, size) are ranked in parts of at most about ``CELL_ROWS`` rows, so that no source and no group of
      copies is one task's. What a source still lacks or has too much is settled in a few rounds by the one document
      whose size is nearest to it.
    * An empty table gives no rows. Other columns are not looked at.
    """
    sized = staged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", word_count("text").alias("size"),
                               F.xxhash64(F.col("doc_id").cast("bigint"), "text").alias("_order")), "sizes")
    cells = staged(sized.groupBy("source", "size").agg(F.count("*").alias("docs")), "histogram")
    targets = staged(source_targets(cells.select("source", (F.col("size") * F.col("docs")).alias("size")), weights, share, cap), "targets")
    rates = balanced_rates(cells, targets, cap, power)
    return _settled(_rounded(sized, cells, rates, cap), targets, cap)


def _same(a: str, b: str, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def _rounded(sized: DataFrame, cells: DataFrame, rates: DataFrame, cap: int) -> DataFrame:
    """Copies by systematic rounding."""
    parts = cells.alias("c").join(rates.alias("r"), _same("c", "r", "source", "size"), "left").select(
        "c.source", "c.size", "c.docs", "r.rate", F.ceil(F.col("c.docs") / CELL_ROWS).cast("bigint").alias("parts"))
    # fixed starts: how much rate the smaller sizes of the source hold; one row per (source, size)
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(parts.withColumn("start", F.coalesce(F.sum(F.col("docs") * F.coalesce("rate", F.lit(0.0))).over(before), F.lit(0.0))), "rates")
    placed = sized.alias("d").join(parts.alias("c"), _same("d", "c", "source", "size")).select(
        "d.*", "c.rate", "c.start", F.pmod("d._order", "c.parts").alias("_part"))
    salted = placed.where("size > 0").groupBy("source", "size", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    salted = salted.withColumn("_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    inside = Window.partitionBy("source", "size", "_part").orderBy("_order", "doc_id")
    ranked = placed.withColumn("_i", F.row_number().over(inside)).alias("d").join(
        salted.alias("s"), _same("d", "s", "source", "size", "_part"), "left")
    place = F.col("d._i") + F.coalesce(F.col("s._first"), F.lit(0))
    upto = lambda i: F.floor(F.col("d.start") + i * F.col("d.rate") + 0.5)
    copies = F.when(F.col("d.size") == 0, 1).otherwise(F.least(F.lit(cap), upto(place) - upto(place - 1))).cast("bigint")
    return staged(ranked.select("d.doc_id", "d.source", "d.size", "d._order", "d._i", copies.alias("copies")), "copies")


def _settled(taken: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """Let the documents nearest in size to what a source lacks (or has too much) be taken once more (or less).

    They are looked for among one document for each source, size and number of copies, a table as small as the histogram; what they
    change is joined with the documents once.
    """
    seen = F.struct("_order", "doc_id", "_i")
    cells = staged(taken.where("size > 0").groupBy("source", "size", "copies").agg(F.count("*").alias("docs"), F.min(seen).alias("row")), "settle")
    met = cells.groupBy("source").agg(F.sum(F.col("copies") * F.col("size") * F.col("docs")).alias("met"))
    gap = targets.alias("t").join(met.alias("m"), _same("t", "m", "source")).select("t.source", (F.col("t.target") - F.col("m.met")).alias("gap"))
    moves: DataFrame | None = None
    for _ in range(SETTLE_ROUNDS):
        able = F.when(F.col("g.gap") > 0, F.col("c.copies") < cap).otherwise(F.col("c.copies") > 0)
        off = F.abs(F.abs(F.col("g.gap")) - F.col("c.size"))
        rank = F.struct(off.alias("off"), F.col("c.size").alias("size"), F.col("c.copies").alias("copies"), F.col("c.row").alias("row"),
                        F.signum("g.gap").cast("bigint").alias("by"))
        best = cells.alias("c").join(gap.alias("g"), _same("c", "g", "source")).where(able & (off < F.abs(F.col("g.gap")))).groupBy(
            F.col("c.source").alias("source")).agg(F.min(rank).alias("move")).select("source", "move.*")
        best = staged(best, "moves")
        moves = best if moves is None else moves.unionByName(best)
        gap = gap.alias("g").join(best.alias("b"), _same("g", "b", "source"), "left").select(
            "g.source", (F.col("g.gap") - F.coalesce(F.col("b.by") * F.col("b.size"), F.lit(0))).alias("gap"))
        # a document moves once
        cells = cells.alias("c").join(best.alias("b"), _same("c", "b", "source", "size", "copies"), "left_anti")
    moves = moves.select("source", "size", "row.*", "by")
    return (taken.alias("d").join(targets.alias("t"), _same("d", "t", "source"))
            .join(moves.alias("m"), _same("d", "m", "source", "doc_id", "_order", "size", "_i"), "left")
            .select("d.doc_id", "d.source", "d.size", "t.source_size", "t.target",
                    (F.col("d.copies") + F.coalesce(F.col("m.by"), F.lit(0))).alias("copies"), "d._order"))
