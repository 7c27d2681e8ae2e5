"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 64-bit hash of its id and text. A source takes all its documents as often as
whole passes fit its target, and of the last pass those whose hash lies below the source's threshold,
so that a smaller budget always takes a part of what a larger one takes. The threshold is found
without sorting: sizes are summed by source and the first 16 bits of the hash, the bucket in which the
budget ends is found from the running sums, and only documents of that bucket are summed again by
their next 16 bits, down to a single hash. Documents are then filtered by comparing their hash.

What is left of a budget at the threshold is less than one document; of the documents from there on the
one whose size comes nearest to the rest is taken too, if that brings the source nearer to its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.positions import with_positions

from .common import WORD, scratch

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 42
#: Bits of the hash summed at a time; four levels find a single hash.
_BITS, _LEVELS = 16, 4
#: Copies of one row made in one step when equal rows have to be told apart.
_STEP = 100_000


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from ``sizes`` (source, source_size), one row per source.

    Sources by code point, null last, have the weights in turn and share the sum of all sizes by
    them. A target stops at ``max_repeats`` times the source's size; what it would have more is shared
    again by weight, until no target is above. Only sums over sources come to the driver.
    """
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % n + 1).cast("int"))
    ranked = with_positions(sizes, [F.col("source").asc_nulls_last()], "_at").select("source", "source_size", weight.alias("w"))
    ranked = scratch(ranked.withColumn("cap", (F.col("source_size") * max_repeats).cast("double")), "mix-sources")
    total = float(ranked.agg(F.sum("source_size").alias("x")).first()["x"] or 0)
    rate, seen = 0.0, -1
    while True:
        # a source at its cap stays there: rates only grow
        capped = F.col("w") * rate > F.col("cap")
        s = ranked.agg(F.sum(F.when(capped, F.col("cap"))).alias("caps"), F.sum(F.when(~capped, F.col("w"))).alias("w"), F.count_if(capped).alias("n")).first()
        if s["n"] == seen or not s["w"]:
            break
        seen, rate = s["n"], (total - (s["caps"] or 0.0)) / s["w"]
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.col("w") * rate).alias("target"))


def _at_level(h: Column, level: int) -> Column:
    return F.shiftrightunsigned(h, 64 - _BITS * (level + 1)).bitwiseAND((1 << _BITS) - 1)


def _prefix(h: Column, level: int) -> Column:
    """The bits of ``h`` before the given level."""
    return F.lit(0).cast("long") if level == 0 else F.shiftrightunsigned(h, 64 - _BITS * level)


def _cuts(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, cut, rest): rows (source, h, size) with a hash below ``cut`` have ``rest`` less than the budget in all.

    The row or rows of hash ``cut`` itself would go beyond it. Budgets are below the source's size.
    """
    now = budgets.select("source", F.lit(0).cast("long").alias("upto"), F.col("budget").alias("rest"))
    for level in range(_LEVELS):
        b = now.select(F.col("source").alias("_s"), "upto", "rest")
        inside = rows.join(b, rows["source"].eqNullSafe(b["_s"]) & (_prefix(F.col("h"), level) == F.col("upto")))
        histogram = inside.groupBy("source", "upto", "rest", _at_level(F.col("h"), level).alias("b")).agg(F.sum("size").alias("n"))
        # at most 65,536 rows of a source
        w = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        found = histogram.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0).cast("long")))
        found = found.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
        now = scratch(found.select("source", F.shiftleft("upto", _BITS).bitwiseOR(F.col("b")).alias("upto"), (F.col("rest") - F.col("before")).alias("rest")), "mix-level")
    return now.withColumnRenamed("upto", "cut")


def _below(a: Column, b: Column) -> Column:
    """Order of hashes as unsigned numbers, which the levels follow."""
    low = F.lit(-(1 << 63))
    return a.bitwiseXOR(low) < b.bitwiseXOR(low)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs`` (doc_id, text, source).

    size counts words, copies tells how often the mix takes the document, at most ``max_repeats``
    times, and taken is copies times size. Documents are taken whole. Null texts have no words; a
    null source is a source of its own, the last. Rows with equal id and text cannot be told apart:
    as many of them as needed are taken, one by one. Equal input gives equal output, in any
    partitioning; a null doc_id is hashed as null. Other columns are not read, no rows give no rows.
    """
    text = F.col("text").cast("string")
    rows = scratch(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text).alias("h"), words(text).alias("size")), "mix-rows")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats).cast("long"))).otherwise(F.lit(0).cast("long"))
    targets = targets.withColumn("passes", full).withColumn("budget", F.round("target").cast("long") - F.col("passes") * F.col("source_size"))
    targets = scratch(targets, "mix-targets")
    sized = rows.where("size > 0").select("source", "h", "size", "doc_id")
    cuts = _cuts(sized, targets.where("budget > 0 AND budget < source_size"))
    c = cuts.select(F.col("source").alias("_s"), "cut", "rest")
    on_source = lambda x: sized["source"].eqNullSafe(x["_s"])
    # rows at the threshold: one document as a rule, equal rows or a chance collision else
    at = sized.join(c, on_source(c) & (F.col("h") == F.col("cut"))).groupBy("source", "h", "doc_id", "size", "rest").agg(F.count("*").alias("m"))
    w = Window.partitionBy("source").orderBy(F.col("doc_id").asc_nulls_last(), "size")
    before = F.coalesce(F.sum(F.col("m") * F.col("size")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    fit = F.least(F.col("m"), F.greatest(F.floor((F.col("rest") - before) / F.col("size")), F.lit(0).cast("long")))
    at = at.withColumn("j", fit)
    at = scratch(at.withColumn("open", F.row_number().over(Window.partitionBy("source").orderBy((F.col("j") < F.col("m")).desc(), F.col("doc_id").asc_nulls_last(), "size")) == 1), "mix-at")
    left = at.groupBy("source").agg((F.first("rest") - F.sum(F.col("j") * F.col("size"))).alias("rest"))
    left = scratch(left.join(cuts.select(F.col("source").alias("_s"), "cut"), F.col("source").eqNullSafe(F.col("_s"))).select("_s", "cut", "rest"), "mix-left")
    # one more document from the threshold on: the one that comes nearest to the rest
    above = sized.join(left, on_source(left) & _below(F.col("cut"), F.col("h"))).select("source", "h", "doc_id", "size", "rest")
    again = at.where("open AND j < m").join(left.select("_s", F.col("rest").alias("still")), F.col("source").eqNullSafe(F.col("_s"))).select("source", "h", "doc_id", "size", F.col("still").alias("rest"))
    nearest = F.min_by(F.struct("h", "doc_id", "size"), F.struct(F.abs(F.col("size") - F.col("rest")), F.col("h"), F.col("doc_id")))
    near = scratch(above.unionByName(again).where("size < 2 * rest").groupBy("source").agg(nearest.alias("x")).select(F.col("source").alias("_s"), "x.*"), "mix-extra")
    # rows of these hashes are told apart one by one, all others by comparing their hash
    none = F.lit(0).cast("long")
    chosen = at.select("source", "h", "doc_id", "size", F.col("j").alias("more")).unionByName(near.select(F.col("_s").alias("source"), "h", "doc_id", "size", F.lit(1).cast("long").alias("more")))
    chosen = scratch(chosen.groupBy("source", "h", "doc_id", "size").agg(F.sum("more").alias("more")), "mix-chosen")
    hashes = chosen.groupBy("source").agg(F.collect_set("h").alias("apart"))
    plan = targets
    for part in (cuts.select("source", "cut"), hashes):
        part = part.withColumnRenamed("source", "_s")
        plan = plan.join(part, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    everything = F.col("budget") >= F.greatest(F.col("source_size"), F.lit(1).cast("long"))
    plan = scratch(plan.select(F.col("source").alias("_s"), "source_size", "target", "passes", "cut", everything.alias("everything"),
                               F.coalesce("apart", F.array().cast("array<long>")).alias("apart")), "mix-plan")
    placed = rows.join(plan, rows["source"].eqNullSafe(plan["_s"])).drop("_s")
    base = ["doc_id", "source", "size", "source_size", "target"]
    apart = F.array_contains("apart", F.col("h")) & (F.col("size") > 0)
    more = (F.col("everything") | F.coalesce(_below(F.col("h"), F.col("cut")), F.lit(False))) & (F.col("size") > 0)
    simple = placed.where(~apart).select(*base, (F.col("passes") + more.cast("long")).alias("copies"))
    same = placed.where(apart).groupBy(*base, "passes", "h").agg(F.count("*").alias("m"))
    k = chosen.select(F.col("source").alias("_s"), F.col("h").alias("_h"), F.col("doc_id").alias("_d"), F.col("size").alias("_n"), "more")
    same = same.join(k, F.col("source").eqNullSafe(F.col("_s")) & (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("size") == F.col("_n")), "left")
    starts = same.withColumn("lo", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"), F.lit(_STEP).cast("long"))))
    each = starts.withColumn("i", F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + _STEP - 1, F.col("m")))))
    special = each.select(*base, (F.col("passes") + (F.col("i") <= F.coalesce("more", none)).cast("long")).alias("copies"))
    return simple.unionByName(special).withColumn("taken", F.col("copies") * F.col("size"))
