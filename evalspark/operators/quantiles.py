"""Exact percentiles (linear interpolation at index ``(n-1)*q``) that scale.

Spark's exact ``percentile`` keeps every distinct value of a group in one
buffer, so one hot group lands whole in one task. Here the exact answer is
found in two passes without that:

1. per group: ``n`` and two GK sketches (``percentile_approx``) at ``q -/+ margin``.
   The sketch guarantees a rank error below ``n / accuracy``, so the true values at
   ranks ``floor((n-1)q)`` and the next one lie between the two sketch values.
2. rows below the band collapse into one row per group (how many, and the largest of them), rows
   above into the smallest of them; rows inside are reduced to ``(value, count)``. Only the band, at
   most ``2 * margin * n`` rows and far fewer distinct values, is ranked: dealt out by ranges of its
   values, counted per range, with the counts of the ranges before as offsets, so that the band of
   one group may span any number of tasks. The neighbours serve a rank just outside the band; a
   rank beyond them fails the job.

Groups of every size take this path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators.positions import running_totals

DEFAULT_ACCURACY = 10_000


def exact_percentiles(df: DataFrame, keys: list[str], value: str, qs: list[float],
                      names: list[str] | None = None, accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Per group of ``keys``: one column per ``q`` with the exact interpolated percentile.

    NULL values are ignored; a group with no values is absent.
    """
    keys = list(keys)
    names = names or [f"p{int(round(q * 100))}" for q in qs]
    margin = 4.0 / accuracy
    lo_q = [max(0.0, q - margin) for q in qs]
    hi_q = [min(1.0, q + margin) for q in qs]
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())

    sketch = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", lo_q, accuracy).alias("_lo"),
        F.percentile_approx("_v", hi_q, accuracy).alias("_hi"),
    )
    q_arr = F.array(*[F.lit(float(q)) for q in qs])
    bands = (sketch
             .select(*keys, "_n", F.posexplode(F.arrays_zip(q_arr.alias("q"), F.col("_lo").alias("lo"),
                                                             F.col("_hi").alias("hi"))).alias("_qi", "_b"))
             .select(*keys, "_n", "_qi", F.col("_b.q").alias("_q"), F.col("_b.lo").alias("_blo"),
                     F.col("_b.hi").alias("_bhi")))
    idx = (F.col("_n") - 1).cast("double") * F.col("_q")
    bands = (bands.withColumn("_r0", F.floor(idx).cast("bigint"))
             .withColumn("_r1", F.least(F.col("_r0") + 1, F.col("_n") - 1))
             .withColumn("_frac", idx - F.col("_r0")))

    # one row per group and q: AQE broadcasts it at run time when its measured size
    # is under the broadcast threshold, else it stays a shuffle join
    joined = data.join(bands, keys, "inner")
    place = F.when(F.col("_v") < F.col("_blo"), -1).when(F.col("_v") > F.col("_bhi"), 1).otherwise(0)
    joined = joined.withColumn("_side", place)
    reduced = (joined.withColumn("_bv", F.when(F.col("_side") == 0, F.col("_v")))
               .groupBy(*keys, "_qi", "_side", "_bv")
               .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max")))
    ranked = running_totals(reduced, [F.col("_side"), F.col("_bv")], F.col("_c"), "_start", keys + ["_qi"])
    ranked = ranked.withColumn("_end", F.col("_start") + F.col("_c") - 1)
    ranked = ranked.join(bands.select(*keys, "_qi", "_r0", "_r1", "_frac"), keys + ["_qi"], "inner")

    def at(rank: str):
        r = F.col(rank)
        known = (F.when((F.col("_side") == 0) & (F.col("_start") <= r) & (r <= F.col("_end")), F.col("_bv"))
                 .when((F.col("_side") < 0) & (r == F.col("_end")), F.col("_max"))
                 .when((F.col("_side") > 0) & (r == F.col("_start")), F.col("_min")))
        return F.max(known)

    missed = F.raise_error(F.lit("a percentile's rank lies outside the sketch's band")).cast("double")
    picked = ranked.groupBy(*keys, "_qi").agg(at("_r0").alias("_v0"), at("_r1").alias("_v1"), F.first("_frac").alias("_frac"))
    picked = picked.withColumn("_v0", F.coalesce("_v0", missed)).withColumn(
        "_v1", F.when(F.col("_frac") == 0, F.col("_v0")).otherwise(F.coalesce("_v1", missed)))
    picked = picked.withColumn(
        "_p", F.when(F.col("_frac") == 0, F.col("_v0"))
        .otherwise(F.col("_v0") * (F.lit(1.0) - F.col("_frac")) + F.col("_v1") * F.col("_frac")))
    wide = picked.groupBy(*keys).pivot("_qi", list(range(len(qs)))).agg(F.first("_p"))
    return wide.select(*keys, *[F.col(str(i)).alias(nm) for i, nm in enumerate(names)])
