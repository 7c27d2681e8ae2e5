"""Composite leaderboard: normalisation, renormalised weights, CI, ranks, marks.

The heavy work (items, tries, tokens) is aggregated to one row per
``(run_id, model_id)`` by the stage operators before anything here runs, so
every window below partitions ``run_id`` over *model* rows, never item rows.
Per-model component lists are built with higher-order array functions on the
row itself: the renormalisation, score and CI need no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions import stats

# Component names in the order they are summed, and their labels.
COMPONENTS = ("ppl", "mmlu", "coding")
COMPONENT_LABELS = {"ppl": "PPL", "mmlu": "MMLU", "coding": "Coding"}

KEYS = ["run_id", "model_id"]


def normalise_ppl(ppl: DataFrame) -> DataFrame:
    """P7/P8/P12 + F1 + J5: fidelity to the best model of the run and its CI.

    ``ppl`` columns: run_id, model_id, ppl, ppl_se, n_runs, run_min, run_max.
    Only rows with ``ppl > 0`` enter the run minimum (F1). The minimum is taken
    over the models' mean PPL, so a single run may score above 100 (no clamp).
    """
    valid = F.col("ppl") > 0
    w = Window.partitionBy("run_id")
    min_ppl = F.min(F.when(valid, F.col("ppl"))).over(w)
    out = ppl.withColumn("min_ppl", min_ppl)
    fid = stats.ppl_fidelity("ppl", "min_ppl")
    # per-run fidelity spread = max - min of 100*min/run  = 100*min/run_min - 100*min/run_max
    spread = stats.ppl_fidelity("run_min", "min_ppl") - stats.ppl_fidelity("run_max", "min_ppl")
    out = (out
           .withColumn("ppl_score", F.when(valid, fid))
           .withColumn("ppl_score_se", F.when(valid, stats.ppl_score_se("ppl", "ppl_se", "min_ppl")))
           .withColumn("ppl_run_spread", F.when(valid, spread)))
    if "runs" in ppl.columns:
        # P7 per run: every run's own fidelity to the best model
        out = out.withColumn("runs", F.transform("runs", lambda r: r.withField("fidelity", F.when(r["ppl"] > 0, stats.ppl_fidelity(r["ppl"], "min_ppl")))))
    return out.withColumn(
        "ppl_ci_half",
        F.when(valid, stats.ppl_ci_half("ppl_score_se", "ppl_run_spread", F.coalesce("n_runs", F.lit(0)))))


def _component(name: str, weight: Column, value: Column, ci: Column) -> Column:
    return F.struct(F.lit(name).alias("component"), weight.alias("w"),
                    value.cast("double").alias("value"), ci.cast("double").alias("ci_half"))


def join_stages(models: DataFrame, runs: DataFrame | dict, accuracy: DataFrame | None = None,
                coding: DataFrame | None = None, ppl: DataFrame | None = None, latency: DataFrame | None = None) -> DataFrame:
    """One wide row per model with every optional stage (left joins on run_id, model_id).

    ``runs`` is the per-run options table (run_id, weights_mmlu, weights_ppl,
    ppl_available) or, for a single option set, a dict of those values (literals,
    no join).
    """
    if isinstance(runs, dict):
        wide = models.select(
            "*", F.lit(float(runs.get("weights_mmlu", 0.5))).alias("weights_mmlu"),
            F.lit(float(runs.get("weights_ppl", 0.0))).alias("weights_ppl"),
            F.lit(bool(runs.get("ppl_available", True))).alias("ppl_available"))
    else:
        wide = models.join(runs, "run_id", "left")
    def tag_error(stage: DataFrame, name: str) -> DataFrame:
        # Each stage may carry its own error text; keep them apart in the wide row
        return stage.withColumnRenamed("error", f"{name}_error") if "error" in stage.columns else stage

    accuracy = tag_error(accuracy, "accuracy") if accuracy is not None else None
    coding = tag_error(coding, "coding") if coding is not None else None
    ppl = tag_error(ppl, "ppl") if ppl is not None else None
    if latency is not None:
        wide = wide.join(tag_error(latency, "latency"), KEYS, "left")
    if accuracy is not None:
        wide = wide.join(accuracy, KEYS, "left")
    else:
        wide = wide.withColumn("acc_score", F.lit(None).cast("double")) \
                   .withColumn("acc_stderr", F.lit(None).cast("double"))
    if coding is not None:
        wide = wide.join(coding, KEYS, "left")
    else:
        for c in ("completed", "pass_num_1", "pass_num_2"):
            wide = wide.withColumn(c, F.lit(None).cast("bigint"))
        for c in ("pass_rate_1", "pass_rate_2"):
            wide = wide.withColumn(c, F.lit(None).cast("double"))
    if ppl is not None:
        wide = wide.join(normalise_ppl(ppl), KEYS, "left")
    else:
        for c in ("ppl", "ppl_score", "ppl_ci_half"):
            wide = wide.withColumn(c, F.lit(None).cast("double"))
    return wide


def score_models(wide: DataFrame) -> DataFrame:
    """Renormalised composite and its CI, per row.

    Components with weight <= 0 or no value drop out; the rest are rescaled to
    sum to 1. The CI is NULL if any *present* component has no CI.
    """
    w_ppl = F.when(F.coalesce(F.col("ppl_available"), F.lit(True)), F.col("weights_ppl")).otherwise(F.lit(0.0))
    weights = stats.component_weights(F.col("weights_mmlu"), w_ppl)
    acc_ci = F.when(F.col("acc_stderr").isNotNull(), stats.accuracy_ci_half("acc_stderr"))
    coding_ci = stats.pass_ci_half("pass_num_2", "completed", "pass_rate_2")
    raw = F.array(
        _component("ppl", weights["ppl"], F.col("ppl_score"), F.col("ppl_ci_half")),
        _component("mmlu", weights["mmlu"], F.col("acc_score") * F.lit(100.0), acc_ci),
        _component("coding", weights["coding"], F.col("pass_rate_2"), coding_ci),
    )
    present = F.filter(raw, lambda c: (c["w"] > 0) & c["value"].isNotNull())
    out = wide.withColumn("_present", present)
    total = F.aggregate("_present", F.lit(0.0), lambda acc, c: acc + c["w"])
    out = out.withColumn("_total", total)
    comps = F.when(F.col("_total") > 0, F.transform(
        "_present",
        lambda c: F.struct(c["component"].alias("component"), (c["w"] / F.col("_total")).alias("weight"),
                           c["value"].alias("value"), c["ci_half"].alias("ci_half"))
    )).otherwise(F.array().cast("array<struct<component:string,weight:double,value:double,ci_half:double>>"))
    out = out.withColumn("components", comps)
    has = F.size("components") > 0
    score = F.aggregate("components", F.lit(0.0), lambda acc, c: acc + c["weight"] * c["value"])
    ci_sq = F.aggregate("components", F.lit(0.0),
                        lambda acc, c: acc + (c["weight"] * c["ci_half"]) * (c["weight"] * c["ci_half"]))
    all_ci = F.forall("components", lambda c: c["ci_half"].isNotNull())
    return (out
            .withColumn("score", F.when(has, score))
            .withColumn("score_ci_half", F.when(has & all_ci, F.sqrt(ci_sq)))
            .withColumn("component_names", F.transform("components", lambda c: c["component"]))
            .drop("_present", "_total"))


def rank_and_mark(scored: DataFrame) -> DataFrame:
    """A14 + W1 + W2 over the model rows of each run.

    * rank: 1..n by score descending, ties in input order (``ordinal``), NULL unscored
    * missing_components: components present in any model of the run minus own
    * nonsignificant: adjacent ranks whose gap <= sqrt(ha^2 + hb^2) mark both
    """
    run = Window.partitionBy("run_id")
    all_names = F.array_distinct(F.flatten(F.collect_set("component_names").over(run)))
    out = scored.withColumn("missing_components",
                            F.array_sort(F.array_except(all_names, F.col("component_names"))))
    order = Window.partitionBy("run_id").orderBy(F.col("score").desc_nulls_last(), F.col("ordinal").asc())
    out = out.withColumn("rank", F.when(F.col("score").isNotNull(), F.row_number().over(order).cast("bigint")))
    by_rank = Window.partitionBy("run_id").orderBy(F.col("rank").asc_nulls_last(), F.col("ordinal").asc())

    def pair(hi_score, hi_ci, lo_score, lo_ci) -> Column:
        known = hi_score.isNotNull() & lo_score.isNotNull() & hi_ci.isNotNull() & lo_ci.isNotNull()
        return F.when(known, (hi_score - lo_score) <= F.sqrt(hi_ci * hi_ci + lo_ci * lo_ci))

    rank_ok = F.col("rank").isNotNull()
    nxt_s = F.when(rank_ok, F.lead("score").over(by_rank))
    nxt_c = F.lead("score_ci_half").over(by_rank)
    prv_s = F.when(rank_ok, F.lag("score").over(by_rank))
    prv_c = F.lag("score_ci_half").over(by_rank)
    sc, ci = F.col("score"), F.col("score_ci_half")
    flag = (F.coalesce(pair(sc, ci, nxt_s, nxt_c), F.lit(False))
            | F.coalesce(pair(prv_s, prv_c, sc, ci), F.lit(False)))
    return out.withColumn("nonsignificant", rank_ok & flag)


def composite_leaderboard(models: DataFrame, runs: DataFrame | dict, accuracy: DataFrame | None = None,
                          coding: DataFrame | None = None, ppl: DataFrame | None = None,
                          latency: DataFrame | None = None) -> DataFrame:
    """Flagship: stage tables -> components -> score/CI -> rank -> marks (one lazy plan); latency is carried, not scored."""
    wide = join_stages(models, runs, accuracy, coding, ppl, latency)
    return rank_and_mark(score_models(wide))
