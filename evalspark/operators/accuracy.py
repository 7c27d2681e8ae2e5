"""Multiple-choice and generative accuracy.

Item tables are the big inputs; every operator here reduces them with
partial (map-side) aggregation before the exchange, so a model or subject that
holds a third of all items is combined in per-partition buffers, never
gathered whole into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODEL_KEYS = ["run_id", "model_id"]


def choice_predictions(loglik: DataFrame, keys=("run_id", "model_id", "doc_id"),
                       choice: str = "choice_no", ll: str = "loglik") -> DataFrame:
    """A2 first half: per item the choice with the largest log-likelihood.

    Ties go to the lowest choice number (first in list order). ``max_by`` over a
    ``(ll, -choice)`` struct is an ordinary aggregate, so items are reduced map-side
    instead of sorted by a window.
    """
    order = F.struct(F.col(ll).alias("ll"), (-F.col(choice)).alias("neg_choice"))
    return (loglik.groupBy(*keys)
            .agg(F.max_by(F.col(choice), order).alias("pred_choice"),
                 F.max(F.col(ll)).alias("best_loglik"),
                 F.count(F.lit(1)).alias("n_choices")))


def choice_accuracy(loglik: DataFrame, gold: DataFrame, keys=("run_id", "model_id", "doc_id"),
                    gold_col: str = "gold") -> DataFrame:
    """A2: item correctness = predicted choice equals the gold choice."""
    pred = choice_predictions(loglik, keys)
    item_key = [k for k in keys if k in gold.columns]
    return (pred.join(gold, item_key, "inner")
            .withColumn("correct", (F.col("pred_choice") == F.col(gold_col)).cast("double")))


def exact_match(generations: DataFrame, text: str = "text", gold: str = "gold",
                keys=MODEL_KEYS) -> DataFrame:
    """A3: mean of ``generated == gold`` per model."""
    return (generations.groupBy(*keys)
            .agg(F.avg((F.col(text) == F.col(gold)).cast("double")).alias("exact_match"),
                 F.count(F.lit(1)).alias("n_samples")))


def subject_and_model_accuracy(items: DataFrame, subject: str = "subject", correct: str = "correct",
                               keys=MODEL_KEYS) -> DataFrame:
    """A4 in one aggregation: grouping sets (keys + subject) and (keys).

    Returns rows for every (model, subject) cell and one overall row per model
    (``subject`` NULL, ``is_overall`` true) with acc, stderr = stddev_samp/sqrt(n)
    and n. One Expand + one shuffle: the item table is scanned once.
    """
    keys = list(keys)
    x = F.col(correct).cast("double")
    grouped = items.groupingSets([keys + [subject], keys], *keys, subject)
    out = grouped.agg(
        F.avg(x).alias("acc"),
        (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("acc_stderr"),
        F.count(x).alias("n"),
        F.grouping(subject).alias("_g"),
    )
    return out.withColumn("is_overall", F.col("_g") == 1).drop("_g")


def group_accuracy(items: DataFrame, subject: str = "subject", correct: str = "correct",
                   keys=MODEL_KEYS) -> DataFrame:
    """A4 model level: the accuracy stage table (acc_score, acc_stderr, n_samples).

    The overall score is the size-weighted mean of subjects (= the mean over all
    items); its SE is computed over all items of the model (SURVEY T33).
    """
    keys = list(keys)
    x = F.col(correct).cast("double")
    return (items.groupBy(*keys)
            .agg(F.avg(x).alias("acc_score"),
                 (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("acc_stderr"),
                 F.count(x).alias("n_samples")))


def pooled_stderr(subjects: DataFrame, keys=MODEL_KEYS) -> DataFrame:
    """A4 alternative when only subject rows exist: pooled SE from subject SEs.

    ``sqrt( sum((n_i-1)*n_i*se_i^2) / (sum n_i - k) / sum n_i )``; cells without an
    SE (one item) contribute zero variance.
    """
    n = F.col("n").cast("double")
    se = F.coalesce(F.col("acc_stderr"), F.lit(0.0))
    return (subjects.groupBy(*keys)
            .agg(F.sum(F.col("acc") * n).alias("_sx"), F.sum(n).alias("_n"),
                 F.sum((n - 1) * n * se * se).alias("_ss"), F.count(F.lit(1)).alias("_k"))
            .select(*keys, (F.col("_sx") / F.col("_n")).alias("acc_score"),
                    F.when(F.col("_n") > F.col("_k"),
                           F.sqrt(F.col("_ss") / (F.col("_n") - F.col("_k")) / F.col("_n"))).alias("acc_stderr"),
                    F.col("_n").cast("bigint").alias("n_samples")))


def limit_per_subject(docs: DataFrame, n: int, subject: str = "subject", order: str = "doc_no") -> DataFrame:
    """The first ``n`` items of every subject (the evaluation limit option).

    ``row_number() <= n`` is planned as a WindowGroupLimit before and after the
    exchange, so each map task forwards at most ``n`` rows per subject.
    """
    w = Window.partitionBy(subject).orderBy(F.col(order).asc())
    return (docs.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= n).drop("_rn"))
