"""Cross-model matrices: subject spread, subject x model accuracy and exercise x model outcomes, long and
wide (A15, A16, A17, F7, F8, F9, J3, O2, O3).

The long tables are the product; the wide ones are for display, one run at a time, with one column per model
in the order of the ranks. Only that list of models comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions import arrays
from evalspark.functions import text as T
from evalspark.operators.positions import with_positions

# Fixed value: a subject is flagged when models differ by at least 4 points (0.04).
SPREAD_FLAG = 0.04


def subject_rows(subjects: DataFrame) -> DataFrame:
    """F8: drop the overall row (task ``mmlu`` / ``is_overall``) and rows without accuracy."""
    out = subjects.filter(F.col("acc").isNotNull())
    if "is_overall" in subjects.columns:
        out = out.filter(~F.col("is_overall"))
    return out.filter(F.col("subject") != F.lit("mmlu"))


def _with_model_counts(rows: DataFrame) -> DataFrame:
    """Adds ``n_models`` (models with the subject) and ``run_models`` (all models of the run with
    subject results): windows over the already aggregated (run, model, subject) rows."""
    subject, run = Window.partitionBy("run_id", "subject"), Window.partitionBy("run_id")
    return (rows.withColumn("n_models", F.size(F.collect_set("model_id").over(subject)))
            .withColumn("run_models", F.collect_set("model_id").over(run)))


def subject_spread(subjects: DataFrame) -> DataFrame:
    """A15 + F7 + F9: per subject max - min accuracy over models.

    Kept only when at least two models have the subject and at least two models
    of the run have subject results at all; the first implies the second.
    """
    per = subject_rows(subjects).groupBy("run_id", "subject").agg(
        (F.max("acc") - F.min("acc")).alias("spread"), F.count_distinct("model_id").alias("n_models"))
    return per.filter(F.col("n_models") >= 2).withColumn("flagged", F.col("spread") >= F.lit(SPREAD_FLAG))


def subject_matrix_long(subjects: DataFrame) -> DataFrame:
    """A16 + J3 (long): one cell per kept subject x model with subject results; absent -> NULL.

    One pass over the accuracy rows: every kept subject carries its cells as a map and the run's
    model list (both bounded by the models of the run) and unfolds them.
    """
    kept = _with_model_counts(subject_rows(subjects)).filter(F.col("n_models") >= 2)
    per = kept.groupBy("run_id", "subject").agg(
        F.map_from_entries(F.collect_list(F.struct("model_id", "acc"))).alias("_cells"), F.first("run_models").alias("_models"))
    grid = per.select("run_id", "subject", "_cells", F.explode("_models").alias("model_id"))
    return grid.select("run_id", "subject", "model_id", F.try_element_at("_cells", F.col("model_id")).alias("acc"))


# The marks of a wide spread and of an absent cell.
WIDE_SPREAD, ABSENT = " †", "–"


def ranked_models(leaderboard: DataFrame, run_id: str, having: DataFrame) -> list[str]:
    """Models of a run that occur in ``having`` (model_id), in the order of the report: by rank, then unscored ones in input order."""
    rows = leaderboard.filter(F.col("run_id") == run_id).select("model_id", "rank", "ordinal")
    rows = rows.join(having.select("model_id").distinct(), "model_id", "left_semi")
    # one row per model of the run
    return [r["model_id"] for r in rows.orderBy(F.asc_nulls_last("rank"), "ordinal").collect()]


def _wide(cells: DataFrame, rows: list[str], models: list[str]) -> DataFrame:
    """``rows`` with one column per model; ``cells`` has rows, model_id, cell."""
    return cells.groupBy(*rows).pivot("model_id", models).agg(F.first("cell")).na.fill(ABSENT, models)


def subject_matrix_wide(subjects: DataFrame, leaderboard: DataFrame, run_id: str) -> tuple[DataFrame, list[str]]:
    """A16 + O2 for one run: line_no, subject, spread and one text column per ranked model, and the models in column order.

    Subjects that two models have, sorted by falling spread, then by name; accuracies and spreads in points with
    one decimal, a spread of 4 points or more is marked, a model without the subject reads ``–``. The table has a
    row per subject.
    """
    mine = subjects.filter(F.col("run_id") == run_id)
    found = subject_rows(mine)
    models = ranked_models(leaderboard, run_id, found)
    spread = subject_spread(mine)
    order = Window.partitionBy("run_id").orderBy(F.col("spread").desc(), "subject")
    points = lambda c: T.fixed(F.col(c) * F.lit(100.0), 1)
    lines = spread.select("subject", F.row_number().over(order).cast("bigint").alias("line_no"),
                          F.concat(points("spread"), F.when(F.col("flagged"), F.lit(WIDE_SPREAD)).otherwise(F.lit(""))).alias("spread"))
    wide = _wide(found.select("subject", "model_id", points("acc").alias("cell")), ["subject"], models)
    return lines.join(wide, "subject").select("line_no", "subject", "spread", *models), models


def exercise_matrix_wide(flags: DataFrame, leaderboard: DataFrame, run_id: str) -> tuple[DataFrame, list[str]]:
    """A17 + O3 + P18 for one run: line_no, language, exercise and one text column per ranked model with results, and the models.

    Rows by exercise name, then language; their places are found without a window over all rows.
    """
    mine = flags.filter(F.col("run_id") == run_id)
    models = ranked_models(leaderboard, run_id, mine)
    cell = arrays.exercise_cell("pass_1", "pass_any").alias("cell")
    wide = _wide(mine.select("language", "exercise", "model_id", cell), ["language", "exercise"], models)
    lines = with_positions(wide, [F.col("exercise"), F.col("language")], "line_no")
    return lines.select((F.col("line_no") + 1).alias("line_no"), "language", "exercise", *models), models
