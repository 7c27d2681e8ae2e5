"""Coding-exercise outcomes: pass flags, pass@N summaries, progress, run lookup.

Covers P17, A5, A6, A17, A19, A20, S3, S4/W4, W6, J3, J4. Inputs are either
the nested records table (one row per finished exercise, ``tests_outcomes``
array) or the long tries table (one row per try).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions import arrays, stats

MODEL_KEYS = ["run_id", "model_id"]
EXERCISE_KEYS = ["run_id", "model_id", "language", "exercise"]


def flags_from_records(records: DataFrame, outcomes: str = "tests_outcomes") -> DataFrame:
    """P17 on the nested form: add ``pass_1`` and ``pass_any`` per record."""
    p1, p_any = arrays.pass_flags(F.col(outcomes))
    return records.withColumn("pass_1", p1).withColumn("pass_any", p_any)


def flags_from_tries(tries: DataFrame, order_cols: list[str], passed: str = "passed",
                     keys=EXERCISE_KEYS) -> DataFrame:
    """P17 on the long form: one row per exercise from its tries.

    ``pass_1`` is the outcome of the earliest try in ``order_cols`` order
    (``min_by`` over a struct key), ``pass_any`` is ``bool_or``. Both are
    ordinary aggregates: tries are combined map-side, never sorted per exercise.
    """
    # one fixed-width order column (a try number or time) keeps this a hash aggregate;
    # a composite order needs a struct key, which Spark aggregates sort-based
    order = F.col(order_cols[0]) if len(order_cols) == 1 else F.struct(*[F.col(c) for c in order_cols])
    return (tries.groupBy(*keys)
            .agg(F.min_by(F.col(passed), order).alias("pass_1"),
                 F.bool_or(F.col(passed)).alias("pass_any"),
                 F.count(F.lit(1)).alias("n_tries")))


def first_n_tries(tries: DataFrame, n: int, order_cols: list[str], keys=EXERCISE_KEYS) -> DataFrame:
    """Keep the first ``n`` tries of each exercise (the repair-loop length).

    ``row_number() <= n`` becomes a WindowGroupLimit on both sides of the
    exchange, so a huge exercise group ships at most ``n`` rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc() for c in order_cols])
    return (tries.withColumn("try_no", F.row_number().over(w).cast("bigint"))
            .filter(F.col("try_no") <= n))


def pass_summary(flags: DataFrame, keys=MODEL_KEYS) -> DataFrame:
    """A5 (+P9/P11): completed, pass counts, rates in percent, Wilson CI half-width.

    ``completed`` counts readable non-empty records, including empty outcome
    lists (SURVEY T21); rates are NULL when nothing was completed.
    """
    agg = flags.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("completed"),
        F.count_if(F.col("pass_1")).alias("pass_num_1"),
        F.count_if(F.col("pass_any")).alias("pass_num_2"),
    )
    done = F.col("completed") > 0
    rate = lambda k: F.when(done, F.lit(100.0) * F.col(k) / F.col("completed"))
    return (agg.withColumn("pass_rate_1", rate("pass_num_1"))
            .withColumn("pass_rate_2", rate("pass_num_2"))
            .withColumn("pass_ci_half", stats.pass_ci_half("pass_num_2", "completed", "pass_rate_2")))


def token_totals(records: DataFrame, keys=MODEL_KEYS) -> DataFrame:
    """Prompt and completion token sums, NULL counted as 0; rows may be exercises or single tries."""
    return records.groupBy(*keys).agg(
        F.sum(F.coalesce(F.col("prompt_tokens"), F.lit(0))).cast("bigint").alias("prompt_tokens"),
        F.sum(F.coalesce(F.col("completion_tokens"), F.lit(0))).cast("bigint").alias("completion_tokens"),
    )


def pass_by_language_rollup(flags: DataFrame) -> DataFrame:
    """A5 by (model, language) with per-model totals via ``rollup``.

    The total row has ``language = NULL`` and ``is_total = true``; the grand
    total over models is dropped.
    """
    agg = (flags.rollup("run_id", "model_id", "language")
           .agg(F.count(F.lit(1)).alias("completed"),
                F.count_if(F.col("pass_1")).alias("pass_num_1"),
                F.count_if(F.col("pass_any")).alias("pass_num_2"),
                F.grouping_id().alias("_gid")))
    agg = agg.filter(F.col("_gid") <= 1).filter(F.col("model_id").isNotNull() | (F.col("_gid") == 0))
    done = F.col("completed") > 0
    return (agg.withColumn("is_total", F.col("_gid") == 1).drop("_gid")
            .withColumn("pass_rate_1", F.when(done, F.lit(100.0) * F.col("pass_num_1") / F.col("completed")))
            .withColumn("pass_rate_2", F.when(done, F.lit(100.0) * F.col("pass_num_2") / F.col("completed"))))


def exercise_matrix_long(flags: DataFrame, models: DataFrame) -> DataFrame:
    """A17 + J3 + P18: one cell per (run, language, exercise, model of the run); absent cells read ``–``.

    The grid is the result: a run's exercises meet that run's models on ``run_id``
    (the model side is the small one; AQE decides from measured sizes), and the
    flags are joined to it on the full key.
    """
    exercises = flags.select("run_id", "language", "exercise").distinct()
    grid = exercises.join(models.select("run_id", "model_id").distinct(), "run_id")
    out = grid.join(flags.select("run_id", "model_id", "language", "exercise", "pass_1", "pass_any"),
                    ["run_id", "model_id", "language", "exercise"], "left")
    return out.withColumn("cell", arrays.exercise_cell("pass_1", "pass_any")).drop("pass_1", "pass_any")


# ---- run directories and progress (S2, S3, S4/W4, A19, J4) -----------------------------------

# Fixed value: run directory names are "<YYYY-MM-DD-HH-MM-SS>--<model>".
RUN_DIR_PATTERN = r"^(\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2})--(.+)$"


def parse_run_dir(run: Column) -> tuple[Column, Column]:
    """Split a run directory name into (started timestamp, model slug); NULLs if it does not match."""
    ts_txt = F.regexp_extract(run, RUN_DIR_PATTERN, 1)
    slug = F.regexp_extract(run, RUN_DIR_PATTERN, 2)
    started = F.try_to_timestamp(F.nullif(ts_txt, F.lit("")), F.lit("yyyy-MM-dd-HH-mm-ss"))
    return started, F.nullif(slug, F.lit(""))


def count_done(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Result files present per run and language (content ignored, SURVEY T2)."""
    if languages:
        files = files.filter(F.col("language").isin(sorted(set(languages))))
    return files.groupBy("run", "language").agg(F.count(F.lit(1)).alias("done"))


def total_exercises(catalog: DataFrame, languages: list[str] | None = None, cap: int = 0) -> DataFrame:
    """S3: catalog exercises for the languages, capped at ``cap`` when positive.

    An empty language list means all languages (documented meaning, SURVEY T4);
    distinct exercises are counted.
    """
    if languages:
        catalog = catalog.filter(F.col("language").isin(sorted(set(languages))))
    total = catalog.agg(F.count_distinct("language", "exercise").alias("total"))
    if cap and cap > 0:
        total = total.select(F.least(F.col("total"), F.lit(cap).cast("bigint")).alias("total"))
    return total


def run_totals(exercise_dirs: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """S3, run directory: exercise folders per run (run, language, exercise), of the given languages; a
    folder counts whether or not its result has landed."""
    if languages:
        exercise_dirs = exercise_dirs.filter(F.col("language").isin(sorted(set(languages))))
    return exercise_dirs.groupBy("run").agg(F.count_distinct("language", "exercise").alias("total"))


def progress(files: DataFrame, catalog: DataFrame, languages: list[str] | None = None, cap: int = 0) -> DataFrame:
    """Done / total per run (summed over the selected languages)."""
    done = count_done(files, languages).groupBy("run").agg(F.sum("done").cast("bigint").alias("done"))
    total = total_exercises(catalog, languages, cap)
    # one-row total: attach as a scalar subquery value, not as a join
    return done.withColumn("total", total.select("total").scalar())


def latest_run(runs: DataFrame, model_slug: str | None = None) -> DataFrame:
    """Most recently modified run per model slug (anchored name match, T5).

    ``runs`` columns: run, mtime. With ``model_slug`` the fallback of the
    reference applies: if no run of that model exists, the most recent of any.
    """
    started, slug = parse_run_dir(F.col("run"))
    parsed = runs.withColumn("slug", slug).withColumn("started", started)
    per_model = (parsed.filter(F.col("slug").isNotNull())
                 .groupBy("slug")
                 .agg(F.max_by("run", F.struct("mtime", "run")).alias("run"),
                      F.max("mtime").alias("mtime")))
    if model_slug is None:
        return per_model
    mine = per_model.filter(F.col("slug") == model_slug).select("run", "mtime")
    overall = parsed.agg(F.max_by("run", F.struct("mtime", "run")).alias("run"), F.max("mtime").alias("mtime"))
    return mine.unionByName(overall.filter(~mine.exists()))


def cap_exercises(catalog: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` exercises per language, chosen in a seeded hash order (reproducible).

    The cap is the feature (the run's test limit). ``row_number() <= n`` per
    language becomes a WindowGroupLimit, so each map task forwards at most ``n``
    rows per language.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("exercise")))
    w = Window.partitionBy("language").orderBy(key, F.col("exercise"))
    return catalog.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def new_runs(after: DataFrame, before: DataFrame) -> DataFrame:
    """Run directories that did not exist before the start (anti join on the name)."""
    return after.join(before.select("run").distinct(), "run", "left_anti")
