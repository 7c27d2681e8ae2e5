"""Evaluation-harness metric documents.

A document is JSON ``{"results": {task: {metric: value}}, "groups": {task: {...}}}``.
Values are parsed as ``variant`` so numbers, booleans and text can be told
apart (only true numbers count, SURVEY P4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.text import subject_name

METRICS_SCHEMA = "map<string, map<string, variant>>"
# Fixed value: primary metric per task.
PRIMARY_METRIC = {"mmlu": "acc", "mmlu_generative": "exact_match"}


def number(v: Column) -> Column:
    """A variant as double only when it holds a number (booleans and text give NULL)."""
    kind = F.schema_of_variant(v)
    is_num = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.when(is_num, F.try_variant_get(v, "$", "double"))


def metric(metrics: Column, name: str) -> Column:
    """``m["<name>,none"]`` if it is a number, else ``m["<name>"]`` if it is a number."""
    return F.coalesce(number(F.try_element_at(metrics, F.lit(f"{name},none"))),
                      number(F.try_element_at(metrics, F.lit(name))))


def parse_metrics(docs: DataFrame, col: str = "json") -> DataFrame:
    """Parse documents into ``results`` and ``groups`` maps of variant metrics."""
    schema = f"struct<results: {METRICS_SCHEMA}, groups: {METRICS_SCHEMA}>"
    return docs.withColumn("_m", F.from_json(F.col(col), schema)) \
        .withColumn("results", F.col("_m.results")).withColumn("groups", F.col("_m.groups")).drop("_m")


def task_summary(parsed: DataFrame, task: str = "mmlu") -> DataFrame:
    """S7 task row: ``groups[task]`` else ``results[task]``; score, stderr, n_samples."""
    filled = lambda c: F.when(F.size(F.try_element_at(c, F.lit(task))) > 0, F.try_element_at(c, F.lit(task)))
    m = F.coalesce(filled("groups"), filled("results"))
    name = PRIMARY_METRIC.get(task, "acc")
    n = number(F.try_element_at(m, F.lit("sample_len")))
    return (parsed.withColumn("_tm", m)
            .withColumn("score", metric(F.col("_tm"), name))
            .withColumn("score_stderr", metric(F.col("_tm"), f"{name}_stderr"))
            .withColumn("n_samples", F.coalesce(n.cast("bigint"), F.lit(0).cast("bigint")))
            .withColumn("error", F.when(F.col("_tm").isNull(), F.lit(f"no results for task {task!r}"))
                        .when(F.col("score").isNull(), F.lit(f"metric {name!r} not found")))
            .drop("_tm"))


def subject_accuracy_from_metrics(parsed: DataFrame, keys=("run_id", "model_id")) -> DataFrame:
    """F8 + P19: per subject ``acc,none`` (tasks other than the overall ``mmlu``)."""
    keys = list(keys)
    out = parsed.select(*keys, F.explode("results").alias("task", "metrics"))
    return (out.filter(F.col("task") != "mmlu")
            .select(*keys, subject_name(F.col("task")).alias("subject"),
                    number(F.try_element_at("metrics", F.lit("acc,none"))).alias("acc"))
            .filter(F.col("acc").isNotNull()))


def render_metrics(subjects: DataFrame, overall: DataFrame, keys=("run_id", "model_id")) -> DataFrame:
    """Build metric documents from accuracy tables (the inverse of ``parse_metrics``).

    ``subjects``: keys, subject, acc, acc_stderr, n; ``overall``: keys, acc, acc_stderr, n.
    One document per model; its size is bounded by the number of subjects.
    """
    keys = list(keys)

    def entry(task: Column) -> Column:
        return F.struct(task.alias("task"), F.create_map(
            F.lit("acc,none"), F.col("acc"), F.lit("acc_stderr,none"), F.col("acc_stderr"),
            F.lit("sample_len"), F.col("n").cast("double")).alias("m"))

    subj = subjects.select(*keys, entry(F.concat(F.lit("mmlu_"), F.col("subject"))).alias("e"))
    over = overall.select(*keys, entry(F.lit("mmlu")).alias("e"))
    per = (subj.unionByName(over).groupBy(*keys)
           .agg(F.map_from_entries(F.collect_list(F.struct(F.col("e.task"), F.col("e.m")))).alias("results")))
    grp = overall.select(*keys, F.create_map(F.lit("mmlu"), F.create_map(
        F.lit("acc,none"), F.col("acc"), F.lit("acc_stderr,none"), F.col("acc_stderr"),
        F.lit("sample_len"), F.col("n").cast("double"))).alias("groups"))
    return per.join(grp, keys, "left").select(*keys, F.to_json(F.struct("results", "groups")).alias("json"))


def write_task_results(parsed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: raw per-task, per-model metrics, partitioned by task and model slug."""
    (parsed.select("run_id", "model_id", F.explode("results").alias("task", "metrics"))
     .select("run_id", "task", "model_id", F.to_json("metrics").alias("metrics"))
     .write.mode(mode).partitionBy("task", "model_id").json(path))


def read_task_results(spark: SparkSession, path: str, tasks: list[str] | None = None) -> DataFrame:
    """K3 read back and flattened: run_id, model_id, task, subject (task without ``mmlu_``), metric and numeric value;
    ``tasks`` prunes folders. Metrics that are no number are left out."""
    df = spark.read.schema("run_id string, metrics string, task string, model_id string").json(path)
    if tasks:
        df = df.filter(F.col("task").isin(tasks))
    out = df.select("run_id", "model_id", "task", F.explode(F.from_json("metrics", "map<string, variant>")).alias("metric", "_v"))
    out = out.select("run_id", "model_id", "task", subject_name(F.col("task")).alias("subject"), "metric", number(F.col("_v")).alias("value"))
    return out.filter(F.col("value").isNotNull())
