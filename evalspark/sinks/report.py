"""Report tables and writers.

The leaderboard produced by ``operators.composite`` stays a DataFrame; these
functions shape it into the nested report record, the ranked display table
and the per-model detail table, and write them partitioned by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions import stats
from evalspark.functions import text as T

# Display labels of the components.
LABELS = {"ppl": "PPL", "mmlu": "MMLU", "coding": "Coding"}


def _label(c):
    m = F.create_map(*[x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, c), c)


def ordered(leaderboard: DataFrame) -> DataFrame:
    """O1: ranked models first, then unscored ones in input order."""
    return leaderboard.orderBy("run_id", F.asc_nulls_last("rank"), "ordinal")


def cells(lb: DataFrame) -> DataFrame:
    """The numbers behind the display cells, one column each: ``lb`` with ppl_half, acc_pct, acc_half,
    pass1_half, pass2_half (Wilson). Missing stages leave NULL."""
    done = F.coalesce(F.col("completed"), F.lit(0)) > 0
    half = lambda k, rate: F.when(done & F.col(rate).isNotNull(), stats.pass_ci_half(k, "completed", rate))
    return (lb.withColumn("ppl_half", F.lit(1.96) * F.col("ppl_se"))
            .withColumn("acc_pct", F.col("acc_score") * 100.0).withColumn("acc_half", F.lit(1.96) * F.col("acc_stderr") * 100.0)
            .withColumn("pass1_half", half("pass_num_1", "pass_rate_1")).withColumn("pass2_half", half("pass_num_2", "pass_rate_2")))


def _say(*parts) -> Column:
    """Texts and columns joined; NULL if a column is."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _maybe(*parts) -> Column:
    """Like ``_say``, but nothing if a column is NULL."""
    return F.coalesce(_say(*parts), F.lit(""))


def with_lines(lb: DataFrame) -> DataFrame:
    """O1 as a column: ``line_no`` from 1 within the run, ranked models first, then the others in input order (model rows only)."""
    w = Window.partitionBy("run_id").orderBy(F.asc_nulls_last("rank"), F.col("ordinal"))
    return lb.withColumn("line_no", F.row_number().over(w).cast("bigint"))


def leaderboard_display(lb: DataFrame, tries: int = 2) -> DataFrame:
    """K2: text cells of the ranked table: rank or ``-``, label, PPL±, accuracy ±, pass@1 ±, pass@N ±,
    first-token time, token rate, score with marks; ``line_no`` is the display order.

    The PPL cell carries the PPL's own interval (1.96 SE), not that of its score points.
    """
    c = cells(with_lines(lb))
    na = F.lit("n/a")
    fixed = T.fixed

    def rate(value: str, half: str):
        return F.coalesce(_say(fixed(value, 1), "% ±", fixed(half, 1)), T.fmt_pct(value))

    def passed(value: str, half: str):
        return F.coalesce(_say(fixed(value, 1), "% ±", fixed(half, 1)), na)

    number = lambda name: T.fmt_num(F.col(name)) if name in lb.columns else na
    score = F.coalesce(_say(fixed("score", 2), T.score_marks("nonsignificant", "missing_components")), na)
    label = F.coalesce("label", "model_id") if "label" in lb.columns else F.col("model_id")
    return ordered(c).select(
        "run_id", "model_id", "rank", "ordinal", "line_no",
        F.coalesce(F.col("rank").cast("string"), F.lit("-")).alias("rank_cell"), label.alias("label_cell"),
        F.coalesce(_say(fixed("ppl", 2), "±", fixed("ppl_half", 2)), fixed("ppl", 2), na).alias("ppl_cell"), rate("acc_pct", "acc_half").alias("accuracy_cell"),
        passed("pass_rate_1", "pass1_half").alias("pass1_cell"), passed("pass_rate_2", "pass2_half").alias(f"pass{tries}_cell"),
        number("ttft_ms_p50").alias("ttft_cell"), number("tok_s_median").alias("rate_cell"), score.alias("score_cell"))


# Texts under the table, by mark.
LEGENDS = {"*": "the difference to a neighbouring rank is not significant at the 95 % level",
           "†": "scored on a part of the components only, not directly comparable with complete rows"}


def legends(lb: DataFrame) -> DataFrame:
    """Below K2: (run_id, mark, text) for every mark that the run's table shows."""
    shown = lb.groupBy("run_id").agg(F.bool_or("nonsignificant").alias("*"), F.bool_or(F.size("missing_components") > 0).alias("†"))
    marks = F.array(*[F.when(F.col(f"`{m}`"), F.struct(F.lit(m).alias("mark"), F.lit(t).alias("text"))) for m, t in LEGENDS.items()])
    return shown.select("run_id", F.inline(F.array_compact(marks)))


def model_details(lb: DataFrame, tries: int = 2) -> DataFrame:
    """K5 + J7: breakdown ``w×label(v) + …``, missing list, and one line per stage: accuracy ± with n, pass rates with
    their Wilson bounds and completed/total, PPL ± with tokens, every run and fidelity, latency with p50 and p95, and the
    stages' errors; ``line_no`` is the order."""
    lb = cells(with_lines(lb))
    has = set(lb.columns)
    fixed = T.fixed
    text = lambda name: F.col(name).cast("string") if name in has else F.lit(None).cast("string")
    number = lambda name, digits: fixed(name, digits) if name in has else F.lit(None).cast("string")
    parts = F.transform("components", lambda c: _say(fixed(c["weight"], 2), "×", _label(c["component"]), "(", fixed(c["value"], 1), ")"))
    w1, w2 = stats.wilson_ci("pass_num_1", "completed"), stats.wilson_ci("pass_num_2", "completed")
    done = _say(F.col("completed").cast("string"), "/", F.coalesce(text("total"), F.lit("?")))
    bounds = lambda rate, w: _say(fixed(rate, 1), "% [", fixed(w["lo"], 1), "-", fixed(w["hi"], 1), "]")
    each = F.array_join(F.transform("runs", lambda r: fixed(r["ppl"], 2)), ", ") if "runs" in has else F.lit(None).cast("string")
    runs = F.coalesce(_say(" (", text("n_runs"), " runs: ", each, ")"), _maybe(" (", text("n_runs"), " runs)"))
    tokens = _maybe(", ~", fixed(F.col("n_tokens") / 1000, 0), "K tokens") if "n_tokens" in has else F.lit("")
    facts = F.array_compact(F.array(
        _say("accuracy ", fixed("acc_pct", 2), "%", _maybe(" ± ", fixed("acc_half", 2), " pts"), _maybe(" (n=", text("n_samples"), ")")),
        F.when(F.col("pass1_half").isNotNull() & F.col("pass2_half").isNotNull(), _say(
            "pass@1 ", bounds("pass_rate_1", w1), f", pass@{tries} ", bounds("pass_rate_2", w2), " (", done, " tests)"))
        .when(F.col("completed").isNotNull(), _say("no completed tests (", done, ")")),
        _say("PPL ", fixed("ppl", 2), _maybe(" ±", fixed("ppl_half", 2)), tokens, runs, _maybe(", fidelity ", fixed("ppl_score", 1), "/100")),
        _say("first token p50 ", number("ttft_ms_p50", 0), " ms", _maybe(" (p95 ", number("ttft_ms_p95", 0), " ms)"), ", ", number("tok_s_median", 1), " tok/s over ",
             text("n_requests"), " requests"),
        *[_say(c.removesuffix("_error") + " error: ", F.col(c)) for c in lb.columns if c.endswith("_error")]))
    return lb.select(
        "run_id", "model_id", "line_no", "rank", _say(fixed("score", 2), T.score_marks("nonsignificant", "missing_components")).alias("score"), "score_ci_half",
        F.array_join(parts, " + ").alias("breakdown"), F.array_join(F.transform("missing_components", _label), ", ").alias("missing"),
        F.array_join(facts, "; ").alias("facts"))


def report_records(lb: DataFrame) -> DataFrame:
    """K1: one nested record per model: identity, rank, score, marks, components with their CI, and one object
    per stage, which is NULL where the stage has no result and ``{error}`` where it failed (T9)."""
    lb = cells(lb)
    has = set(lb.columns)
    comps = F.transform("components", lambda c: F.struct(
        c["component"].alias("name"), F.round(c["weight"], 4).alias("weight"), F.round(c["value"], 2).alias("value"),
        F.round(c["ci_half"], 2).alias("ci_half")))
    wilson = stats.wilson_ci("pass_num_2", "completed")

    def stage(name: str, present, *fields):
        named = {"perplexity": "ppl"}.get(name, name) + "_error"
        error = F.col(named) if named in has else F.lit(None).cast("string")
        body = [F.when(present, f).alias(n) for n, f in fields]
        return F.when(present | error.isNotNull(), F.struct(*body, error.alias("error"))).alias(name)

    known = lambda *names: [(n, F.col(n)) for n in names if n in has]
    identity = [c for c in ("run_id", "model_id", "ordinal", "label", "path", "flags", "rank", "score", "score_ci_half", "nonsignificant", "missing_components") if c in has]
    return lb.select(
        *identity, (F.size("missing_components") > 0).alias("partial"), comps.alias("components"),
        stage("accuracy", F.col("acc_score").isNotNull(), ("score", F.col("acc_score")), ("score_stderr", F.col("acc_stderr")), *known("n_samples"), ("ci_half", F.col("acc_half"))),
        stage("coding", F.col("completed").isNotNull(), *known("completed", "total", "pass_num_1", "pass_num_2", "pass_rate_1", "pass_rate_2", "prompt_tokens", "completion_tokens"),
              ("ci_low", wilson["lo"]), ("ci_high", wilson["hi"])),
        stage("perplexity", F.col("ppl").isNotNull(), *known("ppl", "ppl_se", "n_runs", "run_min", "run_max", "runs", "n_tokens"), ("fidelity", F.col("ppl_score")), ("ci_half", F.col("ppl_ci_half"))),
        stage("latency", F.col("n_requests").isNotNull() if "n_requests" in has else F.lit(False),
              *known("n_requests", "ttft_ms_mean", "ttft_ms_p50", "ttft_ms_p95", "tok_s_mean", "tok_s_median", "total_tokens")))


def write_report(lb: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """K1 writer: nested records, one folder per run (idempotent overwrite of the run's partition)."""
    (report_records(lb).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").format(fmt).save(path))


def run_meta(runs: DataFrame) -> DataFrame:
    """K4: run metadata; options of skipped stages are NULL, duration rounded to 0.1 s.

    The accuracy limit and the number of tries are kept even when their stage is skipped; the
    perplexity options depend on whether a reference text was available.
    """
    on = lambda skipped, c: F.when(~F.coalesce(F.col(skipped), F.lit(False)), F.col(c)).alias(c)
    have_ppl = lambda c: F.when(F.coalesce(F.col("ppl_available"), F.lit(False)), F.col(c)).alias(c)
    return runs.select(
        "run_id", "binary", "version", "config", F.round(F.col("duration_s"), 1).alias("duration_s"), on("skip_mmlu", "mmlu_task"), "mmlu_limit",
        on("skip_coding", "languages"), on("skip_coding", "coding_limit"), on("skip_coding", "coding_kv_fix"), "coding_tries",
        have_ppl("weights_ppl"), have_ppl("ppl_reference"))

