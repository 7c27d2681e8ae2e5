"""The query catalogue: one Spark query per operator family, each with a DuckDB twin.

Every query reads the given tables through ``plans.fixtures`` recipes and runs
over the whole tables. Computed doubles are rounded to 6 decimals in both the
Spark and the SQL form (sums of doubles depend on order, SURVEY T32).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions import text as T
from evalspark.operators import accuracy, composite, hooks, latency, loglik, matrices, ngram, outcomes, perplexity, stages
from evalspark.sinks import report
from evalspark.sources import files, metrics, registry
from evalspark.streaming import jobs
from evalspark.plans import fixtures as fx
from evalspark.session import cut_lineage

QueryFn = Callable[[SparkSession, str], DataFrame]

# Flagship options: weights_mmlu 0.5 and weights_ppl 0.5 give ppl .5, mmlu .25, coding .25.
FLAGSHIP_OPTIONS = {"weights_mmlu": 0.5, "weights_ppl": 0.5, "ppl_available": True}


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def r5(c) -> Column:
    """Percentiles of millisecond values: inputs are multiples of 0.001 and the interpolation
    fractions multiples of 0.05, so exact results are multiples of 0.00005; 5 decimals never
    meet a rounding tie, whichever interpolation formula an engine uses."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 5)


def r3(c) -> Column:
    """Large-magnitude sums and means (milliseconds since midnight, summed log-probs): 3 decimals
    keep the comparison independent of the summation order (SURVEY T32)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 3)


# ---- stage tables shared by several queries ------------------------------------------------

def accuracy_stage(spark, sf):
    return accuracy.group_accuracy(fx.item_results(spark, sf))


def coding_flags(spark, sf, language=None):
    return outcomes.flags_from_tries(fx.tries(spark, sf, language), fx.TRY_ORDER)


def coding_stage(spark, sf):
    return outcomes.pass_summary(coding_flags(spark, sf))


def leaderboard(spark, sf):
    return composite.composite_leaderboard(
        fx.models(spark, sf), FLAGSHIP_OPTIONS, accuracy_stage(spark, sf), coding_stage(spark, sf),
        fx.ppl_model_summary(spark, sf))


# ---- queries -------------------------------------------------------------------------------

def q_composite_leaderboard(spark, sf):
    lb = leaderboard(spark, sf)
    return lb.select("run_id", "model_id", F.col("ordinal").cast("bigint").alias("ordinal"), "rank",
                     r6("score").alias("score"), r6("score_ci_half").alias("score_ci_half"),
                     "nonsignificant", F.array_join("missing_components", ",").alias("missing"),
                     F.size("components").cast("bigint").alias("n_components"))


def q_subject_accuracy(spark, sf):
    res = accuracy.subject_and_model_accuracy(fx.item_results(spark, sf))
    return res.select("run_id", "model_id", F.coalesce("subject", F.lit("(all)")).alias("subject"),
                      r6("acc").alias("acc"), r6("acc_stderr").alias("acc_stderr"),
                      r6(F.lit(1.96) * F.col("acc_stderr") * 100).alias("ci_half"),
                      F.col("n").cast("bigint").alias("n"), "is_overall")


def q_limit_per_subject(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("lang").alias("subject"), F.col("doc_id").alias("doc_no"),
                                                   "source")
    out = accuracy.limit_per_subject(docs, 50, "subject", "doc_no")
    return out.select("subject", "doc_no", "source")


def q_pass_summary(spark, sf):
    s = coding_stage(spark, sf)
    ci = F.col("pass_ci_half")
    return s.select("run_id", "model_id", "completed", "pass_num_1", "pass_num_2",
                    r6("pass_rate_1").alias("pass_rate_1"), r6("pass_rate_2").alias("pass_rate_2"),
                    r6(ci).alias("pass_ci_half"))


def q_pass_by_language_rollup(spark, sf):
    flags = coding_flags(spark, sf, "linestatus")
    s = outcomes.pass_by_language_rollup(flags)
    return s.select("run_id", "model_id", F.coalesce("language", F.lit("(all)")).alias("language"),
                    "completed", "pass_num_1", "pass_num_2",
                    r6("pass_rate_1").alias("pass_rate_1"), r6("pass_rate_2").alias("pass_rate_2"), "is_total")


def q_token_totals(spark, sf):
    return outcomes.token_totals(fx.try_tokens(spark, sf))


def q_first_n_tries(spark, sf):
    t = outcomes.first_n_tries(fx.tries(spark, sf), 2, fx.TRY_ORDER)
    return (t.groupBy("run_id", "model_id", "try_no")
            .agg(F.count(F.lit(1)).alias("n_tries"), F.count_if("passed").alias("n_passed")))


def q_exercise_matrix_long(spark, sf):
    flags = coding_flags(spark, sf)
    m = outcomes.exercise_matrix_long(flags, fx.models(spark, sf))
    return m.select("run_id", "language", "exercise", "model_id", "cell")


def q_progress(spark, sf):
    return outcomes.progress(fx.result_files(spark, sf), fx.exercise_catalog(spark, sf), ["F", "O"], 0)


def q_latest_run(spark, sf):
    files = fx.result_files(spark, sf)
    runs = files.groupBy("run").agg(F.max("mtime").alias("mtime"))
    return outcomes.latest_run(runs).select("slug", "run", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss").alias("mtime"))


def q_new_runs(spark, sf):
    files = fx.result_files(spark, sf)
    runs = files.groupBy("run").agg(F.max("mtime").alias("mtime"))
    before = runs.filter(F.col("mtime") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return outcomes.new_runs(runs, before).select("run", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss").alias("mtime"))


def q_request_latency(spark, sf):
    per = latency.request_latency(fx.chunks(spark, sf))
    return per.select("run_id", "model_id", "request_id", "n_tokens", r3("ttft_ms").alias("ttft_ms"),
                      r3("tok_s").alias("tok_s"))


def q_latency_summary(spark, sf):
    s = latency.latency_summary(latency.request_latency(fx.chunks(spark, sf)))
    return s.select("run_id", "model_id", "n_requests", r3("ttft_ms_mean").alias("ttft_ms_mean"),
                    r5("ttft_ms_p50").alias("ttft_ms_p50"), r5("ttft_ms_p95").alias("ttft_ms_p95"),
                    r3("tok_s_mean").alias("tok_s_mean"), r3("tok_s_median").alias("tok_s_median"),
                    "total_tokens")


def q_ppl_log_parse(spark, sf):
    p = perplexity.parse_ppl_logs(fx.ppl_logs(spark, sf))
    return p.select("run_id", "model_id", "run_no", "ppl", "ppl_se", F.col("error").isNotNull().alias("failed"))


def q_ppl_summary(spark, sf):
    p = perplexity.parse_ppl_logs(fx.ppl_logs(spark, sf))
    s = perplexity.ppl_summary(p)
    return s.select("run_id", "model_id", r6("ppl").alias("ppl"), r6("ppl_se").alias("ppl_se"), "n_runs",
                    r6("run_min").alias("run_min"), r6("run_max").alias("run_max"))


def q_token_estimate(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return (docs.groupBy(F.col("source").alias("model_id"))
            .agg(F.sum(perplexity.estimate_tokens(F.col("text"))).cast("bigint").alias("est_tokens"),
                 F.count(F.lit(1)).alias("n_docs")))


def _lookup_counts(tok: DataFrame) -> DataFrame:
    return tok.groupBy("run_id", "model_id", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("logprob").alias("sum_logprob"))


def _all_lookup_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("run_id", "model_id", "outcome").agg(F.sum("n").alias("n"), r3(F.sum("sum_logprob")).alias("sum_logprob"))


def q_token_logprob_lookup(spark, sf):
    tokens = fx.blank_some_ids(loglik.request_tokens(fx.document_requests(spark, sf), fx.token_id))

    def part(among):
        return _lookup_counts(loglik.lookup_long(tokens.filter(among(F.col("prefix_id"))), fx.ngram_candidates(spark, sf, among=among)))
    return _all_lookup_counts(loglik.by_prefix_parts(spark, part))


def q_token_logprob_lookup_nested(spark, sf):
    tokens = fx.blank_some_ids(loglik.request_tokens(fx.document_requests(spark, sf), fx.token_id))

    def part(among):
        responses = ngram.nested_responses(fx.ngram_candidates(spark, sf, among=among))
        with_resp = tokens.filter(among(F.col("prefix_id"))).join(responses, ["model_id", "prefix_id"], "left")
        return _lookup_counts(loglik.lookup_nested(with_resp))
    return _all_lookup_counts(loglik.by_prefix_parts(spark, part))


def q_request_loglik(spark, sf):
    req = fx.document_requests(spark, sf)
    tokens = fx.blank_some_ids(loglik.request_tokens(req, fx.token_id))

    def part(among):
        return loglik.request_sums(loglik.lookup_long(tokens.filter(among(F.col("prefix_id"))), fx.ngram_candidates(spark, sf, among=among)))
    s = loglik.score_request_sums(loglik.by_prefix_parts(spark, part), req)
    return s.select("run_id", "model_id", "request_id", r3("loglik").alias("loglik"), "is_greedy", "n_tokens")


# Fixed values of the hook queries: model window, new tokens, vocabulary of the adaptive scorer.
MAX_LENGTH, MAX_NEW_TOKENS, VOCABULARY = 48, 8, 10_000


def q_prefix_scores(spark, sf):
    """Whole documents scored token by token against their full prefixes."""
    s = hooks.score_with(fx.id_requests(spark, sf), lambda: hooks.AdaptiveScorer(VOCABULARY))
    return s.select("run_id", "model_id", "request_id", "request_no", r3("loglik").alias("loglik"), "is_greedy", "n_tokens")


def q_generations(spark, sf):
    """Prompts that were not answered before (those of even conversations were), cut to the model's window, with their
    generations as texts."""
    requests = fx.prompt_requests(spark, sf)
    pending = hooks.unanswered(requests, requests.filter(F.col("conv_id") % 2 == 0), ["model_id", "prompt_ids"])
    made = hooks.generate_with(pending, "prompt-lookup", MAX_LENGTH, MAX_NEW_TOKENS)
    # ids back to words: a map of the prompt's own
    named = made.join(pending.select("request_id", F.map_from_arrays(F.array_distinct("prompt_ids"), F.array_distinct("prompt")).alias("_words")), "request_id")
    named = named.withColumn("generated", F.array_join(F.transform("generated", lambda i: F.element_at("_words", i)), " "))
    return hooks.placeholder_texts(named).select("run_id", "model_id", "request_id", "request_no", "generated", "is_placeholder")


def q_choice_accuracy(spark, sf):
    req = fx.benchmark_choice_requests(spark, sf, fx.models(spark, sf))
    tokens = fx.blank_some_ids(loglik.request_tokens(req, fx.token_id))
    cands = fx.ngram_candidates(spark, sf, prefixes=tokens.select("model_id", "prefix_id"))
    tok = loglik.lookup_long(tokens, cands)
    ll = loglik.score_requests(tok, req)
    gold = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("gold"))
    items = accuracy.choice_accuracy(ll, gold)
    return (items.groupBy("run_id", "model_id")
            .agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("correct") == 1).alias("n_correct"),
                 r6(F.avg("correct")).alias("acc")))


def q_token_perplexity(spark, sf):
    lp = fx.unigram_token_logprobs(spark, sf)
    p = perplexity.token_perplexity(lp, keys=["model_id"], logprob="logprob", weight="count")
    return p.select("model_id", r6("ppl").alias("ppl"), r6("ppl_se").alias("ppl_se"), "n_tokens")


# Fixed value of the recipe: tokens of one context window.
WINDOW = 1024


def q_window_perplexity(spark, sf):
    p = perplexity.windowed_perplexity_of_words(*fx.positioned_words(spark, sf), WINDOW, ["model_id"])
    return p.select("model_id", "chunk_no", r6("ppl").alias("ppl"), r6("ppl_se").alias("ppl_se"), "n_tokens")


def _subjects(spark, sf):
    return accuracy.subject_and_model_accuracy(fx.item_results(spark, sf))


def q_subject_spread(spark, sf):
    s = matrices.subject_spread(_subjects(spark, sf))
    return s.select("run_id", "subject", r6("spread").alias("spread"), "n_models", "flagged")


def q_subject_matrix(spark, sf):
    m = matrices.subject_matrix_long(_subjects(spark, sf))
    return m.select("run_id", "subject", "model_id", r6("acc").alias("acc"))


def _metric_docs(spark, sf):
    res = _subjects(spark, sf)
    subj = res.filter(~F.col("is_overall"))
    overall = res.filter(F.col("is_overall"))
    return metrics.parse_metrics(metrics.render_metrics(subj, overall))


def q_metrics_task_summary(spark, sf):
    s = metrics.task_summary(_metric_docs(spark, sf), "mmlu")
    return s.select("run_id", "model_id", r6("score").alias("score"), r6("score_stderr").alias("score_stderr"),
                    "n_samples", "error")


def q_metrics_generative(spark, sf):
    s = metrics.task_summary(metrics.parse_metrics(fx.generative_metric_docs(spark, sf)), "mmlu_generative")
    return s.select("run_id", "model_id", r6("score").alias("score"), "n_samples", "error")


def q_metrics_subjects(spark, sf):
    s = metrics.subject_accuracy_from_metrics(_metric_docs(spark, sf))
    return s.select("run_id", "model_id", "subject", r6("acc").alias("acc"))


def q_registry_flatten(spark, sf):
    m = registry.resolve_models(fx.registry_entries(spark, sf))
    return m.select("run_id", "ordinal", "model_id", "label", "resolved_path",
                    F.array_join("flags", " ").alias("flags"))


def q_registry_violations(spark, sf):
    return registry.registry_violations(fx.registry_entries(spark, sf))


def q_run_option_violations(spark, sf):
    return registry.run_option_violations(fx.run_options_table(spark, sf))


# Fixed value of the generation recipe: stop sequences of the short-answer task.
GEN_STOPS = [" ", "\n", ","]


def q_generation_exact_match(spark, sf):
    g = fx.generations(spark, sf)
    text, missing = T.placeholder(T.stop_cut(F.col("generated"), GEN_STOPS))
    g = g.withColumn("answer", F.lower(text)).withColumn("is_placeholder", missing)
    em = accuracy.exact_match(g, text="answer", gold="gold")
    extra = g.groupBy("run_id", "model_id").agg(F.count_if(F.col("answer") == F.col("gold")).alias("n_exact"),
                                                F.count_if("is_placeholder").alias("n_placeholder"))
    return em.join(extra, ["run_id", "model_id"]).select(
        "run_id", "model_id", F.col("n_samples").alias("n_prompts"), "n_exact",
        r6("exact_match").alias("exact_match"), "n_placeholder")


def full_leaderboard(spark, sf):
    """The leaderboard with its latency stage, which is carried for display and has error texts of its own."""
    models = fx.models(spark, sf)
    summary = latency.latency_summary(latency.request_latency(fx.chunks(spark, sf)))
    ppl = fx.ppl_model_summary(spark, sf, run_lists=True).join(
        q_token_estimate(spark, sf).select("model_id", F.col("est_tokens").alias("n_tokens")), "model_id", "left")
    return composite.composite_leaderboard(models, FLAGSHIP_OPTIONS, accuracy_stage(spark, sf), coding_stage(spark, sf),
                                           ppl, latency.latency_stage(models, summary))


def q_leaderboard_display(spark, sf):
    """The numbers behind the display cells (their texts are rounded and tested by hand values)."""
    lb = report.cells(full_leaderboard(spark, sf))
    return lb.select(
        "run_id", "model_id", F.coalesce(F.col("rank").cast("string"), F.lit("-")).alias("rank_cell"),
        *[r6(c).alias(c) for c in ("ppl", "ppl_half", "acc_pct", "acc_half", "pass_rate_1", "pass1_half", "pass_rate_2", "pass2_half")],
        r5("ttft_ms_p50").alias("ttft_ms_p50"), r3("tok_s_median").alias("tok_s_median"), r6("score").alias("score"),
        T.score_marks("nonsignificant", "missing_components").alias("marks"))


def q_score_breakdown(spark, sf):
    lb = leaderboard(spark, sf)
    return lb.select("run_id", "model_id", F.array_join("missing_components", ",").alias("missing"), F.inline("components")).select(
        "run_id", "model_id", "component", *[r6(c).alias(c) for c in ("weight", "value", "ci_half")], "missing")


def q_report_records(spark, sf):
    r = report.report_records(full_leaderboard(spark, sf))
    return r.select(
        "run_id", "model_id", "rank", "partial", F.size("components").cast("bigint").alias("n_components"), r6("accuracy.score").alias("accuracy"),
        r6("accuracy.ci_half").alias("accuracy_ci"), "coding.completed", "coding.pass_num_2", r6((F.col("coding.ci_high") - F.col("coding.ci_low")) / 2).alias("coding_half"),
        r6("perplexity.ppl").alias("ppl"), "perplexity.n_runs", r6("perplexity.run_min").alias("run_min"), r6("perplexity.run_max").alias("run_max"),
        r6("perplexity.fidelity").alias("fidelity"), r6("perplexity.ci_half").alias("ppl_ci"), "latency.n_requests", F.col("latency.error").isNotNull().alias("latency_failed"))


def q_leaderboard_cells(spark, sf):
    c = report.leaderboard_display(full_leaderboard(spark, sf))
    return c.select("run_id", "line_no", *[n for n in c.columns if n.endswith("_cell")])


def q_model_details(spark, sf):
    return report.model_details(full_leaderboard(spark, sf)).select("run_id", "line_no", "model_id", "score", "breakdown", "missing", "facts")


def q_report_legends(spark, sf):
    return report.legends(leaderboard(spark, sf)).select("run_id", "mark")


def q_perplexity_runs(spark, sf):
    """The run list of every record, one row per run, with the run's place and its own fidelity."""
    r = report.report_records(full_leaderboard(spark, sf)).select("run_id", "model_id", F.posexplode("perplexity.runs").alias("at", "r"))
    return r.select("run_id", "model_id", F.col("at").cast("bigint").alias("at"), "r.run_no", r6("r.ppl").alias("ppl"), r6("r.ppl_se").alias("ppl_se"), r6("r.fidelity").alias("fidelity"))


# The run shown by the wide matrices, and its columns: models are dealt to the runs evenly.
WIDE_RUN, WIDE_COLUMNS = "r0", fx.N_MODELS // fx.N_RUNS


def _numbered(wide: DataFrame, models: list[str], rows: list[str]) -> DataFrame:
    """``wide`` with its model columns named by their place (m01, m02, …) and a line 0 that names the models."""
    names = [f"m{k + 1:02d}" for k in range(WIDE_COLUMNS)]
    column = lambda k, of: of(models[k]) if k < len(models) else F.lit(None).cast("string")
    head = wide.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("line_no"), *[F.lit(None).cast("string").alias(c) for c in rows],
                                             *[column(k, F.lit).alias(n) for k, n in enumerate(names)])
    return head.unionByName(wide.select("line_no", *rows, *[column(k, lambda m: F.col(f"`{m}`")).alias(n) for k, n in enumerate(names)]))


def q_subject_matrix_wide(spark, sf):
    wide, models = matrices.subject_matrix_wide(_subjects(spark, sf), leaderboard(spark, sf), WIDE_RUN)
    return _numbered(wide, models, ["subject", "spread"])


def q_exercise_matrix_wide(spark, sf):
    wide, models = matrices.exercise_matrix_wide(coding_flags(spark, sf), leaderboard(spark, sf), WIDE_RUN)
    return _numbered(wide, models, ["exercise"])


def _report_stages(spark, sf):
    """The stages of a report over logs of which some have no result: the perplexity stage fails, and so does the
    server whose answers the latency stage needs; accuracy and coding go on."""
    def server(_):
        # no answer may be an error; the test events hold some
        answers = fx.table(spark, sf, "events").groupBy((F.col("event_type") == "error").alias("failed")).agg(F.count("*").alias("n"))
        return answers.withColumn("n", F.when(F.col("failed"), F.raise_error(F.lit("the server answered with errors")).cast("bigint")).otherwise(F.col("n")))

    return [
        stages.Stage("server", server),
        stages.Stage("accuracy", lambda _: accuracy_stage(spark, sf)),
        stages.Stage("coding", lambda _: coding_stage(spark, sf)),
        stages.Stage("latency", lambda t: latency.latency_summary(latency.request_latency(fx.chunks(spark, sf))), needs=["server"]),
        stages.Stage("ppl", lambda _: perplexity.ppl_summary(perplexity.strict_ppl_logs(fx.ppl_logs(spark, sf))), report_as="ppl"),
    ]


def q_stage_failures(spark, sf):
    """The leaderboard of what the stage graph could make, with the error texts of its failed stages."""
    graph = _report_stages(spark, sf)
    done = stages.run_stages(graph)
    models = stages.with_stage_errors(fx.models(spark, sf), done, graph)
    lb = composite.composite_leaderboard(models, FLAGSHIP_OPTIONS, *[done.tables.get(n) for n in ("accuracy", "coding", "ppl", "latency")])
    return lb.select("run_id", "model_id", "rank", r6("score").alias("score"), r6("score_ci_half").alias("score_ci_half"), "server_error",
                     F.substring_index("ppl_error", "\n", 1).alias("ppl_error"), F.lit(done.status["latency"]).alias("latency"))


# Parts in which a table lands, one after the other, in the streaming queries.
LANDINGS = 4


def _landings(df: DataFrame, ts: str, newest_first: bool = False):
    """The LANDINGS parts of ``df`` by time, oldest first or newest first."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    span = df.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    share = (at - F.lit(span["lo"])) / F.lit(max(1, (span["hi"] or 0) - (span["lo"] or 0)))
    part = sum(((share >= F.lit(k / LANDINGS)).cast("int") for k in range(1, LANDINGS)), F.lit(0))
    parts = [df.filter(part == k) for k in range(LANDINGS)]
    return parts[::-1] if newest_first else parts


def q_stream_request_latency(spark, sf):
    """Event-stream lines land as JSON records in LANDINGS parts by time; the stream is restarted after each."""
    folder = jobs.stream_folder(spark, "request-latency")
    for k, part in enumerate(_landings(fx.table(spark, sf, "events"), "ts")):
        fx.landed_line_texts(part).write.text(f"{folder}/landing/part-{k}")
        lines = jobs.landed_lines(jobs.text_stream(spark, f"{folder}/landing/part-*"))
        jobs.run_to_end(jobs.stream_request_latency(latency.parse_stream_lines(lines), folder + "/out", folder + "/ckpt"))
    per = jobs.finish_request_latency(spark, folder + "/out")
    return per.select("run_id", "model_id", "request_id", "n_tokens", r3("ttft_ms").alias("ttft_ms"),
                      r3("tok_s").alias("tok_s"))


def q_stream_line_counts(spark, sf):
    """Lines land newest part first with broken records among them; requests close after LATE_AFTER."""
    folder = jobs.stream_folder(spark, "line-counts")
    for k, part in enumerate(_landings(fx.table(spark, sf, "events"), "ts", newest_first=True)):
        fx.landed_line_texts(part, clean=False).write.text(f"{folder}/landing/part-{k}")
        lines = jobs.landed_lines(jobs.text_stream(spark, f"{folder}/landing/part-*"))
        jobs.run_to_end(jobs.stream_request_latency(latency.parse_stream_lines(lines), folder + "/out", folder + "/ckpt", lateness=LATE_AFTER))
        jobs.run_to_end(jobs.stream_line_counts(lines, folder + "/counts", folder + "/ckpt-counts"))
    return jobs.line_counts(spark, folder + "/counts", folder + "/out")


# How far requests may start behind the newest in the line-count query.
LATE_AFTER = "10 days"


def _landed_files(spark, sf, folder):
    """Result-file events of ``lineitem`` landing newest first: yields the stream after each landing."""
    li = fx.table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_linestatus", "l_partkey")
    for k, part in enumerate(_landings(li, "l_shipdate", newest_first=True)):
        part.write.parquet(f"{folder}/landing/part-{k}")
        yield fx.result_file_events(spark.readStream.schema(part.schema).parquet(f"{folder}/landing/part-*"))


def q_stream_progress(spark, sf):
    """Files land in LANDINGS parts, newest first; the stream is restarted after each."""
    folder = jobs.stream_folder(spark, "progress")
    totals = fx.exercise_catalog(spark, sf).groupBy("language").agg(F.count_distinct("exercise").alias("total"))
    for files_stream in _landed_files(spark, sf, folder):
        jobs.run_to_end(jobs.land_progress(files_stream, folder + "/out", folder + "/ckpt"))
    return jobs.landed_progress(spark, folder + "/out", totals)


def q_stream_heartbeat(spark, sf):
    """The last count that the progress stream told of each run, and whether a heartbeat followed when it went quiet."""
    folder = jobs.stream_folder(spark, "heartbeat")
    *_, files_stream = _landed_files(spark, sf, folder)
    query = jobs.stream_progress(files_stream, folder + "/out", folder + "/ckpt", interval_s=0.5)

    def told():
        rows = spark.read.schema("run string, language string, kind string, done long, at_ms long").parquet(folder + "/out")
        return rows.groupBy("run", "language").agg(F.max("done").alias("done"), F.bool_or(F.col("kind") == "heartbeat").alias("heartbeat"))

    def all_beat():
        # the first batch reads all that has landed
        last = query.lastProgress
        return last is not None and last["batchId"] >= 0 and told().agg(F.bool_and("heartbeat").alias("x")).first()["x"] is not False

    jobs.run_until(query, all_beat)
    return told()


def q_stream_leaderboard(spark, sf):
    folder = jobs.stream_folder(spark, "leaderboard")
    labels = jobs.file_stream(spark, f"{sf}/labels.parquet", fx.table(spark, sf, "labels"))
    docs = fx.table(spark, sf, "documents").select("doc_id", "source", "lang")
    items = labels.join(docs, "doc_id", "inner").select(
        fx.run_of(F.col("source")), F.col("source").alias("model_id"), F.col("lang").alias("subject"), "doc_id",
        F.when(F.col("quality") == 1, 1.0).otherwise(0.0).alias("correct"))
    # stages that do not change while items land are worked out once
    coding, ppl, models = (cut_lineage(x) for x in (coding_stage(spark, sf), fx.ppl_model_summary(spark, sf), fx.models(spark, sf)))

    def rebuild(acc_stage):
        lb = composite.composite_leaderboard(models, FLAGSHIP_OPTIONS, acc_stage, coding, ppl)
        return lb.select("run_id", "model_id", F.col("ordinal").cast("bigint").alias("ordinal"), "rank",
                         r6("score").alias("score"), r6("score_ci_half").alias("score_ci_half"),
                         "nonsignificant", F.array_join("missing_components", ",").alias("missing"),
                         F.size("components").cast("bigint").alias("n_components"))

    jobs.run_to_end(jobs.stream_leaderboard(items, rebuild, folder + "/out", folder + "/ckpt"))
    return jobs.newest_leaderboard(spark, folder + "/out")


def q_exercise_cap(spark, sf):
    capped = outcomes.cap_exercises(fx.exercise_catalog(spark, sf), 100, seed=7)
    return capped.select("language", "exercise")


def q_run_meta(spark, sf):
    return report.run_meta(fx.run_records(spark, sf))


def q_generation_texts(spark, sf):
    g = loglik.parse_generations(fx.generation_responses(spark, sf))
    return (g.groupBy("run_id", "model_id")
            .agg(F.count(F.lit(1)).alias("n_requests"),
                 F.sum(F.size("texts")).cast("bigint").alias("n_texts"),
                 F.sum(F.length(F.get(F.col("texts"), 0))).cast("bigint").alias("first_text_chars")))


def q_exercise_records(spark, sf):
    rec = outcomes.flags_from_records(files.parse_exercise_records(fx.record_texts(spark, sf)))
    ok = F.col("reject").isNull()
    return rec.groupBy("run_id", "model_id").agg(
        F.count_if(ok).alias("completed"), F.count_if(F.col("reject") == "empty").alias("n_empty"), F.count_if(F.col("reject") == "unreadable").alias("n_unreadable"),
        F.count_if(ok & F.col("pass_1")).alias("pass_num_1"), F.count_if(ok & F.col("pass_any")).alias("pass_num_2"),
        F.coalesce(F.sum(F.when(ok, F.col("prompt_tokens"))), F.lit(0)).cast("bigint").alias("prompt_tokens"))


def q_stream_lines(spark, sf):
    parsed = latency.parse_stream_lines(fx.stream_lines(spark, sf))
    return parsed.groupBy("run_id", "model_id").agg(
        F.count_if(~F.col("is_end") & ~F.col("malformed")).alias("n_texts"), F.count_if("is_end").alias("n_ends"), F.count_if("malformed").alias("n_malformed"))


def q_token_responses(spark, sf):
    r = fx.response_texts(spark, sf).withColumn("r", files.token_response(F.col("json")))
    return r.groupBy("run_id", "model_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("r").isNull()).alias("n_without"), F.sum("r.id").cast("bigint").alias("id_sum"),
        r3(F.sum("r.logprob")).alias("logprob_sum"), F.sum(F.size("r.top_logprobs")).cast("bigint").alias("n_candidates"))


def q_ppl_error_tails(spark, sf):
    """One log file per user lands; the last lines of every log without a result are its error text."""
    folder = jobs.stream_folder(spark, "logs")
    files.spread_files(fx.ppl_log_files(spark, sf), "file").write.partitionBy("file").text(folder + "/logs")
    logs = files.read_ppl_logs(spark, folder + "/logs/*")
    parsed = perplexity.parse_ppl_logs(logs.withColumn("file", F.regexp_extract("path", "file=([^/]+)/", 1).cast("bigint")))
    return parsed.select("file", "ppl", "ppl_se", "error")


def q_composite_labels(spark, sf):
    r = fx.run_options_table(spark, sf)
    return r.select("run_id", T.composite_label("weights_mmlu", "weights_ppl", F.lit(2)).alias("label"))


def q_task_results(spark, sf):
    """Metric documents written by task and model, two tasks of them read back metric by metric."""
    folder = jobs.stream_folder(spark, "tasks")
    metrics.write_task_results(_metric_docs(spark, sf), folder)
    got = metrics.read_task_results(spark, folder, ["mmlu", "mmlu_de"])
    return got.select("run_id", "model_id", "task", "subject", "metric", r6("value").alias("value"))


def q_progress_one_language(spark, sf):
    return outcomes.progress(fx.result_files(spark, sf), fx.exercise_catalog(spark, sf), ["F"], 500)


def q_model_counts(spark, sf):
    """The rule of one to five models per run, on registries of which some hold more."""
    e = fx.registry_entries(spark, sf).withColumn("run_id", F.concat("run_id", F.lit("-"), (F.col("model_pos") % 16).cast("string")))
    bad = registry.registry_violations(e, check_model_count=True).filter(F.col("rule") == "model_count")
    return bad.select("run_id", F.col("detail").alias("n_models"))


# The languages asked for in the landing query, as an option text.
LANDED_LANGUAGES = " python, go,python "


def q_landed_results(spark, sf):
    """One result file per supplier lands; two languages are read, records and quarantine are written in one pass."""
    folder = jobs.stream_folder(spark, "results")
    files.land_exercise_results(fx.supplier_results(spark, sf), folder + "/landing")
    raw = files.landed_results(spark, folder + "/landing", LANDED_LANGUAGES)
    files.ingest_results(raw, folder + "/out")
    records, rejects = (files.ingested(spark, folder + "/out", kind) for kind in ("records", "rejects"))
    flags = outcomes.flags_from_records(records)
    # every file read is a record or a reject; none is opened again to be counted
    done = outcomes.count_done(records.select(*files.LANDED_KEYS).unionByName(rejects.select(*files.LANDED_KEYS)))
    found = flags.groupBy("run", "language").agg(F.count("*").alias("completed"), F.count_if("pass_1").alias("pass_num_1"), F.count_if("pass_any").alias("pass_num_2"),
                                                 F.sum("prompt_tokens").alias("prompt_tokens"))
    bad = rejects.groupBy("run", "language").agg(
        F.count_if(F.col("reason") == "empty").alias("n_empty"), F.count_if(F.col("reason") == "unreadable").alias("n_unreadable"))
    return done.join(found, ["run", "language"], "left").join(bad, ["run", "language"], "left").na.fill(0)


def q_reference_counts(spark, sf):
    """Characters and estimated tokens of the reference texts, one corpus per source, read in pieces."""
    folder = jobs.stream_folder(spark, "reference")
    corpora = fx.reference_corpora(spark, sf)
    corpora.select("corpus", F.col("value").cast("string").alias("value")).write.partitionBy("corpus").text(folder + "/corpora")
    per = files.reference_counts(files.reference_pieces(spark, folder + "/corpora/*"))
    corpus = F.regexp_extract("path", "corpus=([^/]+)/", 1).alias("corpus")
    # a corpus may be several files
    return per.groupBy(corpus).agg(F.sum("n_chars").alias("n_chars"))


def q_registry_json(spark, sf):
    entries = registry.parse_registry_json(fx.registry_documents(spark, sf))
    return registry.registry_violations(entries).select("run_id", F.col("group_pos").cast("bigint").alias("group_pos"), "model_pos", "rule")


QUERIES: dict[str, QueryFn] = {
    "report_records": q_report_records,
    "exercise_records": q_exercise_records,
    "stream_lines": q_stream_lines,
    "token_responses": q_token_responses,
    "registry_json": q_registry_json,
    "landed_results": q_landed_results,
    "ppl_error_tails": q_ppl_error_tails,
    "composite_labels": q_composite_labels,
    "task_results": q_task_results,
    "progress_one_language": q_progress_one_language,
    "model_counts": q_model_counts,
    "reference_counts": q_reference_counts,
    "composite_leaderboard": q_composite_leaderboard,
    "subject_accuracy": q_subject_accuracy,
    "limit_per_subject": q_limit_per_subject,
    "pass_summary": q_pass_summary,
    "pass_by_language_rollup": q_pass_by_language_rollup,
    "token_totals": q_token_totals,
    "first_n_tries": q_first_n_tries,
    "exercise_matrix_long": q_exercise_matrix_long,
    "progress": q_progress,
    "latest_run": q_latest_run,
    "new_runs": q_new_runs,
    "request_latency": q_request_latency,
    "latency_summary": q_latency_summary,
    "ppl_log_parse": q_ppl_log_parse,
    "ppl_summary": q_ppl_summary,
    "token_estimate": q_token_estimate,
    "token_logprob_lookup": q_token_logprob_lookup,
    "token_logprob_lookup_nested": q_token_logprob_lookup_nested,
    "request_loglik": q_request_loglik,
    "choice_accuracy": q_choice_accuracy,
    "prefix_scores": q_prefix_scores,
    "generations": q_generations,
    "token_perplexity": q_token_perplexity,
    "window_perplexity": q_window_perplexity,
    "subject_spread": q_subject_spread,
    "subject_matrix": q_subject_matrix,
    "metrics_task_summary": q_metrics_task_summary,
    "metrics_subjects": q_metrics_subjects,
    "metrics_generative": q_metrics_generative,
    "registry_flatten": q_registry_flatten,
    "registry_violations": q_registry_violations,
    "run_option_violations": q_run_option_violations,
    "generation_exact_match": q_generation_exact_match,
    "exercise_cap": q_exercise_cap,
    "run_meta": q_run_meta,
    "generation_texts": q_generation_texts,
    "leaderboard_display": q_leaderboard_display,
    "leaderboard_cells": q_leaderboard_cells,
    "model_details": q_model_details,
    "report_legends": q_report_legends,
    "stage_failures": q_stage_failures,
    "perplexity_runs": q_perplexity_runs,
    "subject_matrix_wide": q_subject_matrix_wide,
    "exercise_matrix_wide": q_exercise_matrix_wide,
    "score_breakdown": q_score_breakdown,
    "stream_request_latency": q_stream_request_latency,
    "stream_line_counts": q_stream_line_counts,
    "stream_progress": q_stream_progress,
    "stream_heartbeat": q_stream_heartbeat,
    "stream_leaderboard": q_stream_leaderboard,
}
