"""Perplexity: log parsing, run summaries, token-level perplexity.

Covers P14, F12, A7, A8, A9 (run spread inputs) and A18.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL_KEYS = ["run_id", "model_id"]

# The two result-line patterns of the perplexity tool, matched case-insensitively
# ("(?i)"). Numbers have no sign or exponent (a value like 7.0E-4 reads as 7.0).
FINAL_ESTIMATE = r"(?i)Final estimate:\s*PPL\s*=\s*([0-9]+(?:\.[0-9]+)?)\s*(?:\+/-\s*([0-9]+(?:\.[0-9]+)?))?"
OVERALL_PPL = r"(?i)overall_ppl\s*=\s*([0-9]+(?:\.[0-9]+)?)"
# number of log lines kept with a parse failure
ERROR_TAIL_LINES = 12


def _num(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("double")


def parse_ppl(log: Column) -> Column:
    """``struct<ppl double, ppl_se double>`` from a tool log; NULL ppl = failure.

    CR becomes LF; the first ``Final estimate`` line wins, else the first
    ``overall_ppl`` (no SE).
    """
    text = F.replace(log, F.lit("\r"), F.lit("\n"))
    fin = _num(text, FINAL_ESTIMATE, 1)
    fin_se = _num(text, FINAL_ESTIMATE, 2)
    overall = _num(text, OVERALL_PPL, 1)
    return F.struct(F.coalesce(fin, overall).alias("ppl"),
                    F.when(fin.isNotNull(), fin_se).alias("ppl_se"))


def log_tail(log: Column, n: int = ERROR_TAIL_LINES) -> Column:
    """the last ``n`` lines of the log without white space at its ends (the error text of a failed run)."""
    lines = F.split(F.regexp_replace(log, r"^\s+|\s+$", ""), r"\r\n|\r|\n")
    k = F.least(F.size(lines), F.lit(n))
    return F.array_join(F.slice(lines, -k, k), "\n")


def parse_ppl_logs(logs: DataFrame, log: str = "log") -> DataFrame:
    """Parse every run log; failures keep a NULL ppl and an ``error`` text (quarantine rows)."""
    parsed = logs.withColumn("_p", parse_ppl(F.col(log)))
    ok = F.col("_p.ppl").isNotNull()
    return (parsed.withColumn("ppl", F.col("_p.ppl")).withColumn("ppl_se", F.col("_p.ppl_se"))
            .withColumn("error", F.when(~ok, F.concat(F.lit("could not parse perplexity output: "),
                                                      log_tail(F.col(log)))))
            .drop("_p"))


def strict_ppl_logs(logs: DataFrame, log: str = "log") -> DataFrame:
    """Like ``parse_ppl_logs``, but a log without a result fails the job with its error text, as a stage of a
    report does that must not go on without one of its runs."""
    parsed = parse_ppl_logs(logs, log)
    return parsed.withColumn("ppl", F.when(F.col("error").isNull(), F.col("ppl")).otherwise(F.raise_error(F.col("error")).cast("double")))


def ppl_summary(runs: DataFrame, keys=MODEL_KEYS, run_no: str | None = None) -> DataFrame:
    """A7 (+A9 inputs): mean of run PPLs, mean of the reported SEs, run count, min/max run.

    Failed runs (NULL ppl) are left out. ``avg`` ignores missing SEs, so the SE
    is NULL only when no run reported one. Min and max of the runs give the run
    spread of the fidelity score. With ``run_no`` the runs are kept as well, as the array
    ``runs`` of (run_no, ppl, ppl_se) in the order of ``run_no``: a list for reports, as long as a
    model has runs, so it is not made without being asked for.
    """
    good = runs.filter(F.col("ppl").isNotNull())
    listed = [F.array_sort(F.collect_list(F.struct(F.col(run_no).alias("run_no"), "ppl", "ppl_se"))).alias("runs")] if run_no else []
    return good.groupBy(*keys).agg(
        F.avg("ppl").alias("ppl"),
        F.avg("ppl_se").alias("ppl_se"),
        F.count(F.lit(1)).alias("n_runs"),
        F.min("ppl").alias("run_min"),
        F.max("ppl").alias("run_max"),
        *listed,
    )


def token_perplexity(token_logprobs: DataFrame, keys=MODEL_KEYS, logprob: str = "logprob",
                     weight: str | None = None, about: float | None = None) -> DataFrame:
    """``exp(-mean lp)``, delta-method SE ``ppl * sd(lp) / sqrt(n)``, n tokens.

    With ``weight`` the rows are pre-aggregated ``(value, count)`` pairs (a token
    occurring c times), which keeps hot tokens from being shipped one row each:
    mean and sample variance come from weighted sums. With ``about``, a value near the means, the
    squares are summed about it in the same pass; without, about each mean in a second pass.
    """
    lp = F.col(logprob).cast("double")
    if weight is None:
        agg = token_logprobs.groupBy(*keys).agg(
            F.avg(lp).alias("_mean"), F.stddev_samp(lp).alias("_sd"), F.count(lp).alias("n_tokens"))
    elif about is not None:
        c, d = F.col(weight).cast("double"), lp - F.lit(float(about))
        agg = token_logprobs.groupBy(*keys).agg(F.sum(c).alias("_n"), F.sum(c * d).alias("_s"), F.sum(c * d * d).alias("_ss"))
        n, s = F.col("_n"), F.col("_s")
        spread = F.sqrt(F.greatest(F.col("_ss") - s * s / n, F.lit(0.0)) / (n - 1))
        agg = agg.select(*keys, (F.lit(float(about)) + s / n).alias("_mean"), F.when(n > 1, spread).alias("_sd"), n.cast("bigint").alias("n_tokens"))
    else:
        # squares about the mean: a second pass over the pre-aggregated rows, since the difference of
        # two large sums would lose a small spread
        c = F.col(weight).cast("double")
        keys = list(keys)
        means = token_logprobs.groupBy(*keys).agg((F.sum(c * lp) / F.sum(c)).alias("_mean"), F.sum(c).alias("_n"))
        agg = (token_logprobs.join(means, keys).groupBy(*keys, "_mean", "_n")
               .agg(F.sum(c * F.pow(lp - F.col("_mean"), 2)).alias("_ss"))
               .withColumn("_sd", F.when(F.col("_n") > 1, F.sqrt(F.col("_ss") / (F.col("_n") - 1))))
               .withColumn("n_tokens", F.col("_n").cast("bigint"))
               .drop("_ss", "_n"))
    ppl = F.exp(-F.col("_mean"))
    return (agg.withColumn("ppl", ppl)
            .withColumn("ppl_se", ppl * F.col("_sd") / F.sqrt(F.col("n_tokens").cast("double")))
            .drop("_mean", "_sd"))


def text_offsets(texts: DataFrame, n_tokens: Column, order: list[str], keys: list[str]) -> DataFrame:
    """For every text its ``offset``, the tokens of all earlier texts of its ``keys`` in the order of ``order``.

    The columns ``order`` must tell the texts of a key apart. Returns keys, order and offset only; a key may
    hold any share of the texts.
    """
    from evalspark.operators.positions import running_totals
    narrow = texts.select(*keys, *order, n_tokens.cast("bigint").alias("_tokens"))
    return running_totals(narrow, [F.col(c) for c in order], F.col("_tokens"), "offset", keys).drop("_tokens")


def context_windows(token_logprobs: DataFrame, ctx: int, position: str = "position") -> DataFrame:
    """A18 windowing: tag each token with its context chunk ``floor(pos / ctx)``."""
    return token_logprobs.withColumn("chunk_no", F.floor(F.col(position) / F.lit(ctx)).cast("bigint"))


def windowed_perplexity(token_logprobs: DataFrame, ctx: int, keys: list[str], position: str = "position", logprob: str = "logprob") -> DataFrame:
    """A18 per (keys, chunk_no): perplexity of each stretch of ``ctx`` tokens; the last one may be shorter."""
    return token_perplexity(context_windows(token_logprobs, ctx, position), [*keys, "chunk_no"], logprob)


def windowed_perplexity_of_words(tokens: DataFrame, logprobs: DataFrame, ctx: int, keys: list[str], word: str = "word", position: str = "position",
                                 about: float = -8.0) -> DataFrame:
    """A18 per (keys, chunk_no) for tokens (keys, position, word) whose log-probability depends on the word only.

    Equal words of a window are counted before they meet ``logprobs`` (word, logprob), so a frequent word moves once
    per window. Words without a log-probability do not count.
    """
    counted = context_windows(tokens, ctx, position).groupBy(*keys, "chunk_no", word).agg(F.count("*").alias("_times"))
    return token_perplexity(counted.join(logprobs, word), [*keys, "chunk_no"], weight="_times", about=about)


def estimate_tokens(text: Column) -> Column:
    """Characters // 4 (code points)."""
    return F.floor(F.length(text) / F.lit(4)).cast("bigint")
