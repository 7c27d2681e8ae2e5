"""Streaming-response latency: per-request first token, tokens, rate; per-model summary.

Covers S6 (line parsing), W7 (end-marker cut), A12, A10, A11, P27, F4, F5.
The chunk table is the big input. Every step is an aggregate keyed by request
(partial aggregation map-side) or a join against a one-row-per-request table;
no window sorts a request's chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions import stats
from evalspark.operators.quantiles import exact_percentiles

REQUEST_KEYS = ["run_id", "model_id", "request_id"]
MODEL_KEYS = ["run_id", "model_id"]

# Fixed values of the event-stream format: data-line prefix and end marker.
DATA_PREFIX = "data:"
END_MARKER = "[DONE]"


def _payload(line: Column) -> Column:
    return F.trim(F.substring(line, 6, 1 << 30))


def _text(payload: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(payload), "$.choices[0].text", "string")


def is_malformed(line: Column) -> Column:
    """Whether a data line is neither the end marker nor has a text."""
    return (_payload(line) != F.lit(END_MARKER)) & _text(_payload(line)).isNull()


def parse_stream_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Event-stream lines -> chunk rows.

    Keeps ``data:`` lines; ``[DONE]`` becomes an end-marker row; bad JSON or a
    missing ``choices[0].text`` is skipped (and flagged ``malformed`` so it can be
    counted). Other columns of ``lines`` (request keys, ts) are carried.
    """
    raw = F.col(line)
    data = lines.filter(raw.startswith(DATA_PREFIX)).withColumn("_payload", _payload(raw))
    is_end = F.col("_payload") == F.lit(END_MARKER)
    text = _text(F.col("_payload"))
    return (data.withColumn("is_end", is_end)
            .withColumn("delta", F.when(~is_end, text))
            .withColumn("malformed", ~is_end & F.col("delta").isNull())
            .drop("_payload"))


def request_latency(chunks: DataFrame, keys=REQUEST_KEYS) -> DataFrame:
    """A12 + W7 + F4 + F5 + P27: one row per request with at least one token.

    * chunks after the first end marker are ignored; the request ends at the end
      marker if there is one, else at its last chunk (SURVEY T6)
    * ``ttft_ms`` = first non-empty chunk - request start, in ms
    * ``tok_s`` = tokens / max(end - first token, 1e-6 s)

    Two aggregates keyed by request: the end-marker time over end-marker rows only (the filter
    reaches the scan), then the chunk statistics before it (left join on the request key).
    """
    keys = list(keys)
    ends = chunks.filter("is_end").groupBy(*keys).agg(F.min("ts").alias("_end_marker"))
    live = chunks.join(ends, keys, "left").filter(
        F.col("_end_marker").isNull() | (F.col("ts") < F.col("_end_marker"))
        | ((F.col("ts") == F.col("_end_marker")) & ~F.col("is_end")))
    token = (~F.col("is_end")) & F.col("delta").isNotNull() & (F.length("delta") > 0)
    per = live.groupBy(*keys).agg(
        F.min("t_start").alias("t_start"),
        F.min(F.when(token, F.col("ts"))).alias("t_first"),
        F.coalesce(F.min("_end_marker"), F.max("ts")).alias("t_end"),
        F.count_if(token).alias("n_tokens"),
    )
    per = per.filter(F.col("n_tokens") > 0)
    first_s = stats.seconds_between("t_start", "t_first")
    gen_s = stats.seconds_between("t_first", "t_end")
    return (per.withColumn("ttft_us", F.timestamp_diff("MICROSECOND", F.col("t_start"), F.col("t_first")))
            .withColumn("ttft_ms", first_s * F.lit(1000.0))
            .withColumn("tok_s", stats.tok_rate(F.col("n_tokens"), gen_s)))


def latency_summary(per_request: DataFrame, keys=MODEL_KEYS, approx_accuracy: int | None = None,
                    materialize: bool = True) -> DataFrame:
    """A10 + A11: n, TTFT mean/p50/p95, tok/s mean/median, total tokens per model.

    Percentiles are exact (linear interpolation at ``(n-1)q``) and computed by the
    two-pass band method, so a model with most of the requests is not gathered
    into one task.
    """
    keys = list(keys)
    if materialize and not approx_accuracy:
        # the exact percentiles read the per-request table three times (aggregates, sketch,
        # band): write it once to the shared checkpoint folder instead of re-running the chunk plan
        from evalspark.session import cut_lineage
        per_request = cut_lineage(per_request)
    # the mean from the exact integer sum of microseconds when available (order-independent)
    ttft_mean = (F.sum("ttft_us") / F.count(F.lit(1)) / F.lit(1000.0)) if "ttft_us" in per_request.columns \
        else F.avg("ttft_ms")
    base = per_request.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_requests"),
        ttft_mean.alias("ttft_ms_mean"),
        F.avg("tok_s").alias("tok_s_mean"),
        F.sum("n_tokens").cast("bigint").alias("total_tokens"),
    )
    if approx_accuracy:
        # opt-in for huge groups: one GK sketch pass, rank error below n / approx_accuracy
        pa = lambda c, q: F.percentile_approx(c, q, approx_accuracy)
        approx = per_request.groupBy(*keys).agg(pa("ttft_ms", 0.5).alias("ttft_ms_p50"),
                                                pa("ttft_ms", 0.95).alias("ttft_ms_p95"),
                                                pa("tok_s", 0.5).alias("tok_s_median"))
        return base.join(approx, keys, "left")
    # both metrics in one sketch + band pass: stack them as (metric, value) rows
    stacked = per_request.select(*keys, F.explode(F.array(
        F.struct(F.lit("ttft_ms").alias("metric"), F.col("ttft_ms").cast("double").alias("value")),
        F.struct(F.lit("tok_s").alias("metric"), F.col("tok_s").cast("double").alias("value")))).alias("_m"))
    stacked = stacked.select(*keys, "_m.metric", "_m.value")
    pct = exact_percentiles(stacked, keys + ["metric"], "value", [0.5, 0.95], ["p50", "p95"])
    wide = (pct.groupBy(*keys)
            .agg(F.max(F.when(F.col("metric") == "ttft_ms", F.col("p50"))).alias("ttft_ms_p50"),
                 F.max(F.when(F.col("metric") == "ttft_ms", F.col("p95"))).alias("ttft_ms_p95"),
                 F.max(F.when(F.col("metric") == "tok_s", F.col("p50"))).alias("tok_s_median")))
    return base.join(wide, keys, "left")


def latency_stage(models: DataFrame, summary: DataFrame, keys=MODEL_KEYS) -> DataFrame:
    """D6 stage table over all models: a model without any usable request keeps a NULL
    summary and the error text (SURVEY T23) instead of failing the job."""
    keys = list(keys)
    out = models.select(*keys).join(summary, keys, "left")
    return out.withColumn("error", F.when(F.col("n_requests").isNull(),
                                          F.lit("ValueError: no usable requests (no tokens received)")))
