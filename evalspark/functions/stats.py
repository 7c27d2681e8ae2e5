"""Statistics as column expressions (all JVM-side, codegen friendly).

Each helper takes and returns ``Column`` objects so it can be used inside
``select``/``agg``/``withColumn`` without leaving the optimiser's view.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's for the same results):
# z value of the 95% interval, and the floor of the token-rate denominator in seconds.
Z95 = 1.96
MIN_RATE_SECONDS = 1e-6


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def wilson_ci(k, n, z: float = Z95) -> Column:
    """Wilson score interval in percent as ``struct<lo double, hi double>``.

    Clamped to [0, 100]; ``n <= 0`` gives (0, 0).
    """
    k = _c(k).cast("double")
    n = _c(n).cast("double")
    zz = F.lit(z * z)
    p = k / n
    d = F.lit(1.0) + zz / n
    center = (p + zz / (F.lit(2.0) * n)) / d
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + zz / (F.lit(4.0) * n * n)) / d
    lo = F.greatest(F.lit(0.0), (center - half) * F.lit(100.0))
    hi = F.least(F.lit(100.0), (center + half) * F.lit(100.0))
    empty = n.isNull() | (n <= 0)
    return F.struct(
        F.when(empty, F.lit(0.0)).otherwise(lo).alias("lo"),
        F.when(empty, F.lit(0.0)).otherwise(hi).alias("hi"),
    )


def accuracy_ci_half(stderr) -> Column:
    """Half-width in score points of the accuracy component: ``1.96 * se * 100``."""
    return F.lit(Z95) * _c(stderr) * F.lit(100.0)


def pass_ci_half(pass_num_any, completed, pass_rate_any) -> Column:
    """Half-width of the Wilson interval on the any-try pass rate.

    NULL when nothing was completed or the rate is unknown.
    """
    ci = wilson_ci(pass_num_any, completed)
    ok = (_c(completed) > 0) & _c(pass_rate_any).isNotNull()
    return F.when(ok, (ci["hi"] - ci["lo"]) / F.lit(2.0))


def ppl_fidelity(ppl, min_ppl) -> Column:
    """``100 * min_ppl / ppl`` (may exceed 100 for a single run, no clamp)."""
    return F.lit(100.0) * _c(min_ppl) / _c(ppl)


def ppl_score_se(ppl, ppl_se, min_ppl) -> Column:
    """Delta-method SE of the fidelity score; the minimum is taken as exact."""
    ppl = _c(ppl)
    return F.when(_c(ppl_se).isNotNull() & (ppl > 0),
                  (F.lit(100.0) * _c(min_ppl) / (ppl * ppl)) * _c(ppl_se))


def ppl_ci_half(score_se, run_spread, n_runs) -> Column:
    """``sqrt((1.96*se)^2 + (spread/2)^2)`` over the parts that exist.

    The spread part needs at least two runs. NULL when neither part exists.
    """
    se_part = F.lit(Z95) * _c(score_se)
    spread_part = F.when(_c(n_runs) >= 2, _c(run_spread) / F.lit(2.0))
    total = (F.coalesce(se_part * se_part, F.lit(0.0))
             + F.coalesce(spread_part * spread_part, F.lit(0.0)))
    return F.when(se_part.isNotNull() | spread_part.isNotNull(), F.sqrt(total))


def tok_rate(n_tokens, seconds) -> Column:
    """Tokens per second with the denominator floored at 1 microsecond."""
    return _c(n_tokens) / F.greatest(_c(seconds), F.lit(MIN_RATE_SECONDS))


def seconds_between(start, end) -> Column:
    """Elapsed seconds between two timestamps, microsecond precision."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)).cast("double") / F.lit(1e6)


def component_weights(weights_mmlu, weights_ppl) -> dict[str, Column]:
    """Base weights before renormalisation: ppl, mmlu and coding shares."""
    w_ppl = _c(weights_ppl).cast("double")
    w_mmlu = _c(weights_mmlu).cast("double")
    return {
        "ppl": w_ppl,
        "mmlu": (F.lit(1.0) - w_ppl) * w_mmlu,
        "coding": (F.lit(1.0) - w_ppl) * (F.lit(1.0) - w_mmlu),
    }
