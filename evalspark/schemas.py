"""Explicit schemas of the evaluation tables; no schema inference anywhere.

DDL strings are accepted by ``spark.read.schema``, ``createDataFrame`` and ``from_json``.
"""

from __future__ import annotations

# D1 model registry row
MODELS = ("run_id string, ordinal bigint, model_id string, label string, path string, tokenizer string, "
          "flags array<string>")
# D2 registry document (family groups with nested models)
REGISTRY = ("run_id string, groups array<struct<tokenizer: string, models_dir: string, flags: array<string>, "
            "models: array<struct<path: string, flags: array<string>>>>>")
# D3 accuracy stage
STAGE_ACCURACY = ("run_id string, model_id string, task string, acc_score double, score_metric string, "
                  "acc_stderr double, n_samples bigint, duration_s double, error string")
SUBJECT_METRICS = "run_id string, model_id string, subject string, metric string, value double"
# D4 coding stage
STAGE_CODING = ("run_id string, model_id string, completed bigint, pass_num_1 bigint, pass_num_2 bigint, "
                "pass_rate_1 double, pass_rate_2 double, prompt_tokens bigint, completion_tokens bigint, "
                "error string")
# D5 perplexity stage and its runs
STAGE_PPL = ("run_id string, model_id string, ppl double, ppl_se double, n_runs bigint, run_min double, "
             "run_max double, n_tokens bigint, error string")
PPL_RUNS = "run_id string, model_id string, run_no bigint, ppl double, ppl_se double"
PPL_LOGS = "run_id string, model_id string, run_no bigint, log string"
# D6 latency stage and its source
STAGE_LATENCY = ("run_id string, model_id string, n_requests bigint, ttft_ms_mean double, ttft_ms_p50 double, "
                 "ttft_ms_p95 double, tok_s_mean double, tok_s_median double, total_tokens bigint, error string")
CHUNKS = ("run_id string, model_id string, request_id string, t_start timestamp_ntz, ts timestamp_ntz, "
          "delta string, is_end boolean")
# D7 / D13 long components
COMPONENTS = "run_id string, model_id string, component string, weight double, value double, ci_half double"
# D8 exercise record (outcomes as JSON values, truthiness applied after parsing)
EXERCISE_RECORD = ("run_id string, model_id string, language string, exercise string, "
                   "tests_outcomes array<boolean>, prompt_tokens bigint, completion_tokens bigint")
TRIES = "run_id string, model_id string, language string, exercise string, try_no bigint, passed boolean"
RESULT_FILES = "path string, run string, language string, exercise string, mtime timestamp"
# D9 loglikelihood request
REQUESTS = ("run_id string, model_id string, request_id string, doc_id bigint, choice_no int, "
            "context_ids array<bigint>, continuation_ids array<bigint>")
# D10 token response entry
TOKEN_RESPONSE = ("struct<id: bigint, token: string, logprob: double, "
                  "top_logprobs: array<struct<id: bigint, token: string, logprob: double>>>")
CANDIDATES = ("model_id string, prefix_id bigint, cand_pos int, cand_id bigint, cand_token string, "
              "cand_logprob double")
# D11 generation response
GENERATION_RESPONSE = "array<struct<index: int, text: string>>"
# D12 response stream lines
STREAM_LINES = ("run_id string, model_id string, request_id string, t_start timestamp_ntz, ts timestamp_ntz, "
                "line string")
# D14 run options / metadata
RUNS = ("run_id string, weights_mmlu double, weights_ppl double, ppl_available boolean, mmlu_task string, "
        "skip_mmlu boolean, skip_ppl boolean, coding_kv_fix string, coding_tries int, mmlu_limit int, "
        "ppl_ctx int, duration_s double")
# D15 matrices (long)
SUBJECT_MATRIX = "run_id string, subject string, model_id string, acc double"
EXERCISE_MATRIX = "run_id string, language string, exercise string, model_id string, cell string"
