"""Model registry: flatten family groups to model rows, resolve, validate.

Registry documents are small, but runs can be many; every rule is a column
expression or a keyed aggregate, so any number of runs validates in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.text import model_label, model_stem, slugify

# Allowed keys of a family group and of a model mapping, the model
# file suffix, the bounds on models per run, allowed evaluation tasks.
GROUP_KEYS = ["tokenizer", "models-dir", "flags", "models"]
MODEL_KEYS = ["path", "flags"]
MODEL_SUFFIX = ".gguf"
MIN_MODELS, MAX_MODELS = 1, 5
ALLOWED_TASKS = ["mmlu", "mmlu_generative"]
ALLOWED_KV_FIX = ["f16", "no-cache", "off"]

ENTRY_COLUMNS = ["run_id", "group_pos", "tokenizer", "models_dir", "group_flags", "model_pos", "path", "flags"]


def load_registry(docs: DataFrame) -> DataFrame:
    """``(run_id, groups array<struct<tokenizer, models_dir, flags, models array<struct<path, flags>>>>)``
    -> one row per model entry in document order (group_pos, model_pos)."""
    g = docs.select("run_id", F.posexplode_outer("groups").alias("group_pos", "g"))
    m = g.select("run_id", "group_pos", F.col("g.tokenizer").alias("tokenizer"),
                 F.col("g.models_dir").alias("models_dir"), F.col("g.flags").alias("group_flags"),
                 F.posexplode_outer("g.models").alias("model_pos", "m"))
    return m.select("run_id", "group_pos", "tokenizer", "models_dir", "group_flags",
                    F.col("model_pos").cast("bigint").alias("model_pos"), F.col("m.path").alias("path"),
                    F.col("m.flags").alias("flags"))


def _rule(cond: Column, rule: str) -> Column:
    return F.when(cond, F.lit(rule))


def _kind(v: Column) -> Column:
    """JSON type of a variant: STRING, LIST, MAPPING, OTHER, or NONE where it is missing or null."""
    k = F.schema_of_variant(v)
    return (F.when(v.isNull() | (k == "VOID"), F.lit("NONE")).when(k == "STRING", F.lit("STRING")).when(k.startswith("ARRAY"), F.lit("LIST"))
            .when(k.startswith("OBJECT"), F.lit("MAPPING")).otherwise(F.lit("OTHER")))


def _text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _falsy(v: Column) -> Column:
    """Missing, null, or an empty list or text: such flags fall back, they are no error."""
    kind = _kind(v)
    return (kind == "NONE") | ((kind == "LIST") & (F.size(F.try_variant_get(v, "$", "array<variant>")) == 0)) | ((kind == "STRING") & (_text(v) == "")) \
        | ((kind == "MAPPING") & (F.size(F.try_variant_get(v, "$", "map<string,variant>")) == 0)) \
        | ((kind == "OTHER") & F.coalesce((F.try_variant_get(v, "$", "double") == 0) | ~F.try_variant_get(v, "$", "boolean"), F.lit(False)))


def _flags(v: Column) -> tuple[Column, Column]:
    """(flags, whether they are neither missing nor a list of texts)."""
    items = F.try_variant_get(v, "$", "array<variant>")
    texts = (_kind(v) == "LIST") & F.forall(items, lambda x: _kind(x) == "STRING")
    return F.when(~_falsy(v) & texts, F.transform(items, _text)), ~_falsy(v) & ~F.coalesce(texts, F.lit(False))


def parse_registry_json(docs: DataFrame, col: str = "json") -> DataFrame:
    """S8 from JSON documents ``(run_id, json)``: a list of family groups whose ``models``
    entries are either a path string or a mapping ``{path, flags}``.

    Groups and entries are parsed as ``variant``. Besides the flattened entry rows there are
    ``group_unknown`` / ``model_unknown`` (keys outside the allowed sets, U4) and ``problems``, the names of
    the shape rules that the document, group or entry breaks (F10).
    """
    doc = F.try_parse_json(F.col(col))
    groups = F.try_variant_get(doc, "$", "array<variant>")
    g = docs.select("run_id", F.coalesce(F.size(groups) == 0, F.lit(True)).alias("_no_groups"), F.posexplode_outer(groups).alias("group_pos", "g"))
    part = lambda c, k: F.try_element_at(F.try_variant_get(F.col(c), "$", "map<string,variant>"), F.lit(k))
    group_flags, bad_group_flags = _flags(part("g", "flags"))
    dir_kind = _kind(part("g", "models-dir"))
    has_dir = F.array_contains(F.map_keys(F.try_variant_get(F.col("g"), "$", "map<string,variant>")), "models-dir")
    models = F.when(_kind(part("g", "models")) == "LIST", F.try_variant_get(part("g", "models"), "$", "array<variant>"))
    is_group = _kind(F.col("g")) == "MAPPING"
    group_problems = F.array(
        _rule(F.col("_no_groups"), "not_a_list"), _rule(~F.col("_no_groups") & ~is_group, "group_not_mapping"),
        _rule(is_group & has_dir & ((dir_kind != "STRING") | (_text(part("g", "models-dir")) == "")), "bad_models_dir"),
        _rule(is_group & bad_group_flags, "bad_flags"))
    g = g.select(
        "run_id", "group_pos", _text(part("g", "tokenizer")).alias("tokenizer"), F.nullif(_text(part("g", "models-dir")), F.lit("")).alias("models_dir"),
        group_flags.alias("group_flags"), unknown_keys(F.map_keys(F.try_variant_get(F.col("g"), "$", "map<string,variant>")), GROUP_KEYS).alias("group_unknown"),
        group_problems.alias("_gp"), F.posexplode_outer(models).alias("model_pos", "m"))
    kind = _kind(F.col("m"))
    flags, bad_flags = _flags(part("m", "flags"))
    entry_problems = F.array(_rule((kind == "MAPPING") & bad_flags, "bad_flags"), _rule(F.col("model_pos").isNotNull() & ~kind.isin("STRING", "MAPPING"), "bad_entry"))
    none = F.array().cast("array<string>")
    # what is wrong with the group is told once, at its first entry
    first = F.coalesce(F.col("model_pos"), F.lit(0)) == 0
    problems = F.array_union(F.when(first, F.col("_gp")).otherwise(none), entry_problems)
    return g.select(
        "run_id", "group_pos", "tokenizer", "models_dir", "group_flags", F.col("model_pos").cast("bigint").alias("model_pos"),
        F.when(kind == "STRING", _text(F.col("m"))).otherwise(_text(part("m", "path"))).alias("path"),
        F.when(kind == "MAPPING", flags).alias("flags"),
        F.when(first, F.col("group_unknown")).otherwise(none).alias("group_unknown"),
        F.when(kind == "MAPPING", unknown_keys(F.map_keys(F.try_variant_get(F.col("m"), "$", "map<string,variant>")), MODEL_KEYS)).otherwise(none).alias("model_unknown"),
        F.filter(problems, lambda x: x.isNotNull()).alias("problems"))


def normal_path(path: Column) -> Column:
    """A path without ``.`` steps, doubled slashes and ``x/..`` pairs: the names of one file are one."""
    parts = F.filter(F.split(path, "/+"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(
        (p == "..") & (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
        F.when((p == "..") & path.startswith("/"), acc).otherwise(F.concat(acc, F.array(p)))))
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))


def resolve_flags(model_flags: Column, group_flags: Column) -> Column:
    """Model flags replace group flags; an empty or missing list falls back to the group."""
    return F.when(F.size(F.coalesce(model_flags, F.array())) > 0, model_flags) \
        .otherwise(F.coalesce(group_flags, F.array().cast("array<string>")))


def resolve_path(path: Column, models_dir: Column, tokenizer: Column) -> Column:
    """Absolute paths are kept, others are joined to models-dir (default: the tokenizer dir)."""
    base = F.coalesce(models_dir, tokenizer)
    return normal_path(F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path)))


def resolve_models(entries: DataFrame) -> DataFrame:
    """D1 model rows: ordinal (document order within the run), model_id (slug), label, stem, path, flags."""
    w = Window.partitionBy("run_id").orderBy("group_pos", "model_pos")
    path = resolve_path(F.col("path"), F.col("models_dir"), F.col("tokenizer"))
    return entries.select(
        "run_id", F.row_number().over(w).cast("bigint").alias("ordinal"),
        slugify(model_stem(path)).alias("model_id"), model_label(path).alias("label"),
        path.alias("resolved_path"), "tokenizer",
        resolve_flags(F.col("flags"), F.col("group_flags")).alias("flags"))


def registry_violations(entries: DataFrame, check_model_count: bool = False) -> DataFrame:
    """one row per broken rule (run_id, group_pos, model_pos, rule, detail).

    Rules: tokenizer required, models non-empty, path required, ``.gguf`` suffix
    (any case), duplicate resolved path within the run; with ``check_model_count``
    also the 1..5 models per run bound.
    """
    path = resolve_path(F.col("path"), F.col("models_dir"), F.col("tokenizer"))
    dup_w = Window.partitionBy("run_id", "_resolved")
    e = entries.withColumn("_resolved", path).withColumn(
        "_dups", F.count(F.lit(1)).over(dup_w))
    rules = F.array(
        _rule(F.coalesce(F.col("tokenizer"), F.lit("")) == "", "tokenizer_required"),
        _rule(F.col("model_pos").isNull(), "models_required"),
        _rule(F.col("model_pos").isNotNull() & (F.coalesce(F.col("path"), F.lit("")) == "")
              & (~F.array_contains("problems", "bad_entry") if "problems" in entries.columns else F.lit(True)), "path_required"),
        _rule(F.col("path").isNotNull() & ~F.lower(F.col("path")).endswith(MODEL_SUFFIX), "not_gguf"),
        _rule(F.col("path").isNotNull() & (F.col("_dups") > 1), "duplicate_path"),
        *([_rule(F.size(F.coalesce("group_unknown", F.array())) > 0, "unknown_group_keys")]
          if "group_unknown" in entries.columns else []),
        *([_rule(F.size(F.coalesce("model_unknown", F.array())) > 0, "unknown_model_keys")]
          if "model_unknown" in entries.columns else []),
    )
    if "problems" in entries.columns:  # rules about shapes, found while parsing
        whole = F.array_contains("problems", "not_a_list") | F.array_contains("problems", "group_not_mapping")
        rules = F.concat(F.when(whole, F.array().cast("array<string>")).otherwise(rules), F.col("problems"))
    out = (e.select("run_id", "group_pos", "model_pos", F.col("_resolved").alias("detail"),
                    F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule")))
    if check_model_count:
        counts = (entries.filter(F.col("model_pos").isNotNull()).groupBy("run_id")
                  .agg(F.count(F.lit(1)).alias("n")))
        bad = counts.filter((F.col("n") < MIN_MODELS) | (F.col("n") > MAX_MODELS)).select(
            "run_id", F.lit(None).cast("int").alias("group_pos"), F.lit(None).cast("bigint").alias("model_pos"),
            F.col("n").cast("string").alias("detail"), F.lit("model_count").alias("rule"))
        out = out.unionByName(bad)
    return out


def unknown_keys(keys_col: Column, allowed: list[str]) -> Column:
    """U4: given keys minus allowed keys, sorted."""
    return F.array_sort(F.array_except(keys_col, F.array(*[F.lit(k) for k in allowed])))


def run_option_violations(runs: DataFrame) -> DataFrame:
    """weights in [0, 1], known task (unless skipped), known KV fix; one row per broken rule."""
    rules = F.array(
        _rule(~F.col("weights_mmlu").between(0.0, 1.0), "weights_mmlu_range"),
        _rule(~F.col("weights_ppl").between(0.0, 1.0), "weights_ppl_range"),
        _rule(~F.coalesce(F.col("skip_mmlu"), F.lit(False)) & ~F.col("mmlu_task").isin(ALLOWED_TASKS),
              "unknown_task"),
        _rule(~F.coalesce(F.col("coding_kv_fix"), F.lit("f16")).isin(ALLOWED_KV_FIX), "unknown_kv_fix"),
    )
    return runs.select("run_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
