"""Array expressions over outcome lists, token id lists and candidate lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def outcome_as_bool(x: Column) -> Column:
    """Truthiness of one JSON outcome (a variant), by its JSON type: false, null, any zero, an empty
    text, list or object are false; everything else is true, the text ``"false"`` too."""
    kind = F.schema_of_variant(x)
    number = F.try_variant_get(x, "$", "double")
    return (F.when(x.isNull() | (kind == "VOID"), F.lit(False))
            .when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
            .when(kind == "STRING", F.try_variant_get(x, "$", "string") != "")
            .when(kind.startswith("ARRAY"), F.size(F.try_variant_get(x, "$", "array<variant>")) > 0)
            .when(kind.startswith("OBJECT"), F.size(F.try_variant_get(x, "$", "map<string,variant>")) > 0)
            .otherwise(F.coalesce(number != 0, F.lit(True))))


def pass_flags(outcomes) -> tuple[Column, Column]:
    """``(passed on try 1, passed on any try)``; an empty or NULL list is (false, false)."""
    o = _c(outcomes)
    p1 = F.coalesce(F.get(o, 0), F.lit(False))
    p_any = F.coalesce(F.exists(o, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))
    return p1, p_any


def exercise_cell(p1, p_any) -> Column:
    """``–`` not run, ``1`` first try, ``2`` a later try, ``·`` failed."""
    p1, p_any = _c(p1), _c(p_any)
    return (F.when(p1.isNull() & p_any.isNull(), F.lit("–"))
            .when(p1, F.lit("1"))
            .when(p_any, F.lit("2"))
            .otherwise(F.lit("·")))


def truncate_context(context_ids, continuation_ids, max_length) -> Column:
    """Keep the last ``max_length - len(continuation)`` context ids when too long.

    Intended meaning for room <= 0: an empty context (SURVEY T15).
    """
    ctx, cont = _c(context_ids), _c(continuation_ids)
    max_len = max_length if isinstance(max_length, Column) else F.lit(max_length)
    keep = max_len - F.size(cont)
    too_long = (F.size(ctx) + F.size(cont)) > max_len
    empty = F.filter(ctx, lambda _: F.lit(False))  # typed empty array
    k = F.greatest(keep, F.lit(1))
    kept = F.when(keep <= 0, empty).otherwise(F.slice(ctx, -k, k))
    return F.when(too_long, kept).otherwise(ctx)


def truncate_prompt(prompt_ids, max_length, max_new_tokens) -> Column:
    """P16, generation: keep the last ``max_length - max_new_tokens`` ids of a longer prompt (none if there is no room)."""
    ids = _c(prompt_ids)
    room = (max_length if isinstance(max_length, Column) else F.lit(max_length)) - (max_new_tokens if isinstance(max_new_tokens, Column) else F.lit(max_new_tokens))
    kept = F.greatest(room, F.lit(1))
    return F.when(F.size(ids) <= room, ids).when(room <= 0, F.slice(ids, 1, 0)).otherwise(F.slice(ids, -kept, kept))
