"""Pluggable scorer and generator (X1, X2) with the full prefixes of every token (W5), in request order.

A request is one row with its token ids; its prefixes are never rows. A task makes them one by one as views of
the request's ids, so the input stays as large as the requests, however long they are. A scorer or generator is
built once per Python worker and then used for all of the worker's tasks.
"""

from __future__ import annotations

import math
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions import arrays
from evalspark.functions import text as texts

REQUEST_KEYS = ["run_id", "model_id", "request_id"]


class Prefix(NamedTuple):
    """What a scorer is asked: the number of the request within its batch, the ids before a token, and the token."""

    request: int
    ids: np.ndarray
    target: int


#: Takes prefixes in order, lazily, and gives (logprob, is_greedy) for each in the same order.
Scorer = Callable[[Iterable[Prefix]], Iterable[tuple[float, bool]]]
#: Takes the prompt's ids and gives the generated ids, or None if there is no answer.
Generator = Callable[[np.ndarray], "list[int] | None"]

_FACTORIES: dict[str, Callable] = {}


def register(name: str):
    """Class or function decorator: a factory of scorers or generators that can be named instead of passed."""
    def put(factory):
        _FACTORIES[name] = factory
        return factory
    return put


def _factory(of) -> Callable:
    if not isinstance(of, str):
        return of
    if of not in _FACTORIES:
        raise KeyError(f"{of!r} is not registered; there are {sorted(_FACTORIES)}")
    return _FACTORIES[of]


_BUILT: dict[str, object] = {}


def _once(key: str, factory: Callable):
    """What ``factory`` makes, made once in this worker."""
    if key not in _BUILT:
        _BUILT[key] = factory()
    return _BUILT[key]


def _prefixes(context: pa.ListArray, continuation: pa.ListArray, max_length: int | None) -> Iterator[Prefix]:
    """The prefixes of a batch of requests, W5 and P16: context and earlier continuation tokens, as views."""
    ctx, c_at = context.values.to_numpy(zero_copy_only=False), context.offsets.to_numpy()
    cont, t_at = continuation.values.to_numpy(zero_copy_only=False), continuation.offsets.to_numpy()
    for k in range(len(continuation)):
        a, tokens = ctx[c_at[k]:c_at[k + 1]], cont[t_at[k]:t_at[k + 1]]
        if max_length is not None and len(a) + len(tokens) > max_length:
            a = a[len(a) - min(len(a), max(0, max_length - len(tokens))):]
        ids = np.concatenate([a, tokens])
        ids.flags.writeable = False
        for at, target in enumerate(tokens.tolist(), len(a)):
            yield Prefix(k, ids[:at], target)


def _sums(of: Iterable[Prefix], scorer: Scorer, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loglik, is_greedy, n_tokens) of ``n`` requests; one without tokens is (0.0, True, 0)."""
    total, greedy, count = np.zeros(n), np.ones(n, bool), np.zeros(n, np.int64)
    asked: deque[int] = deque()
    ask, answered = asked.append, asked.popleft

    def noted():
        for p in of:
            ask(p.request)
            yield p

    now, logliks, all_greedy = -1, [], True

    def close() -> None:
        if now >= 0:
            total[now], greedy[now], count[now] = sum(logliks), all_greedy, len(logliks)

    for logprob, is_greedy in scorer(noted()):
        if not asked:
            raise ValueError("the scorer gave more answers than there are prefixes")
        k = answered()
        if k != now:
            close()
            now, logliks, all_greedy = k, [], True
        logliks.append(logprob)
        all_greedy = all_greedy and bool(is_greedy)
    close()
    if asked:
        raise ValueError(f"the scorer left {len(asked)} prefixes unanswered")
    return total, greedy, count


def score_with(requests: DataFrame, scorer: str | Callable[[], Scorer], max_length: int | None = None, order: str = "request_no",
               keys=REQUEST_KEYS, context: str = "context_ids", continuation: str = "continuation_ids") -> DataFrame:
    """Keys, ``order``, loglik, is_greedy, n_tokens per request (A1), from a scorer that sees full prefixes.

    ``scorer`` is a registered name or a factory; it is called once per worker and gives a ``Scorer``. With
    ``max_length`` the last context ids are kept that leave room for the continuation. NULL id lists count as
    empty. The requests' own number ``order`` is carried, so that a sink can restore the order.
    """
    factory, key = _factory(scorer), uuid.uuid4().hex
    kept = [*keys, order]
    schema = T.StructType([*requests.select(*kept).schema.fields, T.StructField("loglik", T.DoubleType()), T.StructField("is_greedy", T.BooleanType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _once(key, factory)
        for batch in batches:
            sums = _sums(_prefixes(*batch.columns[-2:], max_length), built, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *map(pa.array, sums)], names=schema.names)

    ids = lambda c: F.coalesce(F.col(c).cast("array<bigint>"), F.array().cast("array<bigint>"))
    return requests.select(*kept, ids(context).alias("_context"), ids(continuation).alias("_continuation")).mapInArrow(run, schema)


def generate_with(requests: DataFrame, generator: str | Callable[[], Generator], max_length: int, max_new_tokens: int, order: str = "request_no",
                  keys=REQUEST_KEYS, prompt: str = "prompt_ids") -> DataFrame:
    """Keys, ``order`` and generated array<bigint> per request; NULL where the generator gave no answer.

    The generator sees the last ``max_length - max_new_tokens`` ids of a prompt (P16) and is built once per worker.
    ``placeholder_texts`` fills the gaps.
    """
    factory, key = _factory(generator), uuid.uuid4().hex
    kept = [*keys, order]
    schema = T.StructType([*requests.select(*kept).schema.fields, T.StructField("generated", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _once(key, factory)
        for batch in batches:
            rows = batch.column(batch.num_columns - 1)
            ids, at = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
            out = [built(ids[a:b]) for a, b in zip(at[:-1], at[1:])]
            answers = pa.array([None if o is None else [int(i) for i in o[:max_new_tokens]] for o in out], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], answers], names=schema.names)

    ids = F.coalesce(F.col(prompt).cast("array<bigint>"), F.array().cast("array<bigint>"))
    cut = requests.withColumn("_ids", ids).select(*kept, arrays.truncate_prompt("_ids", max_length, max_new_tokens).alias("_ids"))
    return cut.mapInArrow(run, schema)


def placeholder_texts(generated: DataFrame, text: str = "generated") -> DataFrame:
    """The text or the placeholder, and whether it is one."""
    filled, missing = texts.placeholder(F.col(text))
    return generated.withColumn("is_placeholder", missing).withColumn(text, filled)


def in_request_order(results: DataFrame, order: str = "request_no") -> DataFrame:
    """Results in the order of their requests, for a sink; every run is ordered by the requests' own number."""
    return results.orderBy("run_id", "model_id", order)


# ---- requests answered before ------------------------------------------------------------------

def request_hash(*parts: str) -> Column:
    """Identity of a request: a digest of what is sent, each part with its length."""
    text = [F.coalesce(F.to_json(F.struct(F.col(p).alias("p"))), F.lit("")) for p in parts]
    return F.sha2(F.concat(*[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in text]), 256)


def unanswered(requests: DataFrame, answered: DataFrame, parts: list[str]) -> DataFrame:
    """Requests that no earlier run has answered: an anti join on the digest of ``parts``; equal requests of one
    table all stay. ``answered`` holds the parts of answered requests."""
    return requests.withColumn("_hash", request_hash(*parts)).join(
        answered.select(request_hash(*parts).alias("_hash")).distinct(), "_hash", "left_anti").drop("_hash")


# ---- scorer and generator without a model ------------------------------------------------------

@register("adaptive")
class AdaptiveScorer:
    """Laplace estimate from the prefix alone: ln((1 + occurrences of the token) / (tokens + vocabulary)).

    Greedy is a token that has occurred, and none more often. Counts are kept from one prefix of a request to the next.
    """

    def __init__(self, vocabulary: int = 10_000):
        self.vocabulary = vocabulary

    def __call__(self, prefixes: Iterable[Prefix]) -> Iterator[tuple[float, bool]]:
        request, seen, counts, most, last = None, 0, {}, 0, None
        for now, ids, target in prefixes:
            size = len(ids)
            if now != request or size < seen:
                request, seen, counts, most = now, 0, {}, 0
            # the next prefix of a request ends with the token that was asked for last
            for token in ((last,) if size == seen + 1 and seen else ids[seen:].tolist()):
                n = counts[token] = counts.get(token, 0) + 1
                if n > most:
                    most = n
            seen, last = size, target
            n = counts.get(target, 0)
            yield math.log((n + 1) / (size + self.vocabulary)), 0 < n == most


@register("prompt-lookup")
class PromptLookup:
    """What followed the last earlier occurrence of the prompt's last token; no answer if it occurs only once."""

    def __call__(self, prompt: np.ndarray) -> list[int] | None:
        if len(prompt) < 2:
            return None
        at = np.flatnonzero(prompt[:-1] == prompt[-1])
        return prompt[at[-1] + 1:].tolist() if len(at) else None
