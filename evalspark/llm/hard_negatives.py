"""Hard-negative mining by threshold joins over an inverted index with suffix-norm bounds.

Anchors are searched in blocks against all rows. A task indexes the rows it reads, dimension by
dimension in an order of falling weight over the whole table. The last dimensions of a row, whose
norm times that of any anchor stays below the least threshold of the block, are left out of the
index: a pair that reaches its threshold has a positive partial score without them. Partial scores
are accumulated along the indexed dimensions, a pair is dropped once its partial score and the
product of the remaining norms stay below the anchor's threshold, and pairs that are left are scored
exactly over whole vectors.

An anchor starts with a high threshold. As long as its windows are not full (the positives, then up to
three negatives for each positive) its threshold is lowered and it is searched again, at last without any
threshold. Starting points come from scores against a bounded sample of rows; they decide how often an
anchor is searched, never what is found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.session import checkpoint_dir

from .common import scratch

#: Anchors searched at a time, and rows indexed at a time within a task; fewer if vectors are long.
BLOCK = 2048
_CHUNK = 1024
#: Dimensions accumulated between two prunings, and components of vectors gathered at a time.
_STEP = 16
_GATHER = 1 << 21
#: Rows of the sample that starting thresholds are drawn from, and how many rows a window should then find.
SAMPLE = 2048
_AIM = 8.0
#: After so many searches with a threshold an anchor is searched without one.
ROUNDS = 5


def integer_vectors(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, x array<long>) of the rows of ``rows`` (vec_id, embedding, label) that take part.

    A component v becomes floor(scale * v), v as double. Rows with a null id, label or vector, or with a
    null or non-finite component, take no part.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(v, lambda e: F.floor(F.lit(scale) * e).cast("long")).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of ``width``; missing dimensions are 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _suffix_norms(x: np.ndarray) -> np.ndarray:
    """Norm of every row from each dimension on; one more column of zeros."""
    sq = np.cumsum(x[:, ::-1] ** 2, axis=1)[:, ::-1]
    return np.sqrt(np.hstack([sq, np.zeros((len(x), 1))])) * (1 + 1e-12)


@dataclass
class Anchors:
    """A block of anchors: ids, labels, whole vectors, vectors in index order with their suffix norms, and windows.

    Window k of anchor i takes rows with lo[i, k] <= score <= hi[i, k]; ``like`` tells whether rows of the
    anchor's own label are looked for or others, ``want`` how many a window takes.
    """

    key: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    q: np.ndarray
    norms: np.ndarray
    order: np.ndarray
    threshold: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    like: bool
    want: int


def _fitting(n: int, width: int) -> int:
    """At most ``n`` vectors, as many as may be held at a time."""
    return max(1, min(n, _GATHER // max(1, width)))


def _exact(x: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs of rows."""
    out = np.empty(len(i), np.int64)
    n = _fitting(len(i), x.shape[1])
    for s in range(0, len(i), n):
        out[s:s + n] = np.einsum("ij,ij->i", x[i[s:s + n]], q[j[s:s + n]])
    return out


class Index:
    """Inverted index of a chunk of rows; a row's last dimensions are left out where their norm proves it safe."""

    def __init__(self, x: np.ndarray, order: np.ndarray, least: float, anchor_norms: np.ndarray):
        self.x = x
        v = x[:, order].astype(np.float64)
        self.norms = _suffix_norms(v)
        # the norm of the rest of any anchor, by dimension
        rest = self.norms * anchor_norms.max(axis=0) if len(anchor_norms) else self.norms
        # rows hold a dimension as long as the rest from there on could reach the least threshold
        self.held = rest[:, :-1] >= least
        self.postings = np.where(self.held, v, 0.0)
        self.lengths = self.held.sum(axis=1)

    def candidates(self, a: Anchors) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, anchor) that may reach the anchor's threshold; all others cannot."""
        n, width = self.postings.shape
        rows = np.arange(n)
        acc = np.zeros((n, len(a.q)))
        slack = 1e-9 * (1 + self.norms[:, 0])[:, None] * (1 + a.norms[:, 0])[None, :]
        goal = a.threshold[None, :] - slack
        for d in range(0, width, _STEP):
            e = min(width, d + _STEP)
            live = self.lengths[rows] > d
            if not live.any():
                break
            acc += self.postings[rows, d:e] @ a.q[:, d:e].T
            # what is not yet accumulated: dimensions behind e, and those the row leaves out before e
            from_ = np.minimum(e, self.lengths[rows])
            rest = self.norms[rows, from_]
            alive = (acc + rest[:, None] * a.norms[:, e if (from_ == e).all() else int(from_.min())][None, :] >= goal[rows]).any(axis=1)
            rows, acc = rows[alive], acc[alive]
            if not len(rows):
                break
        from_ = self.lengths[rows]
        bound = acc + self.norms[rows, from_][:, None] * a.norms[:, from_].T
        i, j = np.nonzero(bound >= goal[rows])
        return rows[i], j


def _best(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` first of every key: higher scores, then smaller ids."""
    by = np.lexsort((ids, -scores, keys))
    k = keys[by]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    place = np.arange(len(k)) - np.maximum.accumulate(np.where(new, np.arange(len(k)), 0)) if len(k) else k
    return by[place < n]


def _search(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, a: Anchors) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, window, vec_id, score) of what one chunk adds to the windows."""
    index = Index(x, a.order, float(a.threshold.min()), a.norms)
    i, j = index.candidates(a)
    fits = (labels[i] == a.label[j]) == a.like
    if a.like:
        fits &= ids[i] != a.vec_id[j]
    i, j = i[fits], j[fits]
    score = _exact(x, a.x, i, j)
    near = score >= a.threshold[j]
    i, j, score = i[near], j[near], score[near]
    out = []
    for k in range(a.lo.shape[1]):
        inside = np.flatnonzero((score >= a.lo[j, k]) & (score <= a.hi[j, k]))
        best = inside[_best(j[inside], score[inside], ids[i[inside]], a.want)]
        out.append((j[best], np.full(len(best), k, np.int32), ids[i[best]], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _round(rows: DataFrame, a: Anchors, width: int) -> DataFrame:
    """(anchor int, window int, vec_id, score, rank) of the windows of a block after one pass over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = _fitting(_CHUNK, width)
            for at in range(0, batch.num_rows, n):
                part = batch.slice(at, n)
                ids, labels = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                j, k, vec_id, score = _search(ids, labels, _matrix(part.column(2), width), a)
                yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(vec_id), pa.array(score)],
                                                 names=["anchor", "window", "vec_id", "score"])

    # every task has sent the first of each window of its chunks: few rows a window
    w = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    found = rows.select("vec_id", "label", "x").mapInArrow(run, "anchor int, window int, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= a.want)


def _dimensions(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Longest vector, and the dimensions by falling sum of squares over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0)
        for batch in batches:
            widest = int(np.diff(batch.column(0).offsets.to_numpy()).max(initial=0))
            n = _fitting(_CHUNK, widest)
            for at in range(0, batch.num_rows, n):
                column = batch.column(0).slice(at, n)
                width = int(np.diff(column.offsets.to_numpy()).max(initial=0))
                sums = (_matrix(column, width).astype(np.float64) ** 2).sum(axis=0)
                total, sums = (total, sums) if len(total) >= len(sums) else (sums, total)
                total[:len(sums)] += sums
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["d", "s"])

    by = rows.select("x").mapInArrow(run, "d int, s double").groupBy("d").agg(F.sum("s").alias("s")).collect()
    weight = np.zeros(max((r["d"] + 1 for r in by), default=0))
    for r in by:
        weight[r["d"]] = r["s"]
    return len(weight), np.argsort(-weight, kind="stable")


def _scores_of_sample(rows: DataFrame, n: int, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels and vectors of at most SAMPLE rows, the same on every run, and the share of all rows that they are."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(_fitting(SAMPLE, width)).collect()
    x = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        x[i, :len(r["x"])] = r["x"]
    return np.array([r["label"] for r in sample], np.int64), x, len(sample) / max(1, n)


def _start(mean: np.ndarray, spread: np.ndarray, rows: np.ndarray, want: float) -> np.ndarray:
    """The score above which a normal spread would have ``want`` of ``rows`` rows."""
    share = np.clip(want / np.maximum(rows, 1e-9), 1e-15, 0.5)
    return mean + spread * np.array([-NormalDist().inv_cdf(float(s)) for s in share])


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` (vec_id, label, x array<long>) are rows that take part, see ``integer_vectors``;
    ``is_anchor`` picks the anchors. A row's score is its integer inner product with the anchor, higher
    scores first, ties by smaller vec_id; scores have to fit a long by a factor of 100. An anchor's positives
    are its first rows of the same label and another vec_id. For each positive the first rows of another
    label with low * positive_score <= 100 * negative_score <= high * positive_score are returned, rank from
    1; a positive without any gives no row. Vectors of different lengths are filled up with zeros.
    Repeated rows count each, as rows and as anchors. No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = scratch(vectors.select("vec_id", "label", "x", F.coalesce(is_anchor, F.lit(False)).alias("anchor")), "negatives-rows")
    anchors = rows.where("anchor").select("vec_id", "label", "x", F.monotonically_increasing_id().alias("key"))
    n, n_anchors = rows.count(), rows.where("anchor").count()
    width, order = _dimensions(rows)
    blocks = max(1, -(-n_anchors // _fitting(block, width)))
    path = f"{checkpoint_dir(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}"
    schema = "vec_id long, label long, x array<long>, key long, block int"
    anchors.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(f"{path}/anchors")
    anchors = spark.read.schema(schema).parquet(f"{path}/anchors")
    sampled = _scores_of_sample(rows, n, width)
    parts = []
    for b in range(blocks):
        # one block of anchors is on the driver at a time
        found = anchors.where(F.col("block") == b).orderBy("key").collect()
        if found:
            _mine_block(rows, found, order, width, n, sampled, positives, negatives, low, high, f"{path}/block-{b}", parts)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(out).parquet(*parts) if parts else spark.createDataFrame([], out)


def _lowered(threshold: np.ndarray, spread: np.ndarray, tried: int) -> np.ndarray:
    """The next thresholds: lower by growing steps, at last none."""
    if tried >= ROUNDS:
        return np.full_like(threshold, -np.inf)
    return threshold - 0.3 * 2 ** tried * np.maximum(spread, 1.0)


def _mine_block(rows, found, order, width, n, sampled, positives, negatives, low, high, path, parts) -> None:
    """Search one block of anchors; what is found is written below ``path``, the folders are added to ``parts``."""
    spark = rows.sparkSession
    m = len(found)
    x = np.zeros((m, width), np.int64)
    for i, r in enumerate(found):
        x[i, :len(r["x"])] = r["x"]
    label = np.array([r["label"] for r in found], np.int64)
    vec_id = np.array([r["vec_id"] for r in found], np.int64)
    q = x[:, order].astype(np.float64)
    norms = _suffix_norms(q)
    s_label, s_x, share = sampled
    scores = x.astype(np.float64) @ s_x.T
    mean, spread = scores.mean(axis=1), scores.std(axis=1)
    alike = np.maximum((s_label[None, :] == label[:, None]).sum(axis=1), 0.5) / max(share, 1e-12)

    def block_of(now, threshold, lo, hi, like, want):
        return Anchors(np.arange(m)[now], vec_id[now], label[now], x[now], q[now], norms[now], order, threshold, lo, hi, like, want)

    # positives: lower the thresholds until every anchor has its number
    ids, got = np.zeros((m, positives), np.int64), np.zeros((m, positives), np.int64)
    have = np.zeros(m, np.int64)
    now = np.arange(m)
    threshold = np.ceil(_start(mean, spread, alike, positives + _AIM))
    tried = 0
    while len(now):
        free = np.full((len(now), 1), np.iinfo(np.int64).min), np.full((len(now), 1), np.iinfo(np.int64).max)
        a = block_of(now, threshold, *free, True, positives)
        best = _round(rows, a, width).collect()  # at most ``positives`` rows of each anchor of the block
        have[now] = 0
        for r in best:
            i = now[r["anchor"]]
            ids[i, r["rank"] - 1], got[i, r["rank"] - 1] = r["vec_id"], r["score"]
            have[i] = max(have[i], r["rank"])
        open_ = (have[now] < positives) & np.isfinite(threshold)
        threshold = _lowered(threshold, spread[now], tried)[open_]
        now, tried = now[open_], tried + 1

    # negatives: a window for every positive, empty where there is none
    exists = np.arange(positives) < have[:, None]
    lo = np.where(exists, -((-low * got) // 100), 1)
    hi = np.where(exists, high * got // 100, 0)
    full = lo > hi
    now = np.flatnonzero(~full.all(axis=1))
    top = np.where(full, np.iinfo(np.int64).max, hi).min(axis=1).astype(np.float64)
    # rows expected beyond the lowest window's upper end come on top of those it should hold
    beyond = np.array([NormalDist().cdf(-min(30.0, (t - u) / s)) if s > 0 else 1.0 for t, u, s in zip(top, mean, spread)]) * n
    threshold = np.minimum(np.ceil(_start(mean, spread, np.full(m, float(n)), beyond + negatives + _AIM)), top)[now]
    tried = 0
    while len(now):
        floor = np.where(full[now], np.iinfo(np.int64).max, lo[now]).min(axis=1)
        threshold = np.maximum(threshold, floor.astype(np.float64))
        a = block_of(now, threshold, np.where(full[now], 1, lo[now]), np.where(full[now], 0, hi[now]), False, negatives)
        # a window is done if it is full, or if nothing of it lies below the threshold
        done = lo[now] >= threshold[:, None]
        w = spark.createDataFrame([(int(i), int(k), int(vec_id[now[i]]), int(ids[now[i], k]), int(got[now[i], k]), bool(done[i, k]))
                                   for i, k in zip(*np.nonzero(~full[now]))], "anchor int, window int, anchor_id long, positive_id long, positive_score long, done boolean")
        best = _round(rows, a, width)
        kept = best.withColumn("n", F.count("*").over(Window.partitionBy("anchor", "window")))
        # one row per window of the block: at most block * positives rows
        kept = kept.join(F.broadcast(w), ["anchor", "window"]).where(F.col("done") | (F.col("n") == negatives))
        place = f"{path}/round-{tried}"
        kept.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score"), "anchor", "window").write.parquet(place)
        parts.append(place)
        filled = spark.read.parquet(place).select("anchor", "window").distinct().collect()
        full[now] |= done
        for r in filled:
            full[now[r["anchor"]], r["window"]] = True
        still = ~full[now].all(axis=1)
        threshold = _lowered(threshold, spread[now], tried)[still]
        now, tried = now[still], tried + 1
