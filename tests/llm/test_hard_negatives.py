"""Hard negatives: against brute force, with small blocks and chunks, ties, repeats and rare labels."""
import random

import numpy as np
import pytest

from evalspark.llm import hard_negatives as hn
from pyspark.sql import functions as F


def brute(rows, anchor, positives=5, negatives=3, low=50, high=95):
    """Every score of every anchor, sorted."""
    out = []
    rows = [(i, lab, [int(np.floor(256 * float(v))) for v in x]) for i, lab, x in rows if i is not None and lab is not None and x is not None
            and all(v is not None and np.isfinite(v) for v in x)]
    for a, lab, x in rows:
        if not anchor(a):
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y)), i, la == lab) for i, la, y in rows))
        found = [(i, -s) for s, i, same in scored if same and i != a][:positives]
        for p, ps in found:
            near = [(i, -s) for s, i, same in scored if not same and low * ps <= 100 * -s <= high * ps][:negatives]
            out += [(a, p, k + 1, i, ps, ns) for k, (i, ns) in enumerate(near)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("vec_id", "embedding", "label").repartition(3)


def mined(spark, rows, every, **kw):
    v = hn.integer_vectors(table(spark, [(i, x, lab) for i, lab, x in rows]))
    return sorted(tuple(r) for r in hn.mine_hard_negatives(v, F.col("vec_id") % every == 0, **kw).collect())


def made_up(seed, n, width, labels, steps=None):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = r.choice(centres)
        x = [0.5 * m + r.gauss(0, 0.6) for m in c]
        rows.append((i, r.choice(labels), [round(v * steps) / steps for v in x] if steps else x))
    return rows


@pytest.mark.parametrize("seed,width,labels,steps", [(1, 16, [0, 1, 2], None), (2, 8, [0, 1], 2), (3, 40, [0] * 30 + [1], None), (4, 3, [5], None)])
def test_against_brute_force(spark, monkeypatch, seed, width, labels, steps):
    monkeypatch.setattr(hn, "_CHUNK", 64)
    rows = made_up(seed, 400, width, labels, steps)
    got = mined(spark, rows, 10, block=16)
    assert got == brute(rows, lambda i: i % 10 == 0)
    if seed < 4:
        assert got


def test_thresholds_decide_nothing(spark, monkeypatch):
    rows = made_up(7, 300, 12, [0, 1, 2])
    want = brute(rows, lambda i: i % 20 == 0)
    for aim, sample, rounds in ((0.01, 8, 2), (500.0, 300, 1)):
        monkeypatch.setattr(hn, "_AIM", aim)
        monkeypatch.setattr(hn, "SAMPLE", sample)
        monkeypatch.setattr(hn, "ROUNDS", rounds)
        assert mined(spark, rows, 20) == want


def test_index_leaves_out_dimensions_and_loses_no_pair():
    r = np.random.default_rng(3)
    x = np.floor(r.normal(0, 1, (200, 24)) * np.linspace(300, 5, 24)).astype(np.int64)
    q = x[:30].copy()
    order = np.argsort(-(x.astype(float) ** 2).sum(axis=0))
    true = x @ q.T
    for share in (0.02, 0.3, 0.8):
        t = np.quantile(true, 1 - share, axis=0)
        a = hn.Anchors(np.arange(30), np.arange(30), np.zeros(30), q, q[:, order].astype(float), hn._suffix_norms(q[:, order].astype(float)), order, t,
                       np.zeros((30, 1)), np.zeros((30, 1)), True, 5)
        index = hn.Index(x, order, float(t.min()), a.norms)
        i, j = index.candidates(a)
        pairs = set(zip(i.tolist(), j.tolist()))
        assert {(int(p), int(k)) for p, k in zip(*np.nonzero(true >= t))} <= pairs
        if share == 0.02:
            assert index.held.mean() < 1 and len(pairs) < 0.5 * true.size


def test_repeats_nulls_and_lengths(spark):
    rows = made_up(11, 60, 6, [0, 1])
    rows += [rows[0], rows[0], rows[5], rows[20], (None, 1, [1.0] * 6), (70, None, [1.0] * 6), (80, 1, None), (90, 1, [1.0, None] + [0.0] * 4), (100, 1, [float("nan")] * 6),
             (110, 1, [float("inf")] * 6), (120, 0, []), (130, 0, [2.0]), (140, 1, [0.0] * 6), (150, 1, [0.3] * 9)]
    assert mined(spark, rows, 10) == brute(rows, lambda i: i % 10 == 0)


def test_extra_columns_and_no_rows(spark):
    empty = hn.integer_vectors(table(spark, []).withColumn("x", F.lit(1)).withColumn("anchor", F.lit(True)))
    assert hn.mine_hard_negatives(empty, F.col("vec_id") == 0).collect() == []
    rows = made_up(5, 50, 4, [0, 1])
    v = hn.integer_vectors(table(spark, [(i, x, lab) for i, lab, x in rows]).withColumn("x", F.lit("z")).withColumn("key", F.lit(2)))
    assert sorted(tuple(r) for r in hn.mine_hard_negatives(v, F.col("vec_id") == 3).collect()) == brute(rows, lambda i: i == 3)
