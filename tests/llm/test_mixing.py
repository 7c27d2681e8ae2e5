"""Mixing: targets against plain arithmetic, thresholds against a sort, takings near their targets."""
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from evalspark.llm import mixing

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, hold sources above their limit there, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in held]
        left, among = total - sum(held.values()), sum(w[s] for s in open_)
        t = {s: Fraction(left * w[s], among) for s in open_}
        over = [s for s in open_ if t[s] > most * sizes[s]]
        if not over:
            return {**held, **t}
        held.update({s: most * sizes[s] for s in over})


def corpus(spark, seed, n, sources):
    r = random.Random(seed)
    rows = [(i, r.choice(sources), " ".join(["w"] * min(400, int(r.paretovariate(0.9) * 5)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def check(docs, out, exact=None):
    rows = out.collect()
    sizes, taken, largest = Counter(), Counter(), defaultdict(int)
    for r in docs.collect():
        n = len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    want = brute_targets(sizes)
    assert len(rows) == docs.count()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - float(want[r["source"]])) < 1e-6 * max(1, r["target"])
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert sum(r["size"] for r in rows) == sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, largest[s] / 2), (s, taken[s], want[s])
    return {s: abs(taken[s] - float(want[s])) / max(1, sizes[s]) for s in sizes}


@pytest.mark.parametrize("sources", [["a"], ["a", "b", None], ["c", "c", "c", "c", "a", "b", "é", "Z", None]])
def test_targets_and_takings(spark, sources):
    docs = corpus(spark, len(sources), 900, sources)
    off = check(docs, mixing.mix(docs))
    assert max(off.values()) < 0.02


def test_reruns_and_partitionings_agree(spark):
    docs = corpus(spark, 9, 500, ["a", "b", "c", "d"])
    one = sorted(tuple(r) for r in mixing.mix(docs).collect())
    assert one == sorted(tuple(r) for r in mixing.mix(docs.repartition(7, "text")).collect())


def test_threshold_equals_sorting(spark):
    docs = corpus(spark, 4, 400, ["a", "b"])
    rows = docs.select("source", F.xxhash64(F.lit(1), "doc_id").alias("h"), mixing.words(F.col("text")).alias("size"))
    for share in (0.01, 0.3, 0.77, 0.999):
        size = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
        budget = {s: max(1, int(n * share)) for s, n in size.items()}
        b = spark.createDataFrame(list(budget.items()), "source string, budget long")
        got = {r["source"]: (r["cut"], r["rest"]) for r in mixing._cuts(rows, b).collect()}
        for s in size:
            left = budget[s]
            for h, n in sorted((r["h"] % (1 << 64), r["size"]) for r in rows.collect() if r["source"] == s):
                if n > left:
                    break
                left -= n
            assert (got[s][0] % (1 << 64), got[s][1]) == (h, left)


def test_equal_rows_are_taken_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_STEP", 7)
    rows = [(1, "a", "x y z")] * 300 + [(i, "b", prose(i, 40)) for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(docs)
    check(docs, out)
    copies = Counter(r["copies"] for r in out.where("source = 'a'").collect())
    assert sum(copies.values()) == 300


def test_one_large_document(spark):
    rows = [(1, "a", prose(1, 3000))] + [(i, "a", "u v") for i in range(2, 400)] + [(i, "b", prose(i, 30)) for i in range(400, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    check(docs, mixing.mix(docs))


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, mixing.mix(odd_docs))
    assert mixing.mix(no_docs).collect() == []
    assert [r["taken"] for r in mixing.mix(odd_docs.where("doc_id = 2")).collect()] == [0]
