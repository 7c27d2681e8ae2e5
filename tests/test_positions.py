"""Positions and running totals against plain Python; groups that span several tasks."""
import random

from pyspark.sql import functions as F

from evalspark.operators.positions import running_totals, with_positions


def test_running_totals(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "a", "a", None, "b"]), i, r.randrange(0, 9) if i % 7 else None) for i in range(700)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    out = running_totals(df, [F.col("i").desc()], F.col("v"), "t", ["k"])
    assert out.columns == ["k", "i", "v", "t"]
    for k, i, v, t in out.collect():
        assert t == sum(x or 0 for kk, ii, x in rows if kk == k and ii > i)


def test_one_group_over_several_tasks(spark):
    df = spark.range(4000).withColumn("k", F.lit("one"))
    out = with_positions(df, [F.col("id")], "at", ["k"])
    assert out.where("at <> id").count() == 0 and out.count() == 4000
    assert "Window" not in out._jdf.queryExecution().toString()


def test_all_rows_and_none(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "s string")
    assert sorted((r["s"] or "~", r["at"]) for r in with_positions(df, [F.col("s").asc_nulls_last()], "at").collect()) == [("x", 0), ("y", 1), ("~", 2)]
    assert with_positions(df.limit(0), [F.col("s")], "at").collect() == []
