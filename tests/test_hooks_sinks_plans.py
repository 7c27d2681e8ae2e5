import contextlib
import io
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as se
from evalspark.plans import catalog
from evalspark.operators import loglik
from evalspark.sinks import report
from evalspark.sources import metrics

def test_parse_generations_orders_by_index(spark):
    df = spark.createDataFrame([([([(1, "b"), (0, "a")],), ([],), (None,)],)],
                               "responses array<struct<choices: array<struct<index: int, text: string>>>>")
    assert loglik.parse_generations(df).first()["texts"] == ["a", "b"]


def test_report_writers(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    from evalspark.plans import catalog
    lb = catalog.leaderboard(spark, sf)
    out = str(tmp_path / "report")
    report.write_report(lb, out)
    back = spark.read.json(out)
    assert back.count() == lb.count() and "components" in back.columns
    rec = back.filter(F.col("model_id") == "src0").first()
    assert rec["run_id"] == "r0" and abs(sum(c["weight"] for c in rec["components"]) - 1.0) < 1e-3
    disp = report.leaderboard_display(lb).collect()
    assert [r["rank_cell"] for r in disp][:3] == ["1", "2", "3"]
    det = report.model_details(lb).filter(F.col("model_id") == "src20").first()
    assert sorted(det["missing"].split(", ")) == ["Coding", "MMLU"]


def test_task_results_writer(spark, tmp_path):
    doc = json.dumps({"results": {"mmlu_a": {"acc,none": 0.5}, "mmlu": {"acc,none": 0.4}}})
    parsed = metrics.parse_metrics(spark.createDataFrame([("r", "m", doc)], "run_id string, model_id string, json string"))
    out = str(tmp_path / "tasks")
    metrics.write_task_results(parsed, out)
    assert sorted(d for d in os.listdir(out) if d.startswith("task=")) == ["task=mmlu", "task=mmlu_a"]
    assert os.listdir(os.path.join(out, "task=mmlu"))[0].startswith("model_id=m")


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("stream,batch", [("stream_request_latency", "request_latency"),
                                          ("stream_leaderboard", "composite_leaderboard")])
def test_stream_equals_batch(spark, stream, batch):
    q = se.queries()
    a = sorted(tuple(r) for r in q[stream](spark, SF).select(*q[batch](spark, SF).columns).collect())
    b = sorted(tuple(r) for r in q[batch](spark, SF).collect())
    assert a == b


BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if not n.startswith("stream_")])
def test_plan_shape(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    plan = buf.getvalue()
    for b in BAD:
        assert b not in plan, f"{name}: {b}"


@pytest.mark.parametrize("tz", ["UTC", "America/New_York"])
def test_stream_latency_across_micro_batches(spark, tmp_path, tz):
    old_tz = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", tz)
    try:
        _latency_across_batches(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old_tz)


def _latency_across_batches(spark, tmp_path):
    import datetime as dt
    from evalspark.operators import latency
    from evalspark.streaming import jobs
    t0 = dt.datetime(2024, 1, 1)
    s = lambda x: t0 + dt.timedelta(seconds=x)
    schema = ("run_id string, model_id string, request_id string, t_start timestamp_ntz, ts timestamp_ntz, "
              "delta string, is_end boolean")
    batches = [
        [("r", "m", "a", t0, s(1), "x", False), ("r", "m", "b", t0, s(2), "", False)],
        [("r", "m", "a", t0, s(3), "y", False), ("r", "m", "a", t0, s(4), None, True),
         ("r", "m", "b", t0, s(5), "z", False)],
        [("r", "m", "a", t0, s(6), "late", False), ("r", "m", "b", t0, s(7), "w", False),
         ("r", "m", "c", t0, s(5000), "q", False)],
    ]
    land = tmp_path / "land"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(land / f"b{i}"))
    like = spark.createDataFrame([], schema)
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(str(land))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    jobs.run_to_end(jobs.stream_request_latency(stream, out, ck))
    got = {r["request_id"]: (r["n_tokens"], round(r["ttft_ms"], 3), round(r["tok_s"], 6))
           for r in jobs.finish_request_latency(spark, out).collect()}
    allrows = spark.createDataFrame([x for b in batches for x in b], schema)
    want = {r["request_id"]: (r["n_tokens"], round(r["ttft_ms"], 3), round(r["tok_s"], 6))
            for r in latency.request_latency(allrows).collect()}
    assert got == want and got["a"][0] == 2


def test_stream_leaderboard_across_micro_batches(spark, tmp_path):
    from evalspark.operators import accuracy, composite
    from evalspark.plans import catalog, fixtures as fx
    from evalspark.streaming import jobs
    labels = fx.table(spark, SF, "labels")
    land = tmp_path / "labels"
    for i in range(3):
        labels.filter(F.col("doc_id") % 3 == i).coalesce(1).write.parquet(str(land / f"part{i}"))
    stream = spark.readStream.schema(labels.schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(str(land))
    docs = fx.table(spark, SF, "documents").select("doc_id", "source", "lang")
    items = stream.join(docs, "doc_id").select(
        fx.run_of(F.col("source")), F.col("source").alias("model_id"), F.col("lang").alias("subject"), "doc_id",
        F.when(F.col("quality") == 1, 1.0).otherwise(0.0).alias("correct"))
    models, coding, ppl = fx.models(spark, SF), catalog.coding_stage(spark, SF), fx.ppl_model_summary(spark, SF)

    def rebuild(acc_stage):
        return composite.composite_leaderboard(models, catalog.FLAGSHIP_OPTIONS, acc_stage, coding, ppl) \
            .select("model_id", "rank", F.round("score", 6).alias("score"), F.round("score_ci_half", 6).alias("ci"))

    out = str(tmp_path / "out")
    jobs.run_to_end(jobs.stream_leaderboard(items, rebuild, out, str(tmp_path / "ck")))
    got = sorted(tuple(r) for r in jobs.newest_leaderboard(spark, out).collect())
    batch = rebuild(accuracy.group_accuracy(fx.item_results(spark, SF)))
    assert got == sorted(tuple(r) for r in batch.collect())


def test_file_stream_reads_a_table_of_one_file_or_of_parts(spark, tmp_path):
    from evalspark.streaming import jobs
    rows = spark.range(20).withColumnRenamed("id", "doc_id")
    rows.repartition(3).write.parquet(str(tmp_path / "parts" / "labels.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    part = next((tmp_path / "one").glob("part-*.parquet"))
    (tmp_path / "single").mkdir()
    part.rename(tmp_path / "single" / "labels.parquet")
    for kind in ("parts", "single"):
        stream = jobs.file_stream(spark, str(tmp_path / kind / "labels.parquet"), rows)
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"ck-{kind}")) \
            .trigger(availableNow=True).start(str(tmp_path / f"out-{kind}"))
        jobs.run_to_end(query)
        assert sorted(r["doc_id"] for r in spark.read.schema(rows.schema).parquet(str(tmp_path / f"out-{kind}")).collect()) == list(range(20))


def test_stream_latency_late_chunk_and_restart(spark, tmp_path):
    """Three landings, each read by a restarted stream under another shuffle width: a request that goes on
    after a restart keeps its tokens, and a chunk for a request whose state has gone is dropped and counted."""
    import datetime as dt
    from evalspark.streaming import jobs
    day = lambda d, sec=0: dt.datetime(2024, 1, 1 + d) + dt.timedelta(seconds=sec)
    schema = ("run_id string, model_id string, request_id string, t_start timestamp_ntz, ts timestamp_ntz, "
              "delta string, is_end boolean, malformed boolean")
    landings = [
        [("r", "m", "a", day(0), day(0, 1), "x", False, False), ("r", "m", "b", day(0), day(0, 2), "x", False, False)],
        [("r", "m", "a", day(0), day(0, 3), "y", False, False), ("r", "m", "a", day(0), day(0, 4), None, False, True),
         ("r", "m", "c", day(9), day(9, 1), "x", False, False)],
        [("r", "m", "c", day(9), day(9, 2), "y", False, False)],
        [("r", "m", "a", day(0), day(0, 5), "late", False, False), ("r", "m", "c", day(9), day(9, 3), "z", False, False)],
    ]
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    width = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for k, rows in enumerate(landings):
            spark.conf.set("spark.sql.shuffle.partitions", str(2 + k))
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"land/p{k}"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "land/p*"))
            jobs.run_to_end(jobs.stream_request_latency(stream, out, ck))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    got = {r["request_id"]: (r["n_tokens"], r["n_malformed"]) for r in jobs.finish_request_latency(spark, out).collect()}
    assert got == {"a": (2, 1), "b": (1, 0), "c": (3, 0)}


def test_line_counts_outlast_restarts(spark, tmp_path):
    """Late, malformed and broken records over three landings, each read by restarted streams."""
    import json
    from evalspark.operators import latency
    from evalspark.streaming import jobs

    def record(request, day, sec, line):
        return json.dumps({"run_id": "r", "model_id": "m", "request_id": request, "t_start": f"2024-01-{day:02d}T00:00:00.000000",
                           "ts": f"2024-01-{day:02d}T00:00:{sec:02d}.000000", "line": line})

    text = 'data: {"choices": [{"text": "x"}]}'
    landings = [[record("a", 9, 1, text), record("a", 9, 2, "data: {bad"), record("a", 9, 3, ": ping"), "no record"],
                [record("b", 8, 1, text), record("c", 2, 1, text), record("c", 2, 2, "data: [DONE]")],
                [record("a", 9, 4, text), record("a", 9, 2, text), record("d", 9, 1, 'data: {"choices": []}'), '{"run_id": 7']]
    out, counts = str(tmp_path / "out"), str(tmp_path / "counts")
    for k, lines in enumerate(landings):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / f"land/p{k}"))
        rows = jobs.landed_lines(jobs.text_stream(spark, str(tmp_path / "land/p*")))
        jobs.run_to_end(jobs.stream_request_latency(latency.parse_stream_lines(rows), out, str(tmp_path / "ck"), lateness="3 days"))
        jobs.run_to_end(jobs.stream_line_counts(rows, counts, str(tmp_path / "ck2")))
    got = {r["model_id"]: tuple(r)[2:] for r in jobs.line_counts(spark, counts, out).collect()}
    # run and model of the last broken record cannot be told: its run is no text and the line is missing
    broken = {k: v for k, v in got.items() if k != "m"}
    assert got["m"] == (9, 2, 2, 4) and sum(v[0] for v in broken.values()) == 2 and sum(v[1] for v in broken.values()) == 2
    per = {r["request_id"]: r["n_tokens"] for r in jobs.finish_request_latency(spark, out).collect()}
    assert per == {"a": 3, "b": 1}


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 1, 0], [1, 2, 0]])
def test_progress_does_not_depend_on_batching(spark, tmp_path, order):
    """Files of runs years apart, some landing twice: in any order the stream counts what the batch counts."""
    from evalspark.operators import outcomes
    from evalspark.streaming import jobs
    schema = "run string, language string, exercise string"
    old, new = "2018-01-01-00-00-00--m", "2024-01-01-00-00-00--m"
    landings = [[(old, "python", "ex1"), (old, "python", "ex2")], [(new, "python", "ex1"), (new, "typescript", "ex1")],
                [(new, "python", "ex2"), (old, "python", "ex2"), (old, "go", "ex9")]]
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for k, i in enumerate(order):
        spark.createDataFrame(landings[i], schema).coalesce(1).write.parquet(str(tmp_path / f"land/p{k}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "land/p*"))
        jobs.run_to_end(jobs.land_progress(stream, out, ck))
    got = sorted(tuple(r) for r in jobs.landed_progress(spark, out).collect())
    files = spark.createDataFrame([x for b in landings for x in b], schema).distinct()
    assert got == sorted(tuple(r) for r in outcomes.count_done(files).collect())
    assert sum(n for _, lang, n in got if lang in ("python", "typescript")) == 5


def test_progress_and_heartbeat_rows(spark, tmp_path):
    """A row for every growth of a count, a heartbeat after a quiet time; a file that lands again changes nothing."""
    import time
    from evalspark.streaming import jobs
    schema = "run string, language string, exercise string"
    land = lambda k, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"land/p{k}"))
    land(0, [("r", "python", "a"), ("r", "python", "b"), ("s", "go", "a")])
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "land/p*"))
    out = str(tmp_path / "out")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        query = jobs.stream_progress(stream, out, str(tmp_path / "ck"), interval_s=0.3)
        told = lambda: [tuple(r) for r in spark.read.parquet(out).orderBy("at_ms").select("run", "kind", "done").collect()]
        def first_beat():
            return query.lastProgress is not None and {x for x in told() if x[1] == "heartbeat"} >= {("r", "heartbeat", 2), ("s", "heartbeat", 1)}
        end = time.monotonic() + 120
        while not first_beat() and time.monotonic() < end:
            time.sleep(0.3)
        land(1, [("r", "python", "b"), ("r", "python", "c")])
        jobs.run_until(query, lambda: ("r", "heartbeat", 3) in told(), 120)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    rows = told()
    assert [x for x in rows if x[1] == "progress" and x[0] == "r"] == [("r", "progress", 2), ("r", "progress", 3)]
    assert [x for x in rows if x[1] == "progress" and x[0] == "s"] == [("s", "progress", 1)]
