"""Structured Streaming jobs (ST1, ST2, ST3).

Sinks lie under the shared checkpoint folder (the session's ``spark.checkpoint.dir``). What only grows is
appended by Spark's own file sink and counted when it is read. Changed rows of keyed state are written per
micro-batch with their batch id; a re-run batch replaces its rows. Nothing is collected to the driver,
and a restarted query resumes from its checkpoint.
"""

from __future__ import annotations

import time
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from evalspark.functions import stats
from evalspark.operators import latency
from evalspark.session import checkpoint_dir

# A request is open until requests that start so much later have been seen.
LATENESS = "1 day"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming job (checkpoint + output) in the shared checkpoint dir."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def _batch_dir(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch_id={batch_id}"


def _upsert_sink(out_path: str):
    """Each micro-batch overwrites its own folder: a re-run batch (after executor loss) replaces,
    never duplicates, its rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_dir(out_path, batch_id))
    return write


def _publish(rows: DataFrame, out_path: str, batch_id: int) -> None:
    """Write a whole table under its batch id, and then a mark that it is complete."""
    rows.write.mode("overwrite").parquet(_batch_dir(f"{out_path}/rows", batch_id))
    mark = rows.sparkSession.range(1).select(F.lit(batch_id).cast("bigint").alias("complete"))
    mark.write.mode("overwrite").parquet(_batch_dir(f"{out_path}/done", batch_id))


def newest_batch(spark: SparkSession, out_path: str) -> DataFrame:
    """The table of the newest batch that is complete; no other batch is read."""
    newest = spark.read.schema("complete bigint").parquet(f"{out_path}/done").agg(F.max("complete").alias("n")).first()["n"]
    return spark.read.parquet(_batch_dir(f"{out_path}/rows", newest))


def run_to_end(query) -> None:
    """Block until an ``availableNow`` query has consumed all input, then surface any failure."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _start(writer, checkpoint: str, available_now: bool, interval: str = "30 seconds"):
    w = writer.option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()


# ---- ST1: per-request latency while chunks arrive --------------------------------------------

REQUEST_KEYS = ["run_id", "model_id", "request_id"]

# A landed record of one stream line; times are local and have microseconds.
LANDED_LINE = "run_id string, model_id string, request_id string, t_start timestamp_ntz, ts timestamp_ntz, line string"
LANDED_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the text lines of files that land below ``path``."""
    return spark.readStream.text(path)


def landed_lines(texts: DataFrame, value: str = "value") -> DataFrame:
    """Stream lines from landed JSON records (batch or stream); a text that is no such record has only nulls."""
    return texts.select(F.from_json(F.col(value), LANDED_LINE, LANDED_TIMES).alias("_r")).select("_r.*")


def stream_request_latency(chunks_stream: DataFrame, out_path: str, checkpoint: str,
                           available_now: bool = True, lateness: str = LATENESS):
    """ST1: tokens, end markers and malformed lines per (request, time), updated per micro-batch.

    The state is one small row per request and time. Which tokens lie behind the first end marker is
    decided when the rows are read, so chunks may arrive in any order. The watermark is on the request's
    start: a request stays open until starts are ``lateness`` ahead of it; a chunk that still comes is late,
    it is dropped and never opens the request anew (``line_counts`` tells how many).
    """
    token = ~F.col("is_end") & F.col("delta").isNotNull() & (F.length("delta") > 0)
    malformed = F.count_if("malformed") if "malformed" in chunks_stream.columns else F.lit(0).cast("bigint")
    # watermarks need an instant type; chunk times are local (NTZ) and read as session-zone instants
    state = (chunks_stream.withColumn("started", F.col("t_start").cast("timestamp")).withWatermark("started", lateness)
             .groupBy(*REQUEST_KEYS, "started", "ts")
             .agg(F.min("t_start").alias("t_start"), F.count_if(token).alias("n_tokens"), F.count_if("is_end").alias("n_ends"),
                  malformed.alias("n_malformed"), F.count("*").alias("n_chunks")))
    return _start(state.writeStream.outputMode("update").foreachBatch(_upsert_sink(out_path)), checkpoint, available_now)


def _request_times(spark: SparkSession, out_path: str) -> DataFrame:
    """State of ST1: counts of a (request, time) only grow, so their largest are the newest."""
    counts = ["n_tokens", "n_ends", "n_malformed", "n_chunks"]
    rows = spark.read.parquet(out_path)
    return rows.groupBy(*REQUEST_KEYS, "ts").agg(F.min("t_start").alias("t_start"), *[F.max(c).alias(c) for c in counts])


def finish_request_latency(spark: SparkSession, out_path: str) -> DataFrame:
    """Per-request table from the ST1 sink (same columns as the batch ``request_latency``)."""
    state = _request_times(spark, out_path)
    ends = state.where("n_ends > 0").groupBy(*REQUEST_KEYS).agg(F.min("ts").alias("end_marker"))
    live = (F.col("end_marker").isNull() | (F.col("ts") <= F.col("end_marker"))) & (F.col("n_tokens") > 0)
    s = state.join(ends, REQUEST_KEYS, "left").groupBy(*REQUEST_KEYS).agg(
        F.min("t_start").alias("t_start"), F.min(F.when(live, F.col("ts"))).alias("t_first"),
        F.coalesce(F.min("end_marker"), F.max("ts")).alias("t_end"), F.coalesce(F.sum(F.when(live, F.col("n_tokens"))), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.min("end_marker").isNotNull().alias("ended"), F.sum("n_malformed").cast("bigint").alias("n_malformed"))
    s = s.filter(F.col("n_tokens") > 0)
    return (s.withColumn("ttft_ms", stats.seconds_between("t_start", "t_first") * F.lit(1000.0))
            .withColumn("tok_s", stats.tok_rate(F.col("n_tokens"), stats.seconds_between("t_first", "t_end"))))


def stream_line_counts(lines_stream: DataFrame, out_path: str, checkpoint: str, available_now: bool = True):
    """Lines, chunk lines and malformed lines per model of all that has landed, late or not.

    A streaming aggregate with one state row per model; every micro-batch writes all of them. Landed
    texts that are no record count under a null run and model.
    """
    line = F.coalesce(F.col("line"), F.lit(""))
    parsed = lines_stream.select("run_id", "model_id", line.alias("line"), F.col("line").isNull().alias("broken"))
    chunk = parsed["line"].startswith(latency.DATA_PREFIX)
    counts = parsed.groupBy("run_id", "model_id").agg(
        F.count("*").alias("n_lines"), F.count_if(chunk).alias("n_chunks"), F.count_if(F.col("broken") | (chunk & latency.is_malformed(F.col("line")))).alias("n_malformed"))
    publish = lambda batch, batch_id: _publish(batch, out_path, batch_id)
    return _start(counts.writeStream.outputMode("complete").foreachBatch(publish), checkpoint, available_now)


def line_counts(spark: SparkSession, counts_path: str, latency_path: str) -> DataFrame:
    """run_id, model_id, n_lines, n_malformed, n_late, n_tokens from the sinks of ``stream_line_counts`` and ST1.

    Late chunks are those that landed but are in no request. Both counts come from the sinks, so they
    outlast restarts and any number of batches; both streams must have read the same landings.
    """
    counted = newest_batch(spark, counts_path)
    kept = _request_times(spark, latency_path).groupBy("run_id", "model_id").agg(F.sum("n_chunks").alias("_kept"), F.sum("n_tokens").alias("n_tokens"))
    same = [counted[k].eqNullSafe(kept[k]) for k in ("run_id", "model_id")]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return counted.join(kept, same, "left").select(
        counted["run_id"], counted["model_id"], "n_lines", "n_malformed", (F.col("n_chunks") - zero("_kept")).alias("n_late"), zero("n_tokens").alias("n_tokens"))


# ---- ST2: progress of landed result files ------------------------------------------------------

FILE_KEYS = ["run", "language", "exercise"]


def land_progress(files_stream: DataFrame, out_path: str, checkpoint: str, available_now: bool = True):
    """ST2: append the key of every landed result file to a Parquet table (Spark's file sink, exactly once).

    There is no state and nothing expires: in whatever order and in however many batches files land,
    ``landed_progress`` counts the same.
    """
    keys = files_stream.select(*FILE_KEYS).writeStream.format("parquet").option("path", out_path).outputMode("append")
    return _start(keys, checkpoint, available_now)


def landed_progress(spark: SparkSession, out_path: str, totals: DataFrame | None = None) -> DataFrame:
    """run, language, done (result files, each counted once) and with ``totals`` (language, total) the expected number."""
    done = spark.read.parquet(out_path).distinct().groupBy("run", "language").agg(F.count("*").alias("done"))
    return done if totals is None else done.join(totals, "language", "left").select("run", "language", "done", "total")


class _Heartbeat(StatefulProcessor):
    """Per (run, language): a row when its count grows, and one when it has been quiet for ``quiet_ms``."""

    COLUMNS = ["run", "language", "kind", "done", "at_ms"]

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "n long")

    def _row(self, key, kind, n, now):
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now + self.quiet_ms)
        return pd.DataFrame([(*key, kind, n, now)], columns=self.COLUMNS)

    def handleInputRows(self, key, rows, timerValues):
        n = (self.done.get()[0] if self.done.exists() else 0) + sum(len(x) for x in rows)
        self.done.update((n,))
        yield self._row(key, "progress", n, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._row(key, "heartbeat", self.done.get()[0], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def stream_progress(files_stream: DataFrame, out_path: str, checkpoint: str, interval_s: float = 30.0, quiet_intervals: int = 3):
    """ST2: a row (run, language, kind, done, at_ms) when a count has changed, and a heartbeat when it has not
    for ``quiet_intervals`` intervals.

    Files are told apart by streaming de-duplication on their whole key, spread over all tasks; its state is
    one entry per file and never expires, so it needs the RocksDB state store, which this sets for the session. Counts and
    timers are kept per (run, language) by a stateful processor. Rows are appended to a Parquet table. The query
    runs until it is stopped, since a heartbeat may always follow.
    """
    files_stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    files = files_stream.select(*FILE_KEYS).dropDuplicates(FILE_KEYS)
    rows = files.groupBy("run", "language").transformWithStateInPandas(
        _Heartbeat(int(1000 * interval_s * quiet_intervals)), "run string, language string, kind string, done long, at_ms long", "Append", "ProcessingTime")
    w = rows.writeStream.format("parquet").option("path", out_path).outputMode("append")
    return _start(w, checkpoint, False, f"{int(1000 * interval_s)} milliseconds")


def run_until(query, reached, timeout_s: float = 300.0, every_s: float = 0.5) -> None:
    """Let a running query go on until ``reached()`` holds, then stop it; a failure of the query is raised."""
    end = time.monotonic() + timeout_s
    try:
        while not reached():
            if query.exception() is not None:
                raise query.exception()
            if time.monotonic() > end:
                raise TimeoutError("the stream did not get there in time")
            time.sleep(every_s)
    finally:
        query.stop()


# ---- ST3: leaderboard recomputed as stage rows land --------------------------------------------

def accuracy_from_sums(stage: DataFrame) -> DataFrame:
    """Accuracy stage columns from the running (n, mean, sample variance) per model."""
    n = F.col("n").cast("double")
    return stage.select(
        "run_id", "model_id", F.col("mean").alias("acc_score"),
        F.when(F.col("n") > 1, F.sqrt(F.col("var")) / F.sqrt(n)).alias("acc_stderr"),
        F.col("n").cast("bigint").alias("n_samples"))


def stream_leaderboard(items_stream: DataFrame, rebuild, out_path: str, checkpoint: str,
                       available_now: bool = True):
    """ST3: keep per-model running moments of landed item rows, rebuild the leaderboard per batch.

    A streaming aggregation holds count, mean and variance per (run, model) — one state row per
    model — and hands all of them to every micro-batch (complete mode), which runs
    ``rebuild(accuracy_stage)`` and writes the leaderboard under its batch id (ranks and lead/lag are not
    streaming operations). Neither items nor earlier batches are read again.
    """
    x = F.col("correct").cast("double")
    sums = items_stream.groupBy("run_id", "model_id").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"))

    def step(batch: DataFrame, batch_id: int) -> None:
        # the batch reads the state: it is run once, and its few rows are read back
        _publish(batch, f"{out_path}/sums", batch_id)
        now = batch.sparkSession.read.schema(batch.schema).parquet(_batch_dir(f"{out_path}/sums/rows", batch_id))
        _publish(rebuild(accuracy_from_sums(now)), out_path, batch_id)

    return _start(sums.writeStream.outputMode("complete").foreachBatch(step), checkpoint, available_now)


def newest_leaderboard(spark: SparkSession, out_path: str) -> DataFrame:
    """The leaderboard of the newest batch of ST3 that is written out."""
    return newest_batch(spark, out_path)


def file_stream(spark: SparkSession, path: str, like: DataFrame, max_files: int | None = None) -> DataFrame:
    """A Parquet file stream with the schema of ``like`` (no inference).

    ``path`` is a landing folder, or a table ``<name>.parquet``, which may be a single file or a folder of part files.
    """
    r = spark.readStream.schema(like.schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    # a stream takes no plain path of a file, but a pattern that fits it, and a folder as well
    return r.parquet(f"{path[:-1]}[{path[-1]}]" if path.endswith(".parquet") else path)
