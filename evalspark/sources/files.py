"""Readers for landed result files, tool logs, response streams and texts.

Layout of coding results (landing convention, SURVEY T1 — Spark skips hidden
``.``/``_`` files, so records are named ``results.json``)::

    <root>/<YYYY-MM-DD-HH-MM-SS>--<model>/<language>/exercises/practice/<exercise>/results.json
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.arrays import outcome_as_bool
from evalspark.operators.latency import parse_stream_lines

RESULT_NAME = "results.json"
# Fixed value: path pattern of a result file (run, language, exercise).
RESULT_PATH = r"([^/]+)/([^/]+)/exercises/practice/([^/]+)/[^/]+$"


#: Tasks of a listing of folders; unless it is set, every folder is a task of its own.
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listing_many(spark: SparkSession) -> Iterator[None]:
    """Folders of readers made within are listed by as many tasks as the session shuffles to, many folders each."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


def language_list(languages: str | list[str] | None) -> list[str]:
    """Comma list, entries stripped, duplicates removed (first wins); empty = all."""
    if languages is None:
        return []
    items = languages.split(",") if isinstance(languages, str) else list(languages)
    out: list[str] = []
    for x in (i.strip() for i in items):
        if x and x not in out:
            out.append(x)
    return out


def _result_glob(root: str, languages: list[str], name: str) -> str:
    if name.startswith(".") or name.startswith("_"):
        raise ValueError(f"{name!r}: Spark skips hidden files; land records as {RESULT_NAME!r}")
    lang = "*" if not languages else ("{" + ",".join(languages) + "}" if len(languages) > 1 else languages[0])
    return f"{root.rstrip('/')}/*/{lang}/exercises/practice/*/{name}"


def parse_exercise_records(raw: DataFrame, value: str = "value") -> DataFrame:
    """S1 parser + F6 + T3 over texts of one record each: ``raw`` with tests_outcomes array<boolean>,
    prompt_tokens, completion_tokens and reject, which is ``unreadable`` (no JSON object), ``empty`` or NULL.

    Outcomes follow JSON truthiness by type (``1`` is a pass, ``"false"`` too).
    """
    keys = F.json_object_keys(F.col(value))
    doc = F.try_parse_json(F.col(value))
    listed = F.coalesce(F.try_variant_get(doc, "$.tests_outcomes", "array<variant>"), F.array().cast("array<variant>"))
    reject = F.when(keys.isNull(), F.lit("unreadable")).when(F.size(keys) == 0, F.lit("empty"))
    return (raw.withColumn("reject", reject)
            .withColumn("tests_outcomes", F.when(F.col("reject").isNull(), F.transform(listed, outcome_as_bool)))
            .withColumn("prompt_tokens", F.try_variant_get(doc, "$.prompt_tokens", "bigint"))
            .withColumn("completion_tokens", F.try_variant_get(doc, "$.completion_tokens", "bigint")))


def exercise_results(raw: DataFrame) -> DataFrame:
    """One record per finished exercise from raw result files (run, language, exercise, path, value).

    Unreadable JSON and empty records are dropped (``exercise_rejects`` has them).
    """
    rec = parse_exercise_records(raw).filter(F.col("reject").isNull())
    return rec.select("run", "language", "exercise", "path", "tests_outcomes", "prompt_tokens", "completion_tokens")


def exercise_rejects(raw: DataFrame) -> DataFrame:
    """F6 quarantine: files that are not readable JSON or are empty records."""
    rejects = parse_exercise_records(raw).filter(F.col("reject").isNotNull())
    return rejects.select("run", "language", "exercise", "path", F.col("reject").alias("reason"))


def read_exercise_results(spark: SparkSession, root: str, languages=None, name: str = RESULT_NAME) -> DataFrame:
    """S1 from a result tree: one record per finished exercise, tagged from its path."""
    return exercise_results(_read_raw(spark, root, languages, name))


def read_exercise_rejects(spark: SparkSession, root: str, languages=None, name: str = RESULT_NAME) -> DataFrame:
    """F6 from a result tree."""
    return exercise_rejects(_read_raw(spark, root, languages, name))


def _read_raw(spark, root, languages, name) -> DataFrame:
    langs = language_list(languages)
    with listing_many(spark):
        df = spark.read.text(_result_glob(root, langs, name), wholetext=True)
    path = F.col("_metadata.file_path")
    return df.select(
        path.alias("path"),
        F.regexp_extract(path, RESULT_PATH, 1).alias("run"),
        F.regexp_extract(path, RESULT_PATH, 2).alias("language"),
        F.regexp_extract(path, RESULT_PATH, 3).alias("exercise"),
        "value")


# Folders of a partitioned landing, from the root down.
LANDED_KEYS = ["run", "language", "exercise"]


def spread_files(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as the session shuffles to. A number is named since rows that become a file
    each are few bytes and would be put together in one task, which then makes all the files one after the other."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def land_exercise_results(results: DataFrame, root: str) -> None:
    """Land result texts (run, language, exercise, value), one folder ``run=…/language=…/exercise=…`` each; landing
    an exercise again replaces its file."""
    (spread_files(results.select(*LANDED_KEYS, "value"), *LANDED_KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*LANDED_KEYS).text(root))


def landed_results(spark: SparkSession, root: str, languages=None) -> DataFrame:
    """S1/S2/F3/U1 input from a partitioned landing: run, language, exercise, path, value of every result file.

    The languages prune folders: files of others are neither opened nor listed as tasks. Files of zero bytes
    have no row.
    """
    with listing_many(spark):
        df = spark.read.schema("value string, " + ", ".join(f"{k} string" for k in LANDED_KEYS)).text(root, wholetext=True)
    wanted = language_list(languages)
    if wanted:
        df = df.filter(F.col("language").isin(wanted))
    return df.select(*LANDED_KEYS, F.col("_metadata.file_path").alias("path"), "value")


def ingest_results(raw: DataFrame, out: str) -> None:
    """S1 + F6 in one pass: parsed records to ``out/kind=records`` and quarantined files, with reason and text, to
    ``out/kind=rejects``; ingesting again replaces both."""
    parsed = parse_exercise_records(raw)
    kind = F.when(F.col("reject").isNull(), F.lit("records")).otherwise(F.lit("rejects"))
    text = F.when(F.col("reject").isNotNull(), F.col("value")).alias("value")
    parsed.select(*LANDED_KEYS, "path", "tests_outcomes", "prompt_tokens", "completion_tokens", F.col("reject").alias("reason"), text, kind.alias("kind")).write.mode(
        "overwrite").partitionBy("kind").parquet(out)


def ingested(spark: SparkSession, out: str, kind: str) -> DataFrame:
    """The ``records`` or ``rejects`` of ``ingest_results``; the other folder is not read."""
    keys = ", ".join(f"{k} string" for k in LANDED_KEYS)
    schema = f"{keys}, path string, tests_outcomes array<boolean>, prompt_tokens bigint, completion_tokens bigint, reason string, value string, kind string"
    df = spark.read.schema(schema).parquet(out).filter(F.col("kind") == kind).drop("kind")
    return df.drop("reason", "value") if kind == "records" else df.select(*LANDED_KEYS, "path", "reason", "value")


def list_result_files(spark: SparkSession, root: str, languages=None, name: str = RESULT_NAME) -> DataFrame:
    """S2 input: result files present (``binaryFile`` with only the path selected: contents are not read)."""
    langs = language_list(languages)
    df = spark.read.format("binaryFile").load(_result_glob(root, langs, name)).select("path", "modificationTime")
    return df.select(
        "path", F.regexp_extract("path", RESULT_PATH, 1).alias("run"),
        F.regexp_extract("path", RESULT_PATH, 2).alias("language"),
        F.regexp_extract("path", RESULT_PATH, 3).alias("exercise"),
        F.col("modificationTime").alias("mtime"))


def read_ppl_logs(spark: SparkSession, glob: str) -> DataFrame:
    """Whole log text per file (stdout then stderr concatenated by the landing job)."""
    with listing_many(spark):
        df = spark.read.text(glob, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("log"))


def read_chunks(spark: SparkSession, glob: str) -> DataFrame:
    """S6 (batch): JSON-lines landing of stream lines ``{run_id, model_id, request_id, t_start, ts, line}``."""
    schema = ("run_id string, model_id string, request_id string, t_start timestamp_ntz, ts timestamp_ntz, "
              "line string")
    return parse_stream_lines(spark.read.schema(schema).json(glob))


RESPONSE_SCHEMA = ("struct<choices: array<struct<logprobs: struct<content: array<struct<id: bigint, "
                   "token: string, logprob: double, top_logprobs: array<struct<id: bigint, token: string, "
                   "logprob: double>>>>>>>>")


def token_response(json_col) -> "F.Column":
    """The first ``logprobs.content`` entry of the first choice as a D10 struct (NULL when absent)."""
    r = F.from_json(json_col, RESPONSE_SCHEMA)
    return F.get(F.get(r["choices"], 0)["logprobs"]["content"], 0)


#: The byte at which reference texts are cut into rows; white space, so that no word is cut.
CUT = " "
_BAD, _ASIDE = "\ufffd", "\U0010fffe"


def reference_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The reference corpus cut at spaces: path, file_size, n_bytes, n_chars and text of every piece.

    Files are read in byte ranges by as many tasks as they are long; no row is longer than the text between two
    spaces. Bytes that are no UTF-8 are dropped, as a lenient decoder does: the cut is an ASCII byte, so it
    is inside no character and borders need no repair. CR LF counts as one line break.
    """
    df = spark.read.option("lineSep", CUT).text(path)
    raw = F.col("value")
    # the text's own replacement characters stay: they step aside while bad bytes become such and go
    valid = F.make_valid_utf8(F.replace(raw, F.lit(_BAD), F.lit(_ASIDE)))
    good = F.replace(F.replace(valid, F.lit(_BAD), F.lit("")), F.lit(_ASIDE), F.lit(_BAD))
    text = F.replace(F.replace(good, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_size"), F.octet_length(raw).cast("bigint").alias("n_bytes"),
                     F.length(text).cast("bigint").alias("n_chars"), text.alias("text"))


def reference_counts(pieces: DataFrame) -> DataFrame:
    """S11 + P15: path, n_chars and the token estimate of every reference text, as a lenient decode of the whole gives.

    The spaces between pieces are what a file has besides its pieces; a byte order mark, which the reader
    skips, is a character of three bytes.
    """
    per = pieces.groupBy("path").agg(F.first("file_size").alias("_size"), F.sum("n_bytes").alias("_bytes"), F.sum("n_chars").alias("_chars"), F.count("*").alias("_rows"))
    besides = F.col("_size") - F.col("_bytes")
    mark = besides - (F.col("_rows") - 1) >= 3
    n_chars = F.col("_chars") + besides - F.when(mark, F.lit(2)).otherwise(F.lit(0))
    return per.select("path", n_chars.cast("bigint").alias("n_chars"), F.floor(n_chars / 4).cast("bigint").alias("est_tokens"))
