"""Recipes that derive the evaluation input shapes from the given test tables.

The test tables (``/root/testdata/sf*/``) are TPC-H-like plus text tables; the
evaluation tables this library consumes are derived from them with Spark, so
every query's work grows with the data:

* item results   ``labels`` join ``documents``: model = source, subject = lang
* try outcomes   ``lineitem``: model = suppkey mod 20, exercise = partkey
* chunks         ``events``: request = (user, day), empty text for errors,
                 end marker at the first purchase
* PPL logs       ``events`` rendered as tool log lines
* tokens         lower-cased words of ``documents`` / ``benchmark``
* generations    ``conversations`` user turn -> next assistant turn
* registry       ``part`` grouped by brand

Each recipe has an SQL twin in ``plans/catalog.py`` for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.sizing import spread

N_RUNS = 2
N_MODELS = 20
#: A model with results in one stage only: the perplexity runs of all models together.
POOLED_MODEL = f"src{N_MODELS}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_of(key: Column) -> Column:
    """Numeric key -> model id ``src<k mod 20>``."""
    return F.concat(F.lit("src"), (key % N_MODELS).cast("string"))


def ordinal_of(model_id: Column) -> Column:
    """Input order of a model id ``src<k>``: k."""
    return F.regexp_extract(model_id, r"(\d+)$", 1).cast("int")


def run_of(model_id: Column) -> Column:
    """Run of a model: its number modulo N_RUNS, so that every run has models of its own."""
    return F.concat(F.lit("r"), (ordinal_of(model_id) % N_RUNS).cast("string")).alias("run_id")


# ---- accuracy -------------------------------------------------------------------------------

def item_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, model_id, subject, doc_id, correct (1.0 when quality = 1)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return (labels.join(docs, "doc_id", "inner")
            .select(run_of(F.col("source")), F.col("source").alias("model_id"), F.col("lang").alias("subject"),
                    "doc_id", F.when(F.col("quality") == 1, 1.0).otherwise(0.0).alias("correct")))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model rows of the run: every source of ``documents`` (``src<k>``, ordinal k), and the pooled
    model ``src20`` that exists in the perplexity stage only."""
    ids = table(spark, sf_dir, "documents").select(F.col("source").alias("model_id")).distinct()
    ids = ids.unionByName(spark.range(1).select(F.lit(POOLED_MODEL).alias("model_id")))
    return ids.select(run_of(F.col("model_id")), "model_id", ordinal_of(F.col("model_id")).alias("ordinal"))


# ---- coding ---------------------------------------------------------------------------------

# Fixed value: the try order of an exercise (l_orderkey, l_linenumber is not unique).
TRY_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]


def tries(spark: SparkSession, sf_dir: str, language: str | None = None) -> DataFrame:
    """One row per try: run_id, model_id, language, exercise, passed + the order columns.

    ``language=None`` gives one language (``python``); ``"linestatus"`` uses
    ``l_linestatus`` as a low-cardinality language tag.
    """
    li = spread(table(spark, sf_dir, "lineitem"))
    lang = F.col("l_linestatus") if language == "linestatus" else F.lit("python")
    return li.select(run_of(model_of(F.col("l_suppkey"))), model_of(F.col("l_suppkey")).alias("model_id"), lang.alias("language"),
                     F.col("l_partkey").cast("string").alias("exercise"),
                     (F.col("l_returnflag") == "R").alias("passed"), *TRY_ORDER)


def try_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every try: run_id, model_id, prompt_tokens, completion_tokens."""
    li = spread(table(spark, sf_dir, "lineitem"))
    return li.select(run_of(model_of(F.col("l_suppkey"))), model_of(F.col("l_suppkey")).alias("model_id"), F.col("l_quantity").cast("bigint").alias("prompt_tokens"),
                     F.floor(F.col("l_extendedprice") / 100).cast("bigint").alias("completion_tokens"))


def result_file_events(li: DataFrame) -> DataFrame:
    """One result-file event per try row: run, language, exercise, mtime (works on a stream)."""
    model = model_of(F.col("l_suppkey"))
    run = F.concat(F.date_format(F.col("l_shipdate"), "yyyy"), F.lit("-01-01-00-00-00--"), model)
    return li.select(run.alias("run"), F.col("l_linestatus").alias("language"),
                     F.col("l_partkey").cast("string").alias("exercise"), F.col("l_shipdate").alias("mtime"))


def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of result files: path, run, language, exercise, mtime.

    One run directory per (model, ship year): ``<year>-01-01-00-00-00--<model>``;
    mtime = last ship date of the run's tries.
    """
    li = spread(table(spark, sf_dir, "lineitem"))
    model = model_of(F.col("l_suppkey"))
    run = F.concat(F.date_format(F.col("l_shipdate"), "yyyy"), F.lit("-01-01-00-00-00--"), model)
    files = (li.select(run.alias("run"), F.col("l_linestatus").alias("language"),
                       F.col("l_partkey").cast("string").alias("exercise"), "l_shipdate")
             .groupBy("run", "language", "exercise").agg(F.max("l_shipdate").alias("mtime")))
    path = F.concat_ws("/", F.col("run"), F.col("language"), F.lit("exercises/practice"), F.col("exercise"),
                       F.lit("results.json"))
    return files.select(path.alias("path"), "run", "language", "exercise", "mtime")


def exercise_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog of exercises per language: the parts, tagged with both line statuses."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("exercise"))
    langs = F.array(F.lit("F"), F.lit("O"))
    return part.select(F.explode(langs).alias("language"), "exercise")


# ---- latency --------------------------------------------------------------------------------

def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, model_id, request_id, t_start, ts, delta, is_end from ``events``.

    request = (user, day), start = midnight; errors carry an empty text; a
    purchase is the end marker of its request.
    """
    return chunks_from_events(spread(table(spark, sf_dir, "events")))


def chunks_from_events(ev: DataFrame, *extra: str) -> DataFrame:
    """The chunk projection of ``events`` rows (works on a stream as well), with further columns of theirs."""
    day = F.to_date("ts")
    return ev.select(
        run_of(model_of(F.col("user_id"))), model_of(F.col("user_id")).alias("model_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format(day, "yyyy-MM-dd")).alias("request_id"),
        F.to_timestamp_ntz(F.date_format(day, "yyyy-MM-dd")).alias("t_start"),
        F.col("ts"),
        F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type")).alias("delta"),
        (F.col("event_type") == "purchase").alias("is_end"),
        *extra,
    )


def landed_line_texts(ev: DataFrame, clean: bool = True) -> DataFrame:
    """``events`` rows as landed JSON records (value) of one stream line each, for the requests of ``chunks_from_events``.

    ``clean``: an error is a line with an empty text. Otherwise an error is broken JSON, a click a comment line,
    and every 50th event lands as a text that is no record.
    """
    from evalspark.streaming.jobs import LANDED_TIMES
    kind = F.col("event_type")
    text = F.concat(F.lit('data: {"choices": [{"text": "'), F.when(kind == "error", F.lit("")).otherwise(kind), F.lit('"}]}'))
    line = F.when(kind == "purchase", F.lit("data: [DONE]"))
    if not clean:
        line = line.when(kind == "error", F.lit('data: {"choices": [')).when(kind == "click", F.lit(": ping"))
    record = F.to_json(F.struct("run_id", "model_id", "request_id", "t_start", "ts", "line"), LANDED_TIMES)
    rows = chunks_from_events(ev.withColumn("line", line.otherwise(text)), "line", "event_id")
    value = record if clean else F.when(F.col("event_id") % 50 == 0, F.lit('{"run_id": ')).otherwise(record)
    return rows.select(value.alias("value"))


# ---- perplexity -----------------------------------------------------------------------------

def ppl_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tool log per event: run_id, model_id, run_no, log.

    ``view`` rows print ``overall_ppl``, ``error`` rows print garbage, the rest a
    final estimate with its SE (numbers as decimal text, no exponent).
    """
    ev = spread(table(spark, sf_dir, "events"))
    ppl_txt = (F.lit(20.0) + F.col("value")).cast("decimal(12,4)").cast("string")
    se_txt = (F.col("value") / 100).cast("decimal(12,4)").cast("string")
    log = (F.when(F.col("event_type") == "error", F.concat(F.lit("main: error loading model\nfailed "),
                                                           F.col("props")))
           .when(F.col("event_type") == "view", F.concat(F.lit("llama_perf: overall_ppl = "), ppl_txt))
           .otherwise(F.concat(F.lit("[1]4.1,[2]5.2\r\nFinal estimate: PPL = "), ppl_txt, F.lit(" +/- "), se_txt)))
    return ev.select(run_of(model_of(F.col("user_id"))), model_of(F.col("user_id")).alias("model_id"),
                     F.col("event_id").alias("run_no"), log.alias("log"))


def ppl_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log per user of ``events`` (file, value): some lines of progress, then a result, or a failure for users
    whose number is divisible by 3; lines end in LF."""
    u = F.col("user_id")
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    lines = F.transform(F.sequence(F.lit(1), (u % 17 + 1).cast("int")), lambda i: F.concat(F.lit("[step "), i.cast("string"), F.lit("] 4."), i.cast("string")))
    last = F.when(u % 3 == 0, F.lit("failed to load the model")).otherwise(F.concat(F.lit("Final estimate: PPL = "), F.col("n").cast("string"), F.lit(".5 +/- 0.25")))
    return users.select(u.alias("file"), F.array_join(F.concat(lines, F.array(last)), "\n").alias("value"))


def ppl_model_summary(spark: SparkSession, sf_dir: str, run_lists: bool = False) -> DataFrame:
    """PPL stage of the flagship: one summary per model and one for the pooled model.

    Every run of a model is one event type (all but errors); a run's ppl is avg(20 + value), its se
    avg(value / 100). The model's ppl and se are the means of its runs, with their least and largest.
    """
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") != "error")
    ids = F.explode(F.array(model_of(F.col("user_id")), F.lit(POOLED_MODEL))).alias("model_id")
    runs = (ev.select(ids, "event_type", "value").groupBy("model_id", "event_type")
            .agg(F.avg(F.lit(20.0) + F.col("value")).alias("ppl"), F.avg(F.col("value") / 100).alias("ppl_se")))
    from evalspark.operators.perplexity import ppl_summary
    runs = runs.select(run_of(F.col("model_id")), "model_id", "event_type", "ppl", "ppl_se", F.lit(None).cast("string").alias("error"))
    return ppl_summary(runs, run_no="event_type" if run_lists else None)


# ---- tokens ---------------------------------------------------------------------------------

# Fixed value: the word splitter of the token recipes.
WORD_SPLIT = r"[ \n]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text (empty pieces removed)."""
    return F.filter(F.split(F.lower(text), WORD_SPLIT), lambda w: F.length(w) > 0)


def token_id(word: Column) -> Column:
    """Token id of a word: a 64-bit hash of its text (NULL word -> NULL id).

    Ids only have to be equal for equal texts within one engine; the SQL twin
    uses md5 digits instead.
    """
    return F.when(word.isNotNull(), F.xxhash64(word))


def blank_some_ids(tokens: DataFrame) -> DataFrame:
    """Token rows without an id for about one target word in sixteen: those are found by their text only."""
    return tokens.withColumn("target_id", F.when(F.substring(F.md5("target_text"), 1, 1) != "0", F.col("target_id")))


def word_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_id = source, word) per occurrence over the whole documents."""
    docs = spread(table(spark, sf_dir, "documents").select("source", "text"))
    return docs.select(F.col("source").alias("model_id"), F.explode(words(F.col("text"))).alias("word"))


def document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is one loglikelihood request of its source's model.

    request_id = doc_id, context = first word, continuation = the remaining words.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    w = words(F.col("text"))
    return docs.select(run_of(F.col("source")), F.col("source").alias("model_id"), F.col("doc_id").alias("request_id"),
                       F.col("doc_id"), F.lit(0).alias("choice_no"),
                       F.slice(w, 1, 1).alias("context"),
                       F.slice(w, 2, 1 << 30).alias("continuation"))


def id_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_requests`` as token ids, numbered by their doc_id."""
    ids = lambda c: F.transform(c, token_id).alias(f"{c}_ids")
    return document_requests(spark, sf_dir).select("run_id", "model_id", "request_id", F.col("doc_id").alias("request_no"), ids("context"), ids("continuation"))


def prompt_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generation request per user turn of ``conversations``: its words as ids, numbered within the conversation."""
    users = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    model = model_of(F.col("conv_id"))
    return users.select(run_of(model), model.alias("model_id"), F.concat_ws("-", "conv_id", "turn").alias("request_id"), "conv_id", F.col("turn").alias("request_no"),
                        words(F.col("text")).alias("prompt"), F.transform(words(F.col("text")), token_id).alias("prompt_ids"))


def benchmark_choice_requests(spark: SparkSession, sf_dir: str, models_df: DataFrame) -> DataFrame:
    """Four answer choices per benchmark item, scored by every model.

    item i: context = first half of its words; choice c = second half of item
    (i + c) mod N (N = number of items), c = 0..3; gold = 0.
    """
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    n_items = bench.select(F.count(F.lit(1))).scalar()
    w = words(F.col("text"))
    half = F.floor(F.size(w) / 2).cast("int")
    parts = bench.select("item_id", F.slice(w, 1, F.greatest(half, F.lit(0))).alias("head"),
                         F.slice(w, half + 1, 1 << 30).alias("tail"))
    heads = parts.select("item_id", "head")
    tails = parts.select(F.col("item_id").alias("src_item"), "tail")
    choices = heads.select("item_id", "head", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("choice_no"))
    choices = choices.withColumn("src_item", (F.col("item_id") + F.col("choice_no")) % n_items)
    req = choices.join(tails, "src_item", "inner")
    # every model scores every item: items enter every run and meet that run's models
    runs = F.explode(F.array(*[F.lit(f"r{i}") for i in range(N_RUNS)]))
    req = req.withColumn("run_id", runs).join(models_df.select("run_id", "model_id"), "run_id")
    return req.select("run_id", "model_id",
                      F.concat_ws("-", F.col("item_id").cast("string"), F.col("choice_no").cast("string"))
                      .alias("request_id"),
                      F.col("item_id").alias("doc_id"), "choice_no",
                      F.col("head").alias("context"), F.col("tail").alias("continuation"))


# ---- generations ----------------------------------------------------------------------------

def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt = user turn, generation = the next assistant turn, gold = first word of the prompt.

    Prompts without a following assistant turn keep a NULL generation (placeholder case).
    """
    conv = table(spark, sf_dir, "conversations")
    users = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    assistants = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("generated"))
    joined = users.join(assistants, ["conv_id", "turn"], "left")
    return joined.select(run_of(model_of(F.col("conv_id"))), model_of(F.col("conv_id")).alias("model_id"), "conv_id", "turn", "prompt",
                         "generated",
                         F.lower(F.split(F.trim(F.col("prompt")), " ").getItem(0)).alias("gold"))


def generative_metric_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric document per model of ``generations`` for the generative task: the share of answers whose first word
    is the gold one; every 7th model's value is text, which is no number."""
    g = generations(spark, sf_dir)
    hit = F.coalesce(F.lower(F.split("generated", " ").getItem(0)) == F.col("gold"), F.lit(False))
    per = g.groupBy("run_id", "model_id").agg(F.avg(hit.cast("double")).alias("x"), F.count("*").alias("n"))
    value = F.when(ordinal_of(F.col("model_id")) % 7 == 0, F.lit('"none"')).otherwise(F.col("x").cast("string"))
    return per.select("run_id", "model_id", F.concat(F.lit('{"results": {"mmlu_generative": {"exact_match,none": '), value, F.lit(', "sample_len": '),
                                                     F.col("n").cast("string"), F.lit('}}, "groups": {}}')).alias("json"))


def run_options_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One options row per user of ``events`` (runs), some out of range or unknown."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id")
    return users.select(
        F.concat(F.lit("u"), u.cast("string")).alias("run_id"),
        ((u % 13).cast("double") / 10.0).alias("weights_mmlu"),
        ((u % 7).cast("double") / 5.0).alias("weights_ppl"),
        F.when(u % 3 == 0, "mmlu").when(u % 3 == 1, "mmlu_generative").otherwise("mmlu_pro").alias("mmlu_task"),
        (u % 5 == 0).alias("skip_mmlu"),
        F.element_at(F.array(*[F.lit(x) for x in ("f16", "no-cache", "off", "q8")]),
                     (u % 4 + 1).cast("int")).alias("coding_kv_fix"))


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metadata rows per user of ``events``: options plus a duration from the event count."""
    ev = table(spark, sf_dir, "events")
    per = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    u = F.col("user_id")
    return per.select(
        F.concat(F.lit("u"), u.cast("string")).alias("run_id"), F.lit("bench-server").alias("binary"), F.concat(F.lit("b"), (u % 17).cast("string")).alias("version"),
        F.concat(F.lit("/runs/"), u.cast("string"), F.lit(".yaml")).alias("config"),
        F.when(u % 3 == 0, "mmlu").otherwise("mmlu_generative").alias("mmlu_task"),
        (u % 5 == 0).alias("skip_mmlu"), (u % 4 == 0).alias("skip_coding"), (u % 7 != 0).alias("ppl_available"),
        (u % 50).cast("int").alias("mmlu_limit"), F.when(u % 2 == 0, "python").otherwise("python,go").alias("languages"),
        (u % 30).cast("int").alias("coding_limit"), F.when(u % 3 == 1, "f16").otherwise("off").alias("coding_kv_fix"), (u % 3 + 1).cast("int").alias("coding_tries"),
        ((u % 7).cast("double") / 10.0).alias("weights_ppl"), F.lit("/texts/reference.txt").alias("ppl_reference"),
        (F.sqrt(F.col("_n").cast("double")) * 10.0).alias("duration_s"))


def generation_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11 responses per user turn: one response whose choices list the prompt (index 1) and the
    next assistant turn (index 0); a prompt without an answer gets a response without it."""
    conv = table(spark, sf_dir, "conversations")
    users = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    asst = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    j = users.join(asst, ["conv_id", "turn"], "left")
    choice = lambda i, t: F.struct(F.lit(i).alias("index"), t.alias("text"))
    choices = F.when(F.col("answer").isNotNull(), F.array(choice(1, F.col("prompt")), choice(0, F.col("answer")))) \
        .otherwise(F.array(choice(1, F.col("prompt"))))
    return j.select(run_of(model_of(F.col("conv_id"))), model_of(F.col("conv_id")).alias("model_id"), "conv_id", "turn",
                    F.array(F.struct(choices.alias("choices"))).alias("responses"))


# ---- registry -------------------------------------------------------------------------------

def registry_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows in flattened document order, one per model entry.

    run = brand; family group = size mod 3 (group 0 has no models-dir, so paths
    default to the tokenizer dir; group 2 lists absolute paths); every third
    model has an empty flag list (falls back to the group flags).
    """
    part = table(spark, sf_dir, "part")
    g = (F.col("p_size") % 3).cast("int")
    brand_no = F.regexp_extract(F.col("p_brand"), r"(\d+)$", 1)
    suffix = F.when(F.col("p_partkey") % 7 == 0, F.lit(".bin")).otherwise(F.lit(".gguf"))
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), suffix)
    return part.select(
        F.col("p_brand").alias("run_id"),
        g.alias("group_pos"),
        F.concat(F.lit("/tok/b"), brand_no, F.lit("/g"), g.cast("string")).alias("tokenizer"),
        F.when(g != 0, F.concat(F.lit("/models/b"), brand_no)).alias("models_dir"),
        F.array(F.concat(F.lit("--ctx="), (F.lit(1024) * (g + 1)).cast("string"))).alias("group_flags"),
        F.col("p_partkey").cast("bigint").alias("model_pos"),
        F.when(g == 2, F.concat(F.lit("/abs/"), name)).otherwise(name).alias("path"),
        F.when(F.col("p_partkey") % 3 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("--type="), F.lower(F.col("p_type"))))).alias("flags"),
    )


# ---- scoring tables (stand-in bigram scorer) ------------------------------------------------

def ngram_candidates(spark: SparkSession, sf_dir: str, prefixes: DataFrame | None = None, among=None) -> DataFrame:
    """Top-50 bigram candidates per (model = source, previous word), generated token at position 0.

    ``prefixes`` (model_id, prefix_id) restricts the build to the prefixes that will be looked up, ``among`` to those of a part.
    """
    from evalspark.operators import ngram
    # same projection as document_requests: the spread exchange is planned once and reused
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    docs = docs.select(F.col("source").alias("model_id"), "text")
    pairs = ngram.bigrams(docs, words(F.col("text")))
    return ngram.top_k_candidates(pairs, token_id, prefixes=prefixes, among=among)


def _unigrams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(model_id, word, count) and (word, logprob): the log-probability is ``ln(count(word) / all words)`` over all documents."""
    from evalspark.session import materialise
    per_model = materialise(word_occurrences(spark, sf_dir).groupBy("model_id", "word").agg(F.count(F.lit(1)).alias("count")), "unigrams")
    uni = per_model.groupBy("word").agg(F.sum("count").alias("_c"))
    total = per_model.select(F.sum("count")).scalar()
    return per_model, uni.select("word", F.log(F.col("_c").cast("double") / total.cast("double")).alias("logprob"))


def unigram_token_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_id, count, logprob): word occurrences pre-aggregated per source, with the word's log-probability."""
    from evalspark.session import materialise
    per_model, vocab = _unigrams(spark, sf_dir)
    # read twice: for the mean and for the squares about it
    return materialise(per_model.join(vocab, "word").select("model_id", "count", "logprob"), "unigram-logprobs")


def positioned_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(model_id, position, word): the words of a source's documents in the order of doc_id as one long text; and
    (word, logprob) of all words."""
    from evalspark.operators.perplexity import text_offsets
    _, vocab = _unigrams(spark, sf_dir)
    docs = spread(table(spark, sf_dir, "documents").select(F.col("source").alias("model_id"), "doc_id", "text"))
    offsets = text_offsets(docs, F.size(words(F.col("text"))), ["doc_id"], ["model_id"])
    # texts move to their offsets and are cut into words there: an array of words is several times its text
    tokens = docs.join(offsets, ["model_id", "doc_id"]).select("model_id", "offset", F.posexplode(words(F.col("text"))).alias("at", "word"))
    return tokens.select("model_id", (F.col("offset") + F.col("at")).alias("position"), "word"), vocab


# ---- landed texts: records, stream lines, responses, registry documents ----------------------

def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record text per finished exercise with the outcomes of its first two tries and the tokens of all: a pass is ``true``,
    ``"false"`` is text (and counts as a pass), 0 is a failure. Every 11th part has an empty record, every 13th no JSON."""
    from evalspark.operators.outcomes import first_n_tries
    li = spread(table(spark, sf_dir, "lineitem"))
    keys = ["run_id", "model_id", "exercise"]
    t = li.select(run_of(model_of(F.col("l_suppkey"))), model_of(F.col("l_suppkey")).alias("model_id"), F.lit("python").alias("language"),
                  F.col("l_partkey").alias("exercise"), F.col("l_returnflag").alias("flag"), *TRY_ORDER)
    shown = F.when(F.col("flag") == "R", F.lit("true")).when(F.col("flag") == "N", F.lit('"false"')).otherwise(F.lit("0"))
    told = first_n_tries(t, 2, TRY_ORDER).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("try_no", shown.alias("x")))).alias("o"))
    rec = told.join(t.groupBy(*keys).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("n")), keys)
    body = F.concat(F.lit('{"tests_outcomes": ['), F.array_join(F.transform("o", lambda x: x["x"]), ", "), F.lit('], "prompt_tokens": '), F.col("n").cast("string"), F.lit("}"))
    text = F.when(F.col("exercise") % 11 == 0, F.lit("{}")).when(F.col("exercise") % 13 == 0, F.lit('{"tests_outcomes": [')).otherwise(body)
    return rec.select("run_id", "model_id", F.col("exercise").cast("string").alias("exercise"), text.alias("value"))


def supplier_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result file per supplier: run, language, exercise, value. The first try passes if the balance is positive,
    a second one always; every 7th file is empty JSON, every 9th no JSON."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    run = F.concat(F.lit("2024-01-01-00-00-00--"), model_of(k))
    body = F.concat(F.lit('{"tests_outcomes": ['), (F.col("s_acctbal") > 0).cast("string"), F.lit(', true], "prompt_tokens": '), (k * 3).cast("string"), F.lit("}"))
    text = F.when(k % 7 == 0, F.lit("{}")).when(k % 9 == 0, F.lit('{"tests_outcomes":')).otherwise(body)
    language = F.element_at(F.array(*[F.lit(x) for x in ("go", "java", "python", "rust")]), (F.col("s_nationkey") % 4 + 1).cast("int"))
    return s.select(run.alias("run"), language.alias("language"), k.cast("string").alias("exercise"), text.alias("value"))


def reference_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference texts (corpus, value binary): the documents of each source, every 3rd with bytes that are no UTF-8 at
    its end, every 4th with line breaks CR LF, and every 5th with a replacement character of its own."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    text = F.when(k % 4 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    tail = F.concat(F.when(k % 3 == 0, F.unhex(F.lit("E282FF"))).otherwise(F.unhex(F.lit(""))), F.when(k % 5 == 0, F.unhex(F.lit("EFBFBD"))).otherwise(F.unhex(F.lit(""))))
    return d.select(F.col("source").alias("corpus"), F.concat(F.coalesce(text, F.lit("")).cast("binary"), tail).alias("value"))


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-stream lines of ``events``: data lines with a text, broken JSON for errors, the end marker for purchases,
    and a comment line for clicks."""
    ev = spread(table(spark, sf_dir, "events"))
    kind = F.col("event_type")
    line = (F.when(kind == "error", F.lit('data: {"choices": [')).when(kind == "purchase", F.lit("data: [DONE]")).when(kind == "click", F.lit(": ping"))
            .otherwise(F.concat(F.lit('data: {"choices": [{"text": "'), kind, F.lit('"}]}'))))
    return ev.select(run_of(model_of(F.col("user_id"))), model_of(F.col("user_id")).alias("model_id"), "ts", line.alias("line"))


def response_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token response text per conversation turn: id = turn, logprob = -length / 100, two candidates; user turns have no content."""
    c = table(spark, sf_dir, "conversations")
    entry = F.concat(F.lit('{"id": '), F.col("turn").cast("string"), F.lit(', "token": "t", "logprob": -'), (F.length("text") / 100).cast("decimal(12,2)").cast("string"),
                     F.lit(', "top_logprobs": [{"id": 1, "token": "a", "logprob": -1.5}, {"id": 2, "token": "b", "logprob": -2.5}]}'))
    content = F.when(F.col("role") == "user", F.lit("[]")).otherwise(F.concat(F.lit("["), entry, F.lit("]")))
    return c.select(run_of(model_of(F.col("conv_id"))), model_of(F.col("conv_id")).alias("model_id"), "conv_id", "turn",
                    F.concat(F.lit('{"choices": [{"logprobs": {"content": '), content, F.lit("}}]}")).alias("json"))


def registry_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry document per part: a family with three entries, with one fault by the part's number.

    p mod 12: 0 none, 1 no tokenizer, 2 empty models-dir, 3 flags no list, 4 entry a number, 5 no path,
    6 wrong suffix, 7 the same file twice, 8 unknown group key, 9 unknown model key, 10 no models, 11 no list at all.
    """
    p = F.col("p_partkey")
    k = p % 12
    name = F.concat(F.lit("m"), p.cast("string"))
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    first = F.when(k == 4, F.lit("7")).when(k == 6, q(F.concat(name, F.lit(".bin")))).otherwise(q(F.concat(name, F.lit(".GGUF"))))
    second = F.when(k == 7, q(F.concat(F.lit("./x/../"), name, F.lit(".GGUF")))).otherwise(q(F.concat(name, F.lit("-b.gguf"))))
    third = (F.when(k == 5, F.lit('{"flags": ["--a"]}')).when(k == 9, F.concat(F.lit('{"path": "c.gguf", "size": 1}')))
             .when(k == 3, F.lit('{"path": "c.gguf", "flags": [1, 2]}')).otherwise(F.lit('{"path": "c.gguf", "flags": ["--c"]}')))
    models = F.when(k == 10, F.lit("[]")).otherwise(F.concat(F.lit("["), first, F.lit(", "), second, F.lit(", "), third, F.lit("]")))
    group = F.concat(F.when(k == 1, F.lit('{')).otherwise(F.lit('{"tokenizer": "/tok", ')), F.when(k == 2, F.lit('"models-dir": "", ')).otherwise(F.lit('"models-dir": "/models", ')),
                     F.when(k == 8, F.lit('"colour": 1, ')).otherwise(F.lit("")), F.when(k == 3, F.lit('"flags": "x", ')).otherwise(F.lit('"flags": ["--g"], ')),
                     F.lit('"models": '), models, F.lit("}"))
    return spread(table(spark, sf_dir, "part")).select(F.concat(F.lit("p"), p.cast("string")).alias("run_id"), F.when(k == 11, group).otherwise(F.concat(F.lit("["), group, F.lit("]"))).alias("json"))
