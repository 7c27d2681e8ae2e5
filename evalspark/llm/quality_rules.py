"""Quality rules whose cutoffs are learned from mergeable quantile sketches.

Each text gets counts (words, symbols, repeated lines, words in repeated windows) and ratios.
For every ratio a KLL sketch is aggregated per (lang, source), and one for each number that ratios are
taken of; sketches merge, so map tasks send one sketch per group and the same sketches are merged again
into one per language and one for the whole table. The cutoff of a group is a fence above its upper
quartile, as many spreads away as FENCE says. The spread is what the sketches show: the distance of the
quartiles, or, where most texts score the same, what a single event makes up in a short text of the
group. The cutoffs of a group are drawn towards those of its language, and these towards those of the table,
the more the fewer rows it has. The cutoffs are a small table that is joined back for filtering.
Everything is built-in expressions: no Python runs on the executors.

Sketches of more than SKETCH_K rows keep a random choice of them, so that a cutoff may differ a little
from run to run, and with it the verdict on a text that lies at the cutoff.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, scratch

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Size of the sketches; up to about so many rows their quantiles are exact.
SKETCH_K = 800
#: Spreads between the upper quartile and the cutoff.
FENCE = 6.0
#: The quantile of words, letters or lines that stands for a short text of the group.
SHORT = 0.1
#: Rows that the cutoffs of the language weigh against those of a group, and those of the table against a language's.
PRIOR_ROWS = 10.0


@dataclass(frozen=True)
class Ratio:
    """A ratio checked against an upper cutoff; ``of`` is the number it is taken of, ``event`` what one occurrence adds to it."""

    name: str
    of: str
    event: int = 1


RATIOS = (
    Ratio("symbol_ratio", "n_words"),                  # symbols per word
    Ratio("shout_ratio", "n_words"),                   # exclamation marks per word
    Ratio("upper_ratio", "word_chars"),                # upper-case letters per character of a word
    Ratio("echo_ratio", "n_words"),                    # words equal to the one before
    Ratio("repeat_ratio", "n_words", event=WINDOW),    # words in repeated windows
    Ratio("dup_line_ratio", "n_lines"),                # lines equal to an earlier one
)
_OF = {"n_words": "__q.n_words", "word_chars": "__q.word_chars", "n_lines": "__q.lines.lines"}


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more.

    Windows are compared by a 64-bit hash of their words. Texts without a repeat stop at the
    hash set; the others sort (hash, position), keep the positions whose hash has an equal
    neighbour, and add up the covered stretch from one kept position to the next.
    """
    def covered(keys: Column) -> Column:
        tagged = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def kept(s: Column) -> Column:
            same = lambda i: F.get(s, i)["h"]
            hits = F.filter(s, lambda x, i: F.coalesce(same(i - 1) == x["h"], F.lit(False)) | F.coalesce(same(i + 1) == x["h"], F.lit(False)))
            return F.array_sort(F.transform(hits, lambda x: x["i"]))

        def total(p: Column) -> Column:
            gap = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gap, F.lit(0).cast("long"), lambda acc, g: acc + g)

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(
            let(tagged, lambda s: let(kept(s), total)))

    def windows(codes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(codes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(codes, i, WINDOW)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashed, lambda c: let(windows(c), covered)))


def counts(text: Column) -> Column:
    """Struct of the base counts of a text and what the ratios need; a null text counts as empty."""
    def lines_dup(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"))

    def build(words: Column, t: Column) -> Column:
        body = F.array_join(words, "")
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
        echo = F.size(F.filter(words, lambda w, i: F.coalesce(F.get(words, i - 1) == w, F.lit(False))))
        return let(body, lambda b: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(b).cast("long").alias("word_chars"),
            (F.length(b) - F.length(F.regexp_replace(b, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            (F.length(b) - F.length(F.replace(b, F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
            (F.length(b) - F.length(F.regexp_replace(b, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
            echo.cast("long").alias("n_echo"),
            let(lines, lines_dup).alias("lines"),
            _repeat_words(words).alias("n_repeat_words")))

    return let(F.coalesce(text, F.lit("")), lambda t: let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: build(w, t)))


def _ratio_columns(c: str) -> list[Column]:
    per_word = lambda x: x / F.greatest(F.col(f"{c}.n_words"), F.lit(1))
    return [
        per_word(F.col(f"{c}.n_symbols")).alias("symbol_ratio"),
        per_word(F.col(f"{c}.n_shouts")).alias("shout_ratio"),
        (F.col(f"{c}.n_upper") / F.greatest(F.col(f"{c}.word_chars"), F.lit(1))).alias("upper_ratio"),
        per_word(F.col(f"{c}.n_echo")).alias("echo_ratio"),
        per_word(F.col(f"{c}.n_repeat_words")).alias("repeat_ratio"),
        (F.col(f"{c}.lines.dup") / F.greatest(F.col(f"{c}.lines.lines"), F.lit(1))).alias("dup_line_ratio"),
    ]


def measure(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` plus struct ``__q`` (base counts) and ``__r`` (ratios)."""
    kept = [docs[c] for c in (docs.columns if keep is None else keep)]
    return docs.select(*kept, counts(docs[text_col]).alias("__q")).select(
        *(keep if keep is not None else docs.columns), "__q", F.struct(*_ratio_columns("__q")).alias("__r"))


def cutoffs(measured: DataFrame, lang: str = "lang", source: str = "source", fence: float = FENCE, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """One row per (lang, source), nulls being a group of their own: the upper cutoff of every ratio.

    Texts of fewer than MIN_WORDS words fail the base rules anyway and do not enter the sketches.
    """
    rows = measured.where(F.col("__q.n_words") >= MIN_WORDS)
    sketched = {**{r.name: F.col(f"__r.{r.name}") for r in RATIOS}, **{k: F.col(c).cast("double") for k, c in _OF.items()}}
    fine = scratch(rows.groupBy(F.col(lang).alias("lang"), F.col(source).alias("source")).agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_double(c, SKETCH_K).alias(k) for k, c in sketched.items()]), "quality-sketches")
    merge = [F.kll_merge_agg_double(k, SKETCH_K).alias(k) for k in sketched]
    at = lambda k, q: F.kll_sketch_get_quantile_double(k, F.lit(q))

    def fences(df: DataFrame, *keys: str) -> DataFrame:
        def one(r: Ratio) -> Column:
            alone = F.lit(float(r.event)) / F.greatest(at(r.of, SHORT), F.lit(1.0))
            return (at(r.name, 0.75) + fence * F.greatest(at(r.name, 0.75) - at(r.name, 0.25), alone)).alias(r.name)
        return df.where("n > 0").select(*keys, "n", F.struct(*[one(r) for r in RATIOS]).alias("own"))

    def drawn(to) -> Column:
        weight = F.col("n") / (F.col("n") + prior_rows)
        return F.struct(*[(weight * F.col(f"own.{r.name}") + (F.lit(1.0) - weight) * to(r.name)).alias(r.name) for r in RATIOS])

    table = fences(fine.agg(F.sum("n").alias("n"), *merge)).first()  # one row of len(RATIOS) numbers, or none
    if table is None:
        return fine.select("lang", "source", F.struct(*[F.lit(None).cast("double").alias(r.name) for r in RATIOS]).alias("cutoff"))
    by_lang = fences(fine.groupBy("lang").agg(F.sum("n").alias("n"), *merge), F.col("lang").alias("_lang"))
    by_lang = by_lang.select("_lang", drawn(lambda name: F.lit(table["own"][name])).alias("coarse"))
    out = fences(fine, "lang", "source").join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")))
    return scratch(out.select("lang", "source", drawn(lambda name: F.col(f"coarse.{name}")).alias("cutoff")), "quality-cutoffs")


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` with ``__base_failed``, ``__kept`` and ``__reasons`` (names of the ratios over their cutoff).

    A group without cutoffs has only texts that fail the base rules, or none.
    """
    lim = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col("cutoff").alias("__cutoff"))
    joined = measured.join(lim, measured[lang].eqNullSafe(lim["__lang"]) & measured[source].eqNullSafe(lim["__source"]), "left")
    base = (F.col("__q.n_words") < MIN_WORDS) | (100 * F.col("__q.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__q.n_words"))
    over = F.filter(F.array(*[F.when(F.col(f"__r.{r.name}") > F.col(f"__cutoff.{r.name}"), F.lit(r.name)) for r in RATIOS]), lambda x: x.isNotNull())
    return joined.withColumn("__base_failed", base).withColumn("__reasons", over).withColumn(
        "__kept", ~F.col("__base_failed") & (F.size("__reasons") == 0)).drop("__lang", "__source")


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): counts, base_failed, kept, reasons.

    A null text has no words and fails; null lang or source are groups of their own; repeated
    rows are judged each; other columns are not read; an empty table gives no rows.
    """
    narrow = docs.select("doc_id", F.col("lang").alias("lang"), F.col("source").alias("source"), "text")
    measured = scratch(measure(narrow, keep=["doc_id", "lang", "source"]), "quality-counts")
    judged = judge(measured, cutoffs(measured))
    return judged.select(
        "doc_id", "__q.n_words", "__q.word_chars", "__q.n_symbols", F.col("__q.lines.dup").cast("long").alias("n_dup_lines"),
        "__q.n_repeat_words", F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"), F.col("__reasons").alias("reasons"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the learned cutoffs, columns unchanged."""
    measured = scratch(measure(docs), "quality-measured")
    return judge(measured, cutoffs(measured)).where("__kept").select(*docs.columns)
