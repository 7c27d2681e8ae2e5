"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word has a hash for itself and one for each of its beginnings of PREFIXES characters, so that
inflected forms share what they begin with; its embedding is the rows of these hashes side by side.
Filters of WIDTHS words run over the whole
text, each keeps its largest response, and a logistic layer combines them into a probability.
Texts are scored in Python over Arrow batches, the words of many documents at a time.

The model is fitted on all labelled rows that are not held out, with their whole texts, in rounds: every task of a
round goes on from the parameters of the round before with the texts of its own partition, and Spark merges what the
tasks changed, number by number. The driver holds the parameters only, as many as the vocabulary needs; texts never reach
it. Buckets that few of all these texts use (MIN_DOCS, or one in RARE) stay zero: a word seen once tells nothing. Per
language, a threshold is calibrated on the scores of the same rows, counted in steps of 1 / STEPS; it yields the extra verdict ``flagged`` and
enters no score.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, scratch

#: Texts that must use a bucket, at least, and the share of all texts that must (one in RARE).
MIN_DOCS, RARE = 6, 20_000
#: Beginnings hashed besides the whole word, numbers of buckets (as a power of two), numbers per bucket.
PREFIXES = (4, 5)
BITS, PART = 20, 4
WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, RATE = 6, 0.1
#: Texts after which no further epoch begins, and parts of the texts after which the tasks' changes are merged in a single epoch.
ENOUGH, SLICES = 30_000, 4
#: Steps of the calibrated thresholds.
STEPS = 1000
#: Where a row of a Parquet file is, in Spark's own columns; rows of a file, as a power of two, whose labels are kept together.
FILE_ROWS, BLOCK_BITS = ("_metadata.file_path", "_metadata.row_index"), 12
#: Labels that are broadcast as they are; the texts of so few are not dealt out either, as each of many tasks would learn too little.
FEW = 5_000
#: Bucket counts a task holds before it hands them on.
_HELD = 1 << 20
#: Share of a word's embedding lost at each update; how far the classes are balanced (0: not, 1: equal weight).
DECAY, BALANCE = 1e-3, 0.5
MAX_THRESHOLD = 0.95
#: Words a worker remembers the buckets of, and characters scored at a time.
CACHE_WORDS = 300_000
_CHUNK = 1 << 20
_PADS = max(WIDTHS)
#: Words of a long text scored at a time.
_PIECE_WORDS = 1 << 15
_KINDS = 1 + len(PREFIXES)
_DIM = _KINDS * PART
_WORD = re.compile(r"\w+")


def _bucket(piece: str) -> int:
    return xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass"), 5) & ((1 << BITS) - 1)


def _buckets(word: str) -> tuple[int, ...]:
    """Bucket of the word in the first table and of its beginnings in the others."""
    return tuple(_bucket(p) for p in (word, *(word[:n] for n in PREFIXES)))


@dataclass
class Model:
    """Buckets in use and their rows per table, filters per width (width * _DIM x FILTERS), and the logistic layer.

    The last row of a table is zero; it stands for padding and for all buckets that are not in use.
    """

    key: str
    used: list[dict[int, int]]
    rows: list[np.ndarray]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    offset: float


class _Words(dict):
    """word -> its rows in the tables of a model, forgetting everything when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.used, self.none = model.used, [len(u) for u in model.used]

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        at = 0
        for k, (used, none, bucket) in enumerate(zip(self.used, self.none, _buckets(word))):
            at |= used.get(bucket, none) << 21 * k
        self[word] = at
        return at


_CACHES: dict[str, _Words] = {}


def _cache(model: Model) -> _Words:
    if model.key not in _CACHES:
        _CACHES.clear()  # one model at a time
        _CACHES[model.key] = _Words(model)
    return _CACHES[model.key]


def _split(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _places(texts: Sequence[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (places x tables) of every word, _PADS paddings behind each text; first place and number of places of each text."""
    split = [_split(t) for t in texts]
    size = np.array([len(x) for x in split], np.int64)
    begin = np.cumsum(size + _PADS) - size - _PADS
    packed = np.fromiter(map(_cache(model).__getitem__, (w for x in split for w in x)), np.int64, int(size.sum()))
    place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(packed))
    rows = np.empty((int((size + _PADS).sum()), _KINDS), np.int64)
    for k in range(_KINDS):
        rows[:, k] = len(model.used[k])
        rows[place, k] = packed >> 21 * k & ((1 << 21) - 1)
    return rows, begin, size + 1


def _embed(rows: np.ndarray, model: Model) -> np.ndarray:
    return np.concatenate([t[rows[:, k]] for k, t in enumerate(model.rows)], axis=1)


def _responses(x: np.ndarray, model: Model) -> np.ndarray:
    """Response of every filter at every place of the embedded words ``x``; past the end there is padding."""
    n, out, at = len(x), [], 0
    for width, w in zip(WIDTHS, model.filters):
        r = np.zeros((n, w.shape[1]), np.float32)
        for j in range(width):
            r[:n - j] += (x @ w[j * _DIM:(j + 1) * _DIM])[j:]
        out.append(r + model.bias[at:at + w.shape[1]])
        at += w.shape[1]
    return np.concatenate(out, axis=1)


def _probability(top: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.maximum(top, 0) @ model.out + model.offset, -30, 30)))


def _score_long(text: str, model: Model, piece: int = _PIECE_WORDS) -> float:
    """Probability of one text, ``piece`` words at a time: the largest responses of the pieces, each of which
    begins with the last words of the one before, are those of the text."""
    words = (m.group() for m in _WORD.finditer(text.lower()))
    top, held = np.full(FILTERS * len(WIDTHS), -np.inf, np.float32), []
    while True:
        new = list(islice(words, piece))
        last = len(new) < piece
        rows = _rows_of(held + new, model, _PADS if last else 0)
        # a place counts in the piece that holds all the words in its reach; the first padding is a place too
        n = len(held) + len(new) + 1 if last else len(rows) - (_PADS - 1)
        if n > 0:
            top = np.maximum(top, _responses(_embed(rows, model), model)[:n].max(axis=0))
        if last:
            return float(_probability(top[None, :], model)[0])
        held = (held + new)[len(held) + len(new) - (_PADS - 1):]


def _rows_of(words: Sequence[str], model: Model, pads: int) -> np.ndarray:
    """Rows of words in the tables, with paddings behind them."""
    packed = np.fromiter(map(_cache(model).__getitem__, words), np.int64, len(words))
    rows = np.empty((len(words) + pads, _KINDS), np.int64)
    for k in range(_KINDS):
        rows[:, k] = len(model.used[k])
        rows[:len(words), k] = packed >> 21 * k & ((1 << 21) - 1)
    return rows


def score_texts(texts: Sequence[str | None], model: Model, longest: int = _CHUNK) -> np.ndarray:
    """Probability of every text; a text without words has the score of padding. Texts of more than ``longest`` characters
    are scored piece by piece, so that memory does not grow with them."""
    out = np.empty(len(texts))
    long = [i for i, t in enumerate(texts) if len(t or "") > longest]
    for i in long:
        out[i] = _score_long(texts[i] or "", model)
    short = [i for i in range(len(texts)) if len(texts[i] or "") <= longest]
    if short:
        out[short] = _score_together([texts[i] for i in short], model)
    return out


def _score_together(texts: Sequence[str | None], model: Model) -> np.ndarray:
    rows, begin, size = _places(texts, model)
    r = _responses(_embed(rows, model), model)
    # a text's places are its words and its first padding; nothing of the next text is in reach
    cuts = np.stack([begin, begin + size], axis=1).ravel()
    return _probability(np.maximum.reduceat(r, cuts, axis=0)[::2], model)


def _flat_size(model_rows: Sequence[int]) -> list[int]:
    """Lines of PART numbers that the tables, filters, bias, output layer and offset take in the flat parameters."""
    n_out = FILTERS * len(WIDTHS)
    return [*model_rows, *[w * _DIM * FILTERS // PART for w in WIDTHS], n_out // PART, n_out // PART, 1]


def _view(flat: np.ndarray, used: list[dict[int, int]], key: str) -> Model:
    """The model whose arrays are parts of ``flat``; what is written to them is written there (the offset is a number of its own)."""
    ends = np.cumsum(_flat_size([len(u) + 1 for u in used]))
    parts = np.split(flat, ends[:-1])
    k = len(used)
    filters = [x.reshape(w * _DIM, FILTERS) for x, w in zip(parts[k:], WIDTHS)]
    bias, out, offset = parts[k + len(WIDTHS):]
    return Model(key, used, parts[:k], filters, bias.reshape(-1), out.reshape(-1), float(offset[0, 0]))


def _untrained(used: list[dict[int, int]]) -> np.ndarray:
    """Flat parameters to begin with."""
    rng = np.random.default_rng(3)
    emb = [rng.normal(0, 0.1, (len(u) + 1, PART)).astype(np.float32) for u in used]
    for e in emb:
        e[-1] = 0
    filters = [rng.normal(0, 0.5, (w * _DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    n_out = FILTERS * len(WIDTHS)
    rest = [np.zeros(n_out, np.float32), rng.normal(0, 0.3, n_out).astype(np.float32), np.zeros(PART, np.float32)]
    return np.concatenate([x.reshape(-1, PART) for x in (*emb, *filters, *rest)])


def _best(text: str | None, model: Model, longest: int = _CHUNK, piece: int = _PIECE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of every filter in a text, and the rows of the words in its reach there (filters x _PADS x tables).
    Texts of more than ``longest`` characters are worked through piece by piece, as in scoring."""
    n_out = FILTERS * len(WIDTHS)
    reach = np.arange(_PADS)
    if len(text or "") <= longest:
        rows, _, n = _places([text], model)
        r = _responses(_embed(rows, model), model)[:int(n[0])]
        where = r.argmax(axis=0)
        return r[where, np.arange(n_out)], rows[where[:, None] + reach]
    words = (m.group() for m in _WORD.finditer(text.lower()))
    top, found, held = np.full(n_out, -np.inf, np.float32), np.zeros((n_out, _PADS, _KINDS), np.int64), []
    while True:
        new = list(islice(words, piece))
        last = len(new) < piece
        rows = _rows_of(held + new, model, _PADS if last else 0)
        n = len(held) + len(new) + 1 if last else len(rows) - (_PADS - 1)
        if n > 0:
            r = _responses(_embed(rows, model), model)[:n]
            where = r.argmax(axis=0)
            larger = r[where, np.arange(n_out)] > top
            top = np.where(larger, r[where, np.arange(n_out)], top)
            found[larger] = rows[where[:, None] + reach][larger]
        if last:
            return top, found
        held = (held + new)[len(held) + len(new) - (_PADS - 1):]


def _learn(texts: Iterable[tuple[str | None, int]], flat: np.ndarray, mem: np.ndarray, used: list[dict[int, int]], key: str, weight: dict[int, float]) -> None:
    """Adagrad over one text at a time, in place; only the place of each filter's largest response gets a gradient."""
    model, m = _view(flat, used, key), _view(mem, used, key)
    for text, y in texts:
        best, rows = _best(text, model)
        top = np.maximum(best, 0)
        p = 1 / (1 + np.exp(-np.clip(top @ model.out + model.offset, -30, 30)))
        g = np.float32((p - y) * weight[y])
        d_top = g * model.out * (top > 0)
        d_out = g * top
        m.out += d_out ** 2
        model.out -= RATE * d_out / np.sqrt(m.out)
        m.offset += float(g) ** 2
        model.offset -= RATE * float(g) / m.offset ** 0.5
        m.bias += d_top ** 2
        model.bias -= RATE * d_top / np.sqrt(m.bias)
        touched, change = [], []
        for k, width in enumerate(WIDTHS):
            s = slice(k * FILTERS, (k + 1) * FILTERS)
            d = d_top[s]
            live = np.flatnonzero(d)
            if not len(live):
                continue
            places = rows[s][live, :width]                                       # live x width x tables
            x = _embed(places.reshape(-1, _KINDS), model).reshape(len(live), -1)
            d_f = x * d[live][:, None]                                           # gradient of the live filters, transposed
            touched.append(places.reshape(-1, _KINDS))
            change.append((model.filters[k].T[live] * d[live][:, None]).reshape(-1, _DIM))
            m.filters[k].T[live] += d_f ** 2
            model.filters[k].T[live] -= RATE * d_f / np.sqrt(m.filters[k].T[live])
        if not touched:
            continue
        places, d_x = np.concatenate(touched), np.concatenate(change)
        for t, (e, me) in enumerate(zip(model.rows, m.rows)):
            at, inverse = np.unique(places[:, t], return_inverse=True)
            total = np.zeros((len(at), PART), np.float32)
            np.add.at(total, inverse.ravel(), d_x[:, t * PART:(t + 1) * PART])
            total[at == len(e) - 1] = 0
            me[at] += total ** 2
            e[at] = (1 - DECAY) * e[at] - RATE * total / np.sqrt(me[at])
    flat[-1, 0], mem[-1, 0] = model.offset, m.offset


def _weights(n: int, positive: int) -> dict[int, float]:
    return {0: (n / max(1, 2 * (n - positive))) ** BALANCE, 1: (n / max(1, 2 * positive)) ** BALANCE}


def _bucket_sets(text: str | None) -> list[set[int]]:
    """The buckets that a text uses, per table."""
    words = set(_split(text))
    return [{*map(_bucket, pieces)} for pieces in (words, *({w[:n] for w in words} for n in PREFIXES))]


def train(texts: Sequence[tuple[str, int]]) -> Model:
    """The model of some texts at hand."""
    rng = np.random.default_rng(3)
    seen: list[Counter] = [Counter() for _ in range(_KINDS)]
    for text, _ in texts:
        for c, buckets in zip(seen, _bucket_sets(text)):
            c.update(buckets)
    used = [{b: i for i, b in enumerate(sorted(b for b, n in c.items() if n >= MIN_DOCS))} for c in seen]
    flat, key = _untrained(used), uuid.uuid4().hex
    mem, weight = np.full_like(flat, 1e-3), _weights(len(texts), sum(y for _, y in texts))
    for _ in range(EPOCHS):
        _learn((texts[i] for i in rng.permutation(len(texts))), flat, mem, used, key, weight)
    return _view(flat, used, key)


def _vocabulary(rows: DataFrame, least: int) -> list[dict[int, int]]:
    """Per table the buckets that ``least`` of all texts use, numbered; every text is counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter() for _ in range(_KINDS)]

        def counted() -> Iterator[pa.RecordBatch]:
            for k, c in enumerate(seen):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), k, np.int32)), pa.array(list(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["k", "bucket", "n"])
                c.clear()

        for batch in batches:
            for text in batch.column(0):
                for c, buckets in zip(seen, _bucket_sets(text.as_py())):
                    c.update(buckets)
                if sum(map(len, seen)) > _HELD:
                    yield from counted()
        yield from counted()

    counts = rows.select("text").mapInArrow(run, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = counts.select("k", "bucket").toArrow().to_pandas()  # at most 1 << BITS of each table
    return [{int(b): i for i, b in enumerate(np.sort(found["bucket"][found["k"] == k].to_numpy()))} for k in range(_KINDS)]


_PARAMS = [f"p{j}" for j in range(PART)] + [f"m{j}" for j in range(PART)]


def _round(rows: DataFrame, flat: np.ndarray, mem: np.ndarray, used: list[dict[int, int]], key: str, weight: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """Parameters after every task has learned the texts of its partition of ``rows``: each line of parameters moves by the mean
    change of the tasks that changed it; the sums of squares add up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, squares = flat.copy(), mem.copy()
        _learn(((t.as_py(), y.as_py()) for b in batches for t, y in zip(b.column(0), b.column(1))), own, squares, used, key, weight)
        at = np.flatnonzero((squares != mem).any(axis=1) | (own != flat).any(axis=1))
        change = np.concatenate([own[at] - flat[at], squares[at] - mem[at]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(np.ascontiguousarray(change[:, j])) for j in range(2 * PART)]], names=["at", *_PARAMS])

    changes = rows.select("text", "label").mapInArrow(run, "at int, " + ", ".join(f"{c} float" for c in _PARAMS))
    merged = changes.groupBy("at").agg(*[(F.avg(c) if c[0] == "p" else F.sum(c)).cast("float").alias(c) for c in _PARAMS]).toArrow()  # as many rows as the model has lines
    at = merged.column("at").to_numpy()
    flat, mem = flat.copy(), mem.copy()
    for j in range(PART):
        flat[at, j] += merged.column(f"p{j}").to_numpy()
        mem[at, j] += merged.column(f"m{j}").to_numpy()
    return flat, mem


def _with_labels(docs: DataFrame, y: DataFrame, place: tuple[str, str] | None) -> DataFrame:
    """(doc_id, text, label) of the rows of ``docs`` that ``y`` (doc_id, label: 0 or 1) names.

    ``place`` names columns of ``docs``: a file, and the number of a row in it; rows that share both are the same. With
    it only ids move to the labels, and two bits a row come back to the texts, which stay where they are.
    """
    if place is None:
        return docs.join(y, "doc_id").select("doc_id", "text", "label")
    file, row = map(F.col, place)
    at = [file.alias("_file"), F.shiftright(row, BLOCK_BITS).alias("_block"), F.shiftright(row, 6).alias("_word"), row.bitwiseAND(63).cast("int").alias("_bit")]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))
    words = docs.select("doc_id", *at).join(y, "doc_id").groupBy("_file", "_block", "_word").agg(
        F.bit_or(bit).alias("known"), F.bit_or(F.when(F.col("label") == 1, bit).otherwise(0)).alias("positive"))
    blocks = words.groupBy("_file", "_block").agg(F.map_from_entries(F.collect_list(F.struct("_word", F.struct("known", "positive")))).alias("_words"))
    # 24 bytes for 64 rows of documents are broadcast
    marked = docs.select("doc_id", "text", *at).join(F.broadcast(blocks), ["_file", "_block"]).withColumn("_mark", F.try_element_at("_words", F.col("_word")))
    return marked.where(F.getbit("_mark.known", F.col("_bit")) == 1).select("doc_id", "text", F.getbit("_mark.positive", F.col("_bit")).cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, place: tuple[str, str] | None = None) -> Model:
    """The model of all rows of ``docs`` (doc_id, text) with a label (``_labelled``); repeated rows count each. ``place`` as in ``_with_labels``."""
    y = labels.select(F.col("_id").alias("doc_id"), "label")
    if place and y.limit(FEW + 1).count() <= FEW:
        place, y = None, F.broadcast(y)
    texts = _with_labels(docs, y, place).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int"))
    if place:  # the labelled texts alone are dealt out: a table may be sorted, and what one task learns must be a mixture
        texts = texts.repartition("doc_id").sortWithinPartitions("slice", "doc_id")
    rows = scratch(texts.select("text", "label", "slice"), "toxicity-texts", "slice")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    used = _vocabulary(rows, max(MIN_DOCS, n // RARE))
    flat, key, weight = _untrained(used), uuid.uuid4().hex, _weights(n, positive)
    mem = np.full_like(flat, 1e-3)
    epochs = min(EPOCHS, -(-ENOUGH // n)) if n else 0
    parts = [rows] if epochs > 1 else [rows.where(F.col("slice") == k) for k in range(SLICES)]
    for _ in range(epochs):
        for part in parts:
            flat, mem = _round(part, flat, mem, used, key, weight)
    return _view(flat, used, key)


def _labelled(labels: DataFrame) -> DataFrame:
    """(_id, label) of the labelled ids that are not held out; of repeated ids one."""
    y = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("label"))
    return y.where(F.col("label").isin(0, 1) & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("label").alias("label"))


def calibrate(scored: DataFrame) -> DataFrame:
    """(lang, threshold): per language of all rows (lang, score, label) the threshold with the best F1, the lowest of equals, in
    the middle between the steps of the scores beside it and not above MAX_THRESHOLD; languages without both classes have none."""
    steps = scored.groupBy("lang", F.floor(F.col("score") * STEPS).alias("step")).agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    # a language has at most STEPS + 1 rows
    down = Window.partitionBy("lang").orderBy(F.desc("step"))
    whole = Window.partitionBy("lang")
    at = steps.select("lang", "step", F.lead(F.col("step") + 1, 1, 0).over(down).alias("below"), F.sum("n").over(down).alias("hits"), F.sum("y").over(down).alias("right"),
                      F.sum("y").over(whole).alias("y"), F.sum("n").over(whole).alias("n"))
    cut = F.least(F.lit(MAX_THRESHOLD), (F.col("step") + F.col("below")) / (2.0 * STEPS))
    f1 = 2 * F.col("right") / (F.col("hits") + F.col("y"))
    return at.where((F.col("y") > 0) & (F.col("y") < F.col("n"))).groupBy("lang").agg(F.max_by(cut, F.struct(f1, -F.col("step"))).alias("threshold"))


def chunks(texts: pa.Array, size: int = _CHUNK) -> Iterator[list[str]]:
    """The texts of a column, some at a time: at most one beyond ``size`` characters."""
    held, total = [], 0
    for x in texts:
        held.append(x.as_py())
        total += len(held[-1] or "")
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def score_toxicity(docs: DataFrame, labels: DataFrame, place: tuple[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, score, predicted, threshold, flagged.

    Null texts count as empty; texts without words all have one score. Texts of any length are scored whole, in bounded memory. ``lang`` chooses the threshold
    of ``flagged`` only; languages without labelled rows use 0.5. Without labelled rows
    every score is that of the untrained model. Repeated rows are scored each. ``place``, the columns of a row's file and of its number there (``FILE_ROWS`` if
    ``docs`` are the rows of Parquet files), spares the other texts a move to the labels; without it Spark joins them as they are.
    """
    known = _labelled(labels)
    model = fit(docs, known, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score_texts(part, model) for part in chunks(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "lang", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = scratch(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang string, score double"), "toxicity-scores")
    limits = calibrate(scored.join(known, scored["doc_id"] == known["_id"])).select(F.col("lang").alias("_lang"), "threshold")
    threshold = F.coalesce("threshold", F.lit(0.5))
    return scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        threshold.alias("threshold"), (F.col("score") >= threshold).alias("flagged"))
