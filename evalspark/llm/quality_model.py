"""Quality classifier: a byte-level convolutional network in numpy.

The UTF-8 bytes of a whole text are embedded; filters of WIDTH bytes run over them every STEP bytes.
Their responses are gathered over chunks of two blocks of BLOCK bytes, each block shared with the next
chunk, as mean (what the chunk is made of) and maximum (what occurs in it). A hidden layer looks at every
chunk, its units keep their largest value over all chunks, and a logistic layer makes one probability.
Texts are scored in Python over Arrow batches, some texts at a time; a long text is worked through
piece by piece.

The model is fitted on the driver from a bounded sample of labelled rows: at most PER_CLASS of each
class, those with the smallest hashes of their ids, none of them held out, with their whole texts,
as far as a bounded number of characters goes (``common.TRAIN_CHARS``); scores cover whole texts too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, training_rows
from .toxicity import chunks

PER_CLASS = 600
EMBED, WIDTH, STEP, FILTERS, HIDDEN = 4, 8, 4, 16, 16
BLOCK = 128
EPOCHS, BATCH, RATE = 12, 16, 0.01
#: A text is worse than not if its score is below.
THRESHOLD = 0.3
#: Bytes scored at a time.
_PIECE = 1 << 19
_PLACES = BLOCK // STEP
_NAMES = ("embed", "w1", "b1", "w2", "b2", "w3", "b3")


@dataclass
class Model:
    embed: np.ndarray   # 256 x EMBED
    w1: np.ndarray      # WIDTH * EMBED x FILTERS
    b1: np.ndarray
    w2: np.ndarray      # 2 * FILTERS x HIDDEN
    b2: np.ndarray
    w3: np.ndarray      # HIDDEN
    b3: np.ndarray      # 1


def _new() -> Model:
    rng = np.random.default_rng(5)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Model(draw(256, EMBED, scale=0.5), draw(WIDTH * EMBED, FILTERS, scale=0.3), np.zeros(FILTERS, np.float32),
                 draw(2 * FILTERS, HIDDEN, scale=0.3), np.zeros(HIDDEN, np.float32), draw(HIDDEN, scale=0.3), np.zeros(1, np.float32))


def _blocks(text: str | None) -> np.ndarray:
    """The text's bytes in whole blocks, at least two, padded with zeros."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(max(2, -(-len(raw) // BLOCK)) * BLOCK, np.uint8)
    out[:len(raw)] = raw
    return out


def _windows(data: np.ndarray, model: Model) -> np.ndarray:
    """The embedded bytes of every filter place (places x WIDTH * EMBED); ``data`` has WIDTH bytes more than the places need."""
    x = model.embed[data]
    n = (len(data) - WIDTH) // STEP
    return np.lib.stride_tricks.as_strided(x, (n, WIDTH * EMBED), (STEP * x.strides[0], x.strides[1])).copy()


def _pool(blocks: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Mean and maximum response of every filter in every block of the bytes ``blocks`` followed by WIDTH more."""
    r = np.maximum(_windows(blocks, model) @ model.w1 + model.b1, 0).reshape(-1, _PLACES, FILTERS)
    return r.mean(axis=1), r.max(axis=1)


def _chunk_features(mean: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Features of the chunks of neighbouring blocks."""
    return np.concatenate([(mean[1:] + mean[:-1]) / 2, np.maximum(top[1:], top[:-1])], axis=1)


def hidden(texts: Sequence[str | None], model: Model) -> np.ndarray:
    """Per text the largest value of every hidden unit over its chunks."""
    data = [_blocks(t) for t in texts]
    # a block of zeros behind every text keeps its last filters off the next one
    spacer = np.zeros(BLOCK, np.uint8)
    joined = np.concatenate([*(x for d in data for x in (d, spacer)), np.zeros(WIDTH, np.uint8)])
    parts = [_pool(joined[a:a + _PIECE + WIDTH] if a + _PIECE < len(joined) - WIDTH else joined[a:], model) for a in range(0, len(joined) - WIDTH, _PIECE)]
    f = _chunk_features(np.concatenate([m for m, _ in parts]), np.concatenate([t for _, t in parts]))
    h = np.maximum(f @ model.w2 + model.b2, 0)
    size = np.array([len(d) // BLOCK for d in data])
    begin = np.cumsum(size + 1) - size - 1
    # chunk i is of blocks i and i + 1; the last block of a text begins no chunk of it
    cuts = np.stack([begin, begin + size - 1], axis=1).ravel()
    return np.maximum.reduceat(h, cuts, axis=0)[::2]


def score_texts(texts: Sequence[str | None], model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(hidden(texts, model) @ model.w3 + model.b3[0], -30, 30)))


def _step(texts: Sequence[str], y: np.ndarray, weight: np.ndarray, model: Model) -> dict[str, np.ndarray]:
    """Gradients of a batch. Only chunks that are the largest for some unit take part; they are worked out once more."""
    data = [_blocks(t) for t in texts]
    chosen, owner = [], []
    for k, d in enumerate(data):
        bytes_ = np.concatenate([d, np.zeros(WIDTH, np.uint8)])
        h = np.maximum(_chunk_features(*_pool(bytes_, model)) @ model.w2 + model.b2, 0)
        for c in np.unique(h.argmax(axis=0)):
            chosen.append(bytes_[c * BLOCK:(c + 2) * BLOCK + WIDTH])
            owner.append(k)
    owner, n = np.array(owner), len(chosen)
    raw = np.stack(chosen)                                                # n x 2 * BLOCK + WIDTH
    at = (np.arange(2 * _PLACES) * STEP)[:, None] + np.arange(WIDTH)      # places x WIDTH
    codes = raw[:, at]
    x = model.embed[codes].reshape(n, 2 * _PLACES, WIDTH * EMBED)
    r = np.maximum(x @ model.w1 + model.b1, 0)
    where = r.argmax(axis=1)
    f = np.concatenate([r.mean(axis=1), r.max(axis=1)], axis=1)
    h = np.maximum(f @ model.w2 + model.b2, 0)
    top, who = np.zeros((len(texts), HIDDEN), np.float32), np.zeros((len(texts), HIDDEN), np.int64)
    for k in range(len(texts)):
        own = np.flatnonzero(owner == k)
        best = h[own].argmax(axis=0)
        top[k], who[k] = h[own][best, np.arange(HIDDEN)], own[best]
    p = 1 / (1 + np.exp(-np.clip(top @ model.w3 + model.b3[0], -30, 30)))
    g = ((p - y) * weight / len(texts)).astype(np.float32)
    d_top = g[:, None] * model.w3 * (top > 0)
    d_h = np.zeros_like(h)
    np.add.at(d_h, (who, np.arange(HIDDEN)[None, :].repeat(len(texts), 0)), d_top)
    d_f = d_h @ model.w2.T
    d_r = np.repeat(d_f[:, None, :FILTERS] / (2 * _PLACES), 2 * _PLACES, axis=1)
    d_r[np.arange(n)[:, None], where, np.arange(FILTERS)] += d_f[:, FILTERS:]
    d_r *= r > 0
    d_x = (d_r @ model.w1.T).reshape(-1, EMBED)
    d_embed = np.stack([np.bincount(codes.ravel(), d_x[:, j], 256) for j in range(EMBED)], axis=1)
    return {"embed": d_embed, "w1": x.reshape(-1, WIDTH * EMBED).T @ d_r.reshape(-1, FILTERS), "b1": d_r.sum(axis=(0, 1)),
            "w2": f.T @ d_h, "b2": d_h.sum(axis=0), "w3": top.T @ g, "b3": g.sum(keepdims=True)}


def train(rows: Sequence[tuple[str, int]]) -> Model:
    """Adam over batches; both classes weigh the same."""
    model, rng = _new(), np.random.default_rng(9)
    first, second, t = {k: 0.0 for k in _NAMES}, {k: 0.0 for k in _NAMES}, 0
    texts = [text for text, _ in rows]
    y = np.array([label for _, label in rows], np.float32)
    share = {c: len(y) / max(1, 2 * int((y == c).sum())) for c in (0, 1)}
    weight = np.array([share[int(c)] for c in y], np.float32)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo:lo + BATCH]
            t += 1
            for k, g in _step([texts[i] for i in pick], y[pick], weight[pick], model).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g ** 2
                move = RATE * (1 - epoch / EPOCHS) * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-7)
                setattr(model, k, (getattr(model, k) - move).astype(np.float32))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Null texts count as empty; all empty texts have one score. Without labelled rows the
    scores are those of the untrained model. Repeated rows are scored each; other columns are not read.
    """
    sample = training_rows(docs, labels, "quality", per_class).orderBy("h", "text").collect()  # at most 2 * per_class ids
    model = train([(r["text"], r["label"]) for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score_texts(part, model) for part in chunks(batch.column(1), _PIECE)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
