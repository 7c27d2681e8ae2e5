"""Benchmark decontamination by latent semantic retrieval.

1. Every text is cut into words once; words of the benchmark become term numbers, all others are
   out of vocabulary. The numbers are written to the shared folder, and with them, per task, how
   many passages hold each term and each pair of terms.
2. TF-IDF rows (presence times idf) of all passages are decomposed by a distributed randomised SVD:
   two passes over the summed counts of pairs, which are A'A without its weights, each task summing
   its share of A'A X, with the benchmark's own passages added at equal weight. The matrix has
   DIMENSIONS columns: terms share them if the benchmark has more.
3. Every passage of every document is projected and compared with every passage of the benchmark
   by cosine (projection and comparison are one product of matrices). A passage whose in-vocabulary share of its norm is below the threshold cannot reach
   it and is not projected.
4. A candidate is checked against the whole item: the longest common subsequence of words with the
   text around the passage must reach LCS_SURE of the item, or LCS_LIKELY for a paraphrase that
   also holds the item's answer: its last line or sentence, or, of an item that is one sentence, most of its last
   third, and then all within a stretch not much longer than the item.

Vocabulary, document frequencies and basis are those of the whole benchmark, so what is found of an
item does not depend on other items. The benchmark is the stated query set; it is searched in blocks of bounded
size over the numbers of step 1, and a task receives one block, the basis and, in step 1, the vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch

PASSAGE, STRIDE = 32, 16
RANK, OVERSAMPLE = 320, 32
#: Matrices that a pass of the SVD sends to the driver, at most.
FIT_PARTS = 8
#: Columns of the TF-IDF matrix; term n is in column n modulo this.
DIMENSIONS = 1 << 14
#: Words of the benchmark searched at a time.
BLOCK_WORDS = 12_000
MIN_COSINE = 0.2
LCS_SURE, LCS_LIKELY, ANSWER = 0.8, 0.6, 0.8
#: Share of the last third that a paraphrase of a one-sentence item must hold, and how long it may be against the item.
LAST_THIRD, STRETCH = 0.5, 1.5
#: Items below so many words need all their words in a row.
SHORT = 8
_WORD = re.compile(r"\w+")
_PAD = -2
#: Terms of passages whose products are held at a time, each a row of the basis's width.
_TERMS = 1 << 12
#: Pairs of terms of passages that are sorted at a time, different pairs that a task holds, pairs in a row, cells of a block of the matrix of pairs.
_SORTED, _HELD, _ROW, _CELLS = 1 << 21, 1 << 21, 1 << 11, 1 << 18


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def lcs(a: list[int], b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = at.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _answer(text: str) -> tuple[list[str], bool]:
    """Words that a paraphrase must hold, and whether they are an answer: the last line that has any words, of a single line
    its last sentence; of a single sentence its last third, which is none."""
    lines = [w for w in map(words_of, text.split("\n")) if w]
    parts = lines if len(lines) > 1 else [w for w in map(words_of, re.split(r"(?<=[.!?])\s+", text)) if w]
    if len(parts) > 1:
        return parts[-1], True
    words = words_of(text)
    return words[-(-2 * len(words) // 3):], False


@dataclass
class Block:
    """Items of the benchmark as term numbers, with the answer of each and whether it is one."""

    ids: list
    items: list[list[int]]
    answers: list[list[int]]
    told: list[bool]

    @staticmethod
    def of(rows: list[tuple], terms: dict[str, int]) -> Block:
        found = [_answer(t) for _, t in rows]
        numbers = lambda ws: [terms[w] for w in ws]
        return Block([i for i, _ in rows], [numbers(words_of(t)) for _, t in rows], [numbers(w) for w, _ in found], [told for _, told in found])


def _items(benchmark: DataFrame) -> DataFrame:
    """The different items, written once."""
    return scratch(benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct(), "decon-items")


def vocabulary(items: DataFrame) -> dict[str, int]:
    """Term numbers of the benchmark's words, in the order of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w for t in batch.column(0) for w in words_of(t.as_py())}), pa.string())], names=["w"])

    found = items.select("text").mapInArrow(run, "w string").distinct()
    return {w: n for n, w in enumerate(sorted(r["w"] for r in found.toLocalIterator()))}


def _blocks(items: DataFrame, terms: dict[str, int]) -> Iterator[Block]:
    """Blocks of at most BLOCK_WORDS words (one item at least), fetched piece by piece."""
    rows, size = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        n = len(words_of(r["text"]))
        if not n:
            continue
        if rows and size + n > BLOCK_WORDS:
            yield Block.of(rows, terms)
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += n
    if rows:
        yield Block.of(rows, terms)


def _windows(flat: np.ndarray, offsets: np.ndarray, stride: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, start, terms) of the passages of the rows of ``flat`` between ``offsets``, some thousands at a time.

    ``terms`` is passages x PASSAGE, sorted, with repeats of a term and places behind the row's
    end as padding. The last passage of a row ends with it, so no word is left out.
    """
    size = np.diff(offsets)
    count = np.where(size <= PASSAGE, np.minimum(size, 1), 1 + -(-(size - PASSAGE) // stride))
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + np.minimum(nth * stride, np.maximum(size[row] - PASSAGE, 0))
    flat = np.concatenate([flat, np.full(PASSAGE, _PAD, flat.dtype)])
    for lo in range(0, len(row), 8192):
        r, s = row[lo:lo + 8192], start[lo:lo + 8192]
        at = s[:, None] + np.arange(PASSAGE)
        terms = np.sort(np.where(at < offsets[r + 1][:, None], flat[at], _PAD), axis=1)
        terms[:, 1:][(terms[:, 1:] == terms[:, :-1]) & (terms[:, 1:] >= 0)] = _PAD
        yield r, s, terms


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _columns(terms: np.ndarray, width: int) -> np.ndarray:
    """Columns of term numbers, of ``width`` in all, passage by passage in rising order, a column counting once; padding and unknown words stay."""
    t = np.sort(np.where(terms >= 0, terms % width, terms), axis=1)
    t[:, 1:][(t[:, 1:] == t[:, :-1]) & (t[:, 1:] >= 0)] = _PAD
    return t


def _pairs(terms: np.ndarray, width: int) -> np.ndarray:
    """Cells (column times ``width`` plus column) of the pairs of columns of passages, on and above the diagonal."""
    t = np.sort(terms, axis=1).astype(np.int32 if width <= 1 << 15 else np.int64)  # padding and unknown words first
    first = (t < 0).sum(axis=1)
    t = t[np.argsort(first, kind="stable")]
    ends = np.searchsorted(np.sort(first), np.arange(PASSAGE), "right")
    return np.concatenate([(t[:n, a, None] * t.dtype.type(width) + t[:n, a:]).ravel() for a, n in enumerate(ends)])


def _added(cells: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells, sorted and each once, and the sums of their counts."""
    order = np.argsort(cells, kind="stable")  # linear for a few sorted runs
    cells = cells[order]
    cuts = np.flatnonzero(np.diff(cells, prepend=-1))
    return cells[cuts], np.add.reduceat(n[order], cuts) if len(cuts) else n


class _PairCounts:
    """How many passages of a task hold each pair of columns; what is more than _HELD different pairs goes out as rows."""

    def __init__(self, width: int) -> None:
        self.width, self.new, self.size = width, [], 0
        self.cells, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, terms: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(terms), 2048):
            self.new.append(_pairs(terms[lo:lo + 2048], self.width))
            self.size += len(self.new[-1])
            if self.size >= _SORTED:
                self._merge()
                if len(self.cells) > _HELD:
                    yield from self.rows()

    def _merge(self) -> None:
        cells = np.sort(np.concatenate(self.new)) if self.new else np.zeros(0, np.int64)
        cuts = np.flatnonzero(np.diff(cells, prepend=-1))
        n = np.diff(cuts, append=len(cells))
        self.cells, self.n = _added(np.concatenate([self.cells, cells[cuts]]), np.concatenate([self.n, n]))
        self.new, self.size = [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Rows (block, at, n) of at most _ROW cells of one block, ``at`` counted from the block's first cell."""
        self._merge()
        size = _rows_of_block(self.width) * self.width
        block = self.cells // size
        at, cuts = (self.cells - block * size).astype(np.int32), np.flatnonzero(np.diff(block, prepend=-1))
        starts = np.concatenate([np.arange(a, b, _ROW) for a, b in zip(cuts, [*cuts[1:], len(block)])]) if len(block) else cuts
        offsets = pa.array([*starts, len(block)], pa.int32())
        n, self.cells, self.n = self.n, self.cells[:0], self.n[:0]
        if len(starts):
            yield pa.RecordBatch.from_arrays([pa.array(block[starts], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(at)),
                                              pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))], names=["block", "at", "n"])


def _rows_of_block(width: int) -> int:
    return max(1, _CELLS // width)


def _tokenise(docs: DataFrame, terms: dict[str, int], width: int) -> DataFrame:
    """(doc_id, key, ids) of every row, and per task, over its non-overlapping passages, a row of (df, passages) and rows of
    (block, at, n), counts of pairs of columns."""

    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("ids", pa.list_(pa.int32())), ("df", pa.list_(pa.int64())), ("passages", pa.int64()),
                        ("block", pa.int32()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])

    def batch_of(rows: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts:
            yield batch_of(x.num_rows, block=x.column(0), at=x.column(1), n=x.column(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, passages, pairs = np.zeros(width, np.int64), 0, _PairCounts(width)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = []
                for t in part.column(2):
                    w = words_of(t.as_py())
                    found.append(np.fromiter(map(terms.get, w, repeat(-1)), np.int32, len(w)))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
                flat = np.concatenate(found)
                for r, _, t in _windows(flat, offsets, PASSAGE):
                    t = _columns(t, width)
                    df += np.bincount(t[t >= 0], minlength=width)
                    passages += len(r)
                    yield from whole(pairs.add(t))
                yield batch_of(part.num_rows, doc_id=part.column(0), key=part.column(1), ids=pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)))
        yield from whole(pairs.rows())
        if passages:
            yield batch_of(1, df=pa.array([df], pa.list_(pa.int64())), passages=pa.array([passages], pa.int64()))

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text")).mapInArrow(
        run, "doc_id long, key string, ids array<int>, df array<long>, passages long, block int, at array<int>, n array<int>")


def text_key(text):
    """Equal for equal texts; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def _weights(terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.where(terms >= 0, idf[np.maximum(terms, 0)], 0).astype(np.float32)


def _product(terms: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows of A X for passages given by their sorted terms; passages with equally many terms go together."""
    out = np.zeros((len(terms), basis.shape[1]), np.float32)
    terms = np.sort(terms, axis=1)  # padding and unknown words first
    filled = (terms >= 0).sum(axis=1)
    order = np.argsort(filled, kind="stable")
    for lo in range(0, len(order), 256):
        rows = order[lo:lo + 256]
        t = terms[rows, PASSAGE - filled[rows[-1]]:]
        out[rows] = np.matmul(_weights(t, idf)[:, None, :], basis[np.maximum(t, 0)])[:, 0]
    return out


def _transposed(terms: np.ndarray, idf: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """A' y, summed per term over passages sorted by term."""
    w = _weights(terms, idf)
    p, j = np.nonzero(w)
    t = terms[p, j]
    order = np.argsort(t, kind="stable")
    t, p, w = t[order], p[order], w[p, j][order]
    out = np.zeros((n, y.shape[1]), np.float64)
    for lo in range(0, len(t), _TERMS):
        c, rows = t[lo:lo + _TERMS], y[p[lo:lo + _TERMS]]
        rows *= w[lo:lo + _TERMS, None]
        cuts = np.flatnonzero(np.diff(c, prepend=-1))
        out[c[cuts]] += np.add.reduceat(rows, cuts, axis=0)
    return out


def _pair_sums(tokens: DataFrame, width: int) -> DataFrame:
    """(cell, n) of every pair of columns that some passage of the corpus holds, a block's cells together."""
    size = _rows_of_block(width) * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = -1, np.zeros(size, np.int64)

        def ended() -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(total)
            for lo in range(0, len(at), 1 << 16):
                c = at[lo:lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(c + now * size, pa.int64()), pa.array(total[c], pa.int64())], names=["cell", "n"])

        for batch in batches:
            (at, offsets), (n, _) = _flat(batch.column(1)), _flat(batch.column(2))
            for block, lo, hi in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:]):
                if block != now:
                    yield from ended()
                    now = block
                    total[:] = 0
                total[at[lo:hi]] += n[lo:hi]  # a cell is once in a row
        yield from ended()

    parts = tokens.where(F.col("block").isNotNull()).select("block", "at", "n")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(run, "cell long, n long")


def _gram(pairs: DataFrame, idf: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A'A X over all passages from the counts of pairs: every task sends one matrix, FIT_PARTS of them at most."""
    width = len(idf)
    rows = _rows_of_block(width)
    basis = (idf[:, None] * x).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, block, now = np.zeros(basis.shape, np.float64), np.zeros((rows, width), np.float32), -1

        def ended() -> None:
            lo, hi = now * rows, min((now + 1) * rows, width)
            b = block[:hi - lo, lo:]
            total[lo:hi] += b @ basis[lo:]
            np.fill_diagonal(b, 0)  # the other triangle
            total[lo:] += b.T @ basis[lo:hi]

        for batch in batches:
            cell, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = cell // (rows * width)
            cuts = np.flatnonzero(np.diff(at, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(at)]):
                if at[a] != now:
                    if now >= 0:
                        ended()
                    now = int(at[a])
                    block[:] = 0
                block.reshape(-1)[cell[a:b] - now * rows * width] += n[a:b]
        if now >= 0:
            ended()
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["m"])

    sums = pairs.coalesce(FIT_PARTS).mapInArrow(run, "m binary").toLocalIterator()
    return idf[:, None] * sum((np.frombuffer(r["m"], np.float32).reshape(basis.shape).astype(np.float64) for r in sums), np.zeros(basis.shape))


@dataclass
class Index:
    """Latent space: idf of the columns and of unknown words, the basis and its singular values."""

    idf: np.ndarray
    unknown: float
    basis: np.ndarray
    values: np.ndarray


def _own_passages(items: list[list[int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(item, columns) of the passages of items."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)
    own = list(_windows(np.array([t for x in items for t in x], np.int32), offsets, STRIDE))
    return np.concatenate([r for r, _, _ in own]), np.concatenate([_columns(t, width) for _, _, t in own])


def fit(tokens: DataFrame, width: int, blocks: Callable[[], Iterator[Block]]) -> Index:
    """Document frequencies and pairs over all passages, then the randomised SVD; the items are read block by block."""
    counts = tokens.where(F.col("df").isNotNull())
    df = np.zeros(width, np.int64)
    for r in counts.select(F.posexplode("df")).groupBy("pos").agg(F.sum("col").alias("n")).toLocalIterator():
        df[r["pos"]] = r["n"]
    passages = counts.agg(F.sum("passages")).first()[0] or 0
    idf = np.log((1 + passages) / (1 + df)) + 0.1
    unknown = float(np.median(idf))
    pairs = scratch(_pair_sums(tokens, width), "decon-pairs")
    rank = min(RANK + OVERSAMPLE, width)
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((width, rank)))[0]
    for _ in range(2):
        # the benchmark's rows weigh as much as the corpus
        corpus, bench = _gram(pairs, idf, q), np.zeros(q.shape)
        for block in blocks():
            own = _own_passages(block.items, width)[1]
            bench += _transposed(own, idf, _product(own, idf, q.astype(np.float32)), width)
        scale = np.linalg.norm(corpus) / max(np.linalg.norm(bench), 1e-12) or 1.0
        g = corpus + scale * bench
        last, q = q, np.linalg.qr(g)[0]
    # Rayleigh-Ritz on the space of the second pass
    small = last.T @ g
    values, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(values)[::-1][:RANK]
    return Index(idf, unknown, (last @ turn[:, best]).astype(np.float32), np.sqrt(np.maximum(values[best], 0)))


def queries(block: Block, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(item, unit vector) of every passage of a block."""
    owner, own = _own_passages(block.items, len(index.idf))
    z = _product(own, index.idf, index.basis)
    return owner, z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


def _compact(item: list[int], span: list[int], text: np.ndarray) -> bool:
    """Whether some stretch of little more than the item's length holds LCS_LIKELY of the item and LAST_THIRD of the span."""
    size, step = int(STRETCH * len(item)) + 1, max(1, len(item) // 4)
    for at in range(0, max(1, len(text) - size + step), step):
        part = text[at:at + size]
        if lcs(item, part) >= LCS_LIKELY * len(item) and lcs(span, part) >= LAST_THIRD * len(span):
            return True
    return False


def _verify(item: list[int], answer: list[int], told: bool, text: np.ndarray) -> tuple[float, bool, bool]:
    """(LCS share, answer found, contaminated) of an item in the words around a passage."""
    share = lcs(item, text) / len(item)
    if len(item) < SHORT:
        run = text.tolist()
        found = any(run[i:i + len(item)] == item for i in range(len(run) - len(item) + 1))
        return share, found, found
    if told:
        has = lcs(answer, text) >= ANSWER * len(answer)
    else:
        has = share >= LCS_LIKELY and _compact(item, answer, text)
    return share, has, share >= LCS_SURE or (share >= LCS_LIKELY and has)


def _search(tokens: DataFrame, block: Block, index: Index, min_cosine: float) -> DataFrame:
    """(doc_id, key, item, cosine, lcs, answer, start) of every confirmed pair of a document and an item, best place each."""
    items, answers, told = block.items, block.answers, block.told
    longest = max(map(len, items))
    owner, vectors = queries(block, index)
    width = len(index.idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # (A V) Z' = A (V Z'): the cosine with every query is read from the terms' places among the queries
        energy, fold = index.idf ** 2, np.ascontiguousarray(index.basis @ vectors.T)
        for batch in batches:
            flat, offsets = _flat(batch.column(2))
            best: dict[tuple[int, int], list] = {}
            for r, s, t in _windows(flat, offsets, STRIDE):
                t = _columns(t, width)
                inside = np.where(t >= 0, energy[np.maximum(t, 0)], 0).sum(axis=1)
                whole = inside + (t == -1).sum(axis=1) * index.unknown ** 2
                live = np.flatnonzero((inside > 0) & (inside >= min_cosine ** 2 * whole))
                for lo in range(0, len(live), 2048):
                    c = live[lo:lo + 2048]
                    cos = _product(t[c], index.idf, fold) / np.sqrt(whole[c])[:, None]
                    for p, q in zip(*np.nonzero(cos >= min_cosine)):
                        best.setdefault((int(r[c[p]]), int(owner[q])), []).append((int(s[c[p]]), float(cos[p, q])))
            rows = []
            for (r, i), places in best.items():
                places.sort()
                # passages of one pair that lie near each other are one place
                spans, item = [], items[i]
                for s, cosine in places:
                    if spans and s - spans[-1][1] <= longest:
                        spans[-1] = [spans[-1][0], s, max(spans[-1][2], cosine)]
                    else:
                        spans.append([s, s, cosine])
                hits = []
                for a, b, cosine in spans:
                    lo, hi = max(int(offsets[r]), a - len(item)), min(int(offsets[r + 1]), b + PASSAGE + len(item))
                    # pieces of twice the item's length and a passage, so that a long place is no chance match
                    step = len(item) + PASSAGE
                    for at in range(lo, max(hi - step, lo + 1), step):
                        share, has, bad = _verify(item, answers[i], told[i], flat[at:min(at + 2 * step, hi)])
                        if bad:
                            hits.append((share, has, cosine, at - int(offsets[r])))
                if hits:
                    share, has, cosine, at = max(hits)
                    rows.append((r, i, cosine, share, has, at))
            cols = list(zip(*rows)) or [()] * 6
            where = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()),
                                              pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.int64())],
                                             names=["doc_id", "key", "item", "cosine", "lcs", "answer", "start"])

    return tokens.where(F.col("ids").isNotNull()).select("doc_id", "key", "ids").mapInArrow(
        run, "doc_id long, key string, item int, cosine double, lcs double, answer boolean, start long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_cosine: float = MIN_COSINE, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per contaminated document of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text).

    Columns: doc_id, item_id, key (of the text), cosine, lcs, answer, start (word the evidence is
    near to). Null or empty texts and items have no words and match nothing. Repeated rows of a
    document count once per doc_id and text; items that differ in id or text are different items.
    Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = _items(benchmark)
    terms = vocabulary(items)
    blocks = lambda: _blocks(items, terms)
    width = min(len(terms), dimensions)
    tokens = scratch(_tokenise(docs, terms, width), "decon-tokens") if terms else None
    index = fit(tokens, width, blocks) if terms else None
    out = None
    for block in blocks():
        hits = _search(tokens, block, index, min_cosine)
        kind = benchmark.schema["item_id"].dataType
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind.simpleString()}")
        hits = scratch(hits.join(F.broadcast(names), "item").drop("item"), "decon-hits")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], f"doc_id long, item_id {benchmark.schema['item_id'].dataType.simpleString()}, key string, cosine double, lcs double, answer boolean, start long")
    best = F.max(F.struct("lcs", "answer", "cosine", "start")).alias("best")
    return out.groupBy("doc_id", "item_id", "key").agg(best).select(
        "doc_id", "item_id", "key", F.round("best.cosine", 4).alias("cosine"), F.round("best.lcs", 4).alias("lcs"), "best.answer", "best.start")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; rows without an id are judged like any other."""
    bad = scratch(find_leaks(docs, benchmark, min_cosine).select(F.col("key").alias("__key")).distinct(), "decon-bad")
    return docs.join(bad, text_key(docs["text"].cast("string")) == bad["__key"], "left_anti")
