"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces and their log scores come from a SentencePiece model file, whose path is a parameter. The
trie is built once on the driver and sent to the tasks; its size is that of the vocabulary. A text is
cut where no piece can cross (before a run of white-space markers and around characters that
are in no piece), and the parts are encoded many at a time: all matches of all pieces at all
positions by walking the trie with arrays, then the best path, left to right, for all parts at once.
Equal parts are encoded once per Python worker as long as they are in its bounded cache.

A path's score is the sum of its pieces' scores; of equal paths the one whose last piece is longest
wins. A character without a piece of its own may be unknown at the least score minus 10; with byte
fallback it becomes its UTF-8 bytes.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_SURFACE = " ⁇ "
_PENALTY = 10.0
#: Piece kinds of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Parts a worker remembers, characters of texts encoded at a time, and characters of parts whose matches are held at a time.
CACHE_PARTS = 200_000
_CHUNK = 1 << 18
_LEARN = 1 << 16


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        at += 1
        out |= (byte & 127) << shift
        if byte < 128:
            return out, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


class DoubleArray:
    """Trie over bytes in three arrays: a child of ``node`` by byte c is ``base[node] + c`` if its ``check`` is ``node``."""

    def __init__(self, keys: Sequence[bytes], values: Sequence[int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in zip(keys, values):
            if not key or 0 in key:
                raise ValueError("a piece must have bytes, none of them zero")
            node = 0
            for c in key:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = nxt
            value[node] = v
        size = 4 * len(children) + 4096
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = np.zeros(size, bool)
        taken[0] = True
        tail, todo = 1, [(0, 0)]
        for node, slot in todo:  # grows while it is walked: breadth first
            kids = np.array(sorted(children[node]), np.int64)
            if not len(kids):
                continue
            if tail + 1024 > len(taken):
                more = len(taken)
                taken = np.concatenate([taken, np.zeros(more, bool)])
                self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
                self.check, self.value = (np.concatenate([x, np.full(more, -1, np.int32)]) for x in (self.check, self.value))
            # first fit among the last slots in use, else behind them
            first = max(1, tail - 512 - int(kids[0]))
            clash = np.zeros(768, bool)
            for c in kids:
                clash |= taken[first + c:first + c + 768]
            at = first + int(np.argmin(clash)) if not clash.all() else tail
            self.base[slot] = at
            taken[at + kids] = True
            tail = max(tail, at + int(kids[-1]) + 1)
            for c in kids.tolist():
                self.check[at + c], self.value[at + c] = slot, value[children[node][c]]
                todo.append((children[node][c], at + c))
        last = int(np.flatnonzero(self.check >= 0).max(initial=0)) + 257
        self.base, self.check, self.value = (np.ascontiguousarray(a[:max(last, 600)]) for a in (self.base, self.check, self.value))


@dataclass
class Vocabulary:
    """Pieces of a model and how texts are prepared; ``key`` tells vocabularies apart."""

    key: str
    pieces: list[tuple[str, float, int]]
    byte_fallback: bool = False
    add_prefix: bool = True
    squeeze: bool = False
    trie: DoubleArray = field(init=False)

    def __post_init__(self) -> None:
        self.scores = np.array([s for _, s, _ in self.pieces], np.float64)
        usable = [(p.encode(), i) for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)]
        normal = [s for _, s, kind in self.pieces if kind == NORMAL] or [0.0]
        for i, (p, _, kind) in enumerate(self.pieces):
            if kind == USER_DEFINED:
                self.scores[i] = len(p.encode()) * max(normal) - 0.1
        self.unknown_score = min(normal) - _PENALTY
        self.unknown = next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for i, (p, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.trie = DoubleArray([p for p, _ in usable], [i for _, i in usable])
        surface = [self._surface(p, kind) for p, _, kind in self.pieces]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        texts = [p for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED)]
        known = set("".join(texts)) | {MARK}
        inner = "".join(re.escape(c) for c in sorted(known - {MARK})) or "\\0"
        # a piece with a marker behind another character would cross the cut
        crossing = any(MARK in p.lstrip(MARK) for p in texts)
        self.parts = re.compile(rf"[^{inner}{MARK}]|[{inner}{MARK}]+" if crossing else rf"{MARK}+[{inner}]*|[{inner}]+|[^{inner}{MARK}]", re.S)

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return (UNKNOWN_SURFACE if kind == UNKNOWN else piece.replace(MARK, " ")).encode()


def load(path: str = MODEL) -> Vocabulary:
    """Read a SentencePiece model file. Models that rewrite characters, or mark word ends, are refused."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            d = dict(_fields(value))
            pieces.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    if normalizer.get(2) or trainer.get(24):
        raise ValueError("only models with identity normalisation and markers before words are supported")
    return Vocabulary(path, pieces, bool(trainer.get(35, 0)), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))


def prepare(text: str, vocab: Vocabulary) -> str:
    """Markers for spaces, with the leading one the model asks for; an empty text stays empty."""
    if vocab.squeeze:
        text = re.sub(" +", " ", text.strip(" "))
    return (" " + text if vocab.add_prefix and text else text).replace(" ", MARK)


def viterbi(parts: Sequence[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all parts one after the other, and how many each part has."""
    trie = vocab.trie
    raw = [p.encode("utf-8", "surrogatepass") for p in parts]
    buf = np.frombuffer(b"\0".join(raw) + b"\0" * 2, np.uint8)
    size = np.array([len(r) for r in raw], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    word = np.repeat(np.arange(len(raw)), size)          # part of every byte
    where = np.arange(len(word)) + word                  # its place in the buffer
    first = (buf[where] & 0xC0) != 0x80
    starts, owner = where[first], word[first]
    # every match of every piece at every character
    pos, node, depth, found = starts, np.zeros(len(starts), np.int64), 0, []
    while len(pos):
        nxt = trie.base[node] + buf[pos + depth].astype(np.int64)
        ok = (trie.check[nxt] == node) & (buf[pos + depth] != 0)
        pos, node = pos[ok], nxt[ok]
        depth += 1
        hit = trie.value[node] >= 0
        if hit.any():
            found.append((pos[hit], np.full(int(hit.sum()), depth, np.int64), trie.value[node[hit]].astype(np.int64)))
    lead = buf[starts]
    width = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    whole = np.zeros(len(buf) + 1, np.int64)
    whole[starts] = width
    alone = np.zeros(len(buf) + 1, bool)
    for s, d, _ in found:
        alone[s[whole[s] == d]] = True
    odd = ~alone[starts]
    found.append((starts[odd], width[odd], np.full(int(odd.sum()), -1, np.int64)))
    s, d, piece = (np.concatenate(x) for x in zip(*found))
    gain = np.where(piece >= 0, vocab.scores[piece], vocab.unknown_score)
    part = np.zeros(len(buf) + 1, np.int64)
    part[starts] = owner
    ahead = s - begin[part[s]]                           # bytes of the part before the match
    order = np.argsort(ahead, kind="stable")
    s, d, piece, gain = s[order], d[order], piece[order], gain[order]
    end = s + d
    cuts = np.flatnonzero(np.diff(ahead[order], prepend=-1, append=-1))
    best, back = np.full(len(buf) + 1, -np.inf), np.zeros(len(buf) + 1, np.int64)
    best[begin] = 0.0
    for lo, hi in zip(cuts[:-1], cuts[1:]):              # matches that start equally far into their part end in different places
        total, to = best[s[lo:hi]] + gain[lo:hi], end[lo:hi]
        better = total > best[to]
        best[to[better]] = total[better]
        back[to[better]] = lo + np.flatnonzero(better)
    # walk back from the ends of all parts
    spend = np.where((piece < 0) & vocab.byte_fallback, d, 1)
    now, live, steps = begin + size, np.flatnonzero(size > 0), []
    while len(live):
        edge = back[now[live]]
        steps.append((live, edge))
        now[live] = s[edge]
        live = live[now[live] > begin[live]]
    count = np.zeros(len(raw), np.int64)
    for live, edge in steps:
        count[live] += spend[edge]
    out = np.empty(int(count.sum()), np.int32)
    at = np.cumsum(count)
    for live, edge in steps:
        at[live] -= spend[edge]
        known = piece[edge] >= 0
        out[at[live[known]]] = piece[edge[known]]
        if not known.all():
            odd, place = edge[~known], at[live[~known]]
            if vocab.byte_fallback:
                for j in range(int(d[odd].max())):
                    has = d[odd] > j
                    out[place[has] + j] = vocab.byte_ids[buf[s[odd[has]] + j]]
            else:
                out[place] = vocab.unknown
    return out, count


def _slices(parts: list[str]) -> Iterator[list[str]]:
    """``parts`` in order, some at a time: of _LEARN characters at most, or one part."""
    first = size = 0
    for i, p in enumerate(parts):
        if size and size + len(p) > _LEARN:
            yield parts[first:i]
            first, size = i, 0
        size += len(p)
    if first < len(parts):
        yield parts[first:]


class Encoder:
    """Encodes texts with a bounded cache of parts."""

    def __init__(self, vocab: Vocabulary, limit: int = CACHE_PARTS):
        self.vocab, self.limit = vocab, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.at, self.len = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, parts: list[str]) -> None:
        new = [p for p in dict.fromkeys(parts) if p not in self.index]
        if new and self.index and len(self.index) + len(new) > self.limit:
            self.clear()
            new = list(dict.fromkeys(parts))
        if new:
            ids, count = map(np.concatenate, zip(*(viterbi(x, self.vocab) for x in _slices(new))))
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(count) - count])
            self.len = np.concatenate([self.len, count])
            self.ids = np.concatenate([self.ids, ids])

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets between texts."""
        split = [self.vocab.parts.findall(prepare(t, self.vocab)) for t in texts]
        parts = [p for x in split for p in x]
        self._learn(parts)
        index = np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))
        ids, sizes = _gather(self.ids, self.at[index], self.len[index]), self.len[index]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        offsets = upto[np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)]
        if not self.vocab.byte_fallback:
            # neighbouring unknown characters are one unknown piece
            lone = np.ones(len(ids), bool)
            lone[1:] = (ids[1:] != self.vocab.unknown) | (ids[:-1] != self.vocab.unknown)
            lone[offsets[:-1][offsets[:-1] < len(ids)]] = True
            offsets = np.concatenate([[0], np.cumsum(lone)])[offsets]
            ids = ids[lone]
        return ids, offsets


def _gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``at``, one after the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(at - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def decode_all(ids: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> list[bytes]:
    """UTF-8 bytes of every text: pieces joined, markers as spaces, byte pieces as bytes, without the leading space."""
    ids = ids.astype(np.int64)
    size = vocab.surface_len[ids]
    data = _gather(vocab.surface, vocab.surface_at[ids], size).tobytes()
    upto = np.concatenate([[0], np.cumsum(size)])[offsets].tolist()
    out = [data[a:b] for a, b in zip(upto[:-1], upto[1:])]
    return [x[1:] if x.startswith(b" ") else x for x in out] if vocab.add_prefix else out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocab: Vocabulary) -> Encoder:
    """The worker's encoder of this vocabulary, with what it has learnt in earlier tasks."""
    if vocab.key not in _ENCODERS:
        _ENCODERS[vocab.key] = Encoder(vocab)
    return _ENCODERS[vocab.key]


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    texts, first, size = [], 0, 0
    for i, x in enumerate(column):
        texts.append(x.as_py() or "")
        size += len(texts[-1])
        if size >= _CHUNK:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts


def encode(docs: DataFrame, path: str = MODEL, text_col: str = "text", keep: Sequence[str] | None = None, check: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with token_ids array<int> and n_tokens, and round_trip if ``check``.

    Columns of ``docs`` with those names are replaced; repeated rows are encoded each.

    Null and empty texts have no ids. round_trip tells whether decoding the ids gives the text
    back; that fails only for texts that hold the marker character itself (it comes back as a space).
    """
    vocab = load(path)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("token_ids", "n_tokens", "round_trip")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocab)
        for batch in batches:
            for first, texts in _chunks(batch.column(batch.num_columns - 1)):
                ids, offsets = encoder(texts)
                cols = [c.slice(first, len(texts)) for c in batch.columns[:-1]]
                cols += [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(offsets), pa.int64())]
                if check:
                    back = decode_all(ids, offsets, vocab)
                    cols.append(pa.array([b == t.encode("utf-8", "surrogatepass") for b, t in zip(back, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, "token_ids", "n_tokens", *["round_trip"] * check])

    schema = docs.select(*kept).schema.add("token_ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long")
    return docs.select(*kept, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema.add("round_trip", "boolean") if check else schema)


def decode(tokens: DataFrame, path: str = MODEL, ids_col: str = "token_ids") -> DataFrame:
    """``tokens`` with the ids replaced by decoded ``text``; null ids give an empty text, bytes that are no UTF-8 become U+FFFD."""
    vocab = load(path)
    kept = [c for c in tokens.columns if c not in (ids_col, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.as_py() or [] for x in batch.column(batch.num_columns - 1)]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            flat = np.array([i for r in rows for i in r], np.int64)
            texts = [b.decode("utf-8", "replace") for b in decode_all(flat, offsets, vocab)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, "text"])

    return tokens.select(*kept, F.col(ids_col).alias("__ids")).mapInArrow(run, tokens.select(*kept).schema.add("text", "string"))
