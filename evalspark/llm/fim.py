"""Fill-in-middle transformation by rotating blocks in place.

A text is scanned once for its tokens and cut at two of their ends into prefix, middle and suffix.
Sentinels are inserted at the cuts of a bytearray, then neighbouring blocks change places by three
reversals: each block is reversed where it stands, then the two together. The inverse finds the
sentinels, rotates the blocks back and deletes the sentinels, which gives the text exactly.

White space and sentinels are ASCII, so scanning and cutting UTF-8 bytes equals doing so over code
points. Work beside the text itself is done in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42
FIM_PERCENT, SPM_PERCENT = 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Bytes scanned or swapped at a time, and bytes of texts sent on at a time.
_PIECE = 1 << 20
_BATCH = 8 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def reverse(buf: bytearray, lo: int, hi: int) -> None:
    """Reverse the bytes of ``buf`` from ``lo`` to ``hi`` where they stand, a piece from either end at a time."""
    while hi - lo > 1:
        n = min((hi - lo) // 2, _PIECE)
        buf[lo:lo + n], buf[hi - n:hi] = buf[hi - n:hi][::-1], buf[lo:lo + n][::-1]
        lo, hi = lo + n, hi - n


def rotate(buf: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchange the blocks ``lo`` to ``mid`` and ``mid`` to ``hi`` by three reversals."""
    reverse(buf, lo, mid)
    reverse(buf, mid, hi)
    reverse(buf, lo, hi)


def _token_ends(data: memoryview) -> Iterator[np.ndarray]:
    """Ends of the tokens of ``data``, piece by piece: a token is a run of words characters with the white space before it.

    White space at the end of the text is a token of its own.
    """
    size = len(data)
    for lo in range(0, size, _PIECE):
        space = _SPACE[np.frombuffer(data[lo:lo + _PIECE + 1], np.uint8)]
        if lo + _PIECE >= size:
            # behind the end, what is last ends: a word as before white space, white space likewise
            ends = np.flatnonzero(~space[:-1] & space[1:]) + lo + 1
            yield np.append(ends, size)
        else:
            yield np.flatnonzero(~space[:-1] & space[1:]) + lo + 1


def _characters(data: memoryview) -> int:
    """Code points of UTF-8 bytes."""
    return sum(int(np.count_nonzero((np.frombuffer(data[lo:lo + _PIECE], np.uint8) & 0xC0) != 0x80)) for lo in range(0, len(data), _PIECE))


def choose(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that depend on the seed and the id alone; a null id has no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i:4 * i + 4], "big") for i in range(4))


def transform(text: bytes, doc_id: int | None, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT):
    """(n, form, prefix_chars, middle_chars, output): the numbers of characters are None in plain form."""
    whole = memoryview(text)
    n = sum(len(ends) for ends in _token_ends(whole))
    h1, h2, h3, h4 = choose(doc_id, seed)
    if not text or h3 % 100 >= fim_percent or any(s in text for s in SENTINELS):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = {0: 0}
    seen = 0
    for ends in _token_ends(whole):
        for k in (first, second):
            if seen < k <= seen + len(ends):
                at[k] = int(ends[k - seen - 1])
        seen += len(ends)
    a, b = at[first], at[second]
    form = "spm" if h4 % 100 < spm_percent else "psm"
    chars = _characters(whole[:a]), _characters(whole[a:b])
    buf = bytearray(text)
    for place, mark in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):
        buf[place:place] = mark
    # now <P> prefix <M> middle <S> suffix
    suffix_at = b + len(PREFIX) + len(MIDDLE)
    rotate(buf, 0 if form == "spm" else a + len(PREFIX), suffix_at, len(buf))
    return n, form, *chars, buf


def restore(output: bytes, form: str | None) -> bytes:
    """The text of which ``output`` was made; the output itself if the form is plain or null."""
    if form not in ("psm", "spm"):
        return output
    buf = bytearray(output)
    if form == "psm":
        # <P> prefix <S> suffix <M> middle
        rotate(buf, buf.index(SUFFIX), buf.index(MIDDLE), len(buf))
    else:
        # <S> suffix <P> prefix <M> middle
        rotate(buf, 0, buf.index(PREFIX), len(buf))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buf.index(mark)
        del buf[at:at + len(mark)]
    return buf


def _batches(rows: Iterator[tuple[int, tuple]], batch: pa.RecordBatch, kept: int, types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size: the first ``kept`` columns of ``batch`` with the new values; a row's size comes first."""
    start, size, values = 0, 0, []
    for i, (n, row) in enumerate(rows):
        values.append(row)
        size += n
        if size >= _BATCH or i + 1 == batch.num_rows:
            new = [pa.array(list(c), t) for c, t in zip(zip(*values), types)]
            yield pa.RecordBatch.from_arrays([c.slice(start, len(values)) for c in batch.columns[:kept]] + new, names=names)
            start, size, values = i + 1, 0, []


def _bytes(x: pa.Scalar) -> bytes:
    return x.as_py() or b""


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (the transformed text) for every row of ``docs`` (doc_id, text).

    n is the number of tokens. A null text counts as empty; empty texts and texts that hold a
    sentinel stay plain, with null character counts. A null doc_id is hashed as no digits. Repeated
    rows come out each, other columns are not read, no rows give no rows. Texts are whole at any length.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = (transform(_bytes(t), i.as_py(), seed, fim_percent, spm_percent) for i, t in zip(*batch.columns))
            yield from _batches(((len(row[-1]), (*row[:-1], bytes(row[-1]))) for row in made), batch, 1, types, names)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restore_texts(made: DataFrame) -> DataFrame:
    """``made`` (form, output and other columns) with the column ``restored``: the text of which each output was made.

    A null output counts as empty; a column ``restored`` of ``made`` is replaced.
    """
    kept = [c for c in made.columns if c != "restored"]
    schema = made.select(*kept).schema.add("restored", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (bytes(restore(_bytes(t), f.as_py())) for f, t in zip(*batch.columns[-2:]))
            yield from _batches(((2 * len(t), (t,)) for t in texts), batch, len(kept), [pa.binary()], [*kept, "restored"])

    out = made.select(*kept, F.col("form").alias("__form"), F.col("output").cast("binary").alias("__output")).mapInArrow(run, schema)
    return out.withColumn("restored", F.col("restored").cast("string"))


def fim_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars with the SHA-256 of the output and of the text restored from it."""
    made = restore_texts(fill_in_middle(docs))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))
