"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Fingerprints are taken over word shingles; the candidate search then works on distinct
fingerprints only, so thousands of exact copies are one entry.

*Index.* Two fingerprints that differ in at most two bits agree in at least six of their
eight positional bytes. One posting list per single (position, byte) would hold 1/256 of
the corpus, so a posting is keyed by five positional bytes at a time (56 choices of positions).
*Count filter.* Every posting list that two fingerprints share is counted for the pair. Pairs that agree
in six bytes share six lists, in seven bytes 21, in five only one; pairs below the guaranteed
minimum go, and the rest are verified by the number of differing bits.
*Long lists.* A list of more than ``list_cap`` fingerprints is not expanded into pairs. Its
fingerprints emit themselves and their 64 one-bit neighbours; two fingerprints are within two
bits exactly if they share one of those values, and at most 65 can share one. This is exact
and linear, whatever the size of the group: a pair either shares no long list, then its count is
complete, or both have been in one, then they meet this way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, scratch
from .components import connected_components

SEED = 42
MAX_BITS = 2
SHINGLE = 3
LIST_CAP = 32
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Shingles hashed at a time within one text, so that a long text needs no more memory.
_STEP = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for start in range(0, n, _STEP):
        block = b"".join(map(digest, (g for g, _ in zip(grams, range(min(_STEP, n - start)))), repeat(SEED)))
        bits = np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _text_key(docs: DataFrame) -> Column:
    """Tells texts of one doc_id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fp long) for every row of ``docs`` (doc_id, text); a null text counts as empty, key is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], names=["doc_id", "key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(docs).alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, key long, fp long")


#: Positional bytes of a posting key, and the masks of all choices of so many positions.
KEY_BYTES = 5
_MASKS = [sum(0xFF << 8 * p for p in positions) for positions in combinations(range(8), KEY_BYTES)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def postings(fps: DataFrame) -> DataFrame:
    """(fp, slot, bytes): one row for every choice of KEY_BYTES positions, with the fingerprint's bytes at these."""
    return fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_long(m))) for m in _MASKS])).alias("slot", "bytes"))


def shared_lists(max_bits: int) -> int:
    """Posting lists that two fingerprints of at most so many differing bits share at least."""
    return comb(8 - max_bits, KEY_BYTES)


def links(fps: DataFrame, max_bits: int = MAX_BITS, list_cap: int = LIST_CAP) -> DataFrame:
    """(u, v) over distinct fingerprints (fp): all links, or for long lists stars that join the same classes.

    Every row is a real link of at most two differing bits.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the index guarantees links of at most two differing bits")
    key = ["slot", "bytes"]
    lists = scratch(postings(fps).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "simhash-lists")
    post = scratch(postings(fps).join(lists, key), "simhash-postings")
    short = post.where(F.col("n") <= list_cap).groupBy(*key).agg(F.collect_list("fp").alias("list"))
    met = short.select("list", F.explode("list").alias("a")).select("a", F.explode(F.filter("list", lambda x: x > F.col("a"))).alias("b"))
    tally = met.groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = tally.where((F.col("shared") >= shared_lists(max_bits)) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    long = post.where(F.col("n") > list_cap).select("fp").distinct()
    reach = {0: [], 1: [], 2: range(64)}[max_bits]
    near = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in reach)]
    if max_bits == 1:
        # a link of one bit: both ends emit the value with that bit cleared, tagged by the bit
        near = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(~(1 << i) if i < 63 else (1 << 63) - 1)).alias("x")) for i in range(64)]
    meet = long.select("fp", F.explode(F.array(*near)).alias("mid")).groupBy("mid").agg(F.collect_list("fp").alias("list")).where(F.size("list") > 1)
    stars = meet.select(F.array_min("list").alias("u"), F.explode("list").alias("v")).where("u <> v").distinct()
    return pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(stars)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, list_cap: int = LIST_CAP) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    component_id is the smallest doc_id reachable over links, itself included. Texts without
    words have fingerprint zero and link like any other. Rows with a null doc_id keep their
    fingerprint; they link their neighbours but never name a class of which another row has an
    id, so component_id is null only if no row of the class has an id. Repeated rows are kept.
    Other columns are not read. An empty table gives no rows.
    """
    return _classed(docs, shingle, max_bits, list_cap).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classed(docs: DataFrame, shingle: int, max_bits: int, list_cap: int) -> DataFrame:
    """(doc_id, key, fp, root, component_id) of every row; a root is of one class, a component_id may be of several if ids are repeated."""
    marks = scratch(fingerprints(docs, shingle), "simhash-marks")
    fps = scratch(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    roots = scratch(connected_components(links(fps.select("fp"), max_bits, list_cap)), "simhash-roots")
    # classes of one fingerprint need no join with the links
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    named = scratch(named, "simhash-named")
    ids = named.where("linked").groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.where("linked").select("fp", "root").join(ids, "root").select("fp", "root", "component_id").unionByName(
        named.where("not linked").select("fp", "root", F.col("least").alias("component_id")))
    classes = scratch(classes, "simhash-classes")
    return marks.join(classes, "fp").select("doc_id", "key", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with one row of each class: that of the smallest doc_id.

    Rows of one id with different texts are judged each in its class; of equal rows with that id
    one stays. Rows with a null doc_id cannot be named and stay.
    """
    rows = scratch(_classed(docs, shingle, max_bits, LIST_CAP).where(F.col("doc_id").isNotNull()).groupBy("doc_id", "key", "root", "component_id").agg(
        F.count("*").alias("n")), "simhash-rows")
    # a class may hold several texts of its smallest id: one of them stays
    keep = rows.where(F.col("doc_id") == F.col("component_id")).groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("k")).select("root", "k.*")
    gone = scratch(rows.join(keep, ["root", "doc_id", "key"], "left_anti").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")), "simhash-gone")
    repeated = scratch(rows.where("n > 1").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")), "simhash-repeated")
    named = docs.withColumn("__text", _text_key(docs))
    same = lambda other: (named["doc_id"] == other["__id"]) & (named["__text"] == other["__key"])
    kept = named.join(gone, same(gone), "left_anti")
    # only rows that occur more than once are compared as rows
    once = kept.join(repeated, same(repeated), "left_anti")
    more = kept.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "__text"])
    return once.unionByName(more).drop("__text")
