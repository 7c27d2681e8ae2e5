"""Helpers shared by the operators: scratch tables, reading, small expressions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.session import checkpoint_dir

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, in folders by the columns ``parts`` if there are any, and read it back: lineage ends there."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda variable is never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


#: Characters of a class's sampled training texts, per row it may have.
TRAIN_CHARS = 16_384


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, extra: Sequence[str] = (), max_chars: int | None = None) -> DataFrame:
    """(text, label, h) and the columns ``extra`` of ``docs``: at most ``per_class`` labelled rows of each class, none held out.

    The sample is the rows with the smallest hashes of their ids, so it is the same on
    every run and does not depend on the partitioning. Repeated ids count once. Texts are whole:
    rows are taken while the characters of their class are at most ``max_chars`` (``per_class`` times
    TRAIN_CHARS), and a text that alone has more is passed over, so the sample can be fetched to the driver.
    """
    max_chars = per_class * TRAIN_CHARS if max_chars is None else max_chars
    y = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where(
        F.col("_y").isin(0, 1) & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    y = y.withColumn("_h", F.xxhash64("_id"))
    picked = None
    for c in (0, 1):
        part = y.where(F.col("_y") == c).orderBy("_h", "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    d = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"), *extra)
    # at most 2 * per_class rows are broadcast; a repeated document counts once
    found = scratch(d.join(F.broadcast(picked), "_id").dropDuplicates(["_id"]), "training-texts")
    # the sums are over numbers of characters, of per_class rows at most
    sizes = found.select("_id", "_y", "_h", F.length("text").cast("long").alias("_n")).where(F.col("_n") <= max_chars)
    total = F.sum("_n").over(Window.partitionBy("_y").orderBy("_h", "_id"))
    fits = sizes.select("_id", total.alias("_total")).where(F.col("_total") <= max_chars)
    return found.join(F.broadcast(fits), "_id", "left_semi").select("text", *extra, F.col("_y").alias("label"), F.col("_h").alias("h"))
