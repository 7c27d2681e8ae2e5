"""Running totals and positions in a global order, without a window that one task has to hold.

Rows are dealt out by ranges of the order, each task sums its own stretch, and the totals of the
stretches (one number per task) become the offsets of those behind. A group may span any number of
tasks; only rows that the order does not tell apart stay together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.session import materialise


def running_totals(df: DataFrame, order: Sequence[Column], value: Column, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with the long column ``name``: the sum of ``value`` over all rows before it in ``order``, within its ``keys``.

    Null values count as zero. Rows that are equal in keys and order come in any order, so pre-aggregate or
    add a column that tells them apart. The result is read from a table in the shared checkpoint folder.
    """
    cols = df.columns
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    dealt = df.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0).cast("long"))).repartitionByRange(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, upto = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(values) + upto
            n = len(values)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - values), pa.array(np.full(n, part, np.int32))], names=[*cols, "_value", "_before", "_part"])
            upto = int(ends[-1]) if n else upto

    schema = T.StructType([*dealt.schema.fields, T.StructField("_before", T.LongType()), T.StructField("_part", T.IntegerType())])
    local = materialise(dealt.mapInArrow(run, schema), "running-totals")
    totals = sorted((r["_part"], r["n"]) for r in local.groupBy("_part").agg(F.sum("_value").alias("n")).collect())
    starts = zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0))
    # one row per task of the writing stage
    offsets = F.broadcast(df.sparkSession.createDataFrame(list(starts), "_part int, _start long"))
    out = local.join(offsets, "_part").withColumn("_before", F.col("_before") + F.col("_start"))
    if keys:
        first = out.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_before").alias("_first"))
        same = [out[k].eqNullSafe(first[f"_k{i}"]) for i, k in enumerate(keys)]
        out = out.join(first, same).withColumn("_before", F.col("_before") - F.col("_first"))
    return out.select(*cols, F.col("_before").alias(name))


def with_positions(df: DataFrame, order: Sequence[Column], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with its place in ``order`` within ``keys``, from 0."""
    return running_totals(df, order, F.lit(1), name, keys)
