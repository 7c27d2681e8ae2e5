"""Explicit input spreading for local runs.

The test tables are single row groups, which one task reads however many cores there
are. A local bench may ask for a round-robin spread of such scans; nothing is decided
from sizes, and without the setting the plan is left as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Session setting with the number of partitions of spread scans; unset or 0: no spreading.
SPREAD_CONF = "spark.evalspark.spread"


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the session asks for, or unchanged."""
    n = int(df.sparkSession.conf.get(SPREAD_CONF, "0"))
    return df.repartition(n) if n > 0 else df
