"""evalspark — Spark-native analytics for language-model evaluation data.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from Spark SQL
built-in expressions, so Catalyst can push filters into scans, prune columns and
keep the work inside whole-stage code generation.

Subpackages:

* ``functions``  column expressions (statistics, text, arrays)
* ``sources``    readers for result files, logs, event streams, registries
* ``operators``  joins, aggregations and windows over the evaluation tables
* ``sinks``      report tables and writers
* ``streaming``  Structured Streaming jobs over landing folders
* ``plans``      the query catalogue and the test-data recipes
"""

from evalspark.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
