"""A graph of stages in which a failing Spark job becomes an error text and only its dependents are skipped.

A stage makes one table. It is written to the shared checkpoint folder as the stage runs, so what fails in it fails
there, on the driver or in any of its tasks, and not later when someone reads the table. A stage whose need has
failed is skipped without an error of its own; stages that do not need it go on.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.session import materialise

OK, FAILED, SKIPPED, OFF = "ok", "failed", "skipped", "off"


@dataclass(frozen=True)
class Stage:
    """One stage: ``make`` gets the tables of its ``needs`` by name and returns its own, or None if it has none.

    ``report_as`` names the column of its error (``<report_as>_error``); it is the stage's name if not given.
    """

    name: str
    make: Callable[[Mapping[str, DataFrame]], DataFrame | None]
    needs: Sequence[str] = ()
    enabled: bool = True
    report_as: str | None = None


@dataclass
class Outcome:
    """Tables of the stages that ran, and per stage its status and error text."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    status: dict[str, str] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, status, error), one row per stage in the order of running."""
        rows = [(name, status, self.errors.get(name)) for name, status in self.status.items()]
        return spark.createDataFrame(rows, "stage string, status string, error string")


def error_text(error: BaseException) -> str:
    """``Type: message``. An error that a task raised is named by its condition, not by the job that it ended, and a
    message that an expression raised on purpose stays whole; of others the first line is told."""
    if isinstance(error, PySparkException) and error.getCondition():
        told = (error.getMessageParameters() or {}).get("errorMessage") if error.getCondition() == "USER_RAISED_EXCEPTION" else None
        message = told if told is not None else str(error).splitlines()[0].partition("] ")[2]
        return f"{error.getCondition()}: {message.partition(' SQLSTATE:')[0].strip()}"
    return f"{type(error).__name__}: {(str(error).splitlines() or [''])[0]}"


def run_stages(stages: Sequence[Stage]) -> Outcome:
    """Run the stages in the given order, in which needs come before those that need them."""
    out = Outcome()
    for stage in stages:
        unknown = [n for n in stage.needs if n not in out.status]
        if unknown:
            raise ValueError(f"stage {stage.name!r} comes before what it needs: {', '.join(unknown)}")
        if stage.name in out.status:
            raise ValueError(f"two stages are named {stage.name!r}")
        if not stage.enabled:
            out.status[stage.name] = OFF
        elif any(out.status[n] in (FAILED, SKIPPED) for n in stage.needs):
            out.status[stage.name] = SKIPPED
        else:
            try:
                table = stage.make({n: out.tables[n] for n in stage.needs if n in out.tables})
                if table is not None:
                    out.tables[stage.name] = materialise(table, f"stage-{stage.name}")
                out.status[stage.name] = OK
            except Exception as error:  # a stage may fail in any way; its text is the result
                out.status[stage.name] = FAILED
                out.errors[stage.name] = error_text(error)
    return out


def with_stage_errors(models: DataFrame, outcome: Outcome, stages: Sequence[Stage]) -> DataFrame:
    """``models`` with a column ``<stage>_error`` for every stage that failed: the text, the same for all models of the graph."""
    named = {s.name: s.report_as or s.name for s in stages}
    return models.withColumns({f"{named[n]}_error": F.lit(text) for n, text in outcome.errors.items()})
