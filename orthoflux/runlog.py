"""What a run did: steps, rows, elapsed time and throughput."""

from __future__ import annotations

import contextlib
import logging
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from .sources.files import write_file

logger = logging.getLogger("orthoflux")


@dataclass
class Step:
    """A finished step; ``rows`` is None where none were noted."""

    name: str
    seconds: float
    rows: int | None = None

    def wrote(self, table: DataFrame) -> DataFrame:
        """``table`` as written by this step, its rows noted."""
        self.rows = table.count()
        return table

    @property
    def per_second(self) -> float | None:
        return None if self.rows is None or self.seconds <= 0 else self.rows / self.seconds

    def __str__(self) -> str:
        rate = "" if self.per_second is None else f", {self.rows} rows, {self.per_second:.0f} rows/s"
        return f"{self.name}: {elapsed(self.seconds)}{rate}"


def elapsed(seconds: float) -> str:
    """Hours, minutes and whole seconds."""
    return str(timedelta(seconds=int(seconds)))


class RunLog:
    """Steps of one run, told to the logger as they end and written as a file at the end.

    Rows are those of the table that a step wrote: Parquet footers hold the counts, so
    the log scans nothing and tasks that Spark runs again count once.  (``observe`` is
    not used: once it ran in a session, fitted forests can no longer be serialised, as
    their summary refers to the session.)
    """

    def __init__(self) -> None:
        self.steps: list[Step] = []

    @contextlib.contextmanager
    def step(self, name: str) -> Iterator[Step]:
        begin, this = time.monotonic(), Step(name, 0.0)
        try:
            yield this
        except Exception:
            logger.error("%s failed after %s", name, elapsed(time.monotonic() - begin))
            raise
        this.seconds = time.monotonic() - begin
        self.steps.append(this)
        logger.info("%s", this)

    def table(self, spark: SparkSession) -> DataFrame:
        """``(step, seconds, elapsed, rows, rows_per_second)`` in order of the run."""
        rows = [(s.name, s.seconds, elapsed(s.seconds), s.rows, s.per_second) for s in self.steps]
        return spark.createDataFrame(rows, "step string, seconds double, elapsed string, rows long, rows_per_second double")

    def write(self, uri: str) -> None:
        """One line a step, total last."""
        total = f"total: {elapsed(sum(s.seconds for s in self.steps))}"
        write_file(uri, "".join(f"{line}\n" for line in [*map(str, self.steps), total]).encode())
