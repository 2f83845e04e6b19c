"""Binary files in the shared folder, read and written by executors.

Tables go through ``orthoflux.scratch``; files go through ``pyarrow.fs``, so any URI the
cluster uses (``file:``, ``hdfs:``, ``s3:``) works the same way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .. import scratch as _scratch
from ..scratch import drop, free_shuffles, keep, scope, scratch, shared_dir

__all__ = ["attempt", "drop", "free_shuffles", "keep", "materialize", "open_input", "scope", "scratch", "shared_dir", "write_atomically"]


#: Bytes shuffled between two collections: what old plans leave on disk depends on the data, not on the machine's pace.
FREE_BYTES = 128 << 20
_freed = 0


def _shuffled(spark: SparkSession) -> int:
    """Bytes that the executors have written for shuffles so far."""
    told = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(told.apply(i).totalShuffleWrite() for i in range(told.size()))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``scratch.materialize``, after which shuffle files of written plans may go, if much was shuffled: texts pass through several shuffles."""
    global _freed
    out = _scratch.materialize(df, name)
    now = _shuffled(df.sparkSession)
    if not _freed <= now < _freed + FREE_BYTES:  # less: another session
        free_shuffles(df.sparkSession)
        _freed = now
    return out


def attempt() -> str:
    """A name part of the running task attempt: no other attempt, speculative or retried, writes under it.

    A table of the files' names, written by the same task, then lists the files of the
    attempt that was committed; what lost attempts leave is never read.
    """
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}"


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else f"file://{uri}")


def write_atomically(uri: str, write) -> None:
    """Call ``write(stream)`` on a private name, then rename: readers never see half a file."""
    fs, path = _fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(own) as out:
        write(out)
    fs.move(own, path)


def open_input(uri: str):
    """A random-access file."""
    fs, path = _fs(uri)
    return fs.open_input_file(path)
