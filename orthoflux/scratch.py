"""Tables kept between steps of iterative operators, in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_made: list[tuple[SparkSession, str]] = []
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a fresh folder is set only where it is unset and the master is local (tests)."""
    base = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{KEY} must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="orthoflux-")
        spark.conf.set(KEY, base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """URI of a new folder for one run of one operator."""
    uri = f"{shared_dir(spark)}/orthoflux/{name}-{uuid.uuid4().hex}"
    _made.append((spark, uri))
    for held in getattr(_scopes, "stack", [])[-1:]:
        held.append(uri)
    return uri


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends here and survives lost executors."""
    spark = df.sparkSession
    uri = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files that no live plan refers to; worth its two collections after large shuffles only.

    The threads that wait for the next event hold the last one, and with it the plan that ended: a small job takes its place.
    """
    gc.collect()
    spark.range(1).collect()
    with contextlib.suppress(Exception):  # events may be late: then some files go the next time
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Folders that this thread makes inside are deleted at the end, unless taken out of the list (see ``keep``).

    What is lazy and reads them must have been written by then.
    """
    stack = _scopes.stack = getattr(_scopes, "stack", [])
    own: list[str] = []
    stack.append(own)
    try:
        yield own
    finally:
        stack.pop()
        drop(spark, own)


def keep(df: DataFrame, name: str, own: list[str]) -> DataFrame:
    """``materialize`` for a result that outlives the scope ``own``: it belongs to the scope around it."""
    before = len(own)
    out = materialize(df, name)
    uris = own[before:]
    del own[before:]
    stack = _scopes.stack
    for held in stack[-2:-1] if stack and stack[-1] is own else ():
        held.extend(uris)
    return out


def drop(spark: SparkSession, uris: list[str]) -> None:
    """Delete scratch folders; call once nothing that reads them will run again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for uri in uris:
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(conf).delete(path, True)
    _made[:] = [x for x in _made if x[1] not in uris]


@atexit.register
def _at_exit() -> None:
    for spark, uri in list(_made):
        with contextlib.suppress(Exception):  # session or store may be gone by now
            drop(spark, [uri])
