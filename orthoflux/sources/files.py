"""Shared by the file formats: binary files as rows, atomic writes by URI."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def binary(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of every file at a path Spark can reach; one file is one row."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_file(uri: str, data: bytes) -> None:
    """Write under a private name, then rename: retried tasks replace the file by equal bytes."""
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else f"file://{uri}")
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, path)


def read_file(uri: str) -> bytes:
    """The whole file."""
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else f"file://{uri}")
    with fs.open_input_file(path) as file:
        return file.read()
