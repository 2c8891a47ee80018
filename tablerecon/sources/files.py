"""Files as Spark lists them, opened from Python where they lie."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemes that are opened from Python, and the name it has for them.
_OPENED = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def _scheme(path: str) -> str:
    return path.partition(":")[0].lower() if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else "file"


def _local(path: str) -> str | None:
    return re.sub(r"^file:(//(?=/))?", "", path) if _scheme(path) == "file" else None


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(_OPENED[_scheme(path)] + path[path.index(":") :])


def open_binary(path: str):
    """A file as Spark names it, open for random access from Python."""
    if local := _local(path):
        return open(local, "rb")
    system, inner = _store(path)
    return io.BufferedReader(system.open_input_file(inner), 1 << 20)


def create_binary(path: str):
    """A new file, open for writing; its folder is made if it is not there."""
    if local := _local(path):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "wb")
    system, inner = _store(path)
    return system.open_output_stream(inner)


def opened(path: str, content: bytes | None):
    """The file itself, or the content that Spark has read for it."""
    return open_binary(path) if content is None else io.BytesIO(content)


def listed(spark: SparkSession, paths: Sequence[str], through_spark: bool | None = None) -> DataFrame:
    """path, length, and content where Python cannot open the store itself (null otherwise).

    ``through_spark`` says that it cannot; by default the scheme tells.
    """
    files = spark.read.format("binaryFile").load(list(paths))
    if through_spark is None:
        through_spark = any(_scheme(p) not in _OPENED for p in files.inputFiles()[:1])
    return files.select("path", "length", "content" if through_spark else F.lit(None).cast("binary").alias("content"))
