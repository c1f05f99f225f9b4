"""Binary files through Spark's own writer and any file system.

Spark has no binary sink, but its text sink writes a string column's bytes as
they are and ends each row with a line feed.  A format whose last byte is a
line feed can therefore be written one row per file, with the committer's
guarantees: a lost executor or a repeated task leaves no half-written file.
"""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END = b"\n"


def write_blobs(rows: DataFrame, column: str, path: str) -> None:
    """One file per row of a binary column that lacks its final ``END``."""
    rows.select(F.col(column).cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option(
        "compression", "none"
    ).text(path)


def list_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files in a folder; their content is not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


class RangeReader:
    """Reads byte ranges of one file at a time, wherever it lies."""

    def __init__(self) -> None:
        self.path = None
        self.file = None

    def read(self, path: str, start: int, size: int) -> bytes:
        if path != self.path:
            # Hadoop writes local files as file:/x.
            uri = re.sub(r"^file:/+", "file:///", path)
            system, name = fs.FileSystem.from_uri(uri)
            self.file = system.open_input_file(name)
            self.path = path
        self.file.seek(start)
        return self.file.read(size)
