"""Folders of files as entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import read_file

ENTRY = "entry_id string, path string, source_type string, title string, description string, content string, tags array<string>, error string"
_PARSED = "path string, source_type string, title string, description string, content string, tags array<string>, error string"


def parse(files: DataFrame) -> DataFrame:
    """Files (path, content) as entries; an archive gives an entry for each member. Ids follow from paths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [e for p, c in zip(batch["path"], batch["content"], strict=True) for e in read_file(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "source_type", "title", "description", "content", "tags", "error"])

    found = files.select("path", "content").mapInPandas(run, _PARSED)
    return found.select(F.substring(F.sha2("path", 256), 1, 32).alias("entry_id"), *found.columns)


def read_folder(spark: SparkSession, path: str, most_bytes: int = 50 << 20, glob: str | None = None) -> DataFrame:
    """Entries of all files below a folder that are not too large."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return parse(reader.load(path).filter(F.col("length") <= most_bytes))


def stream_folder(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """The same as a stream of the files that come in."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files).load(path)
    return parse(rows)
