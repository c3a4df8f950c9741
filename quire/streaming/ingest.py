"""A stream of book files into sections: the row-local readers work on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.sources.readers import parse


def stream_books(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return parse(spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path))
