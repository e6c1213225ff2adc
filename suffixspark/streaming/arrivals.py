"""Suffix arrays of texts as they arrive: each micro-batch is sorted and appended. Texts are independent, so no state is kept."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from suffixspark.operators.suffix_sort import sparse_suffix_array
from suffixspark.sources.texts import as_bytes


def watch_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, content), a row per new file."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(folder).select("path", "content")


def suffix_arrays(texts: DataFrame, keys: list[str], column: str, s: int, target: str, checkpoint: str) -> StreamingQuery:
    """Start writing keys, rank, pos of each arriving text to Parquet under target, one folder a batch, so that a repeated batch replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        sparse_suffix_array(as_bytes(df, keys, column), s).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
