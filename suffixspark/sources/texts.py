"""Texts as (key..., content BINARY) rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from suffixspark.operators.running import running_total


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, bytes kept as they are, line ends included."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def as_bytes(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The working form: keys and content. Strings become UTF-8 bytes; null texts give no rows."""
    binary = isinstance(df.schema[column].dataType, T.BinaryType)
    content = F.col(column) if binary else F.encode(F.col(column), "UTF-8")
    return df.select(*keys, content.alias("content")).filter(F.col("content").isNotNull())


def sized(df: DataFrame, s: int) -> DataFrame:
    """n_bytes of each text and the number of sampled positions (cells)."""
    keys = [c for c in df.columns if c != "content"]
    n = F.octet_length("content").cast("bigint")
    return df.select(*keys, n.alias("n_bytes"), F.expr(f"(octet_length(content) + {s - 1}L) div {s}L").alias("cells"))


def symbols(df: DataFrame) -> DataFrame:
    """A row per byte: keys, pos, byte."""
    keys = [c for c in df.columns if c != "content"]
    pairs = F.posexplode(F.regexp_extract_all(F.hex("content"), F.lit(".."), F.lit(0))).alias("pos", "h")
    return df.select(*keys, pairs).select(*keys, F.col("pos").cast("bigint").alias("pos"), F.conv("h", 16, 10).cast("bigint").alias("byte"))


def joined_symbols(df: DataFrame, order: str, separator: bytes, end: bytes) -> DataFrame:
    """The bytes of all texts, in the order of one column, as one text: separator between texts, end after the last.

    The joined text never exists as a value: a row (pos, byte) is at the running total of the lengths before it."""
    last = df.agg(F.max(order).alias("last"))
    whole = df.join(F.broadcast(last)).select(  # one row
        order, F.concat("content", F.when(F.col(order) == F.col("last"), F.lit(bytearray(end))).otherwise(F.lit(bytearray(separator)))).alias("content")
    )
    start = running_total(whole.select(order, F.octet_length("content").cast("bigint").alias("n")), [order], "n", "start")
    at = start.select(order, "start")
    return symbols(whole).join(at, order).select((F.col("start") + F.col("pos")).alias("pos"), "byte")
