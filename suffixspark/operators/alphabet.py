"""Symbols of a text: frequency, dense rank, and the bits they need."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from suffixspark.functions import bits_for_alphabet


def symbol_frequency(df: DataFrame) -> DataFrame:
    """keys, byte, cnt for every byte value that occurs. At most 256 rows leave a text, so nothing is shuffled."""
    keys = [c for c in df.columns if c != "content"]
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("byte", T.LongType()), T.StructField("cnt", T.LongType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [np.bincount(np.frombuffer(b, np.uint8), minlength=256) for b in pdf["content"]]
            table = np.stack(found) if found else np.zeros((0, 256), np.int64)
            row, byte = np.nonzero(table)
            yield pdf[keys].iloc[row].reset_index(drop=True).assign(byte=byte.astype(np.int64), cnt=table[row, byte])

    return df.mapInPandas(count, schema)


def alphabet_rank(df: DataFrame) -> DataFrame:
    """keys, byte, rank: the order of a byte among those that occur in its text, from 0."""
    keys = [c for c in df.columns if c != "content"]
    w = Window.partitionBy(*keys).orderBy("byte")  # at most 256 rows a key
    return symbol_frequency(df).select(*keys, "byte", (F.row_number().over(w) - 1).cast("bigint").alias("rank"))


def kernel(s: int, bits) -> F.Column:
    """The width a text is packed to: raw bytes for s = 1, else the least of 8, 16 and 32 bits, else wide (62-bit pieces)."""
    if s == 1:
        return F.lit("raw")
    return F.when(bits <= 8, "packed8").when(bits <= 16, "packed16").when(bits <= 32, "packed32").otherwise("wide")


def alphabet_bits(df: DataFrame, s: int) -> DataFrame:
    """keys, alphabet_size, bits_per_char, required_bits (for s symbols) and kernel."""
    keys = [c for c in df.columns if c != "content"]
    sizes = symbol_frequency(df).groupBy(*keys).agg(F.count("*").alias("alphabet_size"))
    bits = sizes.withColumn("bits_per_char", bits_for_alphabet(F.col("alphabet_size"))).withColumn("required_bits", F.col("bits_per_char") * s)
    return bits.withColumn("kernel", kernel(s, F.col("required_bits")))


def fixed_ranks(symbols: DataFrame) -> DataFrame:
    """rank_aa and rank_dna of each (…, pos, byte) row: two fixed alphabets. rank_dna doesn't keep the order of $ and A, so it isn't used for packing."""
    b = F.col("byte")
    # ASCII of $ - A C G T are 36 45 65 67 71 84.
    aa = F.when(b == 36, 0).when(b == 45, 1).otherwise(b - 65 + 2).cast("bigint")
    dna = F.when(b == 67, 1).when(b == 71, 2).when(b == 84, 3).otherwise(0).cast("bigint")
    return symbols.withColumn("rank_aa", aa).withColumn("rank_dna", dna).drop("byte")
