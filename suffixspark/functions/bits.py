"""Integer bit arithmetic as column expressions (no floating logarithms: they round wrongly from 2^29 on)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_width(x: Column) -> Column:
    """Bits needed to write x >= 1; 1 for 0."""
    return F.length(F.bin(x.cast("bigint"))).cast("bigint")


def bits_for_alphabet(k: Column) -> Column:
    """ceil(log2(k)): bits that hold k different ranks, 0 for up to one."""
    return F.when(k <= 1, F.lit(0).cast("bigint")).otherwise(bit_width(k - 1))


def ceil_div(x: Column, by: int) -> Column:
    return F.floor((x + (by - 1)) / by).cast("bigint")
