"""Column expressions shared by the operators."""

from suffixspark.functions.bits import bit_width, bits_for_alphabet, ceil_div

__all__ = ["bit_width", "bits_for_alphabet", "ceil_div"]
