"""Sparse suffix arrays over tables of byte texts, as Spark jobs."""
