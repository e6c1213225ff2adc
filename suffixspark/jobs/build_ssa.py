"""Build the sparse suffix array of a file: python -m suffixspark.jobs.build_ssa -s 3 [-c] [-u] INPUT OUTPUT"""

import argparse
import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suffixspark.operators.compress import compress, header
from suffixspark.operators.suffix_sort import KERNEL_BYTES, full_then_sample, sort_chunks, sort_chunks_then_sample, sparse_suffix_array
from suffixspark.session import cut
from suffixspark.sources.chunks import CHUNK, file_chunks, files_at
from suffixspark.sources.ssa_file import write_ssa

log = logging.getLogger(__name__)


def sorted_file(spark: SparkSession, source: str, n_bytes: int, s: int, optimized: bool, plan: str, kernel_bytes: int) -> DataFrame:
    """rank, pos of a file, or of the files of a folder as one text. What one task can hold is a row, a longer text is sorted from its chunks and no task holds it."""
    if plan == "doubling" or plan == "auto" and n_bytes > kernel_bytes:
        chunks = file_chunks(spark, source, CHUNK, max(62, s), joined=True).drop("path")
        return sort_chunks(chunks, s) if optimized else sort_chunks_then_sample(chunks, s)
    text = file_chunks(spark, source, max(n_bytes, 1), 0, joined=True).select("content")
    return sparse_suffix_array(text, s, plan, kernel_bytes) if optimized else full_then_sample(text, s, plan, kernel_bytes)


def build(spark: SparkSession, source: str, target: str, s: int, compressed: bool = False, optimized: bool = True, plan: str = "auto", kernel_bytes: int = KERNEL_BYTES, joined: bool = False) -> None:
    """Write the suffix array of one file, or (joined) of the files of a folder, in the order of their paths, as one text. Seconds of finding the text, of building and of writing are logged."""
    if not 1 <= s <= 255:
        raise ValueError("the file format holds the sparseness in one byte: 1 to 255")
    began = time.monotonic()
    found = files_at(source)
    if not found or len(found) > 1 and not joined:
        raise FileNotFoundError(source) if not found else ValueError(f"more than one file at {source}: a target holds one suffix array")
    n_bytes, one = sum(f.size for f in found), F.lit(0).alias("one")
    size = spark.createDataFrame([(0, -(-n_bytes // s))], "one int, cells long")
    headers = header(size, s, compressed)
    of = headers.first()
    log.info("found %d bytes in %.2f s", n_bytes, time.monotonic() - began)
    began = time.monotonic()
    sa = cut(sorted_file(spark, source, n_bytes, s, optimized, plan, kernel_bytes).select(one, "rank", "pos"))
    log.info("built the suffix array in %.2f s", time.monotonic() - began)
    began = time.monotonic()
    words = compress(sa, headers, ["one"]) if compressed else sa.select(F.col("rank").alias("word_idx"), F.col("pos").alias("word"))
    write_ssa(words, target, of.bits_per_element, s, of.sa_length)
    log.info("wrote %s in %.2f s", target, time.monotonic() - began)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="build_ssa", description=__doc__)
    parser.add_argument("-s", type=int, required=True, metavar="SPARSENESS", help="keep suffixes that start at every s-th byte")
    parser.add_argument("-c", action="store_true", help="compress the output by bit packing")
    parser.add_argument("-u", action="store_true", help="sort all suffixes first, then sample")
    parser.add_argument("input")
    parser.add_argument("output")
    a = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    build(SparkSession.builder.appName("build_ssa").getOrCreate(), a.input, a.output, a.s, a.c, not a.u)


if __name__ == "__main__":
    main()
