"""Data source "ssa": a suffix array as one binary file, written in parallel and read back.

Layout, little-endian: bits per element (1 byte), sparseness (1 byte), element count (8 bytes), then 64-bit words.
The path must be on a file system that all executors mount: each task writes its words at their own offset.

    words.select("word_idx", "word").write.format("ssa").option("path", p).option("bits", 10).option("sparseness", 3).option("length", 334).mode("overwrite").save()
    spark.read.format("ssa").load(p)    # word_idx, word
"""

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEADER = struct.Struct("<BBQ")
WORDS_PER_TASK = 1 << 20


def read_header(path: str) -> tuple[int, int, int]:
    """bits per element, sparseness, element count."""
    with open(path, "rb") as f:
        return HEADER.unpack(f.read(HEADER.size))


class SsaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ssa"

    def schema(self) -> str:
        return "word_idx long, word long"

    def reader(self, schema) -> "SsaReader":
        return SsaReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> "SsaWriter":
        return SsaWriter(self.options)


@dataclass
class Words(InputPartition):
    start: int
    count: int


class SsaReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Words]:
        bits, _, length = read_header(self.path)
        words = -(-length * bits // 64)
        return [Words(at, min(WORDS_PER_TASK, words - at)) for at in range(0, words, WORDS_PER_TASK)]

    def read(self, part: Words) -> Iterator[tuple[int, int]]:
        with open(self.path, "rb") as f:
            f.seek(HEADER.size + 8 * part.start)
            words = np.frombuffer(f.read(8 * part.count), "<i8")
        yield from zip(range(part.start, part.start + part.count), words.tolist(), strict=True)


class SsaWriter(DataSourceWriter):
    """Tasks write into a file beside the path, of its own name for each job; the commit on the driver writes the header and renames it. Writing a word twice is harmless."""

    def __init__(self, options: dict):
        self.path, self.bits, self.sparseness, self.length = options["path"], int(options["bits"]), int(options["sparseness"]), int(options["length"])
        if not 1 <= self.sparseness <= 255:
            raise ValueError("the file holds the sparseness in one byte: 1 to 255")
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        open(self.part, "wb").close()

    def write(self, rows: Iterator) -> WriterCommitMessage:
        with open(self.part, "r+b") as f:
            for _, run in groupby(enumerate(rows), lambda x: x[1].word_idx - x[0]):  # neighbouring words are one write
                first = None
                while some := [r for _, r in islice(run, WORDS_PER_TASK)]:
                    if first is None:
                        first = some[0].word_idx
                        f.seek(HEADER.size + 8 * first)
                    f.write(np.array([r.word for r in some], "<i8").tobytes())
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        with open(self.part, "r+b") as f:
            f.write(HEADER.pack(self.bits, self.sparseness, self.length))
        os.replace(self.part, self.path)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


def write_ssa(words: DataFrame, path: str, bits: int, sparseness: int, length: int) -> None:
    words.sparkSession.dataSource.register(SsaSource)
    options = {"path": path, "bits": bits, "sparseness": sparseness, "length": length}
    words.select("word_idx", "word").sortWithinPartitions("word_idx").write.format("ssa").options(**options).mode("overwrite").save()


def read_ssa(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(SsaSource)
    return spark.read.format("ssa").load(path)
