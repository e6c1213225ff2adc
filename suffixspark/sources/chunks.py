"""Texts as chunks: rows (keys..., offset, content, after), so that no task holds a whole text.

A chunk starts at a multiple of the chunk size; after holds the bytes that follow it in its text, up to the halo asked for, so that what starts in a chunk can look a little beyond it.
Chunks come from files of any size (byte ranges, read by many tasks), from texts in rows, or from many rows that make one text."""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from suffixspark.operators.running import running_total

CHUNK, HALO = 1 << 20, 64
#: Bytes that one task reads.
TASK_BYTES = 32 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path on it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


def files_at(path: str) -> list[pafs.FileInfo]:
    """A file, or the files of a folder in the order of their paths, without those that begin with _ or a dot."""
    fs, at = file_system(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [info]
    inside = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted((f for f in inside if f.type == pafs.FileType.File and f.base_name[0] not in "_."), key=lambda f: f.path)


class ByteSource(DataSource):
    """Data source "bytes": files as chunks. Options: path, chunk, halo, joined (the files of a folder, in the order of their paths, are one text whose path is the folder's)."""

    @classmethod
    def name(cls) -> str:
        return "bytes"

    def schema(self) -> str:
        return "path string, offset long, content binary, after binary"

    def reader(self, schema) -> "ByteReader":
        return ByteReader(self.options["path"], int(self.options.get("chunk", CHUNK)), int(self.options.get("halo", HALO)), self.options.get("joined", "false") == "true")


@dataclass
class Range(InputPartition):
    """Bytes of a text, which is of a file, or of several: those (path, start in the text, size) that this range and its halo touch."""

    path: str
    start: int
    end: int
    files: list[tuple[str, int, int]]


class ByteReader(DataSourceReader):
    def __init__(self, path: str, chunk: int, halo: int, joined: bool = False):
        if chunk < 1 or halo < 0:
            raise ValueError("a chunk has at least a byte, a halo none or more")
        self.path, self.chunk, self.halo, self.joined = path, chunk, halo, joined

    def partitions(self) -> list[Range]:
        step = max(1, TASK_BYTES // self.chunk) * self.chunk
        found = files_at(self.path)
        files = [(f.path, start, f.size) for f, start in zip(found, accumulate((f.size for f in found), initial=0), strict=False)]
        texts = [(self.path, files)] if self.joined else [(path, [(path, 0, size)]) for path, _, size in files]
        out = []
        for path, of in texts:
            end = sum(size for _, _, size in of)
            for at in range(0, end, step):
                upto = min(at + step, end)
                out.append(Range(path, at, upto, [(p, start, size) for p, start, size in of if start < upto + self.halo and start + size > at]))
        return out or [Range("", 0, 0, [])]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs = file_system(self.path)[0]
        for at in range(part.start, part.end, self.chunk):
            until, pieces = at + self.chunk + self.halo, []
            for path, start, size in part.files:
                low, high = max(at, start), min(until, start + size)
                if low < high:
                    with fs.open_input_file(path) as f:
                        pieces.append(f.read_at(high - low, low - start))
            data = b"".join(pieces)
            columns = [pa.array([part.path]), pa.array([at], pa.int64()), pa.array([data[: self.chunk]], pa.binary()), pa.array([data[self.chunk :]], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "offset", "content", "after"])


def file_chunks(spark: SparkSession, path: str, chunk: int = CHUNK, halo: int = HALO, joined: bool = False) -> DataFrame:
    """path, offset, content, after of a file of any size, or of all files of a folder. An empty file has no chunk. joined: the files of a folder, in the order of their paths, are one text."""
    spark.dataSource.register(ByteSource)
    return spark.read.format("bytes").options(path=path, chunk=chunk, halo=halo, joined=joined).load()


def text_chunks(df: DataFrame, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """The chunks of texts in rows (keys..., content). Nothing is shuffled."""
    keys = [c for c in df.columns if c != "content"]
    at = df.filter(F.octet_length("content") > 0).withColumn("offset", F.explode(F.expr(f"sequence(0L, octet_length(content) - 1L, {chunk}L)")))
    return at.select(*keys, "offset", F.expr(f"substring(content, cast(offset + 1 as int), {chunk})").alias("content"), F.expr(f"substring(content, cast(offset + {chunk + 1} as int), {halo})").alias("after"))


def joined_chunks(df: DataFrame, order: str, separator: bytes, end: bytes, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """The chunks of all texts of df in the order of one column (unique) as one text: separator between texts, end after the last. The joined text never exists as a value:
    each text goes, cut at the borders of chunks, to the chunks that hold a part of it, and once more to those whose halo does."""
    last = df.agg(F.max(order).alias("last"))
    whole = df.join(F.broadcast(last)).select(  # one row
        order, F.concat("content", F.when(F.col(order) == F.col("last"), F.lit(bytearray(end))).otherwise(F.lit(bytearray(separator)))).alias("content")
    )
    start = running_total(whole.select(order, F.octet_length("content").cast("bigint").alias("n")), [order], "n", "start").select(order, "start")
    return regrouped(whole.join(start, order).select("start", "content"), chunk, halo)


def regrouped(pieces: DataFrame, chunk: int, halo: int) -> DataFrame:
    """offset, content, after of one text from pieces (start, content) of it, of any sizes, without gaps. A chunk and its halo are what a group holds."""
    if halo > chunk:
        raise ValueError("a halo is not longer than a chunk")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, bytes]] = []
            for start, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for number in range(start // chunk, (start + len(text) - 1) // chunk + 1):
                    low, high = max(start, number * chunk), min(start + len(text), (number + 1) * chunk)
                    out.append((number, low, text[low - start : high - start]))
                    high = min(high, number * chunk + halo)
                    if number and low < high:
                        out.append((number - 1, low, text[low - start : high - start]))
            number, at, part = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(at, pa.int64()), pa.array(part, pa.binary())], ["number", "at", "part"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        whole, offset = b"".join(pdf["part"]), int(pdf["number"].iloc[0]) * chunk
        return pd.DataFrame({"offset": [offset], "content": [whole[:chunk]], "after": [whole[chunk:]]})

    cut_up = pieces.select(F.col("start").cast("long"), F.col("content")).filter(F.octet_length("content") > 0).mapInArrow(parts, "number long, at long, part binary")
    return cut_up.groupBy("number").applyInPandas(joined, "offset long, content binary, after binary")


def chunk_keys(chunks: DataFrame) -> list[str]:
    return [c for c in chunks.columns if c not in ("offset", "content", "after")]


def with_fields(chunks: DataFrame, keys: list[str], more: str) -> T.StructType:
    return T.StructType([*(chunks.schema[k] for k in keys), *T.StructType.fromDDL(more).fields])
