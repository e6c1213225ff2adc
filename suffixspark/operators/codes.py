"""First codes: the symbols from each sampled position on, packed into integers that sort as they do, made chunk by chunk with one row for each cell.

A symbol is its rank in the alphabet, from 1; 0 stands for what is past the end. If the s symbols of a cell fit 62 bits, a code holds as many cells as do. Wider cells get several codes, pieces,
which sort one after the other as the cell does."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suffixspark.session import cut
from suffixspark.sources.chunks import chunk_keys, with_fields

#: Alphabets (a row of up to 256 bytes for each text) are sent to all tasks up to this many; more are joined.
SENT_ALPHABETS = 10_000


@dataclass(frozen=True)
class Layout:
    """How cells of s symbols of `bits` bits become codes: `sizes` symbols each, together `step` cells."""

    s: int
    bits: int
    sizes: tuple[int, ...]
    step: int

    @property
    def symbols(self) -> int:
        return sum(self.sizes)

    @property
    def columns(self) -> list[str]:
        return [f"code{i}" for i in range(len(self.sizes))]


def layout(s: int, alphabet_size: int) -> Layout:
    bits = max(1, int(alphabet_size).bit_length())  # of 1..size; 0 stands for the end
    take = 62 // bits
    if s <= take:
        return Layout(s, bits, (take - take % s,), take // s)
    return Layout(s, bits, (*[take] * (s // take), *[s % take] * (s % take > 0)), 1)


def pack(rank: np.ndarray, at: np.ndarray, plan: Layout) -> list[np.ndarray]:
    """The codes at some places of ranks (1 up; at least plan.symbols more after the last place, 0 past the end)."""
    out, begin = [], 0
    for size in plan.sizes:
        code = np.zeros(len(at), np.int64)
        for k in range(begin, begin + size):
            code <<= plan.bits
            code |= rank[at + k]
        out.append(code)
        begin += size
    return out


def byte_counts(chunks: DataFrame) -> DataFrame:
    """keys, byte, cnt. A chunk gives at most 256 rows, which are added up before they are shuffled."""
    keys = chunk_keys(chunks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.bincount(np.frombuffer(b.as_buffer(), np.uint8), minlength=256) for b in batch.column("content")]
            row, byte = np.nonzero(np.stack(found)) if found else (np.zeros(0, np.int64),) * 2
            cnt = np.stack(found)[row, byte] if found else np.zeros(0, np.int64)
            own = batch.select(keys).take(pa.array(row)).columns if keys else []
            yield pa.RecordBatch.from_arrays([*own, pa.array(byte.astype(np.int64)), pa.array(cnt.astype(np.int64))], [*keys, "byte", "cnt"])

    rows = chunks.select(*keys, "content").mapInArrow(count, with_fields(chunks, keys, "byte long, cnt long"))
    return rows.groupBy(*keys, "byte").agg(F.sum("cnt").alias("cnt"))


def alphabets(chunks: DataFrame) -> DataFrame:
    """keys, alphabet (the bytes that occur, in order; at most 256)."""
    keys = chunk_keys(chunks)
    return byte_counts(chunks).groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("byte").cast("int"))).alias("alphabet"))


def cell_codes(chunks: DataFrame, s: int) -> tuple[DataFrame, Layout | None]:
    """keys, cell, code0, code1, ... and their layout, by the largest alphabet of all texts; None if there are no texts. The halo must hold layout.symbols - 1 bytes: max(62, s) always does."""
    keys = chunk_keys(chunks)
    known = cut(alphabets(chunks))
    largest = known.agg(F.max(F.size("alphabet")).alias("n"), F.count("*").alias("rows")).first()
    if largest.n is None:
        return chunks.select(*keys, F.col("offset").alias("cell"), F.col("offset").alias("code0")).limit(0), None
    plan = layout(s, largest.n)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                offset, content, after, alphabet = (batch.column(c)[i] for c in ("offset", "content", "after", "alphabet"))
                rank = np.zeros(256, np.int64)
                rank[alphabet.as_py()] = np.arange(1, len(alphabet) + 1)
                text, offset = np.frombuffer(content.as_buffer(), np.uint8), offset.as_py()
                ranks = np.concatenate([rank[text], rank[np.frombuffer(after.as_buffer(), np.uint8)], np.zeros(plan.symbols, np.int64)])
                at = np.arange(-offset % s, len(text), s)
                for lo in range(0, len(at), 1 << 18):
                    part = at[lo : lo + (1 << 18)]
                    own = batch.select(keys).take(pa.array(np.full(len(part), i))).columns if keys else []
                    yield pa.RecordBatch.from_arrays([*own, pa.array((part + offset) // s), *(pa.array(c) for c in pack(ranks, part, plan))], [*keys, "cell", *plan.columns])

    if keys:
        named = chunks.join(F.broadcast(known) if largest.rows <= SENT_ALPHABETS else known, keys)
    else:
        named = chunks.withColumn("alphabet", F.array(*map(F.lit, known.first()["alphabet"])))
    more = ", ".join(f"{c} long" for c in ["cell", *plan.columns])
    return named.select(*keys, "offset", "content", "after", "alphabet").mapInArrow(codes, with_fields(chunks, keys, more)), plan
