"""Sparse suffix arrays: the positions p with p mod s = 0 in the order of the suffixes that start there.

Three plans give the same rows (keys, rank, pos):

- sort: explode the sampled positions and sort their suffixes with a window. It holds about n^2 / 2s bytes a text: short texts only.
- kernel: prefix doubling in numpy, a text at a time, texts spread over the tasks. For corpora of many texts.
- doubling: distributed prefix doubling over chunks of texts, for texts that one task shouldn't hold.

auto takes the kernel for texts of up to KERNEL_BYTES and doubling for longer ones. Files and joined texts of any length are sorted from their chunks (sort_chunks)."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from suffixspark.operators.codes import Layout, cell_codes, layout, pack
from suffixspark.operators.running import running_total
from suffixspark.session import cut
from suffixspark.sources.chunks import CHUNK, chunk_keys, text_chunks

KERNEL_BYTES = 16 << 20
#: Rows of a batch that the kernel gives.
BATCH_ROWS = 1 << 18


def by_sort(df: DataFrame, s: int) -> DataFrame:
    keys = [c for c in df.columns if c != "content"]
    at = df.filter(F.octet_length("content") > 0).withColumn("pos", F.explode(F.expr(f"sequence(0L, octet_length(content) - 1L, {s}L)")))
    suffix = at.select(*keys, "pos", F.expr("substring(content, cast(pos + 1 as int))").alias("suffix"))
    w = Window.partitionBy(*keys).orderBy("suffix")
    return suffix.select(*keys, (F.row_number().over(w) - 1).cast("bigint").alias("rank"), "pos")


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Of sorted rows, where each row's run of equal rows starts."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def ladder(text: np.ndarray, s: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(order, name, step) after each round of prefix doubling: the cells in the order of their first `step` cells, and of each cell 1 + the number of cells before its group.

    Groups are runs of the order. A group of one is settled: its cell keeps its place and takes no part in further rounds, where the others are sorted within their groups by the name of the cell
    `step` on (0 past the end)."""
    n, cells = len(text), -(-len(text) // s)
    alphabet, rank = np.unique(text, return_inverse=True)
    plan = layout(s, len(alphabet))
    padded = np.zeros(cells * s + plan.symbols, np.int64)
    padded[:n] = rank + 1
    codes = pack(padded, np.arange(0, n, s), plan)
    order = np.argsort(codes[0]) if len(codes) == 1 else np.lexsort(codes[::-1])
    start, step = _runs([c[order] for c in codes]), plan.step
    name = np.empty(cells, np.int64)
    name[order] = start + 1
    slots = np.arange(cells)  # places of the order whose group isn't settled
    while True:
        yield order, name, step
        grouped = np.zeros(len(start), bool)
        grouped[1:] = start[1:] == start[:-1]
        grouped[:-1] |= grouped[1:]
        slots, start = slots[grouped], start[grouped]
        if not len(slots):
            return
        own = order[slots]
        after = np.zeros(len(own), np.int64)
        inside = own + step < cells
        after[inside] = name[own[inside] + step]
        by = np.argsort(start * (cells + 1) + after) if cells < 3_000_000_000 else np.lexsort((after, start))
        order, name = order.copy(), name.copy()
        order[slots] = own[by]
        start = slots[_runs([start[by], after[by]])]
        name[order[slots]] = start + 1
        step *= 2


def suffix_order(text: np.ndarray, s: int) -> np.ndarray:
    """Sampled positions of one text in suffix order."""
    if not len(text):
        return np.zeros(0, np.int64)
    for order, _, _ in ladder(text, s):
        last = order
    return last * s


def per_text(df: DataFrame, fields: list[str], made: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """keys and fields (long): the rows that `made` gives for each text's bytes, as columns, texts spread over the tasks. Nothing is shuffled."""
    keys = [c for c in df.columns if c != "content"]
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(f, T.LongType()) for f in fields)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, list[np.ndarray]]] = []
            size = 0
            for i, text in enumerate(batch.column("content")):
                columns = made(np.frombuffer(text.as_buffer(), np.uint8))
                for at in range(0, len(columns[0]), BATCH_ROWS):
                    held.append((i, [c[at : at + BATCH_ROWS] for c in columns]))
                    size += len(held[-1][1][0])
                    if size >= BATCH_ROWS:
                        yield together(batch, held)
                        held, size = [], 0
            if held:
                yield together(batch, held)

    def together(batch: pa.RecordBatch, held: list[tuple[int, list[np.ndarray]]]) -> pa.RecordBatch:
        row = np.repeat([i for i, _ in held], [len(c[0]) for _, c in held])
        own = batch.select(keys).take(pa.array(row)).columns if keys else []
        return pa.RecordBatch.from_arrays([*own, *(pa.array(np.concatenate([c[k] for _, c in held]), pa.int64()) for k in range(len(fields)))], [*keys, *fields])

    return df.select(*keys, "content").mapInArrow(rows, schema)


def by_kernel(df: DataFrame, s: int, full: bool = False) -> DataFrame:
    """full: all suffixes are sorted, then every s-th position is kept."""

    def sort(text: np.ndarray) -> list[np.ndarray]:
        pos = suffix_order(text, 1 if full else s)
        pos = pos[pos % s == 0] if full else pos
        return [np.arange(len(pos)), pos]

    return per_text(df, ["rank", "pos"], sort)


def by_doubling(df: DataFrame, s: int, chunk: int = CHUNK) -> DataFrame:
    return sort_chunks(text_chunks(df, chunk, max(62, s)), s)


def sort_chunks(chunks: DataFrame, s: int) -> DataFrame:
    """keys, rank, pos from chunks (keys..., offset, content, after) of texts of any length; after holds at least max(62, s) bytes, where there are so many."""
    keys = chunk_keys(chunks)
    codes, plan = cell_codes(chunks, s)
    if plan is None:
        return codes.select(*keys, F.col("cell").alias("rank"), F.col("cell").alias("pos"))
    return double(codes, keys, plan)


def double(codes: DataFrame, keys: list[str], plan: Layout) -> DataFrame:
    """keys, rank, pos from first codes (keys, cell, code0, ...), for texts of any length.

    First, cells are named by their codes. A round gives each cell the pair (its name, the name of the cell `step` on, 0 past the end), then names it anew: its old name
    plus the number of smaller pairs under that name. Equal pairs are counted before they are sorted, so a frequent pair is one row; names that
    are alone are final and only looked up. Names start at 1, so shorter suffixes sort first."""
    named, step = _name(codes.withColumn("name", F.lit(1).cast("bigint")), keys, plan.columns), plan.step
    while True:
        named = cut(named)
        if not named.filter("group > 1").limit(1).count():
            break
        open_ = named.filter("group > 1").select(*keys, "cell", "name")
        partner = named.select(*keys, (F.col("cell") - step).alias("cell"), F.col("name").alias("after")).filter("cell >= 0")
        pairs = open_.join(partner, [*keys, "cell"], "left").withColumn("after", F.coalesce("after", F.lit(0).cast("bigint")))
        named = named.filter("group = 1").unionByName(_name(pairs, keys, ["after"]))
        step *= 2
    return named.select(*keys, (F.col("name") - 1).alias("rank"), (F.col("cell") * plan.s).alias("pos"))


def _name(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """keys, cell, name, group (how many share the name) from keys, cell, name and the columns that part those of one name."""
    groups = rows.groupBy(*keys, "name", *by).agg(F.count("*").alias("group"))
    totals = running_total(groups, [*keys, "name", *by], "group", "total")
    first = totals.groupBy(*keys, "name").agg(F.min("total").alias("first"))
    new = totals.join(first, [*keys, "name"]).select(*keys, "name", *by, "group", (F.col("name") + F.col("total") - F.col("first")).alias("new"))
    return rows.join(new, [*keys, "name", *by]).select(*keys, "cell", F.col("new").alias("name"), "group")


def _renumbered(kept: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rank (from 0, without gaps), pos of some rows of a suffix array, by running totals over ranges."""
    ranks = running_total(kept.withColumn("one", F.lit(1).cast("bigint")), [*keys, "rank"], "one", "total").drop("one")
    if not keys:
        return ranks.select(F.col("total").alias("rank"), "pos")
    first = ranks.groupBy(*keys).agg(F.min("total").alias("first"))
    return ranks.join(first, keys).select(*keys, (F.col("total") - F.col("first")).alias("rank"), "pos")


def full_then_sample(df: DataFrame, s: int, plan: str = "auto", kernel_bytes: int = KERNEL_BYTES) -> DataFrame:
    """The plan without the sampling shortcut: sort all suffixes, keep every s-th position, number them again. The kernel samples what it has sorted; other plans number over ranges."""
    keys = [c for c in df.columns if c != "content"]
    if plan == "kernel":
        return by_kernel(df, _sparseness(s), full=True)
    if plan == "auto":
        long, short = df.filter(F.octet_length("content") > kernel_bytes), df.filter(F.octet_length("content") <= kernel_bytes)
        out = full_then_sample(short, s, "kernel")
        return out.unionByName(full_then_sample(long, s, "doubling")) if long.limit(1).count() else out
    return _renumbered(sparse_suffix_array(df, 1, plan).filter(F.col("pos") % _sparseness(s) == 0), keys)


def sort_chunks_then_sample(chunks: DataFrame, s: int) -> DataFrame:
    """The same from chunks of texts of any length."""
    return _renumbered(sort_chunks(chunks, 1).filter(F.col("pos") % _sparseness(s) == 0), chunk_keys(chunks))


def _sparseness(s: int) -> int:
    if s < 1:
        raise ValueError(f"sparseness must be 1 or more, not {s}")
    return s


def sparse_suffix_array(df: DataFrame, s: int, plan: str = "auto", kernel_bytes: int = KERNEL_BYTES) -> DataFrame:
    """keys, rank, pos of every text of df (keys..., content BINARY). Keys must be unique and not null; empty texts give no rows."""
    plans = {"sort": by_sort, "kernel": by_kernel, "doubling": by_doubling}
    if plan in plans:
        return plans[plan](df, _sparseness(s))
    if plan != "auto":
        raise ValueError(f"no such plan: {plan}")
    long = df.filter(F.octet_length("content") > kernel_bytes)
    out = by_kernel(df.filter(F.octet_length("content") <= kernel_bytes), _sparseness(s))
    return out.unionByName(by_doubling(long, s)) if long.limit(1).count() else out
