"""What follows from the order of all suffixes: the Burrows-Wheeler transform with its primary and sampled index, its inverse, and the longest common prefixes."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suffixspark.operators.running import running_total
from suffixspark.operators.suffix_sort import KERNEL_BYTES, ladder, per_text, sort_chunks, suffix_order
from suffixspark.session import cut
from suffixspark.sources.chunks import CHUNK, chunk_keys, text_chunks, with_fields


def _transform(text: np.ndarray) -> list[np.ndarray]:
    if not len(text):
        return [np.zeros(0, np.int64)] * 2
    pos = suffix_order(text, 1)
    before = np.where(pos > 0, text[pos - 1].astype(np.int64), -1)
    return [np.arange(len(pos) + 1), np.concatenate([text[-1:].astype(np.int64), before])]


def bwt(df: DataFrame, kernel_bytes: int = KERNEL_BYTES) -> DataFrame:
    """keys, idx, byte of every text (keys..., content): the byte before each suffix in suffix order, the empty suffix first (idx 0). At the primary index, where the whole text stands, byte is null;
    empty texts give no rows."""
    keys = [c for c in df.columns if c != "content"]
    short, long = df.filter(F.octet_length("content") <= kernel_bytes), df.filter(F.octet_length("content") > kernel_bytes)
    out = per_text(short, ["idx", "byte"], _transform).select(*keys, "idx", F.when(F.col("byte") >= 0, F.col("byte")).alias("byte"))
    return out.unionByName(bwt_chunks(text_chunks(long))) if long.limit(1).count() else out


def bwt_chunks(chunks: DataFrame) -> DataFrame:
    """The same from chunks (keys..., offset, content, after) of texts of any length, offsets at multiples of CHUNK: each suffix goes to the chunk with the byte before it."""
    keys = chunk_keys(chunks)
    sa = sort_chunks(chunks, 1).select(*keys, (F.col("rank") + 1).alias("idx"), (F.col("pos") - 1).alias("at"))
    length = chunks.groupBy(*keys).agg(F.max(F.col("offset") + F.octet_length("content")).alias("n"))
    last = length.select(*keys, F.lit(0).cast("long").alias("idx"), (F.col("n") - 1).alias("at"))
    asked = sa.unionByName(last)
    number = lambda place: F.expr(f"{place} div {CHUNK}L").alias("_number")
    texts = chunks.select(*keys, number("offset"), "content")
    schema = with_fields(chunks, keys, "idx long, byte long")

    def look_up(suffixes: pd.DataFrame, text: pd.DataFrame) -> pd.DataFrame:
        content = np.frombuffer(text["content"].iloc[0], np.uint8) if len(text) else np.zeros(0, np.uint8)
        return suffixes[[*keys, "idx"]].assign(byte=content[suffixes["at"].to_numpy() % CHUNK].astype(np.int64))

    by = [*keys, "_number"]
    found = asked.filter("at >= 0").select(*keys, "idx", "at", number("at")).groupBy(*by).cogroup(texts.groupBy(*by)).applyInPandas(look_up, schema)  # a group is a chunk's suffixes
    return found.unionByName(asked.filter("at < 0").select(*keys, "idx", F.lit(None).cast("long").alias("byte")))


def primary_index(transform: DataFrame) -> DataFrame:
    """keys, primary_index: where a text's own row stands in its transform."""
    keys = [c for c in transform.columns if c not in ("idx", "byte")]
    return transform.filter("byte is null").select(*keys, F.col("idx").alias("primary_index"))


def sampled_index(sa: DataFrame, r: int) -> DataFrame:
    """keys, sample, idx: for each position that is a multiple of r, the index of its suffix in the transform, from keys, rank, pos."""
    keys = [c for c in sa.columns if c not in ("rank", "pos")]
    return sa.filter(F.col("pos") % r == 0).select(*keys, F.expr(f"pos div {r}L").alias("sample"), (F.col("rank") + 1).alias("idx"))


def inverse_bwt(transform: DataFrame) -> DataFrame:
    """keys, pos, byte: the text of a transform (keys..., idx, byte), for texts of any length.

    Sorting the transform by (byte, idx) leads from each row to that of the suffix one byte longer. How far a row is from the empty suffix, at idx 0, is found by pointer jumping: each round
    adds the distance of the row that one points to, and points to where that points, so that rounds grow with the logarithm of the length; rows that point to idx 0 are done."""
    keys = [c for c in transform.columns if c not in ("idx", "byte")]
    rows = cut(transform.select(*keys, "idx", "byte", F.coalesce("byte", F.lit(-1)).alias("order"), F.lit(1).cast("long").alias("one")))
    sorted_ = running_total(rows, [*keys, "order", "idx"], "one", "total")
    if keys:
        first = sorted_.groupBy(*keys).agg(F.min("total").alias("first"))
        sorted_ = sorted_.join(first, keys).withColumn("total", F.col("total") - F.col("first"))
    # idx 0 is the root; the row of the whole text leads back to it
    links = sorted_.filter("total > 0").select(*keys, F.col("total").alias("idx"), F.col("idx").alias("to"), F.lit(1).cast("long").alias("far"))
    done, open_ = links.filter("to = 0"), links.filter("to > 0")
    settled = [cut(done)]
    open_ = cut(open_)
    while not open_.isEmpty():
        known = open_.unionByName(_all(settled)).select(*keys, F.col("idx").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        moved = cut(open_.join(known, [*keys, "to"]).select(*keys, "idx", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far")))
        settled.append(moved.filter("to = 0"))
        open_ = moved.filter("to > 0")
    n = rows.groupBy(*keys).agg((F.count("*") - 1).alias("n"))
    far = _all(settled).select(*keys, "idx", "far").unionByName(rows.filter("idx = 0").select(*keys, "idx", F.lit(0).cast("long").alias("far")))
    both = far.join(rows.filter("byte is not null").select(*keys, "idx", "byte"), [*keys, "idx"])
    both = both.join(n, keys) if keys else both.crossJoin(F.broadcast(n))  # one row
    return both.select(*keys, (F.col("n") - 1 - F.col("far")).alias("pos"), "byte")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _prefixes(text: np.ndarray) -> list[np.ndarray]:
    """rank, pos, and how many bytes a suffix has in common with the one before it. Two suffixes that share a name of the ladder have its `step` first bytes in common, so each rung is tried once, from the top."""
    if not len(text):
        return [np.zeros(0, np.int64)] * 3
    rungs = list(ladder(text, 1))
    order, n = rungs[-1][0], len(text)
    a, b, common = order[:-1], order[1:], np.zeros(n - 1, np.int64)

    def longer(value: np.ndarray, step: int) -> None:
        at = np.flatnonzero((a + common < n) & (b + common < n))
        common[at[value[a[at] + common[at]] == value[b[at] + common[at]]]] += step

    for _, name, step in reversed(rungs):
        longer(name, step)
    open_ = np.arange(n - 1)
    for _ in range(rungs[0][2] - 1):  # what is left is shorter than a first code
        open_ = open_[np.maximum(a, b)[open_] + common[open_] < n]
        open_ = open_[text[a[open_] + common[open_]] == text[b[open_] + common[open_]]]
        if not len(open_):
            break
        common[open_] += 1
    return [np.arange(n), order, np.concatenate([np.zeros(1, np.int64), common])]


def lcp(df: DataFrame, kernel_bytes: int = KERNEL_BYTES) -> DataFrame:
    """keys, rank, pos, lcp of every text of up to kernel_bytes (longer ones are an error: the names of all rounds are held in a task)."""
    checked = F.when(F.octet_length("content") <= kernel_bytes, F.col("content")).otherwise(F.raise_error(F.lit(f"a text is longer than {kernel_bytes} bytes")))
    return per_text(df.withColumn("content", checked), ["rank", "pos", "lcp"], _prefixes)
