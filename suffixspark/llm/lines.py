"""Line dedup: explode normalised lines, hash, count the documents of each hash, drop frequent lines, put the rest together by position.

A document is a row, so repeated rows count each. A line's key is the line without ASCII white space at its ends and with A-Z lower-cased;
null and empty texts are one empty line. Lines whose key has at least min_chars code points and is in at least min_docs documents go, except
from the rows with the largest doc_id that hold it (nulls sort first; the rows of a tie all keep it). An empty table gives an empty result.
Keys are compared by 128-bit hashes."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suffixspark.llm.rows import row_and, sliced
from suffixspark.session import cut

#: Frequent lines of up to this many rows (24 bytes each) are sent to the tasks; more are joined.
SENT_ROWS = 1_000_000
LOWEST = -(1 << 63)
U64 = (1 << 64) - 1


def line_hashes(text: bytes, min_chars: int) -> list[tuple[int, int]]:
    """(line number, 128-bit hash of its key) of the lines with long keys."""
    out = []
    for i, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(b" \t\n\r\x0b\x0c").lower()
            if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
                out.append((i, xxhash.xxh3_128_intdigest(key)))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def document_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc_id: a row for each document and key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                own = {h for _, h in line_hashes(text.as_py() or b"", min_chars)}
                keys += own
                ids += [doc_id] * len(own)
            h1, h2 = np.array([k >> 64 for k in keys], np.uint64), np.array([k & U64 for k in keys], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(rows, "h1 long, h2 long, doc_id long")


def frequent_keys(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """h1, h2, keeper: keys in many documents, and the largest doc_id that holds each. Counts are added up before the shuffle."""
    counted = document_keys(docs, min_chars).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    return counted.filter(F.col("n") >= min_docs).select("h1", "h2", "keeper")


RESULT = "n_lines long, n_dropped long, text string"


def _rebuild(text: str | None, drop: set[int]) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    return len(lines), len(drop), "\n".join(x for i, x in enumerate(lines) if i not in drop)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, sent_rows: int = SENT_ROWS) -> DataFrame:
    """row (a struct with the columns of docs), n_lines, n_dropped, text (what is left)."""
    frequent = cut(frequent_keys(docs, min_chars, min_docs))
    if frequent.count() <= sent_rows:
        return _drop_sent(docs, frequent, min_chars)
    return _drop_joined(docs, frequent, min_chars)


def _drop_sent(docs: DataFrame, frequent: DataFrame, min_chars: int) -> DataFrame:
    """The frequent keys (at most SENT_ROWS) go to all tasks, so that texts aren't shuffled."""
    table = frequent.toPandas().sort_values(["h1", "h2"])
    shared = docs.sparkSession.sparkContext.broadcast((table["h1"].to_numpy(), table["h2"].to_numpy(), table["keeper"].fillna(LOWEST).astype(np.int64).to_numpy()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return drop_lines(batches, *shared.value, min_chars)

    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long"), F.col("text"))
    return packed.mapInArrow(rows, row_and(docs, RESULT))


def drop_lines(batches: Iterator[pa.RecordBatch], h1: np.ndarray, h2: np.ndarray, keeper: np.ndarray, min_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows (row, doc_id, text) without the lines whose keys are among the sorted ones, in slices of batches."""
    keeper_of = {(a, b): k for a, b, k in zip(h1.tolist(), h2.tolist(), keeper.tolist(), strict=True)} if len(h1) <= 1 << 16 else None
    for batch in sliced(batches):
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = line_hashes((text or "").encode(), min_chars)
            own, drop = LOWEST if doc_id is None else doc_id, set()
            if found:
                a, b = _signed(np.array([h >> 64 for _, h in found], np.uint64)), _signed(np.array([h & U64 for _, h in found], np.uint64))
                if keeper_of is not None:
                    kept_by = [keeper_of.get(x) for x in zip(a.tolist(), b.tolist(), strict=True)]
                else:
                    at = np.searchsorted(h1, a)
                    kept_by = [_find(h1, h2, keeper, i, x, y) for i, x, y in zip(at.tolist(), a.tolist(), b.tolist(), strict=True)]
                drop = {i for (i, _), k in zip(found, kept_by, strict=True) if k is not None and own < k}
            out.append(_rebuild(text, drop))
        n, dropped, texts = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())], ["row", "n_lines", "n_dropped", "text"])


def _find(h1: np.ndarray, h2: np.ndarray, keeper: np.ndarray, i: int, x: int, y: int) -> int | None:
    while i < len(h1) and h1[i] == x:
        if h2[i] == y:
            return int(keeper[i])
        i += 1
    return None


def _drop_joined(docs: DataFrame, frequent: DataFrame, min_chars: int) -> DataFrame:
    """The general way: lines meet the frequent keys in a join, and the dropped positions go back to their texts."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(line_hashes((t or "").encode(), min_chars)) for t in pdf["text"]]
            n = [len(x) for x in found]
            flat = [x for y in found for x in y]
            at = np.repeat(np.arange(len(pdf)), n)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].iloc[at].array, "t1": pdf["t1"].iloc[at].array, "t2": pdf["t2"].iloc[at].array, "pos": np.array([i for i, _ in flat], np.int64),
                "h1": _signed(np.array([h >> 64 for _, h in flat], np.uint64)), "h2": _signed(np.array([h & U64 for _, h in flat], np.uint64)),
            })

    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(1), "text"))  # with doc_id, what sets rows apart
    own = keyed.select("doc_id", "t1", "t2", "text").mapInPandas(lines, "doc_id long, t1 long, t2 long, pos long, h1 long, h2 long")
    lost = own.join(frequent, ["h1", "h2"]).filter(F.coalesce("doc_id", F.lit(LOWEST)) < F.col("keeper"))
    lost = lost.groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("lost")).select(F.col("doc_id").alias("d"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), "lost")
    both = keyed.join(lost, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left")
    drop = F.coalesce("lost", F.array().cast("array<bigint>"))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(drop, i.cast("long")))
    return both.select("row", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.size(drop).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("text"))
