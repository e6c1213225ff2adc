"""Exact top-k by inner product, pruned with multi-resolution segment statistics.

Components are quantised to floor(256 x). The largest inner products are the smallest of |q|^2 + |c|^2 - 2 <q, c> for given lengths. A vector cut
into segments has a mean and a deviation in each; the squared distance of two vectors is at least the sum over segments of
size * ((difference of means)^2 + (difference of deviations)^2). From coarse to fine these bounds drop pairs whose score can't reach the
k-th best; survivors get their exact integer score.

Queries and candidates are cut into blocks; a pair of blocks is one row of work, so a task holds two blocks and no more. The queries go to the tasks
in passes of about PASS_QUERIES each, however many there are; candidates aren't shuffled. A block returns k rows per query, which a window merges. Vectors that are null, empty, or hold nulls or non-finite components take no part, nor do
rows without id; vectors of unlike dimension aren't compared. A query's own row is no candidate for it; other rows with the same vector are. A repeated
id asks once (with an arbitrary one of its vectors, if they differ), and each of its rows is a candidate for the others. A quantised component beyond sqrt(2^62 / dimension), whose scores 64 bits might not hold, raises an error
rather than giving a wrong score. An empty table gives no rows; columns besides the two named aren't read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suffixspark.session import cut

BLOCK = 4096
QUERY_BLOCK = 1024
PASS_QUERIES = 16_384
LEVELS = (2, 8)
_PAIRS = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """id, dim, v (int32 components as bytes)."""
    x = F.col(vector)
    fit = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    most = F.sqrt(F.lit(2.0**62) / F.size(x))
    whole = lambda e: F.when(F.abs(e.cast("double") * scale) <= most, F.floor(e.cast("double") * scale)).otherwise(F.raise_error("a component is too large for exact 64-bit scores").cast("long"))
    rows = vectors.filter(F.col(key).isNotNull() & fit).select(F.col(key).cast("long").alias("id"), F.transform(x, whole).alias("v"))
    return rows.select("id", F.size("v").alias("dim"), "v")


def _blocks(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """A row per block of up to `size` vectors of one dimension: dim, <prefix>no, <prefix>ids, <prefix>v. Made within each partition: no shuffle."""
    schema = f"dim int, {prefix}ids array<long>, {prefix}v binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        count: dict[int, int] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, v = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            del count[dim]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([v.tobytes()], pa.binary())], ["dim", f"{prefix}ids", f"{prefix}v"])

        for batch in batches:
            ids, dims, flat = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            ends = flat.offsets.to_numpy()
            values = flat.values.to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                table = values[ends[at][:, None] + np.arange(dim)] if len(at) else np.zeros((0, dim), np.int64)
                for lo in range(0, len(at), size):
                    held.setdefault(dim, []).append((ids[at[lo : lo + size]], table[lo : lo + size]))
                    count[dim] = count.get(dim, 0) + len(at[lo : lo + size])
                    if count[dim] >= size:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(pack, schema)


def _segments(v: np.ndarray, n: int) -> np.ndarray:
    """Means and deviations of n segments, scaled by the root of the segment's size, so that squared distances of these rows are lower bounds."""
    parts = [x for x in np.array_split(v, min(n, v.shape[1]), axis=1)]
    size = np.sqrt([x.shape[1] for x in parts])
    return np.hstack([np.stack([x.mean(axis=1) for x in parts], axis=1) * size, np.stack([x.std(axis=1) for x in parts], axis=1) * size])


def best_of_blocks(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, candidate id and score of the k best candidates of each query in one block; ties to the smaller id."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    exact_q, exact_c = q.astype(np.float64), c.astype(np.float64)
    norms = (exact_q**2).sum(axis=1)[:, None], (exact_c**2).sum(axis=1)[None, :]
    slack = 1e-6 * (1 + norms[0] + norms[1].max(initial=0))
    alive = q_ids[:, None] != c_ids[None, :]
    least = np.full(len(q_ids), -np.inf)
    for n in levels:
        cols = np.flatnonzero(alive.any(axis=0))
        sq, sc = _segments(exact_q, n), _segments(exact_c[cols], n)
        apart = (sq**2).sum(axis=1)[:, None] + (sc**2).sum(axis=1)[None, :] - 2 * (sq @ sc.T)
        upper = np.where(alive[:, cols], (norms[0] + norms[1][:, cols] - apart) / 2 + slack, -np.inf)
        if len(cols) > k:  # exact scores of the k most promising give a score to reach
            top = np.argpartition(-upper, k - 1, axis=1)[:, :k]
            score = np.einsum("qd,qkd->qk", exact_q, exact_c[cols[top]])
            score[~np.take_along_axis(alive, cols[top], axis=1)] = -np.inf
            least = np.maximum(least, score.min(axis=1) - slack[:, 0])
        alive[:, cols] &= upper >= least[:, None]
    row, col, score = _exact(q, c, exact_q, exact_c, alive, k)
    order = np.lexsort((c_ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
    keep = place < k
    return q_ids[row[keep]], c_ids[col[keep]], score[keep]


def _exact(q: np.ndarray, c: np.ndarray, exact_q: np.ndarray, exact_c: np.ndarray, alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, column and score of the surviving pairs, at least those that reach the k-th best score of their row."""
    cols = np.flatnonzero(alive.any(axis=0))
    largest = np.abs(exact_q).max(initial=0) * np.abs(exact_c).max(initial=0) * q.shape[1]
    if alive.sum() > alive.size // 64 and largest < 2**52:  # many: one product of matrices, exact in doubles
        scores = np.where(alive[:, cols], exact_q @ exact_c[cols].T, -np.inf)
        if len(cols) > k:
            row, at = np.nonzero(scores >= np.maximum(-np.partition(-scores, k - 1, axis=1)[:, k - 1 : k], -(2.0**52)))
        else:
            row, at = np.nonzero(scores > -np.inf)
        return row, cols[at], scores[row, at].astype(np.int64)
    row, col = np.nonzero(alive)
    score = np.zeros(len(row), np.int64)
    for lo in range(0, len(row), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        score[part] = np.einsum("id,id->i", q[row[part]], c[col[part]])
    return row, col, score


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row of vectors that is_query holds of."""
    picked = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"), is_query.alias("asks"))
    asks = cut(quantised(picked.filter("asks"), "key", "vector", scale).dropDuplicates(["id"]))
    candidates = _blocks(quantised(picked, "key", "vector", scale), BLOCK, "c")
    passes = max(1, -(-asks.count() // PASS_QUERIES))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                q_ids, c_ids = (batch.column(x)[i].values.to_numpy() for x in ("qids", "cids"))
                q, c = (np.frombuffer(batch.column(x)[i].as_buffer(), np.int64).reshape(-1, dim) for x in ("qv", "cv"))
                found = best_of_blocks(q_ids, q, c_ids, c, k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    scored = None
    for n in range(passes):
        queries = _blocks(asks.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == n).repartition(1), QUERY_BLOCK, "q")
        pairs = candidates.join(F.broadcast(queries), "dim")  # about PASS_QUERIES vectors, whatever the size of the table
        found = pairs.mapInArrow(search, _PAIRS)
        scored = found if scored is None else scored.unionAll(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
