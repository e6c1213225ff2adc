"""Mixing sources to target weights: how often each document is taken so that every source comes near its share.

A document's size is its number of tokens (runs of other characters than ASCII white space; null: 0). Sources, by code point with null last, have
weights that repeat; together they share `budget` times all sizes, but none more than `most` times its own size: the excess is shared again by weight until
none is above. That is target = min(level * weight, most * size) with one level for all, found from running totals over the sources.

A source takes each document target div size times, and some of them once more. For the rest of its budget it has a histogram of exact lengths: every length
gives its share of documents, and a bounded-knapsack table of reachable sums picks counts by length for what is left. Which documents of a length
those are is decided by a seeded hash of their id, so reruns agree. A row is a document; repeated rows are ordered by hash and id alike, so that one of
them is taken as well as the other. Null ids count as one id; documents of size 0 take no words. Without rows there is no result."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suffixspark.operators.running import running_total
from suffixspark.session import cut

#: The part of a budget that the table of reachable sums settles.
TABLE_WORDS = 1 << 16
BUCKETS = 4096
SOURCE = ["_null", "_source"]


def n_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """_null, _source, source_size, target, from rows with _null, _source and size."""
    own = cut(sizes.groupBy(*SOURCE).agg(F.sum("size").alias("source_size")))
    place = running_total(own.withColumn("_one", F.lit(1).cast("long")), SOURCE, "_one", "_place").drop("_one")
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighted = place.withColumn("_w", F.get(table, (F.col("_place") % len(weights)).cast("int"))).withColumn("_cap", F.col("source_size") * most)
    filled = weighted.withColumn("_at", F.col("_cap") / F.col("_w"))  # the level from which the source is full
    caps = _before(filled, "_cap", "_caps")
    caps = _before(caps, "_w", "_ws")
    sums = caps.agg(F.sum("_w").alias("w"), F.sum("source_size").alias("s")).withColumn("goal", F.col("s") * budget)
    # with the sources up to this one full, the level is what is left over the weights that are left; the right one is the first that no later source is full at
    at = caps.crossJoin(F.broadcast(sums))  # one row
    level = (F.col("goal") - F.col("_caps")) / (F.col("w") - F.col("_ws"))
    fits = at.filter(level <= F.col("_at")).agg(F.min_by(level, F.struct("_at", *SOURCE)).alias("level"))
    target = F.least(F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("_w"), F.col("_cap"))
    return weighted.crossJoin(F.broadcast(fits)).select(*SOURCE, "source_size", target.alias("target"))


def _before(df: DataFrame, value: str, out: str) -> DataFrame:
    """The sum of a double over the sources that are full at a lower level."""
    ranged = cut(df.repartitionByRange("_at", *SOURCE).withColumn("_range", F.spark_partition_id()))
    per = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offset = per.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_offset"))
    within = Window.partitionBy("_range").orderBy("_at", *SOURCE).rowsBetween(Window.unboundedPreceding, -1)
    both = ranged.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0.0))).join(F.broadcast(offset), "_range")
    return both.withColumn(out, F.col("_offset") + F.col("_in")).drop("_range", "_in", "_offset")


def fit_counts(length: np.ndarray, n: np.ndarray, budget: int) -> np.ndarray:
    """How many of the n documents of each length to take so that their words are as near below the budget as the table finds."""
    total = int((length * n).sum())
    if budget >= total:
        return n.copy()
    if budget <= 0:
        return np.zeros_like(n)
    take = np.array([int(c) * budget // total for c in n], np.int64)  # each length's share
    left, order = budget - int((take * length).sum()), np.argsort(-length, kind="stable")
    for i in order:  # down to what the table holds, longest first
        if left > TABLE_WORDS and length[i]:
            more = min(int(n[i] - take[i]), (left - TABLE_WORDS) // int(length[i]))
            take[i] += more
            left -= more * int(length[i])
    spare = n - take
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for i in order[::-1]:  # short lengths first: they reach most sums
        size, count = int(length[i]), int(spare[i])
        if not size or not count or size > left or reach >> left & 1:
            continue
        count = min(count, left // size)
        steps.append((i, reach))
        part = 1
        while count > 0:  # 1, 2, 4, ... and the rest make every count
            part = min(part, count)
            reach |= (reach << (part * size)) & mask
            count -= part
            part *= 2
    at = reach.bit_length() - 1
    for i, before in reversed(steps):
        size = int(length[i])
        while not before >> at & 1:
            at -= size
            take[i] += 1
    return take


def length_counts(histogram: DataFrame, targets: DataFrame) -> DataFrame:
    """_null, _source, size, times (for all of the length), more (how many of them once more), source_size, target."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        length, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        times = min(int(target // total), 1 << 30) if total else 0
        more = fit_counts(length, n, int(target) - times * total) if total else np.zeros_like(n)
        return pdf.drop(columns="n").assign(times=times, more=more)

    rows = histogram.join(targets, SOURCE).select(*SOURCE, "size", "n", "source_size", "target")
    schema = "_null boolean, _source string, size long, source_size long, target double, times long, more long"
    return rows.groupBy(*SOURCE).applyInPandas(fit, schema)  # at most as many rows as there are lengths


def mix(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """row (a struct of the columns to keep), size, source_size, target, times (how often the document is taken), taken (words)."""
    name = F.col(source).cast("string")
    of = [name.isNull().alias("_null"), F.coalesce(name, F.lit("")).alias("_source"), n_tokens(F.col(text)).alias("size")]
    order = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *of, order.alias("_order"), F.col(key).cast("string").alias("_key"), F.pmod(order, F.lit(BUCKETS)).cast("int").alias("_bucket"))
    group = [*SOURCE, "size"]
    buckets = cut(own.groupBy(*group, "_bucket").agg(F.count("*").alias("n")))
    lengths = cut(buckets.groupBy(*group).agg(F.sum("n").alias("n")))
    targets = source_targets(lengths.select(*SOURCE, (F.col("size") * F.col("n")).alias("size")), weights, budget, most)
    counts = length_counts(lengths, targets)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    offsets = buckets.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(counts, group)
    # the first `more` of a length, by bucket and then by hash: buckets before the last one are whole, so only rows of one bucket are ordered
    ranked = own.withColumn("_rank", F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy("_order", "_key")))
    times = F.col("times") + (F.col("_before") + F.col("_rank") <= F.col("more")).cast("long")
    out = ranked.join(offsets.drop("n"), [*group, "_bucket"]).withColumn("times", times)
    return out.select("row", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))
