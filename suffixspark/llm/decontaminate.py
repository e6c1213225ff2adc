"""Benchmark decontamination: a BM25 index of the test items, asked by every passage of the training texts with block-max WAND.

Tokens are runs of a-z, 0-9 and non-ASCII bytes after lower-casing A-Z. A passage is two neighbouring stretches of `stretch` tokens, and a text's
passages overlap by one stretch, so that an item of up to `stretch` tokens lies whole in some passage. Items are grouped by length, for stretches of 64, 128,
256, ... tokens, and in indexes of about ITEMS_PER_INDEX items. Indexes of together TOKENS_PER_PASS tokens are sent to the tasks at once; each such pass reads and splits the texts once.

A score is BM25 of the item for the passage's distinct tokens, divided by the item's score for itself. Items stand in blocks of BLOCK; a token's largest share in a
block bounds what it can add there, so only blocks whose bounds add up to the threshold are entered, and in them only items are scored that a pivot stops at. All items at or above it are retrieved, then
verified: the share of the token trigrams of the item's question (all sentences but the last) and of its answer (the last sentence; for an item of
one sentence, its halves) that are in the passage must both reach min_overlap.

Null and empty texts hold nothing, items without tokens are in nothing; repeated rows and items count each. Without items nothing is found. Texts of any length are
searched whole. `clean` keeps columns of any name."""

import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An index has at most about so many items. What is sent to the tasks at once is a group of indexes with at most so many tokens of items (or one index).
ITEMS_PER_INDEX, TOKENS_PER_PASS = 1024, 1 << 19
BLOCK = 8
SLACK = 1e-4  # bounds are rounded
LEAST_STRETCH = 64
K1, B = 1.2, 0.75
THRESHOLD, MIN_OVERLAP = 0.6, 0.6
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BATCH_TOKENS = 400_000
LEAK = "item_id long, score double, question double, answer double"


def tokens(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "replace").lower())


def trigrams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def question_and_answer(text: str) -> tuple[set, set]:
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text) if tokens(s)]
    if len(sentences) > 1:
        return trigrams(tokens(" ".join(sentences[:-1]))), trigrams(tokens(sentences[-1]))
    words = tokens(text)
    half = (len(words) + 1) // 2
    return trigrams(words[:half]), trigrams(words[half:])


@dataclass
class Index:
    """Postings by token number: items (ascending) and shares from start[t] to start[t + 1]; most[t]: the largest share in each block."""

    stretch: int
    ids: list
    parts: list[tuple[set, set]]
    number: dict[bytes, int]
    start: np.ndarray
    items: array
    shares: array
    most: np.ndarray


def build(rows: list[tuple[int, str]], stretch: int, df: dict[bytes, int], n_items: int, mean: float) -> Index:
    number: dict[bytes, int] = {}
    post: list[list[tuple[int, float]]] = []
    for i, (_, text) in enumerate(rows):
        words = tokens(text)
        tf: dict[bytes, int] = {}
        for w in words:
            tf[w] = tf.get(w, 0) + 1
        norm = K1 * (1 - B + B * len(words) / mean)
        gain = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + norm) for w, f in tf.items()}
        own = sum(gain.values())
        for w, g in gain.items():
            if w not in number:
                number[w] = len(number)
                post.append([])
            post[number[w]].append((i, g / own))
    most = np.zeros((len(number) + 1, -(-len(rows) // BLOCK)), np.float32)
    for t, ps in enumerate(post):
        for i, g in ps:
            most[t, i // BLOCK] = max(most[t, i // BLOCK], g)
    start = np.cumsum([0, *map(len, post)])
    flat = [p for ps in post for p in ps]
    return Index(stretch, [i for i, _ in rows], [question_and_answer(t) for _, t in rows], number, start, array("q", (i for i, _ in flat)), array("d", (g for _, g in flat)), most)


def indexes(items: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[Index]:
    """The indexes of all items. Document frequencies and lengths are those of all items."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tokens(t or "") for t in batch.column(0).to_pylist()]
            own = [w for words in found for w in set(words)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], ["term"])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(tokens(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], ["item_id", "text", "n"])

    picked = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    measured = picked.mapInArrow(sizes, "item_id long, text string, n long").filter("n > 0")
    measured = measured.withColumn("stretch", F.greatest(F.lit(LEAST_STRETCH), F.expr("cast(power(2, length(bin(n - 1))) as long)")))
    groups = measured.groupBy("stretch").agg(F.count("*").alias("items"), F.sum("n").alias("n")).orderBy("stretch").collect()  # a row per doubling of the length
    total = sum(g["items"] for g in groups)
    mean = sum(g["n"] for g in groups) / max(total, 1)
    counts = picked.select("text").mapInArrow(terms, "term binary").groupBy("term").agg(F.count("*").alias("df"))
    for g in groups:
        parts = -(-g["items"] // max(1, min(ITEMS_PER_INDEX, TOKENS_PER_PASS // g["stretch"])))
        for p in range(parts):
            here = measured.filter(F.col("stretch") == g["stretch"]).filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
            rows = [(r["item_id"], r["text"]) for r in here.orderBy("item_id", "text").collect()]  # about ITEMS_PER_INDEX
            if rows:
                own = here.select("text").mapInArrow(terms, "term binary").distinct()
                df = {bytes(r["term"]): r["df"] for r in counts.join(own, "term").collect()}
                yield build(rows, g["stretch"], df, total, mean)


def passes(items: DataFrame) -> Iterator[list[Index]]:
    """The indexes in groups that are sent together."""
    group: list[Index] = []
    size = 0
    for index in indexes(items):
        own = index.stretch * len(index.ids)
        if group and size + own > TOKENS_PER_PASS:
            yield group
            group, size = [], 0
        group.append(index)
        size += own
    if group:
        yield group


def wand(index: Index, terms: np.ndarray, blocks: list[int], threshold: float) -> list[tuple[int, float]]:
    """Block-max WAND: the items of some blocks (ascending) that score at least the threshold for a passage with these terms, and their scores.
    Posting lists stand in the order of their next items. The pivot is the first item at which the lists' largest shares in its block, summed in that order, can reach the threshold;
    lists before it are moved on to it, so what lies between is never scored. Blocks that aren't given are leapt over."""
    items, shares, out = index.items, index.shares, []
    at, ends = index.start[terms].tolist(), index.start[terms + 1].tolist()
    for block in blocks:
        low, high = block * BLOCK, (block + 1) * BLOCK
        bounds = index.most[terms, block]
        lists = []  # next item, place of its posting, end of the list, largest share
        for j in np.flatnonzero(bounds).tolist():
            at[j] = bisect_left(items, low, at[j], ends[j])
            lists.append([items[at[j]], at[j], ends[j], float(bounds[j])])
        while True:
            lists.sort()
            reach, pivot = SLACK, None
            for item, _, _, bound in lists:
                reach += bound
                if reach >= threshold:
                    pivot = item
                    break
            if pivot is None:
                break
            whole, got = lists[0][0] == pivot, []
            for x in lists:
                if x[0] > pivot or (x[0] == pivot and not whole):
                    break
                if whole:
                    got.append(shares[x[1]])
                    x[1] += 1
                else:
                    x[1] = bisect_left(items, pivot, x[1], x[2])
                x[0] = items[x[1]] if x[1] < x[2] else high
            score = math.fsum(got)  # the same in whatever index an item stands
            if whole and score >= threshold:
                out.append((pivot, score))
            lists = [x for x in lists if x[0] < high]
    return out


def search(index: Index, texts: list[str | None], threshold: float, min_overlap: float) -> list[dict[int, tuple[float, float, float]]]:
    """For each text: item (its place in the index) -> score, question and answer share of its best verified passage."""
    return search_words(index, [tokens(t or "") for t in texts], threshold, min_overlap)


def search_words(index: Index, words: list[list[bytes]], threshold: float, min_overlap: float) -> list[dict[int, tuple[float, float, float]]]:
    """search of texts that are split already."""
    none, vocabulary = len(index.number), len(index.number) + 1
    get = index.number.get
    out: list[dict[int, tuple[float, float, float]]] = [{} for _ in words]
    lengths = np.array([len(w) for w in words], np.int64)
    per_text = -(-lengths // index.stretch)
    first = np.r_[0, np.cumsum(per_text)]
    if not first[-1]:
        return out
    ids = np.fromiter((get(w, none) for ws in words for w in ws), np.int64, int(lengths.sum()))
    place = np.arange(len(ids)) - np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    stretch = np.repeat(first[:-1], lengths) + place // index.stretch
    known = ids != none
    pairs = np.unique(stretch[known] * vocabulary + ids[known])
    at, term = pairs // vocabulary, pairs % vocabulary
    ends = np.searchsorted(at, np.arange(first[-1] + 2))
    passage, block = _live_blocks(index, at, term, int(first[-1]), threshold)
    blocks_of: dict[int, list[int]] = {}
    for p, b in zip(passage.tolist(), block.tolist(), strict=True):
        blocks_of.setdefault(p, []).append(b)
    text_of = np.searchsorted(first, np.arange(first[-1]), side="right") - 1
    for p, blocks in blocks_of.items():
        t = int(text_of[p])
        terms = np.unique(term[ends[p] : ends[p + (2 if p + 1 < first[t + 1] else 1)]])  # the last stretch of a text has no next
        hits = wand(index, terms, blocks, threshold)
        if hits:
            lo = (p - int(first[t])) * index.stretch
            own = trigrams_of(words[t][lo : lo + 2 * index.stretch])
            for i, score in hits:
                q, a = (len(x & own) / len(x) if x else 1.0 for x in index.parts[i])
                if q >= min_overlap and a >= min_overlap and (score, q, a) > out[t].get(i, (0.0, 0.0, 0.0)):
                    out[t][i] = (score, q, a)
    return out


def _live_blocks(index: Index, at: np.ndarray, term: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a passage (by its first stretch, of n) and a block of items that it can reach the threshold in; at, term: the distinct terms of the stretches.
    A passage whose terms' largest shares don't add up to the threshold has no pivot in any block, and its blocks aren't looked at."""
    most = np.bincount(at, index.most.max(axis=1, initial=0)[term], n + 1)
    open_ = most[:-1] + most[1:] >= threshold - SLACK
    needed = np.r_[open_, False] | np.r_[False, open_]
    row = np.cumsum(needed) - 1
    seen = needed[at]
    at, term = row[at[seen]], term[seen]
    bound = np.zeros((int(needed.sum()) + 1, index.most.shape[1]), np.float32)
    if len(at):
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        bound[at[starts]] = np.add.reduceat(index.most[term], starts, axis=0)
    rows = np.flatnonzero(open_)
    which, block = np.nonzero(bound[row[rows]] + bound[row[rows] + 1] >= threshold - SLACK)  # a passage is a stretch and the next
    return rows[which], block


def trigrams_of(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """All runs of one to three tokens."""
    return {tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def _batched(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of a bounded number of characters, one text at least."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t or "") > BATCH_TOKENS * 6:
            yield lo, i
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """key, item_id, score, question, answer: a row for each text and the items it holds."""
    sc = docs.sparkSession.sparkContext
    picked = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], f"{key} long, {LEAK}")
    for group in passes(items):
        shared = sc.broadcast(group)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, texts, found = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
                for lo, hi in _batched(texts):
                    words = [tokens(t or "") for t in texts[lo:hi]]
                    for index in shared.value:
                        for k, hits in zip(keys[lo:hi], search_words(index, words, threshold, min_overlap), strict=True):
                            found += [(k, index.ids[i], *x) for i, x in sorted(hits.items())]
                cols = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])], [key, "item_id", "score", "question", "answer"])

        out = out.unionAll(picked.mapInArrow(rows, f"{key} long, {LEAK}"))
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """The rows of docs that hold no item, with all their columns. Nothing is shuffled."""
    sc, columns = docs.sparkSession.sparkContext, docs.columns
    rest = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(text).cast("string").alias("text"))
    for group in passes(items):
        shared = sc.broadcast(group)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                kept = np.ones(len(texts), bool)
                for lo, hi in _batched(texts):
                    words = [tokens(t or "") for t in texts[lo:hi]]
                    for index in shared.value:
                        kept[lo:hi] &= [not hits for hits in search_words(index, words, threshold, min_overlap)]
                yield batch.filter(pa.array(kept))

        rest = rest.mapInArrow(rows, rest.schema)
    return rest.select("row.*")
