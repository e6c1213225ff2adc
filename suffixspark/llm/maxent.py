"""Language-model scoring with a hashed maximum-entropy model.

Tokens are words (runs of bytes other than ASCII white space, A-Z lower-cased) and one end per text. A token's probability is
P(class | features) * P(token | class, features). Features are the tokens before it: the last one, the last two together, and the last but one and
two (skips), hashed. The class comes from a softmax over them. Within its class a token comes from a second one over the same features, factored by a Huffman tree over the
class's words: at each node the features, hashed with the node, choose one of two sides by a softmax whose bias is the sides' training counts. Without weights that gives each token its share of the
class. The class of rare tokens (fewer than HEAD_COUNT, or not among the HEAD most frequent) also has room for unknown ones, and there a token has (c + 0.1) / (sum over its tokens of
(c + 0.1) + 0.1). The end is a class of its own. Frequent tokens are put into classes by k-means over the hashed tokens beside them, the rest of the head by rank.

Everything is learned from all training rows: counts in one pass with a shuffle of distinct tokens; then texts are written once as numbers, from which the neighbours of
frequent tokens are counted, and ROUNDS passes of gradient updates are made, in which every task steps through its own rows in sparse minibatches and the weights of both softmaxes are averaged by rows. Scoring reads
the numbers too; rare tokens meet their counts in a join, so no vocabulary is held whole. base is the add-0.1 unigram score.

Null texts are empty: they have the end alone. Rows that repeat are scored each. Nothing to learn from leaves the counts at 0: a base of
log10(0.1 / 0.1) a token, and a score of 0 for an end."""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suffixspark.llm.rows import give_back
from suffixspark.session import cut

HEAD, HEAD_COUNT, BUCKETS, ROUNDS = 1 << 16, 3, 1 << 14, 1
CLUSTERS, NEIGHBOURS, LEAST_SEEN, SEEDS = 12, 64, 64, 256
LOCAL_WORDS = 200_000
MINIBATCH, RATE = 16_384, 0.3
#: Weights of tree nodes, and the tokens of a minibatch of theirs: a node meets few tokens of each.
NODE_BUCKETS, NODE_MINIBATCH, NODE_RATE = 1 << 20, 65_536, 0.6
#: Tokens whose nodes are in memory at once.
AT_ONCE = 8192
FEATURES = 4
SMOOTH = 0.1


def words_of(text: pa.Scalar) -> list[bytes]:
    return (text.as_py() or b"").lower().split()


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8").alias("text"))


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: the counts of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.binary()), pa.array(np.fromiter(totals.values(), np.int64, len(totals)))], ["word", "n"])

        for _, split in _groups(batches, "text"):
            totals.update(chain.from_iterable(split))
            if len(totals) > LOCAL_WORDS:
                yield out()
                totals.clear()
        yield out()
        totals.clear()
        give_back()

    return _texts(docs, text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Codes(dict):
    """Words -> their codes in a coded text: head words have their id. After the rare id and the end come NEIGHBOURS codes of rare words, by hash."""

    def __missing__(self, word: bytes) -> int:
        return len(self) + 2 + xxhash.xxh32_intdigest(word) % NEIGHBOURS


def encode(docs: DataFrame, number: dict[bytes, int], key: Column | None = None, learn: Column | None = None, text: str = "text") -> DataFrame:
    """doc_id, learn, ids (the int32 codes of a text's tokens, the end with them), rare (the words outside the head, in order)."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(shared.value)
        end = len(codes) + 1
        for batch, split in _groups(batches, "text"):
            flat = list(chain.from_iterable(split))
            lengths = np.fromiter(map(len, split), np.int64, len(split))
            at = np.cumsum(lengths + 1)
            ids = np.full(len(flat) + len(split), end, np.int32)
            body = np.ones(len(ids), bool)
            body[at - 1] = False
            ids[body] = words = np.fromiter(map(codes.__getitem__, flat), np.int32, len(flat))
            rare = np.flatnonzero(words > end)
            none = np.searchsorted(rare, np.r_[0, np.cumsum(lengths)])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("learn"), pa.Array.from_buffers(pa.large_binary(), len(split), [None, pa.py_buffer(4 * np.r_[0, at]), pa.py_buffer(ids)]).cast(pa.binary()),
                pa.ListArray.from_arrays(pa.array(none, pa.int32()), pa.array([flat[i] for i in rare.tolist()], pa.binary())),
            ], ["doc_id", "learn", "ids", "rare"])
        give_back()

    doc_id, learned = F.lit(None) if key is None else key, F.lit(True) if learn is None else learn
    rows_in = docs.select(doc_id.cast("long").alias("doc_id"), learned.alias("learn"), F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8").alias("text"))
    return rows_in.mapInArrow(rows, "doc_id long, learn boolean, ids binary, rare array<binary>")


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Coded rows in groups of a bounded number of tokens: the rows, the codes of all, and the number of tokens of each."""
    for batch in batches:
        column = batch.column("ids").cast(pa.large_binary())
        if not len(column):
            continue
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
        codes = np.frombuffer(column.buffers()[2], np.int32)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + 4 * NODE_MINIBATCH, "right")) - 1)
            yield batch.slice(lo, hi - lo), codes[ends[lo] : ends[hi]], np.diff(ends[lo : hi + 1])
            lo = hi
    give_back()


def _hash_of(number: dict[bytes, int]) -> np.ndarray:
    """The neighbour hash of each code; -1 for the end."""
    return np.array([*(xxhash.xxh32_intdigest(w) % NEIGHBOURS for w in number), -1, -1, *range(NEIGHBOURS)], np.int64)


def count_neighbours(docs: DataFrame, number: dict[bytes, int], text: str = "text") -> np.ndarray:
    """(id, hash): how often a word that is beside the word of that id has that hash, over all rows."""
    return _neighbours(encode(docs, number, text=text), number, len(number))


def _neighbours(coded: DataFrame, number: dict[bytes, int], asked: int) -> np.ndarray:
    """The same of the first ids, from coded rows. A task holds a table of the ids that are asked for."""
    shared = coded.sparkSession.sparkContext.broadcast(_hash_of(number))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = shared.value
        beside = np.zeros(asked * NEIGHBOURS, np.int64)
        for _, codes, _ in _coded(batches):
            hashes = hash_of[codes]
            for a, h in ((codes[:-1], hashes[1:]), (codes[1:], hashes[:-1])):
                at = np.flatnonzero((a < asked) & (h >= 0))
                np.add.at(beside, a[at].astype(np.int64) * NEIGHBOURS + h[at], 1)
        yield from _slices(beside, 1)

    out = np.zeros(asked * NEIGHBOURS)
    if asked:
        _add_slices(coded.select("ids").mapInArrow(count, _SLICES), np.int64, out)  # HEAD * NEIGHBOURS numbers at most
    return out.reshape(asked, NEIGHBOURS)


_SLICES, SLICE = "place int, weight double, numbers binary", 4096


def _slices(numbers: np.ndarray, weight: float) -> Iterator[pa.RecordBatch]:
    """A task's table in rows of SLICE numbers; those of zeros alone are left out."""
    some = [(lo // SLICE, numbers[lo : lo + SLICE]) for lo in range(0, len(numbers), SLICE)]
    places, parts = zip(*[(i, x.tobytes()) for i, x in some if x.any()], strict=True) if numbers.any() else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([float(weight)] * len(places), pa.float64()), pa.array(parts, pa.binary())], ["place", "weight", "numbers"])


def _add_slices(rows: DataFrame, kind: type, out: np.ndarray) -> None:
    """Write the sums of the tasks' numbers times weights to out."""

    def add(table: pa.Table) -> pa.Table:
        total: np.ndarray | float = 0.0
        for weight, numbers in zip(table["weight"].to_pylist(), table["numbers"], strict=True):
            total = total + np.frombuffer(numbers.as_py(), kind).astype(np.float64) * weight
        return pa.table({"place": table["place"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    for r in rows.groupBy("place").applyInArrow(add, "place int, sums binary").collect():
        sums = np.frombuffer(r["sums"])
        out[r["place"] * SLICE :][: len(sums)] = sums


@dataclass
class Trees:
    """A Huffman tree for each class, over its head words. A word's nodes are start[id] to start[id + 1] of node and side."""

    start: np.ndarray
    node: np.ndarray
    side: np.ndarray  # 1 or 0
    bias: np.ndarray  # of each node: log(training count of side 1 / of side 0)


def grow_trees(count: np.ndarray, class_of: np.ndarray) -> Trees:
    """From the head words' counts (1 at least) and classes; rare words and the end, the last two ids, have no nodes."""
    n = len(count) - 2
    mass, parent, side, nodes = [*count[:n].tolist(), *[0] * n], np.full(2 * n, -1), np.zeros(2 * n, np.int8), n
    for c in np.unique(class_of[:n]):
        own = np.flatnonzero(class_of[:n] == c)
        leaves = own[np.argsort(count[own], kind="stable")].tolist()
        i, j, made = 0, nodes, nodes
        for _ in range(len(leaves) - 1):  # the two lightest of leaves and nodes are joined; both lists are in order
            for s in (0, 1):
                leaf = i < len(leaves) and (j == made or mass[leaves[i]] <= mass[j])
                x = leaves[i] if leaf else j
                i, j = i + leaf, j + (not leaf)
                parent[x], side[x] = made, s
                mass[made] += mass[x]
            made += 1
        nodes = made
    total = np.array(mass, float)
    bias = np.zeros(nodes - n)
    for s, sign in ((1, 1), (0, -1)):
        of = np.flatnonzero((parent >= 0) & (side == s))
        bias[parent[of] - n] += sign * np.log(total[of])
    words, at, found = np.arange(n), np.arange(n), []
    while len(words):
        inside = parent[at] >= 0
        words, at = words[inside], at[inside]
        found.append((words, parent[at] - n, side[at]))
        at = parent[at]
    word, node, of_side = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    order = np.argsort(word, kind="stable")
    start = np.searchsorted(word[order], np.arange(n + 3))
    return Trees(start, node[order].astype(np.uint32), of_side[order].astype(np.int8), bias.astype(np.float32))


@dataclass
class Model:
    number: dict[bytes, int]  # head word -> id; rare words are id len(number), the end is the id after it
    count: np.ndarray  # of each id; the rare words' together
    class_of: np.ndarray
    bias: np.ndarray  # of classes
    weights: np.ndarray  # (bucket, class)
    trees: Trees
    node_weights: np.ndarray  # of hashes of node and feature
    train_tokens: int
    distinct: int
    rare_mass: float  # sum over rare words of (c + 0.1), + 0.1

    @property
    def rare(self) -> int:
        return len(self.number)

    @property
    def end(self) -> int:
        return len(self.number) + 1

    @property
    def inside(self) -> np.ndarray:
        """log10 P(id | class) before any weight is learned: shares of the counts, 0 for rare words and the end."""
        of_class = np.bincount(self.class_of, self.count)
        return np.where(np.arange(len(self.count)) < self.rare, np.log10(np.maximum(self.count, 1) / np.maximum(of_class[self.class_of], 1)), 0.0)


def _clusters(vectors: np.ndarray, k: int) -> np.ndarray:
    """k-means of rows of counts, each as heavy as its sum; the first centres are far from each other among the SEEDS heaviest."""
    k = min(k, len(vectors))
    if not k:
        return np.zeros(0, np.int64)
    mass = vectors.sum(axis=1)
    x = np.sqrt(vectors / mass[:, None])
    heavy = x[np.argsort(-mass, kind="stable")[:SEEDS]]
    centres = [heavy[0]]
    for _ in range(1, min(k, len(heavy))):
        centres.append(heavy[np.min([((heavy - c) ** 2).sum(axis=1) for c in centres], axis=0).argmax()])
    centre = np.array(centres)
    for _ in range(20):
        own = ((x**2).sum(axis=1)[:, None] + (centre**2).sum(axis=1) - 2 * x @ centre.T).argmin(axis=1)
        centre = np.array([np.average(x[own == j], axis=0, weights=mass[own == j]) if (own == j).any() else centre[j] for j in range(len(centre))])
    return own


@dataclass
class Head:
    number: dict[bytes, int]  # word -> id, most frequent first
    n: np.ndarray  # the counts
    tokens: int  # of all words
    distinct: int


def head_words(counts: DataFrame) -> Head:
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    head = counts.filter(F.col("n") >= HEAD_COUNT).orderBy(F.desc("n"), "word").limit(HEAD).select("word", "n").collect()  # HEAD rows at most
    return Head({bytes(r["word"]): i for i, r in enumerate(head)}, np.array([r["n"] for r in head], np.int64), sums["n"] or 0, sums["v"] or 0)


def vocabulary(docs: DataFrame, counts: DataFrame, n_texts: int, text: str = "text") -> Model:
    """The model before training, from the rows and the table of count_words."""
    head = head_words(counts)
    return start_model(encode(docs, head.number, text=text), head, n_texts)


def start_model(coded: DataFrame, head: Head, n_texts: int) -> Model:
    """The model before training, from coded rows and their head."""
    size = len(head.number)
    rare_n, rare_v = head.tokens - int(head.n.sum()), head.distinct - size
    often = int((2 * head.n >= LEAST_SEEN).sum())  # the others have too few neighbours: two a token at most
    table = np.zeros((size, NEIGHBOURS))
    table[:often] = _neighbours(coded, head.number, often)
    class_of = np.where(np.arange(size) < HEAD // 4, CLUSTERS, CLUSTERS + 1)
    seen = np.flatnonzero(table.sum(axis=1) >= LEAST_SEEN)
    class_of[seen] = _clusters(table[seen], CLUSTERS)
    class_of = np.concatenate([class_of, [CLUSTERS + 2, CLUSTERS + 3]]).astype(np.int64)
    count = np.concatenate([head.n, [rare_n, n_texts]])
    of_class = np.bincount(class_of, count, CLUSTERS + 4)
    bias = np.log((of_class + 0.5) / (of_class + 0.5).sum())
    weights, node_weights = np.zeros((BUCKETS, len(bias)), np.float32), np.zeros(NODE_BUCKETS, np.float32)
    return Model(head.number, count, class_of, bias, weights, grow_trees(count, class_of), node_weights, head.tokens + n_texts, head.distinct + (n_texts > 0), rare_v * SMOOTH + rare_n + SMOOTH)


def contexts(ids: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """(FEATURES, token): 32-bit hashes of the tokens before each."""
    place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    before = []
    for k in (1, 2, 3):
        x = np.full(len(ids), end + 1, np.uint64)
        x[k:] = ids[:-k] if len(ids) > k else ids[:0]
        x[place < k] = end + 1
        before.append(x)
    mixed = [before[0] * np.uint64(0x9E3779B97F4A7C15), (before[0] * np.uint64(1_000_003) + before[1]) * np.uint64(0xC2B2AE3D27D4EB4F), before[1] * np.uint64(0x165667B19E3779F9), before[2] * np.uint64(0x27D4EB2F165667C5)]
    return np.stack([(m >> np.uint64(32)).astype(np.uint32) for m in mixed])


def buckets_of(context: np.ndarray) -> np.ndarray:
    """(token, FEATURES)."""
    return (context >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64).T


class Encoder(dict):
    """Words -> ids; unknown ones are rare."""

    def __init__(self, model: Model):
        super().__init__(model.number)
        self.model = model

    def __missing__(self, word: bytes) -> int:
        return self.model.rare

    def encode(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all tokens with the ends, the text of each, and the feature buckets (token, FEATURES)."""
        lengths = np.array([len(w) + 1 for w in split], np.int64)
        ids = np.full(int(lengths.sum()), self.model.end, np.int64)
        body = np.ones(len(ids), bool)
        body[np.cumsum(lengths) - 1] = False
        ids[body] = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(body.sum()))
        return ids, np.repeat(np.arange(len(split)), lengths), buckets_of(contexts(ids, lengths, self.model.end))


def log_classes(model: Model, buckets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Natural log P(class | features), (token, class)."""
    rows = weights.take(buckets[:, 0], axis=0)
    for k in range(1, FEATURES):
        rows += weights.take(buckets[:, k], axis=0)
    logits = np.ascontiguousarray(rows.T)
    logits += model.bias.astype(np.float32)[:, None]
    logits -= logits.max(axis=0)
    logits -= np.log(np.exp(logits).sum(axis=0))
    return logits.T


def node_steps(trees: Trees, ids: np.ndarray, context: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of all tokens, token by token: log-odds of the side that a token takes, the places of the weights (feature, node), and that side (1 or -1)."""
    first = trees.start[ids]
    depth = trees.start[ids + 1] - first
    at = np.arange(int(depth.sum())) + np.repeat(first - np.cumsum(depth) + depth, depth)
    node = trees.node.take(at)
    sign = (2 * trees.side.take(at) - 1).astype(np.float32)
    odds, salt, places = trees.bias.take(node), node * np.uint32(0x9E3779B1), np.empty((len(context), len(node)), np.int64)
    for c, place in zip(context, places, strict=True):
        x = np.repeat(c, depth)
        x ^= salt
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        x >>= np.uint32(32 - NODE_BUCKETS.bit_length() + 1)
        place[:] = x
        odds += weights.take(place)
    odds *= sign
    return odds, places, sign


def log_inside(trees: Trees, ids: np.ndarray, context: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Natural log P(token | class, features); 0 for rare words and the end."""
    odds, _, _ = node_steps(trees, ids, context, weights)
    np.maximum(odds, -80, out=odds)  # exp stays finite
    sums = np.concatenate([[0.0], np.cumsum(np.log(1 + np.exp(-odds)), dtype=np.float64)])
    ends = np.cumsum(trees.start[ids + 1] - trees.start[ids])
    return sums[np.r_[0, ends[:-1]]] - sums[ends]


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Rows in groups of a bounded number of tokens."""
    for batch in batches:
        lo, split, n = 0, [], 0
        for i, t in enumerate(batch.column(column)):
            split.append(words_of(t))
            n += len(split[-1]) + 1
            if n > 200_000 or i == batch.num_rows - 1:
                yield batch.slice(lo, len(split)), split
                lo, split, n = i + 1, [], 0


def _adagrad(weights: np.ndarray, squares: np.ndarray, step: np.ndarray, rate: float) -> None:
    squares += step * step
    step *= rate
    step /= np.sqrt(squares)
    weights -= step


def class_step(m: Model, ids: np.ndarray, buckets: np.ndarray, weights: np.ndarray, squares: np.ndarray) -> None:
    gradient = np.exp(log_classes(m, buckets, weights).T).astype(np.float64)
    gradient[m.class_of[ids], np.arange(len(ids))] -= 1
    flat = np.ascontiguousarray(buckets.T).reshape(-1)
    step = np.empty(weights.shape, np.float32)
    for j, g in enumerate(gradient):
        step[:, j] = np.bincount(flat, np.tile(g, FEATURES), len(weights))
    _adagrad(weights, squares, step, RATE)


def node_step(m: Model, ids: np.ndarray, context: np.ndarray, weights: np.ndarray, squares: np.ndarray, step: np.ndarray) -> None:
    """step: room for a gradient."""
    step.fill(0)
    for lo in range(0, len(ids), AT_ONCE):
        odds, places, sign = node_steps(m.trees, ids[lo : lo + AT_ONCE], context[:, lo : lo + AT_ONCE], weights)
        np.minimum(odds, 80, out=odds)
        gradient = -sign / (1 + np.exp(odds))
        for p in places:
            np.add.at(step, p, gradient)
    _adagrad(weights, squares, step, NODE_RATE)


def train_round(coded: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """One pass of gradient updates over all coded rows: the averages of the tasks' weights of classes and nodes, by tokens."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights, nodes, seen = m.weights.copy(), m.node_weights.copy(), 0
        squares, node_squares, step = np.ones(weights.shape, np.float32), np.ones(nodes.shape, np.float32), np.empty(nodes.shape, np.float32)
        for _, codes, lengths in _coded(batches):
            ids = np.where(codes > m.end, m.rare, codes)
            context = contexts(ids, lengths, m.end)
            buckets = buckets_of(context)
            for lo in range(0, len(ids), MINIBATCH):
                class_step(m, ids[lo : lo + MINIBATCH], buckets[lo : lo + MINIBATCH], weights, squares)
            for lo in range(0, len(ids), NODE_MINIBATCH):
                node_step(m, ids[lo : lo + NODE_MINIBATCH], context[:, lo : lo + NODE_MINIBATCH], nodes, node_squares, step)
            seen += len(ids)
        yield from _slices(np.concatenate([weights.reshape(-1), nodes, np.ones(1, np.float32)]), seen)

    out = np.zeros(model.weights.size + model.node_weights.size + 1)  # the last one is for the tokens
    _add_slices(coded.select("ids").mapInArrow(learn, _SLICES), np.float32, out)
    out = (out[:-1] / max(out[-1], 1)).astype(np.float32)
    return out[: model.weights.size].reshape(model.weights.shape), out[model.weights.size :]


def train_coded(coded: DataFrame, head: Head, rounds: int = ROUNDS) -> Model:
    model = start_model(coded, head, coded.count())
    for _ in range(rounds):
        model.weights, model.node_weights = train_round(coded, model)
    return model


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and the table of all words' counts (word, n)."""
    counts = cut(count_words(docs, text))
    head = head_words(counts)
    return train_coded(cut(encode(docs, head.number, text=text)), head, rounds), counts


def train_and_score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows scored by the model of those for which learn is true; each text is split and numbered once for both."""
    counts = cut(count_words(docs.filter(learn), text))
    head = head_words(counts)
    coded = _numbered(encode(docs, head.number, F.col(key), learn, text))
    return score_coded(coded, train_coded(coded.filter("learn"), head), counts)


def _numbered(coded: DataFrame) -> DataFrame:
    return cut(coded.withColumn("row", F.monotonically_increasing_id()))


def score(docs: DataFrame, model: Model, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    return score_coded(_numbered(encode(docs, model.number, F.col(key), text=text)), model, counts)


_PARTS = "row long, doc_id long, n_tokens long, n_known long, base double, score double"


def token_logs(m: Model, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log P(token | tokens before it); of rare words, that of their class."""
    context = contexts(ids, lengths, m.end)
    buckets, logs = buckets_of(context), np.empty(len(ids))
    for lo in range(0, len(ids), AT_ONCE):
        some = ids[lo : lo + AT_ONCE]
        classes = log_classes(m, buckets[lo : lo + AT_ONCE], m.weights)
        logs[lo : lo + AT_ONCE] = classes[np.arange(len(some)), m.class_of[some]] + log_inside(m.trees, some, context[:, lo : lo + AT_ONCE], m.node_weights)
    return logs


def score_coded(coded: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast(model)
    log_all = float(np.log10(model.train_tokens + SMOOTH * (model.distinct + 1)))
    log_rare = float(np.log10(model.rare_mass))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        base_of = np.log10(m.count + SMOOTH) - log_all
        base_of[m.rare] = -log_all  # the join adds log10(c + 0.1)
        for batch, codes, lengths in _coded(batches):
            ids = np.where(codes > m.end, m.rare, codes)
            logs = token_logs(m, ids, lengths) / np.log(10)
            logs[ids == m.rare] -= log_rare
            starts = np.cumsum(lengths) - lengths
            sums = [np.add.reduceat(x, starts) for x in (((ids != m.rare) & (m.count[ids] > 0)).astype(np.int64), base_of[ids], logs)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(lengths), *map(pa.array, sums)], ["row", "doc_id", "n_tokens", "n_known", "base", "score"])

    texts = coded.select("row", "doc_id", "ids").mapInArrow(parts, _PARTS)
    rare = coded.select("row", F.explode("rare").alias("word")).join(counts.withColumnRenamed("n", "c"), "word", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)
    rare = rare.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), (F.coalesce("c", F.lit(0)) > 0).cast("long").alias("n_known"), log.alias("base"), log.alias("score"))
    sums = texts.unionAll(rare).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def held_out(key: Column) -> Column:
    """True of one document in ten, by the CRC-32 of the id as text; null ids are held out."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 10 == 0, F.lit(True))
