"""Token counts with a trie: distinct pre-tokens are inserted in a trie, and the unigram forward score of each prefix is found once.

A pre-token is a run of bytes other than ASCII white space, with the word mark before it. A piece's probability falls with its place in the fixed public
vocabulary, as 1 / (place + 1). The forward score of a trie node is the best log probability over the segmentations of its prefix; with it goes
the number of tokens of that segmentation (ties: fewer tokens). A character that is no piece counts as one token per UTF-8 byte, each as improbable as the last piece.
The node a pre-token ends at has its count of tokens; a text's is the sum over its pre-tokens. Null and empty texts have none.
A task keeps its trie over all its batches. It is the best segmentation that is scored, not their sum: token counts are those of one segmentation.
Repeated rows are counted each. An empty table gives no rows, and columns of any name stay inside `row`."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suffixspark.llm.pieces import MAX_PIECE, TOKENIZERS, PieceTable, code_points, prefix_hashes, vocabulary
from suffixspark.llm.rows import row_and

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
#: A trie that has grown to this many words is begun anew; counts don't change by it.
MAX_WORDS = 400_000
#: The trie is so many characters deep: a longer word leaves it there and goes on by itself. Words are inserted in groups of at most so many characters, padded.
DEPTH, CELLS = 512, 1 << 20
TEXTS_AT_ONCE = 512
MARK = "▁"


class Trie:
    """Pre-tokens (bytes) -> tokens and log probability. The nodes of a level are the different prefixes of that length of all words so far, in the order of their hashes,
    with their forward scores. Words that are new are inserted together, level by level: nodes that are there already are looked up, new ones are scored from the nodes above them."""

    def __init__(self, pieces: dict[str, int], max_words: int = MAX_WORDS):
        self.pieces, self.table, self.max_words = pieces, PieceTable(pieces), max_words
        self.worst = -math.log(len(pieces) + 1)
        self.cost = -np.log(np.arange(1, len(pieces) + 1))
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.tokens, self.score = np.zeros(0, np.int64), np.zeros(0)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # hashes, scores, tokens
        self.nodes_scored = 0

    def look_up(self, split: list[list[bytes]]) -> list[np.ndarray]:
        """The numbers of the words of each text, for tokens and score."""
        if len(self.number) > self.max_words:
            self._clear()
        missing = set().union(*split) - self.number.keys()
        if missing:
            self._insert(list(missing))
        get = self.number.__getitem__
        return [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in split]

    def _insert(self, words: list[bytes]) -> None:
        texts = [MARK + w.decode("utf-8", "replace") for w in words]
        order = sorted(range(len(words)), key=lambda i: len(texts[i]))
        tokens, score, lo = [self.tokens], [self.score], 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * min(len(texts[order[hi]]), DEPTH) <= CELLS:
                hi += 1
            t, s = self._levels([texts[i] for i in order[lo:hi]])
            tokens.append(t)
            score.append(s)
            lo = hi
        first = len(self.tokens)
        self.number |= {words[i]: first + k for k, i in enumerate(order)}
        self.tokens, self.score = np.concatenate(tokens), np.concatenate(score)

    def _levels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, lengths = code_points([t[:DEPTH] for t in texts])
        sums, n = prefix_hashes(codes).T.copy(), len(texts)
        node = [np.zeros(n, np.int64)]  # of each word at each level
        score, tokens = [np.zeros(1)], [np.zeros(1, np.int64)]
        last_score, last_tokens = np.zeros(n), np.zeros(n, np.int64)
        for end in range(1, codes.shape[1] + 1):
            there = np.flatnonzero(lengths >= end)
            hashes, example, own = np.unique(sums[end, there], return_index=True, return_inverse=True)
            example = there[example]
            at = np.full(n, -1, np.int64)
            at[there] = own
            if len(self.levels) < end:
                self.levels.append((np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)))
            kept, kept_score, kept_tokens = self.levels[end - 1]
            place = np.searchsorted(kept, hashes)
            old = np.zeros(len(hashes), bool)
            inside = place < len(kept)
            old[inside] = kept[place[inside]] == hashes[inside]
            best, fewest = np.zeros(len(hashes)), np.zeros(len(hashes), np.int64)
            best[old], fewest[old] = kept_score[place[old]], kept_tokens[place[old]]
            new = ~old
            if new.any():
                best[new], fewest[new] = self._score(end, example[new], codes, sums, node, score, tokens)
                self.nodes_scored += int(new.sum())
                self.levels[end - 1] = tuple(np.insert(a, place[new], b[new]) for a, b in ((kept, hashes), (kept_score, best), (kept_tokens, fewest)))
            node.append(at)
            score.append(best)
            tokens.append(fewest)
            over = np.flatnonzero(lengths == end)
            last_score[over], last_tokens[over] = best[at[over]], fewest[at[over]]
        for i in [i for i, t in enumerate(texts) if len(t) > DEPTH]:
            above = [(float(score[e][node[e][i]]), int(tokens[e][node[e][i]])) for e in range(DEPTH - MAX_PIECE + 1, DEPTH + 1)]
            last_score[i], last_tokens[i] = self._beyond(texts[i], above)
        return last_tokens, last_score

    def _score(self, end: int, example: np.ndarray, codes: np.ndarray, sums: np.ndarray, node: list, score: list, tokens: list) -> tuple[np.ndarray, np.ndarray]:
        """Forward scores and tokens of new nodes of a level, each given by a word that goes through it."""
        units = utf8_length(codes[example, end - 1])
        above = node[end - 1][example]
        best, fewest = score[end - 1][above] + units * self.worst, tokens[end - 1][above] + units
        for k in range(1, min(end, MAX_PIECE) + 1):
            found = self.table.find((sums[end, example] - sums[end - k, example] * self.table.power[k]) ^ np.uint64(k << 56))
            hit = np.flatnonzero(found >= 0)
            above = node[end - k][example[hit]]
            s, t = score[end - k][above] + self.cost[found[hit]], tokens[end - k][above] + 1
            better = (s > best[hit]) | ((s == best[hit]) & (t < fewest[hit]))
            best[hit[better]], fewest[hit[better]] = s[better], t[better]
        return best, fewest

    def _beyond(self, text: str, recent: list[tuple[float, int]]) -> tuple[float, int]:
        """Score and tokens of a word that leaves the trie, from those of its last MAX_PIECE nodes."""
        for end in range(DEPTH + 1, len(text) + 1):
            n = len(text[end - 1].encode("utf-8", "replace"))
            best = (recent[-1][0] + n * self.worst, -(recent[-1][1] + n))
            for k in range(1, len(recent) + 1):
                p = self.pieces.get(text[end - k : end])
                if p is not None:
                    best = max(best, (recent[-k][0] + float(self.cost[p]), -(recent[-k][1] + 1)))
            recent = [*recent[-MAX_PIECE + 1 :], (best[0], -best[1])]
        return recent[-1]


def utf8_length(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


def count_tokens(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """row (a struct with the columns of docs), n_pretokens, n_tokens, log_prob (natural, of the best segmentation)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = None
        for batch in batches:
            trie = trie if trie is not None else Trie(shared.value)
            n, tokens, logs, texts = [], [], [], batch.column("text").cast(pa.binary())
            for lo in range(0, batch.num_rows, TEXTS_AT_ONCE):
                for at in trie.look_up([(t.as_py() or b"").split() for t in texts[lo : lo + TEXTS_AT_ONCE]]):
                    n.append(len(at))
                    tokens.append(int(trie.tokens[at].sum()))
                    logs.append(math.fsum(trie.score[at].tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(logs, pa.float64())], ["row", "n_pretokens", "n_tokens", "log_prob"])

    packed = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))
    return packed.mapInArrow(rows, row_and(docs, "n_pretokens long, n_tokens long, log_prob double"))


def pretoken_counts(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """pretoken, n (its occurrences, the terminal count), n_tokens (of one occurrence), over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            for t in batch.column(0).cast(pa.binary()):
                for w in (t.as_py() or b"").split():
                    seen[w] = seen.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["pretoken", "n"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = None
        for batch in batches:
            trie = trie if trie is not None else Trie(shared.value)
            (at,) = trie.look_up([[w.encode() for w in batch.column(0).to_pylist()]])
            found = trie.tokens[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], ["pretoken", "n", "n_tokens"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(count, "pretoken string, n long")
    return rows.groupBy("pretoken").agg(F.sum("n").alias("n")).mapInArrow(score, "pretoken string, n long, n_tokens long")
