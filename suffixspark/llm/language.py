"""Language ID with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all its segmentations into pieces
(forward algorithm); a text's is the product over its words. The piece probabilities are fitted by expectation maximisation on the words of a sample
of at most about sample_per_lang labelled documents of each language, picked by a hash of the id.

Words are runs of letters (Unicode categories L, and M after a letter) of the lower-cased text with the word mark before them, of any length; nothing else of a text is scored.
A text that is null or has no letter is `und` with score 0, and so is every text if nothing was learned. The score is the posterior probability of the
language that is returned; ties go to the smaller language. Documents without text, language or id aren't learned from.
Repeated rows are each learned from and each scored. An empty table gives no rows, and columns of any name, also those of the result, stay inside `row`."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suffixspark.llm.pieces import SIDE_BY_SIDE, TOKENIZERS, PieceTable, expected_counts, forward, lattice, log_forward, long_word_counts, vocabulary
from suffixspark.llm.rows import give_back, row_and, sliced

SAMPLE_PER_LANG = 1000
MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
WORDS_AT_ONCE = 4096
#: The words whose scores a task keeps have at most so many characters together (and one batch).
MEMO_CHARACTERS = 1 << 22
UNKNOWN = "und"


@dataclass
class Languages:
    names: list[str]
    prob: np.ndarray  # (piece + unknown, language)
    prior: np.ndarray  # natural logarithms


def parts(text: str) -> list[str]:
    """The words of a text, as they are scored."""
    return ["▁" + w for w in LETTERS.findall(text.lower())]


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, word, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table: dict[tuple[str, str], int] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for w in parts(t.as_py()):
                    table[name, w] = table.get((name, w), 0) + 1
            names, words = zip(*table, strict=True) if table else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.string()), pa.array(table.values(), pa.int64())], ["lang", "word", "n"])

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    return rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_per_lang: int = SAMPLE_PER_LANG, rounds: int = 3, model: str = MODEL) -> Languages:
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("key is not null and text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    names = sorted(sizes)
    pieces = vocabulary(model)
    if not names:
        return Languages([], np.zeros((len(pieces) + 1, 0)), np.zeros(0))
    million = 1_000_000
    share = F.create_map(*[F.lit(x) for n in names for x in (n, max(1, int(million * min(1.0, sample_per_lang / sizes[n]))))])
    sample = known.filter(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(million)) < share[F.col("lang")])
    table = word_counts(sample, "text", "lang").toPandas()  # words of the bounded sample
    prior = np.log(np.array([sizes[n] for n in names], float) / sum(sizes.values()))
    prob = np.full((len(pieces) + 1, len(names)), 1.0 / (len(pieces) + 1))
    if len(table):
        tables = PieceTable(pieces)
        words = sorted(set(table["word"]), key=lambda w: (len(w), w))
        number = {w: i for i, w in enumerate(words)}
        weight = np.zeros((len(words), len(names)))
        weight[table["word"].map(number), table["lang"].map({n: i for i, n in enumerate(names)})] = table["n"]
        short = sum(len(w) <= SIDE_BY_SIDE for w in words)
        for _ in range(rounds):
            counts = np.zeros_like(prob)
            for lo in range(0, short, WORDS_AT_ONCE):
                some = words[lo : min(lo + WORDS_AT_ONCE, short)]
                counts += expected_counts(lattice(some, tables), np.array([len(w) for w in some]), weight[lo : lo + len(some)], prob)
            for i in range(short, len(words)):
                counts += long_word_counts(words[i], tables, weight[i], prob)
            prob = (counts + 0.01) / (counts + 0.01).sum(axis=0)
    return Languages(names, prob, prior)


class Scorer:
    """Texts -> log probabilities by language. The scores of words are kept up to MEMO_CHARACTERS, then gathered anew."""

    def __init__(self, languages: Languages, pieces: dict[str, int]):
        self.of, self.table, self.log_prob = languages, PieceTable(pieces), np.log(languages.prob)
        self._clear()

    def _clear(self) -> None:
        self.number, self.size, self.rows = {}, 0, np.empty((WORDS_AT_ONCE, len(self.of.names)))

    def _add(self, words: list[str]) -> None:
        words, new, old = sorted(words, key=len), [], len(self.number)
        short = sum(len(w) <= SIDE_BY_SIDE for w in words)
        for lo in range(0, short, WORDS_AT_ONCE):
            some = words[lo : min(lo + WORDS_AT_ONCE, short)]
            alpha = forward(lattice(some, self.table), self.of.prob)
            new.append(np.log(np.maximum(alpha[[len(w) for w in some], np.arange(len(some))], 1e-300)))
        new += [log_forward(w, self.table, self.log_prob)[None, :] for w in words[short:]]
        self.size += sum(map(len, words))
        if old + len(words) > len(self.rows):  # half as much again, so that few copies are made
            self.rows = np.concatenate([self.rows[:old], np.empty((len(words) + old // 2, self.rows.shape[1]))])
        self.rows[old : old + len(words)] = np.concatenate(new)
        self.number.update(zip(words, range(old, old + len(words)), strict=True))

    def score(self, texts: list[str]) -> np.ndarray:
        split = [parts(t) for t in texts]
        if self.size > MEMO_CHARACTERS:
            self._clear()
        missing = set().union(*split) - self.number.keys()
        if missing:
            self._add(list(missing))
        get = self.number.__getitem__
        sums = [self.rows[np.fromiter(map(get, w), np.int64, len(w))].sum(axis=0) for w in split]
        return np.array(sums).reshape(len(texts), -1) + self.of.prior


def predict(docs: DataFrame, languages: Languages, text: str = "text", model: str = MODEL) -> DataFrame:
    """row (a struct with the columns of docs), lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, vocabulary(model)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from label(batches)
        give_back()  # what the task's scorer held; the worker lives on

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in sliced(batches):
            scorer = scorer or Scorer(*shared.value)
            names, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            texts = batch.column("text").to_pylist()
            at = [i for i, t in enumerate(texts) if t and LETTERS.search(t)] if languages_known else []
            for lo in range(0, len(at), 256):
                some = at[lo : lo + 256]
                logs = scorer.score([texts[i] for i in some])
                best = logs.argmax(axis=1)
                top = logs[np.arange(len(some)), best]
                score[some] = 1 / np.exp(logs - top[:, None]).sum(axis=1)
                for i, b in zip(some, best.tolist(), strict=True):
                    names[i] = scorer.of.names[b]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    languages_known = bool(languages.names)
    return docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text")).mapInArrow(rows, row_and(docs, "lang_pred string, score double"))


def held_out(key: Column, of: int) -> Column:
    """True of one in `of` documents, by the CRC-32 of the id as text; null ids are held out."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % of == 0, F.lit(True))
