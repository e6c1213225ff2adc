"""Phrase collocations by Toivonen's sampling: a sample proposes frequent phrases; one pass over all texts counts these and their negative border exactly; border phrases
that turn out frequent trigger further passes, until no phrase that could be frequent is uncounted.

Everything is counted within a language (null: und). A text (null: empty) has A-Z lower-cased and is split at [.,;:!?\\x0A-\\x0D] into pieces, these into words [^\\x20\\x09]+;
a phrase is up to 3 words in a row within a piece, all its occurrences counted. A phrase can only be frequent (min_count times) if the words and the two-word phrases in it are.

The sample is the documents whose text hashes to 0 modulo 1 / SHARE; a phrase is proposed that is found there at least lowered() times. A pass counts a phrase exactly if all its shorter
phrases are proposed, that is, the proposed phrases and those just beyond them, as far as they occur at all (words always). What is proposed goes to the tasks as sets of bits,
of a bounded size, so that a few phrases more than needed may be counted; their counts are exact too. After a pass the words and two-word phrases that are frequent and weren't proposed
open what was not counted: the next pass proposes all that are known to be frequent, and counts what no pass before it has counted. There are at most three passes.

Candidates are phrases of 2 and 3 words. Repeated rows count each; texts of any length are read whole; other columns and an empty table don't matter."""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suffixspark.operators.running import running_total
from suffixspark.session import cut

#: Share of the documents that the sample holds, as 1 / so many. It decides how much is counted in which pass, not what is found.
ONE_IN = 4
#: A set of bits has 2 to the power of at least and at most this: it goes through the driver to all tasks, one of 2 ** 27 bits is 16 MB. The driver gets it in blocks of so many words.
LEAST_BITS, MOST_BITS, BLOCK = 20, 27, 4096
#: Texts whose phrases are added up together: until their bytes are this many.
BYTES_AT_ONCE = 3 << 20
#: Counts of phrases are sent to the tasks up to this many rows; more are joined.
SENT_ROWS = 200_000
UNKNOWN = "und"
#: The score of a cut. Counts have at most 16 digits, so that 10^6 a a and l r have at most 38 and are exact.
EXACT = "cast(cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) as decimal(32,0)) * cast(1000000 as decimal(7,0)) as decimal(38,0)) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"
#: What each byte becomes: the ends of pieces a dot, a tab a space, A-Z a-z.
_TO = bytes(ord(".") if b in b".,;:!?\n\x0b\x0c\r" else ord(" ") if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def lowered(min_count: int, share: float) -> int:
    """How often a phrase is in the sample to be proposed: a little less than its share of min_count."""
    return max(1, int(0.8 * min_count * share))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def _next_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(before * _MIX[0] + word)


def _word_hashes(words: list[bytes], seeds: list[int]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh64_intdigest, words, seeds)), np.uint64)


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


class Bits:
    """A set of hashes, kept as one bit each in a table of a bounded size."""

    def __init__(self, power: int, words: np.ndarray):
        self.shift, self.words = np.uint64(64 - power), words

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _bits_of(phrases: DataFrame, rows: int) -> Bits:
    """The set of the given phrases (lang, phrase; `rows` rows, all of as many words). Tasks make the hashes; the driver gets a bounded number of words of bits."""
    power = min(MOST_BITS, max(LEAST_BITS, (8 * max(rows, 1)).bit_length()))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seeds = list(map(_seed, pdf["lang"]))
            split = [p.encode().split(b" ") for p in pdf["phrase"]]
            out = _word_hashes([w[0] for w in split], seeds)
            for k in range(1, len(split[0]) if split else 1):  # all of one length
                out = _next_hash(out, _word_hashes([w[k] for w in split], seeds))
            at = out >> np.uint64(64 - power)
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bit": (at & np.uint64(63)).astype(np.int32)})

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        words = np.zeros(BLOCK, np.int64)
        words[pdf["word"].to_numpy(np.int64) % BLOCK] = pdf["bits"].to_numpy(np.int64)
        return pd.DataFrame({"block": pdf["word"].iloc[:1] // BLOCK, "words": [words.tobytes()]})

    set_words = phrases.select("lang", "phrase").mapInPandas(places, "word long, bit int").groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    blocks = set_words.groupBy(F.expr(f"word div {BLOCK}L").alias("block")).applyInPandas(block, "block long, words binary")  # a group has at most BLOCK rows
    words = np.zeros(max(BLOCK, 1 << (power - 6)), np.uint64)
    for r in blocks.collect():  # a set of bits, of a bounded size
        words[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["words"], np.uint64)
    return Bits(power, words)


def _portions(langs: list[str | None], texts: pa.Array) -> Iterator[tuple[str, bytes]]:
    """The texts of a batch by language, put together until they are long; a dot between two of them, so that no phrase goes across."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for lang, text in zip(langs, texts, strict=True):
        lang, text = UNKNOWN if lang is None else lang, text.as_py() or b""
        held.setdefault(lang, []).append(text)
        size[lang] = size.get(lang, 0) + len(text)
        if size[lang] >= BYTES_AT_ONCE:
            yield lang, b".".join(held.pop(lang))
            del size[lang]
    for lang, some in held.items():
        yield lang, b".".join(some)


def _numbered(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The different words, and the number of each word in turn; -1 where a piece ends."""
    whole = pa.array([text.translate(_TO).replace(b".", b" . ")], pa.large_binary())
    split = pc.split_pattern(whole, b" ").values.dictionary_encode()
    names = split.dictionary
    plain = ~np.isin(names.to_numpy(zero_copy_only=False), [b"", b"."])
    number = np.where(plain, np.cumsum(plain) - 1, -1)
    number[names.to_numpy(zero_copy_only=False) == b""] = -2
    ids = number[split.indices.to_numpy(zero_copy_only=False)]
    return names.filter(pa.array(plain)).cast(pa.large_string()), ids[ids > -2]


def _spaced(*parts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))


def _counted(ids: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of two or three columns of numbers below size, and how often each is there."""
    if len(ids) == 3 and size >= 1 << 21:  # three numbers don't fit 63 bits
        pairs, which = np.unique(ids[0] * size + ids[1], return_inverse=True)
        (at, last), n = _counted([which.reshape(-1), ids[2]], max(size, len(pairs)))
        return [pairs[at] // size, pairs[at] % size, last], n
    key = ids[0]
    for x in ids[1:]:
        key = key * size + x
    key, n = np.unique(key, return_counts=True)
    out = []
    for _ in ids[1:]:
        key, last = np.divmod(key, size)
        out.append(last)
    return [key, *reversed(out)], n


def _phrases(lang: str, text: bytes, proposed: tuple[Bits, Bits] | None, before: list[tuple[Bits, Bits]], n_words: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """Length, phrases, counts, and whether each is proposed, of those phrases of up to n_words words that this pass counts. The first pass also gives the number of all words, as of length 0."""
    names, ids = _numbered(text)
    size = len(names)
    if not size:
        return
    hashes = _word_hashes(names.cast(pa.large_binary()).to_pylist(), [_seed(lang)] * size)
    yes = lambda sets, k, h: np.ones(len(h), bool) if sets is None else sets[k].has(h)
    word_in, old_word = yes(proposed, 0, hashes), [s[0].has(hashes) for s in before]
    spaced = lambda found: _spaced(*(names.take(pa.array(x)) for x in found))
    if not before:
        times = np.bincount(ids[ids >= 0], minlength=size)
        yield 0, pa.array([""], pa.large_string()), times.sum(keepdims=True), np.ones(1, bool)
        yield 1, names, times, word_in
    # the two words that begin at each place: are they counted at all, in this pass, and do they let phrases of three be counted, in this pass or before
    a, b = ids[:-1], ids[1:]
    two = np.flatnonzero((a >= 0) & (b >= 0) & word_in[a] & word_in[b])
    a, b = a[two], b[two]
    pair_hash = _next_hash(hashes[a], hashes[b])
    known = yes(proposed, 1, pair_hash)
    counted, opened = np.zeros(len(two), bool), []
    for s, old in zip(before, old_word, strict=True):
        both = old[a] & old[b]
        counted |= both
        opened.append(both & s[1].has(pair_hash))
    for which in (True, False):
        new = np.flatnonzero(~counted & (known == which))
        if len(new) and n_words > 1:
            found, n = _counted([a[new], b[new]], size)
            yield 2, spaced(found), n, np.full(len(n), which)
    if n_words < 3:
        return
    place = np.full(len(ids), -1, np.int64)
    place[two[known]] = np.flatnonzero(known)
    x, y = place[:-2], place[1:-1]
    three = np.flatnonzero((x >= 0) & (y >= 0))
    x, y = x[three], y[three]
    done = np.zeros(len(three), bool)
    for s in opened:
        done |= s[x] & s[y]
    x, y = x[~done], y[~done]
    if len(x):
        found, n = _counted([a[x], b[x], b[y]], size)
        yield 3, spaced(found), n, np.ones(len(n), bool)


def _counts(docs: DataFrame, proposed: tuple[Bits, Bits] | None, before: list[tuple[Bits, Bits]], least: int, n_words: int = 3) -> DataFrame:
    """lang, phrase, k (its words), known (whether it is proposed), n, for n >= least (and all words, k = 0). Phrases are added up in each batch, then in each task, then shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast((proposed, before))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proposed, before = shared.value
        pa.set_memory_pool(pa.system_memory_pool())  # which gives memory back at once
        for batch in batches:
            for lang, text in _portions(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                for _, phrases, n, known in _phrases(lang, text, proposed, before, n_words):
                    for lo in range(0, len(phrases), 1 << 16):
                        part, size = phrases.slice(lo, 1 << 16), min(1 << 16, len(phrases) - lo)
                        key = pc.binary_join_element_wise(pa.scalar(lang, pa.large_string()), part, pa.scalar("\n", pa.large_string()))
                        yield pa.RecordBatch.from_arrays([key.cast(pa.string()), pa.array(known[lo : lo + size]), pa.array(n[lo : lo + size].astype(np.int64))], ["key", "known", "n"])

    found = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(rows, "key string, known boolean, n long")
    # one short key: the language, a line end (no phrase has one) and the phrase
    summed = found.groupBy("key", "known").agg(F.sum("n").alias("n")).withColumn("phrase", F.substring_index("key", "\n", -1))
    k = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1)
    lang = F.left("key", F.length("key") - F.length("phrase") - 1)
    return summed.filter((F.col("n") >= least) | F.col("key").endswith("\n")).select(lang.alias("lang"), "phrase", k.alias("k"), "known", "n")


def _proposal(frequent: DataFrame) -> tuple[Bits, Bits]:
    of = {r["k"]: r["count"] for r in frequent.groupBy("k").count().collect()}  # at most 3 rows
    return tuple(_bits_of(frequent.filter(F.col("k") == k), of.get(k, 0)) for k in (1, 2))


def frequent_phrases(docs: DataFrame, min_count: int = 10, one_in: int = ONE_IN, least_in_sample: int | None = None) -> tuple[DataFrame, int]:
    """lang, phrase, k, n of all phrases of k = 1 to 3 words found at least min_count times, and with k = 0 the number of words; then how many passes over all texts it took."""
    sample = docs.filter(F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(one_in)) == 0)
    least = lowered(min_count, 1 / one_in) if least_in_sample is None else least_in_sample
    proposed, before, tables = _proposal(cut(_counts(sample, None, [], least, 2))), [], []
    while True:
        tables.append(cut(_counts(docs, proposed, before, min_count)))
        if tables[-1].filter("k < 3 and not known").isEmpty():
            return reduce(DataFrame.unionByName, tables).drop("known"), len(tables)
        before = [*before, proposed]
        proposed = _proposal(reduce(DataFrame.unionByName, tables))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """df, to be sent to all tasks if it has at most so many rows; else joins shuffle, and Spark splits the rows that ask for a very common key."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def collocations(docs: DataFrame, min_count: int = 10, first: int = 2000, inside: int = 50, one_in: int = ONE_IN, sent_rows: int = SENT_ROWS, least_in_sample: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score. a, l, r: how often the phrase and its two parts are found, n: words of the language;
    score: floor(1000000 a a / (l r)) at the cut that makes it lowest. Phrases inside a longer one that is found `inside` % as often are left out."""
    docs = docs.select("lang", "text")
    frequent, _ = frequent_phrases(docs, min_count, one_in, least_in_sample)
    of = _sent(frequent.filter("k > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("part_n")), sent_rows)
    candidates = frequent.filter("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    left, right = F.array_join(F.slice("w", F.lit(1), F.col("cut")), " "), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ")
    asked = cuts.select("lang", "phrase", "k", "a", "cut", left.alias("part"), right.alias("right"))
    with_left = asked.join(of, ["lang", "part"]).select("lang", "phrase", "k", "a", "cut", F.col("part_n").alias("l"), F.col("right").alias("part"))
    both = with_left.join(of, ["lang", "part"]).withColumnRenamed("part_n", "r")
    lowest = both.withColumn("score", F.expr(EXACT)).groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    scored = lowest.select("lang", "phrase", "k", "a", "m.l", "m.r", "m.score")
    longer = candidates.filter("k = 3").select("lang", "a", F.explode(F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 2), " "))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = scored.join(most, ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (100 * F.col("longest") < inside * F.col("a")))
    order = kept.select("lang", "phrase", "a", "l", "r", "score", (-F.col("score")).alias("by_score"), (-F.col("a")).alias("by_a"), F.lit(1).cast("long").alias("one"))
    placed = running_total(order, ["lang", "by_score", "by_a", "phrase"], "one", "place")
    begin = placed.groupBy("lang").agg(F.min("place").alias("begin")).join(frequent.filter("k = 0").select("lang", "n"), "lang")
    ranked = placed.join(_sent(begin, sent_rows), "lang").withColumn("rank", F.col("place") - F.col("begin") + 1).filter(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
