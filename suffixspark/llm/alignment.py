"""Cross-tokenizer alignment by interval coalescing: which tokens of one tokenizer overlap which of another.

Tokenizer A is a byte-level BPE (a tokenizers JSON file), B a sentencepiece model; both encode a space and the text, without special tokens. Their tokens are byte
ranges. All ranges are lexsorted by start, the ends are accumulated to a running maximum, and a group ends where a start reaches it: there A and B tokens
both end. Within a group, the places where a token starts part the bytes; each part lies in one A and one B token, and these two are linked.

Neither tokenizer joins what stands before a space with the space, so a text is cut into units at its spaces, and each different unit is encoded and aligned once in a task
(a text with two white-space characters around a space, or a space at its end, is one unit: there the split of white space depends on what follows).
What is found is written to a table with the links of each text, so that no text is encoded twice. Links are counted over the corpus by pairs of ids, and the counts go to all tasks: at most `sent_rows` pairs, the most frequent ones, each 17 bytes. The others are joined.

Null and empty texts, and those whose A or B bytes differ from the space and the text, have no tokens. Repeated rows (also of null or repeated doc_id) count each.
An empty table gives an empty result. Texts of any length are encoded whole. Columns of any name can be carried: they stay inside `row`."""

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suffixspark.llm.pieces import TOKENIZERS
from suffixspark.llm.rows import give_back, row_and, sliced
from suffixspark.session import cut

BYTE_BPE, PIECE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
#: Pairs whose counts are sent to all tasks.
SENT_ROWS = 2_000_000
#: A task's aligned units are forgotten when they are this many, or this many characters.
MAX_UNITS, MAX_CHARS = 150_000, 8 << 20
#: Texts that are aligned together: this many, or until their characters are this many.
TEXTS_AT_ONCE, CHARS_AT_ONCE = 256, 1 << 19
#: White space around a space: the split of such a run depends on more than the unit.
ODD = re.compile(r"\s (?=\s)|  | $")
#: Units of these characters are encoded so many at once: printable ASCII and Latin letters, no white space.
TOGETHER = 256
PLAIN = re.compile("[!-~\u00c0-\u017f]+")
#: Fixed value: how a byte-level vocabulary cuts texts before it merges bytes.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ALIGNED = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "links": "array<long>"}
RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters themselves, the other bytes in turn from U+0100 on."""
    itself = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in itself]
    return {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers and the bytes of each of their tokens."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte = byte_of_character()
        names = sorted(self.a.get_vocab().items(), key=lambda x: x[1])
        a_bytes = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, _ in names]
        if [i for _, i in names] != list(range(len(names))):
            raise ValueError(f"ids of {byte_bpe} have gaps")
        self.b = SentencePieceProcessor(model_file=piece_bpe)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"pieces of {piece_bpe} go across a space: texts can't be cut into units")
        self.bytes = a_bytes, b_bytes
        self.lengths = tuple(np.array([len(x) for x in of], np.int64) for of in self.bytes)
        self.by_rank = self._by_rank(json.loads(Path(byte_bpe).read_text()))

    def _by_rank(self, file: dict):
        """The same BPE by ranks of tokens, which is faster, or None. It is the same if ids follow the order of the merges, each merge has its own result, and each token is what its own bytes
        are merged to: two tokens that stand side by side and make a token are then the two that its merge names, as within these bytes all was merged as it is when they stand alone."""
        import tiktoken

        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in file["model"]["merges"]]
        pre = file.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or file.get("normalizer"):
            return None
        vocabulary, first = file["model"]["vocab"], 256
        if [vocabulary.get(a + b) for a, b in merges] != list(range(first, first + len(merges))):
            return None
        ranks = {self.bytes[0][i]: i for i in range(first + len(merges))}
        out = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        plain = [t for t, i in vocabulary.items() if first <= i < first + len(merges) and PLAIN.fullmatch(self.bytes[0][i].decode("utf-8", "replace"))]
        texts = [self.bytes[0][vocabulary[t]].decode() for t in plain]
        alone = self.a.encode_batch(texts, add_special_tokens=False)
        return out if all(x.ids == [vocabulary[t]] for t, x in zip(plain, alone, strict=True) if len(x.ids) == 1 or len(self.a.pre_tokenizer.pre_tokenize_str(self.bytes[0][vocabulary[t]].decode())) == 1) else None

    def encode(self, units: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For A and B the ids of the tokens of all units, each with a space before it, in turn, and the unit of each token; then which units have tokens: all but those where the bytes of A or B
        differ from the space and the unit."""
        plain = [i for i, u in enumerate(units) if self.by_rank and PLAIN.fullmatch(u)]
        joined = [" ".join([units[i] for i in plain[lo : lo + TOGETHER]]) for lo in range(0, len(plain), TOGETHER)]
        side = [np.array(list(chain.from_iterable(x)), np.int64) for x in ([self.by_rank.encode_ordinary(" " + t) for t in joined], self.b.encode(joined, num_threads=1))]
        whole = "".join([" " + t for t in joined]).encode()
        if not all(b"".join([of[i] for i in ids.tolist()]) == whole for of, ids in zip(self.bytes, side, strict=True)):
            plain, side = [], (np.zeros(0, np.int64),) * 2
        ends = np.cumsum([len(units[i].encode()) + 1 for i in plain])
        taken = set(plain)
        rest = [i for i in range(len(units)) if i not in taken]
        texts = [units[i] for i in rest]
        ok, found = np.ones(len(units), bool), []
        a = [x.ids for x in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        for k, i in enumerate(rest):
            ok[i] = all(b"".join([of[x] for x in ids]) == b" " + texts[k].encode() for of, ids in zip(self.bytes, (a[k], b[k]), strict=True))
        for ids, lengths, others in zip(side, self.lengths, (a, b), strict=True):
            start = np.cumsum(lengths[ids]) - lengths[ids]
            unit = np.array(plain, np.int64)[np.searchsorted(ends, start, "right")] if plain else np.zeros(0, np.int64)
            kept = [(i, x) for i, x in zip(rest, others, strict=True) if ok[i]]
            ids = np.concatenate([ids, *(np.array(x, np.int64) for _, x in kept)])
            found.append((ids, np.concatenate([unit, np.repeat(np.array([i for i, _ in kept], np.int64), [len(x) for _, x in kept])])))
        return found, ok


@lru_cache(maxsize=1)
def tokenizers_of(byte_bpe: str, piece_bpe: str) -> Tokenizers:
    return Tokenizers(byte_bpe, piece_bpe)


def coalesce(start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For intervals of two kinds (0: A, 1: B): their order by start (A before B), the number of the group of each in that order, and whether a link ends there:
    the A and the B interval that were last begun overlap from this start to the next."""
    order = np.lexsort((kind, start))
    first, reach = start[order], np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = first[1:] >= reach[:-1]
    last_of_start = np.ones(len(order), bool)
    last_of_start[:-1] = first[1:] != first[:-1]
    return order, np.cumsum(breaks) - 1, last_of_start


@lru_cache(maxsize=1 << 18)
def _marked(x: int) -> str:
    return f"{x // 3}{',|;'[x % 3]}"


class Units:
    """Different units of texts, each aligned once. Numbers are dense; a unit without tokens (its bytes differ) has ok false."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers, self.number, self.chars = tokenizers, {}, 0
        self.groups: list[str] = []
        self.counts = np.zeros((0, 3), np.int64)  # A tokens, B tokens, groups
        self.ok = np.zeros(0, bool)
        self.first = np.zeros(1, np.int64)  # where the links of each unit begin
        self.links = np.zeros(0, np.int64)  # a << 32 | b

    def add(self, units: set[str]) -> None:
        new = list(units - self.number.keys())
        if not new:
            return
        self.number |= {u: len(self.number) + i for i, u in enumerate(new)}
        self.chars += sum(map(len, new))
        found, ok = self.tokenizers.encode(new)
        ids, unit = (np.concatenate([side[k] for side in found]) for k in (0, 1))
        kinds = np.repeat(np.arange(2), [len(side[0]) for side in found])
        lengths = np.concatenate([of[side[0]] for of, side in zip(self.tokenizers.lengths, found, strict=True)])
        end = np.concatenate([np.cumsum(lengths[kinds == k]) for k in (0, 1)])  # both cover the bytes of all units, one after the other
        order, group, linked = coalesce(end - lengths, end, kinds)
        ids, kinds, unit = ids[order], kinds[order], unit[order]
        n = len(new)
        a_at, b_at = np.cumsum(kinds == 0) - 1, np.cumsum(kinds == 1) - 1
        links = (ids[kinds == 0][a_at[linked]] << 32) | ids[kinds == 1][b_at[linked]]
        of_group = unit[np.flatnonzero(np.diff(group, prepend=-1))]
        counts = np.stack([np.bincount(unit[kinds == 0], minlength=n), np.bincount(unit[kinds == 1], minlength=n), np.bincount(of_group, minlength=n)], 1)
        self.groups += self._texts(ids, kinds, unit, group, n)
        self.counts = np.concatenate([self.counts, counts])
        self.ok = np.concatenate([self.ok, ok])
        of_link = unit[linked]
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(of_link, minlength=n))])
        self.links = np.concatenate([self.links, links[np.argsort(of_link, kind="stable")]])

    @staticmethod
    def _texts(ids: np.ndarray, kinds: np.ndarray, unit: np.ndarray, group: np.ndarray, n: int) -> list[str]:
        """The groups of each unit, as a1,a2|b1;a3|b2,b3."""
        order = np.lexsort((kinds, group))  # stable: by start within
        k, g = kinds[order], group[order]
        last = np.ones(len(order), bool)
        last[:-1] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
        mark = np.where(last, np.where(k == 0, 1, 2), 0)
        parts = list(map(_marked, (ids[order] * 3 + mark).tolist()))
        of, first = np.unique(unit[order], return_index=True)  # tokens of a unit stand together
        begin = np.sort(first)
        texts = [""] * n
        for u, a, b in zip(unit[order][begin].tolist(), begin.tolist(), np.append(begin, len(parts))[1:].tolist(), strict=True):
            texts[u] = "".join(parts[a:b])[:-1]
        return texts

    def flat(self, numbers: np.ndarray) -> np.ndarray:
        """The places of the links of these units, one after the other."""
        begin, n = self.first[numbers], self.first[numbers + 1] - self.first[numbers]
        return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())


def units_of(text: str) -> list[str]:
    return [text] if ODD.search(text) or text.startswith(" ") else text.split(" ")


def _portions(texts: pa.Array) -> Iterator[list[str]]:
    out, chars = [], 0
    for t in texts:
        out.append(t.as_py() or "")
        chars += len(out[-1])
        if len(out) >= TEXTS_AT_ONCE or chars >= CHARS_AT_ONCE:
            yield out
            out, chars = [], 0
    yield out


def _numbered(cache: dict, texts: list[str], paths: tuple[str, str]) -> tuple[Units, list[np.ndarray]]:
    """The units of each text, as numbers; none for a text that has no tokens."""
    known = cache.get("units")
    if known is None or len(known.number) > MAX_UNITS or known.chars > MAX_CHARS:
        known = cache["units"] = Units(tokenizers_of(*paths))
    split = [units_of(t) if t else [] for t in texts]
    known.add(set().union(*split))
    numbers = [np.fromiter(map(known.number.__getitem__, u), np.int64, len(u)) for u in split]
    return known, [x if known.ok[x].all() else x[:0] for x in numbers]


def aligned(docs: DataFrame, text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, carried: list[str] | None = None) -> DataFrame:
    """row (a struct with the carried columns of docs, by default all), n_a, n_b, n_groups, n_links, groups_sha256, and links: a << 32 | b for each link. Each text is encoded here, and nowhere else."""
    carried = docs.columns if carried is None else carried

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        pa.set_memory_pool(pa.system_memory_pool())  # which gives memory back at once
        for batch in batches:
            done = 0
            for texts in _portions(batch.column("text")):
                known, numbers = _numbered(cache, texts, (byte_bpe, piece_bpe))
                flat, size = np.concatenate([*numbers, np.zeros(0, np.int64)]), np.array([len(x) for x in numbers], np.int64)
                n_links = known.first[flat + 1] - known.first[flat]
                total = _sums(np.concatenate([known.counts[flat], n_links[:, None]], 1), size)
                groups = [";".join(map(known.groups.__getitem__, x.tolist())) for x in numbers]
                sha = [hashlib.sha256(g.encode()).hexdigest() if len(x) else "" for g, x in zip(groups, numbers, strict=True)]
                offsets = pa.array(np.concatenate([[0], np.cumsum(total[:, 3])]).astype(np.int32))
                links = pa.ListArray.from_arrays(offsets, pa.array(known.links[known.flat(flat)]))
                row = batch.column("row").slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([row, *(pa.array(c) for c in total.T.copy()), pa.array(sha, pa.string()), links], ["row", *ALIGNED])
                give_back()
        known = numbers = groups = links = None
        cache.clear()  # the worker lives on, for stages that don't need this
        give_back()

    kept = docs.select(*[F.col(f"`{c}`") for c in carried])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(text).cast("string").alias("text"))
    return packed.mapInArrow(rows, row_and(kept, ", ".join(f"{k} {v}" for k, v in ALIGNED.items())))


def link_counts(found: DataFrame) -> DataFrame:
    """a, b, n, best: each pair of ids that is linked anywhere in aligned texts, its number of links, and whether no other A id has more with this B id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            pair, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair >> 32, pa.int32()), pa.array(pair & 0xFFFFFFFF, pa.int32()), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    pairs = cut(found.select("links").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    highest = pairs.groupBy("b").agg(F.max("n").alias("highest"))  # at most a row for each id of the vocabulary
    return cut(pairs.join(F.broadcast(highest), "b").select("a", "b", "n", (F.col("n") == F.col("highest")).alias("best")))


def _least_sent(counts: DataFrame, sent_rows: int) -> int:
    """The least count from which on at most sent_rows pairs are left."""
    sizes = counts.groupBy(F.length(F.bin("n")).alias("bits")).count().orderBy(F.desc("bits")).collect()  # at most 64 rows
    left, bits = sent_rows, 63
    for r in sizes:
        left -= r["count"]
        if left < 0:
            break
        bits = r["bits"]
    return 1 << (bits - 1)


def align(docs: DataFrame, text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, sent_rows: int = SENT_ROWS, carried: list[str] | None = None) -> DataFrame:
    """row (a struct with the carried columns of docs, by default all), n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    found = cut(aligned(docs, text, byte_bpe, piece_bpe, carried))
    counts = link_counts(found)
    least = _least_sent(counts, sent_rows)
    sent = counts.filter(F.col("n") >= least).select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "n", "best").toPandas().sort_values("pair")
    shared = docs.sparkSession.sparkContext.broadcast((sent["pair"].to_numpy(np.int64), sent["n"].to_numpy(np.int64), sent["best"].to_numpy(bool)))
    whole = least == 1 or counts.filter(F.col("n") < least).isEmpty()
    kept = [f for f in RESULT.split(", ") if f.split()[0] not in ("n_best", "count_sum")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, ns, bests = shared.value
        for batch in sliced(batches):
            links = batch.column("links")
            size, links = np.diff(links.offsets.to_numpy()).astype(np.int64), links.flatten().to_numpy()  # flatten: of the slice alone
            own, at = np.unique(links, return_inverse=True)
            place = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
            sent = pairs[place] == own if len(pairs) else np.zeros(len(own), bool)
            of = np.zeros((len(own), 2), np.int64)
            of[sent] = np.stack([bests[place[sent]], ns[place[sent]]], 1)
            n_best, count_sum = _sums(of[at.reshape(-1)], size).T.copy()
            columns = {"row": batch.column("row"), **{f.split()[0]: batch.column(f.split()[0]) for f in kept}, "n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
            columns = {c: columns[c] for c in names}
            if not whole:
                rare = ~sent[at.reshape(-1)]
                offsets = np.concatenate([[0], np.cumsum(_sums(rare.astype(np.int64)[:, None], size)[:, 0])]).astype(np.int32)
                columns["rest"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(links[rare]))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    names, row = ["row", *(f.split()[0] for f in RESULT.split(", "))], found.select("row.*")
    if whole:
        return found.mapInArrow(rows, row_and(row, RESULT))
    found = cut(found.mapInArrow(rows, row_and(row, f"{RESULT}, rest array<long>")).withColumn("at", F.monotonically_increasing_id()))
    rare = counts.filter(F.col("n") < least).select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "n", "best")
    links = found.select("at", F.explode("rest").alias("pair")).join(rare, "pair")  # a rare pair has few links: no hot key
    more = links.groupBy("at").agg(F.sum(F.col("best").cast("long")).alias("more_best"), F.sum("n").alias("more_sum"))
    both = found.join(more, "at", "left")
    added = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
    return both.withColumns(added).drop("rest", "at", "more_best", "more_sum")


def _sums(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the columns over so many rows in turn."""
    so_far = np.concatenate([np.zeros((1, rows.shape[1]), np.int64), np.cumsum(rows, axis=0)])
    ends = np.cumsum(sizes)
    return so_far[ends] - so_far[ends - sizes]
