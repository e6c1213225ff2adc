"""Pieces of a public vocabulary and sums over the segmentations of words."""

from functools import lru_cache

import numpy as np

TOKENIZERS = "/opt/tokenizers"
MAX_PIECE = 16
#: Words of more characters are summed one by one and in logarithms, since their probabilities leave the range of doubles; the others side by side.
SIDE_BY_SIDE = 24


@lru_cache(maxsize=2)
def vocabulary(path: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> dict[str, int]:
    """Pieces in the file's order -> number from 0, without control and byte pieces; the mark of a word's start is U+2581."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    kept = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {p: i for i, p in enumerate(p for p in kept if len(p) <= MAX_PIECE)}


class PieceTable:
    """Piece numbers of many strings at once: hash tables over numpy arrays. A key that finds its place taken goes to the next table."""

    SLOTS = 20
    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: dict[str, int]):
        self.pieces, self.unknown = pieces, len(pieces)
        self.power = np.array([pow(int(self.BASE), k, 1 << 64) for k in range(MAX_PIECE + 1)], np.uint64)
        texts = list(pieces)
        left = self.hashes(texts), np.array([pieces[t] for t in texts], np.int32)
        self.tables = []
        while len(left[0]):
            keys, ids = np.zeros(1 << self.SLOTS, np.uint64), np.full(1 << self.SLOTS, -1, np.int32)
            at = self._slot(left[0], len(self.tables))
            keys[at], ids[at] = left
            missed = ids[at] != left[1]
            left = left[0][missed], left[1][missed]
            self.tables.append((keys, ids))

    def _slot(self, h: np.ndarray, n: int) -> np.ndarray:
        return ((h * np.uint64(0xC2B2AE3D27D4EB4F + 2 * n)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def hashes(self, texts: list[str]) -> np.ndarray:
        codes, lengths = code_points(texts)
        h = prefix_hashes(codes)[np.arange(len(texts)), lengths]
        return h ^ (lengths.astype(np.uint64) << np.uint64(56))

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, -1, np.int32)
        for n, (keys, ids) in enumerate(self.tables):
            at = self._slot(h, n)
            np.copyto(out, ids[at], where=keys[at] == h)
        return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) with 0 after the end, and the lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    width = int(lengths.max(initial=0))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(texts), width), np.uint64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out, lengths


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the first 0, 1, ... code points of each row."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * PieceTable.BASE + codes[:, i]
    return out


def lattice(words: list[str], table: PieceTable) -> np.ndarray:
    """Piece numbers, (end, length - 1, word); -1 where there is none, and one past the last piece for a character that is no piece."""
    codes, lengths = code_points(words)
    width = codes.shape[1]
    sums = prefix_hashes(codes).T.copy()
    out = np.full((width + 1, min(MAX_PIECE, max(width, 1)), len(words)), -1, np.int32)
    for end in range(1, width + 1):
        there = lengths >= end
        for k in range(1, min(end, out.shape[1]) + 1):
            found = table.find((sums[end] - sums[end - k] * table.power[k]) ^ np.uint64(k << 56))
            if k == 1:
                found = np.where(found < 0, table.unknown, found)
            out[end, k - 1] = np.where(there, found, -1)
    return out


def forward(found: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """alpha, (end, word, model): the summed probability of all segmentations of each beginning of each word. prob: (piece + unknown, model)."""
    width, longest, n = found.shape
    alpha = np.zeros((width, n, prob.shape[1]))
    alpha[0] = 1
    for end in range(1, width):
        for k in range(1, min(end, longest) + 1):
            at = np.flatnonzero(found[end, k - 1] >= 0)
            if len(at):
                alpha[end, at] += alpha[end - k, at] * prob[found[end, k - 1, at]]
    return alpha


def expected_counts(found: np.ndarray, lengths: np.ndarray, weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, (piece + unknown, model), each word weighted by (word, model): forward and backward."""
    width, longest, n = found.shape
    alpha, beta = forward(found, prob), np.zeros((width, n, prob.shape[1]))
    beta[lengths, np.arange(n)] = 1
    for start in range(width - 2, -1, -1):
        for k in range(1, min(width - 1 - start, longest) + 1):
            at = np.flatnonzero(found[start + k, k - 1] >= 0)
            if len(at):
                beta[start, at] += beta[start + k, at] * prob[found[start + k, k - 1, at]]
    share = weight / np.maximum(alpha[lengths, np.arange(n)], 1e-300)
    out = np.zeros_like(prob)
    for end in range(1, width):
        for k in range(1, min(end, longest) + 1):
            ids = found[end, k - 1]
            at = np.flatnonzero(ids >= 0)
            if len(at):
                mass = alpha[end - k, at] * prob[ids[at]] * beta[end, at] * share[at]
                for m in range(prob.shape[1]):
                    out[:, m] += np.bincount(ids[at], mass[:, m], len(prob))
    return out


def ways(word: str, table: PieceTable, end: int) -> tuple[list[int], list[int]]:
    """The pieces that end after `end` characters of the word: their lengths and numbers."""
    lengths, ids = [], []
    for k in range(1, min(end, MAX_PIECE) + 1):
        found = table.pieces.get(word[end - k : end], table.unknown if k == 1 else None)
        if found is not None:
            lengths.append(k)
            ids.append(found)
    return lengths, ids


def log_forward(word: str, table: PieceTable, log_prob: np.ndarray) -> np.ndarray:
    """The logarithm of the summed probability of all segmentations of one word of any length, by model. Only the last MAX_PIECE sums are held."""
    recent = np.zeros((MAX_PIECE, log_prob.shape[1]))  # of the beginning of e characters at e % MAX_PIECE
    for end in range(1, len(word) + 1):
        lengths, ids = ways(word, table, end)
        recent[end % MAX_PIECE] = np.logaddexp.reduce(recent[[(end - k) % MAX_PIECE for k in lengths]] + log_prob[ids], axis=0)
    return recent[len(word) % MAX_PIECE]


def long_word_counts(word: str, table: PieceTable, weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """expected_counts of one word of any length."""
    n, log_prob = len(word), np.log(prob)
    alpha, beta = np.full((n + 1, prob.shape[1]), -np.inf), np.full((n + 1, prob.shape[1]), -np.inf)
    alpha[0] = beta[n] = 0
    steps = [ways(word, table, end) for end in range(1, n + 1)]
    for end, (lengths, ids) in enumerate(steps, 1):
        alpha[end] = np.logaddexp.reduce(alpha[[end - k for k in lengths]] + log_prob[ids], axis=0)
    for end in range(n, 0, -1):
        lengths, ids = steps[end - 1]
        at = [end - k for k in lengths]
        beta[at] = np.logaddexp(beta[at], beta[end] + log_prob[ids])
    out = np.zeros_like(prob)
    for end, (lengths, ids) in enumerate(steps, 1):
        np.add.at(out, ids, np.exp(alpha[[end - k for k in lengths]] + log_prob[ids] + beta[end] - alpha[n]) * weight)
    return out
