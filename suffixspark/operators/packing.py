"""Packing: s neighbouring symbols become one integer that sorts as they do. Texts are packed chunk by chunk, with a row for each cell and none for a byte."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suffixspark.operators.codes import SENT_ALPHABETS, alphabets
from suffixspark.session import cut
from suffixspark.sources.chunks import CHUNK, chunk_keys, text_chunks, with_fields

MOST_BITS = 62


def bitpack(df: DataFrame, s: int) -> DataFrame:
    """keys, cell, code of every text (keys..., content). Codes are at most 62 bits: s * bits_per_char beyond that raises."""
    return bitpack_chunks(text_chunks(df, CHUNK, s), s, raises=True).drop("piece")


def bitpack_wide(df: DataFrame, s: int) -> DataFrame:
    """keys, cell, piece, code for cells of any width: a cell is cut into pieces of as many symbols as 62 bits hold. The pieces of a cell in turn sort as the cell does."""
    return bitpack_chunks(text_chunks(df, CHUNK, s), s)


def bitpack_chunks(chunks: DataFrame, s: int, raises: bool = False) -> DataFrame:
    """The same from chunks (keys..., offset, content, after) whose halo is s or more. A symbol is its rank in its text's alphabet, in as many bits as the alphabet needs; a short last cell is padded with 0."""
    keys = chunk_keys(chunks)
    known = alphabets(chunks)
    if keys:
        known = cut(known)
        named = chunks.join(F.broadcast(known) if known.count() <= SENT_ALPHABETS else known, keys)
    else:
        named = chunks.crossJoin(F.broadcast(known))  # one row

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                offset, content, after, alphabet = (batch.column(c)[i] for c in ("offset", "content", "after", "alphabet"))
                more = np.frombuffer(after.as_buffer(), np.uint8)
                bits = (len(alphabet) - 1).bit_length()
                if raises and bits * s > MOST_BITS:
                    raise ValueError(f"a cell of {s} symbols needs more than {MOST_BITS} bits")
                rank = np.zeros(256, np.int64)
                rank[alphabet.as_py()] = np.arange(len(alphabet))
                text, offset = np.frombuffer(content.as_buffer(), np.uint8), offset.as_py()
                size, take = len(text) + len(more), MOST_BITS // max(bits, 1)
                ranks = np.concatenate([rank[text], rank[more], np.zeros(s, np.int64)])
                at = np.arange(-offset % s, len(text), s)
                cells, pieces, codes = [], [], []
                for piece, begin in enumerate(range(0, s, take)):
                    own = at[at + begin < size]
                    code = np.zeros(len(own), np.int64)
                    for k in range(begin, min(begin + take, s)):
                        code = (code << bits) | ranks[own + k]
                    cells.append((own + offset) // s)
                    pieces.append(np.full(len(own), piece))
                    codes.append(code)
                n = sum(map(len, cells))
                own_keys = batch.select(keys).take(pa.array(np.full(n, i))).columns if keys else []
                yield pa.RecordBatch.from_arrays([*own_keys, *(pa.array(np.concatenate(c).astype(np.int64)) for c in (cells, pieces, codes))], [*keys, "cell", "piece", "code"])

    return named.select(*keys, "offset", "content", "after", "alphabet").mapInArrow(rows, with_fields(chunks, keys, "cell long, piece long, code long"))
