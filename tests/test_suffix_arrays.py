import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import numpy as np
from suffixspark.jobs.build_ssa import build, main
from suffixspark.operators import alphabet, compress, packing
from suffixspark.operators.suffix_sort import full_then_sample, sparse_suffix_array, suffix_order
from suffixspark.sources.ssa_file import read_header, read_ssa
from suffixspark.sources.texts import as_bytes, joined_symbols, sized, symbols
from suffixspark.streaming.arrivals import suffix_arrays, watch_folder

# Text, s -> packed codes, suffix array.
SMALL = [
    (b"banana", 1, [1, 0, 2, 0, 2, 0], [5, 3, 1, 0, 4, 2]), (b"banana", 2, [4, 8, 8], [0, 4, 2]), (b"banana", 3, [18, 8], [3, 0]), (b"bab", 2, [2, 2], [2, 0]),
    (b"aaaaa", 2, [0, 0, 0], [4, 2, 0]), (b"abcabcab$", 3, [27, 27, 24], [6, 3, 0]), (b"MKV-MKL$", 2, [34, 41, 34, 24], [6, 4, 0, 2]), (b"ACGT\n", 2, [10, 28, 0], [4, 0, 2]),
    (b"a", 4, [0], [0]), (b"\x7f\x80\xff\x00", 1, [1, 2, 3, 0], [3, 0, 1, 2]), (b"\xc3\xa9a", 1, [2, 1, 0], [2, 1, 0]),
]


def brute(text: bytes, s: int) -> list[int]:
    return sorted(range(0, len(text), s), key=lambda p: text[p:])


def table(spark, texts):
    return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "key long, content binary")


def arrays(df) -> dict[int, list[int]]:
    out: dict[int, list[tuple[int, int]]] = {}
    for r in df.collect():
        out.setdefault(r["key"], []).append((r["rank"], r["pos"]))
    assert all(sorted(k for k, _ in v) == list(range(len(v))) for v in out.values())
    return {k: [p for _, p in sorted(v)] for k, v in out.items()}


def random_texts(n=30):
    r = random.Random(3)
    texts = [bytes(r.choices(range(97, 97 + r.randint(1, 6)), k=r.randint(0, 60))) for _ in range(n)]
    return [*texts, b"", b"x", b"ab" * 200, bytes(range(256)), bytes(range(255, -1, -1)) * 2]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.integers(1, 7))
def test_kernel_on_any_bytes(text, s):
    assert suffix_order(np.frombuffer(text, np.uint8), s).tolist() == brute(text, s)


@pytest.mark.parametrize("s", [1, 2, 3])
def test_plans_agree(spark, s):
    texts = random_texts()
    df = table(spark, texts)
    want = {i: brute(t, s) for i, t in enumerate(texts) if t}
    for plan in ("sort", "kernel", "auto"):
        assert arrays(sparse_suffix_array(df, s, plan)) == want
    assert arrays(full_then_sample(df, s)) == want


@pytest.mark.parametrize("s", [1, 3, 13])
def test_doubling(spark, s):
    texts = [b"banana", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", b"mississippi" * 9, b"", bytes(range(256))]
    assert arrays(sparse_suffix_array(table(spark, texts), s, "doubling")) == {i: brute(t, s) for i, t in enumerate(texts) if t}


def test_long_texts_go_to_doubling(spark):
    texts = [b"abcab" * 4, b"ab"]
    assert arrays(sparse_suffix_array(table(spark, texts), 2, kernel_bytes=8)) == {i: brute(t, 2) for i, t in enumerate(texts)}


def test_small_vectors(spark):
    for text, s, codes, sa in SMALL:
        df = table(spark, [text])
        assert [r["code"] for r in packing.bitpack(df, s).orderBy("cell").collect()] == codes
        assert arrays(sparse_suffix_array(df, s)) == {0: sa}


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        sparse_suffix_array(table(spark, [b"a"]), 0)
    with pytest.raises(ValueError):
        sparse_suffix_array(table(spark, [b"a"]), 1, "none")
    with pytest.raises(SystemExit):
        main(["in", "out"])


def test_null_and_empty_texts_give_no_rows(spark):
    df = as_bytes(spark.createDataFrame([(1, None), (2, "")], "key long, text string"), ["key"], "text")
    assert sparse_suffix_array(df, 1).count() == 0
    assert [r["cells"] for r in sized(df, 3).collect()] == [0]
    assert alphabet.symbol_frequency(df).count() == 0


def test_alphabet(spark):
    df = table(spark, [b"$ACCA", b"zzz"])
    assert {(r["key"], r["byte"], r["rank"]) for r in alphabet.alphabet_rank(df).collect()} == {(0, 36, 0), (0, 65, 1), (0, 67, 2), (1, 122, 0)}
    bits = {r["key"]: (r["alphabet_size"], r["bits_per_char"], r["required_bits"], r["kernel"]) for r in alphabet.alphabet_bits(df, 5).collect()}
    assert bits == {0: (3, 2, 10, "packed16"), 1: (1, 0, 0, "packed8")}
    assert [r["rank_dna"] for r in alphabet.fixed_ranks(symbols(table(spark, [b"$ACGT"]))).orderBy("pos").collect()] == [0, 0, 1, 2, 3]


def test_compression_is_undone(spark):
    texts = [t for t in random_texts() if t]
    df = table(spark, texts)
    for s in (1, 2, 5):
        headers = compress.header(sized(df, s), s)
        words = compress.compress(sparse_suffix_array(df, s), headers, ["key"])
        assert {r["key"]: r["n"] for r in words.groupBy("key").agg(F.count("*").alias("n")).collect()} == {r["key"]: r["n_words"] for r in headers.collect()}
        assert arrays(compress.decompress(words, headers, ["key"])) == {i: brute(t, s) for i, t in enumerate(texts)}


@pytest.mark.parametrize("scattered", [False, True])
def test_blocks_of_long_texts(spark, scattered):
    """Texts of several blocks, whose last elements end in the next one, with a null and a second key, headers without rows, and rows in any order."""
    r = np.random.default_rng(1)
    want = {(k, name): (r.permutation(n) * 3).tolist() for k, name, n in [(1, "a", 1), (None, "b", 64), (3, "c", 4096), (4, None, 4097), (5, "e", 30_000)]}
    rows = [(*key, rank, pos) for key, found in want.items() for rank, pos in enumerate(found)]
    sizes = [(*key, len(found)) for key, found in want.items()]
    headers = compress.header(spark.createDataFrame([*sizes, (98, "none", 0), (99, "no rows", 5)], "k long, name string, cells long"), 3)
    mixed = lambda df: df.orderBy(F.xxhash64(df.columns[-1])) if scattered else df
    words = compress.compress(mixed(spark.createDataFrame(rows, "k long, name string, rank long, pos long")), headers, ["k", "name"])
    packed, back = {}, {}
    for row in words.collect():
        packed.setdefault((row.k, row.name), {})[row.word_idx] = row.word
    bits = {(h.k, h.name): h.bits_per_element for h in headers.collect()}
    assert {key: [w[i] for i in range(len(w))] for key, w in packed.items()} == {key: compress.pack_bits(np.array(found), bits[key]).tolist() for key, found in want.items()}
    for row in compress.decompress(mixed(words), headers, ["k", "name"]).collect():
        back.setdefault((row.k, row.name), []).append((row.rank, row.pos))
    assert {key: sorted(found) for key, found in back.items()} == {key: list(enumerate(found)) for key, found in want.items()}


def test_compression_shuffles_no_row_for_an_element(spark):
    """200,000 elements of 12 bits: their positions and their words, and little more, are written by shuffles."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    df = table(spark, [random.Random(i).randbytes(4000) for i in range(50)])
    headers, before = compress.header(sized(df, 1), 1), written()
    assert compress.decompress(compress.compress(sparse_suffix_array(df, 1), headers, ["key"]), headers, ["key"]).filter("pos >= 0").count() == 200_000
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert 0 < written() - before < 200_000 * 5


def test_joined_text(spark):
    df = spark.createDataFrame([(2, "cd"), (1, "ab"), (3, "")], "key long, text string")
    rows = joined_symbols(as_bytes(df, ["key"], "text"), "key", b"-", b"$").orderBy("pos").collect()
    assert bytes(r["byte"] for r in rows) == b"ab-cd-$" and [r["pos"] for r in rows] == list(range(7))


def file_bytes(text: bytes, s: int, compressed: bool) -> bytes:
    """The file of a text, from sorting all suffixes and writing out all bits."""
    positions = brute(text, s)
    width = (len(positions) * s).bit_length() if compressed else 64
    bits = "".join(f"{p:0{width}b}" for p in positions)
    bits += "0" * (-len(bits) % 64)
    words = [int(bits[i : i + 64], 2) for i in range(0, len(bits), 64)]
    return struct.pack(f"<BBQ{len(words)}Q", width, s, len(positions), *words)


@pytest.mark.parametrize("symbols_,s,optimized", [("ACGT", 1, True), ("ACGT", 3, False), ("ACDEFGHIKLMNPQRSTVWY-", 3, True), ("ACDEFGHIKLMNPQRSTVWY-", 7, True)])
def test_files(spark, tmp_path, symbols_, s, optimized):
    text = "".join(random.Random(s).choices(symbols_, k=1000)).encode() + b"$"
    (tmp_path / "text").write_bytes(text)
    for compressed in (False, True):
        out = str(tmp_path / f"{compressed}.ssa")
        build(spark, str(tmp_path / "text"), out, s, compressed, optimized)
        data = open(out, "rb").read()
        assert data == file_bytes(text, s, compressed)
        bits, sparseness, length = read_header(out)
        assert (sparseness, length) == (s, -(-1001 // s))
        assert [r["word"] for r in read_ssa(spark, out).orderBy("word_idx").collect()] == list(struct.unpack(f"<{(len(data) - 10) // 8}q", data[10:]))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["False.ssa", "True.ssa", "text"]


def test_one_file_at_a_time(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_bytes(b"banana")
    with pytest.raises(ValueError):
        build(spark, str(tmp_path), str(tmp_path / "out"), 2)


def test_wide_cells(spark):
    text = bytes(range(97, 123)) * 3 + b"xyz"
    rows = packing.bitpack_wide(table(spark, [text, b"", b"aa"]), 30).filter("key = 0").orderBy("cell", "piece").collect()
    want = []
    for cell in range(0, len(text), 30):
        for lo in range(0, 30, 12):  # 12 symbols of 5 bits
            own = text[cell + lo : min(cell + lo + 12, cell + 30)]
            if own:
                size = min(12, 30 - lo)
                want.append((cell // 30, lo // 12, sum((c - 97) << 5 * (size - 1 - i) for i, c in enumerate(own))))
    assert [(r["cell"], r["piece"], r["code"]) for r in rows] == want


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"banana")
    query = suffix_arrays(watch_folder(spark, str(tmp_path / "in")), ["path"], "content", 2, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert [r["pos"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("rank").collect()] == [0, 4, 2]


def test_queries_run(spark):
    from suffixspark.jobs.catalog import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES)
    for name in ("q01_text_length", "q09_ssa_compressed_words", "q12_ssa_single_text"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
