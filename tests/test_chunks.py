"""Texts in chunks: files by byte ranges, rows, many rows as one text; what is built from chunks equals what is built from whole texts."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from suffixspark.jobs.build_ssa import build
from suffixspark.jobs.catalog import QUERIES
from suffixspark.operators import codes, packing, transforms
from suffixspark.operators.compress import pack_bits, unpack_bits
from suffixspark.operators.suffix_sort import full_then_sample, ladder, sort_chunks, suffix_order
from suffixspark.sources.chunks import file_chunks, joined_chunks, regrouped, text_chunks
from tests.test_suffix_arrays import arrays, brute, file_bytes, table


def whole(rows, chunk, halo):
    """The text of chunks, whose offsets and halos are right."""
    rows = sorted(rows, key=lambda r: r["offset"])
    text = b"".join(r["content"] for r in rows)
    assert [r["offset"] for r in rows] == list(range(0, len(text), chunk))
    assert all(bytes(r["after"]) == text[r["offset"] + chunk : r["offset"] + chunk + halo] for r in rows)
    return text


@pytest.mark.parametrize("chunk,halo", [(7, 3), (64, 62), (4096, 62)])
def test_file_chunks(spark, tmp_path, chunk, halo):
    text = bytes(random.Random(1).choices(range(256), k=1000))
    (tmp_path / "text").write_bytes(text)
    (tmp_path / "none").write_bytes(b"")
    for path in (f"{tmp_path}/text", f"file://{tmp_path}/text", f"file:{tmp_path}/text"):
        assert whole(file_chunks(spark, path, chunk, halo).collect(), chunk, halo) == text
    assert file_chunks(spark, f"{tmp_path}/none").count() == 0
    assert {r["path"].rsplit("/", 1)[1] for r in file_chunks(spark, str(tmp_path)).collect()} == {"text"}
    with pytest.raises(Exception, match="absent"):
        file_chunks(spark, f"{tmp_path}/absent").count()


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    """3 GB, mostly a hole: no task holds more than a batch of chunks."""
    with open(tmp_path / "large", "wb") as f:
        f.truncate(3 << 30)
        for at in (0, 1 << 31, (3 << 30) - 5):
            f.seek(at)
            f.write(b"Mark!")
    chunks = file_chunks(spark, f"{tmp_path}/large", 8 << 20, 0)
    assert chunks.rdd.getNumPartitions() == 96
    found = chunks.select("offset", F.octet_length("content").alias("n"), F.locate("Mark!", F.col("content").cast("string")).alias("mark")).collect()
    assert sum(r["n"] for r in found) == 3 << 30
    assert sorted(r["offset"] + r["mark"] - 1 for r in found if r["mark"]) == [0, 1 << 31, (3 << 30) - 5]


def test_text_chunks_and_pieces(spark):
    texts = [b"", b"a", bytes(range(256)) * 3, b"abcdefg"]
    rows = text_chunks(table(spark, texts), 100, 62).collect()
    for i, t in enumerate(texts):
        assert whole([r for r in rows if r["key"] == i], 100, 62) == t
    text, r = bytes(random.Random(2).choices(range(256), k=3000)), random.Random(3)
    cuts = sorted({0, len(text), *r.sample(range(len(text)), 40)})
    pieces = spark.createDataFrame([(a, bytearray(text[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)], "start long, content binary")
    assert whole(regrouped(pieces, 128, 62).collect(), 128, 62) == text


def test_joined_chunks(spark):
    texts = ["ab", "", "cdefghijklmnop" * 20, "é"]
    df = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "key long, content binary")
    assert whole(joined_chunks(df, "key", b"-", b"$", 64, 62).collect(), 64, 62) == ("-".join(texts) + "$").encode()


@pytest.mark.parametrize("s", [1, 3, 13, 30, 70])
def test_sort_of_chunks(spark, s):
    r = random.Random(s)
    texts = [b"banana" * 20, b"a" * 150, bytes(r.choices(b"ACGT", k=700)), bytes(r.choices(range(256), k=300)) * 2, b"x"]
    df = table(spark, texts)
    want = {i: brute(t, s) for i, t in enumerate(texts)}
    assert arrays(sort_chunks(text_chunks(df, 100, max(62, s)), s)) == want
    if s == 13:
        assert arrays(full_then_sample(df, s, "kernel")) == arrays(full_then_sample(df, s, "auto", kernel_bytes=200)) == want


def test_cells_off_the_sample_have_no_row(spark):
    rows, plan = codes.cell_codes(text_chunks(table(spark, [bytes(range(200)) * 5]), 100, 62), 30)
    assert rows.count() == -(-1000 // 30) and plan.step == 1 and len(plan.columns) == 5


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(b"ab"), max_size=80), st.integers(1, 40))
def test_kernel_of_repeats_and_wide_cells(text, s):
    assert suffix_order(np.array(text, np.uint8), s).tolist() == brute(bytes(text), s)


def test_settled_suffixes_leave_the_rounds():
    text = np.frombuffer(bytes(random.Random(1).choices(b"ACGT", k=5000)) + b"ab" * 200, np.uint8)
    rounds = list(ladder(text, 1))
    assert [step for _, _, step in rounds] == [rounds[0][2] << i for i in range(len(rounds))]
    assert all(sorted(order) == list(range(len(text))) for order, _, _ in rounds)


@pytest.mark.parametrize("bits", [1, 2, 7, 31, 33, 63, 64])
def test_bits(bits):
    for n in (0, 1, 63, 64, 65, 200):
        values = np.array([random.Random(i).getrandbits(bits) for i in range(n)], np.uint64).view(np.int64)
        text = "".join(f"{int(v) & (1 << 64) - 1:0{bits}b}" for v in values)
        text += "0" * (-len(text) % 64)
        words = pack_bits(values, bits)
        assert [int(w) & (1 << 64) - 1 for w in words] == [int(text[i : i + 64], 2) for i in range(0, len(text), 64)]
        assert unpack_bits(words, bits, n).tolist() == values.tolist()


def test_packing_of_chunks(spark):
    text = bytes(random.Random(5).choices(b"ACGT$", k=1000))
    whole_ = {(r["cell"], r["piece"]): r["code"] for r in packing.bitpack_wide(table(spark, [text]), 30).collect()}
    assert {(r["cell"], r["piece"]): r["code"] for r in packing.bitpack_chunks(text_chunks(table(spark, [text]), 64, 30), 30).collect()} == whole_
    with pytest.raises(Exception, match="62 bits"):
        packing.bitpack(table(spark, [text]), 30).count()


@pytest.mark.parametrize("compressed,optimized", [(False, False), (True, True)])
def test_build_from_chunks(spark, tmp_path, compressed, optimized):
    text = bytes(random.Random(7).choices(b"ACGT", k=900)) * 2
    (tmp_path / "text").write_bytes(text)
    build(spark, f"{tmp_path}/text", f"{tmp_path}/out", 3, compressed, optimized, kernel_bytes=500)
    assert (tmp_path / "out").read_bytes() == file_bytes(text, 3, compressed)


def test_files_of_a_folder_as_one_text(spark, tmp_path):
    """Files shorter than a chunk or its halo, empty ones, and hidden ones, which are no part of it."""
    r = random.Random(8)
    parts = [bytes(r.choices(b"ACGT", k=n)) for n in (0, 1, 500, 3, 0, 64, 700)]
    (tmp_path / "table").mkdir()
    for i, part in enumerate(parts):
        (tmp_path / "table" / f"part-{i}").write_bytes(part)
    (tmp_path / "table" / "_SUCCESS").write_bytes(b"other")
    text = b"".join(parts)
    assert whole(file_chunks(spark, f"{tmp_path}/table", 100, 62, joined=True).collect(), 100, 62) == text
    for kernel_bytes in (1 << 20, 500):
        build(spark, f"{tmp_path}/table", f"{tmp_path}/out", 3, True, kernel_bytes=kernel_bytes, joined=True)
        assert (tmp_path / "out").read_bytes() == file_bytes(text, 3, True)


def test_build_query_of_a_table_of_several_files(spark, tmp_path):
    r = random.Random(9)
    parts = [bytes(r.choices(b"ACGT", k=300)) for _ in range(3)]
    (tmp_path / "conversations.parquet").mkdir()
    for i, part in enumerate(parts):
        (tmp_path / "conversations.parquet" / f"part-{i}.parquet").write_bytes(part)
    rows = QUERIES["q17_build_file"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [row["pos"] for row in rows] == brute(b"".join(parts), 5) and [row["rank"] for row in rows] == list(range(180))


def test_build_of_an_empty_file(spark, tmp_path):
    (tmp_path / "text").write_bytes(b"")
    build(spark, f"{tmp_path}/text", f"{tmp_path}/out", 3)
    assert (tmp_path / "out").read_bytes()[2:] == bytes(8)


TEXTS = [b"", b"a", b"banana", b"a" * 40, b"mississippi" * 6, bytes(range(256)) * 2, b"ab" * 100 + b"c"]


def brute_bwt(text):
    order = sorted(range(len(text) + 1), key=lambda p: text[p:]) if text else []
    return [text[p - 1] if p else None for p in order]


def transformed(df):
    out = {}
    for r in df.orderBy("key", "idx").collect():
        out.setdefault(r["key"], []).append(r["byte"])
    return out


def test_bwt_and_its_inverse(spark):
    df = table(spark, TEXTS)
    want = {i: brute_bwt(t) for i, t in enumerate(TEXTS) if t}
    assert transformed(transforms.bwt(df)) == transformed(transforms.bwt(df, kernel_bytes=20)) == want
    assert {r["key"]: r["primary_index"] for r in transforms.primary_index(transforms.bwt(df)).collect()} == {i: b.index(None) for i, b in want.items()}
    found = {}
    for r in transforms.inverse_bwt(transforms.bwt(df)).orderBy("key", "pos").collect():
        found.setdefault(r["key"], []).append(r["byte"])
    assert {i: bytes(b) for i, b in found.items()} == {i: t for i, t in enumerate(TEXTS) if t}


def test_bwt_of_one_text_in_chunks(spark):
    text = b"abracadabra" * 30
    chunks = text_chunks(table(spark, [text]).drop("key"))
    rows = transforms.bwt_chunks(chunks)
    assert [r["byte"] for r in rows.orderBy("idx").collect()] == brute_bwt(text)
    assert bytes(r["byte"] for r in transforms.inverse_bwt(rows).orderBy("pos").collect()) == text


def test_lcp(spark):
    df = table(spark, TEXTS)
    for i, text in enumerate(TEXTS):
        rows = transforms.lcp(df).filter(F.col("key") == i).orderBy("rank").collect() if i in (3, 5) else transforms.lcp(table(spark, [text])).orderBy("rank").collect()
        order = brute(text, 1)
        common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert [(r["pos"], r["lcp"]) for r in rows] == [(p, common(text[order[k - 1] :], text[p:]) if k else 0) for k, p in enumerate(order)]
    with pytest.raises(Exception, match="longer than 5 bytes"):
        transforms.lcp(df, kernel_bytes=5).count()
