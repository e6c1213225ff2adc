"""Alignment against a plain version: whole texts encoded by both libraries, every pair of ranges compared."""

import hashlib
import os
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from suffixspark.llm import alignment
from suffixspark.llm.queries import op11_token_alignment

os.environ["TOKENIZERS_PARALLELISM"] = "false"
FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers(alignment.BYTE_BPE, alignment.PIECE_BPE)


def ranges(ids, of):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(of[i]), i))
        at += len(of[i])
    return out


def whole(both, text):
    """A and B ranges of a text, or none."""
    if not text:
        return [], []
    a = both.a.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    same = b"".join(both.bytes[0][i] for i in a) == b"".join(both.bytes[1][i] for i in b) == b" " + text.encode()
    return (ranges(a, both.bytes[0]), ranges(b, both.bytes[1])) if same else ([], [])


def brute(both, rows):
    found = [(k, *whole(both, t)) for k, t in rows]
    links = [[(x[2], y[2]) for x in a for y in b[bisect_left(b, x[0] - 64, key=lambda y: y[0]) : bisect_left(b, x[1], key=lambda y: y[0])] if x[0] < y[1]] for _, a, b in found]  # no token has 64 bytes
    count = Counter(p for own in links for p in own)
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = []
    for (k, a, b), own in zip(found, links, strict=True):
        cuts = sorted({x[1] for x in a} & {y[1] for y in b})
        sides = [defaultdict(list), defaultdict(list)]
        for side, own_ranges in zip(sides, (a, b), strict=True):
            for s, _, i in own_ranges:
                side[bisect_right(cuts, s)].append(str(i))
        groups = ["|".join(",".join(side[g]) for side in sides) for g in range(len(cuts))]
        text = ";".join(groups)
        out.append((k, len(a), len(b), len(cuts), len(own), sum(count[p] == highest[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("row.k", *FIELDS).collect()), key=str)


TEXTS = [
    None, "", " ", "  ", "a", "Hello world", " leading", "trailing ", "two  spaces", "a\n\n b \n c\td", "\n", "\n x", "x \n\n y", "<|endoftext|> <s> </s> <unk>", "naïve café Ünïcode ß", "日本語のテキスト、空白なし", "👩‍👩‍👧 emoji 𝔘",
    "▁ mark is a space for the pieces", "tab\tand\x0bmore\x0cand\r\nends", "don't we'll I'm they've", "x" * 3000, "a b " * 700 + "c", "ＦＵＬＬ width ½ ﬁ", "a b  c", "\x00 nul \x1c fs", "é combined", "1234567890 12,345.67",
]


@pytest.mark.parametrize("sent_rows", [alignment.SENT_ROWS, 40, 0])
def test_equals_brute_force(spark, both, sent_rows):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "Hello world"), (3, "repeated id"), (3, "repeated id")]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "k long, text string, n_a int, row string").repartition(3)
    assert got(alignment.align(df, sent_rows=sent_rows)) == sorted(brute(both, rows), key=str)


def test_documents(spark, both):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    expected = {r[0]: tuple(r) for r in brute(both, [tuple(r) for r in docs.collect()])}
    found = {r["doc_id"]: tuple(r[c] for c in ["doc_id", *FIELDS]) for r in op11_token_alignment(spark, d).collect()}
    assert found == expected


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs).count() == 0
    assert alignment.align(docs, sent_rows=0).columns == ["row", *FIELDS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Zé\n\t.,'s1 日▁ 　"), max_size=24), max_size=4))
def test_units_encode_as_the_whole_text_does(both, texts):
    known, numbers = alignment._numbered({}, texts, (alignment.BYTE_BPE, alignment.PIECE_BPE))
    for text, own in zip(texts, numbers, strict=True):
        a, b = whole(both, text)
        joined = ";".join(known.groups[u] for u in own)
        ids = [[int(i) for g in joined.split(";") for i in g.split("|")[side].split(",")] if joined else [] for side in (0, 1)]
        assert ids == [[x[2] for x in a], [y[2] for y in b]]


def test_least_sent(spark):
    counts = spark.createDataFrame([(0, i, n, True) for i, n in enumerate([1, 1, 1, 2, 3, 900, 1000])], "a int, b int, n long, best boolean")
    assert [alignment._least_sent(counts, k) for k in (0, 0, 2, 4, 6, 7, 9)] == [1 << 62, 1 << 62, 512, 2, 2, 1, 1]
    assert counts.filter(F.col("n") >= 2).count() == 4
