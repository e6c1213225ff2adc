"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from suffixspark.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n int, phrase string"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", low)]


def brute(rows, min_count=10, first=2000, inside=50):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in words_of(text):
            total[lang] += len(piece)
            for k in (1, 2, 3):
                count.update((lang, *piece[i : i + k]) for i in range(len(piece) - k + 1))
    frequent = {p: a for p, a in count.items() if len(p) > 2 and a >= min_count}
    found = []
    for p, a in frequent.items():
        cuts = [(10**6 * a * a // (count[p[: k + 1]] * count[(p[0], *p[k + 1 :])]), k, count[p[: k + 1]], count[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
        score, _, left, right = min(cuts)
        if not any(q[0] == p[0] and len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q))) for q, b in frequent.items()):
            found.append((p[0], score, a, " ".join(p[1:]), left, right))
    out = []
    for lang in {f[0] for f in found}:
        best = sorted((f for f in found if f[0] == lang), key=lambda f: (-f[1], -f[2], f[3].encode()))[:first]
        out += [(lang, i + 1, p, a, left, right, total[lang], score) for i, (_, score, a, p, left, right) in enumerate(best)]
    return sorted(out)


def random_rows():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(25)] + ["Éa", "ß", "a|b", "\x00", "日本", "\x1c"]
    text = lambda: "".join(r.choice(vocabulary[: r.choice([3, 31])]) + r.choice([" ", "  ", "\t", ". ", "\n", ",", " ; ", " "]) for _ in range(r.randrange(0, 60)))
    rows = [(text(), r.choice(["en", "de", None, "und", "en"])) for _ in range(150)]
    rows += [("New York City new york city", "en")] * 20 + [("the very Hot phrase", "xx")] * 300 + [("the other", "xx")] * 40 + [(None, "en"), ("", "en"), (None, None), ("...", "de"), ("rare words only", "zz")]
    return rows + [("x " * 5000 + "y x y", "xx")]


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    return random_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(None if i % 7 == 0 else i // 2, t, lang, 1, "x") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("options", [{}, {"one_in": 1}, {"one_in": 10**9}, {"least_in_sample": 10**9}, {"sent_rows": 3, "first": 7}, {"min_count": 2, "inside": 90, "first": 50}])
def test_equals_brute_force(docs, rows, options):
    plain = {k: v for k, v in options.items() if k in ("min_count", "inside", "first")}
    assert got(phrases.collocations(docs, **options)) == brute(rows, **plain)


def test_sets_that_are_too_small_only_count_more(docs, rows, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BITS", 6)
    monkeypatch.setattr(phrases, "MOST_BITS", 7)
    assert got(phrases.collocations(docs)) == brute(rows)


def test_passes(spark, docs):
    """What a sample without any phrase leaves open takes a pass for each length; a sample that is the whole table, and proposes enough, leaves nothing open."""
    assert phrases.frequent_phrases(docs, one_in=10**9)[1] == 3
    assert phrases.frequent_phrases(docs, one_in=1)[1] == 1


def test_empty_table(spark):
    out = phrases.collocations(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_products_beyond_64_bits(spark):
    """a a 10^6 and l r are exact in 38 digits."""
    a, left, right = 9_876_543_210_987_65, 9_876_543_210_987_67, 9_876_543_210_987_99
    r = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(F.expr(phrases.EXACT).alias("score")).first()
    assert r.score == 10**6 * a * a // (left * right)


def test_three_numbers_of_any_size():
    r = np.random.default_rng(1)
    rows = r.integers(0, 1 << 22, (50, 3))[r.integers(0, 50, 900)]
    found, n = phrases._counted(list(rows.T), 1 << 22)
    assert Counter(map(tuple, rows.tolist())) == dict(zip(zip(*(x.tolist() for x in found), strict=True), n.tolist(), strict=True))
