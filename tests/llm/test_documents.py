import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from suffixspark.llm import decontaminate, jaccard, mixing, topk
from suffixspark.llm.components import components

DOCS = "doc_id long, text string, source string, size int, row string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "b", "c") for i, t, s in rows], DOCS)


def sentence(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# op10


def vectors():
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=9)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(8)]  # ties
    return [*rows, (400, None), (410, [1.0, None]), (420, [float("nan")] * 9), (430, []), (440, [1.0, 2.0]), (450, [3.0, 1.0]), (None, rows[3][1]), (7, rows[7][1])]


@pytest.mark.parametrize("passes", [12, 16_384])
def test_top_k(spark, monkeypatch, passes):
    monkeypatch.setattr(topk, "PASS_QUERIES", passes)
    monkeypatch.setattr(topk, "BLOCK", 64)
    rows = vectors()
    df = spark.createDataFrame([(*x, 3) for x in rows], "vec_id long, embedding array<double>, id int")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 10 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    fit = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for i, q in fit:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in fit if j != i and len(c) == len(q))[:5]
            if best:
                want[i] = [(j, -s) for s, j in best]
    assert got == want


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 10 == 0, 5).count() == 0


def test_huge_components_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, -1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.top_k(df, F.col("vec_id") % 10 == 0, 5).collect()
    large = spark.createDataFrame([(0, [1e6, -1e6]), (1, [1e6, 1e6]), (2, [-1e6, 1e6])], "vec_id long, embedding array<double>")
    got = topk.top_k(large, F.col("vec_id") == 0, 5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 0), (2, -2 * 256_000_000**2)]


# op9


def brute_components(rows):
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def of(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[of(i)] = of(j)
    first = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            first[of(i)] = min(first.get(of(i), d), d)
    return sorted(((d, len(sets[i]), first.get(of(i)) if sets[i] else d) for i, (d, _, _) in enumerate(rows)), key=str)


def near_copies(n, seed=4):
    """Chains and stars of edits around the threshold, short texts, a common passage, and odd rows."""
    r = random.Random(seed)
    rows, base, common = [], sentence(r, 120), sentence(r, 60)
    for i in range(n):
        w = base.split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w), "a"))
    for i in range(n):
        rows.append((5000 + i, common + " " + sentence(r, r.choice([5, 10, 40])), "a"))
    chain = sentence(r, 150).split()
    for i in range(12):
        rows.append((8000 - i, " ".join(chain), "a"))
        for _ in range(2):
            chain[r.randrange(len(chain))] = f"c{r.randrange(10**6)}"
    rows += [(i, " ".join(r.choices("abc", k=r.randint(1, 9))), "a") for i in range(60)]
    return [*rows, (9000, None, "a"), (9001, "", "a"), (9002, " \n ", "a"), (None, base, "a"), (9003, base.upper(), "a"), (9004, base, "a"), (9004, base, "a"), (None, "only here with no other", "a"), (9005, "z " * 20_000, "a")]


@pytest.mark.parametrize("leaf,sent", [(256, 1_000_000), (10, 0)])
def test_groups(spark, monkeypatch, leaf, sent):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "SENT_ROWS", sent)
    monkeypatch.setattr(jaccard, "SENT_SHINGLES", sent)
    monkeypatch.setattr(jaccard, "HOT", 20)
    monkeypatch.setattr(jaccard, "SAMPLED", 2)
    rows = near_copies(14)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.groups(table(spark, rows)).collect()), key=str)
    assert got == brute_components(rows)


def mosaics(n, seed=7):
    """Texts of stock sentences in any order, hardly any of them linked, a chain, and a large group of near copies."""
    r = random.Random(seed)
    stock = [sentence(r, 9) for _ in range(60)]
    rows = [(i, " ".join(r.sample(stock, 6)), "a") for i in range(n)]
    chain = sentence(r, 150).split()
    for i in range(20):
        rows.append((2000 + i, " ".join(chain), "a"))
        for _ in range(2):
            chain[r.randrange(len(chain))] = f"c{r.randrange(10**6)}"
    base = " ".join(stock[:8]).split()
    for i in range(n // 2):
        w = list(base)
        w[r.randrange(len(w))] = f"m{i}"
        rows.append((3000 + i, " ".join(w), "a"))
    return rows


@pytest.mark.parametrize("leaf,weight", [(4096, 1 << 22), (40, 1 << 22), (1024, 3000)])
def test_groups_of_mosaics(spark, monkeypatch, leaf, weight):
    """Regions of many classes without links end in the time of their pairs, in one task and parted."""
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "LEAF_WEIGHT", weight)
    monkeypatch.setattr(jaccard, "PIVOTS", 8)
    monkeypatch.setattr(jaccard, "PIVOT_WEIGHT", 400)
    rows = mosaics(500 if leaf == 4096 else 150)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.groups(table(spark, rows)).collect()), key=str)
    assert got == brute_components(rows)


def test_groups_of_nothing(spark):
    assert jaccard.groups(table(spark, [])).count() == 0


@pytest.mark.parametrize("gather,dense", [(1 << 22, 1 << 22), (5, 150)])
def test_cells_join_as_all_pairs_do(monkeypatch, gather, dense):
    monkeypatch.setattr(jaccard, "GATHER", gather)
    monkeypatch.setattr(jaccard, "DENSE", dense)
    r = random.Random(9)
    for k in range(20):
        base = [np.unique(np.array(r.sample(range(3000), 60))) for _ in range(3)]
        sets = [np.unique(np.concatenate([b[: r.randint(48, 60)], np.array(r.sample(range(3000, 3300), r.randint(0, 12)), np.int64)])) for b in r.choices(base, k=60 + k)]
        region, m = jaccard.Region(sets), len(sets)
        common = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        assert (region.common(np.arange(m)) == common).all()
        region.join(np.arange(m))
        label = np.arange(m)
        for i, j in np.argwhere(jaccard.linked(common, region.sizes[:, None], region.sizes)):
            label[label == label[i]] = label[j]
        assert ((region.label[:, None] == region.label) == (label[:, None] == label)).all()


def test_a_region_of_pairs_far_from_each_other_ends():
    r = random.Random(3)
    sets = [np.unique(np.r_[0, [r.randrange(10**9) for _ in range(40)]]) for _ in range(1024)]
    region = jaccard.Region(sets)
    region.join(np.arange(1024))
    assert len(set(region.label.tolist())) == 1024


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (7, 7)]
    r = random.Random(1)
    r.shuffle(edges)
    labels = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert labels == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


# op6


def test_decontamination(spark):
    r = random.Random(3)
    words = lambda n, tag: " ".join(f"{tag}{r.randrange(5000)}" for _ in range(n))
    items = [(i, f"{words(20, 'q')}. {words(12, 'a')}.") for i in range(30)] + [(50, f"{words(150, 'q')}. {words(90, 'a')}."), (51, ""), (52, None), (53, "one")]
    by = dict(items)
    question = by[5].split(".")[0]
    rows = [
        (1, f"{words(200, 'x')} {by[3]} {words(300, 'x')}", "s"), (2, by[4].upper().replace(" ", "\n"), "s"), (3, words(500, "x"), "s"), (4, f"{words(50, 'x')} {question} {words(50, 'x')}", "s"),
        (5, f"{words(130, 'x')} {by[50]} {words(30, 'x')}", "s"), (6, None, "s"), (7, "", "s"), (8, f"{by[7]} {words(90, 'x')} {by[8]}", "s"), (8, f"{by[7]} {words(90, 'x')} {by[8]}", "s"), (None, by[9], "s"), (10, words(60_000, "x") + by[10], "s"),
    ]
    docs, bench = table(spark, rows), spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, n string")
    found = sorted(((x["doc_id"], x["item_id"]) for x in decontaminate.leaks(docs, bench).collect()), key=str)
    assert found == sorted([(1, 3), (2, 4), (5, 50), (8, 7), (8, 8), (8, 7), (8, 8), (None, 9), (10, 10)], key=str)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == [3, 4, 6, 7]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_several_indexes_and_passes(spark, monkeypatch):
    """Items in many indexes, sent in several passes, are found as they are by one."""
    r = random.Random(11)
    items = [(i, f"{sentence(r, r.choice([6, 30, 70]), 3000)}. {sentence(r, 8, 3000)}.") for i in range(40)]
    docs = table(spark, [(i, f"{sentence(r, 90)} {items[i][1]} {sentence(r, 40)}" if i < 40 else sentence(r, 300), "s") for i in range(60)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    assert {(x[0], x[1]) for x in want} >= {(i, i) for i in range(40)}
    monkeypatch.setattr(decontaminate, "ITEMS_PER_INDEX", 8)
    monkeypatch.setattr(decontaminate, "TOKENS_PER_PASS", 1024)
    assert len(list(decontaminate.passes(bench))) > 2
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect())) == [tuple(x) for x in want]
    assert sorted(x["doc_id"] for x in decontaminate.clean(docs, bench).collect()) == sorted(set(range(60)) - {x[0] for x in want})


def test_block_bounds_lose_nothing():
    """Against scoring every item for every passage."""
    r = random.Random(8)
    items = [(i, " ".join(f"w{r.randrange(60)}" for _ in range(r.randint(5, 30))) + ".") for i in range(40)]
    df = {}
    for _, t in items:
        for w in set(decontaminate.tokens(t)):
            df[w] = df.get(w, 0) + 1
    index = decontaminate.build(items, 64, df, len(items), 15.0)
    texts = [" ".join(f"w{r.randrange(60)}" for _ in range(r.randint(0, 300))) for _ in range(60)]
    for text, got in zip(texts, decontaminate.search(index, texts, 0.5, 0.0), strict=True):
        words, want = decontaminate.tokens(text), {}
        for lo in range(0, len(words), 64):
            passage = {index.number[w] for w in words[lo : lo + 128] if w in index.number}
            score = np.zeros(len(items))
            for t in passage:
                at = slice(index.start[t], index.start[t + 1])
                score[index.items[at]] += index.shares[at]
            for i in np.flatnonzero(score >= 0.5).tolist():
                want[i] = max(want.get(i, 0), score[i])
        assert {i: x[0] for i, x in got.items()} == pytest.approx(want)


# op3


def level(sizes, weights, budget, most):
    """Share the budget by weight; what is over a source's limit is shared again."""
    left, open_, target = budget, set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        full = {i for i in open_ if share[i] >= most * sizes[i]}
        if not full:
            for i in open_:
                target[i] = share[i]
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ -= full
    return target


def test_mix(spark):
    r = random.Random(6)
    rows = [(i, sentence(r, r.randint(0, 40)), r.choice(["b", "a", "é", "z", None])) for i in range(400)] + [(1000 + i, "same words here", "hot") for i in range(600)]
    rows += [(2000, None, "a"), (2001, "", None), (3, rows[3][1], rows[3][2]), (None, "no id", "a"), (2002, "x " * 300, "b"), (2003, "", "empty")]
    out = mixing.mix(table(spark, rows), ["doc_id", "source", "text"])
    got = out.collect()
    assert len(got) == len(rows) and all(x["size"] == len((x["row"]["text"] or "").split()) and x["taken"] == x["times"] * x["size"] and x["taken"] <= 2 * x["size"] for x in got)
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    want = level(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(sizes), 2.0)
    for n, size, target in zip(names, sizes, want, strict=True):
        own = [x for x in got if x["row"]["source"] == n]
        assert {x["source_size"] for x in own} == {size} and own[0]["target"] == pytest.approx(target)
        assert abs(sum(x["taken"] for x in own) - target) <= max(2, 0.001 * target)
    again = mixing.mix(table(spark, rows).repartition(7), ["doc_id", "source", "text"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(table(spark, []), ["doc_id"]).count() == 0


def test_counts_reach_the_best_sum():
    r = random.Random(2)
    for _ in range(200):
        length = np.array(sorted(r.sample(range(1, 30), r.randint(1, 6))))
        n = np.array([r.randint(0, 4) for _ in length])
        budget = r.randint(0, int((length * n).sum()) + 3)
        take = mixing.fit_counts(length, n, budget)
        assert (take >= 0).all() and (take <= n).all()
        share = np.array([c * budget // max(1, int((length * n).sum())) for c in n.tolist()])
        reach = {0}
        for size, count in zip(length.tolist(), (n - share).tolist(), strict=True):
            reach = {x + k * size for x in reach for k in range(count + 1)}
        left = budget - int((share * length).sum())
        if budget < int((length * n).sum()):
            assert int((take * length).sum()) == int((share * length).sum()) + max(x for x in reach if x <= left)
