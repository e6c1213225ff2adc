import random

import corpus_pipeline
from suffixspark.llm.queries import ORACLES, QUERIES


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = docs.selectExpr("cast(null as long) doc_id", "cast(null as string) text", "lang", "source", "n_chars").limit(1).union(docs.limit(1)).union(docs.limit(1))
    docs = docs.union(odd).selectExpr("*", "1 as size", "'x' as row", "'y' as mix_size")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        if name != "source_mix":
            assert docs.columns == columns
        docs = docs.checkpoint()
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.count() == docs.select("doc_id").distinct().count()


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.filter("mix_times < 1 or mix_times > 2").count() == 0 and out.count() > 100


def test_queries_are_registered():
    import __spark_entry__

    assert [int(q[2:].split("_")[0]) for q in QUERIES] == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sets_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    k = min(5, len(low))
    return frozenset(tuple(low[i : i + k]) for i in range(len(low) - k + 1)) if low else frozenset()


def one_of_each_group(rows):
    """The rows that stay: of rows that are connected by links, the one with the smallest id, nulls last, and of several with that id any one."""
    sets, label = [sets_of(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(label[i], []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def near_copies():
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(14):
        base = [r.choice(words) for _ in range(60)]
        texts += [" ".join(base), " ".join([*base, "more"]), " ".join(["Other", *base])]
    return texts


def test_near_duplicates_of_null_and_repeated_ids(spark):
    texts = near_copies()
    ids = [None, None, None, 7, 8, 1, 2, 2, 9, 3, 3, 3] + [i // 2 if i % 5 else None for i in range(30)]
    rows = [(i, t, "en", f"s{k % 3}", k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows += [(2, "another text of its own with some words", "en", "s", 900), (None, None, "en", "s", 901), (None, "", "en", "s", 902), (5, "   ", "en", "s", 903), (None, texts[0], "en", "s", 904), (7, texts[0], "en", "s", 905)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as copy", "3 as at").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, None)
    assert out.columns == docs.columns
    found, want = sorted((r[0] is None, r[0] or 0) for r in out.collect()), sorted((r[0] is None, r[0] or 0) for r in one_of_each_group(rows))
    assert found == want
    left = [sets_of(r["text"]) for r in out.collect()]
    assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(left) for b in left[:i])


def test_near_duplicates_of_many_null_ids(spark):
    """All rows without an id, of many texts: one pass over them, not one for each text."""
    rows = [(None, t, "en", "s", 0) for t in near_copies()] * 30
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), None).count() == len(one_of_each_group(rows[:42]))


def test_stages_of_an_empty_table_and_of_long_texts(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        assert docs.count() == 0
    long = " ".join(f"word{i * i % 9973} the of and" for i in range(60_000))
    docs = spark.createDataFrame([(1, long, "en", "a", 0), (2, long + " end", "en", "b", 0), (3, "Der kleine Hund lief schnell nach Hause, und alle Kinder freuten sich sehr.", "de", "b", 0), (4, None, "en", None, 0), (4, "12 34", "en", None, 0)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, d)
    assert sorted((r["doc_id"], r["text"] == long) for r in docs.collect()) == [(1, True), (3, False)]
