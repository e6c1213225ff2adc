import collections
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from suffixspark.llm import language, maxent, pieces, tokens
from suffixspark.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, row string, score string, word string"
EN = ["the house of the river is old", "and the people in the street were happy", "there was nothing that they could think about"]
FR = ["la maison de la rivière est vieille", "et les gens dans la rue étaient heureux", "il n'y avait rien à quoi penser"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "a", "b", "c") for i, t, g in rows], DOCS)


def labelled():
    r = random.Random(1)
    some = lambda pool: " ".join(w for s in r.choices(pool, k=4) for w in s.split())
    rows = [(i, some(EN), "en") for i in range(60)] + [(100 + i, some(FR), "fr") for i in range(40)]
    return [*rows, (200, None, "en"), (201, "", None), (202, "12 34 !!", "fr"), (203, "the house", None), (None, "la maison", "fr"), (0, rows[0][1], "en"), (204, "maison " * 20_000, "fr"), (205, "x" * 5000, "en")]


def test_language(spark):
    docs = table(spark, labelled())
    held = language.held_out(F.col("doc_id"), 5)
    out = language.predict(docs, language.learn(docs.filter(~held)))
    got = [(r["row"]["doc_id"], r["row"]["lang"], r["lang_pred"], r["score"]) for r in out.collect()]
    assert len(got) == len(labelled())
    by = {i: (p, s) for i, _, p, s in got}
    assert by[200] == by[201] == by[202] == ("und", 0.0)
    assert by[203][0] == "en" and by[None][0] == by[204][0] == "fr"
    assert all(p == g for i, g, p, _ in got if i is not None and i < 200) and all(0 <= s <= 1 for *_, s in got)


def test_numerals_are_no_letters(spark):
    docs = table(spark, labelled())
    rows = [(1, "½ ² Ⅷ ① 3", None), (2, "½ the house", None), (3, "riviere\u0300 de la maison", None)]
    out = {r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(table(spark, rows), language.learn(docs)).collect()}
    assert out[1] == ("und", 0.0) and out[2][0] == "en" and out[3][0] == "fr"
    assert language.parts("Riviere\u0300 x²y½") == ["▁riviere\u0300", "▁x", "▁y"]


def test_language_without_labels(spark):
    docs = table(spark, [(1, "some text", None)])
    assert [(r["lang_pred"], r["score"]) for r in language.predict(docs, language.learn(docs)).collect()] == [("und", 0.0)]
    assert language.predict(table(spark, []), language.learn(table(spark, labelled()))).count() == 0


def test_forward_sums_all_segmentations():
    vocabulary = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}
    prob = np.array([[0.3, 0.1], [0.2, 0.2], [0.1, 0.3], [0.1, 0.1], [0.2, 0.2], [0.1, 0.1]])

    def brute(w, m):
        return 1.0 if not w else sum(prob[vocabulary.get(w[:k], 5 if k == 1 else -1), m] * brute(w[k:], m) for k in range(1, min(3, len(w)) + 1) if w[:k] in vocabulary or k == 1)

    words = ["a", "ab", "abab", "abcab", "bbaaba", ""]
    alpha = pieces.forward(pieces.lattice(words, pieces.PieceTable(vocabulary)), prob)
    for i, w in enumerate(words):
        assert alpha[len(w), i] == pytest.approx([brute(w, 0), brute(w, 1)])


@pytest.mark.parametrize("word", ["a", "abab", "abcabaab", "bbaabaabc"])
def test_long_words_sum_all_segmentations(word):
    """Sums and expected counts against listing all segmentations, side by side and in logarithms."""
    vocabulary = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}
    prob = np.array([[0.3, 0.1], [0.2, 0.2], [0.1, 0.3], [0.1, 0.1], [0.2, 0.2], [0.1, 0.1]])
    table_ = pieces.PieceTable(vocabulary)

    def all_ways(w):
        if not w:
            return [[]]
        return [[vocabulary.get(w[:k], 5), *rest] for k in range(1, min(3, len(w)) + 1) if w[:k] in vocabulary or k == 1 for rest in all_ways(w[k:])]

    total, counts = np.zeros(2), np.zeros_like(prob)
    for way in all_ways(word):
        p = prob[way].prod(axis=0)
        total += p
        for i in way:
            counts[i] += p
    counts *= np.array([2.0, 5.0]) / total
    assert np.exp(pieces.log_forward(word, table_, np.log(prob))) == pytest.approx(total)
    assert pieces.long_word_counts(word, table_, np.array([2.0, 5.0]), prob) == pytest.approx(counts)
    assert pieces.expected_counts(pieces.lattice([word], table_), np.array([len(word)]), np.array([[2.0, 5.0]]), prob) == pytest.approx(counts)


def test_long_word_does_not_underflow():
    vocabulary = {"a": 0, "aa": 1}
    table_, prob = pieces.PieceTable(vocabulary), np.array([[0.01], [0.0001], [0.1]])
    got = pieces.log_forward("a" * 5000, table_, np.log(prob))[0]
    ways = [1, 1]  # each segmentation has probability 0.01 ** 5000
    for _ in range(4999):
        ways.append(ways[-1] + ways[-2])
    assert got == pytest.approx(math.log(ways[5000]) + 5000 * math.log(0.01))


def test_posterior_of_texts():
    """The posterior of a text against products over the sums of its words, with words beyond SIDE_BY_SIDE."""
    vocabulary = {"▁": 0, "a": 1, "b": 2, "ab": 3}
    prob = np.array([[0.4, 0.3], [0.2, 0.1], [0.1, 0.3], [0.2, 0.2], [0.1, 0.1]])
    scorer = language.Scorer(language.Languages(["x", "y"], prob, np.log([0.5, 0.5])), vocabulary)
    text = "ab " + "ab" * 30 + " c ab"

    def total(w, m):
        best = [1.0]
        for end in range(1, len(w) + 1):
            best.append(sum(best[s] * prob[vocabulary.get(w[s:end], 4), m] for s in range(max(0, end - 2), end) if w[s:end] in vocabulary or end - s == 1))
        return math.log(best[-1])

    want = [sum(total(w, m) for w in language.parts(text)) + math.log(0.5) for m in (0, 1)]
    assert scorer.score([text])[0] == pytest.approx(want)


def brute_tokens(word: bytes, vocabulary: dict[str, int]) -> tuple[int, float]:
    text, worst = tokens.MARK + word.decode("utf-8", "replace"), -math.log(len(vocabulary) + 1)
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        n = len(text[end - 1].encode())
        ways = [(best[end - 1][0] + n * worst, best[end - 1][1] - n)]
        ways += [(best[s][0] - math.log(vocabulary[text[s:end]] + 1), best[s][1] - 1) for s in range(max(0, end - pieces.MAX_PIECE), end) if text[s:end] in vocabulary]
        best.append(max(ways))
    return -best[-1][1], best[-1][0]


def test_token_counts(spark):
    rows = [(1, "the house of\tthe rivière\n日本語 😀", "x"), (2, None, "x"), (3, "", "x"), (4, " \n", "x"), (5, "a" * 3000, "x"), (6, "ab " * 5000, "x"), (1, "the house of\tthe rivière\n日本語 😀", "x")]
    vocabulary = pieces.vocabulary()
    out = tokens.count_tokens(table(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        found = [brute_tokens(w, vocabulary) for w in (r["row"]["text"] or "").encode().split()]
        assert (r["n_pretokens"], r["n_tokens"]) == (len(found), sum(n for n, _ in found))
        assert r["log_prob"] == pytest.approx(sum(s for _, s in found))
    assert tokens.count_tokens(table(spark, [])).count() == 0


def test_trie_is_begun_anew_without_effect():
    vocabulary = pieces.vocabulary()
    small, large = tokens.Trie(vocabulary, max_words=3), tokens.Trie(vocabulary)
    for words in ([b"one", b"two", b"three", b"four"], [b"one", b"onerous"], [b"three", b"two"]):
        a, b = small.look_up([words])[0], large.look_up([words])[0]
        assert small.tokens[a].tolist() == large.tokens[b].tolist() == [brute_tokens(w, vocabulary)[0] for w in words]


def test_trie_is_kept_over_batches():
    """A prefix is scored once, whichever batch brings it; words that leave the trie go on from its nodes."""
    vocabulary, trie = pieces.vocabulary(), tokens.Trie(pieces.vocabulary())
    batches = [[b"one", b"onerous"], [b"ones", b"onerous", b"oner"], [b"onerousness", b"two"], [b"house" * 150, b"house" * 150 + b"s", b"house" * 20], ["日本語".encode() * 300]]
    prefixes = set()
    for words in batches:
        at = trie.look_up([words])[0]
        assert trie.tokens[at].tolist() == [brute_tokens(w, vocabulary)[0] for w in words]
        assert trie.score[at].tolist() == pytest.approx([brute_tokens(w, vocabulary)[1] for w in words])
        for w in words:
            text = (tokens.MARK + w.decode())[: tokens.DEPTH]
            prefixes |= {text[:n] for n in range(1, len(text) + 1)}
        assert trie.nodes_scored == len(prefixes) == sum(len(level[0]) for level in trie.levels)


def test_terminal_counts(spark):
    out = {r["pretoken"]: (r["n"], r["n_tokens"]) for r in tokens.pretoken_counts(table(spark, [(1, "a b a", ""), (2, "a house", "")])).collect()}
    assert {k: n for k, (n, _) in out.items()} == {"a": 3, "b": 1, "house": 1}


def base_scores(rows):
    end = object()
    split = [(i, [*(t or "").encode().lower().split(), end]) for i, t, _ in rows]
    trained = [w for i, ws in split if i is not None and zlib.crc32(str(i).encode()) % 10 for w in ws]
    c = collections.Counter(trained)
    return [(i, len(ws), sum(c[w] > 0 for w in ws), len(trained), sum(math.log10((c[w] + 0.1) / (len(trained) + 0.1 * (len(c) + 1))) for w in ws)) for i, ws in split]


def test_language_model(spark):
    rows = labelled()
    docs = table(spark, rows)
    model, counts = maxent.train(docs.filter(~maxent.held_out(F.col("doc_id"))))
    got = sorted(([r[c] for c in ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")] for r in maxent.score(docs, model, counts).collect()), key=lambda r: (str(r[0]), r[1]))
    want = sorted(base_scores(rows), key=lambda r: (str(r[0]), r[1]))
    assert [r[:4] for r in got] == [list(r[:4]) for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want])
    assert all(r[5] <= 1e-6 for r in got) and sum(r[5] for r in got) > sum(r[4] for r in got)  # better than the base


def test_class_probabilities_sum_to_one(spark):
    docs = table(spark, labelled())
    model, _ = maxent.train(docs)
    _, _, buckets = maxent.Encoder(model).encode([b"the house of nobody".split(), []])
    assert np.exp(maxent.log_classes(model, buckets, model.weights)).sum(axis=1) == pytest.approx(1, abs=1e-5)
    for c in set(model.class_of[:-2].tolist()):
        assert (10 ** model.inside[:-2][model.class_of[:-2] == c]).sum() == pytest.approx(1)


def brute_log_token(model, before, word):
    """log10 P(word | three words before), walking from the model's arrays one token at a time; None is the end, rare words stop at their class."""
    ids = [model.end + 1 if w == "" else model.number.get(w, model.rare) for w in before]  # the last word first
    wide, mask = (1 << 64) - 1, (1 << 32) - 1
    features = [ids[0] * 0x9E3779B97F4A7C15, ((ids[0] * 1_000_003 + ids[1]) & wide) * 0xC2B2AE3D27D4EB4F, ids[1] * 0x165667B19E3779F9, ids[2] * 0x27D4EB2F165667C5]
    context = [(x & wide) >> 32 for x in features]
    logits = [model.bias[c] + sum(float(model.weights[x >> 18, c]) for x in context) for c in range(len(model.bias))]
    i = model.end if word is None else model.number.get(word, model.rare)
    out = logits[model.class_of[i]] - math.log(sum(map(math.exp, logits)))
    for at in range(model.trees.start[i], model.trees.start[i + 1]):
        node, side, odds = int(model.trees.node[at]), int(model.trees.side[at]), 0.0
        for x in context:
            x = ((x ^ (node * 0x9E3779B1 & mask)) * 0x85EBCA6B) & mask
            x = ((x ^ (x >> 15)) * 0xC2B2AE35) & mask
            odds += float(model.node_weights[x >> 12])
        odds += float(model.trees.bias[node])
        out -= math.log1p(math.exp(-odds if side else odds))
    return out / math.log(10)


def told_apart():
    """Words that only the context tells apart, and rare ones."""
    r = random.Random(5)
    pairs = {"left": "sock", "right": "shoe", "upper": "deck", "lower": "hull"}
    return [(i, " ".join(x for a in r.choices(list(pairs), k=12) for x in (a, pairs[a])) + f" only{i}", "") for i in range(400)]


def test_context_tells_words_of_a_class_apart(spark, monkeypatch):
    monkeypatch.setattr(maxent, "CLUSTERS", 1)  # all of them in one class
    docs = table(spark, told_apart())
    model, _ = maxent.train(docs)
    assert len(set(model.class_of[:-2].tolist())) == 1 and len(model.number) == 8
    for a, b in ((b"left", b"sock"), (b"right", b"shoe"), (b"upper", b"deck"), (b"lower", b"hull")):
        logs = {w: brute_log_token(model, [a, b"sock", b"left"], w) for w in model.number}
        inside = 10 ** logs[b] / sum(10**x for x in logs.values())
        assert inside > 2 * 10 ** model.inside[model.number[b]] and inside == max(10**x for x in logs.values()) / sum(10**x for x in logs.values())


def test_tokens_of_a_class_sum_to_one(spark):
    """With the learned weights, in any context; without weights, a word has its share of the counts."""
    model, _ = maxent.train(table(spark, labelled()))
    assert np.abs(model.node_weights).max() > 0.01
    n = len(model.count)
    for before in ([b"the", b"in", b"people"], [b"nobody", b"", b""]):
        ids = np.array([model.end + 1 if not w else model.number.get(w, model.rare) for w in before])
        every = np.stack([np.full(n, ids[2]), np.full(n, ids[1]), np.full(n, ids[0]), np.arange(n)], axis=1).reshape(-1)
        context = maxent.contexts(every, np.full(n, 4), model.end)[:, 3::4]
        logs = maxent.log_inside(model.trees, np.arange(n), context, model.node_weights)
        for c in set(model.class_of.tolist()):
            assert np.exp(logs[model.class_of == c]).sum() == pytest.approx(1, abs=1e-4)
        plain = maxent.log_inside(model.trees, np.arange(n), context, np.zeros_like(model.node_weights))
        assert plain / math.log(10) == pytest.approx(model.inside, abs=1e-5)


def test_scores_against_a_walk_over_the_model(spark):
    """score, of rows with null and repeated ids, unknown words and no words."""
    rows = [*labelled()[:60], *told_apart()[:40], (300, "never seen words", ""), (300, "never seen words", ""), (None, "the sock", ""), (301, None, "")]
    docs = table(spark, rows)
    model, counts = maxent.train(docs.filter("doc_id is not null and doc_id < 300"))
    c = {bytes(r["word"]): r["n"] for r in counts.collect()}
    want = []
    for i, t, _ in rows:
        ws, total = (t or "").lower().encode().split(), 0.0
        for k, w in enumerate([*ws, None]):
            total += brute_log_token(model, [ws[k - d] if k >= d else "" for d in (1, 2, 3)], w)
            if w is not None and w not in model.number:
                total += math.log10((c.get(w, 0) + 0.1) / model.rare_mass)
        want.append((str(i), len(ws) + 1, total))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in maxent.score(docs, model, counts).collect())
    want.sort()
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-4)


def test_train_and_score_is_train_then_score(spark):
    docs = table(spark, labelled()).coalesce(1)
    learn = ~maxent.held_out(F.col("doc_id"))
    model, counts = maxent.train(docs.filter(learn))
    both = [sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 2)) for r in out.collect()) for out in (maxent.train_and_score(docs, learn), maxent.score(docs, model, counts))]
    assert both[0] == both[1] and len(both[0]) == len(labelled())


def test_texts_are_numbered_once_for_training_and_scoring(spark):
    """What scores reads the coded table and the counts, no texts; tables of tasks travel in slices, without those of zeros."""
    files = QUERIES["op7_maxent_scores"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("documents.parquet" not in f for f in files)
    numbers = np.zeros(3 * maxent.SLICE + 5, np.float32)
    numbers[[1, -1]] = 2, 3
    batches = lambda: [*maxent._slices(numbers, 2), *maxent._slices(numbers, 0.5)]
    assert [b["place"].to_pylist() for b in batches()] == [[0, 3]] * 2
    rows = spark.createDataFrame([tuple(r.values()) for b in batches() for r in b.to_pylist()], maxent._SLICES)
    out = np.zeros(len(numbers))
    maxent._add_slices(rows, np.float32, out)
    assert out.tolist() == (numbers * 2.5).tolist()


def test_neighbours_are_counted_whole(spark):
    """Also of words that come after many others, and that no task sees often."""
    r = random.Random(3)
    junk = [(i, " ".join(f"j{i}x{k}" for k in range(1000)), "") for i in range(20)]
    rows = junk + [(100 + i, " ".join(r.choices(["red", "green", "blue", "white"], k=9)), "") for i in range(60)]
    want = collections.Counter()
    for _, t, _ in rows:
        ws = t.split()
        for a, b in [*zip(ws, ws[1:]), *zip(ws[1:], ws)]:
            want[a, xxhash.xxh32_intdigest(b) % maxent.NEIGHBOURS] += 1
    classes = []
    for n in (1, 8):
        docs = table(spark, rows).repartitionByRange(n, "doc_id") if n > 1 else table(spark, rows).coalesce(1).sortWithinPartitions("doc_id")
        counts = maxent.count_words(docs)
        model = maxent.vocabulary(docs, counts, docs.count())
        got = maxent.count_neighbours(docs, model.number)
        assert all(got[i, h] == want[w.decode(), h] for w, i in model.number.items() for h in range(maxent.NEIGHBOURS))
        classes.append({w: model.class_of[i] for w, i in model.number.items()})
    assert classes[0] == classes[1] and len(classes[0]) == 4 and all(c < maxent.CLUSTERS for c in classes[0].values())


def test_nothing_to_learn_from(spark):
    model, counts = maxent.train(table(spark, []))
    out = maxent.score(table(spark, [(1, None, "x"), (2, "word", "x")]), model, counts).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out] == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
    assert maxent.score(table(spark, []), model, counts).count() == 0
