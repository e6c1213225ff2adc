"""N-gram Jaccard join: documents whose shingle sets have a Jaccard similarity of 80 % or more, and the groups they form.

The join is exact up to collisions of 64-bit hashes (of 48 bits for two linked classes whose shingles no third one has). Documents with equal sets are one class, and only classes are compared.

1. Prefix filter, before any metric step: nearly all distances between texts are 1, so that everything is in the window of a sampled document. A set of n that links
   has need(n) shingles in common with its partner; so by any fixed order of the shingles both hold their first common ones among their first n - need(n) + 1, and w of
   them among w - 1 more. A class whose window has too few shingles that any other class has is done.
2. The classes that are left go through the same step again, in an order in which shingles that few of them have come first: frequent passages come last and hardly make anything a
   neighbour. A shingle makes a star of the classes that have it there; connected stars are the first regions. Linked classes share a region.
3. A region of up to LEAF classes and LEAF_WEIGHT shingles is joined in one task: pivot classes make Voronoi cells, a class is also put in each cell within the window
   d(x, p) <= d(x, nearest) + 2 * 0.2 (triangle inequality), and the cells are joined in turn as long as that leaves less than half of the pairs. What the windows don't
   part is compared by one product of the region's incidence table: time and memory are at most in proportion to the pairs of a bounded region.
4. Larger regions: up to PIVOTS classes of each are compared with all of it, over many tasks. A region whose other classes are all connected by that is done: a group
   of near copies is, since all within 0.2 of a pivot are linked through it. The others are parted by their next common shingle (the k-th, in windows that are wider
   by k - 1), those of equal members once; parts with all members connected are dropped, small ones go to step 3, large ones through step 4 again.

Texts: A-Z lower-cased, words are runs of bytes other than ASCII white space; sets are of distinct runs of 5 words, or the whole sequence if it is
shorter. A null text or one without words has the empty set, which is linked with nothing: its component is its own id. Repeated rows are copies. Null ids
are in the component of their set's smallest id, null if there is none. Long texts are read whole. Only the two columns named are read, so that
others may have any name; an empty table gives no rows."""

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suffixspark.llm.components import components
from suffixspark.llm.rows import sliced
from suffixspark.session import cut

SHINGLE, PERCENT = 5, 80
WIDER = 20  # windows are wider by a 20th of the set
#: Regions of up to LEAF classes and LEAF_WEIGHT shingles in all (8 bytes each) are joined in one task. PIVOTS: of a region in a round; CELLS: pivots within a task.
LEAF, LEAF_WEIGHT, PIVOTS, CELLS = 4096, 1 << 22, 256, 8
#: The pivots' shingles that are sent to the tasks at a time (8 bytes each), and those of one region, the first of its pivots excepted.
PIVOT_WEIGHT, REGION_WEIGHT = 1 << 22, 1 << 18
#: A row with a set counts as so many rows of numbers when tables are cut.
SET_ROWS = 8
#: Entries of lists and cells of a table that a product of incidence tables takes at a time.
GATHER, DENSE = 1 << 22, 1 << 22
#: Candidates of up to this many classes (24 bytes each) are sent to the tasks to pick their texts; more are joined.
SENT_ROWS = 1_000_000
#: The same for shingles that several classes have (16 bytes each).
SENT_SHINGLES = 4_000_000
#: Past these, keys with more rows than this (or than a SENT_SHINGLESth of all) are sent apart, the rest meet by a shuffle: no key fills a task.
HOT, SAMPLED = 1 << 16, 64
#: The bits of a shingle that step 1 leaves out, and those of a class by which it tells two apart.
LOW, TAG = np.int64(0xFFFF), (1 << 48) - 1
#: Texts are hashed in blocks of about so many bytes, cut at white space.
BLOCK = 1 << 16
WHITE = re.compile(rb"[ \t-\r]")
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
BASE = 0x2545F4914F6CDD1D
#: A random number for each byte, A-Z as a-z.
VALUE = np.array([xxhash.xxh3_64_intdigest(bytes([b]).lower()) for b in range(256)], np.uint64)
INSIDE = np.array([not WHITE.match(bytes([b])) for b in range(256)])


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= MIX[1]
    h ^= h >> np.uint64(29)
    return h


def word_hashes(text: bytes) -> np.ndarray:
    """The hash of each word in turn: a polynomial in BASE over its bytes' values, from differences of running sums. Takes some 40 bytes for each of a block, or of a longer word."""
    parts, at = [np.zeros(0, np.uint64)], 0
    while at < len(text):
        cut_at = WHITE.search(text, at + BLOCK)
        end = cut_at.start() if cut_at else len(text)
        raw = np.frombuffer(text, np.uint8, end - at, at)
        edges = np.flatnonzero(np.diff(INSIDE[raw], prepend=False, append=False))
        up, down = powers(max(2 * BLOCK, 1 << len(raw).bit_length()))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(VALUE[raw] * up[: len(raw)], out=sums[1:])
        parts.append(mixed((sums[edges[1::2]] - sums[edges[::2]]) * down[edges[::2]]))
        at = end
    return np.concatenate(parts)


def shingles(text: bytes) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h += words[i : i + n] * MIX[i]
    h = np.sort(mixed(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def class_of(sets: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(sets.tobytes()) - (1 << 63) if len(sets) else 0


def need(n):
    """The least number of common shingles that a set of n can link with."""
    return (PERCENT * n + 99) // 100


def wider(n):
    return (n + WIDER - 1) // WIDER


def _mapped(docs: DataFrame, make, schema: str) -> DataFrame:
    """make(list of (doc_id, sets)) -> arrays, over all rows of docs (doc_id, text in UTF-8, more...)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(t.as_py() or b"") for t in batch.column("text")]
            yield make(batch, sets)

    return docs.mapInArrow(rows, schema)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class, and t, a hash of the text that tells apart rows of one id (or without one)."""

    def make(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), batch.column("t")]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "class", "t"])

    return _mapped(docs.withColumn("t", F.xxhash64("text")), make, "doc_id long, n_shingles long, class long, t long")


def _flat(sets: list[np.ndarray], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all parts in turn, and the class of each one's set."""
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat.view(np.int64), np.repeat(np.array([class_of(s) for s in sets], np.int64), [len(p) for p in parts])


def windows(docs: DataFrame) -> DataFrame:
    """s, class: the shingles in whose wider window a class is, by the order of the hashes. Of a shingle's hash the first 48 bits: two that meet in these only make more candidates."""

    def make(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        flat, own = _flat(sets, [s[: len(s) - need(len(s)) + wider(len(s))] for s in sets])
        return pa.RecordBatch.from_arrays([pa.array(flat & ~LOW), pa.array(own)], ["s", "class"])

    return _mapped(docs, make, "s long, class long")


def candidates(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes that have enough window shingles in common with others (step 1)."""
    at = windows(docs)
    tag = F.col("class").bitwiseAND(TAG)  # 48 bits tell two classes apart here; what is shuffled is smaller by a fifth
    shared = cut(at.groupBy("s").agg(F.min(tag).alias("a"), F.max(tag).alias("b"), F.count("*").alias("rows")).filter("a <> b").select("s", "rows"))
    hits = meet(at, shared, "s").groupBy("class").agg(F.count("*").alias("hits"))
    least = wider_col(need_col(F.col("n")))
    return hits.join(classes, "class").filter(F.col("hits") >= least * F.col("copies")).select("class", "first", "t", "n")


def meet(rows: DataFrame, table: DataFrame, key: str, sent: int | None = None, how: str = "inner") -> DataFrame:
    """The join (inner or left) of rows with a table that has a key once, and in `rows` how many rows have it. A small table is sent to all tasks; of a larger one only the hot
    keys are, and there are at most as many as rows / HOT of them, or `sent`."""
    sent, size = SENT_SHINGLES if sent is None else sent, table.agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).first()
    if size["n"] <= sent:
        return rows.join(F.broadcast(table.drop("rows")), key, how)
    hot = F.col("rows") > max(HOT, size["rows"] // max(1, sent))
    most, rest = table.filter(hot).drop("rows"), table.filter(~hot).drop("rows")
    return rows.join(F.broadcast(most), key).unionByName(rows.join(F.broadcast(most.select(key)), key, "left_anti").join(rest, key, how))


def need_col(n: Column) -> Column:
    return F.floor((n * PERCENT + 99) / 100)


def wider_col(n: Column) -> Column:
    return F.floor((n + WIDER - 1) / WIDER)


def shingles_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, s: the shingles of the wanted classes, from the document with the smallest id; from each row, if that and its text are repeated."""
    few = wanted.count() <= SENT_ROWS
    pick = wanted.select(F.col("class").alias("want"), F.col("first"), F.col("t").alias("of"))
    rows = docs.withColumn("t", F.xxhash64("text")).join(F.broadcast(pick) if few else pick, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("t") == F.col("of")))

    def make(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        kept = [s for s, w in zip(sets, batch.column("want").to_pylist(), strict=True) if class_of(s) == w]  # an id may have several texts
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _flat(kept, kept)], ["s", "class"])

    return _mapped(rows.select("doc_id", "text", "want"), make, "s long, class long")


def common_shingles(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """class, n (shingles), of: those that other wanted classes have too, as (df, s) from the rarest on, where df is how many have s. Only of classes with as many as a link
    needs. All that two of them have in common is in both lists.

    One shuffle counts the classes of a shingle. Hot shingles, found in a sample of the classes, are counted before theirs; the sample decides only which way a shingle takes: its
    count is of all classes."""
    each = shingles_of(docs, wanted)
    each = each.distinct() if repeated else each
    rows = wanted.agg(F.sum("n")).first()[0] or 0
    least = max(HOT, rows // SENT_SHINGLES if SENT_SHINGLES else 0)
    sampled = shingles_of(docs, wanted.filter(F.pmod(F.xxhash64("class"), F.lit(SAMPLED)) == 0))
    hot = cut(sampled.groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") * SAMPLED > least).select("s"), rows // max(1, HOT))  # about as many at most
    met = each.join(F.broadcast(hot), "s", "left_anti").withColumn("df", F.count("*").over(Window.partitionBy("s")))
    if not hot.isEmpty():
        most = each.join(F.broadcast(hot), "s")
        counted = cut(most.groupBy("s").agg(F.count("*").alias("df")), rows // max(1, HOT))
        met = met.unionByName(most.join(F.broadcast(counted), "s"))
    lists = met.filter("df > 1").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("of"))
    return lists.join(wanted.select("class", "n"), "class").filter(room(1) > 0).select("class", "n", "of")


def room(k: int) -> Column:
    """How many of the shingles `of` are in a window that holds the first k common ones: shingles of the class's own come before them."""
    return (F.size("of") - need_col(F.col("n")) + k).cast("int")


def stars(common: DataFrame) -> DataFrame:
    """a, b: classes and the least class in the same window (step 2)."""
    near = common.select("class", F.explode(F.slice("of", F.lit(1), room(1))).alias("x")).select("class", F.col("x.s").alias("s"))
    near = cut(near)
    lead = cut(near.groupBy("s").agg(F.min("class").alias("lead"), F.count("*").alias("rows")))
    return meet(near, lead.filter("rows > 1"), "s").filter("class <> lead").select(F.col("class").alias("a"), F.col("lead").alias("b")).distinct()


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of a and b shingles, so many of them common, are linked."""
    return 100 * common >= PERCENT * (a + b - common)


class Region:
    """The shingle sets of a task's classes as an incidence table, and which classes are connected (label)."""

    def __init__(self, sets: list[np.ndarray], label: np.ndarray | None = None, sizes: np.ndarray | None = None):
        """sizes: of the whole sets, if some of their shingles, which no other has, are left out."""
        m = len(sets)
        held = np.array([len(s) for s in sets], np.int64)
        self.sizes = held if sizes is None else sizes
        self.label = np.arange(m) if label is None else np.unique(label, return_inverse=True)[1]
        _, token, df = np.unique(np.concatenate(sets) if m else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(m), held), df[token] > 1
        row, token = row[shared], np.cumsum(df > 1)[token[shared]] - 1
        self.rows = token, np.searchsorted(row, np.arange(m + 1))  # tokens of a row
        self.df = df[df > 1]
        order = np.argsort(token, kind="stable")
        self.posts, self.starts = row[order], np.r_[0, np.cumsum(self.df)]  # rows of a token
        self.heavy = self.df > max(8, m // 16)

    def common(self, rows: np.ndarray) -> np.ndarray:
        """(row, class): how many shingles they have in common. Tokens that many have are multiplied densely, the others by their lists."""
        m, (token, at) = len(self.sizes), self.rows
        out = np.zeros((len(rows), m))
        n = at[rows + 1] - at[rows]
        flat = token[np.repeat(at[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        of = np.repeat(np.arange(len(rows)), n)
        light = ~self.heavy[flat]
        flat, of = flat[light], of[light]
        weight = np.cumsum(self.df[flat])
        lo = 0
        while lo < len(flat):
            hi = max(lo + 1, int(np.searchsorted(weight, (weight[lo - 1] if lo else 0) + GATHER)))
            d = self.df[flat[lo:hi]]
            where = np.repeat(self.starts[flat[lo:hi]] - np.cumsum(d) + d, d) + np.arange(d.sum())
            first, last = int(of[lo]), int(of[hi - 1]) + 1
            out[first:last] += np.bincount((np.repeat(of[lo:hi], d) - first) * m + self.posts[where], minlength=(last - first) * m).reshape(-1, m)
            lo = hi
        heavy = np.flatnonzero(self.heavy)
        width = max(1, DENSE // max(1, m))
        for lo in range(0, len(heavy), width):
            some = heavy[lo : lo + width]
            table, d = np.zeros((m, len(some)), np.float32), self.df[some]
            where = np.repeat(self.starts[some] - np.cumsum(d) + d, d) + np.arange(d.sum())
            table[self.posts[where], np.repeat(np.arange(len(d)), d)] = 1
            out += table[rows] @ table.T
        out[np.arange(len(rows)), rows] = self.sizes[rows]
        return out.astype(np.int64)

    def connect(self, rows: np.ndarray, common: np.ndarray, members: np.ndarray) -> None:
        """Give all that is linked with a row the same label; common is (row, member)."""
        links = linked(common, self.sizes[rows][:, None], self.sizes[members])
        for i, row in zip(rows.tolist(), links, strict=True):
            met = np.unique(np.r_[self.label[i], self.label[members[row]]])
            if len(met) > 1:
                self.label[np.isin(self.label, met)] = met[0]

    def join(self, members: np.ndarray) -> None:
        """Connect the linked members (step 3)."""
        labels, n = np.unique(self.label[members], return_counts=True)
        if len(labels) == 1:
            return
        if len(members) > 2 * CELLS:
            pivots = members[:: -(-len(members) // CELLS)]
            common = self.common(pivots)[:, members]
            self.connect(pivots, common, members)
            far = 1 - common / (self.sizes[pivots][:, None] + self.sizes[members] - common)
            within = far <= far.min(axis=0) + 2 * (100 - PERCENT) / 100 + 1e-9
            if 2 * (within.sum(axis=1) ** 2).sum() < len(members) ** 2:
                for cell in within:
                    self.join(members[cell])
                return
        labels, n = np.unique(self.label[members], return_counts=True)
        rest = members[self.label[members] != labels[n.argmax()]]  # what the largest group has in itself is connected
        for lo in range(0, len(rest), 256):
            self.connect(rest[lo : lo + 256], self.common(rest[lo : lo + 256])[:, members], members)


def join_small(regions: DataFrame) -> DataFrame:
    """a, b: edges that connect what is linked in each region of (region, class, n, sets, comp), where those of one comp are connected already."""

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class")
        ids = pdf["class"].to_numpy()
        region = Region([np.asarray(s, np.int64) for s in pdf["sets"]], pdf["comp"].to_numpy(), pdf["n"].to_numpy())
        before = region.label.copy()
        region.join(np.arange(len(ids)))
        new = np.isin(region.label, region.label[region.label != before])  # groups that have grown
        _, first, own = np.unique(region.label, return_index=True, return_inverse=True)
        return pd.DataFrame({"a": ids[new], "b": ids[first[own]][new]})

    return regions.groupBy("region").applyInPandas(leaf, "a long, b long").filter("a <> b")


def _pivots(member: DataFrame, round_no: int) -> DataFrame:
    """region, class: up to PIVOTS classes of each region, those outside its largest group first, and no more shingles than REGION_WEIGHT after the first."""
    sizes = member.groupBy("region", "comp").agg(F.count("*").alias("size"))
    main = sizes.groupBy("region").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"))
    best = F.struct((F.col("comp") == F.col("main")).alias("late"), F.xxhash64(F.lit(round_no), "class", "region").alias("h"), "class", "n")
    # the least of PIVOTS slices of a region by hash, so that no region is gathered whole
    sliced = member.join(F.broadcast(main) if main.count() <= SENT_ROWS else main, "region").groupBy("region", F.pmod(F.xxhash64("class"), F.lit(PIVOTS)).alias("slice")).agg(F.min(best).alias("best"))
    w = Window.partitionBy("region").orderBy("best").rowsBetween(Window.unboundedPreceding, 0)  # PIVOTS rows
    picked = sliced.withColumn("sum", F.sum("best.n").over(w)).filter((F.col("sum") <= REGION_WEIGHT) | (F.col("sum") == F.col("best.n")))
    return picked.select("region", F.col("best.class").alias("class"), F.col("best.n").alias("n"))


def _compared(regions: DataFrame, pivots: DataFrame) -> DataFrame:
    """a, b: links between the classes of regions (region, class, n, sets) and pivots (region, class, sets, n), which go to the tasks in passes of about PIVOT_WEIGHT shingles."""
    passes = max(1, -(-(pivots.agg(F.sum("n")).first()[0] or 0) // PIVOT_WEIGHT))
    found = None
    for p in range(passes):
        part = F.pmod(F.xxhash64("region"), F.lit(passes)) == p
        table: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for batch in pivots.filter(part).select("region", "class", "n", "sets").toArrow().to_batches():
            for region, own, n, s in zip(*(batch.column(c).to_pylist() for c in ("region", "class", "n")), batch.column("sets"), strict=True):
                table.setdefault(region, []).append((own, n, s.values.to_numpy()))
        shared = regions.sparkSession.sparkContext.broadcast(table)

        def compare(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for region, own in pdf.groupby("region"):
                    ids, size, sets = zip(*shared.value[region], strict=True)
                    held, size, rows = [len(s) for s in sets], np.array(size), [np.asarray(s, np.int64) for s in own["sets"]]
                    token, at = np.unique(np.concatenate(sets), return_inverse=True)
                    has = np.zeros((len(token), len(ids)), np.uint8)
                    has[at, np.repeat(np.arange(len(ids)), held)] = 1
                    for name, n, s in zip(own["class"].to_numpy(), own["n"].to_numpy(), rows, strict=True):
                        place = np.minimum(np.searchsorted(token, s), len(token) - 1)
                        common = has[place[token[place] == s]].sum(axis=0, dtype=np.int64)
                        hits = np.array(ids)[linked(common, n, size)]
                        a.append(hits)
                        b.append(np.full(len(hits), name))
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

        links = regions.filter(part).select("region", "class", "n", "sets").mapInPandas(compare, "a long, b long").filter("a <> b")
        found = links if found is None else found.union(links)
    return found


def _sized(member: DataFrame) -> DataFrame:
    """The regions that aren't one group, and whether they are small: region, rows, small."""
    size = member.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows"), F.sum("n").alias("weight"))
    return size.filter("lo <> hi").select("region", "rows", ((F.col("rows") <= LEAF) & (F.col("weight") <= LEAF_WEIGHT)).alias("small"))


def _labelled(member: DataFrame, edges: DataFrame) -> DataFrame:
    labels = components(edges).select(F.col("node").alias("class"), "label")
    return member.join(labels, "class", "left").withColumn("comp", F.coalesce("label", "class")).drop("label")


def with_sets(member: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """The members, at most `rows`, with their sets. Few of them are sent, so that sets are shuffled once at most."""
    return sets.join(F.broadcast(member) if rows <= SENT_ROWS else member, "class")


def join_regions(label: DataFrame, common: DataFrame) -> DataFrame:
    """a, b: edges that connect what is linked in the regions of label (class, region), whatever their sizes (steps 3 and 4)."""
    edges = label.sparkSession.createDataFrame([], "a long, b long")
    sets = common.select("class", F.col("of.s").alias("sets"))
    member = cut(label.join(common.select("class", "n"), "class").select("region", "class", "n", F.lit(0).alias("from"), F.col("class").alias("comp")))
    k = 1
    while True:
        rows = member.count()
        sized = cut(_sized(member), rows)
        open_ = meet(member, sized, "region", SENT_ROWS)
        small = with_sets(open_.filter("small"), sets, rows).select("region", "class", "n", "sets", "comp")
        edges = cut(edges.union(join_small(small)))
        if not sized.filter("not small").limit(1).count():
            return edges
        large = cut(open_.filter("not small").drop("small"), rows)
        for round_no in range(2):
            pivots = cut(with_sets(_pivots(large, 2 * k + round_no), sets, rows), SET_ROWS * rows)
            edges = cut(edges.union(_compared(with_sets(large, sets, rows), pivots)).distinct())
            asked = pivots.select("region", "class", F.lit(True).alias("asked"))
            large = cut(_labelled(large.join(asked, ["region", "class"], "left_anti"), edges), rows)
            large = cut(meet(large, cut(_sized(large).drop("small"), rows), "region", SENT_ROWS), rows)
            if large.isEmpty():
                return edges
        # part what is left by the next common shingle
        of = large.join(common.select("class", "of"), "class").withColumn("i", F.explode(F.when(F.col("from") < room(k), F.sequence("from", room(k) - 1))))
        split = cut(of.select(F.xxhash64("region", F.get("of", "i").getField("s")).alias("part"), F.get("of", "i").alias("x"), "region", "class", "n", (F.col("i") + 1).alias("from"), "comp"))
        stars_ = split.groupBy("part").agg(F.min("region").alias("region"), F.min("x").alias("x"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("who"))
        once = cut(stars_.filter("lo <> hi").groupBy("region", "rows", "who").agg(F.min_by("part", "x").alias("part")).select("part", "rows"))
        member = cut(meet(split, once, "part", SENT_ROWS).select(F.col("part").alias("region"), "class", "n", "from", "comp"))
        k += 1


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8").alias("text"))
    each = cut(described(own))
    n = each.count()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("least")
    classes = each.filter("n_shingles > 0").groupBy("class").agg(least, F.max("n_shingles").alias("n"), F.count("*").alias("copies"))
    classes = cut(classes.select("class", F.col("least.doc_id").alias("first"), F.col("least.t").alias("t"), "n", "copies"), n)
    wanted = cut(candidates(own, classes), n)
    named = each.join(wanted.select("class", "first"), "class").filter(F.col("doc_id").eqNullSafe(F.col("first")))
    repeated = named.count() > wanted.count()  # rows that repeat an id and its text
    common = cut(common_shingles(own, wanted, repeated), n * SET_ROWS)
    edges = cut(stars(common))
    label = components(edges).select(F.col("node").alias("class"), F.col("label").alias("region"))
    member = components(join_regions(label, common)).select(F.col("node").alias("class"), "label")
    named = member.join(classes, "class").groupBy("label").agg(F.min("first").alias("component"))
    # most classes are one document with no link, whose component is its own id
    of_class = classes.join(member, "class", "left").join(named, "label", "left").filter("copies > 1 or component is not null")
    of_class = cut(of_class.select("class", F.coalesce("component", "first").alias("component"), F.col("copies").alias("rows")), n)
    met = meet(each.filter("n_shingles > 0"), of_class, "class", SENT_ROWS, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return met.union(each.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
