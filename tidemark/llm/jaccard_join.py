"""N-gram Jaccard self-join by chosen paths.

Sets of word five-grams are embedded in minhash coordinates, so that two sets
agree in a coordinate with the probability of their similarity.  A run sends
each set down the path that its value in a chosen coordinate names; sets of one
class that are equal travel as one.  A bucket that is still large is split again
on further coordinates, which its own path chooses, so that runs and branches
fail apart; small ones are compared by brute force, and enough runs and children
are made that a pair at the threshold meets with the target recall, splits
included.
A large bucket that its next coordinate does not thin is a true group of near
copies and isn't split; its members are compared in pairs of blocks, so no task
holds more than two blocks.

Comparison takes two rounds.  First signatures decide which sets of a bucket
have a partner at all there; then only their texts are fetched and the
similarity is computed exactly.  A pair that meets in several buckets is counted
in the first of those that both share.  Tasks return a row per set, never pairs:
its number of links there, and the smallest set that it is connected to, from
which connected groups follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import RollingHash, as_text, kind_of, mixed, numbered, only_rows, release, salted_join, shuffle_width, stored

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.99999
COORDINATES = 64
BUCKET = 1_024
ROWS_PER_TASK, TEXTS_PER_TASK = 20_000, 2_500
#: Shingles of the sets that a task keeps to meet them again: 32 MB.
SHINGLES_HELD = 1 << 22
#: Children of a bucket at least; shape_for() takes more where the target asks for them.
CHILDREN, MOST_CHILDREN = 3, 8
MAX_DEPTH = 3
#: Keys with more rows than this are split over SALTS tasks where they are joined.
HOT, SALTS = 1_024, 64
#: A coordinate that leaves more than this share of a bucket together has found near copies.
CLUSTERED = 0.7
#: Of the coordinates; a pair at the threshold falls below with probability 1e-7.
AGREE = 0.5
_HASH = RollingHash(101)
_STEPS = np.random.default_rng(103).integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURNS = np.random.default_rng(107).integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` lower-cased words.

    A text of fewer words is one shingle of all it has; one without is empty."""
    if not text:
        return np.empty(0, np.uint64)
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACES[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    word = mixed(_HASH.ranges(_HASH.prefix(data), start, end))
    width = min(words, len(word))
    total = np.zeros(len(word) - width + 1, np.uint64)
    for i in range(width):
        total += word[i : i + len(total)] * _STEPS[i]
    return np.unique(mixed(total))


def signature(s: np.ndarray) -> np.ndarray:
    """The minimum of each coordinate's hash, as 32 bits."""
    out = np.empty(COORDINATES, np.uint64)
    for at in range(0, COORDINATES, 16):
        out[at : at + 16] = (s[None, :] * _TURNS[at : at + 16, None]).min(axis=1)
    return (mixed(out) >> np.uint64(32)).astype(np.uint32)


def runs_for(recall: float, similarity: float) -> int:
    return max(1, ceil(log(1 - recall) / log(1 - similarity)))


def shape_for(recall: float, similarity: float) -> tuple[int, int]:
    """(runs, children) with which a pair at the threshold meets, though all its buckets are split MAX_DEPTH times."""

    def lost(runs: int, children: int) -> float:
        apart = 0.0
        for _ in range(MAX_DEPTH):
            apart = (1 - similarity * (1 - apart)) ** children
        return (1 - similarity * (1 - apart)) ** runs

    runs = runs_for(recall, similarity)
    while lost(runs, MOST_CHILDREN) > 1 - recall:
        runs += 1
    children = next(c for c in range(CHILDREN, MOST_CHILDREN + 1) if lost(runs, c) <= 1 - recall)
    if runs + MAX_DEPTH * children > COORDINATES:
        raise ValueError(f"{runs} runs and {children} children need more than {COORDINATES} coordinates")
    return runs, children


def path(parent: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The child bucket that a value in a coordinate leads to."""
    turn = (coordinate.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(mixed(parent ^ turn) + value.astype(np.uint64)).astype(np.int64)


def chosen(parent: np.ndarray, depth: int, runs: int, children: int) -> np.ndarray:
    """Rows of ``children`` coordinates, drawn by each bucket from those of its depth: none that its path has used."""
    width = (COORDINATES - runs) // MAX_DEPTH
    turns = mixed(np.arange(1, width + 1, dtype=np.uint64))
    order = np.argsort(mixed(parent[:, None] ^ turns), axis=1, kind="stable")
    return runs + depth * width + order[:, :children]


def _sketches(docs: DataFrame, words: int, runs: int) -> DataFrame:
    """Per row of (row, i, t): its id as text, the size and hash sums of its set, signature and root buckets."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, i, value in zip(batch["row"], batch["i"], batch["t"]):
                s = shingles(value if isinstance(value, str) else None, words)
                if not len(s):
                    rows.append((row, i, 0, 0, 0, None, None))
                    continue
                sig = signature(s)
                roots = path(np.arange(runs, dtype=np.uint64), np.zeros(runs), sig[:runs])
                one, two = s.sum(dtype=np.uint64), mixed(s ^ np.uint64(0xABCDEF12345)).sum(dtype=np.uint64)
                rows.append((row, i, len(s), one.astype(np.int64), two.astype(np.int64), sig.tobytes(), roots))
            yield pd.DataFrame(rows, columns=["row", "i", "n", "h1", "h2", "sig", "roots"])

    return docs.select("row", as_text("i").alias("i"), "t").mapInPandas(sketch, "row long, i string, n long, h1 long, h2 long, sig binary, roots array<long>")


def _counted(rows: DataFrame) -> DataFrame:
    """Rows (cls, bucket, ...) of buckets with at least two members, with their number m."""
    many = rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    return salted_join(rows, many, ["bucket"], ["cls"], HOT, SALTS)


def _with_signatures(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes.select("cls", "sig"), "cls").select("cls", "bucket", "m", "sig")


def _is_tight(large: DataFrame, classes: DataFrame, depth: int, runs: int, children: int) -> DataFrame:
    """``large`` with a mark on buckets that one of their coordinates leaves together: groups of near copies."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                sig = np.frombuffer(b"".join(batch["sig"]), np.uint32).reshape(len(batch), -1)
                c = chosen(batch["bucket"].to_numpy().astype(np.uint64), depth, runs, children)[:, 0]
                yield batch[["bucket", "m"]].assign(value=sig[np.arange(len(sig)), c].astype(np.int64))

    counts = _with_signatures(large, classes).mapInPandas(probe, "bucket long, m long, value long").groupBy("bucket", "m", "value").agg(F.count("*").alias("n"))
    tight = counts.groupBy("bucket").agg(F.max(F.col("n") > F.col("m") * CLUSTERED).alias("tight"))
    return salted_join(large, tight, ["bucket"], ["cls"], HOT, SALTS).select("cls", "bucket", "m", "tight")


def _leaves(classes: DataFrame, bucket: int, runs: int, children: int) -> DataFrame:
    """(cls, bucket, m): where brute force compares.

    A large bucket is split on chosen coordinates, unless the first of them shows
    that it holds near copies: those would stay together in every child."""
    level = stored(_counted(classes.select("cls", F.explode("roots").alias("bucket"))))
    columns = ["cls", "bucket", "m"]
    out, large = level.where(F.col("m") <= bucket).select(*columns), level.where(F.col("m") > bucket).select(*columns)
    for depth in range(MAX_DEPTH):
        if not large.head(1):
            return out
        marked = stored(_is_tight(large, classes, depth, runs, children))

        def split(batches: Iterator[pd.DataFrame], depth: int = depth) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                sig = np.frombuffer(b"".join(batch["sig"]), np.uint32).reshape(len(batch), -1)
                parent = batch["bucket"].to_numpy().astype(np.uint64)
                for c in chosen(parent, depth, runs, children).T:
                    yield pd.DataFrame({"cls": batch["cls"], "bucket": path(parent, c, sig[np.arange(len(sig)), c])})

        out = out.unionByName(marked.where("tight").select(*columns))
        parts = _with_signatures(marked.where("not tight"), classes).mapInPandas(split, "cls long, bucket long")
        level = stored(_counted(parts))
        out, large = out.unionByName(level.where(F.col("m") <= bucket).select(*columns)), level.where(F.col("m") > bucket).select(*columns)
    return out.unionByName(large)


class _Group:
    """The members of one bucket, or of two blocks of one, as slices of a partition's arrays."""

    def __init__(self, rows: _Rows, first: int, end: int):
        self.rows, self.first, self.end = rows, first, end
        self.sig, self.n, self.block = rows.sig[first:end], rows.n[first:end], rows.block[first:end]

    def pairs(self, similarity: float) -> np.ndarray:
        """A matrix that marks the pairs a < b to be decided here."""
        m = len(self.n)
        out = np.zeros((m, m), bool)
        for a in range(0, m, 64):
            agree = (self.sig[a : a + 64, None, :] == self.sig[None, :, :]).sum(axis=2, dtype=np.int16) >= AGREE * self.sig.shape[1]
            one, other = self.n[a : a + 64, None], self.n[None, :]
            out[a : a + 64] = agree & (np.minimum(one, other) >= (similarity - 1e-9) * np.maximum(one, other))
        out &= np.tri(m, k=-1, dtype=bool).T
        if out.any():
            if self.block[0] != self.block[-1] or (self.block != self.block[0]).any():
                out &= self.block[:, None] != self.block[None, :]
            if out.any():
                self._drop_met_before(out)
        return out

    def _drop_met_before(self, out: np.ndarray) -> None:
        """Unmarks pairs that share a bucket with a smaller number; that bucket decides them."""
        bucket, lists = self.rows.bucket[self.first], self.rows.buckets[self.first : self.end]
        a, b = np.nonzero(out)
        if len(a) <= 4 * len(lists):
            before = [{x for x in some.tolist() if x < bucket} for some in lists]
            met = [not before[i].isdisjoint(before[j]) for i, j in zip(a.tolist(), b.tolist())]
            out[a[met], b[met]] = False
            return
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = np.concatenate(list(lists))
        owner, flat = owner[flat < bucket], flat[flat < bucket]
        names, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)
        column = np.full(len(names), -1)
        for at in range(0, len(shared), 2048):
            some = shared[at : at + 2048]
            column[:] = -1
            column[some] = np.arange(len(some))
            here = column[inverse]
            x = np.zeros((len(lists), len(some)), np.float32)
            x[owner[here >= 0], here[here >= 0]] = 1
            out &= ~((x @ x.T) > 0)

    def linked(self, similarity: float, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the pairs that are at least that similar, exactly."""
        pairs = self.pairs(similarity)
        a, b = np.nonzero(pairs)
        if not len(a):
            return a, b
        used = np.unique(np.concatenate([a, b]))
        sets = [np.empty(0, np.uint64)] * len(self.n)
        for i in used.tolist():
            sets[i] = self.rows.shingles(self.first + i, words)
        if len(a) <= 40 * len(sets):
            both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)])
        else:
            # in strips, so that no list of all pairs is made before the exact test
            both, n = self._common(sets), self.n
            for at in range(0, len(n), 64):
                strip, least = both[at : at + 64], (similarity - 1e-12) * (n[at : at + 64, None] + n[None, :] - both[at : at + 64])
                pairs[at : at + 64] &= strip >= least
            return np.nonzero(pairs)
        keep = both >= (similarity - 1e-12) * (self.n[a] + self.n[b] - both)
        return a[keep], b[keep]

    @staticmethod
    def _common(sets: list[np.ndarray]) -> np.ndarray:
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        names, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # what all have adds the same to each pair
        shared = np.flatnonzero((count > 1) & (count < len(sets)))
        out = np.full((len(sets), len(sets)), float((count == len(sets)).sum()), np.float32)
        place = np.full(len(names), -1)
        place[shared] = np.arange(len(shared))
        at = place[inverse]
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        for first in range(0, len(shared), 1024):
            lo, hi = np.searchsorted(at, [first, first + 1024])
            x = np.zeros((len(sets), min(1024, len(shared) - first)), np.float32)
            x[owner[lo:hi], at[lo:hi] - first] = 1
            out += x @ x.T
        return out


class _Rows:
    """A partition's rows, ordered so that each bucket (and pair of blocks) is one slice."""

    def __init__(self, batches: Iterator[pd.DataFrame]):
        got = [x for x in batches if len(x)]
        self.frame = frame = pd.concat(got, ignore_index=True) if got else pd.DataFrame()
        if not len(frame):
            self.slices = []
            return
        order = np.lexsort([frame[c].to_numpy() for c in ("cls", "high", "low", "bucket")])
        self.frame = frame = frame.iloc[order]
        self.cls, self.bucket, self.block = (frame[c].to_numpy() for c in ("cls", "bucket", "block"))
        self.n = frame["n"].to_numpy().astype(float)
        self.sig = np.frombuffer(b"".join(frame["sig"]), np.uint32).reshape(len(frame), -1)
        self.buckets = frame["buckets"].to_numpy()
        self.texts = frame["t"].to_numpy() if "t" in frame else None
        low, high = frame["low"].to_numpy(), frame["high"].to_numpy()
        new = (self.bucket[1:] != self.bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(frame)]
        self.slices = list(zip(edges, edges[1:]))
        self._sets: dict[int, np.ndarray] = {}
        self._held = 0

    def shingles(self, i: int, words: int) -> np.ndarray:
        """A set met in several buckets of this partition is made once, as long as few are held."""
        key = int(self.cls[i])
        if key not in self._sets:
            if self._held > SHINGLES_HELD:
                self._sets.clear()
                self._held = 0
            self._sets[key] = shingles(self.texts[i], words)
            self._held += len(self._sets[key])
        return self._sets[key]

    def groups(self) -> Iterator[_Group]:
        return (_Group(self, a, b) for a, b in self.slices if b - a > 1)


def _roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position connected to each."""
    root = np.arange(m)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def connected(nodes_edges: DataFrame, rounds: int = 128, jumps: int = 64) -> DataFrame:
    """(node, root) for edges (a, b): the smallest node that each is connected to.

    A round hooks each node to its least smaller neighbour, flattens the trees by
    pointer jumping and leaves the edges between their roots.  A node that is
    least among its neighbours takes one in, or has a smaller one next round: two
    rounds at least halve the nodes, whatever the shape of the group.
    """
    edges = stored(nodes_edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    label = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    for _ in range(rounds):
        if not edges.head(1):
            return label
        spent = [edges, label]
        tree = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("first")).withColumn("up", F.col("first")))
        held = tree
        for _ in range(jumps):
            over = tree.select(F.col("node").alias("up"), F.col("up").alias("beyond"))
            after = stored(salted_join(tree, over, ["up"], ["node"], HOT, SALTS, "left").select("node", "first", F.coalesce("beyond", "up").alias("up"), F.col("beyond").isNotNull().alias("moved")))
            tree = after.drop("moved")
            release(held)
            held = after
            if not after.where("moved").head(1):
                break
        else:
            raise RuntimeError(f"trees still not flat after {jumps} jumps")
        to = tree.select(F.col("node").alias("root"), "up")
        label = stored(salted_join(label, to, ["root"], ["node"], HOT, SALTS, "left").select("node", F.coalesce("up", "root").alias("root")))
        # the edges that made the tree lie inside it
        rest = salted_join(edges, tree.withColumnRenamed("node", "a"), ["a"], ["b"], HOT, SALTS).where("b <> first").select(F.col("up").alias("x"), F.col("b").alias("root"))
        ends = salted_join(rest, to, ["root"], ["x"], HOT, SALTS, "left").select("x", F.coalesce("up", "root").alias("y")).where("x <> y")
        edges = stored(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        release(*spent, held)
    if edges.head(1):
        raise RuntimeError(f"groups still not connected after {rounds} rounds")
    return label


def jaccard_join(
    df: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    bucket: int = BUCKET,
    row: str | None = None,
) -> DataFrame:
    """``id_col``, ``row``, ``root``, ``class_id``, ``set_id``, ``n_links``, ``n_copies`` per row.

    ``row`` names a column of distinct longs (see ``common.numbered``); without
    one the rows are numbered here.  ``root`` numbers the group.  ``set_id``: smallest id among the rows with the same shingles, of which there
    are ``n_copies``.  ``n_links``: number of other such sets at least that
    similar.  ``class_id``: smallest id in the group that the links connect.
    Words are runs without ASCII white space, lower-cased; a text of fewer words
    than a shingle is one shingle.  A null text or one without words has no links
    and is a class of its own (its id; ``root`` is null).  Texts of any length are
    taken whole.  A null id is kept; its class is named by the other ids, or null.
    Repeated rows are copies; a pair exactly at the similarity is linked.  An
    empty table gives none.  Other columns are not read.
    """
    runs, children = shape_for(recall, similarity)
    docs = df.select(F.col(id_col).alias("i"), F.col(text).alias("t"), *([F.col(row).alias("row")] if row else []))
    docs = docs if row else numbered(docs, "row")
    sketched = _sketches(docs, words, runs)
    rows = stored(sketched.withColumn("i", F.col("i").cast(kind_of(df, id_col))))
    same = ["h1", "h2", "n"]
    # a class is named by its first row, whose text stands for all
    classes = stored(rows.where("n > 0").groupBy(*same).agg(
        F.first("sig").alias("sig"), F.first("roots").alias("roots"), F.min("i").alias("set_id"), F.min("row").alias("cls"), F.count("*").alias("n_copies")
    ))
    leaves = _leaves(classes, bucket, runs, children)
    homes = leaves.groupBy("cls").agg(F.sort_array(F.collect_set(F.struct("bucket", "m"))).alias("homes"))
    met = stored(homes.join(classes.select("cls", "n", "sig"), "cls").withColumn("buckets", F.col("homes.bucket")))
    blocks = F.ceil(F.col("h.m") / F.lit(bucket)).cast("int")
    placed = met.withColumn("h", F.explode("homes")).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # a block meets itself and each other block: the key names both, the lower first
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("cls", "n", "sig", "buckets", F.col("h.bucket").alias("bucket"), "block", other).withColumns(
        {"low": F.least("block", "other"), "high": F.greatest("block", "other")}
    )

    keys, columns = ("bucket", "low", "high"), ["cls", "n", "sig", "buckets", "bucket", "block", "low", "high"]

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _Rows(batches)
        keep = []
        for g in rows.groups():
            pairs = g.pairs(similarity)
            if pairs.any():
                keep.append(g.first + np.flatnonzero(pairs.any(axis=0) | pairs.any(axis=1)))
        if keep:
            yield rows.frame.iloc[np.concatenate(keep)][columns]

    schema = "cls long, n long, sig binary, buckets array<long>, bucket long, block int, low int, high int"
    tasks = shuffle_width(df.sparkSession, met.count() * runs, ROWS_PER_TASK)
    wanted = stored(dealt.repartition(tasks, *keys).mapInPandas(candidates, schema))
    classes_wanted = wanted.select(F.col("cls").alias("row")).distinct()
    texts = only_rows(docs.select("row", "t"), "row", classes_wanted).join(classes_wanted, "row").withColumnRenamed("row", "cls")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _Rows(batches)
        for g in rows.groups():
            a, b = g.linked(similarity, words)
            if len(a):
                m, cls = len(g.n), rows.cls[g.first : g.end]
                links = np.bincount(a, minlength=m) + np.bincount(b, minlength=m)
                yield pd.DataFrame({"cls": cls, "links": links, "root": cls[_roots(m, a, b)]})[links > 0]

    tasks = shuffle_width(df.sparkSession, wanted.count(), TEXTS_PER_TASK)
    found = stored(wanted.join(texts, "cls").repartition(tasks, *keys).mapInPandas(compare, "cls long, links long, root long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("n_links"))
    groups = connected(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    named = classes.select(*same, "cls", "set_id", "n_copies").join(links, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    named = named.withColumn("root", F.coalesce("root", "cls"))
    lowest = named.groupBy("root").agg(F.min("set_id").alias("class_id"))
    named = salted_join(named, lowest, ["root"], ["cls"], HOT, SALTS).select(*same, "class_id", "root", "set_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    # a text may have very many copies
    out = salted_join(rows.select("i", "row", *same), named, same, ["row"], HOT, SALTS, "left")
    return out.select(
        F.col("i").alias(id_col), "row", "root", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("i")).alias("class_id"),
        F.when(F.col("n") > 0, F.col("set_id")).otherwise(F.col("i")).alias("set_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )
