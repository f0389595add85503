"""Approximate nearest neighbours over learned, balanced partitions.

A bounded, hash-chosen sample is searched exactly, which gives a neighbour
graph.  Recursive spectral bisection at the median, refined by balanced swaps,
cuts that graph into equal parts with few edges between them.  A small network
learns from the sample where a vector's neighbours lie (soft labels); it then
assigns *every* row to its most probable part and sends a query to the several
most probable ones, until they hold a share of its probability that is
calibrated on the sample for the recall asked for.  What a query meets there is
reranked in full precision.  Neighbouring parts lie in one block, so that a query
travels once to a block and meets there only the parts that it visits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import kind_of, stored
from tidemark.llm.vectors import blocked_topk, hashed, stacked, valid_vectors

SAMPLE = 12_288
#: Sampled vectors to a part, so that the router has something to learn from.
SAMPLE_PER_PART = 24
ROWS_PER_BLOCK = 16_384
QUERIES_PER_BLOCK = 16_384
GRAPH_NEIGHBOURS = 10
HIDDEN = 128
RECALL = 0.95
#: A query visits parts of this many rows per neighbour asked for, at least.
LEAST_ROWS = 8


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each vector, by inner product."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        score = x[at : at + 1024] @ x.T
        score[np.arange(len(score)), np.arange(at, at + len(score))] = -np.inf
        out[at : at + 1024] = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return out


def _halves(nodes: np.ndarray, near: np.ndarray, rng: np.random.Generator, rounds: int = 60, swaps: int = 8) -> np.ndarray:
    """True for one half of the nodes: the second eigenvector's median, then swaps."""
    local = np.full(near.shape[0], -1)
    local[nodes] = np.arange(len(nodes))
    to = local[near[nodes]]
    a, b = np.nonzero(to >= 0)
    b = to[a, b]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.bincount(a, minlength=len(nodes)) + 1.0
    root = np.sqrt(degree)
    x = rng.standard_normal(len(nodes))
    for _ in range(rounds):
        x -= root * (root @ x) / (root @ root)
        y = x / root
        x = 0.5 * x + 0.5 * (np.bincount(a, y[b], len(nodes)) + y) / root
        x /= np.linalg.norm(x) or 1.0
    side = np.zeros(len(nodes), bool)
    side[np.argsort(x / root, kind="stable")[len(nodes) // 2 :]] = True
    for _ in range(swaps):
        across = np.bincount(a, side[a] != side[b], len(nodes)) * 2 - (degree - 1)
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        one, two = one[np.argsort(-across[one], kind="stable")], two[np.argsort(-across[two], kind="stable")]
        m = min(len(one), len(two))
        good = np.flatnonzero(across[one[:m]] + across[two[:m]] > 2)[: max(1, m // 8)]
        if not len(good):
            break
        side[one[good]], side[two[good]] = False, True
    return side


def balanced_parts(near: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A part number per node; parts differ by a node or so in size."""
    rng, out = np.random.default_rng(seed), np.zeros(near.shape[0], np.int64)

    def split(nodes: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            out[nodes] = first
            return
        side = _halves(nodes, near, rng)
        split(nodes[~side], first, n // 2)
        split(nodes[side], first + n // 2, n - n // 2)

    split(np.arange(near.shape[0]), 0, 1 << (parts - 1).bit_length())
    return out


class Router:
    """Vector to part probabilities: one hidden layer, trained by Adam on soft labels."""

    def __init__(self, width: int, parts: int, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.w = [rng.standard_normal((width, hidden)) * (2 / width) ** 0.5, np.zeros(hidden), rng.standard_normal((hidden, parts)) * (1 / hidden) ** 0.5, np.zeros(parts)]

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm > 0, norm, 1.0) * np.sqrt(x.shape[1])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(self._unit(x) @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 25, batch: int = 256, rate: float = 2e-3, seed: int = 5) -> Router:
        rng, x = np.random.default_rng(seed), self._unit(x)
        m, v, t = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                h = np.maximum(x[rows] @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3]
                e = np.exp(z - z.max(axis=1, keepdims=True))
                d = (e / e.sum(axis=1, keepdims=True) - y[rows]) / len(rows)
                back = (d @ self.w[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self


def learn_router(x: np.ndarray, parts: int, recall: float, k: int) -> tuple[Router, float]:
    """A router and the share of its probability that a query visits for that recall.

    An eighth of the sample is held out of the graph and of the fit; its
    neighbours in the whole sample say how far down a query must go."""
    held = np.arange(len(x)) % 8 == 0
    fit, test = x[~held], x[held]
    near = neighbour_graph(fit, min(GRAPH_NEIGHBOURS, len(fit) - 1))
    part = balanced_parts(near, parts)
    parts = int(part.max()) + 1
    soft = np.eye(parts)[part]
    soft = (soft + soft[near].mean(axis=1)) / 2
    router = Router(x.shape[1], parts).fit(fit, soft)
    home = router.probabilities(x).argmax(axis=1)
    p = router.probabilities(test)
    order = np.argsort(-p, axis=1, kind="stable")
    mass = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
    before = np.empty_like(mass)
    np.put_along_axis(before, order, mass - np.take_along_axis(p, order, axis=1), axis=1)
    score = test @ x.T
    score[np.arange(len(test)), np.flatnonzero(held)] = -np.inf
    m = min(k, len(x) - 1)
    truth = home[np.argpartition(-score, m - 1, axis=1)[:, :m]]
    # the probability that stands before a neighbour's part must be visited first
    return router, float(np.quantile(np.take_along_axis(before, truth, axis=1), recall, method="higher"))


def visited(p: np.ndarray, mass: float, sizes: np.ndarray, least: int) -> list[np.ndarray]:
    """Most probable parts of each row of p, as long as what stands before them is at most ``mass``
    or holds fewer than ``least`` rows."""
    order = np.argsort(-p, axis=1, kind="stable")
    sorted_, rows = np.take_along_axis(p, order, axis=1), sizes[order]
    before, filled = np.cumsum(sorted_, axis=1) - sorted_, np.cumsum(rows, axis=1) - rows
    return [np.sort(o[m]) for o, m in zip(order, (before <= mass) | (filled < least))]


@dataclass
class Index:
    """What was learned from the sample: vectors of ``width`` go to the router's parts, others to the last."""

    router: Router
    mass: float
    width: int

    @property
    def last(self) -> int:
        return self.router.w[3].shape[0]

    def parts(self, vectors: pd.Series) -> np.ndarray:
        out = np.full(len(vectors), self.last, np.int32)
        same = (vectors.map(len) == self.width).to_numpy()
        if same.any():
            out[same] = self.router.probabilities(stacked(vectors[same], self.width)).argmax(axis=1)
        return out

    def visits(self, vectors: pd.Series, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The parts that each query visits, of the parts with rows."""
        out = [np.array([self.last])] * len(vectors)
        same = np.flatnonzero((vectors.map(len) == self.width).to_numpy())
        if len(same):
            found = visited(self.router.probabilities(stacked(vectors.iloc[same], self.width)), self.mass, sizes[: self.last], least)
            for i, parts in zip(same, found):
                out[i] = parts
        return [x[sizes[x] > 0] for x in out]


def rerank(
    query_ids: np.ndarray, queries: np.ndarray, visits: list[np.ndarray], ids: np.ndarray, rows: np.ndarray, part: np.ndarray, k: int
) -> pd.DataFrame:
    """The k best of the rows in the parts that a query visits, by exact double inner product; ties to smaller ids.

    A product of matrices, part by part, selects, with a margin for its rounding;
    the row-wise sum, the same for equal vectors wherever they stand, decides."""
    order = np.lexsort((ids, part))
    ids, rows, part = ids[order], rows[order], part[order]
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
    slices = list(zip(part[edges].tolist(), edges, [*edges[1:], len(part)]))
    norm = np.linalg.norm(rows, axis=1).max(initial=0)
    repeated = len(np.unique(ids)) < len(ids)
    query, row, found = [], [], []
    for at in range(0, len(queries), 256):
        block, some = queries[at : at + 256], visits[at : at + 256]
        score = np.full((len(block), len(ids)), -np.inf)
        owner, parts = np.repeat(np.arange(len(some)), [len(x) for x in some]), np.concatenate(some)
        for p, a, b in slices:
            who = owner[parts == p]
            if len(who):
                score[who, a:b] = block[who] @ rows[a:b].T
        slack = 1e-12 * norm * np.linalg.norm(block, axis=1)
        for i in range(len(block)):
            s = score[i]
            s[ids == query_ids[at + i]] = -np.inf
            m = int((s > -np.inf).sum())
            if not m:
                continue
            # repeated ids fill places of their own, so all that could matter are looked at
            if m <= k or repeated:
                near = np.flatnonzero(s > -np.inf)
            else:
                near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k] - slack[i])
            exact = (rows[near] * block[i]).sum(axis=1)
            best = np.lexsort((ids[near], -exact))
            if repeated:
                best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])]
            best = best[:k]
            query.append(np.full(len(best), query_ids[at + i]))
            row.append(ids[near[best]])
            found.append(exact[best])
    if not query:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "over": []})
    return pd.DataFrame({"query_id": np.concatenate(query), "vec_id": np.concatenate(row), "score": np.concatenate(found), "over": 0.0})


def _blocks(sizes: np.ndarray, rows_per_block: int) -> tuple[dict[int, tuple[int, int]], int]:
    """Per part its first block and how many it fills; neighbouring small parts share one."""
    out, made, room = {}, 0, 0
    for p in np.flatnonzero(sizes).tolist():
        if sizes[p] <= room:
            out[p], room = (made - 1, 1), room - sizes[p]
            continue
        many = int(-(-sizes[p] // rows_per_block))
        out[p], made = (made, many), made + many
        room = rows_per_block - sizes[p] if many == 1 else 0
    return out, made


def nearest(
    df: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    query_modulus: int = 20,
    sample: int = SAMPLE,
    sample_per_part: int = SAMPLE_PER_PART,
    rows_per_block: int = ROWS_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
    recall: float = RECALL,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (double) for rows whose id is divisible by ``query_modulus``.

    The index is fitted on at most ``sample`` vectors and holds every row; the
    sample decides the number of parts, at every size of the table.  Rows with a
    null id, a null, empty or zero vector, or a null or non-finite component take
    no part; ids name vectors, so a repeated row counts once, an id with several
    vectors by the best of them, and no row with the query's id is its neighbour.
    Vectors of other lengths than the sample's commonest are kept in a part of
    their own and searched in full.  A part beyond ``rows_per_block`` rows (a hot
    vector) is split over blocks; a query visits all of them.  Ties go to smaller
    ids; an empty table gives an empty result.  Other columns are not read.
    """
    indexed, index = index_vectors(df, id_col, vector, k, sample, sample_per_part, recall)
    sizes = np.zeros(index.last + 1, np.int64)
    for p, n in indexed.groupBy("part").count().collect():  # at most sample / sample_per_part + 1 rows
        sizes[p] = n
    at, made = _blocks(sizes, rows_per_block)
    asked = indexed.where(F.col("vec_id") % query_modulus == 0)
    # no block meets more queries than all; a block with too many meets them in turns
    turns = max(1, -(-asked.count() // queries_per_block))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, v, turn, parts in zip(batch["vec_id"], batch["v"], batch["turn"], index.visits(batch["v"], sizes, LEAST_ROWS * k)):
                blocks: dict[int, list[int]] = {}
                for p in parts.tolist():
                    first, many = at[p]
                    for b in range(first, first + many):
                        blocks.setdefault(b, []).append(p)
                out += [(i, v, b * turns + turn, parts) for b, parts in blocks.items()]
            yield pd.DataFrame(out, columns=["vec_id", "v", "key", "parts"])

    kind = kind_of(indexed, "v")
    queries = asked.select("vec_id", "v", hashed(turns).alias("turn")).mapInPandas(deal, f"vec_id long, v {kind}, key long, parts array<int>")
    where = F.create_map(*[F.lit(x) for p, (first, many) in at.items() for x in (p, first * (1 << 32) + many)]) if at else F.create_map(F.lit(0), F.lit(1))
    place = F.element_at(where, F.col("part"))
    block = F.floor(place / (1 << 32)) + F.pmod(F.xxhash64("vec_id", "v"), place.cast("long") % (1 << 32))
    rows = indexed.select("vec_id", "v", "part", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    rows = rows.select("vec_id", "v", "part", (F.col("block") * turns + F.col("turn")).cast("long").alias("key"))

    def scorer(asked: pd.DataFrame, queries: np.ndarray, found: pd.DataFrame, rows: np.ndarray) -> pd.DataFrame:
        visits = [np.asarray(x) for x in asked["parts"]]
        return rerank(asked["vec_id"].to_numpy(), queries, visits, found["vec_id"].to_numpy(), rows, found["part"].to_numpy(), k)

    return blocked_topk(queries, rows, made * turns, k, scorer, "double")


def index_vectors(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 20,
    sample: int = SAMPLE, sample_per_part: int = SAMPLE_PER_PART, recall: float = RECALL,
) -> tuple[DataFrame, Index]:
    """Every valid row's part (``vec_id``, ``v``, ``part``), and what decides it."""
    valid = stored(valid_vectors(df, id_col, vector, nonzero=True))
    n = valid.count()
    share = min(1.0, 1.5 * sample / max(n, 1))
    order = F.xxhash64("vec_id", F.lit(17))
    some = valid.where(F.pmod(order, F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).orderBy(order, "vec_id", "v").limit(sample).toPandas()
    widths = some["v"].map(len)
    width = int(widths.mode().min()) if len(some) else 1
    x = stacked(some["v"][widths == width], width)
    learned = len(x) >= 2 * max(sample_per_part, GRAPH_NEIGHBOURS)
    index = Index(*(learn_router(x, len(x) // sample_per_part, recall, k) if learned else (Router(width, 1), 1.0)), width)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(part=index.parts(batch["v"]))

    return stored(valid.mapInPandas(route, f"vec_id long, v {kind_of(valid, 'v')}, part int")), index
