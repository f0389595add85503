"""Exact top-k by inner product: columnar branch and bound over integer vectors.

Inside a block the vectors lie dimension by dimension, widest dimensions first.
A query adds up its products one block of dimensions at a time.  What the rest
can still add is at most the product of the remaining masses (norms) of query
and candidate, by Cauchy-Schwarz.  After each block the candidates that lead are
scored to the end; the k-th best of those scores, or of all lower bounds if that
is more, is what a candidate's upper bound must reach.  The others are dropped
and the survivors compacted before the next block.  Bounds prune strictly, so
ties survive to be settled by id, and sums of integers below 2**53 are exact in
double precision.  Vectors too wide for that are multiplied in limbs of 20 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.vectors import blocked_topk, hashed, valid_vectors

ROWS_PER_BLOCK = 16_384
QUERIES_PER_BLOCK = 8_192
DIMENSIONS = 8
SCALE = 256
#: Two vectors with norms below this have exact products in double precision.
NARROW = 2.0**26
#: Components below this are split into limbs; beyond, Python's integers serve.
LIMBED = 2.0**40
_LEAST, _MOST = -(2**63), 2**63 - 1


def quantised(v: np.ndarray, scale: float = SCALE) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(scale * v)


def _kth(score: np.ndarray, owner: np.ndarray | None, k: int) -> float:
    """The k-th best score, one to an owner; owners ascend."""
    if owner is not None and len(score):
        score = np.maximum.reduceat(score, np.flatnonzero(np.append(True, owner[1:] != owner[:-1])))
    return np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf


def branch_and_bound(
    query: np.ndarray, columns: np.ndarray, mass: np.ndarray, k: int, step: int, owner: np.ndarray | None = None, visited: list[int] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of all candidates that may be among the k best.

    ``columns``: dimensions x candidates.  ``mass[b]``: each candidate's norm
    over the dimensions from block b on.  ``owner``: ascending ids where some
    are repeated; an id then counts once, by its best candidate.  ``visited``
    collects how many candidates each block of dimensions still met.
    """
    n = columns.shape[1]
    alive, partial, least = np.arange(n), np.zeros(n), -np.inf
    rest = np.sqrt(np.append(np.cumsum((query**2)[::-1])[::-1], 0.0))
    for b, at in enumerate(range(0, len(query), step)):
        if visited is not None:
            visited.append(len(alive))
        block = columns[at : at + step] if len(alive) == n else columns[at : at + step, alive]
        partial = partial + query[at : at + step] @ block
        if len(alive) <= k:
            continue
        upto = min(at + step, len(query))
        slack = rest[upto] * mass[b + 1, alive]
        leads = min(4 * k, len(alive))
        lead = np.sort(np.argpartition(partial, len(partial) - leads)[len(partial) - leads :])
        whole = partial[lead] + query[upto:] @ columns[upto:, alive[lead]]
        names = None if owner is None else owner[alive]
        least = max(least, _kth(whole, None if names is None else names[lead], k), _kth(partial - slack, names, k))
        keep = partial + slack >= least - 1e-6 * max(1.0, abs(least))
        if keep.sum() < 0.9 * len(keep) or upto >= len(query):
            alive, partial = alive[keep], partial[keep]
    return alive, partial


def wide_scores(query: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer products of any width: exact, held at the ends of a long, and as doubles where they
    lie beyond (else 0).  Arguments are not yet quantised."""
    q, r = quantised(query), quantised(rows)
    if max(np.abs(q).max(initial=0), np.abs(r).max(initial=0)) < LIMBED and len(q) < 1 << 13:
        qh, rh = np.floor(q / 2**20), np.floor(r / 2**20)
        ql, rl = q - qh * 2**20, r - rh * 2**20
        high, middle, low = rh @ qh, rh @ ql + rl @ qh, rl @ ql
        about = high * 2.0**40 + middle * 2.0**20 + low
        out = (high.astype(np.int64) << 40) + (middle.astype(np.int64) << 20) + low.astype(np.int64)
        # integers wrap; near the ends the sign tells, further out the size
        over = (np.abs(about) > 1.5 * 2.0**63) | ((np.abs(about) > 2.0**62) & ((about < 0) != (out < 0)))
        return np.where(over, np.where(about > 0, _MOST, _LEAST), out), np.where(over, about, 0.0)
    exact = lambda x: int(x) * SCALE if abs(x) >= 2**53 else int(np.floor(SCALE * x))
    q = [exact(x) for x in query.tolist()]
    products = [sum(a * exact(x) for a, x in zip(q, row)) for row in rows.tolist()]
    held = [min(max(x, _LEAST), _MOST) for x in products]
    # halved until a double holds them: only their order matters
    about = [float(x // 2**1100) * 2.0**60 if abs(x) >= 2**1020 else float(x) for x in products]
    return np.array(held, np.int64), np.array([a if x != h else 0.0 for a, x, h in zip(about, products, held)])


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, step: int = DIMENSIONS) -> pd.DataFrame:
    by_id = np.argsort(ids, kind="stable")
    ids, rows = ids[by_id], rows[by_id]
    with np.errstate(over="ignore"):
        q, r = quantised(queries), quantised(rows)
        broad, broad_query = np.linalg.norm(r, axis=1) >= NARROW, np.linalg.norm(q, axis=1) >= NARROW
    few = np.flatnonzero(broad)
    names, plain = ids[~broad], r[~broad]
    owner = names if (names[1:] == names[:-1]).any() else None
    order = np.argsort(-plain.var(axis=0), kind="stable") if len(plain) else np.arange(rows.shape[1])
    columns = np.ascontiguousarray(plain[:, order].T)
    squares = columns**2
    mass = np.sqrt([squares[e:].sum(axis=0) for e in [*range(0, len(order), step), len(order)]])
    out = []
    for n, query_id in enumerate(query_ids):
        if broad_query[n]:
            near, (score, over) = ids, wide_scores(queries[n], rows)
        else:
            # one more than k: the query's own id may be among them
            at, found = branch_and_bound(q[n, order], columns, mass, k + int((names == query_id).any()), step, owner)
            near, score, over = names[at], found.astype(np.int64), np.zeros(len(at))
            if len(few):
                more, beyond = wide_scores(queries[n], rows[few])
                near, score, over = np.append(near, ids[few]), np.append(score, more), np.append(over, beyond)
        best: dict[int, tuple] = {}
        for i in np.lexsort((near, -over, ~score)).tolist():
            if near[i] != query_id:
                best.setdefault(int(near[i]), (int(score[i]), float(over[i])))
                if len(best) == k:
                    break
        out += [(query_id, i, *s) for i, s in best.items()]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "over"])


def exact_topk(
    df: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    query_modulus: int = 50,
    rows_per_block: int = ROWS_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (long) for rows whose id is divisible by ``query_modulus``.

    Components become floor(256 * x).  Rows with a null id, a null or empty
    vector, or a null or non-finite component take no part; ids name vectors, so
    a repeated row counts once, an id with several vectors by the best of them,
    and no row with the query's id is its neighbour.  Vectors of another length
    are no candidates, those of any length are read whole.  Scores beyond a long
    are ranked as doubles and held at its ends; ties go to smaller ids.  An empty table gives an empty
    result.  Other columns are not read.  Each query meets every row once, in
    blocks of bounded size.
    """
    rows = stored(valid_vectors(df, id_col, vector))
    n = rows.count()
    queries = rows.where(F.col("vec_id") % query_modulus == 0)
    stripes = max(1, -(-n // rows_per_block))
    turns = max(1, -(-queries.count() // queries_per_block))
    # key = turn * stripes + stripe: a block of queries meets every stripe of rows
    each = lambda first, times, of: F.explode(F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda i: of(first, i)))
    q = queries.select("vec_id", "v", each(hashed(turns), stripes, lambda turn, i: turn * stripes + i).alias("key"))
    r = rows.select("vec_id", "v", each(hashed(stripes), turns, lambda stripe, i: i * stripes + stripe).alias("key"))

    def scorer(asked: pd.DataFrame, queries: np.ndarray, found: pd.DataFrame, rows: np.ndarray) -> pd.DataFrame:
        return search_block(asked["vec_id"].to_numpy(), queries, found["vec_id"].to_numpy(), rows, k)

    return blocked_topk(q, r, stripes * turns, k, scorer, "long")
