"""Exact top-k inner-product search by no-random-access aggregation over sorted component lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one cell of the search: so many candidates and so many queries meet in one task.
CANDIDATES, QUERIES = 4096, 512


def scaled(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v array<long>)``: components as floor(256 x). Rows with a null id, a null vector or a null or non-finite
    component take no part."""
    v = f"`{vec_col}`"
    fine = f"`{id_col}` is not null and {v} is not null and forall({v}, x -> coalesce(abs(cast(x as double)) < double('inf'), false))"
    return vectors.where(fine).select(
        F.col(id_col).alias("id"), F.expr(f"transform({v}, x -> floor(256 * cast(x as double)))").alias("v")
    )


def nra(c, q, k: int, own):
    """Top ``k`` of the rows of ``c`` for every row of ``q``: lists of (row, score), unordered, with all ties of the last.

    Each component of ``c`` is a sorted list. A query reads every list from the end that is good for it, all to the same
    depth, block by block. What has been read gives each row a known part of its score; a component not yet read is
    at most the last one read and at least the list's worst. A row whose upper bound is under the k-th best lower bound
    cannot qualify. When few rows are left, or the lists are read through, their final scores are resolved. ``own[i]``:
    rows that query i leaves out.
    """
    import numpy as np

    n, d = c.shape
    order = np.argsort(c, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    values = np.take_along_axis(c, order, axis=0)
    out = [None] * len(q)
    live = np.arange(len(q))
    good, bad = np.maximum(q, 0), np.minimum(q, 0)
    worst = good * values[0] + bad * values[-1]
    known = np.zeros((n, len(q)), dtype=c.dtype)
    read, depth = 0, max(1, n // 8)
    lowest = -(1 << 62) if c.dtype == object else -np.inf
    while len(live):
        depth = min(depth, n)
        high, low = rank >= n - depth, rank < depth
        g, b = good[live], bad[live]
        known += (c * (high & (rank < n - read))) @ g.T + (c * (low & (rank >= read))) @ b.T
        edge_high, edge_low = g * values[n - depth], b * values[depth - 1]
        seen_high, seen_low = high.astype(c.dtype), low.astype(c.dtype)
        upper = known + (edge_high + edge_low).sum(axis=1) - seen_high @ edge_high.T - seen_low @ edge_low.T
        w_high, w_low = g * values[0], b * values[-1]
        lower = known + worst[live].sum(axis=1) - seen_high @ w_high.T - seen_low @ w_low.T
        for col, i in enumerate(live):
            lower[own[i], col] = upper[own[i], col] = lowest
        floor = np.sort(lower, axis=0)[max(0, n - k)] if n else None
        may = upper >= floor
        left = may.sum(axis=0)
        done = (left <= max(16 * k, n // 64)) | (depth == n)
        for col in np.flatnonzero(done):
            i = live[col]
            rows = np.setdiff1d(np.flatnonzero(may[:, col]), own[i])
            out[i] = (rows, c[rows] @ q[i])
        known, live = known[:, ~done], live[~done]
        read, depth = depth, 2 * depth
    return out


def _matrix(column, width: int, dtype):
    import numpy as np

    m = np.zeros((len(column), width), dtype=dtype)
    for i, v in enumerate(column):
        m[i, : len(v)] = v
    return m


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    candidates: int = CANDIDATES,
    block: int = QUERIES,
) -> DataFrame:
    """``(query_id, rank int, id, score long)``: each query's ``k`` best candidates, ties to the smaller id.

    ``queries`` has the same columns as ``vectors``; a query's candidates are the rows of other ids. Both are dealt by
    hash into blocks of bounded size, and each block of queries meets each block of candidates in one task, as an
    equality join of block numbers; each such cell gives ``k`` rows a query, and a ranked window merges them. Nothing is
    broadcast. Missing components of shorter vectors count zero. Every row is a candidate, also one that repeats an id,
    a vector or both. Queries that repeat an id and a vector are one query; those of one id with different vectors are
    queries each (``query_hash`` tells them apart). Scores beyond 64 bits are
    clipped. No candidates or no queries: no rows.
    """
    c, q = scaled(vectors, id_col, vec_col), scaled(queries, id_col, vec_col)
    n_c, n_q = c.count(), q.count()
    cells, blocks = max(1, -(-n_c // candidates)), max(1, -(-n_q // block))
    kind = vectors.schema[id_col].dataType.simpleString()

    def deal(df, own, n, other, m):
        to = F.pmod(F.xxhash64("id"), F.lit(n)).alias(own)
        return df.select("id", "v", F.xxhash64("v").alias("h"), to, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other))

    left = deal(c, "cell", cells, "block", blocks)
    right = deal(q, "block", blocks, "cell", cells)

    def search(a, b):
        import numpy as np
        import pandas as pd

        empty = pd.DataFrame({"query_id": [], "query_hash": [], "id": [], "score": []})
        a, b = a.sort_values(["id", "h"]), b.sort_values(["id", "h"]).drop_duplicates(["id", "h"])
        if a.empty or b.empty:
            return empty
        width = max(max(map(len, a["v"])), max(map(len, b["v"])), 1)
        most = [max((int(np.abs(np.asarray(v, dtype=float)).max()) if len(v) else 0 for v in x["v"]), default=0) for x in (a, b)]
        exact = float if most[0] * most[1] * width < 1 << 50 else object  # whole numbers up to 2^53 are exact in floats
        va, vb = _matrix(a["v"], width, exact), _matrix(b["v"], width, exact)
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        at = pd.Series(np.arange(len(ia))).groupby(ia).indices
        none = np.array([], dtype=int)
        got, parts = nra(va, vb, k, [at.get(i, none) for i in ib]), []
        for i, h, (rows, score) in zip(ib, b["h"], got):
            best = np.lexsort((ia[rows], -score))[:k] if exact is float else sorted(range(len(rows)), key=lambda r: (-score[r], ia[rows[r]]))[:k]
            clipped = [max(-(1 << 63), min((1 << 63) - 1, int(score[r]))) for r in best]
            parts.append(pd.DataFrame({"query_id": i, "query_hash": h, "id": ia[rows[best]] if len(best) else [], "score": clipped}))
        return pd.concat(parts, ignore_index=True)

    met = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block"))
    found = met.applyInPandas(search, f"query_id {kind}, query_hash long, id {kind}, score long")
    w = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score", "query_hash"
    )
