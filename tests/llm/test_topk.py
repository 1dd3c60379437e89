import math
import random

from cellspan.llm import topk


def brute(rows, query_ids, k):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if q in query_ids:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)
            out += [(q, r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, query_ids, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.top_k(df, df.where(df.vec_id.isin(list(query_ids))), **kw)
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in out.collect())


def test_matches_brute_force_over_many_cells(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([-1.0, -0.5, 0.0, 0.3, r.gauss(0, 1)]) for _ in range(7)]) for i in range(600)]
    rows += [(1000 + i, [0.25] * 7) for i in range(300)]  # one common vector: many ties
    ids = set(range(0, 600, 50)) | {1000, 1250}
    assert run(spark, rows, ids, candidates=64, block=5) == brute(rows, ids, 5)
    assert run(spark, rows, ids) == brute(rows, ids, 5)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, [None, 1.0]), (150, [math.inf, 1.0]), (200, [math.nan, 1.0])]
    rows += [(None, [1.0, 1.0]), (250, []), (300, [1.0]), (1, [0.0, -3.0]), (350, [1e12, 2.0]), (2, [-1e12, 1.0, 4.0])]
    ids = {0, 50, 100, 150, 200, 250, 300, 350}
    assert run(spark, rows, ids) == brute(rows, ids, 5)


def test_empty_and_repeated(spark):
    assert run(spark, [], {0}) == []
    assert run(spark, [(0, [1.0])], {0}) == []
    assert run(spark, [(0, [1.0])] * 3 + [(1, [2.0])] * 2, {0}) == [(0, 1, 1, 131072), (0, 2, 1, 131072)]
    df = spark.createDataFrame([(0, [1.0], 7, 7), (1, [2.0], 8, 8)], "vec_id long, embedding array<float>, score long, block int")
    assert topk.top_k(df, df).count() == 2


def test_repeated_rows_and_ties_over_cells(spark):
    """Every row is a candidate: copies of an id, in whatever cells they are; very long vectors."""
    r = random.Random(7)
    rows = [(i % 70, [float(i % 3)] * 5) for i in range(400)] + [(500 + i, [0.125] * 20_000) for i in range(3)]
    r.shuffle(rows)
    ids = {500, 501, 69}
    want, fine = [], [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    for q, a in {(i, tuple(v)) for i, v in fine if i in ids}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    assert run(spark, rows, ids, candidates=32, block=2) == sorted(want)
