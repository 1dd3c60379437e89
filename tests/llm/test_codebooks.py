import hashlib
import math
import random

import numpy as np
import pytest

from cellspan.llm import codebooks, queries


def compressed(rows, parts=8, entries=16, rounds=6):
    """Brute force in Python integers over (id, vector, label)."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max(len(v) for _, v, _ in rows) // parts))
    whole = lambda x: math.floor(x * 4096) if abs(x) < 2**60 else int(x) * 4096
    pad = lambda v: [whole(x) for x in v] + [0] * (parts * width - len(v))
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = [[pad(v)[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in rows]
    books = [[v[p] for v in vectors[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        codes = [[nearest(v[p], books[p])[1] for p in range(parts)] for v in vectors]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, c in zip(vectors, codes) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in vectors]
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, label), e in zip(rows, errors):
        by[label] = by.get(label, 0) + e
    clip = lambda x: min(x, 2**63 - 1)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for _, c in f), clip(e), clip(by[label]), digest) for (i, _, label), f, e in zip(rows, found, errors)), key=repr)


def vectors(seed, n, d, scale=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, scale) for _ in range(d)] for _ in range(10)]
    out = []
    for i in r.sample(range(10_000), n):
        c = r.choice(centres)
        out.append((i, [float(np.float32(x + r.gauss(0, 0.3 * scale))) for x in c], r.choice((0, 1, 2, None))))
    return out


def run(spark, tmp_path, rows, element="float"):
    df = spark.createDataFrame([(*r, "clash", b"x") for r in rows], f"vec_id long, embedding array<{element}>, label int, v string, code binary").repartition(5)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    out = queries.QUERIES["op12_vector_codes"](spark, str(tmp_path))
    return sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_matches_brute_force(spark, tmp_path):
    rows = vectors(1, 300, 24)
    rows += [(rows[0][0], rows[0][1], 2), (rows[0][0], rows[1][1], 0), rows[5], rows[5]]  # ids and rows that repeat
    rows += [(None, rows[7][1], 1), (20_000, None, 1), (20_001, [0.5] * 23 + [None], 1), (20_002, [float("nan")] * 24, 1), (20_003, [float("inf")] * 24, 1)]
    rows += [(20_004, [0.25] * 9, 0), (20_005, [], 0), (3, [1.0] * 24, None)]
    assert run(spark, tmp_path, rows) == compressed(rows)


def test_equal_distances_and_few_vectors(spark, tmp_path):
    r = random.Random(2)
    grid = [(i, [float(r.randint(-1, 1)) for _ in range(16)], 0) for i in range(120)]
    assert run(spark, tmp_path, grid) == compressed(grid)
    (tmp_path / "few").mkdir()
    assert run(spark, tmp_path / "few", grid[:5]) == compressed(grid[:5])


@pytest.mark.parametrize("scale", [1e6, 1e30])
def test_large_components_stay_exact(spark, tmp_path, scale):
    rows = vectors(3, 60, 8, scale)
    assert run(spark, tmp_path, rows, "double") == compressed(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    (tmp_path / "none").mkdir()
    assert run(spark, tmp_path / "none", [(1, None, 0)]) == []


def test_search_starts_anywhere_and_reads_less():
    r = np.random.default_rng(5)
    centres = r.integers(-4000, 4000, (16, 8))
    points = centres[r.integers(0, 16, 2000)] + r.integers(-200, 200, (2000, 8))
    distances = ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    book = codebooks.Exponion(centres)
    for start in (distances.argmin(axis=1), r.integers(0, 16, 2000)):
        best, least = book.nearest(points, start)
        assert (best == distances.argmin(axis=1)).all() and (least == distances.min(axis=1)).all()
    near = distances.min(axis=1)
    looked_at = sum(int((4 * near >= d).sum()) for e in range(1) for d, _ in book.neighbours[e])
    assert looked_at < 0.5 * 15 * len(points)
