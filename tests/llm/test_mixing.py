import random

from cellspan.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def targets(sizes, share=1.5, most=2.0):
    """Brute force: deal by weight, stop at the cap, deal the excess again until none is above."""
    keys = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    w = {k: (3, 1, 2)[i % 3] for i, k in enumerate(keys)}
    left, free, out = share * sum(sizes.values()), set(keys), {}
    while True:
        total = sum(w[k] for k in free)
        over = {k for k in free if left * w[k] / total > most * sizes[k]} if total else set()
        if not over:
            return out | {k: left * w[k] / total if total else 0.0 for k in free}
        out |= {k: most * sizes[k] for k in over}
        free -= over
        left = share * sum(sizes.values()) - sum(out.values())


def check(rows, got):
    size = {s: sum(len((t or "").split()) for _, t, _, x, _ in rows if x == s) for s in {r[3] for r in rows}}
    want = targets(size)
    taken, longest = dict.fromkeys(size, 0), max([len((r[1] or "").split()) for r in rows], default=0)
    assert len(got) == len(rows)
    for r in got:
        s = r["source"]
        assert r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
    for s, x in taken.items():
        assert abs(x - want[s]) <= 2 * longest, (s, x, want[s])
        # The documents taken are balanced too: as many as the source's share of its words, within a few.
        mine = [r["copies"] for r in got if r["source"] == s]
        assert abs(sum(mine) - len(mine) * want[s] / max(1, size[s])) <= 3, (s, sum(mine))


def test_targets_are_met(spark):
    r = random.Random(1)
    rows = [
        (i, "w " * r.choice([0, 1, 5, 30, 31, 32, 33, 200]), "en", r.choice(["a", "b", "Z", "é", None, "big", "big", "big"]), 1)
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, block=64).collect()
    check(rows, got)
    again = mixing.mix(df.repartition(5), block=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_odd_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([(1, None, None, None, None), (None, "", None, "a", None)], SCHEMA)
    assert [r["taken"] for r in mixing.mix(none).collect()] == [0, 0]
    rows = [(1, "a b c", "x", "s", 1)] * 50 + [(None, "a b", "x", None, 1)] * 9 + [(3, "long " * 100_000, "x", "t", 1)]
    check(rows, mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect())


def test_flight_keeps_totals():
    r = random.Random(4)
    p = [r.random() for _ in range(500)]
    size = [float(r.choice([1, 2, 3, 50, 700])) for _ in p]
    q = mixing.flight(p, size, 7)
    assert sum(0 < x < 1 for x in q) <= 2
    assert abs(sum(p) - sum(q)) < 1e-6
    assert abs(sum(a * b for a, b in zip(p, size)) - sum(a * b for a, b in zip(q, size))) < 1e-4
    mean = [sum(x) / 400 for x in zip(*(mixing.flight([0.3, 0.5, 0.7, 0.5], [1.0, 2.0, 3.0, 4.0], s) for s in range(400)))]
    assert max(abs(a - b) for a, b in zip(mean, [0.3, 0.5, 0.7, 0.5])) < 0.1
