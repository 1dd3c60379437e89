import random

import pytest
import xxhash

from cellspan.llm import simhash
from cellspan.llm.common import connected_components


def fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(w, w[1:], w[2:])] or ([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [])
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(fps):
    """Brute force over (id, fingerprint): smallest id reachable over links of three bits or fewer."""
    at = list(range(len(fps)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, f, least[root(i)]) for i, (d, f) in enumerate(fps)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return simhash.near_duplicates(df)


def docs(seed=3):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)] + ["É", "ß", "x\x0by"]
    base = [" ".join(r.choices(vocab, k=r.randint(1, 200))) for _ in range(60)]
    out = list(base)
    for t in base[:30]:
        for _ in range(6):
            w = t.split(" ")
            w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
    out += ["", None, " \t\n", "one", "ONE", "a b", base[0].upper(), base[0], "z " * 70_000]
    ids = r.sample(range(10_000), len(out))
    return [(i, t, "en", "s", 1) for i, t in zip(ids, out)]


def test_matches_brute_force(spark):
    rows = docs()
    want = components([(r[0], fingerprint(r[1])) for r in rows])
    got = [(r["id"], r["fp"] % (1 << 64), r["component"]) for r in run(spark, rows).collect()]
    assert sorted(got) == sorted(want)
    assert len({c for *_, c in got}) < len(got)


def test_blocks_of_long_texts_lose_no_shingle(spark):
    texts = [" ".join(map(str, random.Random(2).choices(range(10**6), k=300_000))), " ".join(map(str, range((1 << 15) + 2)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(df).collect()}
    assert got == {i: fingerprint(t) for i, t in enumerate(texts)}


def test_hot_variants_lose_no_link(spark, monkeypatch):
    r = random.Random(5)
    base = r.getrandbits(64)
    fps = {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(400)}
    fps |= {r.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = {(min(signed(a), signed(b)), max(signed(a), signed(b))) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 3}
    for hot in (1 << 30, 3):
        monkeypatch.setattr(simhash, "HOT_VARIANT", hot)
        got = [(x["a"], x["b"]) for x in simhash.near_links(df).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_empty_table_and_repeated_rows(spark):
    assert run(spark, []).count() == 0
    rows = [(7, "a b c d", None, None, None)] * 3 + [(None, "a b c d", "x", "y", 2), (None, None, None, None, None)]
    got = sorted(((r["id"], r["component"]) for r in run(spark, rows).collect()), key=str)
    assert got == sorted([(7, 7)] * 3 + [(None, 7), (None, None)], key=str)


def test_keep_one(spark):
    rows = [(1, "a b c d", "en", "s", 7), (2, "A B c d", "en", "s", 7), (3, "other words are here", "en", "s", 1)]
    rows += [(1, "a b c d", "en", "s", 7), (None, "a b c d", "en", "s", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(
        [(1, "a b c d"), (3, "other words are here")], key=str
    )


def test_keep_one_tells_rows_of_one_id_apart(spark):
    rows = [(5, "one text of its own"), (5, "quite other words here"), (3, "quite other words here"), (None, "a third text is here"), (None, None), (None, "")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = {(r["doc_id"], r["text"]) for r in got}
    assert len(got) == 4 and {(5, rows[0][1]), (3, rows[1][1]), (None, rows[3][1])} < kept


@pytest.mark.parametrize("n", [1, 2, 40])
def test_components_of_paths(spark, n):
    edges = [(i * 7 % (n + 1), (i + 1) * 7 % (n + 1)) for i in range(n)]
    df = spark.createDataFrame(edges + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    want = {}
    for a, b in [*edges, (100, 101)]:
        for x in (a, b):
            want.setdefault(x, {x})
        joined = want[a] | want[b]
        for x in joined:
            want[x] = joined
    assert got == {x: min(s) for x, s in want.items() if len(s) > 1}
