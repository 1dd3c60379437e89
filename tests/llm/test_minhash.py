import random

import pytest

import corpus_pipeline
from cellspan.llm import minhash, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else {tuple(w)} - {()}


def components(rows):
    """Brute force: smallest id reachable over exact similarities of 0.8 or more."""
    sets, at = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) * 10 >= len(x | y) * 8:
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def docs(seed=4):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(500)] + ["É", "ß"]
    base = [" ".join(r.choices(vocab, k=r.randint(60, 200))) for _ in range(40)]
    out = list(base)
    for t in base[:25]:
        for edits in (1, 1, 2, 4):
            w = t.split(" ")
            for _ in range(edits):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
    chain = base[30].split(" ")
    for _ in range(30):
        chain[r.randrange(len(chain))] = r.choice(vocab)
        out.append(" ".join(chain))
    out += ["", None, " \t\n", "one", "ONE", "a b", base[0].upper(), base[0], "z " * 5000]
    return list(zip(r.sample(range(10_000), len(out)), out))


def test_matches_brute_force(spark):
    rows = docs()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["component"] for r in minhash.near_duplicates(df).collect()}
    assert got == components(rows)


def edited(text, places, mark):
    w = text.split(" ")
    for k in places:
        w[k] = f"{mark}{k}"
    return " ".join(w)


def test_large_group_of_edited_copies(spark):
    """Copies too far from the text they come from, some of which are near to each other by edits that they share."""
    r = random.Random(11)
    base = " ".join(f"v{r.randrange(400)}" for _ in range(120))
    out = [base]
    out += [edited(base, r.sample(range(120), 5), f"x{i}_") for i in range(30)]  # near to the base or to nothing
    for c in range(2):
        shared = edited(base, r.sample(range(120), 6), f"c{c}_")
        out += [edited(shared, r.sample(range(120), k), f"y{c}_{i}_") for i, k in enumerate([0, 1, 1, 2, 2, 3, 4])]
        deep = edited(shared, r.sample(range(120), 6), f"d{c}_")
        out += [edited(deep, r.sample(range(120), k), f"z{c}_{i}_") for i, k in enumerate([1, 1, 2, 2])]
    for c in range(2):  # parts of the text, which have nothing that it does not have
        part = base.split(" ")[20 * c : 20 * c + 80]
        out += [" ".join(part[k:]) for k in range(4)]
    rows = list(zip(r.sample(range(10_000), len(out)), out))
    want = components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert 10 < len(set(want.values())) < len(out) - 10
    for rounds in (0, 1, 3):
        got = {x["id"]: x["component"] for x in minhash.near_duplicates(df, rounds=rounds).collect()}
        assert got == want, rounds


def test_stage_drops_near_copies(spark, tmp_path):
    rows = docs()
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    want = {i for i, c in components(rows).items() if i == c}
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert simhash.keep_one(df).count() > len(want)


@pytest.mark.parametrize("rows", [[], [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)]])
def test_empty_table_and_repeated_rows(spark, rows):
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["id"], r["component"]) for r in got), key=str) == sorted([(i, 1 if t else None) for i, t in rows], key=str)
