import random
import re
import zlib

import numpy as np
import pytest

from cellspan.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dictionary(docs):
    n = {}
    for d, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            if h % 31 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= 7:
                n[r] = n.get(r, 0) + 1
    return {w: c for w, c in n.items() if c >= 2}


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(n, ratio=10):
    out, form = {}, {}
    for w in n:
        best = sorted((-n[x], x) for x in n if near(w, x))
        f = best[0][1] if best and -best[0][0] >= ratio * n[w] else None
        out[w] = (n[w], len(best), f, n[f] if f else None)
        form[w] = f
    def root(w):
        return root(form[w]) if form[w] else w
    return sorted((w, f, root(w), c, k, fn) for w, (c, k, f, fn) in out.items())


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def dense(seed, size, letters="abÀ", lengths=(7, 12)):
    """Words over few letters, so that most have near ones; some share long heads or tails."""
    r = random.Random(seed)
    make = lambda k: "".join(r.choice(letters) for _ in range(k))
    out = {make(r.randint(*lengths)) for _ in range(size)}
    out |= {"prefixed" + make(r.randint(0, 6)) for _ in range(size)} | {make(r.randint(0, 6)) + "suffixed" for _ in range(size)}
    out |= {"head" + make(r.randint(1, 5)) + "tail" for _ in range(size)} | {"a" * k for k in range(7, 30)}
    return {w: r.choice((2, 2, 3, 5, 20, 60, 700, 9000)) for w in out}


@pytest.mark.parametrize("group", [16_384, 6])
def test_variants_match_brute_force(spark, group):
    n = dense(1, 150)
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    assert got(spelling.group_variants(df, group=group)) == variants(n)


def test_chunks_of_few_rows_lose_nothing(spark, monkeypatch):
    n = dense(2, 80)
    run = spelling._near_batches(8, 1 << 22)
    monkeypatch.setattr(spelling, "_near_batches", lambda rows, cells: run)
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(spelling.group_variants(df)) == variants(n)


def test_query_over_texts(spark, tmp_path):
    r = random.Random(5)
    words = [w.upper() if r.random() < 0.2 else w for w in dense(3, 40)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(1, 400)))) for i in range(40)]
    docs += [(7, docs[0][1]), (None, docs[1][1]), (50, None), (51, ""), (52, "x" * 50_000 + " " + "x" * 50_000), (53, "123 ... 7-7 ab")]
    docs += [(60 + i, "Straße ÀÉÎÕÜàé naïveté-naïveté") for i in range(40)]
    rows = [(d, t, "en", "s", 0, "clash", 1) for d, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, word string, n long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert got(queries.QUERIES["op11_spelling_variants"](spark, str(tmp_path))) == variants(dictionary(docs))


def test_empty_table_and_lone_word(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert got(spelling.group_variants(none)) == []
    one = spark.createDataFrame([("solitary", 3)], "word string, n long")
    assert got(spelling.group_variants(one)) == [("solitary", None, "solitary", 3, 0, None)]


def test_roots_follow_chains_of_forms(spark):
    n = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20_000, "aabbbbb": 200_000}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert {r[0]: r[2] for r in got(spelling.group_variants(df))} == dict.fromkeys(n, "aabbbbb")


def test_wavelet_tree_reports_rectangles():
    r = np.random.default_rng(4)
    for size in (1, 2, 3, 64, 100):
        values = r.permutation(size)
        tree = spelling.WaveletTree(values)
        x, y = np.sort(r.integers(0, size + 1, (2, 50)), axis=0), np.sort(r.integers(0, size + 1, (2, 50)), axis=0)
        q, v = tree.report(x[0], x[1], y[0], y[1])
        expected = {(i, int(values[at])) for i in range(50) for at in range(x[0][i], x[1][i]) if y[0][i] <= values[at] < y[1][i]}
        assert sorted(zip(q.tolist(), v.tolist())) == sorted(expected)
