import hashlib
import random
import re

import pytest

from cellspan.llm import decontaminate, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))


def judged(docs, items, window=10):
    """Brute force: every window of every item against every place of every document."""
    sought = []
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        sought += [(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1)] if w else []
    out = []
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for i, x in sought:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    if i is not None:
                        named.add(str(i))
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def corpus(seed, letters=12):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(letters)] + ["É", "ß1"]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    items = [(i, text(r.randint(8, 40))) for i in range(25)]
    shared = text(14)
    items += [(100 + i, f"{text(3)} {shared} {text(3)}") for i in range(6)]
    items += [(200, "one"), (201, "two words"), (202, "w1 w2 w3"), (203, "Z z Z z Z z Z z Z z Z z Z z"), (204, None), (205, " ,. "), (None, text(20)), (5, text(15))]
    docs = []
    for i in range(60):
        t = [text(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            w = words(r.choice(items)[1])
            a = r.randint(0, max(0, len(w) - 10))
            t += [", ".join(w[a : a + r.choice((9, 10, 11, 30))]).upper(), text(r.randint(0, 5))]
        docs.append((i, " ".join(t)))
    docs += [(60, None), (61, ""), (62, "z " * 3000), (63, "a one b"), (64, "two-words"), (None, docs[3][1]), (7, docs[4][1]), (7, docs[4][1]), (8, items[0][1])]
    return docs, items


def run(spark, tmp_path, docs, items):
    df = spark.createDataFrame([(d, t, "en", "s", 0, "clash", 1) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long, w string, h long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, start int").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = queries.QUERIES["op13_decontaminate"](spark, str(tmp_path))
    return sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


@pytest.mark.parametrize("seed, letters", [(1, 12), (2, 3), (3, 400)])
def test_matches_brute_force(spark, tmp_path, seed, letters):
    docs, items = corpus(seed, letters)
    assert run(spark, tmp_path, docs, items) == judged(docs, items)


def test_too_many_passages_for_a_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_PASSAGES", 2)
    docs, items = corpus(4)
    assert run(spark, tmp_path, docs, items) == judged(docs, items)


def test_empty_tables(spark, tmp_path):
    docs, items = corpus(5)
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    assert run(spark, tmp_path / "a", docs, []) == judged(docs, [])
    assert run(spark, tmp_path / "b", [], items) == []


def test_spans_and_items(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k y a b c d e f g h i j")], "doc_id long, text string")
    items = spark.createDataFrame([("p", "A b c d e f g h i j k l"), ("q", "nothing of it")], "item_id string, text string")
    r = decontaminate.contaminated_words(docs, items).first()
    assert [tuple(s) for s in r["spans"]] == [(1, 12), (13, 23)]
    assert (r["n_hit"], r["item_ids"]) == (21, ["p"])


def test_main_path_has_no_python(spark):
    docs, items = (spark.createDataFrame(x, f"{n} long, text string") for x, n in zip(corpus(6), ("doc_id", "item_id")))
    plan = decontaminate.contaminated_words(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
