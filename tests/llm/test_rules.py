import random

import pytest
from pyspark.sql import functions as F

from cellspan.llm import licenses, quality, urls


def counts(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    from collections import Counter

    twice = {x for x, n in Counter(s).items() if n > 1}
    covered = {j for i, x in enumerate(s) if x in twice for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_counts_match_brute_force(spark):
    r = random.Random(1)
    texts = [" ".join(r.choices("ab", k=r.randint(0, 12))) for _ in range(200)]
    texts += ["".join(r.choices("ab é\n\t\x0b#|<😀 ", k=60)) for _ in range(200)] + [None, "", " ", "x y z " * 30_000, "w" * 200_000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for row in quality.base_counts(df).collect():
        got = tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == counts(texts[row["doc_id"]]), texts[row["doc_id"]]


def rejected(text):
    """Brute force of the rules beyond the base."""
    import re

    n_words, chars, symbols, dup, _ = counts(text)
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters = sum(any(c.isalpha() for c in x) for x in w)
    broken = sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines)
    listed = sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•]", x)) for x in lines)
    return [
        10 * symbols > n_words, chars < 3 * n_words, chars > 10 * n_words, 10 * letters < 8 * n_words,
        10 * dup > 3 * len(lines), 10 * broken > 3 * len(lines), 10 * listed > 9 * len(lines),
    ]


def test_cascade_is_order_free(spark):
    good = " ".join(f"word{i}" for i in range(80))
    texts = [good, "too short", "a b c " * 60, "## " * 90, None, "", "same line\n" * 60, good + " é", good]
    texts += ["\n".join(f"- {good} {i}" for i in range(9)), "\n".join(f"{good} {i}..." for i in range(9)), good + " 12 34" * 60]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, t string")
    rules = quality.ALL_RULES
    ordered = quality.order_rules(df, rules)
    assert sorted(x.name for x in ordered) == sorted(x.name for x in rules)
    want = {0, 7, 8}
    assert {r["doc_id"] for r in quality.cascade(df).collect()} == want
    assert {r["doc_id"] for r in df.where(quality.verdict(list(reversed(ordered)))).collect()} == want
    assert quality.cascade(df.limit(0)).count() == 0


def test_rules_match_brute_force(spark):
    r = random.Random(3)
    parts = ["#", "aa", "bbb", "ccccccccccccccccc", "\n", "x y z", "12", "…\n", "- é", "\n* ", "words of a text "]
    texts = [" ".join(r.choices(r.sample(parts, r.randint(1, 5)), k=r.randint(0, 150))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    flags = [quality.over_text(x.reject, "text").alias(x.name) for x in quality.MORE_RULES]
    got = {x["doc_id"]: list(x)[1:] for x in df.select("doc_id", *flags).collect()}
    assert got == {i: rejected(t) for i, t in enumerate(texts)}
    assert all(any(v[k] for v in got.values()) for k in range(len(flags)))
    base = quality.base_counts(df).where(f"not {quality.BASE_FAILED}")
    assert {x["doc_id"] for x in base.collect()} == {x["doc_id"] for x in df.where(quality.verdict(list(quality.BASE_RULES))).collect()}


def test_rules_are_ranked_by_rejections_per_cost():
    rules = tuple(quality.Rule(x, "") for x in "abcd")
    verdicts = {(True, True, False, False): 50, (False, False, True, False): 10, (False,) * 4: 40}
    # b rejects what a does at a tenth of its cost; after it a has nothing left to reject.
    got = quality.rank_rules(rules, [1.0, 0.1, 0.5, 0.2], verdicts)
    assert [r.name for r in got] == ["b", "c", "d", "a"]


def test_costs_are_measured_over_texts(spark):
    df = spark.createDataFrame([(f"word{i} " * 3000,) for i in range(400)], "text string").repartition(8)
    dear = quality.Rule("dear", "size(array_distinct(transform(w, x -> sha2(concat(x, t), 256)))) > 9")
    cheap = quality.Rule("cheap", "t like 'word1%'")
    cost, verdicts = quality.rate_rules(df.limit(20), (dear, cheap))
    assert cost[0] > 3 * cost[1] and sum(verdicts.values()) == 20


def test_rejected_rows_go_through_no_later_rule(spark):
    df = spark.createDataFrame([("short",), ("word " * 60,)], "text string")
    boom = quality.Rule("boom", "if(size(w) < 50, raise_error('evaluated'), false)")
    first = quality.BASE_RULES[0]
    assert df.where(quality.verdict([first, boom])).count() == 1


def test_license_scan(spark):
    mit = licenses.KNOWN[0][1]
    texts = [
        mit,
        "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("license", "licence").replace(",", " ,\n"),
        "prose\nReleased  under the *MIT* licence\nmore\nLicensed under CC BY-NC 4.0.",
        None,
        "",
        "All rights reserved.",
        "prose " * 100_000,
        mit,
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {r["doc_id"]: r for r in licenses.scan(df, licenses.known_licenses(spark)).collect()}
    assert [got[i]["license"] for i in range(8)] == ["MIT", "MIT", None, None, None, None, None, "MIT"]
    assert got[2]["notices"] == ["CC-BY-NC-4.0", "MIT"] and got[3]["notices"] == [] and got[5]["notices"] == []
    assert got[3]["canonical_digest"] is None and got[4]["canonical_digest"] == got[5]["canonical_digest"]
    assert licenses.scan(df.limit(0), licenses.known_licenses(spark)).count() == 0


def test_license_files_with_titles(spark):
    texts = {}
    for n, t in licenses.KNOWN:
        texts.setdefault(n, t)
    files = [(n, f"{title}\n\nCopyright (c) 2020 Somebody\n\n{texts[n]}\n") for n, titles in licenses.TITLES.items() for title in titles]
    assert ("BSD-3-Clause" in texts) and len({n for n, _ in files}) == 6
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(files)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(df, licenses.known_licenses(spark)).collect()}
    assert got == {i: n for i, (n, _) in enumerate(files)}


def canonical(text):
    """The canonical form in plain Python."""
    import regex

    t = regex.sub(r"(?m)^[^\p{L}\p{N}\n]*(copyright\b[^\n]*(\d{4}|\(c\)|©)|\(c\)|©|all rights reserved)[^\n]*$", "", text.lower())
    for a, b in licenses.SPELLINGS:
        t = t.replace(a, b)
    return regex.sub(r"[^\p{L}\p{N}]+", " ", t).strip()


def test_digests_of_license_files(spark):
    """Whole license texts that this machine has are found by the join with the digest table, and only by it."""
    import hashlib
    import os

    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    here = {k: v for k, v in names.items() if os.path.exists(f"{folder}/{k}")}
    if not here:
        pytest.skip("no license texts on this machine")
    texts = {v: open(f"{folder}/{k}", encoding="utf-8").read() for k, v in here.items()}
    for v, t in texts.items():
        assert (v, hashlib.sha256(canonical(t).encode()).hexdigest()) in licenses.DIGESTS
    rows = [(i, v, t.upper().replace("LICENSE", "LICENCE").replace(",", " , ")) for i, (v, t) in enumerate(texts.items())]
    df = spark.createDataFrame([(i, t) for i, _, t in rows] + [(99, rows[0][2] + " one more word")], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(df, licenses.known_licenses(spark)).collect()}
    assert got == {i: v for i, v, _ in rows} | {99: None}
    none = {r["license"] for r in licenses.scan(df, licenses.known_licenses(spark, digests=())).collect()}
    assert none == {None}


def test_licenses_of_one_text_and_too_many(spark):
    known = licenses.known_licenses(spark, (("B", "Same Text."), ("A", "same, text"), ("C", "other")), ())
    assert sorted((r["license"], len(r["digest"])) for r in known.collect()) == [("A", 64), ("C", 64)]
    many = spark.range(licenses.MAX_KNOWN + 1).select(F.col("id").cast("string").alias("license"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), many)


PAGES = "page_id long, url string, host int"


def test_stated_rules(spark):
    cases = {
        "http://a.COM/x": ("a.com", "/x", "com/", "allow"),
        "https://example.com/en/1?q#f": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://b.example.com/en/": ("b.example.com", "/en/", "example.com/en/", "block"),
        "https://www.example.com/en/?": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "x://a.net/fr/": ("a.net", "/fr/", "net/fr/", "block"),
        "x://a.net/frx": ("a.net", "/frx", None, "allow"),
        "http://com?x=/y": ("com", "", None, "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "no host": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://É.com": ("É.com", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(cases)], PAGES)
    none = urls.mine(df.select("url", F.lit(False).alias("bad")))
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, none).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert urls.judge(df.limit(0), none).count() == 0


def test_mined_rules_block(spark):
    rows = [(i, f"http://a.org/{'ads' if i % 2 else 'news'}/{i}", 1) for i in range(400)] + [(7, "http://a.org/ads/9", 1)]
    df = spark.createDataFrame(rows, PAGES)
    rules = urls.mine(df.select("url", F.col("url").contains("/ads/").alias("bad")), min_support=0.05)
    assert [r["tokens"] for r in rules.collect()] == [["path:ads"]]
    got = urls.judge(df, rules)
    assert got.count() == 401
    assert all((r["verdict"] == "block") == r["path"].startswith("/ads/") for r in got.collect())


def brute_rules(sets, bad, least, confidence, lift):
    """All token sets by enumeration: those under a bound and those with a proper subset as sure are left out."""
    from itertools import combinations

    found = {}
    for size in range(1, max(map(len, sets)) + 1):
        for t in {c for s in sets for c in combinations(sorted(s), size)}:
            have = [b for s, b in zip(sets, bad) if set(t) <= s]
            if sum(have) >= least and sum(have) >= confidence * len(have) and sum(have) / len(have) >= lift * sum(bad) / len(bad):
                found[t] = sum(have) / len(have)
    return {t for t, c in found.items() if not any(set(o) < set(t) and k >= c for o, k in found.items())}


def test_mining_and_matching_match_brute_force(spark):
    r = random.Random(9)
    rows, bad = [], []
    for i in range(900):
        host, path, query = r.choice(["a.org", "b.org", "ads.c.org"]), r.choice(["news", "win", "shop"]), r.choice(["", "?ref=1", "?id=2"])
        rows.append((i, f"http://{host}/{path}/{i}{query}", 1))
        sure = host == "ads.c.org" or (path == "win" and query == "?ref=1")
        bad.append(r.random() < (0.95 if sure else 0.1))
    df = spark.createDataFrame([(*x, b) for x, b in zip(rows, bad)], PAGES + ", bad boolean")
    sets = [set(x["t"]) for x in df.orderBy("page_id").select(urls.tokens("url").alias("t")).collect()]
    want = brute_rules(sets, bad, 20, 0.8, 1.5)
    rules = urls.mine(df, min_support=0.002)
    assert {tuple(x["tokens"]) for x in rules.collect()} == want and 2 <= len(want)
    blocked = {i for i, s in enumerate(sets) if any(set(t) <= s for t in want)}
    assert {x["id"] for x in urls.judge(df, rules).where("verdict = 'block'").collect()} == blocked and blocked


def test_single_urls_are_not_learnt_by_heart(spark):
    df = spark.createDataFrame([(i, f"http://a.org/{i}?k{i}=1", 1) for i in range(100)], PAGES)
    labelled = df.select("url", (F.col("page_id") % 10 == 0).alias("bad"))
    assert urls.mine(labelled, min_support=0.0).count() == 0
    mostly = df.select("url", (F.col("page_id") % 10 != 0).alias("bad"))  # confident only because most are bad
    assert urls.mine(mostly).count() == 0
    assert urls.mine(labelled.limit(0)).count() == 0 and urls.mine(labelled.select("url", F.lit(None).cast("boolean").alias("bad"))).count() == 0
