from cellspan.llm import boilerplate, passages

SCHEMA = "doc_id long, text string, source string, line string, n_lines long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", -1) for i, t, s in rows], SCHEMA)


def brute_boilerplate(rows, ratio, least):
    pages, have = {}, {}
    for _, t, s in rows:
        pages[s] = pages.get(s, 0) + 1
        for x in {x.strip(" \t\r\f\v") for x in (t or "").split("\n")} - {""}:
            have[s, x] = have.get((s, x), 0) + 1
    bad = {k for k, n in have.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if (s, x.strip(" \t\r\f\v")) not in bad]
        out.append((i, "\n".join(kept), sum(bool(x.strip(" \t\r\f\v")) for x in lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_boilerplate_matches_brute_force(spark):
    rows = [(i, f"Menu\nline {i}\n\n  Menu \nfoot {i % 4}", "hot" if i % 3 else "b") for i in range(60)]
    rows += [(100, None, "hot"), (101, "", None), (102, "Menu", None), (103, "Menu\n" * 20_000, "b"), (104, "Menu", "lone")]
    rows += [(105, "x y", "b")] * 3
    got = boilerplate.drop_boilerplate(frame(spark, rows), max_ratio=0.3, min_pages=5)
    assert got.columns[:4] == ["doc_id", "text", "source", "line"]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str) == brute_boilerplate(rows, 0.3, 5)
    assert boilerplate.drop_boilerplate(frame(spark, [])).count() == 0


def brute_repeats(rows, least):
    import re

    seen, out = {}, set()
    for i, t in sorted({r[:2] for r in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        pieces = [(m.start(), m.end(), m[0].lower().encode().split()) for m in re.finditer(passages.PIECE, t or "")]
        pieces = [p for p in pieces if p[2]]
        for k, (start, _, _) in enumerate(pieces):
            w = []
            for _, end, more in pieces[k:]:
                w += more
                if len(w) >= least:
                    first = seen.setdefault(tuple(w), (i, start))
                    if first != (i, start):
                        out.add((i, start, end, *first))
                    break
    return out


def brute_passages(rows, least, run):
    """Runs of repeated units of ``run`` words at least, by (id, start, end, words)."""
    import re

    out = set()
    again = brute_repeats(rows, least)
    for i, t in {r[:2] for r in rows}:
        spans = sorted((s, e) for d, s, e, *_ in again if d == i)
        words = lambda a, b: len(t[a:b].encode().split())
        k = 0
        while k < len(spans):
            start, end = spans[k]
            while k + 1 < len(spans) and (spans[k + 1][0] <= end or not words(end, spans[k + 1][0])):
                k += 1
                end = max(end, spans[k][1])
            k += 1
            if words(start, end) >= run:
                out.add((i, start, end, words(start, end)))
    return out


def test_units_match_brute_force(spark):
    p = "One two three four five six seven eight nine. Next comes a sentence that has ten words in it."
    rows = [(5, f"intro words here {p} tail", "s"), (3, f"Other start\n{p.upper()}", "s"), (9, f"{p} {p}", "s")]
    rows += [(None, p, "s"), (7, None, "s"), (8, "", "s"), (10, "é ü " * 40_000, None), (11, "short one. short one.", "s")]
    df = frame(spark, rows)
    got = passages.repeated_units(df)
    assert {(r["id"], r["start"], r["end"], r["kept_id"], r["kept_start"]) for r in got.collect()} == brute_repeats(rows, 8)
    for run in (10, 18, 19):
        found = passages.repeated_passages(df, run)
        assert {(r["id"], r["start"], r["end"], r["n_words"]) for r in found.collect()} == brute_passages(rows, 8, run)
    left = {r["doc_id"]: r["text"] for r in passages.remove_spans(df, passages.repeated_passages(df, 10)).collect()}
    assert left[3] == rows[1][1] and left[5].startswith("intro words here") and left[5].endswith("tail") and "Next" not in left[5]
    assert left[9].strip() == "" and left[7] is None and left[11] == rows[-1][1]


def test_passages_match_brute_force_on_random_texts(spark):
    import random

    r = random.Random(3)
    stock = [" ".join(r.choices("abcdefghijklmnop", k=r.randint(3, 14))) + r.choice([". ", "! ", "\n", "。 "]) for _ in range(40)]
    planted = "".join(r.sample(stock, 6))
    rows = [(i, "".join(r.choices(stock, k=r.randint(1, 9))) + (planted if i % 3 else "") + f"own words of {i} and nothing else. ", "s") for i in range(60)]
    got = passages.repeated_passages(frame(spark, rows))
    want = brute_passages(rows, 8, passages.MIN_RUN)
    assert {(x["id"], x["start"], x["end"], x["n_words"]) for x in got.collect()} == want and len(want) > 30


def test_stock_sentences_alone_stay(spark):
    stock = "This stock sentence has ten words and is found everywhere."
    long = "Here begins a passage that many documents share with each other. It goes on for some more words than a stock sentence does. And then it comes to its end with a third sentence."
    rows = [(i, f"Document number {i} has words of its own here {i}. {stock} More of its own {i} {i} {i} {i} {i}.", "s") for i in range(9)]
    rows += [(20, long, "s"), (21, f"Before it. {long} After it.", "s")]
    spans = passages.repeated_passages(frame(spark, rows)).collect()
    assert [(r["id"], r["kept_id"], r["kept_start"]) for r in spans] == [(21, 20, 0)]


def test_short_sentences_are_taken_together(spark):
    p = "A bb cc. Dd ee. Ff gg hh ii. Jj kk. Ll mm nn oo. Pp."
    rows = [(1, f"Start of one. {p} End here.", "s"), (2, f"Another begins {p} and goes on for a while.", "s"), (3, "A bb cc. Dd ee.", "s")]
    got = passages.repeated_units(frame(spark, rows))
    found = {(r["id"], r["start"], r["end"], r["kept_id"], r["kept_start"]) for r in got.collect()}
    assert found == brute_repeats(rows, 8) and {x[0] for x in found} == {2}
    spans = passages.repeated_passages(frame(spark, rows), 10)
    text = {r["doc_id"]: r["text"] for r in passages.remove_spans(frame(spark, rows), spans).collect()}
    assert "Ff gg" not in text[2] and text[1] == rows[0][1]
    assert passages.repeated_passages(frame(spark, [])).count() == 0


def test_spans_are_offsets_of_the_original(spark):
    t = "ß🙂 keep. " + "A b c d e f g h i. " * 5 + "End\n"
    df = spark.createDataFrame([(1, t, "clash"), (2, t, "clash")], "doc_id long, text string, removed string")
    for r in passages.remove_spans(df, passages.repeated_passages(df)).collect():
        want, last = "", 0
        for s in r["removed"]:
            want, last = want + t[last : s["start"]], max(last, s["end"])
        assert r["text"] == want + t[last:] and r["removed"] and r["removed"][0]["kept_id"] == 1


def test_repeated_rows_and_ids(spark):
    t = "one two three four five six seven eight nine " * 4
    assert passages.repeated_units(frame(spark, [(1, t, "s")] * 3)).count() == 0
    rows = [(1, t, "s"), (1, "another text of the same id", "s"), (None, t, "s"), (None, "words without an id", "s")]
    df = frame(spark, rows)
    left = passages.remove_spans(df, passages.repeated_passages(df)).collect()
    assert sorted((r["doc_id"] is None, r["text"]) for r in left) == sorted(
        [(False, t), (False, "another text of the same id"), (True, ""), (True, "words without an id")]
    )
