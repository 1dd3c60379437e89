import random

from cellspan.llm import fixity

SCHEMA = "page_id long, url string, html string, digest string"


def frame(spark, rows):
    return fixity.warc_records(spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], SCHEMA))


def run(spark, a, b):
    return sorted(((r["id"], r["kind"]) for r in fixity.audit(frame(spark, a), frame(spark, b)).collect()), key=str)


def test_locates_what_differs(spark):
    r = random.Random(1)
    a = [(i, f"http://h/{i}", "x" * r.randint(0, 50)) for i in r.sample(range(-5000, 100_000), 3000)]
    a += [(None, None, "n"), (7_000_000, "u", None)]
    b = list(a)
    gone, changed = r.sample(range(2900), 5), r.sample(range(2900, 3000), 5)
    for i in changed:
        b[i] = (*b[i][:2], b[i][2] + "!")
    b = [x for i, x in enumerate(b) if i not in gone] + [(200_000, "new", "y")]
    want = [(a[i][0], "missing") for i in gone] + [(a[i][0], "changed") for i in changed] + [(200_000, "extra")]
    assert run(spark, a, b) == sorted(want, key=str)


def test_equal_empty_and_repeated(spark):
    a = [(i % 5, "u", "h") for i in range(50)] + [(None, None, None)] * 3
    assert run(spark, a, list(reversed(a))) == []
    assert run(spark, [], []) == []
    assert run(spark, a, a[:-1]) == [(None, "changed")]
    assert run(spark, a, a + a[:1]) == [(0, "changed")]
    assert run(spark, [], [(3, "u", "h")]) == [(3, "extra")]
    assert run(spark, [(3, "u", "h" * 1_000_000)], []) == [(3, "missing")]


def test_offsets_are_places_in_the_file(spark):
    a = [(i, f"http://h/{i}", "x" * (i % 7)) for i in range(1, 200)]
    b = [x for x in a if x[0] not in (90, 150)]
    df = frame(spark, a)
    sizes = {r["id"]: len(r["record"]) for r in df.collect()}
    for r in fixity.audit(df, frame(spark, b)).collect():
        assert r["offset"] == sum(n for i, n in sizes.items() if i < r["id"]) and r["length"] == sizes[r["id"]]


def test_ids_over_the_whole_range(spark):
    a = [(i, "u", "h") for i in (-(1 << 63), -5, 0, 7, (1 << 63) - 1)] + [(None, "u", "h")]
    assert run(spark, a, a) == []
    assert run(spark, a, a[1:-1]) == sorted([(-(1 << 63), "missing"), (None, "missing")], key=str)
    assert run(spark, a[:2], a) == sorted([(i, "extra") for i, *_ in a[2:]], key=str)
