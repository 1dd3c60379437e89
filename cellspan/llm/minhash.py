"""Near-duplicates by the exact Jaccard similarity of word shingles, with MinHash bands as candidates."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, cut, gathered, maybe_broadcast, settled, small_batches

#: Words of a shingle, and the similarity from which two texts are near-duplicates.
WORDS, SIMILARITY = 5, 0.8

#: MinHash bands and the rows of each: a pair of similarity s shares no band with probability (1 - s ** ROWS) ** BANDS.
BANDS, ROWS = 30, 5

#: Rounds in which groups are compared with one head and grouped again, before they are compared with more and more heads.
ROUNDS = 1

#: Heads of a group in the first round after these; their number doubles from round to round.
HEADS = 8

#: Sets of the heads of a comparison are broadcast up to so many heads and so many hashes.
HEAD_SETS, HEAD_HASHES = 5_000, 2_000_000

#: Bytes of the batches of texts that a worker is given.
BATCH = 8 << 20


def _shingle_hashes(text, words):
    """Distinct XXH64 of the word shingles of a text in bytes, ascending; a shorter text is one shingle, no words none."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = text.lower().split()  # bytes: A-Z and the six ASCII separators only
    if len(w) < words:
        return np.array([digest(b" ".join(w), 42)] if w else [], dtype="<u8")
    joined, ends, at = b" ".join(w), [], -1
    for x in w:
        at += len(x) + 1
        ends.append(at)
    starts = [0, *[x + 1 for x in ends[:-words]]]
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :])), dtype="<u8", count=len(starts)))


def _node(hashes):
    """One number for a set of shingles."""
    import numpy as np
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 42)).view(np.int64))


def _signature_batches(words, bands, rows):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        k = bands * rows
        seeds = np.array([[xxhash.xxh64_intdigest(b"%d" % i, s) for i in range(k)] for s in (1, 2)], dtype=np.uint64)
        flip, odd = seeds[0][:, None], (seeds[1] | np.uint64(1))[:, None]

        def keys(h):
            least = np.full(k, ~np.uint64(0))
            for at in range(0, h.size, 2048):
                # The high half is well mixed by the product; it is folded down and multiplied once more.
                x = (h[None, at : at + 2048] ^ flip) * odd
                x ^= x >> np.uint64(32)
                x *= odd
                np.minimum(least, x.min(axis=1), out=least)
            return [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(bands, rows))]

        for b in batches:
            nodes, counts, out = [], [], []
            for t in b.column(1).cast(pa.binary()):
                h = _shingle_hashes(t.as_py() or b"", words)
                nodes.append(_node(h))
                counts.append(h.size)
                out.append(np.array(keys(h) if h.size else [], dtype=np.uint64).view(np.int64))
            arrays = [b.column(0), pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), pa.array(out, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "node", "n", "keys"])

    return run


def _set_batches(words):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            texts = b.column(0).cast(pa.binary())
            for at in range(0, len(texts), 64):
                sets = [_shingle_hashes(t.as_py() or b"", words) for t in texts[at : at + 64]]
                arrays = [pa.array([_node(h) for h in sets], pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["node", "hashes"])

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``(id, node long, component)`` for every row: documents that link share the smallest id reachable.

    Two texts link if the Jaccard similarity of their shingle sets, counted exactly, is ``similarity`` or more. Texts of one
    set are one node. Candidates are found in rounds. The first groups are the MinHash bands; no group is expanded into its
    pairs: its most central member, the head, is compared with all others, first each member with the most central of its
    heads, then with others that it is not connected to yet. If x does not link to a text b, and x and y have no difference
    from b in common (a shingle of b that both lack, or one outside of b that both have), then the intersection of x and y
    is no larger than that of x and b, and their union no smaller, so they do not link either. So the next groups are
    those members of unconnected groups that share differences from a central text, as many as a link needs. After
    ``rounds`` such rounds, what groups are still unconnected are compared with their next 8, 16, 32 ... members, until each
    is connected or all its pairs have been compared: no candidate is left out. A round compares each member with the heads
    of its groups only. Empty table: no rows. Repeated rows stay.
    """
    kind, ratio = docs.schema[id_col].dataType.simpleString(), Fraction(similarity).limit_denominator(1000)
    small_batches(docs.sparkSession, BATCH)
    signed = cut(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
            _signature_batches(words, bands, rows), f"id {kind}, node long, n long, keys array<long>"
        )
    )
    nodes = signed.groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    banded = nodes.select("node", "n", F.explode("keys").alias("g"))
    members, n_members = settled(_with_degree(banded))
    near_size = f"{ratio.denominator} * least(n, head_n) >= {ratio.numerator} * greatest(n, head_n)"
    sets, comps, more = None, None, None  # more: links that are not in comps yet
    if n_members:  # later groups are parts of the first ones
        wanted = members.select("node").distinct()
        every = docs.select(F.col(text_col).alias("t")).mapInArrow(_set_batches(words), "node long, hashes array<long>")
        sets = cut(every.join(maybe_broadcast(wanted, 200_000), "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")))
    for _ in range(rounds):
        if not n_members:
            break
        heads = members.groupBy("g").agg(F.max(F.struct("degree", "node", "n")).alias("head")).select(
            "g", F.col("head.node").alias("head"), F.col("head.n").alias("head_n"), F.col("head.degree").alias("head_degree")
        )
        led, n_led = settled(members.join(heads, "g").where("node <> head").select("g", "node", "n", "degree", "head", "head_n", "head_degree"), n_members)
        pairs, _n = settled(led.where(near_size).select("head", "head_degree", "node").distinct(), n_led)
        best, _n = settled(pairs.groupBy("node").agg(F.max(F.struct("head_degree", "head"))["head"].alias("head")), _n)
        links = _verified(best, _n, sets, similarity)
        comps = _joined(comps, links if more is None else links.union(more))
        rest, _n = settled(_apart(pairs.select("head", "node").join(best, ["head", "node"], "left_anti"), comps), n_led)
        more = _verified(rest, _n, sets, similarity)
        grown, near = _differences(_referred(led, best), n_led, sets, comps, similarity)
        more, _n = settled(more.union(near))
        members, n_members = settled(_regrouped(grown))
    if n_members:
        comps = _compared(members, n_members, sets, comps, more, similarity, near_size)
    elif more is not None:
        comps = _joined(comps, more)
    rooted = nodes.select("node", "least", F.col("node").alias("root"))
    if comps is not None:
        rooted = nodes.join(comps, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return signed.select("id", "node").join(rooted.join(named, "root").select("node", "component"), "node").select("id", "node", "component")


def _compared(members, n_members: int, sets, comps, more, similarity: float, near_size: str) -> DataFrame:
    """Components when the pairs of the groups of ``members`` have been compared, but for those already connected.

    Members of a group are ranked; a round takes the next ranks as heads, twice as many as the round before, and compares
    them with all members after them in groups that are not in one component yet. So the rounds are few, and no pair of a
    group is compared twice.
    """
    ranked = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("degree"), "node"))
    groups, n_groups = settled(members.withColumn("rank", ranked).select("g", "node", "n", "rank"), n_members)
    first, heads = 1, HEADS
    while True:
        if more is not None:
            comps = _joined(comps, more)
        placed = groups.withColumn("comp", F.col("node"))
        if comps is not None:
            placed = groups.join(comps, "node", "left").select("g", "node", "n", "rank", F.coalesce("component", "node").alias("comp"))
        per = placed.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("rank").alias("last"))
        left, n_groups = settled(placed.join(per.where(f"lo <> hi and last > {first}").select("g"), "g"), n_groups)
        if not n_groups:
            return comps
        head = left.where(f"rank >= {first} and rank < {first + heads}").select(
            "g", F.col("node").alias("head"), F.col("n").alias("head_n"), F.col("rank").alias("head_rank"), F.col("comp").alias("head_comp")
        )
        met = left.join(head, "g").where("head_rank < rank and comp <> head_comp").where(near_size).select("head", "node").distinct()
        pairs, n_pairs = settled(met)
        more, _n = settled(_verified(pairs, n_pairs, sets, similarity), n_pairs)
        groups = left.select("g", "node", "n", "rank")
        first, heads = first + heads, 2 * heads


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of ``comps (node, component)`` and further links."""
    known = None if comps is None else comps.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return settled(connected_components(links if known is None else known.union(links)))[0]


def _with_degree(grouped: DataFrame) -> DataFrame:
    """``(g, node, n, degree)`` of the groups ``(g, node, n)`` with several members; ``degree``: fellow members in all groups."""
    counts = grouped.groupBy("g").agg(F.count("*").alias("c")).where("c > 1")
    shared = grouped.join(counts, "g")
    degree = shared.groupBy("node").agg(F.sum("c").alias("degree"))
    return shared.join(degree, "node").select("g", "node", "n", "degree")


def _verified(pairs: DataFrame, n_pairs: int, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of ``(head, node)`` whose sets are similar enough."""
    both = _with_sets(pairs, n_pairs, sets).withColumn("both", F.expr("size(array_intersect(x, y))"))
    ratio = Fraction(similarity).limit_denominator(1000)
    linked = both.where(f"{ratio.denominator} * both >= {ratio.numerator} * (size(x) + size(y) - both)")
    return linked.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b"))


def _with_sets(pairs: DataFrame, n_pairs: int, sets: DataFrame, head: str = "head") -> DataFrame:
    """``pairs`` with the sets ``x`` of ``head`` and ``y`` of ``node``.

    Few pairs go to the sets, and the sets of few heads to the pairs; else the sets are shuffled. Heads can be hot, so
    their side is one that AQE can split.
    """
    few = F.broadcast(pairs) if n_pairs <= 100_000 else pairs
    nodes = sets.select("node", F.col("hashes").alias("y")).join(few, "node")
    names = pairs.select(F.col(head).alias("node")).distinct()
    left = sets.join(maybe_broadcast(names, 200_000), "node", "left_semi").select(F.col("node").alias(head), F.col("hashes").alias("x"))
    n, size = left.agg(F.count("*"), F.coalesce(F.sum(F.size("x")), F.lit(0))).first()
    return nodes.join(F.broadcast(left) if n <= HEAD_SETS and size <= HEAD_HASHES else left, head)


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs ``(head, node)`` whose ends are not in one component."""
    of = lambda name: comps.select(F.col("node").alias(name), F.col("component").alias(f"{name}_comp"))
    both = pairs.join(of("head"), "head", "left").join(of("node"), "node", "left")
    return both.where(F.coalesce("head_comp", "head") != F.coalesce("node_comp", "node")).select("head", "node")


def _referred(led: DataFrame, best: DataFrame) -> DataFrame:
    """``led`` with ``ref``: the best head of the best head of a group's head, where it has them."""
    up = best.select(F.col("node").alias("_a"), F.col("head").alias("_b"))
    above = up.select(F.col("_a").alias("_b"), F.col("_b").alias("_c"))
    up = up.join(above, "_b", "left").select("_a", F.coalesce("_c", "_b").alias("_b"))
    return led.join(up, F.col("head") == F.col("_a"), "left").withColumn("ref", F.coalesce("_b", "head")).drop("_a", "_b")


def _differences(led: DataFrame, n_led: int, sets: DataFrame, comps: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``(rows, links)``: for members of groups that are not in one component yet, how they differ from a reference.

    Let a member x lack ``missed`` of the n shingles of the reference and have ``added`` others: its differences, of weight
    S = missed + t * added (t: the similarity). x links to the reference if S <= (1 - t) * n, else it is far from it. With m
    differences in common, x and y link if (1 + t) * m >= S(x) + S(y) - (1 - t) * n. Members that link to the reference are
    in one component (these are ``links``), so only pairs with a far member matter: if x is far, then m > S(y) / (1 + t),
    and m >= S(x) - (1 - t) * n because S(y) is t * m at least. In any one order of differences, two members that share as
    many as each of them needs have one in common among the first ``differences - need + 1`` of each: ``short`` by the first
    bound, ``long`` by the second.
    """
    ratio = Fraction(similarity).limit_denominator(1000)
    p, q = ratio.numerator, ratio.denominator
    placed = led.join(comps, "node", "left").select("g", "node", "n", "degree", "ref", F.coalesce("component", "node").alias("comp"))
    per = placed.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    apart = placed.join(per.select("g"), "g").where("node <> ref").select("ref", "node", "n", "degree", "comp").distinct()
    pairs, n_pairs = settled(apart, n_led)
    both = _with_sets(pairs, n_pairs, sets, "ref")
    both = both.withColumns({"added": F.array_except("y", "x"), "missed": F.array_except("x", "y"), "ref_n": F.size("x")}).drop("x", "y")
    weighed = both.withColumn("weight", F.lit(q) * F.size("missed") + F.lit(p) * F.size("added")).select(
        "ref", "node", "n", "degree", "comp",
        F.concat("added", "missed").alias("differ"),
        F.expr(f"weight > {q - p} * ref_n").alias("far"),
        F.expr(f"size(added) + size(missed) - weight div {p + q}").alias("short"),
        F.expr(f"size(added) + size(missed) - greatest(0L, (weight - {q - p} * ref_n - 1) div {q})").alias("long"),
    )
    rows = gathered(cut(gathered(weighed, 8 * n_pairs)), 8 * n_pairs)
    return rows, rows.where("not far").select(F.least("ref", "node").alias("a"), F.greatest("ref", "node").alias("b"))


def _regrouped(rows: DataFrame) -> DataFrame:
    """Groups ``(g, node, n, degree)`` of members of one reference that may link and are not in one component yet.

    The order of differences is by rarity among the members; those of only one member come first and are of no use. Far
    members are grouped among themselves (kind 0), and with those that link to the reference (kind 1).
    """
    wanted = rows.groupBy("ref").agg(F.bool_or("far").alias("any"), F.count("*").alias("c")).where("any and c > 1").select("ref")
    grown = rows.join(wanted, "ref").select(
        "ref", "node", "n", "degree", "comp", "far", "short", "long", F.size("differ").alias("size"), F.explode("differ").alias("s")
    )
    shared = grown.groupBy("ref", "s").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("c > 1")
    of_pair = Window.partitionBy("ref", "node")
    shared, _n = settled(shared)
    first = grown.join(shared.hint("merge"), ["ref", "s"]).withColumns(
        {"at": F.row_number().over(of_pair.orderBy("c", "s")), "alone": F.col("size") - F.count("*").over(of_pair)}
    )
    kinds = F.array_compact(
        F.array(
            F.when(F.col("far") & (F.col("at") + F.col("alone") <= F.col("short")), F.lit(0)),
            F.when(F.col("at") + F.col("alone") <= F.when(F.col("far"), F.col("long")).otherwise(F.col("short")), F.lit(1)),
        )
    )
    first = first.where("lo <> hi").withColumn("kind", F.explode(kinds)).withColumn("g", F.xxhash64("ref", "s", "kind"))
    first, _n = settled(first.select("g", "kind", "node", "n", "degree", "comp", "far"))
    apart = first.groupBy("g", "kind").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_and("far").alias("all_far"))
    return first.join(apart.where("lo <> hi and (kind = 0 or not all_far)").select("g"), "g").select("g", "node", "n", "degree")
