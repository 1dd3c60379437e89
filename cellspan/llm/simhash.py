"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, maybe_broadcast

#: Groups of distinct fingerprints under one variant that are larger are keyed once more by the other segment.
HOT_VARIANT = 256


def _fingerprint_batches(batches):
    from itertools import islice

    import numpy as np
    import pyarrow as pa
    import xxhash

    digest = xxhash.xxh64_intdigest

    def hashes(text):
        w = text.lower().split()  # bytes: A-Z and the six ASCII separators only
        if len(w) < 3:
            return [digest(b" ".join(w), 42)] if w else []
        joined, ends, at = b" ".join(w), [], -1
        for x in w:
            at += len(x) + 1
            ends.append(at)
        starts = [0, *[x + 1 for x in ends[:-3]]]
        return (digest(joined[a:b], 42) for a, b in zip(starts, ends[2:]))

    def fingerprint(text):
        total, n, source = np.zeros(64, np.int64), 0, iter(hashes(text))
        while True:
            h = np.fromiter(islice(source, 1 << 15), dtype="<u8")
            if not h.size:
                break
            n += h.size
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.sum(axis=0, dtype=np.int64)
            if h.size < 1 << 15:
                break
        if not n:
            return 0
        return int(np.packbits(total * 2 > n, bitorder="little").view("<i8")[0])

    for b in batches:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        got = pa.array([fingerprint(x or b"") for x in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), got], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp long)`` for every row: 64 majority bits over the XXH64 of 3-word shingles (no words: zero).

    A null text counts as empty, a text under three words is one shingle. Long texts are hashed in blocks. A row
    with a null id keeps its fingerprint.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        _fingerprint_batches, f"id {kind}, fp long"
    )


def _segment(fp: str, s: int) -> str:
    return f"(shiftrightunsigned({fp}, {32 * s}) & 4294967295L)"


def _first_shared(x: str, seg: str, pos: str, n: int) -> str:
    """Whether (seg, pos) is the first variant that two words share; x: array of the segments' differing bits."""
    earlier = " and ".join(["true", *[f"({seg} <= {i} or bit_count({x}[{i}]) > 1)" for i in range(n - 1)]])
    return f"(({x}[{seg}] = 0 and {pos} = 0) or {x}[{seg}] = shiftleft(1L, {pos})) and {earlier}"


def near_links(fps: DataFrame) -> DataFrame:
    """Every pair ``(a, b)`` of distinct fingerprints that differ in one to three bits, once.

    A fingerprint is cut into two 32-bit segments, of which one differs by at most one bit. Each segment is indexed
    under its 32 variants with one bit deleted; an equality join finds the pairs, and each is verified and kept only at
    the first variant that it shares. Variants with more than ``HOT_VARIANT`` fingerprints are keyed again: the other
    segment's two halves differ by three bits at most, so one of them differs by at most one, and its 16 one-bit
    deletions extend the key. Nothing is capped.
    """
    keyed = fps.select("fp", F.expr("explode(sequence(0, 63))").alias("k")).select(
        "fp",
        F.expr(
            "shiftleft(cast(k as bigint), 32) | (case when k < 32 then fp & 4294967295L else shiftrightunsigned(fp, 32) end"
            " & ~shiftleft(1L, k % 32))"
        ).alias("key"),
    )
    # Counted map-side and joined back, so that AQE can split a variant that very many fingerprints share.
    counts = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")).hint("merge")
    shared = cut(keyed.join(counts, "key"))
    diff = "array((a ^ b) & 4294967295L, shiftrightunsigned(a ^ b, 32))"
    seg, pos = "cast(shiftright(key, 37) as int)", "cast(shiftright(key, 32) & 31 as int)"
    close = f"a < b and bit_count(a ^ b) <= 3 and {_first_shared(diff, seg, pos, 2)}"

    def pairs(df, keys, more="true"):
        left = df.select(*keys, F.col("fp").alias("a"))
        right = df.select(*keys, F.col("fp").alias("b"))
        on = " and ".join(f"l.{k} = r.{k}" for k in keys)
        test = f"{close} and {more}".replace("key", "l.key").replace("sub", "l.sub")
        return left.alias("l").join(right.alias("r"), F.expr(f"{on} and {test}"), "inner").select("a", "b")

    plain = pairs(shared.where(F.col("n") <= HOT_VARIANT), ["key"])
    hot = shared.where(F.col("n") > HOT_VARIANT)
    if hot.isEmpty():
        return plain
    other = "(case when shiftright(key, 37) = 0 then shiftrightunsigned({0}, 32) else {0} & 4294967295L end)"
    halves = hot.select("key", "fp", F.expr("explode(sequence(0, 31))").alias("j")).select(
        "key",
        "fp",
        F.expr(
            f"shiftleft(j, 16) | (cast(shiftright({other.format('fp')}, 16 * (j div 16)) & 65535 as int)"
            " & ~shiftleft(1, j % 16))"
        ).alias("sub"),
    )
    rest = other.format("(a ^ b)")
    half = f"array({rest} & 65535, shiftright({rest}, 16))"
    again = _first_shared(half, "cast(shiftright(sub, 20) as int)", "cast(shiftright(sub, 16) & 15 as int)", 2)
    return plain.union(pairs(halves, ["key", "sub"], again))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp long, component)`` for every row: documents whose fingerprints link share the smallest id reachable.

    Equal fingerprints are one node, so groups of copies never expand into pairs. Empty table: no rows. Repeated rows
    stay. A component of null ids only has a null component.
    """
    fp = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(fp.groupBy("fp").agg(F.min("id").alias("least")))
    comps = connected_components(near_links(nodes))
    rooted = nodes.join(comps, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = rooted.join(named, "root").select(F.col("fp").alias("node"), "component")
    return fp.join(by_fp, F.col("fp") == F.col("node")).select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grouped=near_duplicates) -> DataFrame:
    """``docs`` with one document of each near-duplicate group that ``grouped`` makes: the one of smallest id.

    Rows are told apart by id and text: rows that share an id but no group are all judged on their own. A null id counts
    as larger than all others; of equal ids the smallest text hash stays. Of rows that repeat a surviving id and text, the
    one with the smallest content stays. Texts are shuffled only where the rows to drop are too many to broadcast.
    """
    id_, h = F.col(id_col), F.xxhash64(text_col)
    key = F.struct(id_.isNull().alias("none"), id_.alias("id"), h.alias("h"))
    groups = cut(grouped(docs.select(key.alias("id"), F.col(text_col).alias("text")), "id", "text").select("id", "component"))
    same = lambda t: docs[id_col].eqNullSafe(t["_id"]) & (F.xxhash64(docs[text_col]) == t["_h"])
    flat = lambda t: maybe_broadcast(cut(t.select(F.col("id.id").alias("_id"), F.col("id.h").alias("_h"))))
    drop = flat(groups.where("id <> component").select("id").distinct())
    left = docs.join(drop, same(drop), "left_anti")
    again = flat(groups.where("id = component").groupBy("id").count().where("count > 1"))
    if again.isEmpty():
        return left
    single = left.join(again, same(again), "left_anti")
    rest = [c for c in docs.columns if c != id_col]
    first = F.min(F.struct(*[F.col(c) for c in rest])).alias("_row")
    one = left.join(again, same(again), "left_semi").groupBy(id_col, F.xxhash64(text_col).alias("_h")).agg(first)
    return single.union(one.select(*[F.col(id_col) if c == id_col else F.col("_row")[c].alias(c) for c in docs.columns]))
