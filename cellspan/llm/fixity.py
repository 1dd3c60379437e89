"""Merkle fixity audit of record archives kept in replicas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, maybe_broadcast, ordinal

#: Places of one leaf, and children of one inner node: 2 to the power of this.
BITS = 6


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``(id, record binary)``: each page as a WARC 1.0 resource record. A null url has no target line, a null body is empty."""
    body = f"encode(coalesce(`{body_col}`, ''), 'UTF-8')"
    head = (
        f"concat('WARC/1.0\\r\\nWARC-Type: resource\\r\\nWARC-Record-ID: <urn:page:', coalesce(cast(`{id_col}` as string), ''), '>\\r\\n', "
        f"coalesce(concat('WARC-Target-URI: ', `{url_col}`, '\\r\\n'), ''), 'Content-Type: text/html\\r\\nContent-Length: ', "
        f"cast(octet_length({body}) as string), '\\r\\n\\r\\n')"
    )
    record = f"concat(encode({head}, 'UTF-8'), {body}, encode('\\r\\n\\r\\n', 'UTF-8'))"
    return pages.select(F.col(id_col).cast("long").alias("id"), F.expr(record).alias("record"))


def digests(records: DataFrame, places: DataFrame) -> DataFrame:
    """``(slot, id, n, length, digest)``: one row for each id; ``slot`` is its place in ``places (id, slot)``.

    Repeated records of an id are combined by sums of parts of their SHA-256, which map-side aggregation bounds and
    which no order changes.
    """
    sha = records.select("id", F.sha2("record", 256).alias("s"), F.octet_length("record").cast("long").alias("l"))
    part = lambda i: F.sum(F.conv(F.substring("s", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    by = sha.groupBy("id").agg(
        F.count("*").alias("n"), F.sum("l").alias("length"), *[part(i).alias(f"p{i}") for i in range(4)]
    )
    at = places.withColumnRenamed("id", "_id")
    return by.join(at, F.col("id").eqNullSafe(F.col("_id"))).select(
        "slot",
        "id",
        "n",
        "length",
        F.sha2(F.concat_ws("|", "n", "p0", "p1", "p2", "p3"), 256).alias("digest"),
    )


def parents(level: DataFrame) -> DataFrame:
    """Nodes over ``level (slot, length, digest)``: hash of the ordered offset ranges and digests of up to 64 children."""
    up = level.withColumn("up", F.shiftright("slot", BITS))
    lo = F.sum("length").over(Window.partitionBy("up").orderBy("slot")) - F.col("length")
    ranged = up.withColumn("range", F.struct("slot", F.concat_ws("-", lo, lo + F.col("length"), "digest").alias("s")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("range")), lambda x: x["s"]), ";")
    return ranged.groupBy("up").agg(F.sum("length").alias("length"), F.sha2(joined, 256).alias("digest")).withColumnRenamed("up", "slot")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(id, kind, file, offset, length)``: records in which two replicas ``(id, record binary)`` differ.

    The ids of both replicas are numbered in order, and each replica's records are hashed into a tree over these places:
    a leaf has 64 places, a node 64 children, each child as its offset range within the node and its digest. Roots are compared first; only nodes that differ are
    descended, and at the end only records of leaves that differ are compared. ``kind``: missing (only in ``a``), extra
    (only in ``b``) or changed. ``file`` is a run of 4096 places, ``offset`` and ``length`` the place in it of the id's
    records in ``a`` (of an extra record: in ``b``). Records of a null id come last, as one id. Ids may be any longs: the
    height of the trees follows their number, not their range. Equal or empty replicas: no rows. Repeated records count
    as often as they occur. No group is larger than 64 rows.
    """
    places = cut(ordinal(a.select("id").union(b.select("id")).distinct(), "id", "slot").select("id", "slot"))
    ids = places.count()
    height = 1
    while max(0, ids - 1) >> (BITS * height):
        height += 1
    trees = []
    for records in (a, b):
        levels = [cut(digests(records, places))]
        for _ in range(height):
            levels.append(cut(parents(levels[-1])))
        trees.append(levels)
    bad = None
    for h in range(height, -1, -1):
        x, y = trees[0][h], trees[1][h]
        if bad is not None:
            up = maybe_broadcast(bad.withColumnRenamed("slot", "up"))
            x, y = (t.join(up, F.shiftright("slot", BITS) == F.col("up"), "left_semi") for t in (x, y))
        x, y = x.withColumnRenamed("digest", "da"), y.select("slot", F.col("digest").alias("db"), *([F.col("id").alias("idb")] if h == 0 else []))
        diff = x.join(y, "slot", "full").where(~F.col("da").eqNullSafe(F.col("db")))
        if h:
            bad = cut(diff.select("slot"))
            if bad.isEmpty():
                break
    if h:
        return a.sparkSession.createDataFrame([], "id long, kind string, file long, offset long, length long")
    kind = F.when(F.col("db").isNull(), "missing").when(F.col("da").isNull(), "extra").otherwise("changed")
    found = diff.select("slot", F.coalesce("id", "idb").alias("id"), kind.alias("kind"))
    files = found.select(F.shiftright("slot", 2 * BITS).alias("file")).distinct()

    def places(levels):
        at = Window.partitionBy(F.shiftright("slot", BITS)).orderBy("slot")
        leaf = levels[1].withColumn("base", F.sum("length").over(at) - F.col("length"))
        leaf = leaf.select(F.col("slot").alias("leaf"), "base")
        inner = levels[0].withColumn("offset", F.sum("length").over(at) - F.col("length"))
        inner = inner.join(maybe_broadcast(files), F.shiftright("slot", 2 * BITS) == F.col("file"), "left_semi")
        both = inner.join(leaf, F.shiftright("slot", BITS) == F.col("leaf"))
        return both.select("slot", (F.col("base") + F.col("offset")).alias("offset"), "length")

    pa, pb = places(trees[0]), places(trees[1])
    pb = pb.select("slot", F.col("offset").alias("ob"), F.col("length").alias("lb"))
    return found.join(pa, "slot", "left").join(pb, "slot", "left").select(
        "id",
        "kind",
        F.shiftright("slot", 2 * BITS).alias("file"),
        F.coalesce("offset", "ob").alias("offset"),
        F.coalesce("length", "lb").alias("length"),
    )
