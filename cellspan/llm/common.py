"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Word separators of the corpus contracts: space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cellspan-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a partition of a frame whose number of rows is known.
ROWS_A_FILE = 100_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as few partitions as a known number of rows needs, so that small frames are few files; never in more."""
    return df.coalesce(max(4, -(-rows // ROWS_A_FILE)))


def settled(df: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """``(cut(df), rows)`` in few partitions; ``most``: so many rows at most, where that is known beforehand.

    The rows are counted while they are written. Retried tasks could be counted twice, so the number is for sizes only, and
    zero exactly if there are no rows.
    """
    out, seen = _watched(df if most is None else gathered(df, most), F.count(F.lit(1)).alias("rows"))
    return gathered(out, seen["rows"]), seen["rows"]


def _watched(df: DataFrame, *metrics) -> tuple[DataFrame, dict]:
    """``cut(df)``, and aggregates of its rows that are taken as it is written."""
    seen = Observation()
    return cut(df.observe(seen, *metrics)), seen.get


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, size: int) -> None:
    """Bound the bytes of an Arrow batch, where the session sets no bound of its own; rows alone do not bound long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(size))


def words(text: str) -> str:
    """SQL for the array of words of a text column (null: no words)."""
    return rf"array_remove(split(coalesce({text}, ''), r'{SPACE}'), '')"


def ascii_lower(text: str) -> str:
    """SQL that lower-cases A-Z of a text column and leaves all other characters (null stays null)."""
    other = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"case when octet_length({text}) = length({text}) then lower({text}) else {other} end"


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once per row and binds it to ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint where the row count is checked to be small; otherwise the join shuffles and AQE splits skew."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def ordinal(df: DataFrame, key: str, name: str) -> DataFrame:
    """Number distinct ``key`` values from 0 in ascending order, null last, without one task seeing all rows.

    Rows are range partitioned, counted by range, and numbered within it; only one count per range reaches the driver.
    """
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = cut(
        df.repartitionByRange(int(parts), F.col(key).asc_nulls_last())
        .sortWithinPartitions(F.col(key).asc_nulls_last())
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id())
    )
    counts = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    base, start = 0, {}
    for p in sorted(counts):
        start[p] = base
        base += counts[p]
    if not start:
        return ranged.withColumn(name, F.lit(0).cast("long")).drop("_at", "_part")
    offset = F.create_map(*[F.lit(x) for kv in start.items() for x in kv])
    within = F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)
    return ranged.withColumn(name, (offset[F.col("_part")] + within).cast("long")).drop("_at", "_part")


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node for every node of an undirected edge list ``(a long, b long)``.

    Alternates large-star and small-star steps (Kiveris et al. 2014). Every step only aggregates a minimum per node and
    joins it back, so hot nodes are pre-aggregated and skewed joins can be split. The number of edges never grows, so the
    steps of a short list run in few partitions. Returns ``(node, component)`` for the nodes of edges between different
    nodes.
    """
    plain = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state = (F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    e, seen = _watched(plain.distinct(), *state)
    few = lambda df: gathered(df, 2 * seen["rows"])
    e = few(e)
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = few(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = few(few(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        least = few(large.groupBy("a").agg(F.min("b").alias("m")))
        small = few(large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        e, now = _watched(few(small.union(least.select("a", F.col("m").alias("b"))).distinct()), *state)
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
