"""Staged analysis: fingerprint the inputs, reuse what was normalised from the same bytes, run a bundle, write it."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from ..sources import folders, sinks


def fingerprint(found: DataFrame) -> str:
    """Digest over path, size and time of change of all files; the files themselves are not read for it."""
    from pyspark.sql import functions as F

    per = found.select(F.sha2(F.concat_ws("|", "path", "bytes", F.col("modified").cast("string")), 256).alias("h"))
    parts = per.select(*[F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"p{i}") for i in range(4)])
    row = parts.agg(F.count("*"), *[F.sum(f"p{i}") for i in range(4)]).first()
    return hashlib.sha256("|".join(map(str, row)).encode()).hexdigest()


def _text(spark: SparkSession, path: str) -> str | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return "\n".join(r[0] for r in spark.read.text(path).collect()) if fs.exists(p) else None


def staged(spark: SparkSession, folder: str, stage: str, name: str, load, required: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """The normalised table of a folder, and whether an earlier stage was reused.

    A stage is reused if the fingerprint of its inputs and its columns are what they were. Each fingerprint has a folder of
    its own, and the manifest is written last; so data that others may read are never overwritten.
    """
    key = fingerprint(folders.files(spark, folder))
    known = _text(spark, f"{stage}/manifest")
    if known and json.loads(known).get("fingerprint") == key:
        df = spark.read.parquet(f"{stage}/data-{key}")
        sinks.validate(df, required)
        df.createOrReplaceTempView(name)
        return df, True
    df = sinks.stage(load(folder), f"{stage}/data-{key}", name)
    sinks.validate(df, required)
    entry = json.loads(sinks.manifest(df, name, f"{stage}/data-{key}")) | {"fingerprint": key}
    spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.mode("overwrite").text(f"{stage}/manifest")
    return df, False


def policy(n_files: int, n_bytes: int) -> dict[str, int]:
    """Read settings by the size of the input: bytes a task reads, and partitions of a shuffle."""
    task = 128 << 20
    return {"spark.sql.files.maxPartitionBytes": task, "spark.sql.shuffle.partitions": max(8, -(-n_bytes // (64 << 20))), "files": n_files}


def run(spark: SparkSession, folder: str, stage: str, name: str, load, bundle, output: str, required: tuple[str, ...] = ()) -> dict[str, str]:
    """Stage, analyse, and write every table of the bundle; returns the status of each."""
    df, _ = staged(spark, folder, stage, name, load, required)
    return sinks.write_bundle(bundle(df), output)
