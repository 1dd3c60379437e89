"""Folders of evidence: inventory, byte-identical files, Spot layout, incremental ingest by file digest."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one of ``spark.checkpoint.dir``; a temporary one only in a local session without it."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or 'file:' + tempfile.mkdtemp(prefix='cellspan-files-')).rstrip('/')}/files-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to a scratch folder and read from there, whatever reads it how often."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def contents(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """The files of a folder in the layout of Spark's ``binaryFile`` source."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".csv", ".txt"), recursive: bool = True) -> DataFrame:
    """``(path, name, bytes, modified, sha256)`` of the files of a folder."""
    return listed(contents(spark, folder, recursive), suffixes)


def listed(found: DataFrame, suffixes: tuple[str, ...] = (".csv", ".txt")) -> DataFrame:
    """As ``files``, of files in the layout of ``contents``."""
    return with_suffix(found, suffixes).select(
        "path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256")
    )


def with_suffix(found: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Of files in the layout of ``contents`` those whose name ends so, whatever its case; without suffixes all."""
    ok = F.lit(not suffixes)
    for s in suffixes:
        ok = ok | F.lower("path").endswith(s)
    return found.where(ok)


def distinct_files(found: DataFrame) -> DataFrame:
    """Of byte-identical files the first by path, with how many there are."""
    w = Window.partitionBy("sha256")
    return found.withColumns({"copies": F.count("*").over(w), "_rn": F.row_number().over(w.orderBy("path"))}).where("_rn = 1").drop("_rn")


def inventory(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.countDistinct("sha256").alias("distinct_files"))


def spot_layout(found: DataFrame, root: str) -> DataFrame:
    """Files with the Spot of their first-level folder: numbered by folder name whatever its case; files at the root
    belong to none."""
    base = root.rstrip("/") + "/"
    inner = F.substring_index("path", base, -1)
    folder = F.when(inner.contains("/"), F.substring_index(inner, "/", 1))
    rows = found.withColumn("spot_folder", folder)
    spots = rows.where("spot_folder is not null").select("spot_folder").distinct()
    numbered = spots.withColumn("_n", F.row_number().over(Window.orderBy(F.lower("spot_folder"), "spot_folder")))  # folders only
    out = rows.join(F.broadcast(numbered), "spot_folder", "left")
    return out.withColumns(
        {
            "spot_id": F.when(F.col("_n").isNull(), "UNASSIGNED-ROOT").otherwise(F.format_string("SPOT-%02d", F.col("_n"))),
            "spot_name": F.coalesce("spot_folder", F.lit("Unassigned")),
        }
    ).drop("_n")


def new_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose bytes were not loaded before; those that failed are tried again."""
    return distinct_files(found).join(manifest.where("status = 'LOADED'").select("sha256"), "sha256", "left_anti")


#: Files of one load.
BATCH = 500

MANIFEST = "sha256 string, path string, status string, rows long"


def ingest(spark: SparkSession, folder: str, target: str, manifest_path: str, read) -> DataFrame:
    """Add what ``read(paths) -> DataFrame`` makes of new files to the Parquet table ``target``, and log them.

    The manifest is keyed by the digest of a file's bytes, so a second run loads nothing again. The rows of a file have a
    partition ``load`` of their own, named by its digest and overwritten: a run that ended between its rows and its log entry
    writes the same partitions again, whatever files have come since. Files are read in batches if their rows say where they
    are from (``source_path``), else one by one. Returns the new entries.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest_path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    manifest = spark.read.schema(MANIFEST).parquet(manifest_path) if fs.exists(hadoop) else spark.createDataFrame([], MANIFEST)
    entries, batch = [], []
    name = lambda r: f"b{r['sha256'][:32]}"

    def load(batch):
        rows = read([r["path"] for r in batch])
        if "source_path" in rows.columns:
            of = spark.createDataFrame([(r["path"], name(r)) for r in batch], "source_path string, load string")
            named = rows.join(F.broadcast(of), "source_path")  # at most BATCH files
            named.write.partitionBy("load").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(target)
        else:
            for r in batch:
                read([r["path"]]).write.mode("overwrite").parquet(f"{target}/load={name(r)}")
        new = [(r["sha256"], r["path"], "LOADED", None) for r in batch]
        spark.createDataFrame(new, MANIFEST).coalesce(1).write.mode("append").parquet(manifest_path)
        entries.extend(new)

    for r in new_files(files(spark, folder), manifest).select("sha256", "path").orderBy("sha256").toLocalIterator():
        batch.append(r)
        if len(batch) == BATCH:
            load(batch)
            batch = []
    if batch:
        load(batch)
    return spark.createDataFrame(entries, MANIFEST)
