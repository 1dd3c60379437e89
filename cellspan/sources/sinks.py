"""Sinks: staged Parquet with a manifest, CSV that a spreadsheet opens safely, bundles of results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identifiers import formula_safe


def stage(df: DataFrame, path: str, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet, register it as a view, and return it as read from the files."""
    w = df.write.mode("overwrite").option("compression", "snappy")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    staged = df.sparkSession.read.parquet(path)
    staged.createOrReplaceTempView(name)
    return staged


def manifest(staged: DataFrame, name: str, path: str) -> str:
    """What was staged, as JSON: columns, types, and rows."""
    return json.dumps({"table": name, "path": path, "rows": staged.count(), "columns": {f.name: f.dataType.simpleString() for f in staged.schema}})


def validate(staged: DataFrame, required: tuple[str, ...], rows: int | None = None) -> None:
    missing = [c for c in required if c not in staged.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if rows is not None and staged.count() != rows:
        raise ValueError("row count differs from what was staged")


def safe(df: DataFrame) -> DataFrame:
    """Text columns with anything that a spreadsheet would run made plain text."""
    return df.select(*[formula_safe(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def write_csv(df: DataFrame, path: str) -> None:
    flat = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) else F.col(f"`{f.name}`") for f in df.schema])
    safe(flat).write.mode("overwrite").option("header", True).csv(path)


def write_bundle(bundle: dict[str, DataFrame], folder: str, kind: str = "parquet") -> dict[str, str]:
    """Every table of a bundle in a folder of its own; a table that fails does not stop the others."""
    status = {}
    for name, df in bundle.items():
        try:
            write_csv(df, f"{folder}/{name}") if kind == "csv" else df.write.mode("overwrite").parquet(f"{folder}/{name}")
            status[name] = "OK"
        except Exception as e:  # noqa: BLE001  each table stands alone
            status[name] = f"ERROR: {str(e)[:200]}"
    return status


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def preview(df: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows, for a sheet."""
    return df.limit(rows)
