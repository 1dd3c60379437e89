"""Master data: enrichment by number and by cell, null-safe upserts, duplicate flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as I
from .common import filled, latest, n_if

#: Rows up to which a master table is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def _dimension(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def last_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the last in ``order``."""
    return latest(df.where(filled(key).isNotNull()), [key], order)


def _one_per_key(master: DataFrame, key: Column, cols: list[str], order: list[str] | None, prefix: str) -> DataFrame:
    """``(_key, prefixed columns, _hit)`` with one row per normalised key: of repeats the last by the columns ``order``
    (by default ``source_file`` and ``source_row`` where the master has them), then by all columns. Combined map-side."""
    by = order if order is not None else [c for c in ("source_file", "source_row") if c in cols]
    last = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(by)], F.struct(*cols).alias("row")))["row"]
    one = master.withColumn("_key", key).where("_key is not null").groupBy("_key").agg(last.alias("_row"))
    return _dimension(one.select("_key", *[F.col("_row")[c].alias(f"{prefix}{c}") for c in cols], F.lit(True).alias("_hit")))


def enrich_number(
    df: DataFrame, master: DataFrame, number: str = "other_party", key: str = "mobile_number", prefix: str = "subscriber_", order: list[str] | None = None
) -> DataFrame:
    """``df`` with the master columns of a number and ``lookup_status``; only valid mobile numbers are looked up.

    Each row stays one row: of master rows whose keys normalise alike the last by ``order`` counts (see ``_one_per_key``).
    """
    cols = [c for c in master.columns if c != key]
    dim = _one_per_key(master, I.msisdn(key), cols, order, prefix)
    out = df.withColumn("_key", I.msisdn(number)).join(dim, "_key", "left")
    status = F.when(F.col("_key").isNull(), "INVALID_KEY").when(F.col("_hit"), "FOUND").otherwise("NOT_FOUND")
    return out.withColumn("lookup_status", status).drop("_key", "_hit")


def enrich_cell(
    df: DataFrame, master: DataFrame, cell: str = "first_cell_id", key: str = "cgi", prefix: str = "cell_", order: list[str] | None = None
) -> DataFrame:
    """``df`` with the master columns of a cell and ``cell_status``; only valid cells are looked up, rows stay one row."""
    cols = [c for c in master.columns if c != key]
    dim = _one_per_key(master, I.cgi_key(key), cols, order, prefix)
    out = df.withColumn("_key", F.when(I.valid_cell(cell), I.cgi_key(cell))).join(dim, "_key", "left")
    status = F.when(F.col("_key").isNull(), "INVALID_KEY").when(F.col("_hit"), "FOUND").otherwise("NOT_FOUND")
    return out.withColumn("cell_status", status).drop("_key", "_hit")


def missing_cells(df: DataFrame, master: DataFrame, cell: str = "first_cell_id", key: str = "cgi") -> DataFrame:
    """Valid cells that the master does not know, with their events."""
    rows = df.where(I.valid_cell(cell)).withColumn("cell_key", I.cgi_key(cell))
    return rows.groupBy("cell_key").agg(F.count("*").alias("events")).join(master.select(I.cgi_key(key).alias("cell_key")), "cell_key", "left_anti")


def with_fallback(primary: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The primary master, and of the other one what the primary lacks."""
    return primary.unionByName(other.join(primary.select(key), key, "left_anti"), allowMissingColumns=True)


def enrichment_summary(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("lookup_status").agg(F.count("*").alias("records"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``existing`` after ``incoming`` (one row per key): new keys are added, changed rows replaced, equal ones kept.

    ``upsert_action`` says which. Columns are compared null-safely, so that null to a value is a change.
    """
    cols = [c for c in existing.columns if c != key]
    old = existing.select(F.col(key), F.struct(*cols).alias("o"), F.lit(True).alias("_old"))
    new = incoming.select(F.col(key), F.struct(*cols).alias("n"), F.lit(True).alias("_new"))
    both = old.join(new, key, "full")
    action = (
        F.when(F.col("_new").isNull(), "KEPT")
        .when(F.col("_old").isNull(), "INSERTED")
        .when(F.col("o").eqNullSafe(F.col("n")), "UNCHANGED")
        .otherwise("UPDATED")
    )
    pick = F.when(F.col("_new"), F.col("n")).otherwise(F.col("o"))
    return both.withColumn("upsert_action", action).select(key, *[pick[c].alias(c) for c in cols], "upsert_action")


def upsert_counts(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    return upsert(existing, incoming, key).groupBy("upsert_action").agg(F.count("*").alias("records"))


SIGNATURE = ("subscriber_number", "other_party", "call_type", "call_datetime", "call_duration", "imei", "imsi", "first_cell_id", "last_cell_id")


def flag_duplicates(df: DataFrame, signature: tuple[str, ...] = SIGNATURE) -> DataFrame:
    """All rows, with flag, count and group id of those whose signature repeats; nothing is removed."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in signature]
    key = F.sha2(F.concat_ws("\u001f", *parts), 256)
    signed = df.withColumn("_signature", key)
    # Counted map-side and joined back: a signature that very many rows share goes through no single task.
    again = signed.groupBy("_signature").agg(F.count("*").alias("_n")).where("_n > 1")
    out = signed.join(again, "_signature", "left").withColumn("duplicate_count", F.coalesce("_n", F.lit(1)).cast("long")).drop("_n")
    again = F.col("duplicate_count") > 1
    return out.withColumns(
        {"potential_duplicate": again, "duplicate_group_id": F.when(again, F.concat(F.lit("DUP-"), F.substring("_signature", 1, 16))).otherwise("")}
    ).drop("_signature")


def duplicate_summary(df: DataFrame, signature: tuple[str, ...] = SIGNATURE) -> DataFrame:
    """Groups of repeated signatures without a window: counts are combined map-side."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in signature]
    return df.groupBy(F.sha2(F.concat_ws("\u001f", *parts), 256).alias("s")).agg(F.count("*").alias("n")).agg(
        n_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("records")
    )


def search(df: DataFrame, text: str, columns: list[str], order: list[Column], limit: int = 20) -> DataFrame:
    """Rows in which any column contains the text, whatever its case; the first ``limit`` in ``order``."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).cast("string").ilike(f"%{text}%")
    return df.where(hit).orderBy(*order).limit(limit)


def enrich_bundle(bundle: dict[str, DataFrame], numbers: DataFrame, cells: DataFrame, specs: dict[str, dict[str, list[str]]]) -> dict[str, DataFrame]:
    """Every table of a bundle with master columns of the number and cell columns that ``specs`` names for it.

    ``specs``: table to ``{"numbers": [...], "cells": [...]}``; each column's master columns carry its name as prefix.
    """
    out = {}
    for name, df in bundle.items():
        spec = specs.get(name, {})
        for c in spec.get("numbers", []):
            df = enrich_number(df, numbers, c, prefix=f"{c}_").withColumnRenamed("lookup_status", f"{c}_lookup")
        for c in spec.get("cells", []):
            df = enrich_cell(df, cells, c, prefix=f"{c}_").withColumnRenamed("cell_status", f"{c}_lookup")
        out[name] = df
    return out


def bundle_missing_cells(bundle: dict[str, DataFrame], cells: DataFrame, specs: dict[str, dict[str, list[str]]]) -> DataFrame:
    """Cells of a bundle's tables that the master does not know: ``(table_name, cell_key, records)``."""
    out = None
    for name, df in bundle.items():
        for c in specs.get(name, {}).get("cells", []):
            one = missing_cells(df, cells, c).select(F.lit(name).alias("table_name"), "cell_key", F.col("events").alias("records"))
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no cell columns are named")
    return out.groupBy("table_name", "cell_key").agg(F.sum("records").alias("records"))
