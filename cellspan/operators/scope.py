"""Scopes of an analysis: sightings, groups of cells, Spots, and what of them the loaded events cover."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as I
from .common import filled, join_intervals, n_distinct

SIGHTINGS = "sighting_id string, location_name string, window_start timestamp_ntz, window_end timestamp_ntz, cgi_group_id string"
CELL_GROUPS = "group_id string, cgi string"


def sighting(sighting_id: str, location: str, at: datetime, before: int = 0, after: int = 0, cgi_group_id: str | None = None) -> tuple:
    """Row of a sighting: an instant with up to a day of minutes before and after it."""
    for m in (before, after):
        if not 0 <= m <= 1440:
            raise ValueError("minutes before and after are 0 to 1440")
    return sighting_id, location, at - timedelta(minutes=before), at + timedelta(minutes=after), cgi_group_id


def sightings(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SIGHTINGS)


def cell_groups(spark: SparkSession, groups: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(g, c) for g, cells in groups.items() for c in cells], CELL_GROUPS)


def loaded_cells(df: DataFrame, column: str = "searched_cell_id") -> DataFrame:
    """First raw text of every cell key of the loaded events."""
    rows = df.withColumn("cell_key", I.cell_key(column)).where("cell_key <> ''")
    return rows.groupBy("cell_key").agg(F.min_by(column, "event_id").alias("cell"), F.count("*").alias("events"))


def loaded_spots(df: DataFrame) -> DataFrame:
    rows = df.where(filled("spot_id").isNotNull())
    return rows.groupBy("spot_id").agg(
        F.min("spot_name").alias("spot_name"), F.count("*").alias("events"), n_distinct(filled("searched_cell_id")).alias("cells"), n_distinct("source_file").alias("files")
    )


def in_spot(df: DataFrame, spot_id: str | None = None, spot_name: str | None = None) -> DataFrame:
    """Events of a Spot, by id or else by name; of all Spots if neither is given."""
    same = lambda c, v: F.lower(F.trim(c)) == v.strip().lower()
    return df.where(same("spot_id", spot_id)) if spot_id else df.where(same("spot_name", spot_name)) if spot_name else df


def group_scope(df: DataFrame, groups: DataFrame, columns: tuple[str, ...] = ("searched_cell_id", "first_cell_id")) -> DataFrame:
    """``group_id`` and the events of which a cell is in the group, each event once per group."""
    keys = F.array_distinct(F.array(*[I.cell_key(c) for c in columns]))
    cells = groups.select("group_id", I.cell_key("cgi").alias("_key")).distinct()
    small = cells.limit(100_001).count() <= 100_000
    exploded = df.withColumn("_key", F.explode(keys)).where("_key <> ''")
    hits = exploded.join(F.broadcast(cells) if small else cells, "_key").drop("_key")
    return hits.dropDuplicates(["group_id", "event_id"])


def scope_status(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: how many of its cells are loaded, and what scope follows."""
    loaded = df.select(I.cell_key("searched_cell_id").alias("_key")).where("_key <> ''").distinct().withColumn("_in", F.lit(1))
    g = groups.withColumn("_key", I.cell_key("cgi"))
    out = g.join(loaded, "_key", "left").groupBy("group_id").agg(F.countDistinct("_key").alias("cells"), n_distinct(F.when(F.col("_in") == 1, F.col("_key"))).alias("loaded_cells"))
    status = F.when(F.col("loaded_cells") == 0, "NO_CELL_LOADED").when(F.col("loaded_cells") < F.col("cells"), "PARTLY_LOADED").otherwise("FULLY_LOADED")
    return out.withColumn("scope_status", status)


def sighting_events(df: DataFrame, found: DataFrame, groups: DataFrame, time: str = "call_datetime") -> DataFrame:
    """Events of each sighting's window and cells (``window_start <= t < window_end``); without a group, of all cells."""
    g = groups.groupBy("group_id").agg(F.collect_set(I.cell_key("cgi")).alias("_cells"))
    s = found.join(g, F.col("cgi_group_id") == F.col("group_id"), "left").drop("group_id")
    t = F.col(f"e.{time}")
    cells = F.array(I.cell_key("e.searched_cell_id"), I.cell_key("e.first_cell_id"))
    on = (t >= F.col("p.window_start")) & (t < F.col("p.window_end")) & (F.col("p.cgi_group_id").isNull() | F.arrays_overlap(cells, F.col("p._cells")))
    if found.limit(10_001).count() > 10_000:
        raise ValueError("more than 10000 sightings")
    keep = ["p.sighting_id", *[f"e.{c}" for c in df.columns]]
    return join_intervals(df, s, on, time, time, "window_start", "window_end", keep)
