"""Analyst-defined intervals (Parts): scope, presence over Parts, visitors, overlap of sessions, and comparison.

Parts are few and stated by an analyst; a join with them broadcasts the Parts after checking that they are few, so the
events are read once and never shuffled for it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identifiers as I
from ..schema import PARTS
from .common import filled, join_intervals, joined, n_distinct, total
from .presence import label

MAX_PARTS = 10_000


def build(spark: SparkSession, ranges: list[tuple], spots: list[str | None] | None = None) -> DataFrame:
    """Numbered half-open Parts from ``(start, end)`` pairs; an end that is not after its start is refused."""
    rows = []
    for i, (a, b) in enumerate(ranges):
        if not a < b:
            raise ValueError(f"part {i + 1} ends at or before its start")
        rows.append((i + 1, f"Part {i + 1}", a, b, (spots or {}) and spots[i]))
    return spark.createDataFrame([(n, name, a, b, s or None) for n, name, a, b, s in rows], PARTS)


def small(parts: DataFrame) -> DataFrame:
    if parts.limit(MAX_PARTS + 1).count() > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} parts")
    return F.broadcast(parts)


def overlapping(parts: DataFrame) -> DataFrame:
    """Pairs of Parts that overlap, with the overlap in seconds."""
    a, b = small(parts).alias("a"), parts.alias("b")
    on = F.expr("a.part_no < b.part_no and a.start_time < b.end_time and b.start_time < a.end_time")
    begin, end = F.greatest("a.start_time", "b.start_time"), F.least("a.end_time", "b.end_time")
    return a.join(b, on).select(
        F.col("a.part_no").alias("part_a"), F.col("b.part_no").alias("part_b"), F.timestamp_diff("SECOND", begin, end).alias("overlap_seconds")
    )


def _scope(time_test: Column) -> Column:
    spot = F.col("p.spot_id").isNull() | (F.lower(F.trim("p.spot_id")) == F.lower(F.trim("e.spot_id")))
    return time_test & spot


def assign(df: DataFrame, parts: DataFrame, time: str = "call_datetime") -> DataFrame:
    """Events with each Part that they fall into (half-open, of its Spot if it names one)."""
    t = F.col(f"e.{time}")
    on = _scope((t >= F.col("p.start_time")) & (t < F.col("p.end_time")))
    keep = [*[f"e.{c}" for c in df.columns], "p.part_no", "p.part_name"]
    return join_intervals(df, small(parts), on, time, time, "start_time", "end_time", keep)


def _cell(name: str) -> str:
    """``cell_key`` of a stated cell."""
    return re.sub("[^A-Z0-9]", "", name.strip().upper())


def in_cells(df: DataFrame, cells: list[str], columns: tuple[str, ...] = ("searched_cell_id", "first_cell_id")) -> DataFrame:
    """Events of which any cell column is in a group of cells."""
    keys = [_cell(c) for c in cells]
    hit = F.lit(False)
    for c in columns:
        hit = hit | I.cell_key(c).isin(*keys)
    return df.where(hit)


def active_cells(df: DataFrame, start, end, time: str = "call_datetime") -> DataFrame:
    """Cells active in the window against all loaded cells, and how sure that scope is."""
    inside = (F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end))
    key = F.when(I.cell_key("searched_cell_id") != "", I.cell_key("searched_cell_id"))
    one = df.agg(n_distinct(key).alias("loaded_cells"), n_distinct(key, inside).alias("active_cells"))
    sure = F.when(F.col("active_cells") == 0, "NONE").when(F.col("active_cells") == 1, "HIGH").when(F.col("active_cells") < F.col("loaded_cells"), "MEDIUM").otherwise("LOW")
    return one.withColumn("confidence", sure)


def part_summary(df: DataFrame, parts: DataFrame, time: str = "call_datetime") -> DataFrame:
    """Each Part with its counts, also those without an event."""
    got = assign(df, parts, time).groupBy("part_no").agg(
        F.count("*").alias("records"),
        n_distinct(filled("subscriber_number")).alias("subscribers"),
        n_distinct(filled("searched_cell_id")).alias("cells"),
        F.min(time).alias("first_activity"),
        F.max(time).alias("last_activity"),
    )
    out = parts.join(got, "part_no", "left").fillna(0, ["records", "subscribers", "cells"])
    return out.select("part_no", "part_name", "records", "subscribers", "cells", "first_activity", "last_activity", F.when(F.col("records") > 0, "HAS_DATA").otherwise("NO_DATA").alias("status"))


def presence(df: DataFrame, parts: DataFrame, n_parts: int, entity: str = "subscriber_number", time: str = "call_datetime") -> DataFrame:
    """Per entity: Parts matched, their ratio, and an indicator for each of ``n_parts`` Parts."""
    hits = assign(df, parts, time).where(filled(entity).isNotNull())
    flags = [F.max((F.col("part_no") == i).cast("int")).alias(f"part_{i}") for i in range(1, n_parts + 1)]
    out = hits.groupBy(entity).agg(F.countDistinct("part_no").alias("parts_matched"), F.count("*").alias("records"), joined("part_name").alias("parts_seen"), *flags)
    return out.withColumn("presence_ratio", F.concat(F.col("parts_matched").cast("string"), F.lit(f"/{n_parts}")))


def visitor_labels(df: DataFrame) -> DataFrame:
    """Type, confidence and priority of a visitor from its counts in the window and in the baseline."""
    now, base, cells = F.col("current_seen_count"), F.col("baseline_seen_count"), F.col("cells_seen")
    device = (F.col("imei_count") >= 2) | (F.col("imsi_count") >= 2)
    kind = (
        F.when(base == 0, "NEW VISITOR")
        .when((base <= 2) & (now >= 2), "RARE REPEAT VISITOR")
        .when(base <= 2, "RARE VISITOR")
        .when((base <= 5) & (now >= 2), "REPEAT RELEVANT VISITOR")
        .otherwise("REGULAR / LOCAL PRESENCE")
    )
    sure = F.when((now >= 2) & ((base <= 2) | (cells >= 2)), "HIGH").when((now >= 2) | (base <= 2) | (cells >= 2), "MEDIUM").otherwise("LOW")
    strong = (cells >= 2) | device
    k = F.col("visitor_type")
    first = (
        F.when(k.isin("NEW VISITOR", "RARE REPEAT VISITOR"), F.when((now >= 2) | strong, "HIGH").otherwise("MEDIUM"))
        .when(k.isin("REPEAT RELEVANT VISITOR", "RARE VISITOR"), F.when(strong, "HIGH").otherwise("MEDIUM"))
        .otherwise(F.when(strong, "MEDIUM").otherwise("LOW"))
    )
    seen = {
        "NEW VISITOR": "not seen outside the Part",
        "RARE VISITOR": "hardly seen outside the Part",
        "RARE REPEAT VISITOR": "hardly seen outside the Part",
        "REPEAT RELEVANT VISITOR": "seldom outside the Part but repeatedly in it",
        "REGULAR / LOCAL PRESENCE": "seen regularly outside the Part",
    }
    why = F.concat_ws(
        "; ",
        F.coalesce(*[F.when(k == name, text) for name, text in seen.items()]),
        F.when(cells >= 2, "several cells in the Part"),
        F.when(F.col("imei_count") >= 2, "several IMEI"),
        F.when(F.col("imsi_count") >= 2, "several IMSI"),
    )
    labelled = df.withColumns({"visitor_type": kind, "visitor_confidence": sure})
    return labelled.withColumns({"visitor_priority": first, "visitor_reason": why})


def visitors(df: DataFrame, parts: DataFrame, time: str = "call_datetime") -> DataFrame:
    """Per Part and subscriber: counts inside, counts of all other timed events, and the visitor labels.

    All events of a subscriber are counted once; those outside a Part are the difference. Untimed events count nowhere.
    """
    rows = df.where(filled("subscriber_number").isNotNull() & F.col(time).isNotNull())
    all_ = rows.groupBy("subscriber_number").agg(F.count("*").alias("_all"))
    inside = assign(rows, parts, time).groupBy("part_no", "subscriber_number").agg(
        F.count("*").alias("current_seen_count"),
        n_distinct(filled("searched_cell_id")).alias("cells_seen"),
        n_distinct(filled("imei")).alias("imei_count"),
        n_distinct(filled("imsi")).alias("imsi_count"),
    )
    out = inside.join(all_, "subscriber_number").withColumn("baseline_seen_count", F.col("_all") - F.col("current_seen_count"))
    return visitor_labels(out.drop("_all"))


def session_overlap(df: DataFrame, parts: DataFrame) -> DataFrame:
    """Sessions that overlap a Part strictly, with the seconds they share; a session that only touches it does not."""
    on = _scope((F.col("e.session_start") < F.col("p.end_time")) & (F.col("e.session_end") > F.col("p.start_time")))
    keep = [*[f"e.{c}" for c in df.columns], "p.part_no", "p.part_name", F.col("p.start_time").alias("_start"), F.col("p.end_time").alias("_end")]
    out = join_intervals(df, small(parts), on, "session_start", "session_end", "start_time", "end_time", keep)
    begin, end = F.greatest("session_start", "_start"), F.least("session_end", "_end")
    micros = F.timestamp_diff("MICROSECOND", begin, end)
    return out.withColumn("overlap_seconds", F.greatest(micros / 1e6, F.lit(0.0))).drop("_start", "_end")


def excluded_sessions(df: DataFrame, parts: DataFrame, cells: list[str]) -> DataFrame:
    """Sessions that match a Part in time and Spot but none of its cells."""
    return session_overlap(df, parts).where(~I.cell_key("searched_cell_id").isin(*[_cell(c) for c in cells])).withColumn(
        "exclusion_reason", F.lit("TIME_MATCH_LOCATION_MISMATCH")
    )


def session_presence(df: DataFrame, parts: DataFrame, entity: str = "subscriber_number") -> DataFrame:
    return session_overlap(df, parts).where(filled(entity).isNotNull()).groupBy(entity).agg(
        F.countDistinct("part_no").alias("parts_matched"),
        F.count("*").alias("sessions"),
        total("overlap_seconds", 6).alias("overlap_seconds"),
        total("total_volume").alias("total_volume"),
    )


def allocation_overlap(df: DataFrame, parts: DataFrame) -> DataFrame:
    """IP allocations that touch a Part (both ends counted), each counted once: the earliest event of a volume key."""
    w = Window.partitionBy("allocation_volume_key").orderBy("event_time", "event_id")
    one = df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    on = _scope((F.col("e.allocation_start") <= F.col("p.end_time")) & (F.col("e.allocation_end") >= F.col("p.start_time")))
    keep = [*[f"e.{c}" for c in one.columns], "p.part_no"]
    return join_intervals(one, small(parts), on, "allocation_start", "allocation_end", "start_time", "end_time", keep)


def classify(df: DataFrame, start, end, spot: str | None = None, others: list[tuple] = (), time: str = "event_time") -> DataFrame:
    """Three levels of rarity of the numbers in one Part, in one pass of conditional counts.

    Not in another Part: PART_ONLY; not in the Spot outside the Part: NEW_IN_SPOT; nowhere else: GLOBAL_UNCOMMON.
    """
    t = F.col(time)
    here = F.coalesce(F.trim("spot_id") == spot, F.lit(False)) if spot else F.lit(True)
    within = F.coalesce((t >= F.lit(start)) & (t < F.lit(end)), F.lit(False))
    now = within & here
    other = F.lit(False)
    for a, b, s in others:
        at = (t >= F.lit(a)) & (t < F.lit(b))
        other = other | F.coalesce(at & (F.trim("spot_id") == s) if s else at, F.lit(False))
    count = lambda c: F.count_if(c)
    rows = df.withColumn("mobile_number", filled("subscriber_number")).where("mobile_number is not null")
    out = (
        rows.groupBy("mobile_number")
        .agg(
            count(now).alias("selected_period_records"),
            n_distinct(filled("searched_cell_id"), now).alias("cells_seen"),
            n_distinct(filled("imei"), now).alias("imei_count"),
            n_distinct(filled("imsi"), now).alias("imsi_count"),
            F.min(F.when(now, t)).alias("first_seen_selected"),
            F.max(F.when(now, t)).alias("last_seen_selected"),
            count(other & ~now).alias("other_parts_records"),
            count(here & ~within).alias("same_spot_other_records"),
            count(~now).alias("global_other_records"),
            n_distinct("spot_id", ~now).alias("global_other_spot_count"),
        )
        .where("selected_period_records > 0")
    )
    status = lambda c, a, b: F.when(F.col(c) == 0, a).otherwise(b)
    out = out.withColumns(
        {
            "part_status": status("other_parts_records", "PART_ONLY", "SEEN_IN_OTHER_PART"),
            "spot_status": status("same_spot_other_records", "NEW_IN_SPOT", "SEEN_IN_SPOT_OUTSIDE_PART"),
            "global_status": status("global_other_records", "GLOBAL_UNCOMMON", "SEEN_ELSEWHERE"),
        }
    )
    score = (
        F.least("selected_period_records", F.lit(100))
        + 10 * F.least("cells_seen", F.lit(10))
        + F.when(F.col("part_status") == "PART_ONLY", 15).otherwise(0)
        + F.when(F.col("spot_status") == "NEW_IN_SPOT", 25).otherwise(0)
        + F.when(F.col("global_status") == "GLOBAL_UNCOMMON", 50).otherwise(0)
        + F.when(F.col("imei_count") > 1, 20).otherwise(0)
        + F.when(F.col("imsi_count") > 1, 20).otherwise(0)
    )
    return out.withColumn("priority_score", score.cast("long")).withColumn("priority", label(F.col("priority_score"), ((120, "High"), (70, "Medium"))))


def compare(df: DataFrame, parts: DataFrame, time: str = "event_time") -> DataFrame:
    """Numbers over all Parts: in how many they are seen, on how many cells at most, and the priority of that."""
    hits = assign(df, parts, time).where(filled("subscriber_number").isNotNull())
    per = hits.groupBy("subscriber_number", "part_no", "part_name").agg(
        F.count("*").alias("n"), n_distinct(filled("searched_cell_id")).alias("c"), n_distinct(filled("imei")).alias("i"), F.min(time).alias("a"), F.max(time).alias("b")
    )
    out = per.groupBy("subscriber_number").agg(
        F.count("*").alias("parts_seen_count"),
        joined("part_name").alias("parts_seen"),
        F.sum("n").alias("total_records"),
        F.max("c").alias("max_cells_seen"),
        F.max("i").alias("max_imei_count"),
        F.min("a").alias("first_seen"),
        F.max("b").alias("last_seen"),
    )
    many, cells = F.col("parts_seen_count") >= 2, F.col("max_cells_seen") >= 2
    first = F.when(many & cells, "High").when(many, "Medium-High").when(cells | (F.col("total_records") >= 10), "Medium").otherwise("Low")
    return out.withColumn("priority", first)
