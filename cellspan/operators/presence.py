"""Presence: subscriber roll-ups with review scores, and rarity of a window against its baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as I
from .common import filled, joined, n_distinct, n_if, total

# Cut-offs of the labels.
SQL_LABELS = ((85, "High"), (55, "Medium"))
FRAME_LABELS = ((70, "High"), (45, "Medium"))


def label(score: Column, cuts, last: str = "Low") -> Column:
    out = F.when(score >= cuts[0][0], cuts[0][1])
    for at, name in cuts[1:]:
        out = out.when(score >= at, name)
    return out.otherwise(last)


def _when(cond: Column, points: int) -> Column:
    return F.when(cond, points).otherwise(0)


def reasons(*pairs: tuple[Column, str], none: str) -> Column:
    text = F.concat_ws(", ", *[F.when(c, r) for c, r in pairs])
    return F.when(text == "", none).otherwise(text)


def rollup(df: DataFrame, time: str = "call_datetime", volume: str | None = None) -> DataFrame:
    """One row per subscriber with counts, lists, review score, priority, confidence and why.

    Night is from 22:00 to 05:59. With ``volume`` (packet sessions), any volume adds five points.
    """
    rows = df.withColumn("subscriber_number", filled("subscriber_number")).where("subscriber_number is not null")
    hour = F.hour(time)
    events, cells, imeis, imsis, nights = (F.col(c) for c in ("event_count", "cells_seen", "imei_count", "imsi_count", "night_event_count"))
    extra = [total(volume, zero=True).alias("total_volume")] if volume else []
    party = [n_distinct(filled("other_party")).alias("other_party_count")] if "other_party" in df.columns else []
    agg = rows.groupBy("subscriber_number").agg(
        F.count("*").alias("event_count"),
        F.min(time).alias("first_seen"),
        F.max(time).alias("last_seen"),
        n_if((hour >= 22) | (hour <= 5)).alias("night_event_count"),
        n_distinct(filled("searched_cell_id")).alias("cells_seen"),
        n_distinct(filled("imei")).alias("imei_count"),
        n_distinct(filled("imsi")).alias("imsi_count"),
        joined("operator", 500).alias("operators"),
        joined("searched_cell_id", 700).alias("searched_cells"),
        *party,
        *extra,
    )
    score = F.least(events, F.lit(50)) + cells * 10 + _when(imeis > 1, 25) + _when(imsis > 1, 25) + _when(nights > 0, 15)
    if volume:
        score = score + _when(F.col("total_volume") > 0, 5)
    points = _when(events >= 3, 1) + _when(cells >= 2, 1) + _when(imeis >= 2, 1) + _when(imsis >= 2, 1) + _when(nights > 0, 1)
    why = reasons(
        (cells >= 2, "multi-cell presence"),
        (events >= 2, "repeat/high activity"),
        (events == 1, "single-event/rare presence"),
        (imeis >= 2, "multiple IMEI"),
        (imsis >= 2, "multiple IMSI"),
        (nights > 0, "night-time activity"),
        none="review recommended",
    )
    return agg.withColumn("priority_score", score.cast("long")).withColumns(
        {"priority": label(F.col("priority_score"), SQL_LABELS), "confidence": label(points, ((3, "High"), (2, "Medium"))), "why_important": why}
    )


#: Bucket: (condition, order). Ties end with the subscriber number.
BUCKETS = {
    "common_numbers": ("event_count >= 2", ["event_count desc", "cells_seen desc", "priority_score desc"]),
    "uncommon_numbers": ("event_count = 1", ["night_event_count desc", "first_seen asc"]),
    "multi_cell_presence": ("cells_seen >= 2", ["cells_seen desc", "event_count desc", "priority_score desc"]),
    "device_consistency": ("imei_count >= 2 or imsi_count >= 2", ["imei_count desc", "imsi_count desc", "event_count desc", "cells_seen desc"]),
    "suspicious_timing": ("night_event_count > 0", ["night_event_count desc", "event_count desc"]),
    "priority_leads": ("true", ["priority_score desc", "cells_seen desc", "event_count desc"]),
}


def bucket(rolled: DataFrame, name: str, top: int | None = 200) -> DataFrame:
    """One of the six review lists: a filter and a top list of ``top`` rows (None: all rows, in no order)."""
    cond, order = BUCKETS[name]
    if top is None:
        return rolled.where(cond)
    by = [F.desc_nulls_last(o.split()[0]) if o.endswith("desc") else F.asc_nulls_last(o.split()[0]) for o in order]
    return rolled.where(cond).orderBy(*by, "subscriber_number").limit(top)


def frame_presence(df: DataFrame, volume: str | None = None, time: str = "call_datetime") -> DataFrame:
    """The other review score: night up to 04:59, cells as the larger of searched and first cells.

    With ``volume``, the top tenth of subscribers by volume (linear percentile) gets 15 points more.
    """
    rows = df.withColumn("subscriber_number", filled("subscriber_number")).where("subscriber_number is not null")
    hour = F.hour(time)
    first = n_distinct("first_cell_id") if "first_cell_id" in df.columns else F.lit(0)
    party = n_distinct("other_party") if "other_party" in df.columns else F.lit(0)
    out = rows.groupBy("subscriber_number").agg(
        F.count("*").alias("event_count"),
        n_if((hour >= 22) | (hour < 5)).alias("night_event_count"),
        F.greatest(n_distinct("searched_cell_id"), first).alias("cells_seen"),
        n_distinct("imei").alias("imei_count"),
        n_distinct("imsi").alias("imsi_count"),
        party.cast("long").alias("other_party_count"),
        total(volume, zero=True).alias("total_volume") if volume else F.lit(0.0).alias("total_volume"),
    )
    c = F.col
    score = (
        _when(c("event_count") == 1, 25)
        + _when(c("cells_seen") >= 2, 35)
        + _when(c("event_count") >= 5, 25)
        + _when(c("imei_count") >= 2, 20)
        + _when(c("imsi_count") >= 2, 20)
        + _when(c("other_party_count") >= 5, 15)
        + _when(c("night_event_count") >= 1, 15)
    )
    if volume:
        edge = out.agg(F.percentile("total_volume", 0.9).alias("edge")).scalar()
        score = score + _when((c("total_volume") > 0) & (c("total_volume") >= edge), 15)
    sure = F.when((c("cells_seen") >= 2) & (c("event_count") >= 2), "High").when(c("event_count") >= 2, "Medium").otherwise("Low")
    out = out.withColumn("priority_score", score.cast("long"))
    return out.withColumns({"priority": label(c("priority_score"), FRAME_LABELS), "confidence": sure})


def window_summary(df: DataFrame, entity: str, time: str, count_name: str) -> DataFrame:
    rows = df.withColumn("entity", I.clean(entity)).where("entity <> ''")
    return rows.groupBy("entity").agg(
        F.count("*").alias(count_name),
        F.min(time).alias("first_seen"),
        F.max(time).alias("last_seen"),
        n_distinct(filled("searched_cell_id")).alias("cells_seen"),
        n_distinct(filled("imei")).alias("imei_count"),
        n_distinct(filled("imsi")).alias("imsi_count"),
    )


def rarity_score() -> tuple[Column, Column]:
    """Score and reason by the first rule that holds."""
    now, base, cells, imeis, imsis = (F.col(c) for c in ("current_seen_count", "baseline_seen_count", "cells_seen", "imei_count", "imsi_count"))
    rules = (
        (base == 0, 100, "Not seen in baseline"),
        (base <= 2, 85, "Very rare in baseline"),
        ((now >= 5) & (base <= 5), 75, "Low baseline presence but repeated in current window"),
        (cells >= 3, 70, "Seen across multiple cells"),
        (imeis >= 2, 65, "Multiple IMEI observed"),
        (imsis >= 2, 60, "Multiple IMSI observed"),
        (now == 1, 50, "Single current appearance"),
    )
    score, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for cond, points, text in rules[1:]:
        score, reason = score.when(cond, points), reason.when(cond, text)
    return score.otherwise(30), reason.otherwise("Common or low-priority presence")


def rarity_priority() -> tuple[Column, Column]:
    now, base, cells, score = (F.col(c) for c in ("current_seen_count", "baseline_seen_count", "cells_seen", "rarity_score"))
    device = (F.col("imei_count") >= 2) | (F.col("imsi_count") >= 2)
    rules = (
        ((score >= 100) & (cells >= 3), "HIGH", "Multi-cell uncommon presence"),
        ((score >= 100) & (now >= 100), "HIGH", "High activity only in current window"),
        ((score >= 85) & (base <= 2) & (now >= 5), "MEDIUM_HIGH", "Rare baseline presence with repeated current activity"),
        (cells >= 2, "MEDIUM_HIGH", "Seen on multiple cells"),
        (device, "MEDIUM", "Multiple device/SIM identifiers observed"),
        (score >= 100, "MEDIUM", "Window-only presence"),
    )
    level, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for cond, a, b in rules[1:]:
        level, reason = level.when(cond, a), reason.when(cond, b)
    return level.otherwise("LOW"), reason.otherwise("Low-priority uncommon presence")


def uncommon(current: DataFrame, baseline: DataFrame, entity: str = "subscriber_number", time: str = "call_datetime", min_score: int = 50) -> DataFrame:
    """Entities of the current window with their rarity against the baseline."""
    now = window_summary(current, entity, time, "current_seen_count")
    base = baseline.select(I.clean(entity).alias("entity")).where("entity <> ''").groupBy("entity").agg(F.count("*").alias("baseline_seen_count"))
    out = now.join(base, "entity", "left").fillna(0, ["baseline_seen_count"])
    score, reason = rarity_score()
    out = out.withColumns({"rarity_score": score, "reason": reason})
    level, rank = rarity_priority()
    return out.withColumns({"priority_level": level, "rank_reason": rank}).where(F.col("rarity_score") >= min_score)


def split_window(df: DataFrame, start, end, time: str = "call_datetime") -> tuple[DataFrame, DataFrame]:
    """Rows in ``[start, end)`` and all others; a row without a time belongs to the baseline."""
    inside = F.coalesce((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)), F.lit(False))
    return df.where(inside), df.where(~inside)


def split_overlap(df: DataFrame, start, end, begin: str = "session_start", finish: str = "session_end") -> tuple[DataFrame, DataFrame]:
    """Sessions that overlap the window, both ends counted, and all others."""
    inside = F.coalesce((F.col(begin) <= F.lit(end)) & (F.col(finish) >= F.lit(start)), F.lit(False))
    return df.where(inside), df.where(~inside)


def uncommon_in_window(df: DataFrame, start, end, **kw) -> DataFrame:
    return uncommon(*split_window(df, start, end, kw.get("time", "call_datetime")), **kw)


def uncommon_sessions(df: DataFrame, start, end, min_score: int = 50) -> DataFrame:
    return uncommon(*split_overlap(df, start, end), time="session_start", min_score=min_score)


def priority_summary(found: DataFrame) -> DataFrame:
    order = F.create_map(*[F.lit(x) for p in (("HIGH", 1), ("MEDIUM_HIGH", 2), ("MEDIUM", 3), ("LOW", 4)) for x in p])
    return found.groupBy("priority_level").agg(F.count("*").alias("numbers"), F.sum("current_seen_count").alias("records")).withColumn("priority_order", order[F.col("priority_level")])


def only_now(df: DataFrame, at, unit: str | None = None, time: str = "event_time", entity: str = "subscriber_number") -> DataFrame:
    """Subscribers seen at one moment (the exact second or, with ``unit``, the same minute) and never else."""
    when = F.date_trunc(unit, time).cast("timestamp_ntz") if unit else F.date_trunc("second", time).cast("timestamp_ntz")
    here = when == F.lit(at)
    rows = df.where(filled(entity).isNotNull())
    now = rows.where(here).groupBy(entity).agg(
        F.count("*").alias("records_found"), n_distinct("searched_cell_id").alias("cells_seen"), n_distinct("imei").alias("imei_count")
    )
    return now.join(rows.where(~here).select(entity), entity, "left_anti")


def moment_counts(df: DataFrame, at, unit: str = "minute", time: str = "event_time") -> DataFrame:
    return df.where(F.date_trunc(unit, time).cast("timestamp_ntz") == F.lit(at)).agg(
        F.count("*").alias("records_found"), n_distinct("subscriber_number").alias("numbers_found"), n_distinct("searched_cell_id").alias("cells_involved")
    )


def separate_identifiers(leads: dict[str, DataFrame], limit: int = 200) -> tuple[dict[str, DataFrame], DataFrame]:
    """Leads of valid mobile numbers, ``limit`` a list, and one table of the other identifiers with their best score.

    The table has what the lists hold: give them whole (``bucket`` without ``top``) for all other identifiers.
    """
    valid = F.col("subscriber_number").rlike(r"^[6-9]\d{9}$")
    kept = {n: df.where(valid).orderBy(F.desc("priority_score"), "subscriber_number").limit(limit) for n, df in leads.items()}
    rest = None
    for n, df in leads.items():
        one = df.where(~valid).select(F.lit(n).alias("lead_list"), "subscriber_number", "priority_score")
        rest = one if rest is None else rest.unionByName(one)
    if rest is None:
        raise ValueError("no lead lists")
    best = F.min(F.struct(-F.col("priority_score"), F.col("lead_list").alias("l")))
    return kept, rest.groupBy("subscriber_number").agg(F.max("priority_score").alias("priority_score"), best["l"].alias("lead_list"))


def moment_bundle(df: DataFrame, at, unit: str = "minute", time: str = "event_time") -> dict[str, DataFrame]:
    """What one moment holds: counts, numbers, cells, devices, and the numbers seen then only."""
    now = df.where(F.date_trunc(unit, time).cast("timestamp_ntz") == F.lit(at))
    per = lambda c: now.where(filled(c).isNotNull()).groupBy(c).agg(F.count("*").alias("records"), n_distinct(filled("subscriber_number")).alias("numbers"))
    return {
        "summary": moment_counts(df, at, unit, time),
        "numbers": per("subscriber_number"),
        "cells": per("searched_cell_id"),
        "devices": per("imei"),
        "sims": per("imsi"),
        "only_now": only_now(df, at, unit, time),
    }
