"""Several searched places (Spots): coverage, presence matrices, continuity, sequences, and review scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identifiers as I
from .common import filled, joined, n_distinct, n_if, night, with_most_frequent


def prepared(df: DataFrame) -> DataFrame:
    """Events of a named Spot and a subscriber; files outside any Spot folder do not count."""
    rows = df.withColumns({c: I.text(c) for c in ("subscriber_number", "spot_id", "imei", "imsi", "searched_cell_id")})
    return rows.where("subscriber_number <> '' and spot_id <> '' and upper(spot_id) <> 'UNASSIGNED-ROOT'")


def spot_summary(df: DataFrame) -> DataFrame:
    return prepared(df).groupBy("spot_id").agg(
        F.count("*").alias("total_events"),
        F.countDistinct("subscriber_number").alias("unique_subscribers"),
        n_distinct(filled("searched_cell_id")).alias("unique_cells"),
        n_distinct(filled("imei")).alias("unique_imei"),
        F.min("call_datetime").alias("first_seen"),
        F.max("call_datetime").alias("last_seen"),
    )


def subscriber_spots(df: DataFrame) -> DataFrame:
    rows = prepared(df)
    key = ["subscriber_number", "spot_id"]
    out = rows.groupBy(*key).agg(
        F.count("*").alias("events"),
        F.min("call_datetime").alias("first_seen"),
        F.max("call_datetime").alias("last_seen"),
        n_distinct(filled("searched_cell_id")).alias("unique_cells"),
        joined("imei").alias("imei_values"),
        joined("imsi").alias("imsi_values"),
    )
    return with_most_frequent(out, rows, key, {"primary_cell": ("searched_cell_id", F.col("searched_cell_id") != "")})


def presence_matrix(df: DataFrame, spots: list[str]) -> DataFrame:
    """Per subscriber: events on each stated Spot and on how many of them it is seen."""
    rows = prepared(df)
    counts = [n_if(F.col("spot_id") == s).alias(f"{s}_events") for s in spots]
    out = rows.groupBy("subscriber_number").agg(F.countDistinct("spot_id").alias("spots_seen"), F.count("*").alias("total_events"), *counts)
    flags = {f"{s}_present": (F.col(f"{s}_events") > 0).cast("int") for s in spots}
    ratio = F.concat(F.col("spots_seen").cast("string"), F.lit(f" of {len(spots)}"))
    status = F.when(F.col("spots_seen") == len(spots), "ALL_SPOTS").when(F.col("spots_seen") > 1, "MULTIPLE_SPOTS").otherwise("EXCLUSIVE")
    return out.withColumns({**flags, "presence": ratio, "presence_status": status})


def device_continuity(df: DataFrame) -> DataFrame:
    """Whether a subscriber of several Spots keeps its device and SIM across them."""
    out = (
        prepared(df)
        .groupBy("subscriber_number")
        .agg(
            F.countDistinct("spot_id").alias("spots_seen"),
            n_distinct(F.when(I.device_family("imei") != "", I.device_family("imei"))).alias("devices"),
            n_distinct(filled("imsi")).alias("sims"),
        )
        .where("spots_seen >= 2")
    )
    d, s = F.col("devices"), F.col("sims")
    kind = (
        F.when((d == 0) & (s == 0), "NOT_AVAILABLE")
        .when((d <= 1) & (s <= 1), "SAME_DEVICE_AND_SIM")
        .when((d > 1) & (s <= 1), "DEVICE_CHANGED")
        .when((d <= 1) & (s > 1), "SIM_CHANGED")
        .otherwise("DEVICE_AND_SIM_CHANGED")
    )
    sure = F.when((d == 1) & (s == 1), "HIGH").when((d >= 1) | (s >= 1), "MEDIUM").otherwise("LOW")
    return out.withColumns({"continuity": kind, "confidence": sure})


def shared_across(df: DataFrame, identifier: str) -> DataFrame:
    """Identifiers seen on two Spots or more."""
    rows = prepared(df).where(F.col(identifier) != "")
    return (
        rows.groupBy(identifier)
        .agg(
            F.countDistinct("spot_id").alias("spots_seen"),
            F.countDistinct("subscriber_number").alias("subscribers"),
            F.count("*").alias("events"),
            joined("spot_id").alias("spots"),
        )
        .where("spots_seen >= 2")
    )


def sequence(df: DataFrame) -> DataFrame:
    """Changes of Spot between consecutive events of a subscriber, with the gap in minutes."""
    rows = prepared(df).where("call_datetime is not null")
    w = Window.partitionBy("subscriber_number").orderBy("call_datetime", "event_id")
    rows = rows.withColumns({"from_spot": F.lag("spot_id").over(w), "from_time": F.lag("call_datetime").over(w)})
    gap = F.round(F.timestamp_diff("MICROSECOND", F.col("from_time"), F.col("call_datetime")) / 6e7, 2)
    return rows.where("from_spot <> spot_id").select(
        "subscriber_number", "from_spot", F.col("spot_id").alias("to_spot"), "from_time", F.col("call_datetime").alias("to_time"), gap.alias("gap_minutes")
    )


def spot_leads(df: DataFrame, rare_events: int = 2, short_minutes: float = 30.0) -> DataFrame:
    """Per Spot and subscriber: signals, score (0 to 100), and whether it is a lead.

    A lead needs a score of 30 and two signals or several SIMs. Signals: rare at the Spot, short span, several Spots,
    verified device change, and night hours in most events.
    """
    rows = prepared(df)
    w = Window.partitionBy("subscriber_number")
    out = rows.groupBy("spot_id", "subscriber_number").agg(
        F.count("*").alias("events"),
        F.min("call_datetime").alias("first_seen"),
        F.max("call_datetime").alias("last_seen"),
        n_distinct(F.when(I.device_family("imei") != "", I.device_family("imei"))).alias("devices"),
        n_distinct(filled("imsi")).alias("sims"),
        n_if(F.col("call_datetime").isNotNull() & night("call_datetime")).alias("night_events"),
    )
    out = out.withColumns(
        {"spots_seen": F.count("*").over(w), "first_spot": F.min(F.struct(F.col("first_seen").isNull(), "first_seen", "spot_id")).over(w)["spot_id"]}
    )
    span = F.timestamp_diff("MICROSECOND", F.col("first_seen"), F.col("last_seen")) / 6e7
    flags = {
        "rare": F.col("events") <= rare_events,
        "short": F.coalesce(span <= short_minutes, F.lit(False)),
        "cross": F.col("spots_seen") >= 2,
        "device": F.col("devices") >= 2,
        "sim": F.col("sims") >= 2,
        "dark": 2 * F.col("night_events") > F.col("events"),
    }
    out = out.withColumns(flags)
    c = F.col
    points = (
        (c("rare"), 5), (c("short"), 5), (c("cross"), 5), (c("device"), 15), (c("sim"), 15),
        (c("rare") & c("short"), 15), (c("cross") & c("rare"), 15), (c("cross") & c("device"), 15), (c("dark") & c("rare"), 10),
    )
    score = F.lit(0)
    for cond, p in points:
        score = score + F.when(cond, p).otherwise(0)
    signals = sum((c(x).cast("int") for x in ("short", "cross", "device", "dark")), c("rare").cast("int"))
    out = out.withColumns({"score": F.least(score, F.lit(100)), "signals": signals})
    level = F.when(c("score") >= 70, "HIGH").when(c("score") >= 50, "MEDIUM_HIGH").when(c("score") >= 30, "MEDIUM").otherwise("LOW")
    lead = (c("score") >= 30) & ((c("signals") >= 2) | c("sim"))
    return out.withColumns({"priority_level": level, "is_lead": lead}).select(
        "spot_id", "subscriber_number", "events", "spots_seen", "first_spot", "devices", "sims", "night_events", "score", "signals", "priority_level", "is_lead"
    )
