"""Tower dumps: summaries, shared identities, movement between searched cells, review indicators.

Blank identifiers count as a value here where the counts are over raw text, as the summaries of a dump define it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identifiers as I
from .common import filled, joined, matrix, n_distinct, n_if, night, total


def summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_events"),
        n_distinct(filled("subscriber_number")).alias("unique_subscribers"),
        n_distinct(filled("searched_cell_id")).alias("unique_cells"),
        n_distinct(filled("operator")).alias("unique_operators"),
        n_distinct(filled("imei")).alias("unique_imei"),
        n_distinct(filled("imsi")).alias("unique_imsi"),
        F.min("call_datetime").alias("first_seen"),
        F.max("call_datetime").alias("last_seen"),
    )


def _per(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(
        F.count("*").alias("total_events"),
        n_distinct(filled("subscriber_number")).alias("unique_subscribers"),
        n_distinct(filled("imei")).alias("unique_imei"),
        F.min("call_datetime").alias("first_seen"),
        F.max("call_datetime").alias("last_seen"),
    )


def operator_summary(df: DataFrame) -> DataFrame:
    return _per(df, F.coalesce(filled("operator"), F.lit("unknown")), "operator")


def cell_summary(df: DataFrame) -> DataFrame:
    return _per(df.where(I.text("searched_cell_id") != ""), I.text("searched_cell_id"), "searched_cell_id")


def call_type_summary(df: DataFrame) -> DataFrame:
    c = df.groupBy(F.coalesce(filled("call_type"), F.lit("unknown")).alias("call_type")).agg(F.count("*").alias("total_events"))
    return c.withColumn("share_percent", F.round(100.0 * F.col("total_events") / F.sum("total_events").over(Window.partitionBy()), 2))


def subscriber_summary(df: DataFrame) -> DataFrame:
    rows = df.withColumn("subscriber_number", I.text("subscriber_number")).where("subscriber_number <> ''")
    return rows.groupBy("subscriber_number").agg(
        F.count("*").alias("total_events"),
        F.min("call_datetime").alias("first_seen"),
        F.max("call_datetime").alias("last_seen"),
        n_distinct(F.to_date("call_datetime")).alias("active_days"),
        n_distinct(I.text("searched_cell_id")).alias("unique_cells"),
        n_distinct(I.text("operator")).alias("unique_operators"),
        n_distinct(I.text("imei")).alias("unique_imei"),
        n_distinct(I.text("imsi")).alias("unique_imsi"),
        n_distinct(I.text("other_party")).alias("unique_other_parties"),
        F.coalesce(F.round(total("call_duration")), F.lit(0.0)).cast("long").alias("total_duration_seconds"),
        n_if(I.text("call_type") == "incoming").alias("incoming_calls"),
        n_if(I.text("call_type") == "outgoing").alias("outgoing_calls"),
        n_if(I.text("call_type") == "smsin").alias("incoming_sms"),
        n_if(I.text("call_type") == "smsout").alias("outgoing_sms"),
    )


def repeat_visitors(df: DataFrame, minimum_events: int = 2) -> DataFrame:
    return subscriber_summary(df).where(F.col("total_events") >= max(minimum_events, 2))


def frequent_visitors(df: DataFrame, top_n: int = 100) -> DataFrame:
    order = [F.desc("total_events"), F.desc("unique_cells"), F.desc("active_days"), F.asc("subscriber_number")]
    return subscriber_summary(df).orderBy(*order).limit(max(top_n, 1))


def identifier_summary(df: DataFrame, identifier: str) -> DataFrame:
    rows = df.withColumn(identifier, I.text(identifier)).where(F.col(identifier) != "")
    return rows.groupBy(identifier).agg(
        F.count("*").alias("total_events"),
        n_distinct(I.text("subscriber_number")).alias("unique_subscribers"),
        n_distinct(I.text("searched_cell_id")).alias("unique_cells"),
        n_distinct(I.text("operator")).alias("unique_operators"),
        F.min("call_datetime").alias("first_seen"),
        F.max("call_datetime").alias("last_seen"),
    )


def shared_identifiers(df: DataFrame, identifier: str, minimum: int = 2) -> DataFrame:
    """Identifiers seen with at least ``minimum`` subscribers, and who they are."""
    rows = df.withColumn(identifier, I.text(identifier)).where(F.col(identifier) != "")
    return (
        rows.groupBy(identifier)
        .agg(
            F.count("*").alias("total_events"),
            n_distinct(filled("subscriber_number")).alias("unique_subscribers"),
            n_distinct(filled("searched_cell_id")).alias("unique_cells"),
            joined("subscriber_number").alias("subscribers"),
            joined("searched_cell_id").alias("cells"),
        )
        .where(F.col("unique_subscribers") >= minimum)
    )


def across(df: DataFrame, column: str, minimum: int = 2) -> DataFrame:
    """Subscribers seen with at least ``minimum`` values of a column (cells, operators)."""
    rows = df.withColumn("subscriber_number", I.text("subscriber_number")).where("subscriber_number <> ''")
    return (
        rows.groupBy("subscriber_number")
        .agg(F.count("*").alias("total_events"), n_distinct(filled(column)).alias("n_values"), joined(column).alias("all_values"))
        .where(F.col("n_values") >= minimum)
    )


def subscriber_cell_matrix(df: DataFrame, cells: list[str]) -> DataFrame:
    return matrix(df.where(I.text("subscriber_number") != ""), "subscriber_number", "searched_cell_id", cells)


def hourly(df: DataFrame) -> DataFrame:
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    seen = df.where("call_datetime is not null").groupBy(F.hour("call_datetime").alias("hour")).agg(
        F.count("*").alias("n"), n_distinct(filled("subscriber_number")).alias("s")
    )
    return hours.join(seen, "hour", "left").select(
        "hour", F.coalesce("n", F.lit(0)).alias("total_events"), F.coalesce("s", F.lit(0)).alias("unique_subscribers")
    )


def daily(df: DataFrame) -> DataFrame:
    return df.where("call_datetime is not null").groupBy(F.to_date("call_datetime").alias("date")).agg(
        F.count("*").alias("total_events"), n_distinct(filled("subscriber_number")).alias("unique_subscribers")
    )


def night_events(df: DataFrame, start_hour: int = 22, end_hour: int = 6) -> DataFrame:
    return df.where(F.col("call_datetime").isNotNull() & night("call_datetime", start_hour, end_hour))


def movements(df: DataFrame) -> DataFrame:
    """Changes of the searched cell between consecutive events of a subscriber, with the gap in seconds."""
    rows = df.withColumns({"subscriber_number": I.text("subscriber_number"), "searched_cell_id": I.text("searched_cell_id")}).where(
        "subscriber_number <> '' and searched_cell_id <> '' and call_datetime is not null"
    )
    w = Window.partitionBy("subscriber_number").orderBy("call_datetime", "searched_cell_id", "event_id")
    rows = rows.withColumns({"from_cell_id": F.lag("searched_cell_id").over(w), "from_datetime": F.lag("call_datetime").over(w)})
    gap = F.expr("timestampdiff(MICROSECOND, from_datetime, call_datetime) / 1e6")
    return rows.where("from_cell_id <> searched_cell_id").select(
        "subscriber_number",
        "from_cell_id",
        F.col("searched_cell_id").alias("to_cell_id"),
        "from_datetime",
        F.col("call_datetime").alias("to_datetime"),
        gap.alias("time_gap_seconds"),
        "operator",
        "source_file",
    )


def transition_summary(df: DataFrame) -> DataFrame:
    return movements(df).groupBy("from_cell_id", "to_cell_id").agg(
        F.count("*").alias("transition_events"),
        F.countDistinct("subscriber_number").alias("unique_subscribers"),
        F.round(F.min("time_gap_seconds"), 7).alias("minimum_gap_seconds"),
        F.round(F.median("time_gap_seconds"), 7).alias("median_gap_seconds"),
    )


def indicators(df: DataFrame) -> DataFrame:
    """Five rules as rows ``(indicator, entity, severity, details)``; the volume threshold is the 99th percentile, 25 at least."""

    def rule(rows: DataFrame, name: str, entity: str, severity: str, details: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("indicator"), F.col(entity).alias("entity"), F.lit(severity).alias("severity"), details.alias("details"))

    text = lambda *p: F.concat(*[F.lit(x) if i % 2 == 0 else F.col(x).cast("string") for i, x in enumerate(p)])
    subs = subscriber_summary(df)
    edge = subs.agg(F.greatest(F.percentile("total_events", 0.99), F.lit(25.0)).alias("edge"))
    high = subs.where(F.col("total_events") >= edge.scalar())
    return (
        rule(shared_identifiers(df, "imei"), "SHARED_IMEI", "imei", "HIGH", text("IMEI linked with ", "unique_subscribers", " subscribers; cells=", "unique_cells"))
        .union(rule(shared_identifiers(df, "imsi"), "SHARED_IMSI", "imsi", "HIGH", text("IMSI linked with ", "unique_subscribers", " subscriber numbers.")))
        .union(rule(across(df, "searched_cell_id"), "MULTI_CELL_PRESENCE", "subscriber_number", "MEDIUM", text("Subscriber found in ", "n_values", " searched cells; events=", "total_events")))
        .union(rule(across(df, "operator"), "MULTI_OPERATOR_IDENTITY", "subscriber_number", "MEDIUM", text("Same normalized number appeared in ", "n_values", " operators.")))
        .union(rule(high, "HIGH_EVENT_VOLUME", "subscriber_number", "LOW", text("Subscriber has ", "total_events", " events.")))
    )
