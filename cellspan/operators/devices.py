"""One device identifier over call, session and IP records; values that several devices share; a timeline of all sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as I
from .common import check_rows, filled, joined, n_distinct, n_if, total


def matches(df: DataFrame, identifier: str, column: str = "imei") -> DataFrame:
    """Rows of a device with how they match: the exact identifier, or the same first 14 digits."""
    rel = I.match_relation(F.lit(identifier), column)
    return df.withColumn("match_relation", rel).where("match_relation in ('EXACT', 'BASE14_MATCH', 'SAME_BASE14')")


def call_bundle(df: DataFrame, identifier: str) -> dict[str, DataFrame]:
    """Targets, SIMs, contacts, towers, timeline, indicators and quality of a device's call records."""
    m = matches(df, identifier)
    span = (F.count("*").alias("events"), F.min("call_datetime").alias("first_seen"), F.max("call_datetime").alias("last_seen"))
    per = lambda rows, *keys: rows.groupBy(*keys).agg(*span, n_distinct(filled("imsi")).alias("sims"))
    contact = m.withColumn("contact", I.contact_key("other_party")).where("contact <> ''").withColumn("category", I.contact_category("other_party"))
    return {
        "targets": per(m, "target", "source_file"),
        "sims": per(m.where(filled("imsi").isNotNull()), "imsi"),
        "contacts": per(contact, "contact", "category"),
        "towers": per(m.where(I.valid_cell("first_cell_id")), "first_cell_id"),
        "timeline": m.select("call_datetime", "event_id", "target", "other_party", "call_type", "first_cell_id", "imei", "match_relation"),
        "indicators": indicators(m),
        "quality": check_rows(
            m,
            {
                "missing_time": F.col("call_datetime").isNull(),
                "missing_imsi": filled("imsi").isNull(),
                "invalid_cell": ~I.valid_cell("first_cell_id"),
                "unknown_contact": I.contact_category("other_party") == "unknown_contact",
            },
        ),
    }


def rule_rows(m: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``(indicator, value)`` for each rule ``name: (value, condition)`` that holds, from one aggregation; ``NO_INDICATOR``
    with the number of rows where none does. A condition reads the value of its own rule as ``v``."""
    one = m.agg(F.count("*").alias("events"), *[v.cast("long").alias(f"r{i}") for i, (v, _) in enumerate(rules.values())])
    row = lambda name, v: F.struct(F.lit(name).alias("indicator"), v.alias("value"))
    rule = lambda i, name, cond: F.transform(F.filter(F.array(F.col(f"r{i}")), lambda v: cond(v)), lambda v: row(name, v))
    held = [rule(i, name, cond) for i, (name, (_, cond)) in enumerate(rules.items())]
    all_, none = F.flatten(F.array(*held)), F.array(row("NO_INDICATOR", F.col("events")))
    return one.select(F.inline(F.when(F.size(all_) > 0, all_).otherwise(none)))


def several(c: str) -> tuple[Column, Column]:
    """More than one value of a column that is not blank."""
    return n_distinct(filled(c)), lambda v: v > 1


def indicators(m: DataFrame) -> DataFrame:
    """Rule rows about one device's call records; a row that says so where no rule holds."""
    return rule_rows(m, {"MULTIPLE_SUBSCRIBERS": several("subscriber_number"), "MULTIPLE_SIMS": several("imsi"), "IDENTIFIER_VARIANTS": several("imei")})


def session_indicators(m: DataFrame, identifier: str) -> DataFrame:
    """Rule rows about one device's packet sessions."""
    return rule_rows(
        m,
        {
            "MULTIPLE_SUBSCRIBERS": several("subscriber_number"),
            "MULTIPLE_SIMS": several("imsi"),
            "MULTIPLE_FILES": several("source_file"),
            "MULTIPLE_SPOTS": several("spot_id"),
            "VOLUME_MISMATCH": (n_if(F.col("volume_mismatch")), lambda v: v > 0),
            "FULL_16_DIGITS": (F.count("*"), lambda v: F.lit(len(identifier) == 16)),
        },
    )


def ip_indicators(m: DataFrame, identifier: str) -> DataFrame:
    """Rule rows about one device's IP events; ``REPORT_QUERY_MATCH`` counts rows that only the report's query matches."""
    rules = {
        "MULTIPLE_SUBSCRIBERS": several("subscriber_number"),
        "MULTIPLE_SIMS": several("imsi"),
        "MULTIPLE_FILES": several("source_file"),
        "FULL_16_DIGITS": (F.count("*"), lambda v: F.lit(len(identifier) == 16)),
    }
    if "match_basis" in m.columns:
        rules["REPORT_QUERY_MATCH"] = (n_if(F.col("match_basis") == "QUERY_SCOPE"), lambda v: v > 0)
    return rule_rows(m, rules)


def session_quality(m: DataFrame) -> DataFrame:
    """Checks of one device's packet sessions: records for which each holds."""
    blank = lambda c: filled(c).isNull()
    return check_rows(
        m,
        {
            "matched_sessions": F.lit(True),
            "invalid_time": ~F.coalesce("session_time_valid", F.lit(False)),
            "missing_subscriber": blank("subscriber_number"),
            "missing_imsi": I.imsi("imsi") == "",
            "missing_ip": blank("ipv4_address") & blank("ipv6_address"),
            "missing_cell": blank("searched_cell_id"),
            "missing_volume": F.col("downlink_volume").isNull() | F.col("uplink_volume").isNull() | F.col("total_volume").isNull(),
            "volume_mismatch": F.col("volume_mismatch"),
            "zero_volume": F.col("is_zero_volume"),
            "imei_of_16_digits": F.length(I.digits("imei")) == 16,
        },
    )


def ip_quality(m: DataFrame) -> DataFrame:
    """Checks of one device's IP events: records for which each holds."""
    return check_rows(
        m,
        {
            "matched_records": F.lit(True),
            "missing_time": F.col("event_time").isNull(),
            "missing_subscriber": filled("subscriber_number").isNull(),
            "missing_imsi": I.imsi("imsi") == "",
            "missing_source_ip": filled("source_ip").isNull(),
            "missing_destination_ip": filled("destination_ip").isNull(),
            "exact_observed": F.col("match_relation") == "EXACT",
            "imei_of_16_digits": F.length(I.digits("imei")) == 16,
        },
    )


def session_bundle(df: DataFrame, identifier: str) -> dict[str, DataFrame]:
    m = matches(df, identifier)
    span = (F.count("*").alias("sessions"), total("total_volume", zero=True).alias("total_volume"))
    return {
        "subscribers": m.where(filled("subscriber_number").isNotNull()).groupBy("subscriber_number", "identifier_type").agg(*span),
        "sims": m.where(filled("imsi").isNotNull()).groupBy("imsi").agg(*span),
        "cells": m.where(I.valid_cell("searched_cell_id")).groupBy("searched_cell_id").agg(*span),
        "timeline": m.select("session_start", "event_id", "subscriber_number", "searched_cell_id", "imei", "match_relation"),
        "indicators": session_indicators(m, identifier),
        "quality": session_quality(m),
    }


def ip_bundle(df: DataFrame, identifier: str) -> dict[str, DataFrame]:
    m = matches(df, identifier)
    span = (F.count("*").alias("events"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))
    return {
        "subscribers": m.where(filled("subscriber_number").isNotNull()).groupBy("subscriber_number").agg(*span),
        "endpoints": m.where(filled("destination_ip").isNotNull()).groupBy("destination_ip", "destination_port").agg(*span),
        "timeline": m.select("event_time", "event_id", "subscriber_number", "destination_ip", "searched_cell_id", "imei", "match_relation"),
        "indicators": ip_indicators(m, identifier),
        "quality": ip_quality(m),
    }


def unified_timeline(calls: DataFrame, sessions: DataFrame, ips: DataFrame, identifier: str) -> DataFrame:
    """Events of a device from all three sources in one schema."""

    def part(df: DataFrame, source: str, time: str, detail: Column) -> DataFrame:
        m = matches(df, identifier)
        return m.select(
            F.lit(source).alias("source"), F.col(time).alias("event_time"), "event_id", I.text("subscriber_number").alias("subscriber_number"), I.text("searched_cell_id").alias("cell"), detail.alias("detail"), "match_relation"
        )

    return (
        part(calls, "CDR", "call_datetime", F.concat_ws(" ", I.text("call_type"), I.text("other_party")))
        .unionByName(part(sessions, "GPRS", "session_start", I.text("ipv4_address")))
        .unionByName(part(ips, "IPDR", "event_time", I.endpoint("destination_ip", "destination_port")))
    )


def associated_identities(timeline: DataFrame) -> DataFrame:
    return timeline.where("subscriber_number <> ''").groupBy("subscriber_number").agg(
        F.count("*").alias("events"), joined("source").alias("sources"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen")
    )


def source_status(timeline: DataFrame) -> DataFrame:
    """One row per source, also those without an event: FOUND or NO_DATA."""
    spark = timeline.sparkSession
    sources = spark.createDataFrame([("CDR",), ("GPRS",), ("IPDR",)], "source string")
    got = timeline.groupBy("source").agg(F.count("*").alias("events"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))
    return F.broadcast(sources).join(got, "source", "left").select(
        "source", F.coalesce("events", F.lit(0)).alias("events"), "first_seen", "last_seen", F.when(F.col("events") > 0, "FOUND").otherwise("NO_DATA").alias("status")
    )


def shared_values(df: DataFrame, value: Column, name: str, minimum: int = 2, time: str = "call_datetime") -> DataFrame:
    """Values that at least ``minimum`` device families (first 14 digits) have in common."""
    rows = df.withColumns({"_family": I.device_family("imei"), name: value}).where(f"_family <> '' and `{name}` is not null and `{name}` <> ''")
    return (
        rows.groupBy(name)
        .agg(
            F.countDistinct("_family").alias("devices"),
            F.count("*").alias("events"),
            joined("_family").alias("device_families"),
            F.min(time).alias("first_seen"),
            F.max(time).alias("last_seen"),
        )
        .where(F.col("devices") >= minimum)
    )


def shared_contacts(df: DataFrame, categories: tuple[str, ...] = ("human_mobile",)) -> DataFrame:
    return shared_values(df.where(I.contact_category("other_party").isin(*categories)), I.contact_key("other_party"), "contact")


def tower_rows(df: DataFrame) -> DataFrame:
    """First and last cell of an event as rows, each once; broken ids and bare network codes left out."""
    cells = F.explode(F.array_distinct(F.array_compact(F.array(filled("first_cell_id"), filled("last_cell_id")))))
    return df.withColumn("cell", cells).where(I.valid_cell("cell") & ~I.plmn_only("cell"))


def shared_towers(df: DataFrame) -> DataFrame:
    return shared_values(tower_rows(df), F.col("cell"), "cell")


def device_overview(df: DataFrame, identifiers: list[str]) -> DataFrame:
    """Every identifier asked for with what was found for its family."""
    asked = df.sparkSession.createDataFrame([(i,) for i in identifiers], "query_identifier string").withColumn("_family", I.device_family("query_identifier"))
    got = df.withColumn("_family", I.device_family("imei")).join(F.broadcast(asked.select("_family").distinct()), "_family", "left_semi")
    got = got.groupBy("_family").agg(
        F.count("*").alias("events"),
        n_distinct(filled("subscriber_number")).alias("subscribers"),
        n_distinct(filled("imsi")).alias("sims"),
        n_if(~I.valid_cell("first_cell_id")).alias("invalid_cells"),
    )
    out = asked.join(got, "_family", "left").fillna(0, ["events", "subscribers", "sims", "invalid_cells"])
    return out.select("query_identifier", F.col("_family").alias("device_family"), "events", "subscribers", "sims", "invalid_cells", F.when(F.col("events") > 0, "FOUND").otherwise("NO_DATA").alias("status"))
