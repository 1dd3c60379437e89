"""Packet sessions: summaries, duration bins, data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as I
from . import common
from .common import check_rows, filled, joined, metric_rows, n_distinct, n_if

#: Upper edges of the duration bins (right-closed), in seconds.
BINS = ((60, "0-1 min"), (300, "1-5 min"), (900, "5-15 min"), (1800, "15-30 min"), (3600, "30-60 min"), (7200, "1-2 h"))


def normalise(df: DataFrame) -> DataFrame:
    """Derived columns of a session: identifier type, validity of its times, and whether its volumes add up.

    Volumes match if total and the sum of both directions differ by at most 1, or a millionth of the sum.
    """
    parts = F.col("downlink_volume") + F.col("uplink_volume")
    apart = F.abs(F.col("total_volume") - parts) > F.greatest(F.lit(1.0), 1e-6 * F.abs(parts))
    return df.withColumns(
        {
            "identifier_type": I.session_identifier("subscriber_number"),
            "session_time_valid": F.coalesce((F.col("session_end") >= F.col("session_start")) & (F.col("session_duration_seconds") >= 0), F.lit(False)),
            "volume_fields_present": F.col("downlink_volume").isNotNull() & F.col("uplink_volume").isNotNull() & F.col("total_volume").isNotNull(),
            "volume_mismatch": F.coalesce(apart, F.lit(False)),
            "is_zero_volume": F.coalesce(F.col("total_volume") == 0, F.lit(False)),
        }
    )


def total(c: str) -> Column:
    return common.total(c, zero=True)


def summary(df: DataFrame) -> DataFrame:
    metrics: dict[str, Column] = {"total_sessions": F.count("*")}
    for c in ("subscriber_number", "imei", "imsi", "ipv4_address", "ipv6_address", "searched_cell_id"):
        metrics[f"unique_{c}"] = n_distinct(filled(c))
    metrics |= {
        "longest_session_seconds": F.max("session_duration_seconds").cast("long"),
        "invalid_time_rows": n_if(~F.col("session_time_valid")),
        "missing_volume_rows": n_if(~F.col("volume_fields_present")),
        "volume_mismatch_rows": n_if(F.col("volume_mismatch")),
        "non_standard_subscribers": n_if(F.col("identifier_type") != "MSISDN"),
        "zero_volume_sessions": n_if(F.col("is_zero_volume")),
    }
    return metric_rows(df, metrics)


def subscriber_summary(df: DataFrame) -> DataFrame:
    rows = df.where(filled("subscriber_number").isNotNull())
    return rows.groupBy("subscriber_number").agg(
        F.count("*").alias("sessions"),
        F.min("session_start").alias("first_seen"),
        F.max("session_end").alias("last_seen"),
        total("session_duration_seconds").alias("duration_seconds"),
        total("total_volume").alias("total_volume"),
        total("downlink_volume").alias("downlink_volume"),
        total("uplink_volume").alias("uplink_volume"),
        n_distinct(filled("searched_cell_id")).alias("unique_cells"),
        n_distinct(filled("imei")).alias("unique_imei"),
        n_distinct(filled("imsi")).alias("unique_imsi"),
        n_distinct(filled("ipv4_address")).alias("unique_ipv4"),
        joined("technology").alias("technologies"),
    )


def identity_summary(df: DataFrame, identity: str) -> DataFrame:
    return df.where(filled(identity).isNotNull()).groupBy(identity).agg(
        F.count("*").alias("sessions"),
        n_distinct(filled("subscriber_number")).alias("subscribers"),
        n_distinct(filled("searched_cell_id")).alias("cells"),
        total("total_volume").alias("total_volume"),
        F.min("session_start").alias("first_seen"),
        F.max("session_start").alias("last_seen"),
    )


def ip_summary(df: DataFrame) -> DataFrame:
    """IPv4 and IPv6 addresses in one table; a session counts for each that it has."""
    both = F.array(
        F.struct(F.lit("IPv4").alias("version"), filled("ipv4_address").alias("ip")), F.struct(F.lit("IPv6").alias("version"), filled("ipv6_address").alias("ip"))
    )
    rows = df.withColumn("a", F.explode(both)).where("a.ip is not null")
    return rows.groupBy(F.col("a.version").alias("ip_version"), F.col("a.ip").alias("ip_address")).agg(
        F.count("*").alias("sessions"), n_distinct(filled("subscriber_number")).alias("subscribers"), total("total_volume").alias("total_volume")
    )


def duration_bin(c: str = "session_duration_seconds") -> Column:
    """Bin and its order; a missing duration has a bin of its own."""
    out = F.when(F.col(c).isNull() | (F.col(c) < 0), F.struct(F.lit(99).alias("bin_order"), F.lit("unknown").alias("bin")))
    for i, (edge, name) in enumerate(BINS):
        out = out.when(F.col(c) <= edge, F.struct(F.lit(i).alias("bin_order"), F.lit(name).alias("bin")))
    return out.otherwise(F.struct(F.lit(len(BINS)).alias("bin_order"), F.lit("over 2 h").alias("bin")))


def duration_bins(df: DataFrame) -> DataFrame:
    return df.groupBy(duration_bin().alias("b")).agg(F.count("*").alias("sessions"), total("total_volume").alias("total_volume")).select("b.bin_order", "b.bin", "sessions", "total_volume")


def counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(filled(column), F.lit("UNKNOWN")).alias(column)).agg(F.count("*").alias("records"))


def hourly(df: DataFrame, time: str = "session_start") -> DataFrame:
    return df.where(F.col(time).isNotNull()).groupBy(F.hour(time).alias("hour")).agg(F.count("*").alias("records"), n_distinct(filled("subscriber_number")).alias("subscribers"))


def quality(df: DataFrame) -> DataFrame:
    blank = lambda c: filled(c).isNull()
    return check_rows(
        df,
        {
            "invalid_session_time": ~F.col("session_time_valid"),
            "missing_volume_fields": ~F.col("volume_fields_present"),
            "volume_mismatch": F.col("volume_mismatch"),
            "non_standard_subscriber": F.col("identifier_type") != "MSISDN",
            "zero_volume": F.col("is_zero_volume"),
            "missing_ipv4": blank("ipv4_address"),
            "missing_ipv6": blank("ipv6_address"),
            "missing_imei": blank("imei"),
            "missing_imsi": blank("imsi"),
        },
    )


def network_summary(df: DataFrame) -> DataFrame:
    """Per technology, plan and roaming circle; missing values are groups too."""
    return df.groupBy("technology", "pre_post", "roaming_circle").agg(
        F.count("*").alias("sessions"), n_distinct(filled("subscriber_number")).alias("subscribers"), total("total_volume").alias("total_volume")
    )
