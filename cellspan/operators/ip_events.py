"""IP-detail events: allocations counted once, addresses, ports and endpoints, cells, query checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as I
from .common import check_rows, filled, joined, metric_rows, n_distinct, n_if, total

FIRST = ("event_time", "event_id")


def first_of(c: str) -> Column:
    """Value of the earliest event of a group."""
    return F.min_by(c, F.struct(*FIRST)).alias(c)


def allocations(df: DataFrame, key: str = "allocation_volume_key") -> DataFrame:
    """One row per allocation with the attributes of its earliest event: volumes repeat on every event of one."""
    rows = df.where(filled(key).isNotNull())
    attributes = ("subscriber_number", "allocation_start", "allocation_end", "source_ip", "uplink_volume", "downlink_volume", "total_volume")
    return rows.groupBy(key).agg(
        *[first_of(c) for c in attributes], F.count("*").alias("events"), n_distinct(filled("searched_cell_id")).alias("cells")
    )


def volume_variants(df: DataFrame) -> DataFrame:
    """Allocations by key, with how many different volumes were reported for each."""
    rows = df.where(filled("allocation_key").isNotNull())
    return rows.groupBy("allocation_key").agg(
        first_of("subscriber_number"), first_of("total_volume"), F.count("*").alias("events"), n_distinct("total_volume").alias("volume_variants")
    )


def subscriber_summary(df: DataFrame) -> DataFrame:
    """Per subscriber, with volumes of its allocations counted once each."""
    rows = df.where(filled("subscriber_number").isNotNull())
    per = rows.groupBy("subscriber_number").agg(
        F.count("*").alias("events"),
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
        n_distinct(filled("searched_cell_id")).alias("cells"),
        n_distinct(filled("imei")).alias("imei_count"),
        n_distinct(filled("destination_ip")).alias("destinations"),
    )
    vol = allocations(df).groupBy("subscriber_number").agg(F.count("*").alias("allocations"), total("total_volume").alias("total_volume"))
    return per.join(vol, "subscriber_number", "left").fillna(0, ["allocations", "total_volume"])


def _per(df: DataFrame, *keys: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("events"),
        n_distinct(filled("subscriber_number")).alias("subscribers"),
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
    )


def identity_summary(df: DataFrame, identity: str) -> DataFrame:
    return _per(df.where(filled(identity).isNotNull()), F.col(identity))


def ip_summary(df: DataFrame, column: str) -> DataFrame:
    version = F.when(F.col(column).contains(":"), "IPv6").otherwise("IPv4")
    return _per(df.where(filled(column).isNotNull()), F.col(column), version.alias("ip_version"))


def port_summary(df: DataFrame) -> DataFrame:
    return _per(df.where("destination_port is not null"), F.col("destination_port"))


def endpoint_summary(df: DataFrame) -> DataFrame:
    return _per(df.where(filled("destination_ip").isNotNull()), I.endpoint("destination_ip", "destination_port").alias("endpoint"))


def cell_summary(df: DataFrame) -> DataFrame:
    same = I.cell_key("first_cell_id") == I.cell_key("last_cell_id")
    return df.where(filled("searched_cell_id").isNotNull()).groupBy("searched_cell_id").agg(
        F.count("*").alias("events"),
        n_distinct(filled("subscriber_number")).alias("subscribers"),
        n_if(same).alias("same_last_cell"),
        n_if(~same).alias("changed_last_cell"),
    )


def movement_summary(df: DataFrame) -> DataFrame:
    kind = I.cell_transition("first_cell_id", "last_cell_id", "searched_cell_id")
    return df.groupBy("first_cell_id", "last_cell_id", kind.alias("transition")).agg(F.count("*").alias("events"), n_distinct(filled("subscriber_number")).alias("subscribers"))


def cell_movement(df: DataFrame) -> DataFrame:
    rows = df.where(filled("subscriber_number").isNotNull())
    return rows.groupBy("subscriber_number", "first_cell_id", "last_cell_id").agg(
        F.count("*").alias("events"), F.bool_or(I.cell_key("first_cell_id") != I.cell_key("last_cell_id")).alias("changed")
    )


def hourly(df: DataFrame) -> DataFrame:
    t = "event_time"
    return df.where(f"{t} is not null").groupBy(F.to_date(t).alias("date"), F.hour(t).alias("hour")).agg(F.count("*").alias("events"), n_distinct(filled("subscriber_number")).alias("subscribers"))


def metrics(df: DataFrame) -> DataFrame:
    out = {"events": F.count("*")}
    for c in ("subscriber_number", "imei", "imsi", "source_ip", "destination_ip", "searched_cell_id", "allocation_key"):
        out[f"unique_{c}"] = n_distinct(filled(c))
    return metric_rows(df, out)


def quality(df: DataFrame) -> DataFrame:
    blank = lambda c: filled(c).isNull()
    outside = F.coalesce(~F.col("event_time").between(F.col("allocation_start"), F.col("allocation_end")), F.lit(False))
    return check_rows(
        df,
        {
            "missing_subscriber": blank("subscriber_number"),
            "missing_imei": blank("imei"),
            "missing_event_time": F.col("event_time").isNull(),
            "missing_destination_ip": blank("destination_ip"),
            "missing_port": F.col("destination_port").isNull(),
            "event_outside_allocation": outside,
            "allocation_end_before_start": F.coalesce(F.col("allocation_end") < F.col("allocation_start"), F.lit(False)),
            "invalid_cell": ~I.valid_cell("searched_cell_id"),
        },
    )


# What makes two rows of a case equal.
SAME_ROW = ("operator", "subscriber_number", "event_time", "allocation_start", "allocation_end", "source_ip", "source_port", "destination_ip", "destination_port", "charging_id", "source_file")


#: Columns that the checks of a case read.
CHECKED = tuple(dict.fromkeys((*SAME_ROW, "record_type", "session_duration_seconds", "source_ip_version", "destination_ip_version", "allocation_key", "uplink_volume", "downlink_volume")))


def case_checks(data: DataFrame, files: DataFrame) -> DataFrame:
    """``(check_name, rows, severity)`` over the records of a case (``sources.ip_detail``) and its files.

    Equal rows are counted by aggregation; an allocation has volume variants if its events state several volumes.
    """
    event = F.col("record_type") == "IPDR_EVENT"
    missing = lambda c: filled(c).isNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    outside = yes((F.col("event_time") < F.col("allocation_start")) | (F.col("event_time") > F.col("allocation_end")))
    checks = {
        "Normalized records": (F.lit(True), "INFO"),
        "Event rows with invalid/missing event time": (event & F.col("event_time").isNull(), "ERROR"),
        "Rows with invalid/missing allocation start": (F.col("allocation_start").isNull(), "WARNING"),
        "Rows with allocation end before start": (yes(F.col("allocation_end") < F.col("allocation_start")), "ERROR"),
        "Events outside allocation interval": (event & outside, "WARNING"),
        "Negative duration rows": (yes(F.col("session_duration_seconds") < 0), "WARNING"),
        "Zero duration rows": (yes(F.col("session_duration_seconds") == 0), "INFO"),
        "Rows missing subscriber/user ID": (missing("subscriber_number"), "WARNING"),
        "Rows missing source IP": (missing("source_ip"), "WARNING"),
        "Event rows missing destination IP": (event & missing("destination_ip"), "WARNING"),
        "Invalid source IP values": (F.col("source_ip_version") == "INVALID", "WARNING"),
        "Invalid destination IP values": (F.col("destination_ip_version") == "INVALID", "WARNING"),
    }
    names = list(checks)
    one = data.agg(*[F.count_if(checks[c][0]).alias(f"c{i}") for i, c in enumerate(names)])
    row = lambda name, n, severity: F.struct(F.lit(name).alias("check_name"), n.cast("long").alias("rows"), F.lit(severity).alias("severity"))
    plain = one.select(F.inline(F.array(*[row(c, F.col(f"c{i}"), checks[c][1]) for i, c in enumerate(names)])))
    equal = data.groupBy(*SAME_ROW).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    variants = data.groupBy("allocation_key").agg(n_distinct(F.struct("uplink_volume", "downlink_volume")).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    failed = files.agg(F.count_if(F.col("status") == "FAILED").alias("n"))
    rest = [
        failed.select(row("Files failed", F.col("n"), "ERROR").alias("r")),
        equal.select(row("Exact duplicate event/allocation rows", F.col("n"), "WARNING").alias("r")),
        variants.select(row("Allocation keys with multiple volume variants", F.col("n"), "WARNING").alias("r")),
    ]
    for r in rest:
        plain = plain.union(r.select("r.*"))
    return plain


def reverse_query(df: DataFrame, ip: str, port: int | None = None) -> DataFrame:
    """How the events of each file match an endpoint that was asked for: exactly, by address only, or not."""
    at = F.col("destination_ip") == ip
    full = at & (F.col("destination_port") == port) if port is not None else at
    kind = F.when(full, "IP_AND_PORT" if port is not None else "IP_ONLY").when(at, "IP_ONLY").otherwise("NO_MATCH")
    return df.groupBy("source_file", F.coalesce(kind, F.lit("NO_MATCH")).alias("match_status")).agg(F.count("*").alias("events"))


def presence_matrix(df: DataFrame, identity: str, files: list[str]) -> DataFrame:
    """Per identity: in which of the stated files it occurs."""
    flags = [F.max((F.col("source_file") == f).cast("int")).alias(f"file_{i + 1}") for i, f in enumerate(files)]
    return df.where(filled(identity).isNotNull()).groupBy(identity).agg(n_distinct("source_file").alias("files_seen"), F.count("*").alias("events"), *flags)


def cells_of(df: DataFrame) -> DataFrame:
    """Cell columns as rows, each cell once per source row."""
    cells = F.explode(F.array_distinct(F.array_compact(F.array(filled("searched_cell_id"), filled("first_cell_id"), filled("last_cell_id")))))
    return df.select("event_id", "subscriber_number", "imei", "event_time", "source_file", cells.alias("cell"))


def joined_first(c: str, limit: int = 10) -> Column:
    """The first distinct values in order, then dots where there are more."""
    s = F.array_sort(F.collect_set(filled(c)))
    return F.when(F.size(s) > limit, F.concat(F.array_join(F.slice(s, 1, limit), ", "), F.lit(", ..."))).otherwise(F.array_join(s, ", "))


def cell_values(df: DataFrame) -> DataFrame:
    return cells_of(df).where(I.valid_cell("cell")).groupBy("cell").agg(
        F.count("*").alias("events"), n_distinct(filled("subscriber_number")).alias("subscribers"), joined_first("subscriber_number").alias("first_subscribers")
    )


def scope_warning(df: DataFrame, start, end) -> DataFrame:
    """How much of all events a chosen window takes in, with a warning where that is most of them."""
    inside = (F.col("event_time") >= F.lit(start)) & (F.col("event_time") < F.lit(end))
    one = df.agg(F.count("*").alias("total_records"), n_if(inside).alias("selected_records"))
    share = F.round(100.0 * F.col("selected_records") / F.greatest(F.col("total_records"), F.lit(1)), 2)
    return one.withColumn("coverage_percent", share).withColumn(
        "warning", F.when(share >= 95, "WINDOW_COVERS_ALMOST_ALL").when(share >= 75, "WINDOW_COVERS_MOST").otherwise("NONE")
    )


def subscriber_lists(df: DataFrame) -> DataFrame:
    return df.where(filled("subscriber_number").isNotNull()).groupBy("subscriber_number").agg(joined("destination_ip", 500).alias("destinations"))
