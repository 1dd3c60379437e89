"""Sheets of one subject's calls, review lists over several tables, and search across them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identifiers as I
from .common import filled, n_distinct, n_if

# What stands for a missing circle and provider, and severities of alerts.
HOME_CIRCLE, NO_PROVIDER = "Home Circle", "Unknown"


def _voice(df: DataFrame) -> DataFrame:
    """``df`` with flags of outgoing and incoming voice and SMS, and the duration of voice in decimals."""
    t = I.call_type("call_type")
    d = F.coalesce("call_duration", F.lit(0.0)).cast("decimal(28,6)")
    sms_in, sms_out = t.rlike("smsin|sms_mt"), t.rlike("smsout|sms_mo")
    return df.withColumns({"_out": I.is_outgoing_voice("call_type"), "_in": I.is_incoming_voice("call_type"), "_sms_in": sms_in, "_sms_out": sms_out, "_d": d})


def _seconds(cond: Column) -> Column:
    zero = F.lit(0).cast("decimal(28,6)")
    return F.round(F.sum(F.when(cond, F.col("_d")).otherwise(zero)), 4).cast("double")


def _counts() -> list[Column]:
    out, in_ = F.col("_out"), F.col("_in")
    return [
        n_if(out | in_).alias("voice_calls"),
        _seconds(out | in_).alias("voice_seconds"),
        n_if(out).alias("out_calls"),
        _seconds(out).alias("out_seconds"),
        n_if(in_).alias("in_calls"),
        _seconds(in_).alias("in_seconds"),
        n_if(F.col("_sms_out")).alias("out_sms"),
        n_if(F.col("_sms_in")).alias("in_sms"),
    ]


def contact_sheet(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per other party: events, voice and SMS by direction, seconds of voice, and their whole-second mean (half up)."""
    rows = _voice(df.where(filled("other_party").isNotNull()))
    out = rows.groupBy(*by, "other_party").agg(
        F.count("*").alias("total_events"), F.min("call_datetime").alias("first_call"), F.max("call_datetime").alias("last_call"), *_counts()
    )
    mean = F.when(F.col("voice_calls") > 0, F.floor(F.col("voice_seconds") / F.col("voice_calls") + 0.5)).otherwise(F.lit(0))
    return out.withColumn("average_voice_seconds", mean.cast("long"))


def cell_sheet(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per valid first cell: events, voice and SMS by direction, and how many parties and days."""
    rows = _voice(df.where(I.valid_cell("first_cell_id")))
    return rows.groupBy(*by, "first_cell_id").agg(
        F.count("*").alias("total_events"), *_counts(), n_distinct(filled("other_party")).alias("parties"), n_distinct(F.to_date("call_datetime")).alias("active_days")
    )


def imei_sheet(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per observed IMEI: voice by direction with seconds, and SMS."""
    rows = _voice(df.where(filled("imei").isNotNull()))
    return rows.groupBy(*by, "imei").agg(*_counts(), n_if(F.col("_sms_out") | F.col("_sms_in")).alias("sms"))


def roaming_sheet(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Records by roaming circle and provider; a missing circle is the home circle."""
    circle = F.coalesce(filled("roaming_circle"), F.lit(HOME_CIRCLE)).alias("circle")
    return df.groupBy(*by, circle, F.coalesce(filled("operator"), F.lit(NO_PROVIDER)).alias("provider")).agg(F.count("*").alias("records"))


def moving_calls(df: DataFrame) -> DataFrame:
    """Voice calls that end in another cell than they began in."""
    moved = F.col("first_cell_id") != F.col("last_cell_id")
    return df.where(moved & (I.is_incoming_voice("call_type") | I.is_outgoing_voice("call_type")))


#: Kinds of identifiers: which columns hold them.
IDENTIFIER_COLUMNS = {
    "phone": ("target", "subscriber_number", "other_party", "a_party", "b_party"),
    "imei": ("imei",),
    "imsi": ("imsi",),
    "cell_id": ("first_cell_id", "last_cell_id", "searched_cell_id"),
}


def related_records(tables: dict[str, DataFrame], identifier: str, kind: str = "phone", key: str = "event_id", limit: int = 1000) -> DataFrame:
    """``(dataset, key, matched_column, record)``: rows of several tables that hold an identifier in any of its columns.

    Compared by digits, phones by the last ten. ``record`` is the row as JSON. A report of the first ``limit`` rows by
    dataset and key; an identifier without digits finds nothing.
    """
    digits = "".join(c for c in identifier if c.isdigit())
    wanted = digits[-10:] if kind == "phone" else digits
    found = []
    for name, df in tables.items():
        columns = [c for c in IDENTIFIER_COLUMNS[kind] if c in df.columns]
        if not columns or not wanted:
            continue
        plain = lambda c: F.regexp_replace(F.regexp_replace(I.text(c), r"\.0+$", ""), r"\D", "")
        same = {c: (F.right(plain(c), F.lit(10)) if kind == "phone" else plain(c)) == wanted for c in columns}
        first = F.coalesce(*[F.when(hit, c) for c, hit in same.items()])
        rows = df.where(reduce(lambda a, b: a | b, same.values()))
        found.append(rows.select(F.lit(name).alias("dataset"), F.col(key).alias("key"), first.alias("matched_column"), F.to_json(F.struct(*df.columns)).alias("record")))
    if not found:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "dataset string, key long, matched_column string, record string")
    return reduce(DataFrame.unionByName, found).orderBy("dataset", "key", "record").limit(limit)


def balanced_sample(df: DataFrame, strata: tuple[str, ...], order: list[str], rows: int) -> DataFrame:
    """A report of ``rows`` rows with the same quota for each stratum, topped up in ``order`` from what is left.

    Each stratum is limited to the report's size before anything is sorted, so a hot stratum costs no more than that.
    """
    groups = df.select(*strata).distinct().count()
    quota = max(1, rows // max(1, groups))
    w = Window.partitionBy(*strata).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= rows)
    return ranked.orderBy(F.when(F.col("_rn") <= quota, 0).otherwise(1), *order).limit(rows).drop("_rn")


def expanded_list(df: DataFrame, column: str, name: str) -> DataFrame:
    """A row for each value of a comma-separated list; blank values have none."""
    values = F.filter(F.split(F.col(column), r"\s*,\s*"), lambda x: F.trim(x) != "")
    return df.withColumn(name, F.explode(F.transform(values, lambda x: F.trim(x))))


def review_queue(lists: dict[str, DataFrame], limit: int = 200) -> DataFrame:
    """One row per subscriber of several lead lists ``(subscriber_number, priority_score)``: the lists that it is in, and
    its best score; the first ``limit`` by how many lists and score."""
    rows = [df.select("subscriber_number", "priority_score", F.lit(name).alias("category")) for name, df in lists.items()]
    one = reduce(DataFrame.unionByName, rows).groupBy("subscriber_number").agg(
        F.countDistinct("category").alias("n_categories"),
        F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"),  # as many as there are lists
        F.max("priority_score").alias("priority_score"),
    )
    return one.orderBy(F.desc("n_categories"), F.desc("priority_score"), "subscriber_number").limit(limit)


def coverage(lists: dict[str, DataFrame]) -> DataFrame:
    """How many subscribers each lead list has."""
    rows = [df.select(F.lit(name).alias("category"), "subscriber_number") for name, df in lists.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("category").agg(F.countDistinct("subscriber_number").alias("subscribers"))


def manifest_metrics(manifest: DataFrame) -> DataFrame:
    """Files, distinct contents and failures of an acquisition manifest ``(kind, status, sha256)`` by kind."""
    return manifest.groupBy("kind").agg(
        F.count("*").alias("files"), n_distinct(filled("sha256")).alias("distinct_files"), n_if(F.col("status") != "LOADED").alias("not_loaded")
    )


def file_summary(files: DataFrame, events: DataFrame, time: str = "event_time") -> DataFrame:
    """Every file of ``files (source_file, …)`` with its events, subscribers and span; also those without an event."""
    per = events.groupBy("source_file").agg(
        F.count("*").alias("events"), n_distinct(filled("subscriber_number")).alias("subscribers"), F.min(time).alias("first_event"), F.max(time).alias("last_event")
    )
    out = files.join(per, "source_file", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("events", "subscribers")})
