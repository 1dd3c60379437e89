"""Subscriber IP-detail reports of several operators: formats by header, query scope, footers, and folders as one case."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..operators.common import broadcast_if_small, fits_broadcast
from . import folders
from .text import base_name, ledger, parsed_rows, with_times

# Headers of the operators' reports and of lists of searches, and the columns that they are.
ALIASES = {
    # Airtel
    "msisdn_userid": "subscriber_number_raw",
    "imei": "imei",
    "imsi": "imsi",
    "downlink_vol": "downlink_volume",
    "uplink_vol": "uplink_volume",
    "event_start_time": "event_time",
    "session_start_time": "session_start",
    "session_end_time": "session_end",
    "pre_post": "pre_post",
    "roaming_circle": "roaming_circle",
    "icr_operator_name": "icr_operator",
    "home_circle": "home_circle",
    "source_public_ipv4": "source_public_ipv4",
    "source_public_ipv6": "source_public_ipv6",
    "source_public_port": "source_port",
    "destination_ip4": "destination_ipv4",
    "destination_ip6": "destination_ipv6",
    "destination_port": "destination_port",
    "source_private_ipv4": "source_private_ipv4",
    "source_handset_port": "source_handset_port",
    "duration": "session_duration_seconds",
    "charging_id": "charging_id",
    "access_point_name": "apn",
    "paco_gw_ip": "gateway_ip",
    "2g_4g_5g": "technology",
    "cgi_latitude": "latitude",
    "cgi_longitude": "longitude",
    "cgi": "cgi",
    # Vi
    "sr_no": "serial",
    "msisdn": "subscriber_number_raw",
    "source_ip": "source_any",
    "source_port": "source_port",
    "translated_ip": "translated_ip",
    "translated_port": "translated_port",
    "destination_ip": "destination_any",
    "session_start_date_time": "session_start",
    "session_end_date_time": "session_end",
    "duration_in_sec": "session_duration_seconds",
    "pgw_ip_address": "gateway_ip",
    "first_cell_id_name_location": "first_cell_id",
    "cgi_ld": "cgi",
    "rat": "technology",
    "data_volume_uplink": "uplink_volume",
    "data_volume_downlink": "downlink_volume",
    # Jio
    "landline_msisdn_mdn_leased_circuit_id_for_internet_access": "subscriber_number_raw",
    "user_id_for_internet_access_based_on_authentication": "user_id",
    "source_ip_address": "source_any",
    "translated_ip_address": "translated_ip",
    "destination_ip_address": "destination_any",
    "static_dynamic_ip_address_allocation": "allocation_type",
    "ist_start_time_of_public_ip_address_allocation_hh_mm_ss": "allocation_start_time",
    "ist_end_time_of_public_ip_address_allocation_hh_mm_ss": "allocation_end_time",
    "start_date_of_public_ip_address_allocation_dd_mm_yyyy": "allocation_start_date",
    "end_date_of_public_ip_address_allocation_dd_mm_yyyy": "allocation_end_date",
    "source_mac_id_address_other_device_identification_number": "imei",
    "first_cell_id": "first_cell_id",
    "last_cell_id": "last_cell_id",
    "time1_dd_mm_yyyy_hh_mm_ss": "time1",
    "session_duration_seconds": "session_duration_seconds",
    "session_duration": "session_duration_seconds",
    "data_volume_up_link": "uplink_volume",
    "data_volume_up_linkdata": "uplink_volume",
    "data_volume_down_link": "downlink_volume",
    "volume_down_link": "downlink_volume",
    "roaming_circle_indicator": "roaming_status",
    "sim_type": "sim_type",
    # Lists of searches
    "search_value": "search_value",
    "from_date": "from_datetime",
    "to_date": "to_datetime",
    "port": "search_port",
    "request_type": "request_type",
}

# Lines below the records of a report that are part of it but no record.
FOOTERS = (
    r"\bno\s+records?\s+found\b",
    r"\bno\s+data\s+found\b",
    r"\bsystem\s+generated\s+report\b",
    r"\breport\s+generated\s+(on|at|by)\b",
    r"\bend\s+of\s+report\b",
    r"\bpage\s+\d+\s+of\s+\d+\b",
    r"\btotal\s+(records?|rows?)\b",
)

# Scopes of a report and reasons of rejection.
TARGET, REVERSE, PUBLIC, BROADBAND, DYNAMIC, UNKNOWN = (
    "TARGET_SUBSCRIBER", "REVERSE_DESTINATION_IP", "REVERSE_PUBLIC_IP_PORT", "BROADBAND_IPV6_ALLOCATION", "JIO_DYNAMIC_IPDR", "UNKNOWN_SCOPE",
)
REASONS = {
    "AIRTEL": "NON_DATA_OR_INVALID_AIRTEL_IPDR_ROW",
    "VI": "NON_DATA_OR_INVALID_VI_IPDR_TIMESTAMP",
    "JIO": "NON_DATA_OR_INVALID_JIO_IPDR_TIMESTAMP",
}

_ADDRESSES = ("source_public_ipv4", "source_public_ipv6", "source_private_ipv4", "translated_ip", "destination_ipv4", "destination_ipv6", "gateway_ip")
_NUMBERS = ("source_port", "translated_port", "destination_port", "session_duration_seconds", "uplink_volume", "downlink_volume", "latitude", "longitude")
_TEXTS = ("imei", "imsi", "charging_id", "apn", "first_cell_id", "last_cell_id", "cgi", "technology", "pre_post", "home_circle", "roaming_circle", "roaming_status")

#: Columns of the records of a case.
COLUMNS = (
    "record_type", "operator", "source_format", "report_scope", "query_value", "query_port", "subscriber_number_raw", "subscriber_number",
    "subscriber_identifier_type", "imei", "imsi", "event_time", "session_start", "session_end", "allocation_start", "allocation_end",
    "session_duration_seconds", "source_ip", "source_ip_version", "source_public_ipv4", "source_public_ipv6", "source_private_ipv4", "source_port",
    "translated_ip", "translated_port", "destination_ip", "destination_ip_version", "destination_ipv4", "destination_ipv6", "destination_port",
    "charging_id", "apn", "gateway_ip", "first_cell_id", "last_cell_id", "cgi", "latitude", "longitude", "technology", "pre_post", "home_circle",
    "roaming_circle", "roaming_status", "uplink_volume", "downlink_volume", "volume_scope", "allocation_key", "event_id", "source_file",
    "source_path", "source_row_number",
)


class Case(NamedTuple):
    """A folder of reports: records, reject ledger, searches asked for, and a row for every file."""

    data: DataFrame
    rejected: DataFrame
    requests: DataFrame
    files: DataFrame


def version(ip: Column) -> Column:
    """IPv4, IPv6, INVALID or blank, of a canonical address with or without a prefix."""
    octet = "(25[0-5]|2[0-4]\\d|1?\\d?\\d)"
    return (
        F.when(ip == "", "")
        .when(ip.rlike(rf"^{octet}(\.{octet}){{3}}(/\d+)?$"), "IPv4")
        .when(ip.rlike(r"^[0-9a-f]*:[0-9a-f:.]*(%\w+)?(/\d+)?$"), "IPv6")
        .otherwise("INVALID")
    )


def stated(above: Column, name: Column) -> dict[str, Column]:
    """What the lines above a header, and the name of a file, say about the query that it answers."""
    kind = F.regexp_extract(above, r"(?i)Dynamic\s+IPDR\s+OF\s+(.+?)\s*:\s*(.+?)\s+from\s", 1)
    asked = F.regexp_extract(above, r"(?i)Dynamic\s+IPDR\s+OF\s+(.+?)\s*:\s*(.+?)\s+from\s", 2)
    port = F.regexp_extract(asked, r"(?i)PUBLIC\s+PORT\s*:\s*(\d+)", 1)
    value = F.trim(F.regexp_replace(asked, r"(?i)\s*(\bAND\s+)?PUBLIC\s+PORT\s*:\s*\d+\s*$", ""))
    public = r"(?i)public[_\s-]*ip([46])[_\s-]+(.+?)[_\s-]*public[_\s-]*port[_\s-]*(\d+)"
    named = F.regexp_extract(name, public, 2)
    named = F.when(F.regexp_extract(name, public, 1) == "6", F.replace(named, F.lit("."), F.lit(":"))).otherwise(F.replace(named, F.lit("_"), F.lit(".")))
    searched = F.regexp_extract(above, r"(?i)DESTIP\s*:-\s*([^\n,]+)", 1)
    first = lambda *cs: F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in cs], F.lit(""))
    query_port = first(port, F.regexp_extract(name, public, 3)).try_cast("long")
    scope = (
        F.when(kind.rlike("(?i)mobile|msisdn|subscriber"), TARGET)
        .when(kind.rlike(r"(?i)public\s*ip|source\s*ip") | name.rlike(r"(?i)public[_\s]ip") | query_port.isNotNull(), PUBLIC)
        .when(kind.rlike(r"(?i)dest|\bip\b"), REVERSE)
        .otherwise(UNKNOWN)
    )
    return {"stated_value": first(value, named, searched), "stated_port": query_port, "stated_scope": scope}


def _format(columns: Column) -> Column:
    has = lambda *names: F.lit(True) if not names else columns.contains(f",{names[0]},") & has(*names[1:])
    return (
        F.when(has("search_value", "from_datetime", "to_datetime", "search_port"), "SEARCH")
        .when(has("subscriber_number_raw", "source_any", "destination_any") & (has("time1") | has("allocation_start_date")), "JIO")
        .when(has("subscriber_number_raw", "event_time"), "AIRTEL")
        .when(has("serial", "subscriber_number_raw", "destination_any"), "VI")
        .otherwise("UNKNOWN")
    )


_PLACE = ("source_path", "section", "source_row", "source_row_end", "reason", "json")


def named(rows: DataFrame, names: list[str]) -> DataFrame:
    """Parsed rows with their format and their cleaned fields under canonical names, blank for none."""
    return rows.withColumnRenamed("path", "source_path").select(
        *_PLACE, _format(F.coalesce("section_columns", F.lit(""))).alias("source_format"),
        *[F.coalesce(I.without_null_tokens(f"f{i}"), F.lit("")).alias(n) for i, n in enumerate(names)],
    )


def classified(rows: DataFrame, names: list[str]) -> DataFrame:
    """``judged`` of the parsed rows of reports."""
    return judged(named(rows, names), names)


def judged(df: DataFrame, names: list[str]) -> DataFrame:
    """The rows of ``named`` with their times, and ``verdict``: record, footer or rejected.

    Each format has its rule for a record. Airtel: a time of the event and any address, port, identity, charging id or cell;
    or an address and an identity with any time, port, charging id or cell. Vi: a start of the session. Jio: the time of the
    event, day first; in files without any such time the start of the allocation (broadband); in files with neither, a time
    in any layout with subscriber, source and destination (dynamic). Footers are lines that ``FOOTERS`` know, and a lone
    time of generation.
    """
    filled = F.filter(F.array(*names), lambda x: x != "")
    line = F.lower(F.regexp_replace(F.array_join(F.array(*names), " "), r"\s+", " "))
    lone = (F.size(filled) == 1) & F.element_at(filled, 1).rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}\s+\d{2}:\d{2}:\d{2}$")
    joined = lambda d, t: F.trim(F.concat_ws(" ", d, t))
    df = df.withColumns(
        {
            "footer": line.rlike("|".join(FOOTERS)) | lone,
            "no_records": line.rlike(r"\bno\s+(records?|data)\s+found\b"),
            "allocation_start": joined("allocation_start_date", "allocation_start_time"),
            "allocation_end": joined("allocation_end_date", "allocation_end_time"),
            "any_time": F.coalesce(I.event_time("time1"), I.event_time("time1", I.MONTH_FIRST)),
            "time1": I.event_time("time1", tuple(f for f in I.TIME_FORMATS if f.startswith("dd"))),
        }
    )
    df = with_times(df, ["event_time", "session_start", "session_end"])
    df = df.withColumns({c: I.event_time(c) for c in ("allocation_start", "allocation_end")})
    raw = F.trim("subscriber_number_raw")
    of_file = df.where("source_format = 'JIO' and reason is null").groupBy("source_path", "section").agg(
        F.bool_or(F.col("time1").isNotNull()).alias("has_events"),
        F.bool_or(F.col("allocation_start").isNotNull()).alias("has_allocations"),
        F.bool_or(raw.rlike(r"^\d{10,15}$")).alias("numeric"),
        F.min(F.when(raw != "", raw)).alias("lo"),
        F.max(F.when(raw != "", raw)).alias("hi"),
    )
    df = df.join(broadcast_if_small(folders.stored(of_file)), ["source_path", "section"], "left")
    any_of = lambda *cs: F.concat(*[F.col(c) for c in cs]) != ""
    network = any_of("source_public_ipv4", "source_public_ipv6", "source_private_ipv4", "destination_ipv4", "destination_ipv6")
    ports, ids = any_of("source_port", "destination_port"), any_of("charging_id", "cgi")
    identity = raw.rlike(r"^(\+?91)?[6-9]\d{9}$|^\d{12,16}$") | any_of("imei", "imsi")
    timed = F.col("event_time").isNotNull() | F.col("session_start").isNotNull() | F.col("session_end").isNotNull()
    airtel = (F.col("event_time").isNotNull() & (network | ports | identity | ids)) | (network & identity & (timed | ports | ids))
    dynamic = (raw != "") & any_of("source_any") & any_of("destination_any") & F.col("any_time").isNotNull()
    jio = F.when(F.col("has_events"), F.col("time1").isNotNull()).when(F.col("has_allocations"), F.col("allocation_start").isNotNull()).otherwise(dynamic)
    kind = F.col("source_format")
    record = F.when(kind == "AIRTEL", ~F.col("footer") & airtel).when(kind == "VI", F.col("session_start").isNotNull()).when(kind == "JIO", jio)
    record = record.when(kind == "SEARCH", F.col("search_value") != "")
    return df.withColumn(
        "verdict",
        F.when(F.col("reason").isin("PREAMBLE", "HEADER"), "layout")
        .when(F.col("reason").isNotNull(), "rejected")
        .when(F.coalesce(record, F.lit(False)), "record")
        .when(F.col("footer") & (kind == "AIRTEL"), "footer")
        .otherwise("rejected"),
    )


def records(df: DataFrame) -> DataFrame:
    """Records under ``COLUMNS`` from classified rows with what their files state."""
    kind = F.col("source_format")
    jio, vi = kind == "JIO", kind == "VI"
    by_format = lambda a, v, j: F.when(kind == "AIRTEL", a).when(vi, v).otherwise(j)
    canon = lambda c: I.canonical_ip(c, keep_invalid=True)
    out = df.withColumns({c: canon(c) for c in (*_ADDRESSES, "source_any", "destination_any")})
    fixed = {c: version(F.col(c)) for c in ("source_any", "destination_any")}
    out = out.withColumns({f"{c}_version": v for c, v in fixed.items()})
    whole = lambda side, v: F.when(kind == "AIRTEL", F.col(side)).when(F.col(f"{side.split('_')[0]}_any_version") == v, F.col(f"{side.split('_')[0]}_any")).otherwise("")
    out = out.withColumns(
        {
            "source_public_ipv4": whole("source_public_ipv4", "IPv4"),
            "source_public_ipv6": whole("source_public_ipv6", "IPv6"),
            "destination_ipv4": whole("destination_ipv4", "IPv4"),
            "destination_ipv6": whole("destination_ipv6", "IPv6"),
        }
    )
    first = lambda a, b: F.when(F.col(a) != "", F.col(a)).otherwise(F.col(b))
    events = F.coalesce("has_events", F.lit(False))
    broadband = jio & ~events & F.coalesce("has_allocations", F.lit(False))
    dynamic = jio & ~events & ~F.coalesce("has_allocations", F.lit(False))
    who = I.subscriber_kind("subscriber_number_raw")
    one = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("")
    time = by_format(F.col("event_time"), F.col("session_start"), F.when(dynamic, F.col("any_time")).otherwise(F.col("time1")))
    begins = by_format(F.col("session_start"), F.col("session_start"), F.when(dynamic, F.col("any_time")).otherwise(F.col("allocation_start")))
    ends = by_format(F.col("session_end"), F.col("session_end"), F.when(dynamic, F.col("any_time")).otherwise(F.col("allocation_end")))
    out = out.withColumns(
        {
            "record_type": F.when(broadband, "IP_ALLOCATION").otherwise("IPDR_EVENT"),
            "operator": by_format(F.lit("Airtel"), F.lit("Vi"), F.lit("Jio")),
            "report_scope": by_format(
                F.col("stated_scope"), F.lit(REVERSE),
                F.when(dynamic, DYNAMIC).when(broadband, BROADBAND).when(F.col("numeric"), TARGET).otherwise(UNKNOWN),
            ),
            "query_value": F.when(jio, one).otherwise(canon("stated_value")),
            "query_port": F.when(kind == "AIRTEL", F.col("stated_port")),
            "subscriber_number": who["value"],
            "subscriber_identifier_type": who["kind"],
            "event_time": time,
            "session_start": begins,
            "session_end": ends,
            "allocation_start": F.when(jio, F.col("allocation_start")).otherwise(begins),
            "allocation_end": F.when(jio, F.col("allocation_end")).otherwise(ends),
            "source_ip": F.when(kind == "AIRTEL", first("source_public_ipv4", "source_public_ipv6")).otherwise(F.col("source_any")),
            "destination_ip": F.when(kind == "AIRTEL", first("destination_ipv4", "destination_ipv6")).otherwise(F.col("destination_any")),
            "first_cell_id": by_format(F.col("cgi"), F.col("first_cell_id"), F.col("first_cell_id")),
            "last_cell_id": by_format(F.col("cgi"), F.col("first_cell_id"), F.col("last_cell_id")),
            "cgi": by_format(F.col("cgi"), F.col("cgi"), F.col("first_cell_id")),
            "volume_scope": F.when(jio, "ALLOCATION").otherwise("SESSION"),
            "source_file": base_name("source_path"),
            "source_row_number": F.col("source_row"),
            "event_id": F.xxhash64("source_path", "source_row"),
        }
    )
    ports = ("source_port", "translated_port", "destination_port")
    out = out.withColumns({c: F.when(F.col(c) != "", F.col(c).try_cast("double")) for c in _NUMBERS}).withColumns({c: F.col(c).cast("long") for c in ports})
    out = out.withColumns({"source_ip_version": version(F.col("source_ip")), "destination_ip_version": version(F.col("destination_ip"))})
    key = I.stable_key("operator", "subscriber_number", "source_ip", "allocation_start", "allocation_end", "session_start", "session_end", "charging_id", "imei", "imsi")
    return out.withColumn("allocation_key", key).select(*COLUMNS)


def read_case(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".csv", ".txt")) -> Case:
    """All IP-detail reports below a folder, whatever their operators, in one pass of Spark over the files.

    Byte-identical files are read once. A report of a tower (by its name) is left to ``cases.read_case``; a file without a
    known header is UNSUPPORTED, one with a header and no record LOADED_EMPTY. ``files`` counts the rows below the header,
    records, footers and rejects of each file, and says what was asked.
    """
    texts = folders.contents(spark, folder)
    found = folders.stored(folders.listed(texts, suffixes))
    first = folders.stored(folders.distinct_files(found).withColumn("tower", F.col("name").rlike(r"(?i)cell[_\s-]*id[_\s-]*ipdrnat")))
    paths = first.where("not tower").select("path")
    if paths.isEmpty():
        raise ValueError("the folder has no reports")
    parsed, names = parsed_rows(spark, texts.join(broadcast_if_small(paths), "path", "left_semi"), [], None, 0, ALIASES)
    parsed = folders.stored(named(parsed, names))
    rows = folders.stored(judged(parsed, names))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source_row", "json"))), lambda x: F.array_join(F.from_json(x["json"], "array<string>"), ",")), "\n")
    above = parsed.where("reason = 'PREAMBLE'").groupBy("source_path").agg(lines.alias("above"))  # PREAMBLE_LINES at most
    said = first.where("not tower").select(F.col("path").alias("source_path"), "name").join(above, "source_path", "left")
    said = folders.stored(said.select("source_path", *[c.alias(n) for n, c in stated(F.coalesce("above", F.lit("")), F.col("name")).items()]))
    kept = rows.where("verdict = 'record' and source_format <> 'SEARCH'").join(broadcast_if_small(said), "source_path", "left")
    reason = F.col("reason")
    for kind, text in REASONS.items():
        reason = F.when(F.col("reason").isNull() & (F.col("source_format") == kind), text).otherwise(reason)
    bad = rows.where("verdict = 'rejected'").withColumn("source_file", base_name("source_path"))
    fields = F.to_json(F.struct(*[F.when(F.col(n) != "", F.col(n)).alias(n) for n in names if n not in ("event_time", "session_start", "session_end", "time1")]))
    bad = bad.withColumns({"_reason": F.coalesce(reason, F.lit("NO_KNOWN_HEADER")), "_json": F.coalesce("json", fields)})
    asked = rows.where("verdict = 'record' and source_format = 'SEARCH'").select(
        "search_value", I.event_time("from_datetime").alias("from_datetime"), I.event_time("to_datetime").alias("to_datetime"),
        F.col("search_port").try_cast("long").alias("port"), "request_type", base_name("source_path").alias("source_file"), F.col("source_row").alias("source_row_number"),
    )
    data = records(kept)
    return Case(data, ledger(bad, "_json", F.col("_reason")), asked, _summary(found, first, rows, said))


def _summary(found: DataFrame, first: DataFrame, rows: DataFrame, said: DataFrame) -> DataFrame:
    """A row for every file: its status, format, query, and how many rows of which kind it has."""
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    counts = rows.groupBy("source_path").agg(
        F.max(F.when(F.col("source_format") != "UNKNOWN", F.col("source_format"))).alias("source_format"),
        F.count_if((F.col("section") > 0) & (F.col("verdict") != "layout")).alias("rows_below_header"),
        is_("record").alias("records_loaded"),
        is_("footer").alias("footer_rows"),
        is_("rejected").alias("rejected_rows"),
        F.coalesce(F.bool_or("no_records"), F.lit(False)).alias("says_no_records"),
    )
    kept = first.select(F.col("path").alias("source_path"), "tower", F.lit(True).alias("_first"))
    every = found.withColumnRenamed("path", "source_path")
    # A row for each file at most: few files say that all of these are few, without a run over the rows.
    few = fits_broadcast(found)
    for more in (kept, counts, said):
        every = every.join(F.broadcast(more) if few else more, "source_path", "left")
    status = (
        F.when(F.col("_first").isNull(), "DUPLICATE_SKIPPED")
        .when(F.col("tower"), "ROUTED")
        .when(F.col("source_format").isNull(), "UNSUPPORTED")
        .when(F.col("records_loaded") > 0, "LOADED")
        .otherwise("LOADED_EMPTY")
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.select(
        "source_path", F.col("name").alias("file_name"), "sha256", "bytes", status.alias("status"), F.coalesce("source_format", F.lit("")).alias("source_format"),
        F.when(F.col("source_format") == "AIRTEL", F.col("stated_scope")).when(F.col("source_format") == "VI", REVERSE).otherwise("").alias("stated_scope"),
        F.coalesce("stated_value", F.lit("")).alias("query_value"), F.col("stated_port").alias("query_port"),
        *[zero(c) for c in ("rows_below_header", "records_loaded", "footer_rows", "rejected_rows")], F.coalesce("says_no_records", F.lit(False)).alias("says_no_records"),
    )
