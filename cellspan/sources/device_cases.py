"""Reports about one device: their formats, what device they were asked for, and their records of three families."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..operators.common import broadcast_if_small
from . import folders, ip_detail, text
from .cases import above_header
from .text import base_name, ledger, parsed_rows

# Headers of call records about a device.
CALL_ALIASES = {
    "target_a_party_number": "a_party",
    "b_party_number": "b_party",
    "other_b_party_number": "b_party",
    "call_type": "call_type",
    "call_date": "call_date",
    "call_initiation_time": "call_time",
    "call_time": "call_time",
    "call_duration": "call_duration",
    "first_cell_global_id": "first_cell_id",
    "last_cell_global_id": "last_cell_id",
    "service_type": "service_type",
    "roaming_network_circle": "roaming_circle",
    "type_of_connection": "connection_type",
    "first_bts_location": "first_location",
    "last_bts_location": "last_location",
    "calling_party_telephone_number": "calling_party",
    "called_party_telephone_number": "called_party",
}
# Headers of packet sessions about a device.
SESSION_ALIASES = {"start_time": "session_start", "end_time": "session_end", "uplink": "uplink_volume", "downlink": "downlink_volume", "total": "total_volume"}

# Formats, and the words of the lines above the header and of the header itself that tell them.
FORMATS = (
    ("VIL_IMEI_CDR", "Vodafone Idea", "CDR", ("vodafone idea call data records", "report type :- main cdr report")),
    ("SEARCH_CRITERIA_IMEI_CDR", "Unknown", "CDR", ("search criteria : imei", "target/a-party number")),
    ("JIO_IMEI_CDR", "Reliance Jio", "CDR", ("ticket number :", "input value ", "calling party telephone number")),
    ("AIRTEL_IMEI_GPRS", "Bharti Airtel", "GPRS", ("gprs of imei", "bharti airtel")),
    ("AIRTEL_DYNAMIC_IMEI_IPDR", "Bharti Airtel", "IPDR", ("dynamic ipdr of imei", "bharti airtel")),
    ("VIL_IMEI_GPRS", "Vodafone Idea", "GPRS", ("vodafone idea call data records", "report type :- gprs report")),
    ("VIL_IMEI_DOT", "Vodafone Idea", "IPDR", ("report type:-dot report", "source ip", "destination ip")),
)

# Where a report, or else its name, states the device that it was asked for.
ASKED_IN_TEXT = (
    r"(?im)^\s*IMEI\s*:\s*-?\s*([0-9]{14,16})",
    r"(?im)^\s*Search\s+Value\s*:\s*([0-9]{14,16})",
    r"(?im)^\s*Input\s+Value.*?:\s*,?\s*['\"]?([0-9]{14,16})",
    r"(?im)Dynamic\s+IPDR\s+OF\s+IMEI\s*:\s*([0-9]{14,16})",
    r"(?im)GPRS\s+OF\s+IMEI\s*:\s*([0-9]{14,16})",
)
ASKED_IN_NAME = (r"(?i)IMEI_IPDR_([0-9]{14,16})", r"(?i)IMEI_([0-9]{14,16})", r"^([0-9]{14,16})_")


#: What every row carries, and what the records of calls and of sessions are made of.
_PLACE = ("source_path", "source_file", "source_row", "source_row_end", "format_id", "operator", "query_identifier")
_OF_CALLS = (*dict.fromkeys(CALL_ALIASES.values()), "imei", "imsi")
_OF_SESSIONS = ("subscriber_number_raw", "imei", "imsi", "session_start", "session_end", "event_time", "uplink_volume", "downlink_volume", "total_volume", "cgi", "apn", "technology", "pre_post", "roaming_circle")


class DeviceCase(NamedTuple):
    """A folder of reports about devices: a row for every file, records of calls, of IP detail and of sessions, and rejects."""

    files: DataFrame
    calls: DataFrame
    ip: DataFrame
    sessions: DataFrame
    rejected: DataFrame


def relation(query: Column | str, observed: Column | str) -> Column:
    """How an identifier in a report relates to the one that was asked for; neither is cut."""
    q, o = I.digits(query), I.digits(observed)
    long = lambda c: F.length(c).isin(15, 16)
    return (
        F.when((q == "") | (o == ""), "UNAVAILABLE")
        .when(q == o, "EXACT")
        .when((F.length(q) == 14) & o.startswith(q), "BASE14_MATCH")
        .when(long(q) & long(o) & (F.left(q, F.lit(14)) == F.left(o, F.lit(14))), "SAME_BASE14")
        .otherwise("REPORT_SCOPE")
    )


def device_format(words: Column, name: Column) -> tuple[Column, Column, Column]:
    """Format, operator and kind of source, from the lower-case lines down to the header, and the file's name."""
    out = [F.lit("UNKNOWN"), F.lit("Unknown"), F.lit("UNKNOWN")]
    generic = F.lower(name).contains("imei_ipdr") & words.contains("destination ip address") & words.contains("source ip address")
    out = [F.when(generic, v).otherwise(o) for v, o in zip(("GENERIC_IMEI_IPDR", "Unknown", "IPDR"), out)]
    for kind, operator, source, marks in reversed(FORMATS):
        hit = F.lit(True)
        for m in marks:
            hit = hit & words.contains(m)
        who = F.when(words.contains("bsnl"), "BSNL").otherwise("Unknown") if kind == "SEARCH_CRITERIA_IMEI_CDR" else F.lit(operator)
        out = [F.when(hit, v).otherwise(o) for v, o in zip((F.lit(kind), who, F.lit(source)), out)]
    return tuple(out)


def asked_for(above: Column, name: Column) -> Column:
    """The device that a report was asked for: 14 to 16 digits, or blank."""
    found = [F.regexp_extract(above, p, 1) for p in ASKED_IN_TEXT] + [F.regexp_extract(name, p, 1) for p in ASKED_IN_NAME]
    return F.coalesce(*[F.when(f != "", f) for f in found], F.lit(""))


def read_device_case(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".csv", ".txt")) -> DeviceCase:
    """All reports about devices below a folder, in one pass over the files; byte-identical files are read once.

    ``files`` says of every file its format, operator, kind of source, the device asked for, how many records it has, how
    they relate to that device, and its status: HAS_DATA, VALID_EMPTY (a known format without records), DUPLICATE or
    UNSUPPORTED. Records carry ``query_identifier``, ``match_relation`` of the device in them, and ``event_id`` by path and
    row. Calls of Jio state both parties: the target is the called one of what comes in, else the calling one. Lines that
    close a report are no rejects.
    """
    found = folders.files(spark, folder, suffixes)
    first = folders.distinct_files(found)
    paths = [r["path"] for r in first.select("path").orderBy("path").toLocalIterator()]
    if not paths:
        raise ValueError("the folder has no reports")
    aliases = ip_detail.ALIASES | SESSION_ALIASES | CALL_ALIASES
    aliases |= {c: c for c in aliases.values()}
    parsed, names = parsed_rows(spark, paths, [], None, 0, aliases)
    rows = parsed.withColumnRenamed("path", "source_path")
    heads = rows.where("reason = 'HEADER'").groupBy("source_path").agg(F.min_by("json", "source_row").alias("head"))
    said = first.select(F.col("path").alias("source_path"), "name").join(above_header(rows), "source_path", "left").join(heads, "source_path", "left")
    above = F.coalesce("above", F.lit(""))
    words = F.lower(F.concat_ws("\n", above, F.array_join(F.from_json("head", "array<string>"), ",")))
    kind, operator, source = device_format(words, F.col("name"))
    said = said.select(
        "source_path", kind.alias("format_id"), operator.alias("operator"), source.alias("source_type"), asked_for(above, F.col("name")).alias("query_identifier"),
        *[c.alias(n) for n, c in ip_detail.stated(above, F.col("name")).items()],
    )
    said = broadcast_if_small(said)
    flat = rows.where("reason is null").join(said, "source_path").select(
        "source_path", base_name("source_path").alias("source_file"), "source_row", "source_row_end", "format_id", "operator", "source_type", "query_identifier",
        *[I.without_null_tokens(f"f{i}").alias(n) for i, n in enumerate(names)],
    )
    line = F.lower(F.concat_ws(" ", *names))
    flat = flat.withColumn("footer", line.rlike("|".join(ip_detail.FOOTERS)))
    calls, bad_calls = _calls(flat.where("source_type = 'CDR' and not footer").select(*_PLACE, *_OF_CALLS))
    sessions, bad_sessions = _sessions(flat.where("source_type = 'GPRS' and not footer").select(*_PLACE, *_OF_SESSIONS))
    kinds = ip_detail.classified(parsed, names).join(said, "source_path").where("source_type = 'IPDR'")
    query = said.select("source_path", "query_identifier", "format_id")
    ip = ip_detail.records(kinds.where("verdict = 'record'").drop("query_identifier", "format_id", "operator", "source_type")).join(query, "source_path")
    ip = _related(ip)
    bad_ip = kinds.where("verdict = 'rejected'").withColumn("source_file", base_name("source_path"))
    bad_ip = ledger(bad_ip.withColumn("_json", F.coalesce("json", F.to_json(F.struct("subscriber_number_raw", "imei", "imsi")))), "_json", F.coalesce("reason", F.lit("NO_VALID_RECORD")))
    broken = rows.where(text.REJECTED).join(said.where("source_type <> 'IPDR'"), "source_path").withColumn("source_file", base_name("source_path"))
    rejected = ledger(broken, "json", F.col("reason")).unionByName(bad_calls).unionByName(bad_sessions).unionByName(bad_ip)
    return DeviceCase(_files(found, first, said, calls, ip, sessions), calls, ip, sessions, rejected)


def _related(df: DataFrame) -> DataFrame:
    return df.withColumns({"query_identifier_type": I.identifier_kind("query_identifier"), "match_relation": relation("query_identifier", "imei")})


def _calls(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    kind = I.canonical_call_type("call_type", "service_type")
    inward = kind.isin("incoming", "smsin")
    jio = F.col("format_id") == "JIO_IMEI_CDR"
    sides = rows.withColumns(
        {
            "target": F.when(jio & inward, F.col("called_party")).when(jio, F.col("calling_party")).otherwise(F.col("a_party")),
            "other_party": F.when(jio & inward, F.col("calling_party")).when(jio, F.col("called_party")).otherwise(F.col("b_party")),
        }
    )
    sides = sides.withColumns({"a_party": F.col("target"), "b_party": F.col("other_party")})
    good, bad = text.calls_from(sides)
    out = _related(good.withColumns({"target": I.party_key("target"), "call_direction": F.when(F.col("call_type").isin("incoming", "smsin"), "INCOMING").when(F.col("call_type").isin("outgoing", "smsout"), "OUTGOING").otherwise("UNKNOWN")}))
    return out.select(
        "event_id", "target", "other_party", "call_datetime", "call_type", "raw_call_type", "call_direction", "call_duration", "imei", "imsi", "first_cell_id", "last_cell_id",
        "service_type", "roaming_circle", "query_identifier", "query_identifier_type", "match_relation", "operator", "format_id", "source_file", "source_path", F.col("source_row").alias("source_row_number"),
    ), bad


def _sessions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    named = rows.withColumns(
        {"subscriber_number": F.col("subscriber_number_raw"), "searched_cell_id": F.col("cgi"), "session_start": F.coalesce("session_start", "event_time")}
    )
    good, bad = text.sessions_from(named.drop("session_duration_seconds"))
    more = rows.select("source_path", "source_row", "query_identifier", "format_id")
    return _related(good.join(more, ["source_path", "source_row"])).withColumnRenamed("source_row", "source_row_number"), bad


def _files(found: DataFrame, first: DataFrame, said: DataFrame, calls: DataFrame, ip: DataFrame, sessions: DataFrame) -> DataFrame:
    every = [df.select("source_path", "match_relation") for df in (calls, ip, sessions)]
    counts = every[0].union(every[1]).union(every[2]).groupBy("source_path").agg(
        F.count("*").alias("records"),
        *[F.count_if(F.col("match_relation") == r).alias(r.lower()) for r in ("EXACT", "BASE14_MATCH", "SAME_BASE14", "REPORT_SCOPE", "UNAVAILABLE")],
    )
    kept = first.select(F.col("path").alias("source_path"), F.lit(True).alias("_first"))
    out = found.withColumnRenamed("path", "source_path").join(broadcast_if_small(kept), "source_path", "left").join(said, "source_path", "left").join(broadcast_if_small(counts), "source_path", "left")
    status = (
        F.when(F.col("_first").isNull(), "DUPLICATE").when(F.col("records") > 0, "HAS_DATA").when(F.col("format_id") != "UNKNOWN", "VALID_EMPTY").otherwise("UNSUPPORTED")
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(
        "source_path", F.col("name").alias("file_name"), "sha256", status.alias("status"), "format_id", "operator", "source_type", "query_identifier",
        I.identifier_kind("query_identifier").alias("query_identifier_type"), *[zero(c) for c in ("records", "exact", "base14_match", "same_base14", "report_scope", "unavailable")],
    )
