"""Operator reports: tower dumps, IP detail, dedicated device reports, and master files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..operators import sessions as S
from ..schema import CALLS, IP_EVENTS, SUBSCRIBER_MASTER, conform, rename_aliases
from .text import CALL_ALIASES, first_header, head, quarantine, read_delimited, sniff, split_line, with_names, with_times

# Words by which reports name their operator.
OPERATORS = ("airtel", "jio", "vodafone", "idea", "vi ", "bsnl")

# Header aliases of tower dumps and IP-detail reports.
TOWER_ALIASES = CALL_ALIASES | {
    "msisdn": "subscriber_number",
    "subscriber": "subscriber_number",
    "cdr_type": "call_type",
    "cgi": "searched_cell_id",
    "cell_id": "searched_cell_id",
    "searched_cell": "searched_cell_id",
}
IP_ALIASES = {
    "msisdn": "subscriber_number",
    "landline_msisdn_mdn_leased_circuit_id": "subscriber_number",
    "mobile_number": "subscriber_number",
    "user_id": "subscriber_number",
    "source_ip_address": "source_ip",
    "private_ip": "source_ip",
    "src_ip": "source_ip",
    "translated_ip_address": "translated_ip",
    "public_ip": "translated_ip",
    "nat_ip": "translated_ip",
    "destination_ip_address": "destination_ip",
    "dest_ip": "destination_ip",
    "dest_port": "destination_port",
    "allocation_start_time": "allocation_start",
    "start_date_of_public_ip_address_allocation": "allocation_start",
    "allocation_end_time": "allocation_end",
    "end_date_of_public_ip_address_allocation": "allocation_end",
    "event_start_time": "event_time",
    "event_date_time": "event_time",
    "cgi": "searched_cell_id",
    "cell_id": "searched_cell_id",
    "first_cell": "first_cell_id",
    "last_cell": "last_cell_id",
    "uplink": "uplink_volume",
    "data_volume_up_link": "uplink_volume",
    "downlink": "downlink_volume",
    "data_volume_down_link": "downlink_volume",
    "total": "total_volume",
}
# Header aliases of master files.
NUMBER_ALIASES = {
    "mobile": "mobile_number",
    "msisdn": "mobile_number",
    "name": "subscriber_name",
    "customer_name": "subscriber_name",
    "father_s_name": "father_name",
    "permanent_address": "address",
    "doa": "activation_date",
    "date_of_activation": "activation_date",
    "caf": "caf_number",
    "caf_no": "caf_number",
}
CELL_ALIASES = {"cell_global_id": "cgi", "cgi_id": "cgi", "lat": "latitude", "long": "longitude", "lon": "longitude", "site_name": "site", "tower_name": "site", "site_address": "address"}


def preamble(lines: list[str]) -> dict[str, str]:
    """Operator, searched cell, period and query identifier as the lines above the header state them."""
    text = "\n".join(lines)
    out = {"operator": next((o.strip() for o in OPERATORS if o in text.lower()), "")}
    cell = re.search(r"(?i)(?:cell|cgi)[^\n:]*:\s*['\"]?([0-9A-Z][0-9A-Z-]{5,})", text)
    span = re.search(r"(?i)(\d{1,4}[-/]\w{2,3}[-/]\d{2,4}[ :\d]*?)\s+(?:to|till)\s+(\d{1,4}[-/]\w{2,3}[-/]\d{2,4}(?:[ :\d]*\d)?)", text)
    device = re.search(r"(?i)imei[^\n\d]{0,20}(\d{14,16})", text)
    out |= {"searched_cell_id": cell[1] if cell else "", "query_identifier": device[1] if device else ""}
    return out | {"period_start": span[1].strip() if span else "", "period_end": span[2].strip() if span else ""}


def classify(lines: list[str]) -> str:
    """Kind of a report by the words of its header: CELL_DUMP, SESSIONS, IP_DETAIL, CALLS, MASTER, EMPTY or UNSUPPORTED."""
    text = "\n".join(lines).lower()
    if re.search(r"no (records?|data) found", text):
        return "EMPTY"
    has = lambda *w: all(x in text for x in w)
    if has("destination", "ip") or has("translated", "ip") or has("nat", "ip"):
        return "IP_DETAIL"
    if (has("uplink") or has("upload")) and (has("session") or has("start")):
        return "SESSIONS"
    if has("subscriber", "name") or has("customer", "name") or has("father"):
        return "MASTER"
    if has("lat", "lon") and (has("cgi") or has("cell")):
        return "MASTER"
    if has("searched") or (has("cell") and has("dump")):
        return "CELL_DUMP"
    if has("party") or has("calling") or has("called"):
        return "CALLS"
    return "UNSUPPORTED"


def inspect(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Manifest of report files: kind, operator, and identifiers stated above the header."""
    rows = []
    for p in paths:
        try:
            lines = head(spark, p)
            m = preamble(lines)
            rows.append((p, classify(lines), m["operator"], m["searched_cell_id"], m["query_identifier"], I_KIND(m["query_identifier"]), None))
        except Exception as e:  # noqa: BLE001  a file that cannot be read is an entry of the manifest
            rows.append((p, "ERROR", "", "", "", "UNKNOWN", str(e)[:200]))
    return spark.createDataFrame(rows, "path string, kind string, operator string, searched_cell_id string, query_identifier string, identifier_kind string, error string")


def I_KIND(value: str) -> str:  # noqa: N802
    return {14: "BASE14", 15: "IMEI15", 16: "IMEISV16"}.get(len(value), "UNKNOWN")


TOWER_COLUMNS = ("subscriber_number", "a_party", "b_party", "call_type", "service_type", "call_date", "call_time", "call_duration", "imei", "imsi", "first_cell_id", "last_cell_id", "searched_cell_id")


def tower_from(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: tower records from rows under canonical names with ``stated_operator`` and ``stated_cell``.

    Where a report has parties but no subscriber, the subscriber is the one of the searched tower: the B party of what
    comes in, else the A party. Rows without a time, or without a subscriber and a device, are rejected.
    """
    df = rows
    for c in TOWER_COLUMNS:
        df = df.withColumn(c, I.without_null_tokens(c) if c in df.columns else F.lit(None).cast("string"))
    kind = I.canonical_call_type("call_type", "service_type")
    inward = kind.isin("incoming", "smsin")
    phone = lambda c: F.when(F.col(c).rlike("[A-Za-z]"), F.upper(c)).otherwise(I.party_key(c))
    df = df.withColumns(
        {
            "_sub": F.coalesce("subscriber_number", F.when(inward, F.col("b_party")).otherwise(F.col("a_party"))),
            "_other": F.when(inward, F.col("a_party")).otherwise(F.col("b_party")),
            "call_type": kind,
            "call_datetime": F.concat_ws(" ", "call_date", "call_time"),
            "call_duration": I.duration_seconds("call_duration"),
            "imei": I.imei("imei"),
            "imsi": I.imsi("imsi"),
            "operator": F.col("stated_operator"),
            "searched_cell_id": F.coalesce("searched_cell_id", "stated_cell"),
        }
    ).withColumns({"subscriber_number": phone("_sub"), "other_party": phone("_other")})
    df = with_times(df, ["call_datetime"])
    no_one = F.col("subscriber_number").isNull() | (F.col("subscriber_number") == "")
    return quarantine(df, F.col("call_datetime").isNull() | (no_one & (F.col("imei") == "")), "NO_TIME_OR_IDENTITY")


def read_tower_dump(spark: SparkSession, path: str, sample: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tower dump in the ``CALLS`` schema, and its rejects (``tower_from``). Dates are read by one layout per file."""
    lines = head(spark, sample or path)
    known = with_names(TOWER_ALIASES, *TOWER_COLUMNS)
    skip, sep, names = first_header(lines, ("party", "msisdn", "subscriber", "cell", "cgi", "imei", "imsi", "date", "time", "type"), known)
    stated = preamble(lines[:skip])
    good, bad = read_delimited(spark, path, names, sep, skip + 1, known, with_path=True)
    df = rename_aliases(good, TOWER_ALIASES).withColumns(
        {"stated_operator": F.lit(stated["operator"]), "stated_cell": F.lit(stated["searched_cell_id"])}
    )
    accepted, more = tower_from(df)
    return conform(accepted, CALLS), bad.unionByName(more)


IP_COLUMNS = ("subscriber_number", "imei", "imsi", "event_time", "allocation_start", "allocation_end", "source_ip", "translated_ip", "destination_ip")


def ip_events_from(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: IP events from rows under canonical names with their ``section_columns``. Where a section has
    no time of events, the start of the allocation is taken; rows without a time are rejected."""
    times = [c for c in ("event_time", "allocation_start", "allocation_end") if c in rows.columns]
    ips = {c: I.canonical_ip(c) for c in ("source_ip", "translated_ip", "destination_ip") if c in rows.columns}
    df = with_times(rows, times).withColumns(ips)
    if "allocation_start" in times:
        own = F.col("section_columns").contains(",event_time,")
        df = df.withColumn("event_time", F.when(own, F.col("event_time")).otherwise(F.col("allocation_start")) if "event_time" in times else F.col("allocation_start"))
    df = conform(df, IP_EVENTS, ("source_row", "source_row_end", "source_path"))
    key = I.stable_key("subscriber_number", "source_ip", "translated_ip", "allocation_start", "allocation_end")
    df = df.withColumns(
        {
            "allocation_key": key,
            "allocation_volume_key": I.stable_key("subscriber_number", "source_ip", "translated_ip", "allocation_start", "allocation_end", "total_volume"),
            "cell_transition_type": I.cell_transition("first_cell_id", "last_cell_id", "searched_cell_id"),
        }
    )
    return quarantine(df, F.col("event_time").isNull(), "NO_EVENT_TIME")


def read_ip_events(spark: SparkSession, path: str, sample: str | None = None) -> tuple[DataFrame, DataFrame]:
    """IP-detail events in their schema, and rejects. Banner and footer rows have no time and are rejected; dates are read
    by one layout per file, sections each by their header."""
    known = with_names(IP_ALIASES, *IP_COLUMNS)
    skip, sep, names = first_header(head(spark, sample or path), ("ip", "port", "msisdn", "mobile", "start", "end", "time", "cell", "imei", "imsi"), known)
    good, bad = read_delimited(spark, path, names, sep, skip + 1, known, with_path=True)
    accepted, more = ip_events_from(rename_aliases(good, IP_ALIASES))
    return accepted.drop("source_row", "source_row_end", "source_path"), bad.unionByName(more)


def read_number_master(spark: SparkSession, path: str, sep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Subscriber master with one row per valid mobile number: of repeats the last of the file."""
    from ..operators.common import latest

    skip, found, names = sniff(head(spark, path), ("mobile", "msisdn", "name", "address", "caf", "activation", "circle"))
    good, bad = read_delimited(spark, path, names, sep or found, skip + 1)
    df = rename_aliases(good, NUMBER_ALIASES).withColumn("mobile_number", I.msisdn("mobile_number"))
    accepted, more = quarantine(df, F.col("mobile_number").isNull(), "NO_VALID_MOBILE")
    one = latest(accepted, ["mobile_number"], [F.desc("source_file"), F.desc("source_row")])
    return conform(one, SUBSCRIBER_MASTER), bad.unionByName(more)


#: How values of a cell master look, for files without a header.
_LOOKS = {
    "cgi": lambda v: bool(re.fullmatch(r"\d{3}-\d{2,3}-\d{1,6}-\d{1,10}", v.strip())),
    "latitude": lambda v: _between(v, 6, 38),
    "longitude": lambda v: _between(v, 67, 98),
}


def _between(value: str, low: float, high: float) -> bool:
    """Whether a text is a decimal fraction in a range (whole numbers are more likely codes)."""
    return bool(re.fullmatch(r"\s*\d{1,3}\.\d+\s*", value)) and low <= float(value) <= high


def positional_layout(lines: list[str], seps: tuple[str, ...] = (",", "|", "\t", ";", "^")) -> tuple[str, list[str]]:
    """Separator and names of a cell master without a header: the columns of which most values look like a cell, a latitude
    and a longitude; the longest text of the others is the address."""
    for sep in seps:
        rows = [split_line(x, sep) for x in lines[:200] if x.strip()]
        width = max((len(r) for r in rows), default=0)
        columns = [[r[i] for r in rows if i < len(r)] for i in range(width)]
        names = [f"column_{i}" for i in range(width)]
        for name, looks in _LOOKS.items():
            share = [sum(map(looks, c)) / len(c) if names[i].startswith("column_") else 0.0 for i, c in enumerate(columns)]
            if share and max(share) >= 0.6:
                names[share.index(max(share))] = name
        if "cgi" in names:
            rest = [i for i in range(width) if names[i].startswith("column_")]
            if rest:
                names[max(rest, key=lambda i: sum(map(len, columns[i])))] = "address"
            return sep, names
    raise ValueError("no column looks like a cell")


def read_cell_master(spark: SparkSession, path: str, sep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cell master ``(cgi, mcc, mnc, lac, cell_id, latitude, longitude, site, address)`` by key, coordinates in range.

    A file without a header is read by how its columns look.
    """
    from ..operators.common import latest

    lines = head(spark, path)
    try:
        skip, found, names = sniff(lines, ("cgi", "cell", "lat", "lon", "site", "address"))
    except ValueError:
        skip, (found, names) = -1, positional_layout(lines)
    good, bad = read_delimited(spark, path, names, sep or found, skip + 1)
    df = rename_aliases(good, CELL_ALIASES)
    for c in ("latitude", "longitude", "site", "address"):
        df = df.withColumn(c, F.col(c) if c in df.columns else F.lit(None).cast("string"))
    point = I.lat_lon(F.concat_ws(",", "latitude", "longitude"))
    df = df.withColumns({"cgi": I.cgi_key("cgi"), "_p": point, "_c": I.cgi_parts("cgi")})
    accepted, more = quarantine(df, ~I.valid_cell("cgi"), "NO_VALID_CELL")
    one = latest(accepted, ["cgi"], [F.desc("source_file"), F.desc("source_row")])
    out = one.select("cgi", "_c.mcc", "_c.mnc", "_c.lac", "_c.cell_id", F.col("_p.lat").alias("latitude"), F.col("_p.lon").alias("longitude"), "site", "address")
    return out, bad.unionByName(more)


def device_evidence(df: DataFrame, query_identifier: str, column: str = "imei") -> DataFrame:
    """Records of a report about one device with how each relates to the identifier that was asked for."""
    relation = I.match_relation(F.lit(query_identifier), column)
    return df.withColumns(
        {"query_identifier": F.lit(query_identifier), "match_relation": relation, "match_basis": F.when(I.digits(column) == "", "QUERY_SCOPE").when(relation == "EXACT", "OBSERVED_EXACT").otherwise("REPORT_SCOPE")}
    )


def zero_sessions(df: DataFrame) -> DataFrame:
    return S.normalise(df).where("is_zero_volume")
