"""Queries over sessions, IP events, devices, several targets, master data, and the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..operators import cross_target, devices, ip_events, master, sessions
from . import domain as D
from .catalog import C, IN, IP, NIGHT, OUT, S, lst, on, query, top

# ---- sessions -----------------------------------------------------------------------------------------------------


def rows_sql(src: str, pairs: dict[str, str]) -> str:
    names = ", ".join(f"'{n}'" for n in pairs)
    return f"SELECT unnest([{names}]) AS metric, unnest([{', '.join(f'({e})::VARCHAR' for e in pairs.values())}]) AS value FROM {src}"


def checks_sql(src: str, pairs: dict[str, str]) -> str:
    names = ", ".join(f"'{n}'" for n in pairs)
    vals = ", ".join(f"count(*) FILTER (WHERE {e})" for e in pairs.values())
    return f"SELECT k AS check_name, v AS records, CASE WHEN n > 0 THEN round(100.0 * v / n, 2) ELSE 0 END AS share_percent FROM (SELECT count(*) AS n, unnest([{names}]) AS k, unnest([{vals}]) AS v FROM {src})"


query(
    "session_summary",
    on(S, sessions.summary),
    rows_sql(
        "s",
        {
            "total_sessions": "count(*)",
            **{f"unique_{c}": f"count(DISTINCT nullif({c}, ''))" for c in ("subscriber_number", "imei", "imsi", "ipv4_address", "ipv6_address", "searched_cell_id")},
            "longest_session_seconds": "max(session_duration_seconds)::BIGINT",
            "invalid_time_rows": "count(*) FILTER (WHERE NOT session_time_valid)",
            "missing_volume_rows": "count(*) FILTER (WHERE total_volume IS NULL)",
            "volume_mismatch_rows": "count(*) FILTER (WHERE volume_mismatch)",
            "non_standard_subscribers": "count(*) FILTER (WHERE identifier_type <> 'MSISDN')",
            "zero_volume_sessions": "count(*) FILTER (WHERE is_zero_volume)",
        },
    ),
)
_V = "round(coalesce(sum(({})::DECIMAL(28,6)), 0), 4)::DOUBLE"
query(
    "session_subscriber_summary",
    on(S, sessions.subscriber_summary),
    f"""SELECT subscriber_number, count(*) AS sessions, min(session_start) AS first_seen, max(session_end) AS last_seen, {_V.format('session_duration_seconds')} AS duration_seconds, {_V.format('total_volume')} AS total_volume,
 {_V.format('downlink_volume')} AS downlink_volume, {_V.format('uplink_volume')} AS uplink_volume, count(DISTINCT sc) AS unique_cells, count(DISTINCT im) AS unique_imei, count(DISTINCT imsi) AS unique_imsi,
 count(DISTINCT ipv4_address) AS unique_ipv4, {lst('technology')} AS technologies FROM s WHERE sub IS NOT NULL GROUP BY 1""",
)
_SI = "SELECT {0}, count(*) AS sessions, count(DISTINCT sub) AS subscribers, count(DISTINCT sc) AS cells, round(coalesce(sum((total_volume)::DECIMAL(28,6)), 0), 4)::DOUBLE AS total_volume, min(session_start) AS first_seen, max(session_start) AS last_seen FROM s WHERE {0} <> '' GROUP BY 1"
query("session_imei_summary", on(S, sessions.identity_summary, "imei"), _SI.format("imei"))
query("session_imsi_summary", on(S, sessions.identity_summary, "imsi"), _SI.format("imsi"))
query(
    "session_ip_summary",
    on(S, sessions.ip_summary),
    """SELECT ip_version, ip_address, count(*) AS sessions, count(DISTINCT sub) AS subscribers, round(sum((total_volume)::DECIMAL(28,6)), 4)::DOUBLE AS total_volume FROM (SELECT 'IPv4' AS ip_version, ipv4_address AS ip_address, sub, total_volume FROM s UNION ALL
 SELECT 'IPv6', ipv6_address, sub, total_volume FROM s) WHERE ip_address <> '' GROUP BY 1, 2""",
)
query(
    "session_duration_bins",
    on(S, sessions.duration_bins),
    "SELECT o AS bin_order, b AS bin, count(*) AS sessions, round(sum((total_volume)::DECIMAL(28,6)), 4)::DOUBLE AS total_volume FROM (SELECT *, CASE WHEN session_duration_seconds IS NULL THEN 99 "
    + " ".join(f"WHEN session_duration_seconds <= {e} THEN {k}" for k, (e, _) in enumerate(sessions.BINS)) + " ELSE 6 END AS o, CASE WHEN session_duration_seconds IS NULL THEN 'unknown' "
    + " ".join(f"WHEN session_duration_seconds <= {e} THEN '{n}'" for e, n in sessions.BINS) + " ELSE 'over 2 h' END AS b FROM s) GROUP BY 1, 2",
)
query("session_technology_counts", on(S, sessions.counts, "technology"), "SELECT coalesce(nullif(technology, ''), 'UNKNOWN') AS technology, count(*) AS records FROM s GROUP BY 1")
query("session_roaming_counts", on(S, sessions.counts, "roaming_circle"), "SELECT coalesce(nullif(roaming_circle, ''), 'UNKNOWN') AS roaming_circle, count(*) AS records FROM s GROUP BY 1")
query("session_hourly_activity", on(S, sessions.hourly), "SELECT hour(session_start)::INTEGER AS hour, count(*) AS records, count(DISTINCT sub) AS subscribers FROM s GROUP BY 1")
query(
    "session_quality",
    on(S, sessions.quality),
    checks_sql("s", {"invalid_session_time": "NOT session_time_valid", "missing_volume_fields": "total_volume IS NULL", "volume_mismatch": "volume_mismatch", "non_standard_subscriber": "identifier_type <> 'MSISDN'", "zero_volume": "is_zero_volume", "missing_ipv4": "ipv4_address = ''", "missing_ipv6": "ipv6_address = ''", "missing_imei": "im IS NULL", "missing_imsi": "imsi = ''"}),
)
query("session_network_summary", on(S, sessions.network_summary), "SELECT technology, pre_post, roaming_circle, count(*) AS sessions, count(DISTINCT sub) AS subscribers, round(sum((total_volume)::DECIMAL(28,6)), 4)::DOUBLE AS total_volume FROM s GROUP BY 1, 2, 3")

# ---- IP events ----------------------------------------------------------------------------------------------------
_FIRST = "arg_min({0}, (coalesce(event_time, TIMESTAMP '0001-01-01'), event_id)) AS {0}"
_AL = "SELECT allocation_volume_key, " + ", ".join(f"arg_min_null({c}, (coalesce(event_time, TIMESTAMP '0001-01-01'), event_id)) AS {c}" for c in ("subscriber_number", "allocation_start", "allocation_end", "source_ip", "uplink_volume", "downlink_volume", "total_volume")) + ", count(*) AS events, count(DISTINCT sc) AS cells FROM i GROUP BY 1"
query("ip_allocations", on(IP, ip_events.allocations), _AL)
query("ip_volume_variants", on(IP, ip_events.volume_variants), "SELECT allocation_key, arg_min_null(subscriber_number, (coalesce(event_time, TIMESTAMP '0001-01-01'), event_id)) AS subscriber_number, arg_min_null(total_volume, (coalesce(event_time, TIMESTAMP '0001-01-01'), event_id)) AS total_volume, count(*) AS events, count(DISTINCT total_volume) AS volume_variants FROM i GROUP BY 1")
query(
    "ip_subscriber_summary",
    on(IP, ip_events.subscriber_summary),
    f"""SELECT a.*, coalesce(n, 0) AS allocations, coalesce(t, 0) AS total_volume FROM (SELECT subscriber_number, count(*) AS events, min(event_time) AS first_seen, max(event_time) AS last_seen, count(DISTINCT sc) AS cells, count(DISTINCT im) AS imei_count, count(DISTINCT dip) AS destinations
 FROM i WHERE sub IS NOT NULL GROUP BY 1) a LEFT JOIN (SELECT subscriber_number, count(*) AS n, round(sum((total_volume)::DECIMAL(28,6)), 4)::DOUBLE AS t FROM ({_AL}) GROUP BY 1) b USING (subscriber_number)""",
)
_IPER = "count(*) AS events, count(DISTINCT sub) AS subscribers, min(event_time) AS first_seen, max(event_time) AS last_seen"
query("ip_imei_summary", on(IP, ip_events.identity_summary, "imei"), f"SELECT imei, {_IPER} FROM i WHERE im IS NOT NULL GROUP BY 1")
query("ip_imsi_summary", on(IP, ip_events.identity_summary, "imsi"), f"SELECT imsi, {_IPER} FROM i GROUP BY 1")
_VER = "CASE WHEN contains({0}, ':') THEN 'IPv6' ELSE 'IPv4' END AS ip_version"
for _c in ("source_ip", "translated_ip", "destination_ip"):
    query(f"ip_{_c}_summary", on(IP, ip_events.ip_summary, _c), f"SELECT {_c}, {_VER.format(_c)}, {_IPER} FROM i WHERE {_c} <> '' GROUP BY 1, 2")
query("ip_port_summary", on(IP, ip_events.port_summary), f"SELECT destination_port::BIGINT AS destination_port, {_IPER} FROM i WHERE destination_port IS NOT NULL GROUP BY 1")
_EP = "CASE WHEN coalesce(destination_ip, '') = '' THEN '' WHEN destination_port IS NULL THEN destination_ip WHEN contains(destination_ip, ':') THEN '[' || destination_ip || ']:' || destination_port ELSE destination_ip || ':' || destination_port END"
query("ip_endpoint_summary", on(IP, ip_events.endpoint_summary), f"SELECT {_EP} AS endpoint, {_IPER} FROM i WHERE dip IS NOT NULL GROUP BY 1")
query("ip_cell_summary", on(IP, ip_events.cell_summary), "SELECT searched_cell_id, count(*) AS events, count(DISTINCT sub) AS subscribers, count(*) FILTER (WHERE first_cell_id = last_cell_id) AS same_last_cell, count(*) FILTER (WHERE first_cell_id <> last_cell_id) AS changed_last_cell FROM i WHERE sc IS NOT NULL GROUP BY 1")
query(
    "ip_movement_summary",
    on(IP, ip_events.movement_summary),
    """SELECT first_cell_id, last_cell_id, CASE WHEN first_cell_id = last_cell_id AND first_cell_id = searched_cell_id THEN 'SAME_SEARCHED_CELL' WHEN first_cell_id = last_cell_id THEN 'SAME_OTHER_CELL' ELSE 'CHANGED_CELL' END AS transition,
 count(*) AS events, count(DISTINCT sub) AS subscribers FROM i GROUP BY 1, 2, 3""",
)
query("ip_cell_movement", on(IP, ip_events.cell_movement), "SELECT subscriber_number, first_cell_id, last_cell_id, count(*) AS events, bool_or(first_cell_id <> last_cell_id) AS changed FROM i WHERE sub IS NOT NULL GROUP BY 1, 2, 3")
query("ip_hourly_activity", on(IP, ip_events.hourly), "SELECT event_time::DATE AS date, hour(event_time)::INTEGER AS hour, count(*) AS events, count(DISTINCT sub) AS subscribers FROM i WHERE event_time IS NOT NULL GROUP BY 1, 2")
query("ip_metrics", on(IP, ip_events.metrics), rows_sql("i", {"events": "count(*)", **{f"unique_{c}": f"count(DISTINCT nullif({c}, ''))" for c in ("subscriber_number", "imei", "imsi", "source_ip", "destination_ip", "searched_cell_id", "allocation_key")}}))
query(
    "ip_quality",
    on(IP, ip_events.quality),
    checks_sql("i", {"missing_subscriber": "sub IS NULL", "missing_imei": "im IS NULL", "missing_event_time": "event_time IS NULL", "missing_destination_ip": "dip IS NULL", "missing_port": "destination_port IS NULL", "event_outside_allocation": "NOT event_time BETWEEN allocation_start AND allocation_end", "allocation_end_before_start": "allocation_end < allocation_start", "invalid_cell": "sc IS NULL"}),
)
query("ip_reverse_query", on(IP, ip_events.reverse_query, "203.0.113.8", 8080), "SELECT source_file, CASE WHEN destination_ip = '203.0.113.8' AND destination_port = 8080 THEN 'IP_AND_PORT' WHEN destination_ip = '203.0.113.8' THEN 'IP_ONLY' ELSE 'NO_MATCH' END AS match_status, count(*) AS events FROM i GROUP BY 1, 2")
_F = [f"file_{k}.csv" for k in range(4)]
query("ip_presence_matrix", on(IP, ip_events.presence_matrix, "imei", _F), "SELECT imei, count(DISTINCT source_file) AS files_seen, count(*) AS events, " + ", ".join(f"max((source_file = '{f}')::INT) AS file_{k + 1}" for k, f in enumerate(_F)) + " FROM i WHERE im IS NOT NULL GROUP BY 1")
query(
    "ip_cell_values",
    on(IP, ip_events.cell_values),
    """, x AS (SELECT sub, unnest(list_distinct(list_filter([sc, first_cell_id, last_cell_id], lambda z: z IS NOT NULL))) AS cell FROM i)
SELECT cell, count(*) AS events, count(DISTINCT sub) AS subscribers, CASE WHEN count(DISTINCT sub) > 10 THEN array_to_string(list_sort(list(DISTINCT sub) FILTER (WHERE sub IS NOT NULL))[1:10], ', ') || ', ...'
 ELSE coalesce(array_to_string(list_sort(list(DISTINCT sub) FILTER (WHERE sub IS NOT NULL)), ', '), '') END AS first_subscribers FROM x WHERE cell <> '405-51--' GROUP BY 1""",
)
query(
    "ip_scope_warning",
    on(IP, ip_events.scope_warning, *D.PARTS[0][:2]),
    f"SELECT *, CASE WHEN coverage_percent >= 95 THEN 'WINDOW_COVERS_ALMOST_ALL' WHEN coverage_percent >= 75 THEN 'WINDOW_COVERS_MOST' ELSE 'NONE' END AS warning FROM (SELECT count(*) AS total_records, count(*) FILTER (WHERE event_time >= TIMESTAMP '{D.PARTS[0][0]}' AND event_time < TIMESTAMP '{D.PARTS[0][1]}') AS selected_records, round(100.0 * count(*) FILTER (WHERE event_time >= TIMESTAMP '{D.PARTS[0][0]}' AND event_time < TIMESTAMP '{D.PARTS[0][1]}') / count(*), 2) AS coverage_percent FROM i)",
)

# ---- devices ------------------------------------------------------------------------------------------------------
ASKED = "350000000000008"
_REL = f"CASE WHEN imei = '{ASKED}' THEN 'EXACT' ELSE 'SAME_BASE14' END"
_M = f"left(imei, 14) = '{ASKED[:14]}'"
_SPAN = "count(*) AS events, min(call_datetime) AS first_seen, max(call_datetime) AS last_seen, count(DISTINCT imsi) AS sims"


def bundle(view, f, name):
    return lambda spark, sf_dir: f(view(spark, sf_dir), ASKED)[name]


query("device_targets", bundle(C, devices.call_bundle, "targets"), f"SELECT target, source_file, {_SPAN} FROM c WHERE {_M} GROUP BY 1, 2")
query("device_sims", bundle(C, devices.call_bundle, "sims"), f"SELECT imsi, {_SPAN} FROM c WHERE {_M} GROUP BY 1")
_CK = "CASE WHEN regexp_matches(other_party, '[0-9]') THEN regexp_replace(other_party, '[^0-9]', '', 'g') ELSE coalesce(other_party, '') END"
query("device_contacts", bundle(C, devices.call_bundle, "contacts"), f"SELECT {_CK} AS contact, cat AS category, {_SPAN} FROM c WHERE {_M} AND coalesce(other_party, '') <> '' GROUP BY 1, 2")
query("device_towers", bundle(C, devices.call_bundle, "towers"), f"SELECT first_cell_id, {_SPAN} FROM c WHERE {_M} AND vc GROUP BY 1")
query("device_timeline", bundle(C, devices.call_bundle, "timeline"), f"SELECT call_datetime, event_id, target, other_party, call_type, first_cell_id, imei, {_REL} AS match_relation FROM c WHERE {_M}")
query(
    "device_indicators",
    bundle(C, devices.call_bundle, "indicators"),
    f""", a AS (SELECT count(DISTINCT sub) AS su, count(DISTINCT imsi) AS si, count(DISTINCT imei) AS ie FROM c WHERE {_M})
SELECT 'MULTIPLE_SUBSCRIBERS' AS indicator, su AS value FROM a WHERE su > 1 UNION ALL SELECT 'MULTIPLE_SIMS', si FROM a WHERE si > 1 UNION ALL SELECT 'IDENTIFIER_VARIANTS', ie FROM a WHERE ie > 1""",
)
query("device_quality", bundle(C, devices.call_bundle, "quality"), checks_sql(f"(SELECT * FROM c WHERE {_M})", {"missing_time": "call_datetime IS NULL", "missing_imsi": "imsi = ''", "invalid_cell": "NOT vc", "unknown_contact": "cat = 'unknown_contact'"}))
_SS = "count(*) AS sessions, round(coalesce(sum((total_volume)::DECIMAL(28,6)), 0), 4)::DOUBLE AS total_volume"
query("device_session_subscribers", bundle(S, devices.session_bundle, "subscribers"), f"SELECT subscriber_number, identifier_type, {_SS} FROM s WHERE {_M} AND sub IS NOT NULL GROUP BY 1, 2")
query("device_session_cells", bundle(S, devices.session_bundle, "cells"), f"SELECT searched_cell_id, {_SS} FROM s WHERE {_M} AND sc IS NOT NULL GROUP BY 1")
_IS = "count(*) AS events, min(event_time) AS first_seen, max(event_time) AS last_seen"
query("device_ip_subscribers", bundle(IP, devices.ip_bundle, "subscribers"), f"SELECT subscriber_number, {_IS} FROM i WHERE {_M} AND sub IS NOT NULL GROUP BY 1")
query("device_ip_endpoints", bundle(IP, devices.ip_bundle, "endpoints"), f"SELECT destination_ip, destination_port::BIGINT AS destination_port, {_IS} FROM i WHERE {_M} AND dip IS NOT NULL GROUP BY 1, 2")


def timeline(spark, sf_dir):
    return devices.unified_timeline(C(spark, sf_dir), S(spark, sf_dir), IP(spark, sf_dir), ASKED)


_UT = f""", u AS (SELECT 'CDR' AS source, call_datetime AS event_time, event_id, coalesce(subscriber_number, '') AS subscriber_number, searched_cell_id AS cell, call_type || ' ' || coalesce(other_party, '') AS detail, {_REL} AS match_relation FROM c WHERE {_M}
 UNION ALL SELECT 'GPRS', session_start, event_id, subscriber_number, searched_cell_id, ipv4_address, {_REL} FROM s WHERE {_M}
 UNION ALL SELECT 'IPDR', event_time, event_id, coalesce(subscriber_number, ''), searched_cell_id, {_EP}, {_REL} FROM i WHERE {_M})"""
query("device_unified_timeline", timeline, f"{_UT} SELECT * FROM u")
query("device_associated_identities", lambda s, d: devices.associated_identities(timeline(s, d)), f"{_UT} SELECT subscriber_number, count(*) AS events, {lst('source')} AS sources, min(event_time) AS first_seen, max(event_time) AS last_seen FROM u WHERE subscriber_number <> '' GROUP BY 1")
query("device_source_status", lambda s, d: devices.source_status(timeline(s, d)), f"{_UT} SELECT source, count(*) AS events, min(event_time) AS first_seen, max(event_time) AS last_seen, 'FOUND' AS status FROM u GROUP BY 1")
_FAM = "CASE WHEN length(imei) BETWEEN 14 AND 16 THEN left(imei, 14) ELSE '' END"
_SV = "SELECT {1} AS {0}, count(DISTINCT fam) AS devices, count(*) AS events, " + lst("fam") + " AS device_families, min(call_datetime) AS first_seen, max(call_datetime) AS last_seen FROM (SELECT *, " + _FAM + " AS fam FROM {2}) WHERE fam <> '' AND coalesce({1}, '') <> '' GROUP BY 1 HAVING count(DISTINCT fam) >= 2"
query("device_shared_subscribers", lambda s, d: devices.shared_values(C(s, d), F.col("subscriber_number"), "subscriber"), _SV.format("subscriber", "sub", "c"))
query("device_shared_sims", lambda s, d: devices.shared_values(C(s, d), I.imsi("imsi"), "sim"), _SV.format("sim", "imsi", "c"))
query("device_shared_contacts", on(C, devices.shared_contacts), _SV.format("contact", "other_party", "(SELECT * FROM c WHERE cat = 'human_mobile')"))
_TR = "(SELECT *, unnest(list_distinct([first_cell_id, last_cell_id])) AS cl FROM c)"
query("device_shared_towers", on(C, devices.shared_towers), _SV.format("cell", "cl", f"(SELECT * FROM {_TR} WHERE cl <> '405-51--')"))
query("device_shared_endpoints", lambda s, d: devices.shared_values(IP(s, d), I.endpoint("destination_ip", "destination_port"), "endpoint", time="event_time"), _SV.replace("call_datetime", "event_time").format("endpoint", f"({_EP})", "i"))
_ASK = [ASKED, "860000000000007", "999999999999999", "35000000000001"]
query(
    "device_overview",
    on(C, devices.device_overview, _ASK),
    "SELECT q AS query_identifier, left(q, 14) AS device_family, count(event_id) AS events, count(DISTINCT sub) AS subscribers, count(DISTINCT imsi) AS sims, count(*) FILTER (WHERE NOT vc) AS invalid_cells, CASE WHEN count(event_id) > 0 THEN 'FOUND' ELSE 'NO_DATA' END AS status FROM (SELECT unnest(["
    + ", ".join(f"'{x}'" for x in _ASK) + f"]) AS q) LEFT JOIN c ON {_FAM} = left(q, 14) GROUP BY 1, 2",
)

# ---- several targets ----------------------------------------------------------------------------------------------
_LN = "CASE WHEN length(regexp_replace(coalesce(other_party, ''), '[^0-9]', '', 'g')) >= 10 THEN right(regexp_replace(other_party, '[^0-9]', '', 'g'), 10) END"
_E = f", e AS (SELECT *, {_LN} AS number, im AS device, imsi AS sim FROM c)"
_CI = "SELECT {0}, count(DISTINCT target) AS target_count, count(*) AS total_events, " + lst("target") + " AS targets, min(call_datetime) AS first_seen, max(call_datetime) AS last_seen FROM {1} WHERE {0} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT target) >= {2}"
_CN = _CI.format("number", "(SELECT * FROM e WHERE number NOT IN (SELECT target FROM e))", 2)
query("cross_common_numbers", on(C, cross_target.common_numbers), f"{_E} {_CN}")
_LINK = f"""{_E}, l AS (SELECT target, number AS linked_target, count(*) AS events, count(*) FILTER (WHERE {IN}) AS incoming, count(*) FILTER (WHERE {OUT}) AS outgoing, count(*) FILTER (WHERE {NIGHT}) AS night_events,
 min(call_datetime) AS first_contact, max(call_datetime) AS last_contact FROM e WHERE number IN (SELECT target FROM e) AND number <> target GROUP BY 1, 2)"""
query("cross_direct_links", on(C, cross_target.direct_links), f"{_LINK} SELECT * FROM l")
_TW = "(SELECT *, unnest(list_distinct([first_cell_id, last_cell_id])) AS tower FROM c)"
_CT = _CI.format("tower", f"(SELECT * FROM {_TW} WHERE tower <> '405-51--')", 2)
query("cross_common_towers", on(C, cross_target.common_towers), _CT)
query("cross_common_devices", on(C, cross_target.common_devices), f"{_E} {_CI.format('device', 'e', 2)}")
query("cross_common_sims", on(C, cross_target.common_sims), f"{_E} {_CI.format('sim', 'e', 2)}")
_TG = [f"9{k:09d}" for k in (7, 8, 16, 46, 143)]


def matrix_sql(item: str, least: int = 2) -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE target = '{x}') AS \"{x}\"" for x in _TG)
    return f"{_E} SELECT {item}, {cols}, count(*) AS total, count(DISTINCT target)::INTEGER AS n_present FROM e WHERE {item} IS NOT NULL AND target IN ({', '.join(repr(x) for x in _TG)}) GROUP BY 1 HAVING count(DISTINCT target) >= {least}"


query("cross_contact_matrix", on(C, cross_target.item_matrix, "number", _TG), matrix_sql("number"))
query("cross_device_matrix", on(C, cross_target.item_matrix, "device", _TG, 1), matrix_sql("device", 1))
query(
    "cross_overview",
    on(C, cross_target.overview),
    f"{_E} SELECT target, count(*) AS events, count(DISTINCT number) AS numbers, count(DISTINCT first_cell_id) FILTER (WHERE vc) AS towers, count(DISTINCT device) AS devices, count(DISTINCT sim) AS sims, count(*) FILTER (WHERE {NIGHT}) AS night_events, min(call_datetime) AS first_seen, max(call_datetime) AS last_seen FROM e GROUP BY 1",
)
query(
    "cross_contact_map",
    on(C, cross_target.contact_map),
    f"""{_E}, k AS ({_CN}), g AS (SELECT * FROM e WHERE number IN (SELECT number FROM k))
SELECT a.*, v AS top_tower FROM (SELECT target, number, count(*) AS events, arg_max(first_cell_id, (call_datetime, event_id)) FILTER (WHERE vc AND call_datetime IS NOT NULL) AS last_tower, max(call_datetime) AS last_time FROM g GROUP BY 1, 2) a
 LEFT JOIN {top('g', 'target, number', 'first_cell_id', 'vc')} t USING (target, number)""",
)
query(
    "cross_movement",
    on(C, cross_target.movement_rows),
    """SELECT target, event_id, from_tower, first_cell_id AS to_tower, from_time, call_datetime AS to_time FROM (SELECT *, lag(first_cell_id) OVER w AS from_tower, lag(call_datetime) OVER w AS from_time FROM c WHERE vc AND call_datetime IS NOT NULL
 WINDOW w AS (PARTITION BY target ORDER BY call_datetime, event_id)) WHERE from_tower <> first_cell_id""",
)
_ALERT_ROWS = ", ".join(f"('{k}', '{v[0]}', '{v[1]}')" for k, v in cross_target.ALERTS.items())
query(
    "cross_alerts",
    on(C, cross_target.alerts),
    f"""{_LINK}, n AS (SELECT * FROM (SELECT 'COMMON_NUMBERS' AS alert, count(*) AS items FROM ({_CN}) UNION ALL SELECT 'DIRECT_LINKS', count(*) FROM l UNION ALL SELECT 'COMMON_TOWERS', count(*) FROM ({_CT})
 UNION ALL SELECT 'COMMON_DEVICES', count(*) FROM ({_CI.format('device', 'e', 2)}) UNION ALL SELECT 'COMMON_SIMS', count(*) FROM ({_CI.format('sim', 'e', 2)})) WHERE items > 0)
SELECT alert, severity, coalesce(items, 0) AS items, replace(says, '%d', coalesce(items, 0)::VARCHAR) AS observation
FROM (VALUES {_ALERT_ROWS}) v(alert, severity, says) LEFT JOIN n USING (alert) WHERE items > 0 OR (alert = 'NOTHING_SHARED' AND NOT EXISTS (SELECT * FROM n))""",
)
query("cross_pair_overlap", lambda s, d: cross_target.pair_overlap(C(s, d), I.imsi("imsi")), "SELECT a.target AS target_a, b.target AS target_b, count(*) AS shared_items FROM (SELECT DISTINCT target, imsi FROM c) a JOIN (SELECT DISTINCT target, imsi FROM c) b ON a.imsi = b.imsi AND a.target < b.target GROUP BY 1, 2")

# ---- master data --------------------------------------------------------------------------------------------------
query(
    "master_enrich_numbers",
    lambda s, d: master.enrich_number(C(s, d), D.number_master(s, d)).select("event_id", "subscriber_name", "subscriber_circle", "lookup_status"),
    "SELECT event_id, name AS subscriber_name, circle AS subscriber_circle, CASE WHEN ms IS NULL THEN 'INVALID_KEY' WHEN mobile_number IS NOT NULL THEN 'FOUND' ELSE 'NOT_FOUND' END AS lookup_status FROM c LEFT JOIN nm ON ms = mobile_number",
)
query(
    "master_enrichment_summary",
    lambda s, d: master.enrichment_summary(master.enrich_number(C(s, d), D.number_master(s, d))),
    "SELECT CASE WHEN ms IS NULL THEN 'INVALID_KEY' WHEN mobile_number IS NOT NULL THEN 'FOUND' ELSE 'NOT_FOUND' END AS lookup_status, count(*) AS records FROM c LEFT JOIN nm ON ms = mobile_number GROUP BY 1",
)
query(
    "master_enrich_cells",
    lambda s, d: master.enrich_cell(C(s, d), D.cell_master(s, d)).select("event_id", "cell_site", "cell_status"),
    "SELECT event_id, site AS cell_site, CASE WHEN NOT vc THEN 'INVALID_KEY' WHEN cgi IS NOT NULL THEN 'FOUND' ELSE 'NOT_FOUND' END AS cell_status FROM c LEFT JOIN cm ON vc AND first_cell_id = cgi",
)
query("master_missing_cells", lambda s, d: master.missing_cells(C(s, d), D.cell_master(s, d)), "SELECT first_cell_id AS cell_key, count(*) AS events FROM c WHERE vc AND first_cell_id NOT IN (SELECT cgi FROM cm) GROUP BY 1")
_NEW = "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN upper(c_name) || '!' ELSE c_name END"


#: Numbers of incoming rows: others are left out than in the master.
_IN_KEY = "'9' || lpad(cast(cast(c_custkey + floor(c_custkey / 3) as bigint) as string), 9, '0')"


def incoming(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.selectExpr(f"{_IN_KEY} as mobile_number", f"{_NEW} as name", "c_mktsegment as circle")


_UP = f""", n2 AS (SELECT {_IN_KEY} AS mobile_number, {_NEW} AS name, c_mktsegment AS circle, TRUE AS hit FROM customer),
up AS (SELECT coalesce(o.mobile_number, n2.mobile_number) AS mobile_number, CASE WHEN hit THEN n2.name ELSE o.name END AS name, CASE WHEN hit THEN n2.circle ELSE o.circle END AS circle,
 CASE WHEN hit IS NULL THEN 'KEPT' WHEN o.mobile_number IS NULL THEN 'INSERTED' WHEN o.name IS NOT DISTINCT FROM n2.name AND o.circle IS NOT DISTINCT FROM n2.circle THEN 'UNCHANGED' ELSE 'UPDATED' END AS upsert_action
 FROM nm o FULL JOIN n2 ON o.mobile_number = n2.mobile_number)"""
query("master_upsert", lambda s, d: master.upsert(D.number_master(s, d), incoming(s, d), "mobile_number"), f"{_UP} SELECT * FROM up")
query("master_upsert_counts", lambda s, d: master.upsert_counts(D.number_master(s, d), incoming(s, d), "mobile_number"), f"{_UP} SELECT upsert_action, count(*) AS records FROM up GROUP BY 1")
query("master_fallback", lambda s, d: master.with_fallback(D.number_master(s, d), incoming(s, d), "mobile_number"), f"{_UP} SELECT * FROM nm UNION ALL SELECT mobile_number, name, circle FROM n2 WHERE mobile_number NOT IN (SELECT mobile_number FROM nm)")
query(
    "master_latest_order",
    lambda s, d: master.last_per_key(s.read.parquet(f"{d}/orders.parquet").withColumn("k", F.col("o_custkey").cast("string")), "k", [F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey"),
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
)
query("master_search", lambda s, d: master.search(s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_brand"), "a1", ["p_name", "p_brand"], [F.desc("p_partkey")]), "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%a1%' OR p_brand ILIKE '%a1%' ORDER BY p_partkey DESC LIMIT 20")
_DUP = ("l_partkey", "l_quantity", "l_returnflag")
query(
    "quality_duplicate_flags",
    lambda s, d: master.flag_duplicates(s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", *_DUP), _DUP).select("l_orderkey", "l_linenumber", "duplicate_count", "potential_duplicate"),
    "SELECT l_orderkey, l_linenumber, count(*) OVER w AS duplicate_count, count(*) OVER w > 1 AS potential_duplicate FROM lineitem WINDOW w AS (PARTITION BY l_partkey, l_quantity, l_returnflag)",
)
query(
    "quality_duplicate_summary",
    lambda s, d: master.duplicate_summary(s.read.parquet(f"{d}/lineitem.parquet"), _DUP),
    "SELECT count(*) FILTER (WHERE n > 1) AS groups, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS records FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_quantity, l_returnflag)",
)
query("quality_event_duplicates", lambda s, d: master.duplicate_summary(C(s, d)), "SELECT count(*) FILTER (WHERE n > 1) AS groups, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS records FROM (SELECT count(*) AS n FROM c GROUP BY coalesce(subscriber_number, ''), coalesce(other_party, ''), call_type, call_datetime, call_duration, imei, imsi, first_cell_id, last_cell_id)")

# ---- scalar functions over text -----------------------------------------------------------------------------------
_PHONE = "case when c_custkey % 4 = 0 then '91' || lpad(cast(9000000000 + c_custkey as string), 10, '0') when c_custkey % 4 = 1 then '0' || cast(8000000000 + c_custkey as string) when c_custkey % 4 = 2 then cast(c_custkey as string) || '.0' else c_name end"


def phones(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.expr(_PHONE).alias("t"))


query(
    "function_numbers",
    lambda s, d: phones(s, d).select("c_custkey", I.digits("t").alias("digits"), I.msisdn("t").alias("msisdn"), I.party_key("t").alias("party"), I.loose_number("t").alias("loose"), I.contact_category("t").alias("category")),
    f""", x AS (SELECT c_custkey, {_PHONE} AS t FROM customer), y AS (SELECT *, regexp_replace(regexp_replace(t, '^([0-9]+)[.]0$', '\\1'), '[^0-9]', '', 'g') AS dg FROM x),
z AS (SELECT *, CASE WHEN regexp_matches(dg, '^91[6-9][0-9]{{9}}$') THEN dg[3:] WHEN regexp_matches(dg, '^0[6-9][0-9]{{9}}$') THEN dg[2:] WHEN regexp_matches(dg, '^[6-9][0-9]{{9}}$') THEN dg END AS m FROM y)
SELECT c_custkey, dg AS digits, m AS msisdn, coalesce(m, dg) AS party, CASE WHEN length(dg) >= 10 THEN right(dg, 10) END AS loose,
 CASE WHEN regexp_matches(t, '[A-Za-z]') THEN 'service_sender_id' WHEN regexp_matches(t, '^[0-9]{{1,6}}$') THEN 'short_code' WHEN regexp_matches(t, '^[0-9]{{7,15}}$') THEN 'human_mobile' ELSE 'unknown_contact' END AS category FROM z""",
)
query(
    "function_identifiers",
    lambda s, d: C(s, d).select("event_id", I.imei("imei").alias("imei15"), I.imsi("imsi").alias("imsi15"), I.loose_imei("imei").alias("loose_imei"), I.device_family("imei").alias("family"), I.identifier_kind("imei").alias("kind"), I.cell_key("first_cell_id").alias("cell_key"), I.valid_cell("first_cell_id").alias("cell_ok"), I.call_meaning("call_type").alias("meaning")),
    """SELECT event_id, imei AS imei15, imsi AS imsi15, im AS loose_imei, left(imei, 14) AS family, CASE WHEN im IS NULL THEN 'UNKNOWN' ELSE 'IMEI15' END AS kind, replace(first_cell_id, '-', '') AS cell_key, vc AS cell_ok,
 CASE call_type WHEN 'incoming' THEN 'Incoming Voice Call' WHEN 'outgoing' THEN 'Outgoing Voice Call' WHEN 'smsin' THEN 'Incoming SMS' WHEN 'smsout' THEN 'Outgoing SMS' ELSE 'Other / Unclassified Operator Event' END AS meaning FROM c""",
)
query("function_luhn", lambda s, d: C(s, d).select("imei").distinct().select("imei", I.imei_status("imei").alias("status")), """SELECT imei, CASE WHEN imei = '' THEN 'NON_STANDARD' WHEN list_sum(list_transform(range(1, 16), lambda k: CASE WHEN k % 2 = 1 THEN imei[k]::INT ELSE (2 * imei[k]::INT) // 10 + (2 * imei[k]::INT) % 10 END)) % 10 = 0 THEN 'VALID_IMEI' ELSE 'INVALID_IMEI' END AS status FROM (SELECT DISTINCT imei FROM c)""")
query("function_stable_key", lambda s, d: IP(s, d).select("event_id", I.stable_key("subscriber_number", "allocation_key", "source_ip").alias("key")), "SELECT event_id, left(sha256(lower(trim(coalesce(subscriber_number, ''))) || '|' || lower(allocation_key) || '|' || source_ip), 24) AS key FROM i")
query("function_endpoints", lambda s, d: IP(s, d).select("event_id", I.endpoint("destination_ip", "destination_port").alias("endpoint")), f"SELECT event_id, {_EP} AS endpoint FROM i")
query(
    "function_canonical_ip",
    lambda s, d: IP(s, d).select("destination_ip").distinct().select("destination_ip", I.canonical_ip("destination_ip").alias("canonical")),
    "SELECT destination_ip, CASE WHEN destination_ip = '2001:db8::0' THEN '2001:db8::' ELSE destination_ip END AS canonical FROM (SELECT DISTINCT destination_ip FROM i)",
)
query(
    "function_durations",
    lambda s, d: C(s, d).select("event_id", F.format_string("%02d:%02d:%02d", (F.col("event_id") % 30).cast("int"), (F.col("event_id") % 60).cast("int"), (F.col("event_id") % 59).cast("int")).alias("t")).select("event_id", I.duration_seconds("t").alias("seconds")),
    "SELECT event_id, ((event_id % 30) * 3600 + (event_id % 60) * 60 + event_id % 59)::DOUBLE AS seconds FROM c",
)
query(
    "function_event_times",
    lambda s, d: C(s, d).where("call_datetime is not null").select("event_id", F.when(F.col("event_id") % 2 == 0, F.date_format("call_datetime", "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format("call_datetime", "yyyy-MM-dd HH:mm:ss")).alias("t")).select("event_id", I.event_time("t").alias("parsed")),
    "SELECT event_id, date_trunc('second', call_datetime) AS parsed FROM c WHERE call_datetime IS NOT NULL",
)
query("function_formula_safe", lambda s, d: C(s, d).select("event_id", I.formula_safe(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("="), "operator")).otherwise(F.col("operator"))).alias("safe")), "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN chr(39) || '=' || operator ELSE operator END AS safe FROM c")
query(
    "function_cell_parts",
    lambda s, d: C(s, d).select("first_cell_id", "last_cell_id").distinct().select("first_cell_id", "last_cell_id", I.cgi_parts("first_cell_id").getField("lac").alias("lac"), I.cells_match("first_cell_id", "last_cell_id").alias("same")),
    "SELECT DISTINCT first_cell_id, last_cell_id, CASE WHEN vc THEN '834' END AS lac, first_cell_id = last_cell_id AS same FROM c",
)

# ---- scopes -------------------------------------------------------------------------------------------------------
from ..operators import scope  # noqa: E402

_GROUPS = {"g1": ["405-51-834-0001", "405 51 834 0002"], "g2": ["405-51-834-0099", "999-99-1-1"], "g3": ["999-99-1-2"]}
_GSQL = "(VALUES " + ", ".join(f"('{g}', '{c.replace('-', '').replace(' ', '')}')" for g, cs in _GROUPS.items() for c in cs) + ") gg(group_id, k)"
query("scope_loaded_cells", on(C, scope.loaded_cells), "SELECT replace(sc, '-', '') AS cell_key, arg_min(sc, event_id) AS cell, count(*) AS events FROM c WHERE sc IS NOT NULL GROUP BY 1")
query("scope_loaded_spots", on(C, scope.loaded_spots), "SELECT spot_id, min(spot_name) AS spot_name, count(*) AS events, count(DISTINCT sc) AS cells, count(DISTINCT source_file) AS files FROM c GROUP BY 1")
query("scope_in_spot", lambda s, d: scope.in_spot(C(s, d), spot_name="spot 2").select("event_id"), "SELECT event_id FROM c WHERE spot_id = 'SPOT-02'")
query(
    "scope_cell_groups",
    lambda s, d: scope.group_scope(C(s, d), scope.cell_groups(s, _GROUPS)).select("group_id", "event_id"),
    f"SELECT DISTINCT group_id, event_id FROM c JOIN {_GSQL} ON k = replace(searched_cell_id, '-', '') OR k = replace(first_cell_id, '-', '')",
)
query(
    "scope_group_status",
    lambda s, d: scope.scope_status(C(s, d), scope.cell_groups(s, _GROUPS)),
    f"SELECT *, CASE WHEN loaded_cells = 0 THEN 'NO_CELL_LOADED' WHEN loaded_cells < cells THEN 'PARTLY_LOADED' ELSE 'FULLY_LOADED' END AS scope_status FROM (SELECT group_id, count(DISTINCT k) AS cells, count(DISTINCT k) FILTER (WHERE k IN (SELECT replace(sc, '-', '') FROM c)) AS loaded_cells FROM {_GSQL} GROUP BY 1)",
)
_SEEN = [scope.sighting("s1", "gate", D.PARTS[0][0], 60, 600, "g1"), scope.sighting("s2", "yard", D.PARTS[1][0], 0, 90)]
query(
    "scope_sighting_events",
    lambda s, d: scope.sighting_events(C(s, d), scope.sightings(s, _SEEN), scope.cell_groups(s, _GROUPS)).select("sighting_id", "event_id"),
    "SELECT sighting_id, event_id FROM c JOIN (VALUES " + ", ".join(f"('{i}', TIMESTAMP '{a}', TIMESTAMP '{b}', {repr(g) if g else 'NULL'})" for i, _, a, b, g in _SEEN)
    + f") s(sighting_id, a, b, g) ON call_datetime >= a AND call_datetime < b AND (s.g IS NULL OR EXISTS (SELECT 1 FROM {_GSQL} WHERE group_id = s.g AND (k = replace(searched_cell_id, '-', '') OR k = replace(first_cell_id, '-', ''))))",
)
query(
    "scope_sessions_without_standard_id",
    lambda s, d: S(s, d).where("identifier_type <> 'MSISDN'").groupBy("identifier_type").agg(F.count("*").alias("sessions")),
    "SELECT identifier_type, count(*) AS sessions FROM s WHERE identifier_type <> 'MSISDN' GROUP BY 1",
)

# ---- what builds on the above -------------------------------------------------------------------------------------
from datetime import datetime  # noqa: E402

from ..operators import cdr, presence  # noqa: E402

_SPEC = {"towers": {"cells": ["first_cell_id"]}, "contacts": {"numbers": ["other_party"]}}


def small_bundle(spark, sf_dir):
    calls = C(spark, sf_dir)
    return {"towers": calls.groupBy("first_cell_id").agg(F.count("*").alias("n")), "contacts": calls.groupBy("other_party").agg(F.count("*").alias("n"))}


query(
    "master_enrich_bundle_numbers",
    lambda s, d: master.enrich_bundle(small_bundle(s, d), D.number_master(s, d), D.cell_master(s, d), _SPEC)["contacts"],
    "SELECT other_party, n, name AS other_party_name, circle AS other_party_circle, CASE WHEN ms IS NULL THEN 'INVALID_KEY' WHEN mobile_number IS NOT NULL THEN 'FOUND' ELSE 'NOT_FOUND' END AS other_party_lookup FROM (SELECT other_party, ms, count(*) AS n FROM c GROUP BY 1, 2) LEFT JOIN nm ON ms = mobile_number",
)
query(
    "master_bundle_missing_cells",
    lambda s, d: master.bundle_missing_cells(small_bundle(s, d), D.cell_master(s, d), _SPEC),
    "SELECT 'towers' AS table_name, first_cell_id AS cell_key, 1::BIGINT AS records FROM (SELECT DISTINCT first_cell_id FROM c WHERE vc) WHERE first_cell_id NOT IN (SELECT cgi FROM cm)",
)
_M0 = datetime(2024, 1, 1, 0, 8)
_MSQL = "SELECT {0}, count(*) AS records, count(DISTINCT sub) AS numbers FROM i WHERE {0} <> '' AND date_trunc('minute', event_time) = TIMESTAMP '2024-01-01 00:08:00' GROUP BY 1"
for _k, _c in (("numbers", "subscriber_number"), ("cells", "searched_cell_id"), ("devices", "imei"), ("sims", "imsi")):
    query(f"ip_moment_{_k}", lambda s, d, k=_k: presence.moment_bundle(IP(s, d), _M0)[k], _MSQL.format(_c))


def session_leads(spark, sf_dir):
    rolled = presence.rollup(S(spark, sf_dir), "session_start", "total_volume")
    return {n: presence.bucket(rolled, n, None) for n in ("common_numbers", "priority_leads")}


query(
    "presence_other_identifiers",
    lambda s, d: presence.separate_identifiers(session_leads(s, d))[1],
    """, x AS (SELECT sub AS subscriber_number, count(*) AS n, least(count(*), 50) + count(DISTINCT sc) * 10 + CASE WHEN count(DISTINCT im) > 1 THEN 25 ELSE 0 END + CASE WHEN count(DISTINCT imsi) > 1 THEN 25 ELSE 0 END
 + CASE WHEN count(*) FILTER (WHERE hour(session_start) >= 22 OR hour(session_start) <= 5) > 0 THEN 15 ELSE 0 END + CASE WHEN sum(total_volume) > 0 THEN 5 ELSE 0 END AS priority_score FROM s WHERE sub IS NOT NULL AND identifier_type <> 'MSISDN' GROUP BY 1)
SELECT subscriber_number, priority_score, CASE WHEN n >= 2 THEN 'common_numbers' ELSE 'priority_leads' END AS lead_list FROM x""",
)
query("function_is_target", lambda s, d: C(s, d).where(I.is_target("other_party", "91" + "9000000008")).select("event_id"), "SELECT event_id FROM c WHERE other_party = '9000000008'")
query("cdr_human_contacts", lambda s, d: cdr.only_category(C(s, d), cdr.HUMAN).select("event_id", "other_party"), "SELECT event_id, other_party FROM c WHERE cat = 'human_mobile'")
query("cdr_last_event", lambda s, d: cdr.latest_by(C(s, d).where("call_datetime is not null"), ("target",)).select("target", "event_id"), "SELECT target, arg_max(event_id, (call_datetime, event_id)) AS event_id FROM c WHERE call_datetime IS NOT NULL GROUP BY 1")
