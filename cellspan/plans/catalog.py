"""Every operator as a query over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..operators import cdr, cross_target, devices, ip_events, master, parts, presence, sessions, spots, towers
from . import domain as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = D.CTES + sql


def on(view, f, *args, **kw):
    return lambda spark, sf_dir: f(view(spark, sf_dir), *args, **kw)


C, S, IP = D.calls, D.sessions, D.ip_events
T = ("target",)
IN, OUT = "lower(trim(call_type)) IN ('incoming', 'mtc', 'a_in')", "lower(trim(call_type)) IN ('outgoing', 'moc', 'a_out')"
SMS = "contains(lower(call_type), 'sms')"
HUMAN = "cat = 'human_mobile'"
NIGHT = "(h >= 22 OR h < 6)"


def lst(x: str) -> str:
    return f"coalesce(string_agg(DISTINCT {x}, ', ' ORDER BY {x}) FILTER (WHERE trim({x}) <> ''), '')"


def top(src: str, by: str, value: str, cond: str = "TRUE") -> str:
    """The most frequent value of each group, of equals the smallest."""
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    return (
        f"(SELECT {keys}v FROM (SELECT {keys}{value} AS v, row_number() OVER ({part}ORDER BY count(*) DESC, {value}) AS rn"
        f" FROM {src} WHERE {value} IS NOT NULL AND {cond} GROUP BY {keys}{value}) WHERE rn = 1)"
    )


# ---- call records of a target -------------------------------------------------------------------------------------
_SUMMARY = f"""count(*) AS total_records, count(*) FILTER (WHERE {IN}) AS incoming_calls, count(*) FILTER (WHERE {OUT}) AS outgoing_calls,
 count(*) FILTER (WHERE regexp_matches(call_type, 'smsin|sms_mt|a2p_smsin')) AS incoming_sms,
 count(*) FILTER (WHERE regexp_matches(call_type, 'smsout|sms_mo|p2p_smsout')) AS outgoing_sms,
 count(*) FILTER (WHERE NOT {IN} AND NOT {OUT} AND NOT {SMS} AND call_type <> '') AS other_call_types,
 floor(coalesce(round(sum((call_duration)::DECIMAL(28,6)), 6)::DOUBLE, 0))::BIGINT AS duration_seconds,
 count(DISTINCT nullif(other_party, '')) AS unique_counterparties,
 count(DISTINCT other_party) FILTER (WHERE {HUMAN}) AS unique_human_contacts,
 count(*) FILTER (WHERE cat = 'service_sender_id') AS sender_records, count(*) FILTER (WHERE cat = 'short_code') AS short_code_records,
 count(DISTINCT im) AS unique_imei, count(DISTINCT imsi) AS unique_imsi,
 count(DISTINCT first_cell_id) FILTER (WHERE vc) AS unique_valid_cells, count(*) FILTER (WHERE NOT vc) AS invalid_cell_rows,
 min(call_datetime) AS first_seen, max(call_datetime) AS last_seen, count(DISTINCT call_datetime::DATE) AS active_days"""
query("cdr_summary", on(C, cdr.summary), f"SELECT {_SUMMARY} FROM c")
query("cdr_target_summary", on(C, cdr.summary, by=T), f"SELECT target, {_SUMMARY} FROM c GROUP BY target")
query(
    "cdr_activity",
    on(C, cdr.activity, by=T),
    f"""SELECT a.*, v AS most_active FROM (SELECT target, count(*) AS total_events, count(DISTINCT other_party) AS unique_numbers,
 round(sum((coalesce(call_duration, 0))::DECIMAL(28,6)), 4)::DOUBLE AS duration_seconds, (2 * sum(round(coalesce(call_duration, 0) * 1e6)::HUGEINT) + 100 * count(*)) // (200 * count(*)) / 10000.0::DOUBLE AS average_duration FROM c GROUP BY target) a
 LEFT JOIN {top('c', 'target', 'other_party')} t USING (target)""",
)
query(
    "cdr_hourly_activity",
    on(C, cdr.hourly),
    """, x AS (SELECT r.range::INTEGER AS hour, count(h) AS total_events FROM range(24) r LEFT JOIN c ON h = r.range GROUP BY 1)
SELECT hour, printf('%02d:00-%02d:59', hour, hour) AS time_window, total_events,
 round(100.0 * total_events / greatest(sum(total_events) OVER (), 1), 2) AS share_percent,
 rank() OVER (ORDER BY total_events DESC)::INTEGER AS activity_rank FROM x""",
)
query("cdr_daily_activity", on(C, cdr.daily), "SELECT strftime(call_datetime, '%d-%m-%Y') AS date, count(*) AS total_events FROM c WHERE call_datetime IS NOT NULL GROUP BY 1")
query(
    "cdr_weekly_activity",
    on(C, cdr.weekly),
    """SELECT isoyear(m)::INTEGER AS iso_year, weekofyear(m)::INTEGER AS iso_week, printf('%d-W%02d', isoyear(m), weekofyear(m)) AS year_week,
 strftime(m, '%d-%m-%Y') || ' to ' || strftime(m + INTERVAL 6 DAY, '%d-%m-%Y') AS date_range, n AS total_events, d AS active_days, round(n / d, 2) AS average_per_day
 FROM (SELECT date_trunc('week', call_datetime) AS m, count(*) AS n, count(DISTINCT call_datetime::DATE) AS d FROM c WHERE call_datetime IS NOT NULL GROUP BY 1)""",
)
query(
    "cdr_monthly_activity",
    on(C, cdr.monthly),
    "SELECT year(call_datetime)::INTEGER AS year, month(call_datetime)::INTEGER AS month, strftime(call_datetime, '%Y-%m') AS year_month, count(*) AS total_events FROM c WHERE call_datetime IS NOT NULL GROUP BY 1, 2, 3",
)
_MS = "SELECT ms AS contact, count(*) AS total_events FROM c WHERE ms IS NOT NULL GROUP BY 1 ORDER BY 2 {}, 1 LIMIT {}"
query("cdr_top_contacts", on(C, cdr.top_contacts), _MS.format("DESC", 20))
query("cdr_bottom_contacts", on(C, cdr.bottom_contacts), _MS.format("", 10))
query(
    "cdr_top_contacts_by_target",
    on(C, cdr.top_contacts, limit=3, by=T),
    """SELECT target, contact, total_events FROM (SELECT target, ms AS contact, count(*) AS total_events,
 row_number() OVER (PARTITION BY target ORDER BY count(*) DESC, ms) AS rn FROM c WHERE ms IS NOT NULL GROUP BY 1, 2) WHERE rn <= 3""",
)
_CAT = "SELECT other_party AS contact, count(*) AS total_events FROM c WHERE cat = '{}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"
query("cdr_top_service_senders", on(C, cdr.top_senders), _CAT.format("service_sender_id"))
query("cdr_top_short_codes", on(C, cdr.top_short_codes), _CAT.format("short_code"))
query("cdr_contact_categories", on(C, cdr.category_counts), "SELECT cat AS contact_category, count(*) AS total_records FROM c GROUP BY 1")
_MEANING = """CASE lower(trim(call_type)) WHEN 'incoming' THEN 'Incoming Voice Call' WHEN 'outgoing' THEN 'Outgoing Voice Call' WHEN 'smsin' THEN 'Incoming SMS'
 WHEN 'smsout' THEN 'Outgoing SMS' WHEN 'sms' THEN 'SMS Event' ELSE 'Other / Unclassified Operator Event' END"""
query("cdr_call_types", on(C, cdr.call_type_counts), f"SELECT call_type, count(*) AS total_records, {_MEANING} AS meaning FROM c GROUP BY 1")
query("cdr_unknown_call_types", on(C, cdr.unknown_call_types), f"SELECT call_type, count(*) AS total_records FROM c WHERE {_MEANING} LIKE 'Other%' AND call_type <> '' GROUP BY 1")
_CONTACT = f"""SELECT other_party AS contact, count(*) AS total_events, count(*) FILTER (WHERE {IN}) AS incoming, count(*) FILTER (WHERE {OUT}) AS outgoing,
 count(*) FILTER (WHERE {SMS}) AS sms, round(coalesce(sum((call_duration)::DECIMAL(28,6)), 0), 4)::DOUBLE AS total_duration, count(DISTINCT first_cell_id) AS unique_towers FROM c WHERE {HUMAN} GROUP BY 1"""
query(
    "cdr_contact_ranking",
    on(C, cdr.contact_ranking),
    f"SELECT *, round(total_events * 2.0 + total_duration / 60 * 1.0 + unique_towers * 3.0, 6) AS score, '{cdr.RULESET}' AS score_ruleset, '{cdr.CONTACT_FORMULA}' AS score_formula FROM ({_CONTACT})",
)
query(
    "cdr_contact_network",
    on(C, cdr.contact_network),
    f"SELECT *, round(total_events * 5.0 + total_duration / 60 * 1.0, 6) AS strength, '{cdr.RULESET}' AS strength_ruleset, '{cdr.NETWORK_FORMULA}' AS strength_formula FROM ({_CONTACT})",
)
query(
    "cdr_contact_detail",
    on(C, cdr.contact_detail, "8000000007"),
    f"""SELECT count(*) AS total_events, count(*) FILTER (WHERE {IN}) AS incoming, count(*) FILTER (WHERE {OUT}) AS outgoing,
 round(coalesce(sum((call_duration)::DECIMAL(28,6)), 0), 4)::DOUBLE AS total_duration, min(call_datetime) AS first_seen, max(call_datetime) AS last_seen,
 count(DISTINCT nullif(first_cell_id, '')) AS unique_towers FROM c WHERE other_party = '8000000007'""",
)
query(
    "cdr_full_contact_summary",
    on(C, cdr.full_contact_summary),
    f""", x AS (SELECT *, CASE WHEN regexp_matches(other_party, '[0-9]') THEN regexp_replace(other_party, '[^0-9]', '', 'g') ELSE coalesce(other_party, '') END AS contact FROM c)
SELECT a.*, b.v AS most_used_tower FROM (SELECT target, contact, count(*) AS total_events, min(call_datetime) AS first_seen, max(call_datetime) AS last_seen,
 count(DISTINCT first_cell_id) FILTER (WHERE vc) AS unique_towers,
 arg_max(first_cell_id, (call_datetime, event_id)) FILTER (WHERE vc AND call_datetime IS NOT NULL) AS last_tower FROM x WHERE contact <> '' GROUP BY 1, 2) a
 LEFT JOIN {top('x', 'target, contact', 'first_cell_id', 'vc')} b USING (target, contact)""",
)
query(
    "cdr_location_overview",
    on(C, cdr.location_overview, by=T),
    f"""SELECT a.*, v AS most_used_cell FROM (SELECT target, count(*) FILTER (WHERE vc) AS valid_rows, count(*) FILTER (WHERE NOT vc) AS invalid_rows,
 count(DISTINCT first_cell_id) FILTER (WHERE vc) AS unique_cells FROM c GROUP BY 1) a LEFT JOIN {top('c', 'target', 'first_cell_id', 'vc')} t USING (target)""",
)
_FREQ = "SELECT first_cell_id, count(*) AS total_events FROM c WHERE vc GROUP BY 1 ORDER BY 2 {}, 1 LIMIT {}"
query("cdr_frequent_cells", on(C, cdr.frequent_cells), _FREQ.format("DESC", 5))
query("cdr_bottom_cells", on(C, cdr.frequent_cells, limit=10, ascending=True), _FREQ.format("", 10))
query(
    "cdr_tower_profile",
    on(C, cdr.tower_profile),
    f"""SELECT a.*, coalesce(b.v, 'N/A') AS most_used_imei, coalesce(d.v, 'N/A') AS most_contacted, coalesce(e.v, 'N/A') AS top_sender FROM
 (SELECT first_cell_id, min(call_datetime) AS first_seen, max(call_datetime) AS last_seen, count(*) AS total_events,
 count(DISTINCT other_party) FILTER (WHERE {HUMAN}) AS unique_human_contacts, count(*) FILTER (WHERE cat = 'service_sender_id') AS sender_events,
 count(*) FILTER (WHERE cat = 'short_code') AS short_code_events, count(DISTINCT im) AS unique_imei, round(coalesce(sum((call_duration)::DECIMAL(28,6)), 0), 4)::DOUBLE AS duration_seconds
 FROM c WHERE vc GROUP BY 1) a LEFT JOIN {top('c', 'first_cell_id', 'im', 'vc')} b USING (first_cell_id)
 LEFT JOIN {top('c', 'first_cell_id', 'other_party', f'vc AND {HUMAN}')} d USING (first_cell_id)
 LEFT JOIN {top('c', 'first_cell_id', 'other_party', "vc AND cat = 'service_sender_id'")} e USING (first_cell_id)""",
)
_HT = f"count(*) AS events, count(DISTINCT call_datetime::DATE) AS days, count(DISTINCT other_party) FILTER (WHERE {HUMAN}) AS unique_human_contacts"
query("cdr_home_tower", on(C, cdr.home_tower, by=T), f"SELECT target, first_cell_id, {_HT}, '22:00-06:00' AS \"window\", 'CDR-RULES-1.0' AS ruleset FROM c WHERE vc AND {NIGHT} GROUP BY 1, 2")
query("cdr_work_tower", on(C, cdr.work_tower, by=T), f"SELECT target, first_cell_id, {_HT} FROM c WHERE vc AND h BETWEEN 9 AND 18 GROUP BY 1, 2")
_LUHN = "(10 - (list_sum(list_transform(range(1, 15), lambda k: CASE WHEN k % 2 = 1 THEN im[k]::INT ELSE (2 * im[k]::INT) // 10 + (2 * im[k]::INT) % 10 END)) % 10)) % 10 = im[15]::INT"
query(
    "cdr_device_summary",
    on(C, cdr.device_summary),
    f""", x AS (SELECT *, {_LUHN} AS ok FROM c WHERE im IS NOT NULL)
SELECT a.*, coalesce(b.v, '') AS most_used_tower, coalesce(d.v, '') AS most_contacted FROM
 (SELECT dev AS device_key, {lst('imei')} AS observed_imei, CASE WHEN bool_or(ok) AND bool_or(NOT ok) THEN 'Valid IMEI with check-digit variation'
 WHEN bool_or(ok) THEN 'Valid 15-digit IMEI' ELSE 'IMEI check digit not verified' END AS imei_status,
 min(call_datetime) AS first_seen, max(call_datetime) AS last_seen, count(*) AS total_events, count(DISTINCT ms) FILTER (WHERE {HUMAN}) AS unique_human_contacts,
 count(DISTINCT first_cell_id) FILTER (WHERE vc) AS unique_valid_towers, round(coalesce(sum((call_duration)::DECIMAL(28,6)), 0), 4)::DOUBLE AS duration_seconds,
 coalesce(string_agg(DISTINCT imei, ', ' ORDER BY imei) FILTER (WHERE ok), '') AS valid_imei,
 coalesce(string_agg(DISTINCT imei, ', ' ORDER BY imei) FILTER (WHERE NOT ok), '') AS invalid_imei FROM x GROUP BY 1) a
 LEFT JOIN {top('x', 'dev', 'first_cell_id', 'vc')} b ON device_key = b.dev LEFT JOIN {top('x', 'dev', 'ms', HUMAN)} d ON device_key = d.dev""",
)
query(
    "cdr_sim_summary",
    on(C, cdr.sim_summary),
    f"""SELECT a.*, v AS most_used_device FROM (SELECT imsi, min(call_datetime) AS first_seen, max(call_datetime) AS last_seen, count(*) AS total_events,
 count(DISTINCT nullif(dev, '')) AS unique_devices FROM c GROUP BY 1) a LEFT JOIN {top('c', 'imsi', 'dev', "dev <> ''")} t USING (imsi)""",
)
query(
    "cdr_review_indicators",
    on(C, cdr.review_indicators, by=T),
    """, x AS (SELECT * FROM c WHERE call_datetime IS NOT NULL),
y AS (SELECT target, count(*) FILTER (WHERE h < 4) AS a, count(DISTINCT other_party) AS b, count(DISTINCT imei) AS d FROM x GROUP BY 1)
SELECT target, 'Late-Night Activity Indicator' AS indicator, a AS records, 'Communication observed between 00:00-04:00; context required' AS remark, 'CDR-RULES-1.0' AS ruleset FROM y WHERE a > 0
UNION ALL SELECT target, 'High Contact Diversity Dispersion', b, 'A large number of unique contacts was observed', 'CDR-RULES-1.0' FROM y WHERE b > 100
UNION ALL SELECT target, 'Multiple Handset Usage Indicator', d, 'SIM identity observed with multiple IMEIs', 'CDR-RULES-1.0' FROM y WHERE d > 1
UNION ALL SELECT target, 'High Daily Activity Indicator', count(*), 'High event volume observed on ' || call_datetime::DATE, 'CDR-RULES-1.0' FROM x GROUP BY target, call_datetime::DATE HAVING count(*) > 50""",
)
query(
    "cdr_common_contacts",
    on(C, cdr.common_contacts),
    "SELECT ms AS contact, count(DISTINCT target) AS targets FROM c WHERE ms IS NOT NULL GROUP BY 1 HAVING count(DISTINCT target) = (SELECT count(DISTINCT target) FROM c)",
)
_MOVE = """, m AS (SELECT * FROM (SELECT target, call_datetime, event_id, first_cell_id, lag(first_cell_id) OVER (PARTITION BY target ORDER BY call_datetime, event_id) AS pc
 FROM c WHERE vc AND call_datetime IS NOT NULL) WHERE pc IS NULL OR pc <> first_cell_id),
tr AS (SELECT * FROM (SELECT target, lag(first_cell_id) OVER w AS from_cell, first_cell_id AS to_cell, lag(call_datetime) OVER w AS from_time, call_datetime AS to_time
 FROM m WINDOW w AS (PARTITION BY target ORDER BY call_datetime, event_id)) WHERE from_cell IS NOT NULL)"""
query("cdr_movement", on(C, cdr.movement), f"{_MOVE} SELECT target, call_datetime, event_id, first_cell_id FROM m")
query("cdr_transitions", on(C, cdr.transitions), f"{_MOVE} SELECT * FROM tr")
query("cdr_movement_pattern", on(C, cdr.movement_pattern), f"{_MOVE} SELECT target, from_cell, to_cell, count(*) AS moves FROM tr GROUP BY ALL")
_CHANGE = """, x AS (SELECT target, event_id, call_datetime, coalesce(imei, '') AS ni, dev AS nd, imsi AS ns, lag(coalesce(imei, '')) OVER w AS oi, lag(dev) OVER w AS od, lag(imsi) OVER w AS os
 FROM c WHERE call_datetime IS NOT NULL WINDOW w AS (PARTITION BY target ORDER BY call_datetime, event_id)),
y AS (SELECT *, coalesce(od, '') <> '' AND nd <> '' AND nd <> od AS dc, coalesce(os, '') <> '' AND ns <> os AS sc2, coalesce(oi, '') <> '' AND ni <> '' AND ni <> oi AS rc FROM x),
z AS (SELECT target, event_id, call_datetime, CASE WHEN dc AND sc2 THEN 'Device and SIM Change' WHEN dc THEN 'Device Change' WHEN sc2 THEN 'SIM Change' WHEN rc THEN 'Identifier Variant' END AS change_type,
 oi AS old_imei, ni AS new_imei, CASE WHEN sc2 THEN os ELSE '' END AS old_imsi, CASE WHEN sc2 THEN ns ELSE '' END AS new_imsi FROM y WHERE dc OR sc2 OR rc)"""
query("cdr_device_change_review", on(C, cdr.change_review), f"{_CHANGE} SELECT * FROM z")
query("cdr_identifier_variants", lambda s, d: cdr.split_changes(cdr.change_review(C(s, d)))[1], f"{_CHANGE} SELECT * FROM z WHERE change_type = 'Identifier Variant'")
query(
    "cdr_first_last_events",
    on(C, cdr.first_and_last_events),
    """SELECT target, call_datetime::DATE AS day, min(call_datetime) AS first_time, arg_min_null(other_party, (call_datetime, event_id)) AS first_party,
 max(call_datetime) AS last_time, arg_max_null(other_party, (call_datetime, event_id)) AS last_party, count(*) AS events FROM c WHERE call_datetime IS NOT NULL GROUP BY 1, 2""",
)
query(
    "cdr_realign_direction",
    lambda s, d: cdr.realign(C(s, d).withColumns({"a_party": F.when(F.col("event_id") % 3 == 0, F.col("other_party")).otherwise(F.col("target")), "b_party": F.when(F.col("event_id") % 3 == 0, F.col("target")).otherwise(F.col("other_party"))}), F.col("target"))
    .groupBy("call_direction", "call_type", (F.col("other_party") == F.col("target")).alias("is_target")).agg(F.count("*").alias("records")),
    """SELECT CASE WHEN call_type IN ('incoming', 'smsin') THEN 'INCOMING' WHEN call_type IN ('outgoing', 'smsout') THEN 'OUTGOING'
 WHEN other_party = target THEN 'UNKNOWN' WHEN event_id % 3 = 0 THEN 'INCOMING' ELSE 'OUTGOING' END AS call_direction, call_type,
 other_party = target AS is_target, count(*) AS records FROM c GROUP BY ALL""",
)
query(
    "cdr_detect_target",
    lambda s, d: cdr.detect_target(C(s, d).where("target = '9000000008'").withColumns({"a_party": F.col("target"), "b_party": F.col("other_party")})),
    "SELECT '9000000008' AS target, count(*) AS n, count(*) AS rows FROM c WHERE target = '9000000008'",
)
query("cdr_observations", on(C, cdr.observations), f"""SELECT unnest(['night_share_percent', 'weekend_share_percent', 'human_share_percent', 'busiest_hour']) AS metric,
 unnest([round(100.0 * count(*) FILTER (WHERE {NIGHT}) / count(*), 2)::VARCHAR, round(100.0 * count(*) FILTER (WHERE dayofweek(call_datetime) IN (0, 6)) / count(*), 2)::VARCHAR,
 round(100.0 * count(*) FILTER (WHERE {HUMAN}) / count(*), 2)::VARCHAR, (SELECT v::VARCHAR FROM {top('c', '', 'h')})]) AS value FROM c""")

# ---- tower dumps --------------------------------------------------------------------------------------------------
query(
    "tower_summary",
    on(C, towers.summary),
    """SELECT count(*) AS total_events, count(DISTINCT sub) AS unique_subscribers, count(DISTINCT sc) AS unique_cells, count(DISTINCT operator) AS unique_operators,
 count(DISTINCT im) AS unique_imei, count(DISTINCT imsi) AS unique_imsi, min(call_datetime) AS first_seen, max(call_datetime) AS last_seen FROM c""",
)
_PER = "count(*) AS total_events, count(DISTINCT sub) AS unique_subscribers, count(DISTINCT im) AS unique_imei, min(call_datetime) AS first_seen, max(call_datetime) AS last_seen"
query("tower_operator_summary", on(C, towers.operator_summary), f"SELECT operator, {_PER} FROM c GROUP BY 1")
query("tower_cell_summary", on(C, towers.cell_summary), f"SELECT searched_cell_id, {_PER} FROM c WHERE sc IS NOT NULL GROUP BY 1")
query("tower_call_types", on(C, towers.call_type_summary), "SELECT call_type, count(*) AS total_events, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share_percent FROM c GROUP BY 1")
_SUBS = """SELECT sub AS subscriber_number, count(*) AS total_events, min(call_datetime) AS first_seen, max(call_datetime) AS last_seen, count(DISTINCT call_datetime::DATE) AS active_days,
 count(DISTINCT searched_cell_id) AS unique_cells, count(DISTINCT operator) AS unique_operators, count(DISTINCT imei) AS unique_imei, count(DISTINCT imsi) AS unique_imsi,
 count(DISTINCT coalesce(other_party, '')) AS unique_other_parties, coalesce(round(round(sum((call_duration)::DECIMAL(28,6)), 4)::DOUBLE), 0)::BIGINT AS total_duration_seconds,
 count(*) FILTER (WHERE call_type = 'incoming') AS incoming_calls, count(*) FILTER (WHERE call_type = 'outgoing') AS outgoing_calls,
 count(*) FILTER (WHERE call_type = 'smsin') AS incoming_sms, count(*) FILTER (WHERE call_type = 'smsout') AS outgoing_sms FROM c WHERE sub IS NOT NULL GROUP BY 1"""
query("tower_subscriber_summary", on(C, towers.subscriber_summary), _SUBS)
query("tower_repeat_visitors", on(C, towers.repeat_visitors, 60), f"SELECT * FROM ({_SUBS}) WHERE total_events >= 60")
query("tower_frequent_visitors", on(C, towers.frequent_visitors, 25), f"SELECT * FROM ({_SUBS}) ORDER BY total_events DESC, unique_cells DESC, active_days DESC, subscriber_number LIMIT 25")
_IDENT = "count(*) AS total_events, count(DISTINCT coalesce(sub, '')) AS unique_subscribers, count(DISTINCT searched_cell_id) AS unique_cells, count(DISTINCT operator) AS unique_operators, min(call_datetime) AS first_seen, max(call_datetime) AS last_seen"
query("tower_imei_summary", on(C, towers.identifier_summary, "imei"), f"SELECT imei, {_IDENT} FROM c WHERE im IS NOT NULL GROUP BY 1")
query("tower_imsi_summary", on(C, towers.identifier_summary, "imsi"), f"SELECT imsi, {_IDENT} FROM c GROUP BY 1")
_SHARED = "SELECT {0}, count(*) AS total_events, count(DISTINCT sub) AS unique_subscribers, count(DISTINCT sc) AS unique_cells, " + lst("sub") + " AS subscribers, " + lst("sc") + " AS cells FROM c WHERE {0} <> '' GROUP BY 1 HAVING count(DISTINCT sub) >= 2"
query("tower_shared_imei", on(C, towers.shared_identifiers, "imei"), _SHARED.format("imei"))
query("tower_shared_imsi", on(C, towers.shared_identifiers, "imsi"), _SHARED.format("imsi"))
_ACROSS = "SELECT sub AS subscriber_number, count(*) AS total_events, count(DISTINCT {0}) AS n_values, " + lst("{0}") + " AS all_values FROM c WHERE sub IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {0}) >= {1}"
query("tower_subscribers_across_cells", on(C, towers.across, "searched_cell_id"), _ACROSS.format("sc", 2))
query("tower_subscribers_across_operators", on(C, towers.across, "operator", 1), _ACROSS.format("operator", 1))
_CELLS = [f"405-51-834-{k:04d}" for k in (1, 2, 3, 4, 5)]
query(
    "tower_subscriber_cell_matrix",
    on(C, towers.subscriber_cell_matrix, _CELLS),
    "SELECT subscriber_number, " + ", ".join(f"count(*) FILTER (WHERE searched_cell_id = '{x}') AS \"{x}\"" for x in _CELLS)
    + ", count(*) FILTER (WHERE searched_cell_id IN (" + ", ".join(f"'{x}'" for x in _CELLS) + ")) AS total, count(DISTINCT searched_cell_id) FILTER (WHERE searched_cell_id IN (" + ", ".join(f"'{x}'" for x in _CELLS) + "))::INTEGER AS n_present FROM c WHERE sub IS NOT NULL GROUP BY 1",
)
query("tower_hourly_activity", on(C, towers.hourly), "SELECT r.range::INTEGER AS hour, count(h) AS total_events, count(DISTINCT sub) AS unique_subscribers FROM range(24) r LEFT JOIN c ON h = r.range GROUP BY 1")
query("tower_daily_activity", on(C, towers.daily), "SELECT call_datetime::DATE AS date, count(*) AS total_events, count(DISTINCT sub) AS unique_subscribers FROM c WHERE call_datetime IS NOT NULL GROUP BY 1")
query("tower_night_events", lambda s, d: towers.night_events(C(s, d)).select("event_id", "call_datetime"), f"SELECT event_id, call_datetime FROM c WHERE {NIGHT}")
_TMOVE = """, m AS (SELECT *, epoch_us(to_datetime - from_datetime) / 1e6 AS time_gap_seconds FROM (SELECT sub AS subscriber_number, lag(sc) OVER w AS from_cell_id, sc AS to_cell_id, lag(call_datetime) OVER w AS from_datetime,
 call_datetime AS to_datetime, operator, source_file FROM c WHERE sub IS NOT NULL AND sc IS NOT NULL AND call_datetime IS NOT NULL
 WINDOW w AS (PARTITION BY sub ORDER BY call_datetime, sc, event_id)) WHERE from_cell_id <> to_cell_id)"""
query("tower_movements", on(C, towers.movements), f"{_TMOVE} SELECT * FROM m")
query(
    "tower_transition_summary",
    on(C, towers.transition_summary),
    f"""{_TMOVE} SELECT from_cell_id, to_cell_id, count(*) AS transition_events, count(DISTINCT subscriber_number) AS unique_subscribers,
 round(min(time_gap_seconds), 7) AS minimum_gap_seconds, round(median(time_gap_seconds), 7) AS median_gap_seconds FROM m GROUP BY 1, 2""",
)
query(
    "tower_indicators",
    on(C, towers.indicators),
    f""", su AS ({_SUBS}), e AS (SELECT greatest(quantile_cont(total_events, 0.99), 25) AS edge FROM su)
SELECT 'SHARED_IMEI' AS indicator, imei AS entity, 'HIGH' AS severity, 'IMEI linked with ' || unique_subscribers || ' subscribers; cells=' || unique_cells AS details FROM ({_SHARED.format('imei')})
UNION ALL SELECT 'SHARED_IMSI', imsi, 'HIGH', 'IMSI linked with ' || unique_subscribers || ' subscriber numbers.' FROM ({_SHARED.format('imsi')})
UNION ALL SELECT 'MULTI_CELL_PRESENCE', subscriber_number, 'MEDIUM', 'Subscriber found in ' || n_values || ' searched cells; events=' || total_events FROM ({_ACROSS.format('sc', 2)})
UNION ALL SELECT 'MULTI_OPERATOR_IDENTITY', subscriber_number, 'MEDIUM', 'Same normalized number appeared in ' || n_values || ' operators.' FROM ({_ACROSS.format('operator', 2)})
UNION ALL SELECT 'HIGH_EVENT_VOLUME', subscriber_number, 'LOW', 'Subscriber has ' || total_events || ' events.' FROM su, e WHERE total_events >= edge""",
)

# ---- presence -----------------------------------------------------------------------------------------------------


def _rollup_sql(src: str, time: str, extra: str = "", points: str = "") -> str:
    return f"""SELECT *, CASE WHEN priority_score >= 85 THEN 'High' WHEN priority_score >= 55 THEN 'Medium' ELSE 'Low' END AS priority,
 CASE WHEN pts >= 3 THEN 'High' WHEN pts >= 2 THEN 'Medium' ELSE 'Low' END AS confidence,
 coalesce(nullif(concat_ws(', ', CASE WHEN cells_seen >= 2 THEN 'multi-cell presence' END, CASE WHEN event_count >= 2 THEN 'repeat/high activity' END,
 CASE WHEN event_count = 1 THEN 'single-event/rare presence' END, CASE WHEN imei_count >= 2 THEN 'multiple IMEI' END,
 CASE WHEN imsi_count >= 2 THEN 'multiple IMSI' END, CASE WHEN night_event_count > 0 THEN 'night-time activity' END), ''), 'review recommended') AS why_important FROM (
 SELECT *, (event_count >= 3)::INT + (cells_seen >= 2)::INT + (imei_count >= 2)::INT + (imsi_count >= 2)::INT + (night_event_count > 0)::INT AS pts,
 least(event_count, 50) + cells_seen * 10 + CASE WHEN imei_count > 1 THEN 25 ELSE 0 END + CASE WHEN imsi_count > 1 THEN 25 ELSE 0 END + CASE WHEN night_event_count > 0 THEN 15 ELSE 0 END {points} AS priority_score
 FROM (SELECT sub AS subscriber_number, count(*) AS event_count, min({time}) AS first_seen, max({time}) AS last_seen,
 count(*) FILTER (WHERE hour({time}) >= 22 OR hour({time}) <= 5) AS night_event_count, count(DISTINCT sc) AS cells_seen, count(DISTINCT im) AS imei_count, count(DISTINCT imsi) AS imsi_count,
 left({lst('operator')}, 500) AS operators, left({lst('sc')}, 700) AS searched_cells {extra} FROM {src} WHERE sub IS NOT NULL GROUP BY 1))"""


_ROLL = f"SELECT * EXCLUDE (pts) FROM ({_rollup_sql('c', 'call_datetime', ', count(DISTINCT nullif(other_party, $$$$)) AS other_party_count')})"
_SROLL = f"SELECT * EXCLUDE (pts) FROM ({_rollup_sql('s', 'session_start', ', round(coalesce(sum((total_volume)::DECIMAL(28,6)), 0), 4)::DOUBLE AS total_volume', '+ CASE WHEN total_volume > 0 THEN 5 ELSE 0 END')})"
query("presence_rollup", on(C, presence.rollup), _ROLL)
query("presence_session_rollup", on(S, presence.rollup, time="session_start", volume="total_volume"), _SROLL)
for _name, (_cond, _order) in presence.BUCKETS.items():
    _by = ", ".join(f"{o} NULLS LAST" for o in _order)
    query(f"presence_{_name}", lambda s, d, n=_name: presence.bucket(presence.rollup(C(s, d)), n, 40), f"SELECT * FROM ({_ROLL}) WHERE {_cond} ORDER BY {_by}, subscriber_number LIMIT 40")
query(
    "presence_session_priority_leads",
    lambda s, d: presence.bucket(presence.rollup(S(s, d), "session_start", "total_volume"), "priority_leads", 40),
    f"SELECT * FROM ({_SROLL}) ORDER BY priority_score DESC, cells_seen DESC, event_count DESC, subscriber_number LIMIT 40",
)


def _frame_sql(src: str, time: str, first: str, party: str, volume: str, edge: str) -> str:
    return f""", a AS (SELECT sub AS subscriber_number, count(*) AS event_count, count(*) FILTER (WHERE hour({time}) >= 22 OR hour({time}) < 5) AS night_event_count,
 greatest(count(DISTINCT searched_cell_id), {first}) AS cells_seen, count(DISTINCT imei) AS imei_count, count(DISTINCT imsi) AS imsi_count, ({party})::BIGINT AS other_party_count, {volume} AS total_volume FROM {src} WHERE sub IS NOT NULL GROUP BY 1),
b AS (SELECT *, CASE WHEN event_count = 1 THEN 25 ELSE 0 END + CASE WHEN cells_seen >= 2 THEN 35 ELSE 0 END + CASE WHEN event_count >= 5 THEN 25 ELSE 0 END + CASE WHEN imei_count >= 2 THEN 20 ELSE 0 END
 + CASE WHEN imsi_count >= 2 THEN 20 ELSE 0 END + CASE WHEN other_party_count >= 5 THEN 15 ELSE 0 END + CASE WHEN night_event_count >= 1 THEN 15 ELSE 0 END + {edge} AS priority_score FROM a)
SELECT *, CASE WHEN priority_score >= 70 THEN 'High' WHEN priority_score >= 45 THEN 'Medium' ELSE 'Low' END AS priority,
 CASE WHEN cells_seen >= 2 AND event_count >= 2 THEN 'High' WHEN event_count >= 2 THEN 'Medium' ELSE 'Low' END AS confidence FROM b"""


query("presence_frame_score", on(C, presence.frame_presence), _frame_sql("c", "call_datetime", "count(DISTINCT first_cell_id)", "count(DISTINCT other_party)", "0.0::DOUBLE", "0"))
query(
    "presence_session_frame_score",
    on(S, presence.frame_presence, volume="total_volume", time="session_start"),
    _frame_sql("s", "session_start", "0", "0", "round(coalesce(sum((total_volume)::DECIMAL(28,6)), 0), 4)::DOUBLE", "CASE WHEN total_volume > 0 AND total_volume >= (SELECT quantile_cont(total_volume, 0.9) FROM a) THEN 15 ELSE 0 END"),
)
W0, W1 = datetime(2024, 1, 28), datetime(2024, 1, 29)


def _uncommon_sql(src: str, inside: str, time: str, min_score: int = 50) -> str:
    return f""", w AS (SELECT *, coalesce({inside}, FALSE) AS now FROM {src} WHERE sub IS NOT NULL),
a AS (SELECT sub AS entity, count(*) AS current_seen_count, min({time}) AS first_seen, max({time}) AS last_seen, count(DISTINCT sc) AS cells_seen, count(DISTINCT im) AS imei_count, count(DISTINCT imsi) AS imsi_count FROM w WHERE now GROUP BY 1),
b AS (SELECT a.*, coalesce(n, 0) AS baseline_seen_count FROM a LEFT JOIN (SELECT sub, count(*) AS n FROM w WHERE NOT now GROUP BY 1) ON sub = entity),
d AS (SELECT *, CASE WHEN baseline_seen_count = 0 THEN 100 WHEN baseline_seen_count <= 2 THEN 85 WHEN current_seen_count >= 5 AND baseline_seen_count <= 5 THEN 75 WHEN cells_seen >= 3 THEN 70
 WHEN imei_count >= 2 THEN 65 WHEN imsi_count >= 2 THEN 60 WHEN current_seen_count = 1 THEN 50 ELSE 30 END AS rarity_score FROM b),
f AS (SELECT *, CASE rarity_score WHEN 100 THEN 'Not seen in baseline' WHEN 85 THEN 'Very rare in baseline' WHEN 75 THEN 'Low baseline presence but repeated in current window' WHEN 70 THEN 'Seen across multiple cells'
 WHEN 65 THEN 'Multiple IMEI observed' WHEN 60 THEN 'Multiple IMSI observed' WHEN 50 THEN 'Single current appearance' ELSE 'Common or low-priority presence' END AS reason,
 CASE WHEN rarity_score >= 100 AND cells_seen >= 3 THEN 'HIGH' WHEN rarity_score >= 100 AND current_seen_count >= 100 THEN 'HIGH' WHEN rarity_score >= 85 AND baseline_seen_count <= 2 AND current_seen_count >= 5 THEN 'MEDIUM_HIGH'
 WHEN cells_seen >= 2 THEN 'MEDIUM_HIGH' WHEN imei_count >= 2 OR imsi_count >= 2 THEN 'MEDIUM' WHEN rarity_score >= 100 THEN 'MEDIUM' ELSE 'LOW' END AS priority_level,
 CASE WHEN rarity_score >= 100 AND cells_seen >= 3 THEN 'Multi-cell uncommon presence' WHEN rarity_score >= 100 AND current_seen_count >= 100 THEN 'High activity only in current window'
 WHEN rarity_score >= 85 AND baseline_seen_count <= 2 AND current_seen_count >= 5 THEN 'Rare baseline presence with repeated current activity' WHEN cells_seen >= 2 THEN 'Seen on multiple cells'
 WHEN imei_count >= 2 OR imsi_count >= 2 THEN 'Multiple device/SIM identifiers observed' WHEN rarity_score >= 100 THEN 'Window-only presence' ELSE 'Low-priority uncommon presence' END AS rank_reason FROM d WHERE rarity_score >= {min_score})"""


_UNC = _uncommon_sql("c", f"call_datetime >= TIMESTAMP '{W0}' AND call_datetime < TIMESTAMP '{W1}'", "call_datetime", 0)
query("presence_uncommon_window", on(C, presence.uncommon_in_window, W0, W1, min_score=0), f"{_UNC} SELECT * FROM f")
query(
    "presence_uncommon_sessions",
    on(S, presence.uncommon_sessions, W0, W1, min_score=0),
    _uncommon_sql("s", f"session_start <= TIMESTAMP '{W1}' AND session_end >= TIMESTAMP '{W0}'", "session_start", 0) + " SELECT * FROM f",
)
query(
    "presence_uncommon_priorities",
    lambda s, d: presence.priority_summary(presence.uncommon_in_window(C(s, d), W0, W1, min_score=0)),
    f"{_UNC} SELECT priority_level, count(*) AS numbers, sum(current_seen_count)::BIGINT AS records, CASE priority_level WHEN 'HIGH' THEN 1 WHEN 'MEDIUM_HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END AS priority_order FROM f GROUP BY 1",
)
_AT = datetime(2024, 1, 1, 0, 8)
_NOW = """SELECT sub AS subscriber_number, count(*) AS records_found, count(DISTINCT searched_cell_id) AS cells_seen, count(DISTINCT imei) AS imei_count FROM i
 WHERE sub IS NOT NULL AND date_trunc('{0}', event_time) = TIMESTAMP '{1}' AND NOT EXISTS (SELECT 1 FROM i j WHERE j.sub = i.sub AND date_trunc('{0}', j.event_time) <> TIMESTAMP '{1}') GROUP BY 1"""
query("ip_only_in_minute", on(IP, presence.only_now, _AT, "minute"), _NOW.format("minute", _AT))
query("ip_only_at_second", on(IP, presence.only_now, datetime(2024, 1, 1, 0, 8, 25)), _NOW.format("second", datetime(2024, 1, 1, 0, 8, 25)))
_CNT = "SELECT count(*) AS records_found, count(DISTINCT subscriber_number) AS numbers_found, count(DISTINCT searched_cell_id) AS cells_involved FROM i WHERE date_trunc('{}', event_time) = TIMESTAMP '{}'"
query("ip_minute_count", on(IP, presence.moment_counts, _AT), _CNT.format("minute", _AT))
query("ip_second_count", on(IP, presence.moment_counts, datetime(2024, 1, 1, 0, 8, 25), "second"), _CNT.format("second", datetime(2024, 1, 1, 0, 8, 25)))

# ---- Parts --------------------------------------------------------------------------------------------------------
_IN = "call_datetime >= start_time AND call_datetime < end_time AND (pspot IS NULL OR pspot = spot_id)"


def with_parts(view, f, *args, **kw):
    return lambda spark, sf_dir: f(view(spark, sf_dir), D.parts(spark), *args, **kw)


query(
    "parts_overlapping",
    lambda s, d: parts.overlapping(D.parts(s)),
    "SELECT a.part_no AS part_a, b.part_no AS part_b, date_diff('second', greatest(a.start_time, b.start_time), least(a.end_time, b.end_time)) AS overlap_seconds FROM p a JOIN p b ON a.part_no < b.part_no AND a.start_time < b.end_time AND b.start_time < a.end_time",
)
query("parts_assign", lambda s, d: parts.assign(C(s, d), D.parts(s)).select("event_id", "part_no"), f"SELECT event_id, part_no FROM c JOIN p ON {_IN}")
query(
    "parts_summary",
    with_parts(C, parts.part_summary),
    f"""SELECT part_no, part_name, count(event_id) AS records, count(DISTINCT sub) AS subscribers, count(DISTINCT sc) AS cells, min(call_datetime) AS first_activity, max(call_datetime) AS last_activity,
 CASE WHEN count(event_id) > 0 THEN 'HAS_DATA' ELSE 'NO_DATA' END AS status FROM p LEFT JOIN c ON {_IN} GROUP BY 1, 2""",
)
_PRES = "count(DISTINCT part_no) AS parts_matched, count(*) AS records, " + lst("part_name") + " AS parts_seen, " + ", ".join(f"max((part_no = {k})::INT) AS part_{k}" for k in (1, 2, 3)) + ", count(DISTINCT part_no) || '/3' AS presence_ratio"
query("parts_subscriber_presence", with_parts(C, parts.presence, 3), f"SELECT subscriber_number, {_PRES} FROM c JOIN p ON {_IN} WHERE sub IS NOT NULL GROUP BY 1")
query("parts_imei_presence", with_parts(C, parts.presence, 3, entity="imei"), f"SELECT imei, {_PRES} FROM c JOIN p ON {_IN} WHERE im IS NOT NULL GROUP BY 1")
query(
    "parts_visitors",
    with_parts(C, parts.visitors),
    f""", r AS (SELECT * FROM c WHERE sub IS NOT NULL AND call_datetime IS NOT NULL), n AS (SELECT sub, count(*) AS al FROM r GROUP BY 1),
a AS (SELECT part_no, r.subscriber_number, count(*) AS current_seen_count, count(DISTINCT sc) AS cells_seen, count(DISTINCT im) AS imei_count, count(DISTINCT imsi) AS imsi_count FROM r JOIN p ON {_IN} GROUP BY 1, 2),
b AS (SELECT a.*, al - current_seen_count AS baseline_seen_count FROM a JOIN n ON subscriber_number = sub),
t AS (SELECT *, CASE WHEN baseline_seen_count = 0 THEN 'NEW VISITOR' WHEN baseline_seen_count <= 2 AND current_seen_count >= 2 THEN 'RARE REPEAT VISITOR' WHEN baseline_seen_count <= 2 THEN 'RARE VISITOR'
 WHEN baseline_seen_count <= 5 AND current_seen_count >= 2 THEN 'REPEAT RELEVANT VISITOR' ELSE 'REGULAR / LOCAL PRESENCE' END AS visitor_type,
 cells_seen >= 2 OR imei_count >= 2 OR imsi_count >= 2 AS strong FROM b)
SELECT * EXCLUDE (strong), CASE WHEN current_seen_count >= 2 AND (baseline_seen_count <= 2 OR cells_seen >= 2) THEN 'HIGH' WHEN current_seen_count >= 2 OR baseline_seen_count <= 2 OR cells_seen >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS visitor_confidence,
 CASE WHEN visitor_type IN ('NEW VISITOR', 'RARE REPEAT VISITOR') THEN CASE WHEN current_seen_count >= 2 OR strong THEN 'HIGH' ELSE 'MEDIUM' END
 WHEN visitor_type IN ('REPEAT RELEVANT VISITOR', 'RARE VISITOR') THEN CASE WHEN strong THEN 'HIGH' ELSE 'MEDIUM' END WHEN strong THEN 'MEDIUM' ELSE 'LOW' END AS visitor_priority,
 concat_ws('; ', CASE visitor_type WHEN 'NEW VISITOR' THEN 'not seen outside the Part' WHEN 'REPEAT RELEVANT VISITOR' THEN 'seldom outside the Part but repeatedly in it' WHEN 'REGULAR / LOCAL PRESENCE' THEN 'seen regularly outside the Part' ELSE 'hardly seen outside the Part' END,
 CASE WHEN cells_seen >= 2 THEN 'several cells in the Part' END, CASE WHEN imei_count >= 2 THEN 'several IMEI' END, CASE WHEN imsi_count >= 2 THEN 'several IMSI' END) AS visitor_reason FROM t""",
)
query("parts_cell_scope", lambda s, d: parts.in_cells(C(s, d), _CELLS[:2]).select("event_id"), f"SELECT event_id FROM c WHERE searched_cell_id IN ('{_CELLS[0]}', '{_CELLS[1]}') OR first_cell_id IN ('{_CELLS[0]}', '{_CELLS[1]}')")
query(
    "parts_active_cells",
    on(C, parts.active_cells, W0, datetime(2024, 1, 28, 6)),
    f"""SELECT *, CASE WHEN active_cells = 0 THEN 'NONE' WHEN active_cells = 1 THEN 'HIGH' WHEN active_cells < loaded_cells THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM
 (SELECT count(DISTINCT sc) AS loaded_cells, count(DISTINCT sc) FILTER (WHERE call_datetime >= TIMESTAMP '{W0}' AND call_datetime < TIMESTAMP '2024-01-28 06:00:00') AS active_cells FROM c)""",
)
_OV = "session_start < end_time AND session_end > start_time AND (pspot IS NULL OR pspot = spot_id)"
_OVS = "greatest(epoch_us(least(session_end, end_time) - greatest(session_start, start_time)) / 1e6, 0)"
query("parts_session_overlap", lambda s, d: parts.session_overlap(S(s, d), D.parts(s)).select("event_id", "part_no", F.round("overlap_seconds", 6).alias("overlap_seconds")), f"SELECT event_id, part_no, round({_OVS}, 6) AS overlap_seconds FROM s JOIN p ON {_OV}")
query("parts_excluded_sessions", lambda s, d: parts.excluded_sessions(S(s, d), D.parts(s), _CELLS).select("event_id", "part_no", "exclusion_reason"), f"SELECT event_id, part_no, 'TIME_MATCH_LOCATION_MISMATCH' AS exclusion_reason FROM s JOIN p ON {_OV} WHERE searched_cell_id NOT IN ({', '.join(repr(x) for x in _CELLS)})")
query(
    "parts_session_presence",
    with_parts(S, parts.session_presence),
    f"SELECT subscriber_number, count(DISTINCT part_no) AS parts_matched, count(*) AS sessions, round(sum(({_OVS})::DECIMAL(28,6)), 6)::DOUBLE AS overlap_seconds, round(sum((total_volume)::DECIMAL(28,6)), 4)::DOUBLE AS total_volume FROM s JOIN p ON {_OV} WHERE sub IS NOT NULL GROUP BY 1",
)
query(
    "parts_allocation_overlap",
    lambda s, d: parts.allocation_overlap(IP(s, d), D.parts(s)).select("allocation_volume_key", "event_id", "part_no"),
    """SELECT allocation_volume_key, event_id, part_no FROM (SELECT *, row_number() OVER (PARTITION BY allocation_volume_key ORDER BY event_time NULLS FIRST, event_id) AS rn FROM i)
 JOIN p ON allocation_start <= end_time AND allocation_end >= start_time AND (pspot IS NULL OR pspot = spot_id) WHERE rn = 1""",
)
_A, _B = D.PARTS[2][:2]
_NOWC = f"(coalesce(event_time >= TIMESTAMP '{_A}' AND event_time < TIMESTAMP '{_B}', FALSE) AND spot_id = 'SPOT-02')"
query(
    "parts_three_level_classification",
    on(IP, parts.classify, _A, _B, "SPOT-02", [(D.PARTS[0][0], D.PARTS[0][1], None)]),
    f""", w AS (SELECT *, {_NOWC} AS now, coalesce(event_time >= TIMESTAMP '{_A}' AND event_time < TIMESTAMP '{_B}', FALSE) AS win FROM i WHERE sub IS NOT NULL),
a AS (SELECT sub AS mobile_number, count(*) FILTER (WHERE now) AS selected_period_records, count(DISTINCT sc) FILTER (WHERE now) AS cells_seen, count(DISTINCT im) FILTER (WHERE now) AS imei_count,
 count(DISTINCT imsi) FILTER (WHERE now) AS imsi_count, min(event_time) FILTER (WHERE now) AS first_seen_selected, max(event_time) FILTER (WHERE now) AS last_seen_selected,
 count(*) FILTER (WHERE event_time >= TIMESTAMP '{D.PARTS[0][0]}' AND event_time < TIMESTAMP '{D.PARTS[0][1]}' AND NOT now) AS other_parts_records,
 count(*) FILTER (WHERE spot_id = 'SPOT-02' AND NOT win) AS same_spot_other_records, count(*) FILTER (WHERE NOT now) AS global_other_records, count(DISTINCT spot_id) FILTER (WHERE NOT now) AS global_other_spot_count FROM w GROUP BY 1),
b AS (SELECT *, CASE WHEN other_parts_records = 0 THEN 'PART_ONLY' ELSE 'SEEN_IN_OTHER_PART' END AS part_status, CASE WHEN same_spot_other_records = 0 THEN 'NEW_IN_SPOT' ELSE 'SEEN_IN_SPOT_OUTSIDE_PART' END AS spot_status,
 CASE WHEN global_other_records = 0 THEN 'GLOBAL_UNCOMMON' ELSE 'SEEN_ELSEWHERE' END AS global_status FROM a WHERE selected_period_records > 0),
d AS (SELECT *, (least(selected_period_records, 100) + 10 * least(cells_seen, 10) + CASE WHEN part_status = 'PART_ONLY' THEN 15 ELSE 0 END + CASE WHEN spot_status = 'NEW_IN_SPOT' THEN 25 ELSE 0 END
 + CASE WHEN global_status = 'GLOBAL_UNCOMMON' THEN 50 ELSE 0 END + CASE WHEN imei_count > 1 THEN 20 ELSE 0 END + CASE WHEN imsi_count > 1 THEN 20 ELSE 0 END)::BIGINT AS priority_score FROM b)
SELECT *, CASE WHEN priority_score >= 120 THEN 'High' WHEN priority_score >= 70 THEN 'Medium' ELSE 'Low' END AS priority FROM d""",
)
query(
    "parts_compare",
    with_parts(IP, parts.compare),
    f""", a AS (SELECT sub AS subscriber_number, part_no, part_name, count(*) AS n, count(DISTINCT sc) AS cc, count(DISTINCT im) AS ii, min(event_time) AS fa, max(event_time) AS fb
 FROM i JOIN p ON event_time >= start_time AND event_time < end_time AND (pspot IS NULL OR pspot = spot_id) WHERE sub IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT subscriber_number, count(*) AS parts_seen_count, {lst('part_name')} AS parts_seen, sum(n)::BIGINT AS total_records, max(cc) AS max_cells_seen, max(ii) AS max_imei_count, min(fa) AS first_seen, max(fb) AS last_seen FROM a GROUP BY 1)
SELECT *, CASE WHEN parts_seen_count >= 2 AND max_cells_seen >= 2 THEN 'High' WHEN parts_seen_count >= 2 THEN 'Medium-High' WHEN max_cells_seen >= 2 OR total_records >= 10 THEN 'Medium' ELSE 'Low' END AS priority FROM b""",
)

# ---- Spots --------------------------------------------------------------------------------------------------------
query(
    "spot_summary",
    on(C, spots.spot_summary),
    "SELECT spot_id, count(*) AS total_events, count(DISTINCT sub) AS unique_subscribers, count(DISTINCT sc) AS unique_cells, count(DISTINCT im) AS unique_imei, min(call_datetime) AS first_seen, max(call_datetime) AS last_seen FROM c WHERE sub IS NOT NULL GROUP BY 1",
)
query(
    "spot_subscribers",
    on(C, spots.subscriber_spots),
    f"""SELECT a.*, v AS primary_cell FROM (SELECT subscriber_number, spot_id, count(*) AS events, min(call_datetime) AS first_seen, max(call_datetime) AS last_seen, count(DISTINCT sc) AS unique_cells,
 {lst('imei')} AS imei_values, {lst('imsi')} AS imsi_values FROM c WHERE sub IS NOT NULL GROUP BY 1, 2) a LEFT JOIN {top('c', 'subscriber_number, spot_id', 'sc', 'sub IS NOT NULL')} t USING (subscriber_number, spot_id)""",
)
_SPOTS = ["SPOT-01", "SPOT-02", "SPOT-03"]
query(
    "spot_presence_matrix",
    on(C, spots.presence_matrix, _SPOTS),
    "SELECT *, " + ", ".join(f'("{x}_events" > 0)::INT AS "{x}_present"' for x in _SPOTS) + ", spots_seen || ' of 3' AS presence, CASE WHEN spots_seen = 3 THEN 'ALL_SPOTS' WHEN spots_seen > 1 THEN 'MULTIPLE_SPOTS' ELSE 'EXCLUSIVE' END AS presence_status FROM (SELECT subscriber_number, count(DISTINCT spot_id) AS spots_seen, count(*) AS total_events, "
    + ", ".join(f"count(*) FILTER (WHERE spot_id = '{x}') AS \"{x}_events\"" for x in _SPOTS) + " FROM c WHERE sub IS NOT NULL GROUP BY 1)",
)
query(
    "spot_device_continuity",
    on(C, spots.device_continuity),
    """SELECT *, CASE WHEN devices = 0 AND sims = 0 THEN 'NOT_AVAILABLE' WHEN devices <= 1 AND sims <= 1 THEN 'SAME_DEVICE_AND_SIM' WHEN devices > 1 AND sims <= 1 THEN 'DEVICE_CHANGED' WHEN devices <= 1 THEN 'SIM_CHANGED' ELSE 'DEVICE_AND_SIM_CHANGED' END AS continuity,
 CASE WHEN devices = 1 AND sims = 1 THEN 'HIGH' WHEN devices >= 1 OR sims >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM
 (SELECT subscriber_number, count(DISTINCT spot_id) AS spots_seen, count(DISTINCT nullif(dev, '')) AS devices, count(DISTINCT imsi) AS sims FROM c WHERE sub IS NOT NULL GROUP BY 1 HAVING count(DISTINCT spot_id) >= 2)""",
)
_SX = "SELECT {0}, count(DISTINCT spot_id) AS spots_seen, count(DISTINCT subscriber_number) AS subscribers, count(*) AS events, " + lst("spot_id") + " AS spots FROM c WHERE sub IS NOT NULL AND {0} <> '' GROUP BY 1 HAVING count(DISTINCT spot_id) >= 2"
query("spot_shared_imei", on(C, spots.shared_across, "imei"), _SX.format("imei"))
query("spot_shared_imsi", on(C, spots.shared_across, "imsi"), _SX.format("imsi"))
query(
    "spot_sequence",
    on(C, spots.sequence),
    """SELECT subscriber_number, from_spot, spot_id AS to_spot, from_time, call_datetime AS to_time, round(epoch_us(call_datetime - from_time) / 6e7, 2) AS gap_minutes FROM
 (SELECT *, lag(spot_id) OVER w AS from_spot, lag(call_datetime) OVER w AS from_time FROM c WHERE sub IS NOT NULL AND call_datetime IS NOT NULL WINDOW w AS (PARTITION BY subscriber_number ORDER BY call_datetime, event_id)) WHERE from_spot <> spot_id""",
)
query(
    "spot_leads",
    on(C, spots.spot_leads, 20, 40_000.0),
    f""", a AS (SELECT spot_id, subscriber_number, count(*) AS events, min(call_datetime) AS fs, max(call_datetime) AS ls, count(DISTINCT nullif(dev, '')) AS devices, count(DISTINCT imsi) AS sims, count(*) FILTER (WHERE {NIGHT}) AS night_events FROM c WHERE sub IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, count(*) OVER (PARTITION BY subscriber_number) AS spots_seen, first_value(spot_id) OVER (PARTITION BY subscriber_number ORDER BY fs NULLS LAST, spot_id) AS first_spot FROM a),
d AS (SELECT *, events <= 20 AS rare, coalesce(epoch_us(ls - fs) / 6e7 <= 40000, FALSE) AS short, spots_seen >= 2 AS crs, devices >= 2 AS dv, sims >= 2 AS sm, 2 * night_events > events AS dark FROM b),
f AS (SELECT *, least(5 * rare::INT + 5 * short::INT + 5 * crs::INT + 15 * dv::INT + 15 * sm::INT + 15 * (rare AND short)::INT + 15 * (crs AND rare)::INT + 15 * (crs AND dv)::INT + 10 * (dark AND rare)::INT, 100) AS score,
 rare::INT + short::INT + crs::INT + dv::INT + dark::INT AS signals FROM d)
SELECT spot_id, subscriber_number, events, spots_seen, first_spot, devices, sims, night_events, score, signals,
 CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 50 THEN 'MEDIUM_HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS priority_level, score >= 30 AND (signals >= 2 OR sm) AS is_lead FROM f""",
)
