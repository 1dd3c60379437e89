"""Queries over the sheets, the review lists, and the device indicators and checks of sessions and IP events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..operators import devices, presence, sheets
from . import domain as D
from .catalog import _ROLL, C, IN, IP, OUT, S, on, query
from .catalog_records import _M, ASKED, bundle, checks_sql

_SEC = "round(sum(CASE WHEN {} THEN coalesce(call_duration, 0)::DECIMAL(28,6) ELSE 0 END), 4)::DOUBLE"
_SMS_IN, _SMS_OUT = "regexp_matches(lower(call_type), 'smsin|sms_mt')", "regexp_matches(lower(call_type), 'smsout|sms_mo')"
_COUNTS = f"""count(*) FILTER (WHERE {IN} OR {OUT}) AS voice_calls, {_SEC.format(f'{IN} OR {OUT}')} AS voice_seconds, count(*) FILTER (WHERE {OUT}) AS out_calls, {_SEC.format(OUT)} AS out_seconds,
 count(*) FILTER (WHERE {IN}) AS in_calls, {_SEC.format(IN)} AS in_seconds, count(*) FILTER (WHERE {_SMS_OUT}) AS out_sms, count(*) FILTER (WHERE {_SMS_IN}) AS in_sms"""

query(
    "sheet_contacts",
    on(C, sheets.contact_sheet, by=("target",)),
    f"""SELECT *, CASE WHEN voice_calls > 0 THEN floor(voice_seconds / voice_calls + 0.5)::BIGINT ELSE 0 END AS average_voice_seconds FROM (
 SELECT target, other_party, count(*) AS total_events, min(call_datetime) AS first_call, max(call_datetime) AS last_call, {_COUNTS}
 FROM c WHERE coalesce(trim(other_party), '') <> '' GROUP BY 1, 2)""",
)
query(
    "sheet_cells",
    on(C, sheets.cell_sheet),
    f"SELECT first_cell_id, count(*) AS total_events, {_COUNTS}, count(DISTINCT nullif(other_party, '')) AS parties, count(DISTINCT call_datetime::DATE) AS active_days FROM c WHERE vc GROUP BY 1",
)
query("sheet_imei", on(C, sheets.imei_sheet), f"SELECT imei, {_COUNTS}, count(*) FILTER (WHERE {_SMS_IN} OR {_SMS_OUT}) AS sms FROM c WHERE im IS NOT NULL GROUP BY 1")
query(
    "sheet_roaming",
    on(S, sheets.roaming_sheet),
    "SELECT coalesce(nullif(trim(roaming_circle), ''), 'Home Circle') AS circle, coalesce(nullif(trim(operator), ''), 'Unknown') AS provider, count(*) AS records FROM s GROUP BY 1, 2",
)
query(
    "sheet_moving_calls",
    lambda s, d: sheets.moving_calls(C(s, d)).select("event_id", "target", "other_party", "first_cell_id", "last_cell_id"),
    f"SELECT event_id, target, other_party, first_cell_id, last_cell_id FROM c WHERE first_cell_id <> last_cell_id AND ({IN} OR {OUT})",
)
_ASKED_NUMBER = "+91 9000000007"
query(
    "related_records",
    lambda s, d: sheets.related_records({"calls": C(s, d), "ip": IP(s, d), "sessions": S(s, d)}, _ASKED_NUMBER).select("dataset", "key", "matched_column"),
    """, r AS (SELECT 'calls' AS dataset, event_id AS key, CASE WHEN target = '9000000007' THEN 'target' WHEN subscriber_number = '9000000007' THEN 'subscriber_number' ELSE 'other_party' END AS matched_column
 FROM c WHERE '9000000007' IN (target, subscriber_number, other_party)
 UNION ALL SELECT 'ip', event_id, 'subscriber_number' FROM i WHERE subscriber_number = '9000000007' UNION ALL SELECT 'sessions', event_id, 'subscriber_number' FROM s WHERE right(subscriber_number, 10) = '9000000007')
SELECT * FROM r ORDER BY dataset, key LIMIT 1000""",
)
query(
    "balanced_sample",
    lambda s, d: sheets.balanced_sample(C(s, d), ("spot_id", "operator"), ["event_id"], 100).select("event_id", "spot_id", "operator"),
    """, q AS (SELECT event_id, spot_id, operator, row_number() OVER (PARTITION BY spot_id, operator ORDER BY event_id) AS rn FROM c), g AS (SELECT greatest(1, 100 // count(*)) AS quota FROM (SELECT DISTINCT spot_id, operator FROM c))
SELECT event_id, spot_id, operator FROM q, g ORDER BY CASE WHEN rn <= quota THEN 0 ELSE 1 END, event_id LIMIT 100""",
)
query(
    "expanded_operators",
    lambda s, d: sheets.expanded_list(presence.rollup(C(s, d)), "searched_cells", "cell").select("subscriber_number", "cell"),
    f"SELECT subscriber_number, trim(x) AS cell FROM (SELECT subscriber_number, unnest(string_split(searched_cells, ',')) AS x FROM ({_ROLL})) WHERE trim(x) <> ''",
)


def _lists(spark, sf_dir):
    rolled = presence.rollup(C(spark, sf_dir))
    return {n: presence.bucket(rolled, n, None) for n in ("device_consistency", "multi_cell_presence", "suspicious_timing", "uncommon_numbers")}


_LISTS = f""", r AS ({_ROLL}), l AS (SELECT 'device_consistency' AS category, subscriber_number, priority_score FROM r WHERE imei_count >= 2 OR imsi_count >= 2
 UNION ALL SELECT 'multi_cell_presence', subscriber_number, priority_score FROM r WHERE cells_seen >= 2 UNION ALL SELECT 'suspicious_timing', subscriber_number, priority_score FROM r WHERE night_event_count > 0
 UNION ALL SELECT 'uncommon_numbers', subscriber_number, priority_score FROM r WHERE event_count = 1)"""
query(
    "review_queue",
    lambda s, d: sheets.review_queue(_lists(s, d), 50),
    f"{_LISTS} SELECT subscriber_number, count(DISTINCT category) AS n_categories, string_agg(DISTINCT category, ', ' ORDER BY category) AS categories, max(priority_score) AS priority_score FROM l GROUP BY 1 ORDER BY 2 DESC, 4 DESC, 1 LIMIT 50",
)
query("review_coverage", lambda s, d: sheets.coverage(_lists(s, d)), f"{_LISTS} SELECT category, count(DISTINCT subscriber_number) AS subscribers FROM l GROUP BY 1")


def _manifest(spark, sf_dir):
    """Parts as if they were files: kind, status and digest."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_brand as kind", "case when p_partkey % 11 = 0 then 'FAILED' else 'LOADED' end as status", "cast(p_size as string) as sha256")


query(
    "manifest_metrics",
    lambda s, d: sheets.manifest_metrics(_manifest(s, d)),
    "SELECT p_brand AS kind, count(*) AS files, count(DISTINCT p_size) AS distinct_files, count(*) FILTER (WHERE p_partkey % 11 = 0) AS not_loaded FROM part GROUP BY 1",
)
query(
    "file_summary",
    lambda s, d: sheets.file_summary(s.range(6).select(F.format_string("file_%d.csv", "id").alias("source_file")), IP(s, d)),
    """SELECT source_file, coalesce(n, 0) AS events, coalesce(m, 0) AS subscribers, first_event, last_event FROM (SELECT 'file_' || range || '.csv' AS source_file FROM range(6))
 LEFT JOIN (SELECT source_file, count(*) AS n, count(DISTINCT sub) AS m, min(event_time) AS first_event, max(event_time) AS last_event FROM i GROUP BY 1) USING (source_file)""",
)


def _rules_sql(src: str, rules: dict[str, tuple[str, str]]) -> str:
    cols = ", ".join(f"({v})::BIGINT AS r{i}" for i, (v, _) in enumerate(rules.values()))
    rows = " UNION ALL ".join(f"SELECT '{n}' AS indicator, r{i} AS value FROM a WHERE {c.format(f'r{i}')}" for i, (n, (_, c)) in enumerate(rules.items()))
    return f""", a AS (SELECT count(*) AS events, {cols} FROM {src} WHERE {_M}), x AS ({rows})
SELECT * FROM x UNION ALL SELECT 'NO_INDICATOR', events FROM a WHERE NOT EXISTS (SELECT * FROM x)"""


_SEVERAL = {
    "MULTIPLE_SUBSCRIBERS": ("count(DISTINCT sub)", "{} > 1"),
    "MULTIPLE_SIMS": ("count(DISTINCT nullif(imsi, ''))", "{} > 1"),
    "MULTIPLE_FILES": ("count(DISTINCT source_file)", "{} > 1"),
}
query(
    "device_session_indicators",
    bundle(S, devices.session_bundle, "indicators"),
    _rules_sql("s", _SEVERAL | {"MULTIPLE_SPOTS": ("count(DISTINCT spot_id)", "{} > 1"), "VOLUME_MISMATCH": ("count(*) FILTER (WHERE volume_mismatch)", "{} > 0")}),
)
query("device_ip_indicators", bundle(IP, devices.ip_bundle, "indicators"), _rules_sql("i", _SEVERAL))
_NONE = "coalesce(trim({}), '') = ''"
query(
    "device_session_quality",
    bundle(S, devices.session_bundle, "quality"),
    checks_sql(
        f"(SELECT * FROM s WHERE {_M})",
        {
            "matched_sessions": "TRUE",
            "invalid_time": "NOT session_time_valid",
            "missing_subscriber": "sub IS NULL",
            "missing_imsi": "imsi = ''",
            "missing_ip": f"{_NONE.format('ipv4_address')} AND {_NONE.format('ipv6_address')}",
            "missing_cell": "sc IS NULL",
            "missing_volume": "downlink_volume IS NULL OR uplink_volume IS NULL OR total_volume IS NULL",
            "volume_mismatch": "volume_mismatch",
            "zero_volume": "is_zero_volume",
            "imei_of_16_digits": "length(imei) = 16",
        },
    ),
)
query(
    "device_ip_quality",
    bundle(IP, devices.ip_bundle, "quality"),
    checks_sql(
        f"(SELECT * FROM i WHERE {_M})",
        {
            "matched_records": "TRUE",
            "missing_time": "event_time IS NULL",
            "missing_subscriber": "sub IS NULL",
            "missing_imsi": "imsi = ''",
            "missing_source_ip": _NONE.format("source_ip"),
            "missing_destination_ip": "dip IS NULL",
            "exact_observed": f"imei = '{ASKED}'",
            "imei_of_16_digits": "length(imei) = 16",
        },
    ),
)

# Labels that the table knows, that only their words tell, and that stay as they are; with the type of each.
_LABELS = (
    ("A_OUT", "outgoing"), ("moc", "outgoing"), ("VDO-OUT", "outgoing"), ("v_in", "incoming"), ("MTC", "incoming"), ("SMT", "smsin"),
    ("A2P_SMSIN", "smsin"), ("SMO", "smsout"), ("P2POUT", "smsout"), ("p2aout", "smsout"), ("sms generic", "sms"), ("Call originating", "outgoing"),
    ("SMS terminating", "smsin"), ("dsm", "dsm"), ("", ""),
)
_LABEL_SQL = "[" + ", ".join(f"'{a}'" for a, _ in _LABELS) + "]"
_TYPE_SQL = "[" + ", ".join(f"'{b}'" for _, b in _LABELS) + "]"


def _labelled(spark, sf_dir):
    labels = F.array(*[F.lit(a) for a, _ in _LABELS])
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.element_at(labels, (F.col("p_partkey") % len(_LABELS)).cast("int") + 1).alias("t"))


query(
    "function_call_types",
    lambda s, d: _labelled(s, d).select("p_partkey", I.canonical_call_type("t").alias("call_type"), I.canonical_call_type("t", F.lit("SMS")).alias("with_sms_service")),
    f""", k AS (SELECT p_partkey, {_TYPE_SQL}[p_partkey % {len(_LABELS)} + 1] AS t FROM part)
SELECT p_partkey, t AS call_type, CASE WHEN t IN ('smsin', 'incoming') THEN 'smsin' WHEN t IN ('smsout', 'outgoing') THEN 'smsout' ELSE 'sms' END AS with_sms_service FROM k""",
)
