"""Record views over the driver's ``events`` table, from expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parts as P
from ..operators import sessions as S

_K = "cast(regexp_extract(props, '\"k\": *([0-9]+)', 1) as int)"
_TARGET = "'9' || lpad(cast(user_id as string), 9, '0')"
_CELL = "'405-51-834-' || lpad(cast({} as string), 4, '0')"

CALLS = {
    "event_id": "event_id",
    "target": _TARGET,
    "subscriber_number": f"case when event_id % 50 = 7 then '' when event_id % 50 = 9 then null else {_TARGET} end",
    "other_party": "case when event_id % 22 = 0 then 'AB-BANK' || cast(event_id % 3 as string) || '-S'"
    " when event_id % 11 = 0 then '5' || lpad(cast(event_id % 7 as string), 4, '0')"
    " when event_id % 50 = 13 then '' when event_id % 50 = 14 then null"
    " when event_id % 19 = 0 then '9' || lpad(cast((user_id + 1) % 150 as string), 9, '0')"
    " else '8' || lpad(cast((event_id * 7919) % 97 as string), 9, '0') end",
    "call_type": "case event_type when 'click' then 'outgoing' when 'view' then 'incoming' when 'purchase' then 'smsout'"
    " when 'signup' then 'smsin' else event_type end",
    "call_datetime": "case when event_id % 50 = 3 then null else ts end",
    "call_duration": "case when event_id % 50 = 17 then null else value end",
    "imei": "case when event_id % 50 = 21 then '' when event_id % 13 = 0 then '86' || lpad(cast((user_id * 7) % 50 as string), 13, '0')"
    " else '35' || lpad(cast(user_id % 120 as string), 13, '0') end",
    "imsi": "'40551' || lpad(cast((user_id * 31) % 140 as string), 10, '0')",
    "first_cell_id": f"case when event_id % 50 = 11 then '405-51--' else {_CELL.format(_K)} end",
    "last_cell_id": _CELL.format(f"(({_K} + event_id % 2) % 100)"),
    "searched_cell_id": f"case when event_id % 50 = 27 then '' else {_CELL.format(_K)} end",
    "operator": "case user_id % 3 when 0 then 'Airtel' when 1 then 'Jio' else 'Vi' end",
    "spot_id": f"'SPOT-0' || cast({_K} % 3 + 1 as string)",
    "spot_name": f"'Spot ' || cast({_K} % 3 + 1 as string)",
    "source_file": "'file_' || cast(event_id % 4 as string) || '.csv'",
    "source_row": "event_id",
}
_PLUS = "{seconds}"
SESSIONS = {
    "event_id": "event_id",
    "subscriber_number": f"case when event_id % 17 = 0 then '40' || lpad(cast(user_id as string), 12, '0') when event_id % 50 = 7 then '' else {_TARGET} end",
    "imei": CALLS["imei"],
    "imsi": CALLS["imsi"],
    "ipv4_address": "'10.0.' || cast(user_id % 200 as string) || '.' || cast(event_id % 50 as string)",
    "ipv6_address": "case when event_id % 5 = 0 then '2001:db8::' || cast(user_id % 90 as string) else '' end",
    "session_start": "ts",
    "session_end": _PLUS,
    "session_duration_seconds": "case when event_id % 60 = 5 then null else floor(value * 40) end",
    "downlink_volume": "value * 3",
    "uplink_volume": "value",
    "total_volume": "case when event_id % 40 = 5 then value * 4 + 7 when event_id % 40 = 6 then 0.0 else value * 4 end",
    "technology": "case event_type when 'click' then '4G' when 'view' then '5G' when 'error' then null else '3G' end",
    "pre_post": "case when user_id % 4 = 0 then 'POST' else 'PRE' end",
    "roaming_circle": "case when user_id % 9 = 0 then 'MH' when user_id % 9 = 1 then '' else 'GJ' end",
    "operator": CALLS["operator"],
    "searched_cell_id": CALLS["searched_cell_id"],
    "spot_id": CALLS["spot_id"],
    "spot_name": CALLS["spot_name"],
    "source_file": CALLS["source_file"],
}
_DAY6 = "cast(floor(hour(ts) / 6) as int)"
_ALLOC = f"cast(user_id as string) || '|' || cast(cast(ts as date) as string) || '|' || cast({_DAY6} as string)"
_VOL = f"cast(100 + (user_id * 37 + {_DAY6} * 11 + event_id % 2) % 500 as double)"
IP_EVENTS = {
    "event_id": "event_id",
    "subscriber_number": CALLS["subscriber_number"],
    "imei": CALLS["imei"],
    "imsi": CALLS["imsi"],
    "event_time": "case when event_id % 50 = 3 then null else ts end",
    "allocation_key": _ALLOC,
    "allocation_volume_key": f"{_ALLOC} || '|' || cast(event_id % 2 as string)",
    "allocation_start": "{allocation_start}",
    "allocation_end": "{allocation_end}",
    "source_ip": "'10.0.' || cast(user_id % 200 as string) || '.1'",
    "translated_ip": "case when event_id % 6 = 0 then '2001:db8::1' else '198.51.100.' || cast(user_id % 30 as string) end",
    "destination_ip": "case when event_id % 50 = 31 then '' when event_id % 12 = 0 then '2001:db8::' || cast(event_id % 9 as string) else '203.0.113.' || cast(event_id % 60 as string) end",
    "destination_port": "case when event_id % 50 = 33 then null when event_id % 5 = 0 then 443 when event_id % 5 = 1 then 80 when event_id % 5 = 2 then 53 else 8080 end",
    "uplink_volume": _VOL,
    "downlink_volume": f"{_VOL} * 2",
    "total_volume": f"{_VOL} * 3",
    "searched_cell_id": CALLS["searched_cell_id"],
    "first_cell_id": CALLS["first_cell_id"],
    "last_cell_id": CALLS["last_cell_id"],
    "operator": CALLS["operator"],
    "spot_id": CALLS["spot_id"],
    "spot_name": CALLS["spot_name"],
    "source_file": CALLS["source_file"],
}
_SPARK = {
    "{seconds}": "cast(date_trunc('second', ts) as timestamp_ntz) + make_dt_interval(0, 0, 0, floor(value))",
    "{allocation_start}": f"cast(date_trunc('day', ts) as timestamp_ntz) + make_dt_interval(0, {_DAY6} * 6)",
    "{allocation_end}": f"cast(date_trunc('day', ts) as timestamp_ntz) + make_dt_interval(0, {_DAY6} * 6 + 5)",
}
_DUCK = {
    "{seconds}": "date_trunc('second', ts) + to_seconds(floor(value)::BIGINT)",
    "{allocation_start}": f"date_trunc('day', ts) + to_hours({_DAY6} * 6)",
    "{allocation_end}": f"date_trunc('day', ts) + to_hours({_DAY6} * 6 + 5)",
}


def _view(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(*[F.expr(_SPARK.get(e, e)).alias(n) for n, e in columns.items()])


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CALLS)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.normalise(_view(spark, sf_dir, SESSIONS))


def ip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, IP_EVENTS).withColumn("destination_port", F.col("destination_port").cast("long"))


#: Three half-open Parts, of which the first two overlap; the second one is of one Spot.
PARTS = (
    (datetime(2024, 1, 5), datetime(2024, 1, 8), None),
    (datetime(2024, 1, 7), datetime(2024, 1, 10), "SPOT-01"),
    (datetime(2024, 1, 20, 12), datetime(2024, 1, 21, 12), None),
)


def parts(spark: SparkSession) -> DataFrame:
    return P.build(spark, [(a, b) for a, b, _ in PARTS], [s for *_, s in PARTS])


#: Keys of the master tables: of the numbers of events every third one is missing, of the cells every fifth.
NUMBER_KEY = "'9' || lpad(cast(cast(c_custkey + floor(c_custkey / 2) as bigint) as string), 9, '0')"
_PART = "cast(cast(p_partkey + floor((p_partkey - 1) / 4) as bigint) as string)"
CELL_KEY = f"'405-51-834-' || case when length({_PART}) < 4 then lpad({_PART}, 4, '0') else {_PART} end"


def number_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.selectExpr(f"{NUMBER_KEY} as mobile_number", "c_name as name", "c_mktsegment as circle")


def cell_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.selectExpr(f"{CELL_KEY} as cgi", "p_name as site")


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{_DUCK.get(e, e)} AS {n}" for n, e in columns.items())


def _cell_ok(c: str) -> str:
    return rf"(lower(coalesce(trim({c}), '')) NOT IN ('', '-', '--', '---', 'nan', 'none', 'null', 'na', 'n/a') AND NOT contains({c}, '--') AND {c} NOT LIKE '%-' AND length(regexp_replace({c}, '[^0-9]', '', 'g')) >= 6)"


_CATEGORY = r"""CASE WHEN coalesce(trim(other_party), '') = '' THEN 'unknown_contact'
 WHEN regexp_matches(other_party, '(?i)^[A-Z]{2}-[A-Z0-9][A-Z0-9-]{2,}-[A-Z]$') THEN 'service_sender_id'
 WHEN regexp_matches(regexp_replace(other_party, '[ -]', '', 'g'), '^[0-9]{1,6}$') THEN 'short_code'
 WHEN regexp_matches(regexp_replace(other_party, '[ -]', '', 'g'), '^[0-9]{7,15}$') THEN 'human_mobile'
 WHEN regexp_matches(other_party, '[A-Za-z]') THEN 'service_sender_id' ELSE 'unknown_contact' END"""

#: CTEs for DuckDB: the views, and ``c`` (calls), ``s`` (sessions), ``i`` (IP events), ``p`` (Parts) with what the
#: Column functions derive from them.
CTES = f"""WITH calls AS (SELECT {_select(CALLS)} FROM events),
c AS (SELECT *, {_CATEGORY} AS cat, {_cell_ok('first_cell_id')} AS vc, hour(call_datetime) AS h,
  CASE WHEN regexp_matches(other_party, '^[6-9][0-9]{{9}}$') THEN other_party END AS ms,
  nullif(trim(subscriber_number), '') AS sub, nullif(searched_cell_id, '') AS sc, nullif(imei, '') AS im,
  CASE WHEN length(imei) = 15 THEN left(imei, 14) ELSE coalesce(imei, '') END AS dev FROM calls),
sess AS (SELECT {_select(SESSIONS)} FROM events),
s AS (SELECT *, nullif(trim(subscriber_number), '') AS sub, nullif(searched_cell_id, '') AS sc, nullif(imei, '') AS im,
  CASE WHEN regexp_matches(subscriber_number, '^[6-9][0-9]{{9}}$') THEN 'MSISDN'
       WHEN regexp_matches(subscriber_number, '^[0-9]{{12,16}}$') THEN 'NON_STANDARD_SUBSCRIBER_ID'
       ELSE 'INVALID_OR_UNVERIFIED' END AS identifier_type,
  coalesce(session_end >= session_start AND session_duration_seconds >= 0, FALSE) AS session_time_valid,
  coalesce(abs(total_volume - (downlink_volume + uplink_volume)) > greatest(1.0, 1e-6 * abs(downlink_volume + uplink_volume)), FALSE) AS volume_mismatch,
  total_volume = 0 AS is_zero_volume FROM sess),
ip AS (SELECT {_select(IP_EVENTS)} FROM events),
i AS (SELECT *, nullif(trim(subscriber_number), '') AS sub, nullif(searched_cell_id, '') AS sc, nullif(imei, '') AS im, nullif(destination_ip, '') AS dip FROM ip),
p AS (SELECT * FROM (VALUES {', '.join(f"({n + 1}, 'Part {n + 1}', TIMESTAMP '{a}', TIMESTAMP '{b}', {repr(s) if s else 'NULL'})" for n, (a, b, s) in enumerate(PARTS))}) v(part_no, part_name, start_time, end_time, pspot)),
nm AS (SELECT {NUMBER_KEY} AS mobile_number, c_name AS name, c_mktsegment AS circle FROM customer),
cm AS (SELECT {CELL_KEY} AS cgi, p_name AS site FROM part)
"""
