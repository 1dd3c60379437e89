"""Fact schemas and how an arbitrary frame is made to fit them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _schema(columns: str) -> T.StructType:
    """Schema from ``name type`` pairs; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(","))])


CALLS = _schema(
    "target string, event_id long, subscriber_number string, other_party string, call_type string, call_datetime timestamp_ntz,"
    " call_duration double, imei string, imsi string, first_cell_id string, last_cell_id string, searched_cell_id string,"
    " operator string, spot_id string, spot_name string, source_file string, source_row long"
)
SESSIONS = _schema(
    "event_id long, subscriber_number string, identifier_type string, imei string, imsi string, ipv4_address string,"
    " ipv6_address string, session_start timestamp_ntz, session_end timestamp_ntz, session_duration_seconds double,"
    " downlink_volume double, uplink_volume double, total_volume double, volume_mismatch boolean, is_zero_volume boolean,"
    " technology string, pre_post string, roaming_circle string, operator string, searched_cell_id string, spot_id string,"
    " spot_name string, source_file string"
)
IP_EVENTS = _schema(
    "event_id long, subscriber_number string, imei string, imsi string, event_time timestamp_ntz, allocation_key string,"
    " allocation_volume_key string, allocation_start timestamp_ntz, allocation_end timestamp_ntz, source_ip string,"
    " translated_ip string, destination_ip string, destination_port long, searched_cell_id string, first_cell_id string,"
    " last_cell_id string, cell_transition_type string, uplink_volume double, downlink_volume double, total_volume double,"
    " spot_id string, spot_name string, source_file string"
)
REJECTS = _schema(
    "source_file string, source_row_number long, source_row_end_number long, rejection_reason string,"
    " raw_row_digest_sha256 string, raw_fields_json string"
)
SUBSCRIBER_MASTER = _schema(
    "mobile_number string, subscriber_name string, father_name string, address string, id_type string, id_number string,"
    " operator string, circle string, activation_date string, caf_number string, source_file string"
)
PARTS = _schema("part_no int, part_name string, start_time timestamp_ntz, end_time timestamp_ntz, spot_id string")


def row_id(file: str = "source_path") -> Column:
    """Id of a loaded row: a hash of its file's whole path and its row, the same whenever the file is read from there."""
    return F.when(F.col(file).isNotNull() & F.col("source_row").isNotNull(), F.xxhash64(file, "source_row"))


def conform(df: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with exactly the columns of ``schema``, and those of ``keep`` that it has: cast where they exist, typed nulls
    where they do not. Rows without an ``event_id`` column get ``row_id`` where their file and row are known, by the path
    where that is known."""
    have = set(df.columns)
    file = "source_path" if "source_path" in have else "source_file"
    if "event_id" not in have and {file, "source_row"} <= have:
        df, have = df.withColumn("event_id", row_id(file)), have | {"event_id"}
    fields = [(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    return df.select(*fields, *[c for c in keep if c in have and c not in schema.names])


def snake(name: str) -> str:
    """Column name in lower case with every other character run as one underscore."""
    import re

    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def dedupe_names(names: list[str]) -> list[str]:
    """``a, a`` as ``a, a.1``."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(n if not k else f"{n}.{k}")
    return out


def rename_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Columns under their canonical names; of several that mean one, the first that is not blank in a row wins."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        base = snake(c.rsplit(".", 1)[0] if c.rsplit(".", 1)[-1].isdigit() else c)
        groups.setdefault(aliases.get(base, base), []).append(c)
    pick = lambda cs: F.coalesce(*[F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.col(f"`{c}`")) for c in cs])
    return df.select(*[(F.col(f"`{cs[0]}`") if len(cs) == 1 else pick(cs)).alias(n) for n, cs in groups.items()])
