"""Call detail records of one or more targets: activity, contacts, towers, devices, movement.

``by`` names the columns that a result is kept apart by (for example ``target``); without it the frame is one subject.
Results are review aids: scores carry their rule set and formula.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identifiers as I
from .common import average, filled, joined, latest, metric_rows, n_distinct, n_if, night, total, with_most_frequent

# Rule set, weights and thresholds of the review rules.
RULESET = "CDR-RULES-1.0"
CONTACT_SCORE = (2.0, 1.0, 3.0)
CONTACT_FORMULA = "Total_Events*2 + Total_Duration_seconds/60 + Unique_Towers*3"
NETWORK_SCORE = (5.0, 1.0)
NETWORK_FORMULA = "Total_Events*5 + Total_Duration_seconds/60"
LATE_NIGHT = (0, 4)
DAILY_EVENTS, CONTACTS, IMEIS = 50, 100, 1


def category(name: str) -> Column:
    return I.contact_category("other_party") == name


HUMAN, SENDER, SHORT = "human_mobile", "service_sender_id", "short_code"


def with_categories(df: DataFrame) -> DataFrame:
    return df.withColumns({"contact_category": I.contact_category("other_party"), "call_meaning": I.call_meaning("call_type")})


def only_category(df: DataFrame, name: str) -> DataFrame:
    return df.where(category(name))


def summary(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    t = I.call_type("call_type")
    known = I.is_incoming_voice("call_type") | I.is_outgoing_voice("call_type") | I.is_sms("call_type")
    return df.groupBy(*by).agg(
        F.count("*").alias("total_records"),
        n_if(I.is_incoming_voice("call_type")).alias("incoming_calls"),
        n_if(I.is_outgoing_voice("call_type")).alias("outgoing_calls"),
        n_if(t.rlike("smsin|sms_mt|a2p_smsin")).alias("incoming_sms"),
        n_if(t.rlike("smsout|sms_mo|p2p_smsout")).alias("outgoing_sms"),
        n_if(~known & (t != "")).alias("other_call_types"),
        F.floor(F.coalesce(total("call_duration", 6), F.lit(0.0))).alias("duration_seconds"),
        n_distinct(filled("other_party")).alias("unique_counterparties"),
        n_distinct(filled("other_party"), category(HUMAN)).alias("unique_human_contacts"),
        n_if(category(SENDER)).alias("sender_records"),
        n_if(category(SHORT)).alias("short_code_records"),
        n_distinct(filled("imei")).alias("unique_imei"),
        n_distinct(filled("imsi")).alias("unique_imsi"),
        n_distinct("first_cell_id", I.valid_cell("first_cell_id")).alias("unique_valid_cells"),
        n_if(~I.valid_cell("first_cell_id")).alias("invalid_cell_rows"),
        F.min("call_datetime").alias("first_seen"),
        F.max("call_datetime").alias("last_seen"),
        n_distinct(F.to_date("call_datetime")).alias("active_days"),
    )


def activity(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    d = F.coalesce("call_duration", F.lit(0.0))
    out = df.groupBy(*by).agg(
        F.count("*").alias("total_events"),
        n_distinct("other_party").alias("unique_numbers"),
        total(d).alias("duration_seconds"),
        average(d).alias("average_duration"),
    )
    return with_most_frequent(out, df, list(by), {"most_active": ("other_party", None)})


def hourly(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All 24 hours with events, share and rank (equal counts share the best rank)."""
    seen = df.where("call_datetime is not null").groupBy(*by, F.hour("call_datetime").alias("hour")).agg(F.count("*").alias("n"))
    if by:
        frame = seen.select(*by).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    else:
        frame = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    out = frame.join(seen, [*by, "hour"], "left").withColumn("total_events", F.coalesce("n", F.lit(0)).cast("long"))
    w = Window.partitionBy(*by)
    return out.select(
        *by,
        "hour",
        F.format_string("%02d:00-%02d:59", "hour", "hour").alias("time_window"),
        "total_events",
        F.round(100.0 * F.col("total_events") / F.greatest(F.sum("total_events").over(w), F.lit(1)), 2).alias("share_percent"),
        F.rank().over(w.orderBy(F.desc("total_events"))).alias("activity_rank"),
    )


def daily(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return df.where("call_datetime is not null").groupBy(*by, F.date_format("call_datetime", "dd-MM-yyyy").alias("date")).agg(F.count("*").alias("total_events"))


def weekly(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """ISO weeks: the year is that of the week, so the days around new year stay together."""
    d = F.to_date("call_datetime")
    monday = F.to_date(F.date_trunc("week", "call_datetime"))
    out = df.where("call_datetime is not null").groupBy(*by, F.extract(F.lit("YEAROFWEEK"), d).alias("iso_year"), F.weekofyear(d).alias("iso_week"), monday.alias("_m"))
    return out.agg(F.count("*").alias("total_events"), F.countDistinct(d).alias("active_days")).select(
        *by,
        "iso_year",
        "iso_week",
        F.format_string("%d-W%02d", "iso_year", "iso_week").alias("year_week"),
        F.concat(F.date_format("_m", "dd-MM-yyyy"), F.lit(" to "), F.date_format(F.date_add("_m", 6), "dd-MM-yyyy")).alias("date_range"),
        "total_events",
        "active_days",
        F.round(F.col("total_events") / F.col("active_days"), 2).alias("average_per_day"),
    )


def monthly(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    t = "call_datetime"
    return df.where(f"{t} is not null").groupBy(*by, F.year(t).alias("year"), F.month(t).alias("month"), F.date_format(t, "yyyy-MM").alias("year_month")).agg(F.count("*").alias("total_events"))


def contact_counts(df: DataFrame, key: Column, by: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*by, key.alias("contact")).where("contact is not null and contact <> ''").groupBy(*by, "contact").agg(F.count("*").alias("total_events"))


def ranked(counts: DataFrame, limit: int, by: tuple[str, ...] = (), ascending: bool = False) -> DataFrame:
    """The first ``limit`` contacts of each subject by count, ties by contact; groups are limited before the shuffle."""
    order = [F.asc("total_events") if ascending else F.desc("total_events"), F.asc("contact")]
    if not by:
        return counts.orderBy(*order).limit(limit)
    return counts.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= limit).drop("_rn")


def top_contacts(df: DataFrame, limit: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    return ranked(contact_counts(df, I.msisdn("other_party"), by), limit, by)


def bottom_contacts(df: DataFrame, limit: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    return ranked(contact_counts(df, I.msisdn("other_party"), by), limit, by, ascending=True)


def top_senders(df: DataFrame, limit: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    return ranked(contact_counts(only_category(df, SENDER), F.col("other_party"), by), limit, by)


def top_short_codes(df: DataFrame, limit: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    return ranked(contact_counts(only_category(df, SHORT), F.col("other_party"), by), limit, by)


def category_counts(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, I.contact_category("other_party").alias("contact_category")).agg(F.count("*").alias("total_records"))


def call_type_counts(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    out = df.groupBy(*by, "call_type").agg(F.count("*").alias("total_records"))
    return out.withColumn("meaning", I.call_meaning("call_type", blank="Other / Unclassified Operator Event"))


def unknown_call_types(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    other = I.call_meaning("call_type") == "Other / Unclassified Operator Event"
    return df.where(other).groupBy(*by, "call_type").agg(F.count("*").alias("total_records"))


def _contact_metrics(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return only_category(df, HUMAN).groupBy(*by, F.col("other_party").alias("contact")).agg(
        F.count("*").alias("total_events"),
        n_if(I.is_incoming_voice("call_type")).alias("incoming"),
        n_if(I.is_outgoing_voice("call_type")).alias("outgoing"),
        n_if(I.is_sms("call_type")).alias("sms"),
        total("call_duration", zero=True).alias("total_duration"),
        n_distinct("first_cell_id").alias("unique_towers"),
    )


def contact_ranking(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    a, b, c = CONTACT_SCORE
    score = F.col("total_events") * a + F.col("total_duration") / 60 * b + F.col("unique_towers") * c
    return _contact_metrics(df, by).withColumns(
        {"score": F.round(score, 6), "score_ruleset": F.lit(RULESET), "score_formula": F.lit(CONTACT_FORMULA)}
    )


def contact_network(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges of the ego network of each subject."""
    a, b = NETWORK_SCORE
    strength = F.col("total_events") * a + F.col("total_duration") / 60 * b
    return _contact_metrics(df, by).withColumns(
        {"strength": F.round(strength, 6), "strength_ruleset": F.lit(RULESET), "strength_formula": F.lit(NETWORK_FORMULA)}
    )


def contact_detail(df: DataFrame, number: str) -> DataFrame:
    """Metrics of one contact."""
    rows = df.where(I.party_key("other_party") == I.party_key(F.lit(number)))
    return rows.agg(
        F.count("*").alias("total_events"),
        n_if(I.is_incoming_voice("call_type")).alias("incoming"),
        n_if(I.is_outgoing_voice("call_type")).alias("outgoing"),
        total("call_duration", zero=True).alias("total_duration"),
        F.min("call_datetime").alias("first_seen"),
        F.max("call_datetime").alias("last_seen"),
        n_distinct(filled("first_cell_id")).alias("unique_towers"),
    )


def full_contact_summary(df: DataFrame, by: tuple[str, ...] = ("target",)) -> DataFrame:
    """Per contact: counts, towers seen, tower used most, tower of the last event."""
    rows = df.withColumn("contact", I.contact_key("other_party")).where("contact <> ''")
    rows = rows.withColumn("_cell", F.when(I.valid_cell("first_cell_id"), F.col("first_cell_id")))
    key = [*by, "contact"]
    at = F.struct("call_datetime", "event_id")
    out = rows.groupBy(*key).agg(
        F.count("*").alias("total_events"),
        F.min("call_datetime").alias("first_seen"),
        F.max("call_datetime").alias("last_seen"),
        n_distinct("_cell").alias("unique_towers"),
        F.max_by("_cell", F.when(F.col("_cell").isNotNull() & F.col("call_datetime").isNotNull(), at)).alias("last_tower"),
    )
    return with_most_frequent(out, rows, key, {"most_used_tower": ("_cell", None)})


def location_overview(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    ok = I.valid_cell("first_cell_id")
    out = df.groupBy(*by).agg(
        n_if(ok).alias("valid_rows"), n_if(~ok).alias("invalid_rows"), n_distinct("first_cell_id", ok).alias("unique_cells")
    )
    return with_most_frequent(out, df, list(by), {"most_used_cell": ("first_cell_id", ok)})


def frequent_cells(df: DataFrame, limit: int = 5, ascending: bool = False) -> DataFrame:
    c = df.where(I.valid_cell("first_cell_id")).groupBy("first_cell_id").agg(F.count("*").alias("total_events"))
    return c.orderBy(F.asc("total_events") if ascending else F.desc("total_events"), "first_cell_id").limit(limit)


def tower_profile(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per valid first cell: span, events, contacts, devices, and what was used most there."""
    rows = df.where(I.valid_cell("first_cell_id"))
    key = [*by, "first_cell_id"]
    out = rows.groupBy(*key).agg(
        F.min("call_datetime").alias("first_seen"),
        F.max("call_datetime").alias("last_seen"),
        F.count("*").alias("total_events"),
        n_distinct("other_party", category(HUMAN)).alias("unique_human_contacts"),
        n_if(category(SENDER)).alias("sender_events"),
        n_if(category(SHORT)).alias("short_code_events"),
        n_distinct(filled("imei")).alias("unique_imei"),
        total("call_duration", zero=True).alias("duration_seconds"),
    )
    picks = {
        "most_used_imei": ("imei", F.trim("imei") != ""),
        "most_contacted": ("other_party", category(HUMAN)),
        "top_sender": ("other_party", category(SENDER)),
    }
    return with_most_frequent(out, rows, key, picks).fillna("N/A", list(picks))


def hour_towers(df: DataFrame, hours: Column, by: tuple[str, ...] = ()) -> DataFrame:
    rows = df.where(I.valid_cell("first_cell_id") & F.col("call_datetime").isNotNull() & hours)
    return rows.groupBy(*by, "first_cell_id").agg(
        F.count("*").alias("events"),
        F.countDistinct(F.to_date("call_datetime")).alias("days"),
        n_distinct("other_party", category(HUMAN)).alias("unique_human_contacts"),
    )


def home_tower(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return hour_towers(df, night("call_datetime"), by).withColumns({"window": F.lit("22:00-06:00"), "ruleset": F.lit(RULESET)})


def work_tower(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Hours 9 to 18 inclusive, that is up to 18:59."""
    return hour_towers(df, F.hour("call_datetime").between(9, 18), by)


def _devices(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(I.clean("imei"), F.lit("")) != "").withColumns(
        {
            "device_key": I.device_key("imei"),
            "_imei": I.clean("imei"),
            "_status": I.imei_status("imei"),
            "_human": F.when(category(HUMAN), I.msisdn("other_party")),
            "_cell": F.when(I.valid_cell("first_cell_id"), F.col("first_cell_id")),
        }
    )


def device_summary(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per probable device: the first 14 digits; a differing last digit is a variant of the same device."""
    rows = _devices(df)
    key = [*by, "device_key"]
    has = lambda s: F.bool_or(F.col("_status") == s)
    status = (
        F.when(has("VALID_IMEI") & has("INVALID_IMEI"), "Valid IMEI with check-digit variation")
        .when(has("VALID_IMEI"), "Valid 15-digit IMEI")
        .when(has("IMEISV"), "IMEISV device identifier")
        .when(has("INVALID_IMEI"), "IMEI check digit not verified")
        .otherwise("Non-standard device identifier")
    )
    out = rows.groupBy(*key).agg(
        joined("_imei").alias("observed_imei"),
        status.alias("imei_status"),
        F.min("call_datetime").alias("first_seen"),
        F.max("call_datetime").alias("last_seen"),
        F.count("*").alias("total_events"),
        n_distinct("_human").alias("unique_human_contacts"),
        n_distinct("_cell").alias("unique_valid_towers"),
        total("call_duration", zero=True).alias("duration_seconds"),
        joined(F.when(F.col("_status") == "VALID_IMEI", F.col("_imei"))).alias("valid_imei"),
        joined(F.when(F.col("_status") == "INVALID_IMEI", F.col("_imei"))).alias("invalid_imei"),
    )
    return with_most_frequent(out, rows, key, {"most_used_tower": ("_cell", None), "most_contacted": ("_human", None)}).fillna(
        "", ["most_used_tower", "most_contacted"]
    )


def sim_summary(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    rows = df.where(F.coalesce(I.clean("imsi"), F.lit("")) != "").withColumn("device_key", I.device_key("imei"))
    key = [*by, "imsi"]
    out = rows.groupBy(*key).agg(
        F.min("call_datetime").alias("first_seen"),
        F.max("call_datetime").alias("last_seen"),
        F.count("*").alias("total_events"),
        n_distinct(filled("device_key")).alias("unique_devices"),
    )
    return with_most_frequent(out, rows, key, {"most_used_device": ("device_key", F.col("device_key") != "")})


def review_indicators(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Threshold rules as rows ``(by…, indicator, records, remark, ruleset)``: aids for review, not findings."""
    rows = df.where("call_datetime is not null").withColumn("_day", F.to_date("call_datetime"))
    h = F.hour("call_datetime")
    one = rows.groupBy(*by).agg(
        n_if((h >= LATE_NIGHT[0]) & (h < LATE_NIGHT[1])).alias("a"), n_distinct("other_party").alias("b"), n_distinct("imei").alias("c")
    )
    rule = lambda c, over, name, remark: F.when(
        F.col(c) > over, F.struct(F.lit(name).alias("indicator"), F.col(c).alias("records"), F.lit(remark).alias("remark"))
    )
    flat = one.select(
        *by,
        F.explode(
            F.array_compact(
                F.array(
                    rule("a", 0, "Late-Night Activity Indicator", "Communication observed between 00:00-04:00; context required"),
                    rule("b", CONTACTS, "High Contact Diversity Dispersion", "A large number of unique contacts was observed"),
                    rule("c", IMEIS, "Multiple Handset Usage Indicator", "SIM identity observed with multiple IMEIs"),
                )
            )
        ).alias("r"),
    ).select(*by, "r.indicator", "r.records", "r.remark")
    days = rows.groupBy(*by, "_day").agg(F.count("*").alias("records")).where(F.col("records") > DAILY_EVENTS)
    busy = days.select(
        *by,
        F.lit("High Daily Activity Indicator").alias("indicator"),
        "records",
        F.concat(F.lit("High event volume observed on "), F.col("_day").cast("string")).alias("remark"),
    )
    return flat.unionByName(busy).withColumn("ruleset", F.lit(RULESET))


def observations(df: DataFrame) -> DataFrame:
    """Plain observations as metric rows: shares of night, weekend and human contact, and the busiest hour."""
    t = F.col("call_datetime")
    h = lambda cond: F.round(100.0 * F.count_if(cond) / F.greatest(F.count("*"), F.lit(1)), 2)
    return metric_rows(
        df,
        {
            "night_share_percent": h(t.isNotNull() & night("call_datetime")),
            "weekend_share_percent": h(F.dayofweek(t).isin(1, 7)),
            "human_share_percent": h(category(HUMAN)),
            "busiest_hour": F.mode(F.hour(t), True),
        },
    )


def common_contacts(df: DataFrame, target: str = "target") -> DataFrame:
    """Contacts of every target: the distinct targets of a contact are counted and compared with all of them."""
    pairs = df.select(target, I.msisdn("other_party").alias("contact")).where("contact is not null").distinct()
    n = df.agg(F.countDistinct(target).alias("n"))
    counts = pairs.groupBy("contact").agg(F.count("*").alias("targets"))
    return counts.where(F.col("targets") == n.scalar())


def movement(df: DataFrame, by: tuple[str, ...] = ("target",)) -> DataFrame:
    """Stays in time order: of events on one tower in a row the first is kept."""
    rows = df.where(I.valid_cell("first_cell_id") & F.col("call_datetime").isNotNull())
    w = Window.partitionBy(*by).orderBy("call_datetime", "event_id")
    prev = F.lag("first_cell_id").over(w)
    return rows.withColumn("_prev", prev).where("_prev is null or _prev <> first_cell_id").select(*by, "call_datetime", "event_id", "first_cell_id")


def transitions(df: DataFrame, by: tuple[str, ...] = ("target",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("call_datetime", "event_id")
    m = movement(df, by).withColumns({"from_cell": F.lag("first_cell_id").over(w), "from_time": F.lag("call_datetime").over(w)})
    return m.where("from_cell is not null").select(
        *by, "from_cell", F.col("first_cell_id").alias("to_cell"), "from_time", F.col("call_datetime").alias("to_time")
    )


def movement_pattern(df: DataFrame, by: tuple[str, ...] = ("target",)) -> DataFrame:
    return transitions(df, by).groupBy(*by, "from_cell", "to_cell").agg(F.count("*").alias("moves"))


def change_review(df: DataFrame, by: tuple[str, ...] = ("target",)) -> DataFrame:
    """Device, SIM and identifier changes between consecutive events of a subject.

    A new raw IMEI of the same device key is an identifier variant, not a device change.
    """
    raw = lambda c: F.coalesce(I.clean(c), F.lit(""))
    rows = df.withColumns({"_imei": raw("imei"), "_imsi": raw("imsi")}).where("call_datetime is not null and (_imei <> '' or _imsi <> '')")
    rows = rows.withColumn("_key", F.when(F.col("_imei") != "", I.device_key("_imei")).otherwise(""))
    w = Window.partitionBy(*by).orderBy("call_datetime", "event_id")
    rows = rows.withColumns({f"_p{c}": F.lag(c).over(w) for c in ("_imei", "_key", "_imsi")})
    differs = lambda c: (F.coalesce(f"_p{c}", F.lit("")) != "") & (F.col(c) != "") & (F.col(c) != F.col(f"_p{c}"))
    device, sim = differs("_key"), differs("_imsi")
    kind = (
        F.when(device & sim, "Device and SIM Change")
        .when(device, "Device Change")
        .when(sim, "SIM Change")
        .when(differs("_imei"), "Identifier Variant")
    )
    return rows.withColumn("change_type", kind).where("change_type is not null").select(
        *by,
        "event_id",
        "call_datetime",
        "change_type",
        F.col("_p_imei").alias("old_imei"),
        F.col("_imei").alias("new_imei"),
        F.when(sim, F.col("_p_imsi")).otherwise("").alias("old_imsi"),
        F.when(sim, F.col("_imsi")).otherwise("").alias("new_imsi"),
    )


def split_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes proper, and identifier variants."""
    v = F.col("change_type") == "Identifier Variant"
    return changes.where(~v), changes.where(v)


def first_and_last_events(df: DataFrame, by: tuple[str, ...] = ("target",)) -> DataFrame:
    """The first and the last event of each subject's day."""
    rows = df.where("call_datetime is not null").withColumn("day", F.to_date("call_datetime"))
    at = F.struct("call_datetime", "event_id")
    return rows.groupBy(*by, "day").agg(
        F.min("call_datetime").alias("first_time"),
        F.min_by("other_party", at).alias("first_party"),
        F.max("call_datetime").alias("last_time"),
        F.max_by("other_party", at).alias("last_party"),
        F.count("*").alias("events"),
    )


def detect_target(df: DataFrame, a: str = "a_party", b: str = "b_party", min_share: float = 0.8, min_rows: int = 3, lead: float = 0.2) -> DataFrame:
    """The number in at least ``min_share`` of the rows that leads the next one by ``lead``; no row if there is none."""
    keys = F.array_distinct(F.array_compact(F.array(I.msisdn(a), I.msisdn(b))))
    n = df.agg(F.count("*").alias("rows"))
    top = df.select(F.explode(keys).alias("number")).groupBy("number").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "number").limit(2)
    both = top.agg(
        F.min(F.struct(-F.col("n"), "number"))["number"].alias("number"), F.max("n").alias("n"), F.min("n").alias("second"), F.count("*").alias("k")
    ).withColumn("rows", n.scalar())
    second = F.when(F.col("k") > 1, F.col("second")).otherwise(F.lit(0))
    ok = (F.col("rows") >= min_rows) & (F.col("n") >= min_share * F.col("rows")) & (F.col("n") - second >= lead * F.col("rows"))
    return both.where(ok).select(F.col("number").alias("target"), "n", "rows")


def realign(df: DataFrame, target: Column | str, a: str = "a_party", b: str = "b_party") -> DataFrame:
    """Rows as the target sees them: ``other_party`` is the opposite one (B where both or neither match), with direction.

    The call type decides the direction; where it says nothing, the side on which the target stands.
    """
    t = I.party_key(F.lit(target) if isinstance(target, str) else target)
    is_a, is_b = I.party_key(a) == t, I.party_key(b) == t
    ty = I.call_type("call_type")
    direction = (
        F.when(ty.isin("incoming", "smsin"), "INCOMING")
        .when(ty.isin("outgoing", "smsout"), "OUTGOING")
        .when(is_a & ~is_b, "OUTGOING")
        .when(is_b & ~is_a, "INCOMING")
        .otherwise("UNKNOWN")
    )
    other = F.when(is_b & ~is_a, F.col(a)).otherwise(F.col(b))
    return df.withColumns({"raw_a_party": F.col(a), "raw_b_party": F.col(b), "other_party": other, "call_direction": direction})


def latest_by(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return latest(df, list(by), [F.desc("call_datetime"), F.desc("event_id")])
