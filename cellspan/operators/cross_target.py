"""Several targets together: what they have in common, their direct links, and matrices of item by target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identifiers as I
from .common import filled, joined, matrix, n_distinct, n_if, night


# Severity of each alert; and what it says.
ALERTS = {
    "COMMON_DEVICES": ("HIGH", "%d devices are used by several targets"),
    "COMMON_SIMS": ("HIGH", "%d SIMs are used by several targets"),
    "DIRECT_LINKS": ("MEDIUM", "%d directed links between targets"),
    "COMMON_NUMBERS": ("REVIEW", "%d numbers are in contact with several targets"),
    "COMMON_TOWERS": ("REVIEW", "%d towers are used by several targets; that alone does not place them together"),
    "NOTHING_SHARED": ("INFO", "no item of several targets (%d)"),
}


#: Targets of a block of a class in ``pair_overlap``.
BLOCK = 1000


def prepared(df: DataFrame) -> DataFrame:
    """Events with the looser keys of comparison and a night flag."""
    return df.withColumns(
        {
            "number": I.loose_number("other_party"),
            "device": I.loose_imei("imei"),
            "sim": I.loose_imsi("imsi"),
            "is_night": F.col("call_datetime").isNotNull() & night("call_datetime"),
        }
    )


def common_items(events: DataFrame, item: str, minimum: int = 2) -> DataFrame:
    """Items that at least ``minimum`` targets have in common."""
    return (
        events.where(F.col(item).isNotNull() & (F.col(item) != ""))
        .groupBy(item)
        .agg(
            F.countDistinct("target").alias("target_count"),
            F.count("*").alias("total_events"),
            joined("target").alias("targets"),
            F.min("call_datetime").alias("first_seen"),
            F.max("call_datetime").alias("last_seen"),
        )
        .where(F.col("target_count") >= minimum)
    )


def common_numbers(df: DataFrame, minimum: int = 2) -> DataFrame:
    """Common numbers that are no targets themselves."""
    e = prepared(df)
    targets = e.select(I.loose_number("target").alias("number")).distinct()
    return common_items(e, "number", minimum).join(targets, "number", "left_anti")


def direct_links(df: DataFrame) -> DataFrame:
    """Directed links from a target to another one that it was in contact with."""
    e = prepared(df)
    targets = e.select(F.col("target").alias("linked_target"), I.loose_number("target").alias("number")).distinct()
    return (
        e.join(targets, "number")
        .where("target <> linked_target")
        .groupBy("target", "linked_target")
        .agg(
            F.count("*").alias("events"),
            n_if(I.is_incoming_voice("call_type")).alias("incoming"),
            n_if(I.is_outgoing_voice("call_type")).alias("outgoing"),
            n_if(F.col("is_night")).alias("night_events"),
            F.min("call_datetime").alias("first_contact"),
            F.max("call_datetime").alias("last_contact"),
        )
    )


def tower_events(df: DataFrame) -> DataFrame:
    """First and last tower of every event as rows, a tower once per event."""
    cells = F.explode(F.array_distinct(F.array_compact(F.array(filled("first_cell_id"), filled("last_cell_id")))))
    return df.withColumn("tower", cells).where(I.valid_cell("tower"))


def common_towers(df: DataFrame, minimum: int = 2) -> DataFrame:
    return common_items(tower_events(df), "tower", minimum)


def common_devices(df: DataFrame, minimum: int = 2) -> DataFrame:
    return common_items(prepared(df), "device", minimum)


def common_sims(df: DataFrame, minimum: int = 2) -> DataFrame:
    return common_items(prepared(df), "sim", minimum)


def item_matrix(df: DataFrame, item: str, targets: list[str], minimum: int = 2) -> DataFrame:
    """Counts of the common items by target; the stated targets are its columns."""
    e = prepared(df).where(F.col(item).isNotNull())
    return matrix(e.where(F.col("target").isin(*targets)), item, "target", targets).where(F.col("n_present") >= minimum)


def overview(df: DataFrame) -> DataFrame:
    return prepared(df).groupBy("target").agg(
        F.count("*").alias("events"),
        n_distinct("number").alias("numbers"),
        n_distinct("first_cell_id", I.valid_cell("first_cell_id")).alias("towers"),
        n_distinct("device").alias("devices"),
        n_distinct("sim").alias("sims"),
        n_if(F.col("is_night")).alias("night_events"),
        F.min("call_datetime").alias("first_seen"),
        F.max("call_datetime").alias("last_seen"),
    )


def contact_map(df: DataFrame, minimum: int = 2) -> DataFrame:
    """Per target and common contact: events, tower used most with it, and tower and time of the last event."""
    e = prepared(df).join(common_numbers(df, minimum).select("number"), "number", "left_semi")
    e = e.withColumn("_cell", F.when(I.valid_cell("first_cell_id"), F.col("first_cell_id")))
    per_cell = e.groupBy("target", "number", "_cell").agg(
        F.count("*").alias("n"), F.max(F.struct(F.col("call_datetime").alias("t"), "event_id")).alias("last")
    )
    seen = F.col("_cell").isNotNull()
    top = F.min(F.when(seen, F.struct(-F.col("n"), F.col("_cell").alias("v"))))
    return per_cell.groupBy("target", "number").agg(
        F.sum("n").alias("events"), top["v"].alias("top_tower"), F.max_by("_cell", F.when(seen & F.col("last.t").isNotNull(), F.col("last"))).alias("last_tower"), F.max("last.t").alias("last_time")
    )


def movement_rows(df: DataFrame) -> DataFrame:
    """Tower changes of every target in time order."""
    rows = df.where(I.valid_cell("first_cell_id") & F.col("call_datetime").isNotNull())
    w = Window.partitionBy("target").orderBy("call_datetime", "event_id")
    rows = rows.withColumns({"from_tower": F.lag("first_cell_id").over(w), "from_time": F.lag("call_datetime").over(w)})
    return rows.where("from_tower <> first_cell_id").select(
        "target", "event_id", "from_tower", F.col("first_cell_id").alias("to_tower"), "from_time", F.col("call_datetime").alias("to_time")
    )


def alerts(df: DataFrame, minimum: int = 2) -> DataFrame:
    """One row per kind of common item that was found: severity, how many there are, and what was observed; a row that
    says so where none was found."""
    found = {
        "COMMON_DEVICES": common_devices(df, minimum),
        "COMMON_SIMS": common_sims(df, minimum),
        "DIRECT_LINKS": direct_links(df),
        "COMMON_NUMBERS": common_numbers(df, minimum),
        "COMMON_TOWERS": common_towers(df, minimum),
    }
    counts = [t.agg(F.count("*").alias("items")).select(F.lit(name).alias("alert"), "items") for name, t in found.items()]
    all_ = reduce(DataFrame.union, counts)
    # Five rows: turned into one, so that "none" is a case of the same pass.
    rows = all_.agg(F.collect_list(F.when(F.col("items") > 0, F.struct("alert", "items"))).alias("r"))
    none = F.array(F.struct(F.lit("NOTHING_SHARED").alias("alert"), F.lit(0).cast("long").alias("items")))
    out = rows.select(F.inline(F.when(F.size("r") > 0, F.col("r")).otherwise(none)))
    text = F.coalesce(*[F.when(F.col("alert") == k, F.format_string(v[1], "items")) for k, v in ALERTS.items()])
    severity = F.coalesce(*[F.when(F.col("alert") == k, v[0]) for k, v in ALERTS.items()])
    return out.select("alert", severity.alias("severity"), "items", text.alias("observation"))


def pair_overlap(df: DataFrame, item: Column, minimum: int = 1) -> DataFrame:
    """Pairs of targets with how many items they share.

    Targets with equal sets of items are one class: items are counted for pairs of classes, and only then pairs of classes
    are spread to pairs of targets, which are written as they come and never aggregated. Classes are cut into blocks of
    ``BLOCK`` targets or so, so that no task spreads a whole class and none holds more than a block.
    """
    pairs = df.select("target", item.alias("item")).where("item is not null and item <> ''").distinct()
    of_target = pairs.groupBy("target").agg(F.sha2(F.to_json(F.sort_array(F.collect_list("item"))), 256).alias("class"))
    sizes = of_target.groupBy("class").agg(F.min("target").alias("first"), F.ceil(F.count("*") / BLOCK).alias("blocks"))
    items = pairs.join(sizes.select(F.col("first").alias("target"), "class"), "target").select("class", "item")
    a, b = items.alias("a"), items.alias("b")
    shared = a.join(b, F.expr("a.item = b.item and a.class <= b.class")).groupBy(F.col("a.class").alias("x"), F.col("b.class").alias("y")).agg(F.count("*").alias("shared_items"))
    blocks = sizes.select("class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    side = lambda c, n: blocks.select(F.col("class").alias(c), F.col("block").alias(n))
    met = shared.where(F.col("shared_items") >= minimum).join(side("x", "i"), "x").join(side("y", "j"), "y").where("x < y or i <= j")
    placed = of_target.join(sizes, "class").select("target", "class", F.pmod(F.xxhash64("target"), F.col("blocks")).alias("block"))
    member = lambda c, n, t: placed.select(F.col("class").alias(c), F.col("block").alias(n), F.col("target").alias(t))
    spread = met.join(member("x", "i", "s"), ["x", "i"]).join(member("y", "j", "t"), ["y", "j"])
    return spread.where("s <> t and (x < y or i < j or s < t)").select(F.least("s", "t").alias("target_a"), F.greatest("s", "t").alias("target_b"), "shared_items")
