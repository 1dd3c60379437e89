"""Folders of reports of one family as a case: records with their Spots, reject ledger, files, Spots and targets."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identifiers as I
from ..operators.common import broadcast_if_small, fits_broadcast
from ..schema import CALLS, conform
from . import folders, reports, text
from .text import base_name, ledger, parsed_rows, with_names

#: Families of reports: their aliases, further columns, what makes records of rows, and the time of a record.
FAMILIES = {
    "calls": (text.CALL_ALIASES, text.CALL_COLUMNS, text.calls_from, "call_datetime"),
    "towers": (reports.TOWER_ALIASES, reports.TOWER_COLUMNS, reports.tower_from, "call_datetime"),
    "sessions": (text.SESSION_ALIASES, text.SESSION_COLUMNS, text.sessions_from, "session_start"),
    "ip": (reports.IP_ALIASES, reports.IP_COLUMNS, reports.ip_events_from, "event_time"),
}

# Words on a line above the header by which it names the target of a report.
TARGET_WORDS = ("msisdn", "target", "input value", "mobile number", "phone number", "subscriber number", "requested number")

_MOBILE = r"(?<!\d)(?:91|0)?[6-9]\d{9}(?!\d)"


class Case(NamedTuple):
    """A folder of reports: records, reject ledger, a row for every file, and a row for every Spot."""

    data: DataFrame
    rejected: DataFrame
    files: DataFrame
    spots: DataFrame


def above_header(rows: DataFrame) -> DataFrame:
    """``(source_path, above)``: the lines above the first header of each file, ``PREAMBLE_LINES`` of them at most."""
    line = lambda x: F.array_join(F.from_json(x["json"], "array<string>"), ",")
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source_row", "json"))), line), "\n")
    return rows.where("reason = 'PREAMBLE'").groupBy("source_path").agg(lines.alias("above"))


def stated_operator(above: Column) -> Column:
    out = F.lit("")
    for o in reversed(reports.OPERATORS):
        out = F.when(F.lower(above).contains(o), o.strip()).otherwise(out)
    return out


def stated_cell(above: Column) -> Column:
    return F.regexp_extract(above, r"(?i)(?:cell|cgi)[^\n:]*:\s*['\"]?([0-9A-Z][0-9A-Z-]{5,})", 1)


def read_case(
    spark: SparkSession, root: str, family: str, spots: list[str] | None = None, root_files: bool = True, suffixes: tuple[str, ...] = (".csv", ".txt")
) -> Case:
    """All reports of a family below ``root``, each with its own layout, separator and sections, in one pass over the files.

    A folder of the first level is a Spot (``folders.spot_layout``); ``spots`` selects some of them by name, without regard
    to case, and ``root_files`` says whether files outside of Spots are read. Byte-identical files are read once, in the
    Spot of the first by path. Records carry ``spot_id``, ``spot_name``, ``source_path`` and an ``event_id`` by path and row.
    """
    aliases, columns, make, time = FAMILIES[family]
    texts = folders.contents(spark, root)
    found = folders.stored(folders.spot_layout(folders.listed(texts, suffixes), root))
    if spots is not None:
        wanted = [s.lower() for s in spots]
        found = found.where(F.lower("spot_folder").isin(wanted) | (F.col("spot_folder").isNull() & F.lit(root_files)))
    elif not root_files:
        found = found.where("spot_folder is not null")
    first = folders.stored(folders.distinct_files(found))
    if first.isEmpty():
        raise ValueError("the folder has no reports")
    texts = texts.join(broadcast_if_small(first.select("path")), "path", "left_semi")
    parsed, names = parsed_rows(spark, texts, [], None, 0, with_names(aliases, *columns))
    rows = folders.stored(parsed).withColumnRenamed("path", "source_path").withColumn("source_file", base_name("source_path"))
    place = ["source_path", "source_file", "source_row", "source_row_end", "section_columns", "more_fields"]
    good = rows.where("reason is null").select(*[F.col(f"f{i}").alias(n) for i, n in enumerate(names) if n not in place], *place)
    above = F.coalesce("above", F.lit(""))
    said = first.select(F.col("path").alias("source_path"), "spot_id", "spot_name").join(above_header(rows), "source_path", "left").select(
        "source_path", "spot_id", "spot_name", stated_operator(above).alias("stated_operator"), stated_cell(above).alias("stated_cell")
    )
    said = folders.stored(said)
    accepted, more = make(good.drop("spot_id", "spot_name").join(broadcast_if_small(said), "source_path", "left"))
    bad = ledger(rows.where(text.REJECTED), "json", F.col("reason")).unionByName(more)
    if family == "towers":
        data = conform(accepted, CALLS, ("source_path",))
    else:
        data = accepted.drop("stated_operator", "stated_cell", "section_columns")
    files = _files(found, first, rows, accepted, said)
    return Case(data, bad, files, _spots(files, accepted, time))


def _files(found: DataFrame, first: DataFrame, rows: DataFrame, accepted: DataFrame, said: DataFrame) -> DataFrame:
    """A row for every file. EMPTY_NO_DATA: the report says that it has no records; LOADED_EMPTY: a header and no record."""
    line = F.lower(F.concat_ws(" ", "json", *[c for c in rows.columns if c[0] == "f" and c[1:].isdigit()]))
    counts = rows.groupBy("source_path").agg(
        F.count_if((F.col("section") > 0) & ~F.coalesce(F.col("reason") == "HEADER", F.lit(False))).alias("rows_below_header"), F.max("section").alias("sections"), F.bool_or(line.rlike(r"no\s+(records?|data)\s+found")).alias("says_empty")
    )
    loaded = accepted.groupBy("source_path").agg(F.count("*").alias("records"))
    kept = first.select(F.col("path").alias("source_path"), F.lit(True).alias("_first"))
    every = found.withColumnRenamed("path", "source_path")
    # A row for each file at most: few files say that all of these are few, without a run over the rows.
    few = fits_broadcast(found)
    for more in (kept, counts, loaded, said.drop("spot_id", "spot_name")):
        every = every.join(F.broadcast(more) if few else more, "source_path", "left")
    status = (
        F.when(F.col("_first").isNull(), "DUPLICATE_SKIPPED")
        .when(F.col("records") > 0, "LOADED")
        .when(F.col("says_empty"), "EMPTY_NO_DATA")
        .when(F.col("sections") > 0, "LOADED_EMPTY")
        .otherwise("UNSUPPORTED")
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return every.select(
        "spot_id", "spot_name", F.col("name").alias("file_name"), "source_path", "sha256", "bytes", status.alias("status"),
        F.coalesce("stated_operator", F.lit("")).alias("operator"), F.coalesce("stated_cell", F.lit("")).alias("searched_cell_id"),
        zero("rows_below_header").alias("rows_below_header"), zero("records").alias("records"),
        F.when(F.col("_first"), zero("rows_below_header") - zero("records")).otherwise(F.lit(0).cast("long")).alias("rejected_rows"),
    )


def _spots(files: DataFrame, accepted: DataFrame, time: str) -> DataFrame:
    """A row for every Spot: its files, records, subscribers, and first and last time."""
    of_files = files.groupBy("spot_id", "spot_name").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("status") == "LOADED").alias("files_loaded"),
        F.count_if(F.col("status") == "DUPLICATE_SKIPPED").alias("duplicates"),
        F.sum("records").alias("records"),
    )
    who = F.col("subscriber_number") if "subscriber_number" in accepted.columns else F.coalesce(I.msisdn("a_party"), F.col("a_party"))
    seen = accepted.groupBy("spot_id").agg(
        F.countDistinct(F.when(F.trim(who) != "", who)).alias("subscribers"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen")
    )
    out = of_files.join(seen, "spot_id", "left")  # both are aggregates by Spot
    return out.withColumn("subscribers", F.coalesce("subscribers", F.lit(0).cast("long")))


def targets(rows: DataFrame, min_share: float = 0.8, min_rows: int = 3, lead: float = 0.2) -> DataFrame:
    """``(source_path, target, method, confidence)`` of each report with a call: the number that the lines above its header
    state, else one in its name, else one that stands in most of its calls.

    ``rows``: ``(source_path, source_row, above, a_party, b_party)``, where ``above`` is the text of a line above the header
    and null in calls. A call states a number on either side. The most frequent number counts only from ``min_share`` of the
    calls of a report with ``min_rows`` of them, and if it leads the next one by ``lead``; else the target stays null
    (AMBIGUOUS, or NOT_DETECTED in short reports and reports without numbers).

    Rows are shuffled once, by report, and all that is asked of a report is counted where they arrive.
    """
    line = F.filter(F.split("above", "\n"), lambda x: F.exists(F.array(*map(F.lit, TARGET_WORDS)), lambda w: F.lower(x).contains(w)))
    call, stated = F.col("above").isNull(), F.regexp_extract(F.array_join(line, "\n"), f"({_MOBILE})", 1)
    sides = rows.select("source_path", "source_row", call.alias("call"), F.when(call, F.col("a_party")).otherwise(stated).alias("a"), F.col("b_party").alias("b"))
    plain = lambda c: F.when(F.col(c).rlike(r"^[6-9]\d{9}\z"), F.col(c)).otherwise(I.msisdn(c))
    sides = sides.select("source_path", "source_row", "call", plain("a").alias("a"), plain("b").alias("b"))
    sides = sides.repartition("source_path")
    either = F.explode(
        F.array(
            F.struct(F.coalesce("a", "b").alias("number"), F.col("call").cast("long").alias("calls")),
            F.struct(F.when(F.col("a") != F.col("b"), F.col("b")).alias("number"), F.lit(0).cast("long").alias("calls")),
        )
    )
    numbers = sides.select("source_path", "source_row", "call", either.alias("e")).where("e.number is not null or e.calls > 0")
    n = F.count_if(F.col("call") & F.col("e.number").isNotNull())
    counts = numbers.groupBy("source_path", F.col("e.number").alias("number")).agg(
        n.alias("n"), F.sum("e.calls").alias("calls"), F.min(F.when(~F.col("call"), F.col("source_row"))).alias("at")
    )
    counts = counts.withColumn("place", F.row_number().over(Window.partitionBy("source_path").orderBy(F.desc("n"), "number")))
    found = counts.groupBy("source_path").agg(
        F.sum("calls").alias("calls"),
        F.min_by("number", "at").alias("said"),
        F.max(F.when((F.col("place") == 1) & (F.col("n") > 0), F.col("number"))).alias("number"),
        F.max("n").alias("n"),
        F.coalesce(F.max(F.when(F.col("place") == 2, F.col("n"))), F.lit(0)).alias("second"),
    )
    named = I.msisdn(F.regexp_extract(base_name("source_path"), f"({_MOBILE})", 1))
    often = (F.col("n") >= min_share * F.col("calls")) & (F.col("n") - F.col("second") >= lead * F.col("calls"))
    able = (F.col("calls") >= min_rows) & F.col("number").isNotNull()
    by = lambda a, b, c, d, e: F.when(F.col("said").isNotNull(), a).when(F.col("named").isNotNull(), b).when(able & often, c).when(able, d).otherwise(e)
    none = F.lit(None).cast("string")
    return found.where("calls > 0").withColumn("named", named).select(
        "source_path",
        by(F.col("said"), F.col("named"), F.col("number"), none, none).alias("target"),
        by("METADATA", "FILE_NAME", "ROW_PRESENCE", "AMBIGUOUS", "NOT_DETECTED").alias("method"),
        by("HIGH", "HIGH", "MEDIUM", "LOW", "NONE").alias("confidence"),
    )


def call_targets(spark: SparkSession, reports: str | DataFrame, suffixes: tuple[str, ...] = (".csv", ".txt"), copies: bool = False) -> DataFrame:
    """``targets`` of all reports of calls below a folder, or in a frame in the layout of Spark's ``binaryFile`` source.

    Very many short reports are better kept as rows of such a frame than as files; with ``copies`` it is read once.
    Byte-identical reports are read once and have the row of the first by path; with ``copies`` each has a row of its own.
    Without ``suffixes`` a report may have any name.
    """
    packed = isinstance(reports, DataFrame)
    found = reports if packed else folders.contents(spark, reports)
    texts = folders.with_suffix(found, suffixes)
    if not copies:
        first = folders.stored(folders.distinct_files(folders.listed(found, suffixes)).select("path"))
        texts = found.join(broadcast_if_small(first), "path", "left_semi")
    if not packed and texts.select("path").isEmpty():
        raise ValueError("the folder has no reports")
    if packed:  # parsing costs more than a small table's bytes say
        texts = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    fields = ("a_party", "b_party", "call_date", "call_time")
    known = with_names(text.CALL_ALIASES, *text.CALL_COLUMNS)
    parsed, names = parsed_rows(spark, texts, [], None, 0, known, only=("path", "source_row", "reason", "json", *fields))
    values = [I.without_null_tokens(f"f{names.index(c)}").alias(c) for c in fields]
    above = F.when(F.col("reason") == "PREAMBLE", F.array_join(F.from_json("json", "array<string>"), ","))
    rows = parsed.where("reason is null or reason = 'PREAMBLE'").select(F.col("path").alias("source_path"), "source_row", above.alias("above"), *values)
    # As calls_from: a row without time and parties is no call. Few rows are without parties, so times are read for these only.
    party, time = F.col("a_party").isNotNull() | F.col("b_party").isNotNull(), F.exists(F.array(F.concat_ws(" ", "call_date", "call_time")), text.states_time)
    return targets(rows.where(F.when(F.col("above").isNotNull() | party, True).otherwise(time)))
