"""Delimited text with a reject ledger, preamble sniffing, and operator report formats."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import REJECTS, dedupe_names, rename_aliases, row_id, snake

#: Encodings that are tried in order; the last one takes any byte.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")


def decode(raw: bytes) -> str:
    for e in ENCODINGS[:-1]:
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            pass
    return raw.decode(ENCODINGS[-1])


def head(spark: SparkSession, path: str, n_bytes: int = 65_536) -> list[str]:
    """First lines of a file, through Spark's file system, so that any store that Spark reads will do."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = min(n_bytes, fs.getFileStatus(p).getLen())
    stream = fs.open(p)
    try:
        raw = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size))) if size else b""
    finally:
        stream.close()
    lines = decode(raw).splitlines()
    return lines[:-1] if size == n_bytes else lines


def split_line(line: str, sep: str) -> list[str]:
    import csv

    return next(csv.reader([line], delimiter=sep), [])


def sniff(lines: list[str], keywords: tuple[str, ...], seps: tuple[str, ...] = (",", "|", "\t", ";", "^")) -> tuple[int, str, list[str]]:
    """Header line, separator and names: the line with most known keywords among its fields."""
    best = (0, 0, ",", [])
    for i, line in enumerate(lines[:200]):
        for sep in seps:
            fields = split_line(line, sep)
            names = [snake(x) for x in fields]
            score = sum(any(k in n for n in names) for k in keywords)
            if len(fields) > 1 and score > best[0]:
                best = (score, i, sep, fields)
    if not best[0]:
        raise ValueError("no line looks like a header")
    return best[1], best[2], [x.strip().strip('"') for x in best[3]]


def base_name(path):
    return F.regexp_extract(path, "([^/]+)$", 1)


#: Lines above the first header of a file that are taken as its preamble; more of them are rejected.
PREAMBLE_LINES = 200

#: Parsed rows that are neither data nor part of a report's layout.
REJECTED = "reason is not null and reason not in ('PREAMBLE', 'HEADER')"

SEPARATORS = (",", "|", "\t", ";", "^")


_LETTER = re.compile(r"[^\W\d_]")


def is_header(fields: list[str], known: set[str], aliases: dict[str, str]) -> bool:
    """Whether a row names columns: most of its fields that are not blank, and two at least, are known names."""
    filled = [x for x in fields if x.strip()]
    hits = misses = 0
    for x in filled:
        # Most rows are data: no name is without letters, and a row with too many other fields needs no further look.
        n = snake(x) if _LETTER.search(x) else ""
        if n and aliases.get(n, n) in known:
            hits += 1
        else:
            misses += 1
            if 5 * misses > 2 * len(filled):
                return False
    return hits >= 2


def first_header(lines: list[str], keywords: tuple[str, ...], aliases: dict[str, str]) -> tuple[int, str, list[str]]:
    """As ``sniff``, but the first line that names columns, where the one with most keywords heads a later section."""
    at, sep, names = sniff(lines, keywords)
    for i, line in enumerate(lines[:at]):
        if is_header(fields := split_line(line, sep), set(aliases.values()), aliases):
            return i, sep, [x.strip().strip('"') for x in fields]
    return at, sep, names


def parsed_rows(
    spark: SparkSession, path: str | list[str] | DataFrame, names: list[str], sep: str | None, skip: int, aliases: dict[str, str] | None = None,
    only: tuple[str, ...] = (),
) -> tuple[DataFrame, list[str]]:
    """``(rows, columns)``: every row of text files with its place, ``reason`` (null: data) and fields ``f0, f1 ...``.

    ``path``: files by name, or a frame ``(path, content)`` of them. They are read whole as bytes, and parsed in a stream of
    batches. With ``aliases`` a file may have
    several sections: a row in which most fields are known names is a header, and the rows below are read by it, up to the
    next one. ``names`` is the header of the first section, above which ``skip`` lines are left out; if it is empty, the
    first header is looked for as well, and the lines above it have the reason PREAMBLE (beyond ``PREAMBLE_LINES`` of
    them NO_HEADER). Columns that ``names`` lacks follow under their canonical names; fields that no name is known for are
    kept in ``more_fields`` as JSON. The headers themselves have the reason HEADER. ``section_columns``: the canonical names of a row's header, between commas. Without
    ``sep`` it is the one under which a line of the file is a header. ``only``: the columns that the rows have, fields by
    their names; all, if it is empty.
    """
    names = dedupe_names(names)
    own = len(names)
    canonical = lambda n: (aliases or {}).get(snake(n), snake(n))
    slots: dict[str, list[int]] = {}
    for i, n in enumerate(names):
        slots.setdefault(canonical(n.rsplit(".", 1)[0] if n.rsplit(".", 1)[-1].isdigit() else n), []).append(i)
    for n in dict.fromkeys((aliases or {}).values()):
        if n not in slots:
            slots[n] = [len(names)]
            names.append(n)
    width, known = len(names), set(slots)
    out_names = ["path", "section", "source_row", "source_row_end", "reason", "json", "section_columns", "more_fields", *[f"f{i}" for i in range(width)]]
    kept = [i for i, n in enumerate([*out_names[:8], *names]) if not only or n in only]
    kinds = dict.fromkeys(out_names, "string") | {"section": "int", "source_row": "long", "source_row_end": "long"}

    def parse(batches):
        import csv
        import io
        import json

        import pyarrow as pa

        dumps = json.JSONEncoder(ensure_ascii=False).encode
        types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        schema = [(i, out_names[i], types[kinds[out_names[i]]]) for i in kept]

        def flush(rows):
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[i], t) for i, _, t in schema], [n for _, n, _ in schema])

        seen = set()

        def names_columns(fields):
            """``is_header``, which for the same few headers of very many short files is asked once."""
            if tuple(fields) in seen:
                return True
            found = is_header(fields, known, aliases)
            if found and len(seen) < 1000:
                seen.add(tuple(fields))
            return found

        def separator(text):
            heads = [x for _, x in zip(range(PREAMBLE_LINES), io.StringIO(text))]
            for s in SEPARATORS:
                if any(map(names_columns, csv.reader(heads, delimiter=s))):
                    return s
            return ","

        @lru_cache(1000)
        def header(fields):
            """For each field of a header the place of its values, or none, and the canonical names between commas."""
            used, at = {}, []
            for n in map(canonical, fields):
                free = slots.get(n, [])[used.get(n, 0) :]
                used[n] = used.get(n, 0) + 1
                at.append(free[0] if free else None)
            return at, "," + ",".join(map(canonical, fields)) + ","

        def rows_of(file, text):
            reader = csv.reader(io.StringIO(text, newline=""), delimiter=sep or separator(text))
            last, section, above = 0, int(own > 0), 0
            at, fields = list(range(own)), names[:own]
            columns = "," + ",".join(map(canonical, fields)) + "," if aliases else None
            for r in reader:
                first, last = last + 1, reader.line_num
                if first <= skip or not any(x.strip() for x in r):
                    continue
                place = (file, section, first, last)
                if aliases and names_columns(r):
                    section, fields, (at, columns) = section + 1, r, header(tuple(r))
                    yield (file, section, first, last, "HEADER", dumps(r), columns, None, *[None] * width)
                    continue
                if not section:
                    above += 1
                    yield (*place, "PREAMBLE" if above <= PREAMBLE_LINES else "NO_HEADER", dumps(r), None, None, *[None] * width)
                    continue
                while len(r) > len(at) and not r[-1].strip():
                    r.pop()
                if len(r) > len(at):
                    yield (*place, "FIELD_COUNT_MISMATCH", dumps(r), columns, None, *[None] * width)
                    continue
                out, more = [None] * width, {}
                for value, slot, name in zip(r, at, fields):
                    if slot is not None:
                        out[slot] = value
                    elif value.strip():
                        more[name.strip()] = value
                yield (*place, None, None, columns, dumps(more) if more else None, *out)

        rows = []
        for b in batches:
            for file, raw in zip(b.column(0).to_pylist(), b.column(1)):
                for r in rows_of(file, decode(raw.as_py())):
                    rows.append(r)
                    if len(rows) >= 5000:
                        yield flush(rows)
                        rows = []
        # Short files share a batch.
        if rows:
            yield flush(rows)

    files = path if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path)
    files = files.select("path", "content")
    return files.mapInArrow(parse, ", ".join(f"`{out_names[i]}` {kinds[out_names[i]]}" for i in kept)), names


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    names: list[str],
    sep: str = ",",
    skip: int = 1,
    aliases: dict[str, str] | None = None,
    with_path: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: rows of text files that share a header, and the ledger of those that do not fit it.

    Files are read whole (a quoted field may hold line breaks and the encoding is found per file). Short rows are filled up
    with nulls and blank trailing extras are dropped; a row with more fields that are not blank goes to the ledger with its
    first and last physical line and the SHA-256 of its fields as JSON. Accepted rows carry ``source_file``, ``source_row``
    and ``source_row_end``; ``with_path`` adds ``source_path``, which tells files of one name apart. With ``aliases`` the
    sections of a report are read each by its header (``parsed_rows``), and rows carry ``section_columns`` and
    ``more_fields``.
    """
    rows, names = parsed_rows(spark, path, names, sep, skip, aliases)
    rows = rows.withColumn("source_file", base_name("path")).withColumnRenamed("path", "source_path")
    place = ["source_file", "source_row", "source_row_end"] + ["source_path"] * with_path + ["section_columns", "more_fields"] * (aliases is not None)
    good = rows.where("reason is null").select(*[F.col(f"f{i}").alias(n) for i, n in enumerate(names)], *place)
    return good, ledger(rows.where(REJECTED), "json", F.col("reason"))


def fields_of(line: str, sep: str):
    """Column of the fields of a line: quoted ones without their quotes and with what follows these, empty ones as null."""
    s = re.escape(sep)
    raw = F.regexp_extract_all(F.concat(F.lit(sep), F.col(line)), F.lit(f'{s}("(?:[^"]++|"")*+"[^{s}]*+|[^{s}]*+)'), F.lit(1))
    quoted = '^"((?:[^"]++|"")*+)"(.*)$'
    inner = lambda x: F.concat(F.replace(F.regexp_extract(x, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(x, quoted, 2))
    return F.transform(raw, lambda x: F.when(x != "", F.when(x.rlike(quoted), inner(x)).otherwise(x)))


def read_lines(
    spark: SparkSession, path: str | list[str], names: list[str], sep: str = ",", skip: int = 1, with_path: bool = False
) -> tuple[DataFrame, DataFrame]:
    """As ``read_delimited`` for UTF-8 files without line breaks in fields, of any size: files are split over tasks.

    A line's number is its place in its split plus the lines of the splits before it in the file, which are counted in a
    pass of their own, a few numbers per file; files are told apart by their whole path. Only the lines up to ``skip`` of
    each file are left out as header. All fields of a line are looked at: a row with more than the header has, of which one
    is not blank, is rejected whole, and so is one with a quote that opens a field and is not closed.
    """
    names = dedupe_names(names)
    width = len(names)
    file = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(path).select(
        "value", F.regexp_replace(file, "^file:/+", "file:/").alias("source_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    w = Window.partitionBy("source_path").orderBy("block")
    splits = lines.groupBy("source_path", "block").agg(F.min("at").alias("lo"), F.count("*").alias("n"))
    splits = splits.withColumn("before", F.sum("n").over(w) - F.col("n")).drop("n")
    placed = lines.join(splits, ["source_path", "block"]).withColumn("source_row", F.col("at") - F.col("lo") + F.col("before") + 1)
    placed = placed.withColumn("source_file", base_name("source_path"))
    rows = placed.where((F.col("source_row") > skip) & (F.trim("value") != "")).withColumn("_r", fields_of("value", sep))
    extra = F.exists(F.slice("_r", width + 1, 1 << 30), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    s = re.escape(sep)
    opened = F.concat(F.lit(sep), F.col("value")).rlike(f'^(?:{s}(?:"(?:[^"]++|"")*+"[^{s}]*+|(?!")[^{s}]*+))*+{s}"')
    reason = F.when(opened, "UNCLOSED_QUOTE").when(extra, "FIELD_COUNT_MISMATCH")
    rows = rows.withColumn("_reason", reason)
    good = rows.where("_reason is null").select(
        *[F.try_element_at("_r", F.lit(i + 1)).alias(n) for i, n in enumerate(names)],
        "source_file", "source_row", F.col("source_row").alias("source_row_end"), *["source_path"] * with_path,
    )
    bad = rows.where("_reason is not null").withColumn("_json", F.to_json(F.transform("_r", lambda x: F.coalesce(x, F.lit("")))))
    return good, ledger(bad, "_json", F.col("_reason"))


#: Beginnings of a numeric date of which one number cannot be a month and the other one can, by the place of the former.
_MONTH, _NO_MONTH = r"(?:0?\d|1[0-2])", r"(?:1[3-9]|[2-9]\d)"
_NUMERIC = {i: rf"^['\"]?{a}[-/.]{b}[-/.]\d{{4}}" for i, a, b in ((1, _NO_MONTH, _MONTH), (2, _MONTH, _NO_MONTH))}


def with_times(df: DataFrame, columns: list[str], by: str = "source_path") -> DataFrame:
    """``df`` with its text columns ``columns`` read as times, each by one layout per file.

    If a column of a file holds a date whose first number cannot be a month, and none whose second cannot be one, its
    numeric dates are day-first; in the opposite case they are month-first; without such dates, or with both kinds, an
    ambiguous date is day-first and another one what it can only be. Names of months, and years that come first, leave no
    choice.
    """
    from ..functions import identifiers as I
    from ..operators.common import broadcast_if_small
    from .folders import stored

    if not columns:
        return df
    over = lambda c, i: F.bool_or(I.text(c).rlike(_NUMERIC[i]))
    orders = df.groupBy(by).agg(*[(over(c, 2) & ~over(c, 1)).alias(f"_m_{c}") for c in columns])
    out = df.join(broadcast_if_small(stored(orders)), by, "left")
    read = lambda c: F.when(F.col(f"_m_{c}"), F.coalesce(I.event_time(c, I.MONTH_FIRST), I.event_time(c))).otherwise(F.coalesce(I.event_time(c), I.event_time(c, I.MONTH_FIRST)))
    return out.withColumns({c: read(c) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def states_time(c):
    """Whether ``with_times`` reads a time from a text, which the layout of its file does not change."""
    from ..functions import identifiers as I

    return F.coalesce(I.event_time(c), I.event_time(c, I.MONTH_FIRST)).isNotNull()


def ledger(rows: DataFrame, json_col: str, reason) -> DataFrame:
    have = set(rows.columns)
    end = F.col("source_row_end") if "source_row_end" in have else F.col("source_row")
    return rows.select(
        "source_file",
        F.col("source_row").alias("source_row_number"),
        end.alias("source_row_end_number"),
        reason.alias("rejection_reason"),
        F.sha2(json_col, 256).alias("raw_row_digest_sha256"),
        F.col(json_col).alias("raw_fields_json"),
    )


def quarantine(df: DataFrame, bad, reason: str) -> tuple[DataFrame, DataFrame]:
    """``(accepted, ledger)`` of a frame with ``source_file`` and ``source_row``; a condition that is null accepts."""
    bad = F.coalesce(bad, F.lit(False))
    rows = df.where(bad).withColumn("_json", F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    return df.where(~bad), ledger(rows, "_json", F.lit(reason))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REJECTS)


# Header aliases of call records.
CALL_ALIASES = {
    "a_party_no": "a_party",
    "calling_no": "a_party",
    "calling_party": "a_party",
    "target_no": "a_party",
    "b_party_no": "b_party",
    "called_no": "b_party",
    "called_party": "b_party",
    "other_party": "b_party",
    "date": "call_date",
    "time": "call_time",
    "call_start_time": "call_time",
    "dur_s": "call_duration",
    "duration": "call_duration",
    "duration_sec": "call_duration",
    "first_cell": "first_cell_id",
    "first_cgi": "first_cell_id",
    "first_cell_global_id": "first_cell_id",
    "last_cell": "last_cell_id",
    "last_cgi": "last_cell_id",
    "last_cell_global_id": "last_cell_id",
    "imei_no": "imei",
    "imsi_no": "imsi",
    "type": "call_type",
    "type_of_call": "call_type",
    "service": "service_type",
    "roam_nw": "roaming_circle",
}


CALL_COLUMNS = ("a_party", "b_party", "call_type", "service_type", "call_date", "call_time", "call_duration", "imei", "imsi", "first_cell_id", "last_cell_id", "roaming_circle")


def with_names(aliases: dict[str, str], *columns: str) -> dict[str, str]:
    """``aliases`` in which the canonical names stand for themselves, too."""
    return aliases | {c: c for c in (*aliases.values(), *columns)}


def calls_from(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: call records from rows under canonical names; without time and parties they are rejected."""
    from ..functions import identifiers as I

    df = rows
    for c in CALL_COLUMNS:
        df = df.withColumn(c, I.without_null_tokens(c) if c in df.columns else F.lit(None).cast("string"))
    df = df.withColumns(
        {
            "raw_call_type": F.col("call_type"),
            "call_type": I.canonical_call_type("call_type", "service_type"),
            "call_datetime": F.concat_ws(" ", "call_date", "call_time"),
            "call_duration": I.duration_seconds("call_duration"),
        }
    )
    df = with_times(df, ["call_datetime"]).withColumn("event_id", row_id())
    empty = F.col("call_datetime").isNull() & F.col("a_party").isNull() & F.col("b_party").isNull()
    return quarantine(df, empty, "NO_TIME_AND_PARTIES")


def read_calls(spark: SparkSession, path: str, sample: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Call records of files with one layout: header found among preamble lines, aliases mapped, values cleaned.

    ``sample`` names the file whose header is sniffed (by default ``path``). Dates are read by one layout per file, sections
    each by their header. Rows without time and parties are rejected.
    """
    known = with_names(CALL_ALIASES, *CALL_COLUMNS)
    skip, sep, names = first_header(head(spark, sample or path), ("party", "call", "imei", "imsi", "cell", "cgi", "date", "time", "dur"), known)
    good, bad = read_delimited(spark, path, names, sep, skip + 1, known, with_path=True)
    accepted, more = calls_from(rename_aliases(good, CALL_ALIASES).drop("section_columns"))
    return accepted, bad.unionByName(more)


# Header aliases of packet-session reports.
SESSION_ALIASES = {
    "msisdn": "subscriber_number",
    "mobile_number": "subscriber_number",
    "start_time": "session_start",
    "session_start_time": "session_start",
    "end_time": "session_end",
    "session_end_time": "session_end",
    "uplink": "uplink_volume",
    "upload": "uplink_volume",
    "downlink": "downlink_volume",
    "download": "downlink_volume",
    "total": "total_volume",
    "cgi": "searched_cell_id",
    "cell_id": "searched_cell_id",
    "ip_address": "ipv4_address",
}


SESSION_COLUMNS = ("imei", "imsi", "technology", "pre_post", "roaming_circle", "ipv6_address")


def sessions_from(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: packet sessions from rows under canonical names; without a start they are rejected."""
    from ..operators import sessions as S
    from ..schema import SESSIONS, conform

    times = [c for c in ("session_start", "session_end") if c in rows.columns]
    df = conform(with_times(rows, times), SESSIONS, ("source_row", "source_path"))
    df = df.withColumn("session_duration_seconds", F.timestamp_diff("SECOND", F.col("session_start"), F.col("session_end")).cast("double"))
    return quarantine(S.normalise(df), F.col("session_start").isNull(), "NO_SESSION_START")


def read_sessions(spark: SparkSession, path: str, sample: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Packet sessions, reject ledger and status; a report that says it has no records is EMPTY_NO_DATA, no failure."""
    lines = head(spark, sample or path)
    known = with_names(SESSION_ALIASES, *SESSION_COLUMNS)
    skip, sep, names = first_header(lines, ("msisdn", "mobile", "subscriber", "imei", "session", "start", "volume", "cell", "cgi"), known)
    status = "EMPTY_NO_DATA" if re.search(r"(?i)no (records?|data) found", "\n".join(lines)) else "HAS_DATA"
    good, bad = read_delimited(spark, path, names, sep, skip + 1, known, with_path=True)
    accepted, more = sessions_from(rename_aliases(good, SESSION_ALIASES))
    return accepted.drop("source_row", "source_path"), bad.unionByName(more), status


def read_call_folder(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Call records of files with different layouts: ``(accepted, rejected, status by path)``.

    Files are grouped by their header, and each group is read at once; a file without a header is left out and said so.
    Byte-identical files are the caller's to drop (``folders.distinct_files``).
    """
    groups: dict[tuple, list[str]] = {}
    status = {}
    for p in paths:
        try:
            skip, sep, names = sniff(head(spark, p), ("party", "call", "imei", "imsi", "cell", "cgi", "date", "time", "dur"))
            groups.setdefault((skip, sep, *names), []).append(p)
            status[p] = "LOADED"
        except Exception as e:  # noqa: BLE001  the status says which file and why
            status[p] = f"FAILED: {str(e)[:200]}"
    if not groups:
        raise ValueError("no file has a header")
    good = bad = None
    for files in groups.values():
        g, b = read_calls(spark, files, files[0])
        good = g if good is None else good.unionByName(g, allowMissingColumns=True)
        bad = b if bad is None else bad.unionByName(b)
    return good, bad, status


def with_targets(calls: DataFrame) -> DataFrame:
    """``calls`` with the target of each file: the number that most of the file's rows have, on either side."""
    from ..functions import identifiers as I
    from ..operators.common import broadcast_if_small

    sides = F.explode(F.array_distinct(F.array_compact(F.array(I.msisdn("a_party"), I.msisdn("b_party")))))
    file = "source_path" if "source_path" in calls.columns else "source_file"
    counts = calls.select(file, sides.alias("number")).groupBy(file, "number").agg(F.count("*").alias("n"))
    best = counts.groupBy(file).agg(F.min(F.struct(-F.col("n"), "number"))["number"].alias("target"))
    return calls.drop("target").join(broadcast_if_small(best), file, "left")
