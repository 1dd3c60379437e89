"""Rows are neither lost nor doubled: regression tests."""

import datetime as dt
import json

from pyspark.sql import functions as F

from cellspan.functions import identifiers as I
from cellspan.operators import cdr, common, master, parts, scope
from cellspan.sources import folders, reports, text


def test_extra_fields_far_beyond_the_header(spark, tmp_path):
    long = "1,2" + "," * 20 + "3"
    (tmp_path / "x.csv").write_text(f'a,b\n1,2\n{long}\n"q, ""r""",\n,5,,,\n')
    for read in (text.read_lines, text.read_delimited):
        good, bad = read(spark, str(tmp_path / "x.csv"), ["a", "b"])
        rows = [(r["a"] or None, r["b"] or None, r["source_row"]) for r in good.orderBy("source_row").collect()]
        assert rows == [("1", "2", 2), ('q, "r"', None, 4), (None, "5", 5)]
        assert [r["source_row_number"] for r in bad.collect()] == [3]
        assert len(json.loads(bad.first()["raw_fields_json"])) == 22


def test_call_type_labels(spark):
    cases = {"SMT": "smsin", "smo": "smsout", "P2POUT": "smsout", "p2aout": "smsout", "VDO_OUT": "outgoing", "v-in": "incoming", "MTC": "incoming"}
    cases |= {"SMS Terminating": "smsin", "call originating": "outgoing", "SMS_Generic": "sms", "dsm": "dsm", "": "", "smtp": "smtp"}
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    assert {r["raw"]: r["got"] for r in df.select("raw", I.canonical_call_type("raw").alias("got")).collect()} == cases
    by = {("MOC", "SMS"): "smsout", ("MTC", "sms"): "smsin", ("SMT", "SMS"): "smsin", ("x", "SMS"): "sms", ("MTC", None): "incoming"}
    df = spark.createDataFrame(list(by), "raw string, service string")
    assert {(r[0], r[1]): r[2] for r in df.select("raw", "service", I.canonical_call_type("raw", "service")).collect()} == by


def test_repeated_master_keys_double_no_event(spark):
    events = spark.createDataFrame([(1, "9876543210", "405-51-834-1"), (2, "123", "405-51--")], "event_id long, other_party string, first_cell_id string")
    numbers = spark.createDataFrame([("919876543210", "old", 1), ("9876543210", "new", 2), ("09876543210", "none", 0)], "mobile_number string, name string, source_row long")
    got = master.enrich_number(events, numbers, order=["source_row"]).orderBy("event_id").collect()
    assert [(r["event_id"], r["subscriber_name"], r["lookup_status"]) for r in got] == [(1, "new", "FOUND"), (2, None, "INVALID_KEY")]
    cells = spark.createDataFrame([("405-51--834-1", "A"), ("405-51-834-1", "B")], "cgi string, site string")
    assert [r["cell_site"] for r in master.enrich_cell(events, cells).orderBy("event_id").collect()] == ["B", None]


def test_cells_are_compared_by_their_key(spark):
    t = dt.datetime
    s = spark.createDataFrame([(1, t(2024, 1, 1, 9), t(2024, 1, 1, 10), "S1", "405-51-834 1")], "event_id long, session_start timestamp_ntz, session_end timestamp_ntz, spot_id string, searched_cell_id string")
    p = parts.build(spark, [(t(2024, 1, 1, 9), t(2024, 1, 1, 10))])
    assert parts.excluded_sessions(s, p, ["405/51/834/1"]).count() == 0 and parts.excluded_sessions(s, p, ["405-51-834-2"]).count() == 1


def test_intervals_by_day(spark):
    """Binned joins give what the plain conditions give, for points, spans over days, long and reversed spans, and nulls."""
    t = dt.datetime
    spans = [(1, t(2024, 1, 1, 23), t(2024, 1, 3, 1)), (2, t(2023, 1, 1), t(2025, 1, 1)), (3, t(2024, 1, 2), t(2024, 1, 1)), (4, None, t(2024, 1, 2)), (5, t(2024, 1, 2, 10), t(2024, 1, 2, 11))]
    ranges = [(t(2024, 1, 1), t(2024, 1, 2)), (t(2024, 1, 2), t(2024, 1, 20)), (t(2024, 1, 3), t(2024, 1, 3, 0, 30))]
    s = spark.createDataFrame([(*x, "S") for x in spans], "event_id long, session_start timestamp_ntz, session_end timestamp_ntz, spot_id string")
    p = parts.build(spark, ranges)
    want = {(i, n + 1) for i, a, b in spans for n, (x, y) in enumerate(ranges) if a and a < y and b > x}
    got = [(r["event_id"], r["part_no"]) for r in parts.session_overlap(s, p).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    got = [(r["event_id"], r["part_no"]) for r in parts.assign(s, p, "session_start").collect()]
    assert set(got) == {(i, n + 1) for i, a, _ in spans for n, (x, y) in enumerate(ranges) if a and x <= a < y}
    plan = parts.assign(s, p, "session_start")._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "BroadcastHashJoin" in plan


def test_loaded_rows_have_ids(spark, tmp_path):
    (tmp_path / "d.csv").write_text(
        "Airtel tower report\nSearched Cell ID: 405-51-834-1\nCalling No,Called No,Call Date,Call Time,Duration,Call Type,IMEI,First Cell\n"
        + "".join(f"9876543210,912345678{i},01/06/2026,10:0{i}:00,5,MOC,350000000000008,405-51-834-1\n" for i in range(5))
    )
    good, _ = reports.read_tower_dump(spark, str(tmp_path / "d.csv"))
    ids = [r["event_id"] for r in good.collect()]
    assert len(set(ids)) == 5 and None not in ids
    groups = spark.createDataFrame([("g", "405-51-834-1")], "group_id string, cgi string")
    assert scope.group_scope(good, groups).count() == 5
    calls, _ = text.read_calls(spark, str(tmp_path / "d.csv"))
    assert sorted(r["event_id"] for r in calls.collect()) == sorted(ids)


def test_rejected_ip_rows_say_where_they_are(spark, tmp_path):
    (tmp_path / "i.csv").write_text("MSISDN,Source IP Address,Destination IP Address,Dest Port,Event Date Time\n9876543210,10.0.0.1,203.0.113.5,443,11/06/2026 10:00:00\nEnd of report,,,,\n")
    _, bad = reports.read_ip_events(spark, str(tmp_path / "i.csv"))
    assert [(r["source_file"], r["source_row_number"]) for r in bad.collect()] == [("i.csv", 3)]


def test_ingest_after_a_crash_loads_nothing_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("a\n1\n")
    read = lambda p: text.read_delimited(spark, p, ["a"])[0]
    run = lambda m: folders.ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / m), read)
    assert run("lost manifest").count() == 1 and run("m").count() == 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_totals_do_not_depend_on_order(spark):
    df = spark.createDataFrame([("t", x, "p") for x in (0.1, 0.2, 0.3, 1e9, 0.00005, 0.00005)], "target string, call_duration double, other_party string")
    got = {tuple(cdr.activity(d, ("target",)).first()) for d in (df, df.orderBy("call_duration").coalesce(1), df.orderBy(F.desc("call_duration")).coalesce(1))}
    assert len(got) == 1
    one = spark.createDataFrame([(1.00005,), (1.00005,)], "d double").agg(common.average(F.col("d")), common.total("d")).first()
    assert one[:] == (1.0001, 2.0001)


def test_cell_master_without_a_header(spark, tmp_path):
    rows = [f"{i}|Sector {i % 3}, some street {i} of the town|19.{100 + i}|72.{200 + i}|405-51-834-{i}" for i in range(1, 9)]
    (tmp_path / "c.txt").write_text("\n".join(rows) + "\nbroken|line\n")
    good, bad = reports.read_cell_master(spark, str(tmp_path / "c.txt"))
    got = sorted(tuple(r) for r in good.select("cgi", "latitude", "longitude", "address").collect())
    assert got[0] == ("405-51-834-1", 19.101, 72.201, "Sector 1, some street 1 of the town") and len(got) == 8 and bad.count() == 1


def test_files_of_one_name_keep_their_rows_apart(spark, tmp_path):
    body = "Calling No,B Party No,Call Date,Call Time,Call Type\n" + "".join(f"9876543210,912345678{i},01/06/2026,10:0{i}:00,MOC\n" for i in range(3))
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.csv").write_text(body)
    paths = [str(tmp_path / d / "x.csv") for d in ("a", "b")]
    calls, _ = text.read_calls(spark, paths, paths[0])
    rows = calls.collect()
    assert len({r["event_id"] for r in rows}) == 6 and {r["source_file"] for r in rows} == {"x.csv"}
    good, bad = text.read_lines(spark, paths, ["a", "b", "c", "d", "e"], with_path=True)
    lines = good.collect()
    assert sorted(r["source_row"] for r in lines) == [2, 2, 3, 3, 4, 4] and bad.count() == 0
    assert {r["source_path"] for r in lines} == {r["source_path"] for r in rows} and {r["a"] for r in lines} == {"9876543210"}


def test_quotes_in_lines(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"x"tail,2\n"x,y"" z"more"e,3\n"open,4\n5,"op\n"",7\n8,i"n"n\n')
    good, bad = text.read_lines(spark, str(tmp_path / "q.csv"), ["a", "b"])
    assert [(r["a"], r["b"]) for r in good.orderBy("source_row").collect()] == [("xtail", "2"), ('x,y" zmore"e', "3"), ("", "7"), ("8", 'i"n"n')]
    assert sorted((r["source_row_number"], r["rejection_reason"]) for r in bad.collect()) == [(4, "UNCLOSED_QUOTE"), (5, "UNCLOSED_QUOTE")]


def test_ingest_after_a_crash_with_a_new_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for with_path in (False, True):
        target = str(tmp_path / f"t{with_path}")
        (tmp_path / "in" / "a.csv").write_text(f"a\n1{with_path}\n")
        (tmp_path / "in" / "b.csv").unlink(missing_ok=True)
        read = lambda p: text.read_delimited(spark, p, ["a"], with_path=with_path)[0]  # noqa: B023, E731
        run = lambda m: folders.ingest(spark, str(tmp_path / "in"), target, str(tmp_path / f"{m}{with_path}"), read)  # noqa: B023, E731
        run("lost manifest")
        (tmp_path / "in" / "b.csv").write_text(f"a\n2{with_path}\n")
        assert run("m").count() == 2 and run("m").count() == 0
        assert sorted(r["a"] for r in spark.read.parquet(target).collect()) == [f"1{with_path}", f"2{with_path}"]


def test_one_date_layout_per_file(spark, tmp_path):
    head = "Calling No,B Party No,Call Date,Call Time\n"
    dates = {"us.csv": ["01/05/2024", "01/25/2024"], "in.csv": ["01/05/2024", "25/01/2024"], "none.csv": ["01/05/2024", "2024-02-03"], "both.csv": ["01/05/2024", "01/25/2024", "25/01/2024"], "days.csv": ["45413", "02-Mar-2024"]}
    for name, values in dates.items():
        (tmp_path / name).write_text(head + "".join(f"9876543210,9123456789,{d},10:00:00\n" if "/" in d or "-" in d else f"9876543210,9123456789,{d},\n" for d in values))
    calls, bad = text.read_calls(spark, [str(tmp_path / n) for n in dates], str(tmp_path / "us.csv"))
    got = {}
    for r in calls.orderBy("source_row").collect():
        got.setdefault(r["source_file"], []).append((r["call_datetime"].month, r["call_datetime"].day))
    assert got == {"us.csv": [(1, 5), (1, 25)], "in.csv": [(5, 1), (1, 25)], "none.csv": [(5, 1), (2, 3)], "both.csv": [(5, 1), (1, 25), (1, 25)], "days.csv": [(5, 1), (3, 2)]}
    assert bad.count() == 0


def test_sections_are_read_by_their_headers(spark, tmp_path):
    (tmp_path / "i.csv").write_text(
        "IPDR\nMSISDN,Source IP Address,Destination IP Address,Event Date Time\n9876543210,10.0.0.1,203.0.113.5,11/06/2026 10:00:00\n"
        "next part\nDestination IP Address,Source IP Address,Dest Port,Note,Event Date Time,MSISDN\n"
        "203.0.113.6,10.0.0.2,443,x,11/06/2026 11:00:00,9876543211\nMSISDN,Source IP Address,Destination IP Address,Event Date Time\n9876543212,10.0.0.3,203.0.113.7,11/06/2026 12:00:00\n"
    )
    good, bad = reports.read_ip_events(spark, str(tmp_path / "i.csv"))
    got = [(r["subscriber_number"], r["source_ip"], r["destination_ip"], r["destination_port"], r["event_time"].hour) for r in good.orderBy("event_time").collect()]
    assert got == [("9876543210", "10.0.0.1", "203.0.113.5", None, 10), ("9876543211", "10.0.0.2", "203.0.113.6", 443, 11), ("9876543212", "10.0.0.3", "203.0.113.7", None, 12)]
    assert [(r["source_row_number"], r["rejection_reason"]) for r in bad.collect()] == [(4, "NO_EVENT_TIME")]
