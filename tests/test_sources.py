import datetime as dt
import json

from pyspark.sql import functions as F

from cellspan import schema
from cellspan.operators import parts, presence
from cellspan.plans import bundles, domain
from cellspan.sources import folders, sinks, text
from cellspan.streaming import ingest

REPORT = """Report of calls
Target : 9876543210

Calling No,B Party No,Call Date,Call Time,Dur(s),Call Type,First Cell ID,IMEI
9876543210,9123456789,11/06/2026,10:00:00,12,MOC,405-51-834-1,350000000000008
9876543210,AB-BANKXX-S,11/06/2026,10:05:00,0,SMS-MT,405-51--,
9876543210,9123456789,11/06/2026,10:06:00,1:05,MTC,405-51-834-2,350000000000008,,
bad,row,with,far,too,many,fields,here,indeed
short,row
"""


def test_quarantine_of_overflow_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("a,b,c\n1,2,3\n4,5,6,7\n8\n\"q\nr\",é,\n".encode("cp1252"))
    good, bad = text.read_delimited(spark, str(tmp_path / "x.csv"), ["a", "b", "c"])
    assert [tuple(r) for r in good.orderBy("source_row").collect()] == [
        ("1", "2", "3", "x.csv", 2, 2), ("8", None, None, "x.csv", 4, 4), ("q\nr", "é", "", "x.csv", 5, 6),
    ]
    row = bad.first()
    assert row["source_row_number"] == 3 and row["rejection_reason"] == "FIELD_COUNT_MISMATCH"
    assert json.loads(row["raw_fields_json"]) == ["4", "5", "6", "7"] and len(row["raw_row_digest_sha256"]) == 64
    assert bad.schema == schema.REJECTS or [f.name for f in bad.schema] == [f.name for f in schema.REJECTS]
    assert text.empty_ledger(spark).schema == schema.REJECTS


def test_split_files_keep_line_numbers(spark, tmp_path):
    n = 3000
    (tmp_path / "big.csv").write_text("a,b\n" + "".join(f"{i},{'x' * 40}\n" for i in range(n)) + "1,2,3\n")
    (tmp_path / "small.csv").write_text("a,b\n7,8\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        good, bad = text.read_lines(spark, str(tmp_path), ["a", "b"])
        rows = good.where("source_file = 'big.csv'").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["source_row"], int(r["a"])) for r in rows) == [(i + 2, i) for i in range(n)]
    assert good.where("source_file = 'small.csv'").first()["source_row"] == 2
    assert bad.first()["source_row_number"] == n + 2


def test_call_report(spark, tmp_path):
    (tmp_path / "c.csv").write_text(REPORT)
    good, bad = text.read_calls(spark, str(tmp_path / "c.csv"))
    rows = good.orderBy("source_row").collect()
    assert [r["call_type"] for r in rows] == ["outgoing", "smsin", "incoming", ""] or [r["call_type"] for r in rows][:3] == ["outgoing", "smsin", "incoming"]
    assert rows[0]["call_datetime"] == dt.datetime(2026, 6, 11, 10) and rows[2]["call_duration"] == 65.0
    assert bad.count() == 1


def test_session_report(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "Airtel\nGPRS report\nMSISDN,IMEI,Start Time,End Time,Uplink,Downlink,Total,CGI\n"
        "9876543210,350000000000008,12-Jun-2026 01:00:00,12-Jun-2026 01:01:00,1,2,3,405-51-834-1\n"
        "9876543210,350000000000008,12-Jun-2026 01:00:00,12-Jun-2026 00:01:00,1,2,30,405-51-834-1\nx,,,,,,,\n"
    )
    good, bad, status = text.read_sessions(spark, str(tmp_path / "s.csv"))
    rows = good.orderBy(F.desc("session_duration_seconds")).collect()
    assert status == "HAS_DATA" and [r["session_time_valid"] for r in rows] == [True, False]
    assert [r["volume_mismatch"] for r in rows] == [False, True] and bad.count() == 1
    (tmp_path / "e.csv").write_text("Airtel\nMSISDN,IMEI,Start Time,End Time\nNo records found\n")
    assert text.read_sessions(spark, str(tmp_path / "e.csv"))[2] == "EMPTY_NO_DATA"


def test_folders_and_incremental_ingest(spark, tmp_path):
    src = tmp_path / "in"
    for folder, name, body in (("Beta", "1.csv", "a\n1\n"), ("alpha", "2.csv", "a\n2\n"), ("alpha", "copy.csv", "a\n2\n"), (".", "root.csv", "a\n3\n")):
        (src / folder).mkdir(parents=True, exist_ok=True)
        (src / folder / name).write_text(body)
    found = folders.files(spark, str(src))
    assert folders.inventory(found).first()[:3] == (4, 16, 3)
    layout = {r["name"]: r["spot_id"] for r in folders.spot_layout(found, f"file:{src}").collect()}
    assert layout == {"1.csv": "SPOT-02", "2.csv": "SPOT-01", "copy.csv": "SPOT-01", "root.csv": "UNASSIGNED-ROOT"}
    run = lambda: folders.ingest(spark, str(src), str(tmp_path / "t"), str(tmp_path / "m"), lambda p: text.read_delimited(spark, p, ["a"])[0])
    assert run().count() == 3 and run().count() == 0
    (src / "new.csv").write_text("a\n9\n")
    assert run().count() == 1
    assert sorted(r["a"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["1", "2", "3", "9"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=cmd", 1, ["x"]), ("ok", 2, None)], "t string, n int, l array<string>")
    staged = sinks.stage(df, str(tmp_path / "p"), "staged_view", ("n",))
    assert spark.table("staged_view").count() == 2 and json.loads(sinks.manifest(staged, "v", "p"))["rows"] == 2
    sinks.validate(staged, ("t",), 2)
    sinks.write_csv(df, str(tmp_path / "c"))
    assert {r["t"] for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {"'=cmd", "ok"}
    assert sinks.write_bundle({"a": df, "b": df.withColumn("v", F.raise_error(F.lit("no")))}, str(tmp_path / "b"))["a"] == "OK"


def test_streams(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=i), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, k string")
    df.write.parquet(str(tmp_path / "in"))
    go = lambda: ingest.ingest_parquet(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ingest.windowed_counts(stream, "ts", ("k",)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(events), count(*) from w").first()[:] == (60, 12)


def test_boundaries(spark):
    t = dt.datetime
    rows = [(1, "a", t(2024, 1, 1, 9, 59, 59), "S1"), (2, "a", t(2024, 1, 1, 10), "S1"), (3, "b", None, "S1"), (4, "", t(2024, 1, 1, 9), "S1")]
    df = spark.createDataFrame(rows, "event_id long, subscriber_number string, call_datetime timestamp_ntz, spot_id string")
    p = parts.build(spark, [(t(2024, 1, 1, 9), t(2024, 1, 1, 10))])
    assert sorted(r["event_id"] for r in parts.assign(df, p).collect()) == [1, 4]
    now, base = presence.split_window(df, t(2024, 1, 1, 9), t(2024, 1, 1, 10))
    assert sorted(r["event_id"] for r in now.collect()) == [1, 4] and sorted(r["event_id"] for r in base.collect()) == [2, 3]
    s = spark.createDataFrame([(1, t(2024, 1, 1, 8), t(2024, 1, 1, 9), "S1"), (2, t(2024, 1, 1, 8), t(2024, 1, 1, 9, 0, 1), "S1")], "event_id long, session_start timestamp_ntz, session_end timestamp_ntz, spot_id string")
    assert [(r["event_id"], r["overlap_seconds"]) for r in parts.session_overlap(s, p).collect()] == [(2, 1.0)]
    assert presence.split_overlap(s, t(2024, 1, 1, 9), t(2024, 1, 1, 10))[0].count() == 2


def test_bundles_build(spark):
    sf = "/root/testdata/sf0.001"
    calls, packet, ips = domain.calls(spark, sf), domain.sessions(spark, sf), domain.ip_events(spark, sf)
    for b in (bundles.call_bundle(calls), bundles.tower_bundle(calls), bundles.spot_bundle(calls, ["SPOT-01"]), bundles.session_bundle(packet), bundles.ip_bundle(ips), bundles.cross_bundle(calls), bundles.device_bundle(calls, packet, ips, "350000000000008")):
        assert all(len(df.columns) for df in b.values())


def test_tower_dump_and_masters(spark, tmp_path):
    from cellspan.plans import pipeline
    from cellspan.sources import reports

    (tmp_path / "in").mkdir()
    dump = tmp_path / "in" / "d.csv"
    dump.write_text(
        "Airtel tower report\nSearched Cell ID: 405-51-834-1\nPeriod 01-06-2026 00:00 to 02-06-2026 00:00\n"
        "Calling No,Called No,Call Date,Call Time,Duration,Call Type,IMEI,First Cell\n"
        "9876543210,9123456789,01/06/2026,10:00:00,5,MTC,350000000000008,405-51-834-1\n"
        "9876543210,AB-BANKXX-S,01/06/2026,10:01:00,5,MOC,x,405-51-834-1\n,,01/06/2026,,,,,\n"
    )
    good, bad = reports.read_tower_dump(spark, str(dump))
    rows = good.orderBy("call_datetime").collect()
    assert [(r["subscriber_number"], r["other_party"], r["imei"]) for r in rows] == [("9123456789", "9876543210", "350000000000008"), ("9876543210", "AB-BANKXX-S", "")]
    assert rows[0]["operator"] == "airtel" and rows[0]["searched_cell_id"] == "405-51-834-1" and bad.count() == 1
    kinds = {r["kind"] for r in reports.inspect(spark, [str(dump), str(tmp_path / "none")]).collect()}
    assert kinds == {"CELL_DUMP", "ERROR"}
    load = lambda folder: reports.read_tower_dump(spark, folder, str(dump))[0]
    args = (spark, str(tmp_path / "in"), str(tmp_path / "stage"), "dump", load)
    assert pipeline.staged(*args)[1] is False and pipeline.staged(*args)[1] is True
    status = pipeline.run(*args, lambda df: {"n": df.groupBy("operator").count()}, str(tmp_path / "out"), ("operator",))
    assert status == {"n": "OK"}
    (tmp_path / "sdr.txt").write_text("Mobile|Name|DOA\n919876543210|A|2020\n9876543210|B|2021\n12|C|2022\n")
    m, r = reports.read_number_master(spark, str(tmp_path / "sdr.txt"))
    assert [(x["mobile_number"], x["subscriber_name"]) for x in m.collect()] == [("9876543210", "B")] and r.count() == 1
    (tmp_path / "cgi.csv").write_text("CGI,Lat,Long,Site Name\n405-51--834-12,19.1,72.9,X\n405-51-,1,2,Y\n")
    c, r = reports.read_cell_master(spark, str(tmp_path / "cgi.csv"))
    assert c.first()[:7] == ("405-51-834-12", "405", "51", "834", "12", 19.1, 72.9) and r.count() == 1


def test_ip_report(spark, tmp_path):
    from cellspan.sources import reports

    (tmp_path / "i.csv").write_text(
        "IPDR\nMSISDN,Source IP Address,Public IP,Destination IP Address,Dest Port,Event Date Time,IMEI,CGI\n"
        "9876543210,10.0.0.1,2001:0DB8::0001,203.0.113.5,443,11/06/2026 10:00:00,350000000000008,405-51-834-1\nEnd of report,,,,,,,\n"
    )
    good, bad = reports.read_ip_events(spark, str(tmp_path / "i.csv"))
    r = good.first()
    assert (r["translated_ip"], r["destination_port"], r["event_time"]) == ("2001:db8::1", 443, dt.datetime(2026, 6, 11, 10)) and bad.count() == 1
    assert reports.device_evidence(good, "35000000000000").first()["match_relation"] == "BASE14_MATCH"


def test_call_folder_with_two_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text(REPORT)
    (tmp_path / "b.txt").write_text("A Party|B Party|Date|Time|Duration|Type\n9811111111|9822222222|01/06/2026|10:00|5|OUT\n9833333333|9811111111|01/06/2026|11:00|5|IN\n")
    (tmp_path / "none.csv").write_text("nothing\n")
    good, bad, status = text.read_call_folder(spark, [str(tmp_path / x) for x in ("a.csv", "b.txt", "none.csv")])
    assert sorted(s.split(":")[0] for s in status.values()) == ["FAILED", "LOADED", "LOADED"]
    got = {r["source_file"]: r["target"] for r in text.with_targets(good).collect()}
    assert got == {"a.csv": "9876543210", "b.txt": "9811111111"} and bad.count() == 1
