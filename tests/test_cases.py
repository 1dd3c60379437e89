import datetime as dt

import pytest

from cellspan.sources import cases

DUMP = "{} tower report\nSearched Cell ID: {}\nCalling No,Called No,Call Type,Date,Time,Duration,IMEI\n"
ROW = "{},{},{},{},10:00:0{},5,350000000000008\n"


@pytest.fixture
def root(tmp_path):
    r = tmp_path / "dumps"
    for d in ("Beta/deep", "alpha"):
        (r / d).mkdir(parents=True)
    one = DUMP.format("Airtel", "405-51-834-1") + ROW.format("9876543210", "9123456789", "MTC", "01/25/2024", 1) + ROW.format("9876543210", "9123456788", "MOC", "01/05/2024", 2)
    (r / "Beta" / "x.csv").write_text(one)
    (r / "Beta" / "deep" / "x.csv").write_text(one.replace("834-1", "834-2") + "Cell ID,Called No,Calling No,Call Type,Date,Time\n405-51-834-9,9000000001,9000000002,MOC,01/26/2024,11:00:00\n,,,,,\njunk\n")
    (r / "alpha" / "x.csv").write_text("Jio\n" + "Calling No|Called No|Call Type|Date|Time\n9000000003|9000000004|MOC|25/01/2024|12:00:00\n")
    (r / "alpha" / "copy.csv").write_text(one)
    (r / "alpha" / "empty.csv").write_text(DUMP.format("BSNL", "405-51-834-7") + "No records found\n")
    (r / "alpha" / "head.csv").write_text(DUMP.format("Vi ", "405-51-834-8"))
    (r / "top.txt").write_text("nothing\n")
    return str(r)


def place(r):
    return r["source_path"].split("/dumps/")[1]


def test_spots_layouts_and_sections(spark, root):
    case = cases.read_case(spark, root, "towers")
    rows = {(place(r), r["subscriber_number"]): r for r in case.data.collect()}
    assert len({r["event_id"] for r in rows.values()}) == len(rows) == 6
    first = rows["Beta/x.csv", "9123456789"]
    assert (first["spot_id"], first["spot_name"], first["operator"], first["searched_cell_id"], first["call_datetime"]) == ("SPOT-02", "Beta", "airtel", "405-51-834-1", dt.datetime(2024, 1, 25, 10, 0, 1))
    assert rows["Beta/x.csv", "9876543210"]["call_datetime"] == dt.datetime(2024, 1, 5, 10, 0, 2)  # month first, as the file shows
    part = rows["Beta/deep/x.csv", "9000000002"]
    assert (part["other_party"], part["searched_cell_id"], part["call_datetime"].hour) == ("9000000001", "405-51-834-9", 11)
    other = rows["alpha/x.csv", "9000000003"]
    assert (other["spot_id"], other["operator"], other["call_datetime"]) == ("SPOT-01", "jio", dt.datetime(2024, 1, 25, 12))
    assert {(r["source_file"], r["source_row_number"]) for r in case.rejected.collect()} == {("empty.csv", 4), ("x.csv", 9)}


def test_files_and_spots(spark, root):
    case = cases.read_case(spark, root, "towers")
    files = {place(r): (r["status"], r["operator"], r["records"], r["rejected_rows"]) for r in case.files.collect()}
    assert files == {
        "Beta/x.csv": ("LOADED", "airtel", 2, 0),
        "Beta/deep/x.csv": ("LOADED", "airtel", 3, 1),
        "alpha/x.csv": ("LOADED", "jio", 1, 0),
        "alpha/copy.csv": ("DUPLICATE_SKIPPED", "", 0, 0),
        "alpha/empty.csv": ("EMPTY_NO_DATA", "bsnl", 0, 1),
        "alpha/head.csv": ("LOADED_EMPTY", "vi", 0, 0),
        "top.txt": ("UNSUPPORTED", "", 0, 0),
    }
    spots = {r["spot_id"]: (r["files"], r["files_loaded"], r["duplicates"], r["records"], r["subscribers"]) for r in case.spots.collect()}
    assert spots["SPOT-02"] == (2, 2, 0, 5, 3) and spots["SPOT-01"] == (4, 1, 1, 1, 1) and spots["UNASSIGNED-ROOT"] == (1, 0, 0, 0, 0)


def test_selected_spots(spark, root):
    case = cases.read_case(spark, root, "towers", spots=["ALPHA"], root_files=False)
    assert {place(r).split("/")[0] for r in case.files.collect()} == {"alpha"} and case.data.count() == 3
    with pytest.raises(ValueError):
        cases.read_case(spark, root, "towers", spots=["none"], root_files=False)


def test_targets_of_files(spark, tmp_path):
    head = "A Party,B Party,Date,Time\n"
    lines = lambda who, n=5: "".join(f"{who},91234567{i:02},01/06/2026,10:0{i}:00\n" for i in range(n))
    files = {
        "a.csv": "Target number : +919811111111\n" + head + lines("9822222222"),
        "calls_919833333333_x.csv": head + lines("9822222222"),
        "rows.csv": head + lines("9822222222", 6),
        "mixed.csv": head + lines("9822222222", 3) + lines("9844444444", 3),
        "short.csv": head + lines("9822222222", 2),
        "none.csv": head + "AB-BANK-S,123,01/06/2026,10:00:00\n" * 4,
    }
    (tmp_path / "in").mkdir()
    for name, body in files.items():
        (tmp_path / "in" / name).write_text(body)
    got = {r["source_path"].rsplit("/", 1)[1]: (r["target"], r["method"], r["confidence"]) for r in cases.call_targets(spark, str(tmp_path / "in")).collect()}
    assert got == {
        "a.csv": ("9811111111", "METADATA", "HIGH"),
        "calls_919833333333_x.csv": ("9833333333", "FILE_NAME", "HIGH"),
        "rows.csv": ("9822222222", "ROW_PRESENCE", "MEDIUM"),
        "mixed.csv": (None, "AMBIGUOUS", "LOW"),
        "short.csv": (None, "NOT_DETECTED", "NONE"),
        "none.csv": (None, "NOT_DETECTED", "NONE"),
    }


def test_sessions_and_calls(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.csv").write_text("GPRS report\nMSISDN,IMEI,Start Time,End Time,Uplink,Downlink,Total,CGI\n9876543210,350000000000008,12-Jun-2026 01:00:00,12-Jun-2026 01:01:00,1,2,3,405-51-834-1\nx,,,,,,,\n")
    case = cases.read_case(spark, str(tmp_path / "s"), "sessions")
    r = case.data.first()
    assert (r["subscriber_number"], r["session_duration_seconds"], r["searched_cell_id"]) == ("9876543210", 60.0, "405-51-834-1")
    assert case.rejected.first()["rejection_reason"] == "NO_SESSION_START" and case.spots.first()["records"] == 1


def test_reports_in_rows_are_as_those_in_files(spark, tmp_path):
    """Very many short reports may come as rows of a frame; byte-identical ones are read once."""
    head = "Calling No,Called No,Date,Time\n"
    texts = {f"/u={i}/r.txt": head + "".join(f"98765432{i:02},912345678{j},25/01/2024,10:00:0{j}\n" for j in range(4)) for i in range(20)}
    texts["/u=9/copy.txt"] = texts["/u=9/r.txt"]
    texts["/u=x/none.txt"] = "nothing\n"
    rows = [(p, dt.datetime(2024, 1, 1), len(t), bytearray(t.encode())) for p, t in texts.items()]
    packed = spark.createDataFrame(rows, "path string, modificationTime timestamp, length long, content binary")
    for p, t in texts.items():
        f = tmp_path / "in" / p[1:]
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    got = {r["source_path"]: (r["target"], r["method"]) for r in cases.call_targets(spark, packed).collect()}
    assert len(got) == 20 and got["/u=3/r.txt"] == ("9876543203", "ROW_PRESENCE") and "/u=9/r.txt" not in got
    files = {r["source_path"].split("/in")[1]: (r["target"], r["method"]) for r in cases.call_targets(spark, str(tmp_path / "in")).collect()}
    assert files == got


def test_rows_are_parsed_once(spark, tmp_path):
    """Whatever is asked of a case afterwards, no report is opened again."""
    import shutil

    (tmp_path / "c" / "s").mkdir(parents=True)
    (tmp_path / "c" / "s" / "x.csv").write_text(DUMP.format("Airtel", "405-51-834-1") + ROW.format("9876543210", "9123456789", "MTC", "25/01/2024", 1))
    case = cases.read_case(spark, str(tmp_path / "c"), "towers")
    shutil.move(str(tmp_path / "c"), str(tmp_path / "gone"))
    assert case.data.count() == 1 and case.files.collect()[0]["records"] == 1 and case.spots.count() == 1 and case.rejected.count() == 0


def test_copies_of_reports_in_rows(spark):
    text = "Calling No,Called No,Date,Time\n" + "9876543210,9123456789,25/01/2024,10:00:00\n" * 3
    rows = [(f"/part={i}/report.txt", dt.datetime(2024, 1, 1), len(text), bytearray(text.encode())) for i in range(3)]
    packed = spark.createDataFrame(rows, "path string, modificationTime timestamp, length long, content binary")
    assert cases.call_targets(spark, packed).count() == 1
    got = sorted((r["source_path"], r["method"]) for r in cases.call_targets(spark, packed, copies=True).collect())
    assert got == [(p, "AMBIGUOUS") for p, *_ in rows]  # two numbers in every row


def test_query_has_a_row_for_every_copy_of_a_report(spark, tmp_path):
    """Reports of one user with equal rows and times in two parts are byte-identical."""
    import duckdb

    from cellspan.plans import catalog, catalog_files

    at, apart = dt.datetime(2024, 1, 1, 10), catalog_files.PER_FILE * 97 * 22 * 19  # equal numbers, other part
    events = [(e + k * apart, at, 7, "click", 1.0, '{"k": 1}') for e in (1, 2, 4) for k in range(2)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    con.execute("create view customer as select 1 as c_custkey, '' as c_name; create view part as select 1 as p_partkey, '' as p_name")
    columns = ("user", "part", "target", "method", "confidence")
    got = catalog.QUERIES["load_call_targets"](spark, folder).select(*columns).collect()
    want = con.execute(f'select "user", part, target, method, confidence from ({catalog.ORACLES["load_call_targets"]})').fetchall()
    assert len(want) == 2 and sorted(map(tuple, got)) == sorted(want)


def test_lines_that_count_for_targets(spark, tmp_path):
    """Rows without time and parties are no calls, whatever the layout of their times; the first line that states a number counts."""
    head, row = "A Party,B Party,Date,Time\n", "9822222222,{},25/01/2024,10:00:00\n"
    files = {
        "timed.csv": head + ",,01/25/2024,10:00:00\n" * 2 + row.format("") * 3,
        "blank.csv": head + ",,x,y\n" * 5 + row.format("") * 4,
        "lines.csv": "Target: none\nMSISDN : 09811111111 and 9833333333\nSubscriber number 9844444444\n" + head + row.format("9811111111"),
        "other.csv": "Cell of 9811111111\n" + head + row.format("-") * 4,
        "quoted.csv": '"Report of 9811111113\nTarget number 9811111112"\n' + head + row.format(""),
        "same.csv": head + row.format("+91 98222 22222") * 4,
        "tie.csv": head + row.format("9811111111") * 4,
        "only.csv": "MSISDN 9811111111\n" + head,
    }
    (tmp_path / "in").mkdir()
    for name, body in files.items():
        (tmp_path / "in" / name).write_text(body)
    got = {r["source_path"].rsplit("/", 1)[1]: (r["target"], r["method"]) for r in cases.call_targets(spark, str(tmp_path / "in")).collect()}
    assert got == {
        "timed.csv": (None, "AMBIGUOUS"),
        "blank.csv": ("9822222222", "ROW_PRESENCE"),
        "lines.csv": ("9811111111", "METADATA"),
        "other.csv": ("9822222222", "ROW_PRESENCE"),
        "quoted.csv": ("9811111112", "METADATA"),
        "same.csv": ("9822222222", "ROW_PRESENCE"),
        "tie.csv": (None, "AMBIGUOUS"),
    }


def test_short_reports_share_batches_and_are_counted_in_one_shuffle(spark, monkeypatch):
    import pyarrow as pa

    from cellspan.sources import text

    body = "Calling No,Called No,Date,Time\n9876543210,9123456789,25/01/2024,10:00:00\n"

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, parse, schema):
            reports = pa.RecordBatch.from_arrays([pa.array([f"/{i}.txt" for i in range(3000)]), pa.array([body.encode()] * 3000, pa.binary())], ["path", "content"])
            return list(parse(iter([reports])))

    with monkeypatch.context() as m:
        m.setattr(text, "DataFrame", Frame)
        known = text.with_names(text.CALL_ALIASES, *text.CALL_COLUMNS)
        batches, names = text.parsed_rows(spark, Frame(), [], None, 0, known, only=("path", "reason", "a_party"))
    assert [b.num_rows for b in batches] == [5000, 1000]
    assert batches[0].schema.names == ["path", "reason", f"f{names.index('a_party')}"]
    assert batches[1].to_pylist()[-1] == {"path": "/2999.txt", "reason": None, f"f{names.index('a_party')}": "9876543210"}

    packed = spark.createDataFrame([("/1.txt", dt.datetime(2024, 1, 1), len(body), bytearray(body.encode()))], "path string, modificationTime timestamp, length long, content binary")
    plan = cases.call_targets(spark, packed, copies=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 2 and "Join" not in plan
