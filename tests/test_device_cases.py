import datetime as dt

import pytest

from cellspan.sources import device_cases

VIL = (
    "Vodafone Idea Call Data Records\nIMEI : - 350000000000077\nReport Type :- Main CDR Report\n"
    "Target /A PARTY NUMBER,CALL_TYPE,Type of Connection,B PARTY NUMBER,Call date,Call Initiation Time,Call Duration,First BTS Location,First Cell Global Id,Last Cell Global Id,Service Type,IMEI,IMSI,Roaming Network/Circle\n"
    "919800000001,Outgoing,PREPAID,919000000001,01-06-2026,08:01:39,5,Tower A,405-70-1-1,405-70-1-2,Voice,350000000000070,405752741941459,Bihar\nEnd of report,,,,,,,,,,,,,\n,,,,,,,,,,,x,,\n"
)
SEARCH = (
    "Search Criteria : IMEI\nSearch Value : 350000000000070\nBSNL\n"
    "Target/A-Party Number,Call Type,Type of Connection,Other/B-party Number,Call Date,Call Initiation Time,Call Duration,First Cell Global ID,Last Cell Global ID,Service Type,IMEI,IMSI\n"
    "9860000001,IN,,BB-BSNLBH-P,28/03/2026,18:16:15,1,404-75-1-1,,SMS,350000000000070,404758180316980\n"
)
JIO = (
    "Ticket Number : ,1\nInput Value IMEI : ,'35000000000007'\nCalling Party Telephone Number,Called Party Telephone Number,Call Date,Call Time,Call Duration,Call Type,First Cell ID,Last Cell ID,IMEI,IMSI\n"
    "919000000005,919000000006,02/06/2026,09:00:00,7,A_IN,405-8-1-1,405-8-1-1,3500000000000712,405800000000001\n"
)
IPDR = (
    "BHARTI AIRTEL LTD\nDynamic IPDR OF IMEI : 350000000000077 from 01-Oct-2025 00:00:00 to 12-Oct-2025 23:59:59\n"
    "MSISDN_userID,IMEI,IMSI,Event_Start_Time,Session_Start_Time,Source_Public_IPv4,Source_Public_Port,Destination_IP4,Destination_Port,CGI\n"
    "9876543210,350000000000077,405510000000001,05-Oct-2025 08:14:24,05-Oct-2025 08:14:21,198.51.100.7,4,203.0.113.1,443,404-10-1-1\n"
    "9876543210,990000000000001,405510000000001,05-Oct-2025 08:14:25,05-Oct-2025 08:14:21,198.51.100.7,4,203.0.113.1,443,404-10-1-1\n This is System generated report\n"
)
GPRS = (
    "BHARTI AIRTEL LTD\nGPRS OF IMEI : 350000000000077 from x\nMSISDN,IMEI,IMSI,Start Time,End Time,Uplink,Downlink,Total,CGI\n"
    "9876543210,350000000000077,405510000000001,12-Jun-2026 01:00:00,12-Jun-2026 01:01:00,1,2,3,405-51-834-1\n"
)


@pytest.fixture
def case(spark, tmp_path):
    f = tmp_path / "dev"
    (f / "again").mkdir(parents=True)
    files = {"vil.csv": VIL, "again/vil.csv": VIL, "search.csv": SEARCH, "jio.csv": JIO, "ipdr.csv": IPDR, "gprs.csv": GPRS, "other.csv": "a,b\n1,2\n"}
    files["IMEI_IPDR_350000000000077.csv"] = "No records found\nSource IP Address,Destination IP Address,Landline/MSISDN/MDN/Leased Circuit ID for Internet Access,TIME1 (dd/MM/yyyy HH:mm:ss)\n"
    for name, body in files.items():
        (f / name).write_text(body)
    return device_cases.read_device_case(spark, str(f))


def test_formats_and_relations(case):
    got = {r["source_path"].split("/dev/")[1]: r for r in case.files.collect()}
    short = {k: (r["format_id"], r["operator"], r["status"], r["query_identifier"], r["query_identifier_type"], r["records"]) for k, r in got.items()}
    dup = short.pop("vil.csv" if short["vil.csv"][2] == "DUPLICATE" else "again/vil.csv")
    assert dup[2] == "DUPLICATE"
    vil = short.pop("vil.csv", None) or short.pop("again/vil.csv")
    assert vil == ("VIL_IMEI_CDR", "Vodafone Idea", "HAS_DATA", "350000000000077", "IMEI15", 1)
    assert short == {
        "search.csv": ("SEARCH_CRITERIA_IMEI_CDR", "BSNL", "HAS_DATA", "350000000000070", "IMEI15", 1),
        "jio.csv": ("JIO_IMEI_CDR", "Reliance Jio", "HAS_DATA", "35000000000007", "BASE14", 1),
        "ipdr.csv": ("AIRTEL_DYNAMIC_IMEI_IPDR", "Bharti Airtel", "HAS_DATA", "350000000000077", "IMEI15", 2),
        "gprs.csv": ("AIRTEL_IMEI_GPRS", "Bharti Airtel", "HAS_DATA", "350000000000077", "IMEI15", 1),
        "IMEI_IPDR_350000000000077.csv": ("GENERIC_IMEI_IPDR", "Unknown", "VALID_EMPTY", "350000000000077", "IMEI15", 0),
        "other.csv": ("UNKNOWN", "Unknown", "UNSUPPORTED", "", "UNKNOWN", 0),
    }
    r = got["ipdr.csv"]
    assert (r["exact"], r["report_scope"], got["jio.csv"]["base14_match"], got["search.csv"]["exact"]) == (1, 1, 1, 1)


def test_records_of_three_families(case):
    calls = {r["format_id"]: r for r in case.calls.collect()}
    v, s, j = (calls[f"{k}_IMEI_CDR"] for k in ("VIL", "SEARCH_CRITERIA", "JIO"))
    assert (v["target"], v["other_party"], v["call_type"], v["call_direction"], v["call_datetime"], v["match_relation"]) == ("9800000001", "919000000001", "outgoing", "OUTGOING", dt.datetime(2026, 6, 1, 8, 1, 39), "SAME_BASE14")
    assert (s["call_type"], s["call_datetime"], s["first_cell_id"]) == ("smsin", dt.datetime(2026, 3, 28, 18, 16, 15), "404-75-1-1")
    assert (j["target"], j["other_party"], j["match_relation"], j["call_direction"]) == ("9000000006", "919000000005", "BASE14_MATCH", "INCOMING")
    assert sorted(r["match_relation"] for r in case.ip.collect()) == ["EXACT", "REPORT_SCOPE"]
    g = case.sessions.first()
    assert (g["subscriber_number"], g["session_duration_seconds"], g["match_relation"], g["source_row_number"]) == ("9876543210", 60.0, "EXACT", 4)
    assert [(r["source_file"], r["rejection_reason"]) for r in case.rejected.collect()] == [("vil.csv", "NO_TIME_AND_PARTIES")]
