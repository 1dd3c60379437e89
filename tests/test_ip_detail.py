import datetime as dt

import pytest

from cellspan.sources import ip_detail

AIRTEL = (
    "MSISDN_userID,IMEI,IMSI,Downlink_Vol,Uplink_Vol,Event_Start_Time,Session_Start_Time,Session_End_Time,Pre_Post,Roaming_Circle,ICR_Operator_Name,Home_Circle,"
    "Source_Public_IPv4,Source_Public_IPv6,Source_Public_Port,Destination_IP4,Destination_IP6,Destination_Port,Source_Private_IPV4,Source_Handset_Port,Duration,"
    "Charging_ID,Access_Point_Name,PACO_GW_IP,2g/4g/5g,CGI Latitude,CGI Longitude,CGI"
)
EVENT = (
    "{who},3500000000000080,405510000000001,200,100,05-Oct-2025 08:14:24,05-Oct-2025 08:14:21,05-Oct-2025 08:15:56,Post,DELHI,,GJ,{v4},{v6},44784,,"
    "2001:0DB8:0:0:0:0:0:7260,5222,,44784,95,1019,net,198.51.100.9,4G,28.6,77.1,404-10-2330-1"
)
JIO = (
    "Landline/MSISDN/MDN/Leased Circuit ID for Internet Access,User Id for internet Access based on authentication,Source IP Address,Source Port,Translated IP Address,"
    "Translated Port,Destination IP Address,Destination Port,Static/Dynamic IP Address Allocation,IST Start Time of Public IP address allocation (hh:mm:ss),"
    "IST End Time of Public IP address allocation (hh:mm:ss),Start Date of Public IP Address allocation (dd/mm/yyyy),End Date of Public IP address allocation (dd/mm/yyyy),"
    "Source MAC-ID Address/Other device Identification number,IMSI,PGW IP address,Access Point Name,First CELL ID,Last CELL ID,TIME1 (dd/MM/yyyy HH:mm:ss),"
    "Session Duration (Seconds),Data Volume Up Link,Data Volume Down Link,Roaming Circle Indicator,Roaming Circle,SIM Type"
)
JIO_ROW = "{who},u,10.0.0.1,1000,198.51.100.1,2000,203.0.113.5,443,Dynamic,10:00:00,11:00:00,{date},{date},350000000000008,405510000000001,192.0.2.1,net,c1,c2,{time},60,1,2,N,GJ,4G"


def folder(tmp_path):
    f = tmp_path / "case"
    (f / "sub").mkdir(parents=True)
    head = "\nBHARTI AIRTEL LTD\n\nPan India\n\nDynamic IPDR OF {} from 01-Oct-2025 00:00:00 to 12-Oct-2025 23:59:59\n\n"
    tail = "\n This is System generated report, and needs no signature.\n\n 12-Oct-2025 18:16:55\n"
    one = EVENT.format(who="9876543210", v4="198.51.100.7", v6="")
    (f / "a.csv").write_text(head.format("MSISDN : 9876543210") + AIRTEL + "\n" + one + "\n" + EVENT.format(who="5754021077243", v4="", v6="2001:db8:8339:2dbc:0:0:0:2") + "\nstray,words\n" + tail)
    (f / "sub" / "a.csv").write_text(head.format("PUBLIC IP : 2001:0db8:0:0::7 AND PUBLIC PORT : 443") + AIRTEL + "\n" + one + "\n" + tail)
    (f / "copy.csv").write_text((f / "a.csv").read_text())
    (f / "x_public_ip4_198_51_100_20_public_port_8080.csv").write_text("AIRTEL\n" + AIRTEL + "\nNo Records Found\n")
    (f / "vi.csv").write_text(
        "VIL Call Data Records\nDESTIP :- 203.0.113.9\n\nSr.No.,MSISDN,IMEI,IMSI,Session Start date & time,Session End date & time,Duration in sec,Source IP,Source Port,Translated IP,Translated Port,"
        "Destination IP,Destination Port,Charging ID,Access Point Name,PGW IP address,First Cell ID-Name/Location,CGI-ld,RAT,Data Volume Uplink,Data Volume Downlink\n"
        "1,919876543211,350000000000016,405510000000002,03/04/2025 10:00:00,03/04/2025 10:05:00,300,10.1.1.1,1,198.51.100.3,2,203.0.113.9,80,7,net,192.0.2.7,Site,405-51-1-2,4G,5,6\nEnd of list\n"
    )
    (f / "jio.csv").write_text(JIO + "\n" + JIO_ROW.format(who="9876543212", date="01/02/2025", time="03/02/2025 01:02:03") + "\n" + JIO_ROW.format(who="9876543212", date="01/02/2025", time="") + "\n")
    (f / "jio_home.csv").write_text(JIO + "\n" + JIO_ROW.format(who="home-1", date="01/02/2025", time="") + "\n")
    (f / "jio_dynamic.csv").write_text(JIO + "\n" + JIO_ROW.format(who="9876543213", date="", time="2025/02/03 04:05:06") + "\n" + JIO_ROW.format(who="", date="", time="2025/02/03 04:05:06") + "\n")
    (f / "Cell_ID_IPDRNAT_1.csv").write_text(JIO + "\n" + JIO_ROW.format(who="9876543214", date="01/02/2025", time="03/02/2025 01:02:03") + "\n")
    (f / "search.csv").write_text("Search Value,From Date,To Date,Port\n203.0.113.77,01/02/2025,02/02/2025,443\n,,,\n")
    (f / "other.txt").write_text("nothing that is known\n")
    return str(f)


@pytest.fixture
def case(spark, tmp_path):
    return ip_detail.read_case(spark, folder(tmp_path))


def test_records_of_all_operators(case):
    rows = {(r["source_path"].split("/case/")[1], r["source_row_number"]): r for r in case.data.collect()}
    t = dt.datetime
    assert set(rows) == {("a.csv", 9), ("a.csv", 10), ("sub/a.csv", 9), ("vi.csv", 5), ("jio.csv", 2), ("jio_home.csv", 2), ("jio_dynamic.csv", 2)}
    assert len({r["event_id"] for r in rows.values()}) == 7
    a, b, s = rows["a.csv", 9], rows["a.csv", 10], rows["sub/a.csv", 9]
    assert (a["subscriber_number"], a["subscriber_identifier_type"], a["source_ip"], a["source_ip_version"]) == ("9876543210", "MSISDN", "198.51.100.7", "IPv4")
    assert (b["subscriber_number"], b["subscriber_identifier_type"], b["source_ip"], b["destination_ip"]) == ("5754021077243", "NUMERIC_SUBSCRIBER_ID", "2001:db8:8339:2dbc::2", "2001:db8::7260")
    assert (a["report_scope"], a["query_value"], a["query_port"]) == ("TARGET_SUBSCRIBER", "9876543210", None)
    assert (s["report_scope"], s["query_value"], s["query_port"]) == ("REVERSE_PUBLIC_IP_PORT", "2001:db8::7", 443)
    assert (a["event_time"], a["session_end"], a["destination_port"], a["uplink_volume"], a["first_cell_id"]) == (t(2025, 10, 5, 8, 14, 24), t(2025, 10, 5, 8, 15, 56), 5222, 100.0, "404-10-2330-1")
    v = rows["vi.csv", 5]
    assert (v["operator"], v["report_scope"], v["query_value"], v["event_time"], v["subscriber_number"], v["destination_ipv4"], v["last_cell_id"]) == ("Vi", "REVERSE_DESTINATION_IP", "203.0.113.9", t(2025, 4, 3, 10), "9876543211", "203.0.113.9", "Site")
    j, h, d = rows["jio.csv", 2], rows["jio_home.csv", 2], rows["jio_dynamic.csv", 2]
    assert (j["record_type"], j["report_scope"], j["query_value"], j["event_time"], j["allocation_end"], j["volume_scope"]) == ("IPDR_EVENT", "TARGET_SUBSCRIBER", "9876543212", t(2025, 2, 3, 1, 2, 3), t(2025, 2, 1, 11), "ALLOCATION")
    assert (h["record_type"], h["report_scope"], h["event_time"], h["allocation_start"], h["subscriber_identifier_type"]) == ("IP_ALLOCATION", "BROADBAND_IPV6_ALLOCATION", None, t(2025, 2, 1, 10), "USER_ID")
    assert (d["record_type"], d["report_scope"], d["event_time"], d["allocation_start"]) == ("IPDR_EVENT", "JIO_DYNAMIC_IPDR", t(2025, 2, 3, 4, 5, 6), None)


def test_footers_are_no_rejects(case):
    got = sorted((r["source_file"], r["source_row_number"], r["rejection_reason"]) for r in case.rejected.collect())
    assert got == [
        ("a.csv", 11, "NON_DATA_OR_INVALID_AIRTEL_IPDR_ROW"),
        ("jio.csv", 3, "NON_DATA_OR_INVALID_JIO_IPDR_TIMESTAMP"),
        ("jio_dynamic.csv", 3, "NON_DATA_OR_INVALID_JIO_IPDR_TIMESTAMP"),
        ("vi.csv", 6, "NON_DATA_OR_INVALID_VI_IPDR_TIMESTAMP"),
    ]


def test_every_file_has_a_row(case):
    rows = {r["source_path"].split("/case/")[1]: r for r in case.files.collect()}
    assert {k: (r["status"], r["records_loaded"], r["footer_rows"], r["rejected_rows"]) for k, r in rows.items()} == {
        "a.csv": ("LOADED", 2, 2, 1),
        "sub/a.csv": ("LOADED", 1, 2, 0),
        "copy.csv": ("DUPLICATE_SKIPPED", 0, 0, 0),
        "x_public_ip4_198_51_100_20_public_port_8080.csv": ("LOADED_EMPTY", 0, 1, 0),
        "vi.csv": ("LOADED", 1, 0, 1),
        "jio.csv": ("LOADED", 1, 0, 1),
        "jio_home.csv": ("LOADED", 1, 0, 0),
        "jio_dynamic.csv": ("LOADED", 1, 0, 1),
        "Cell_ID_IPDRNAT_1.csv": ("ROUTED", 0, 0, 0),
        "search.csv": ("LOADED", 1, 0, 0),
        "other.txt": ("UNSUPPORTED", 0, 0, 0),
    }
    empty = rows["x_public_ip4_198_51_100_20_public_port_8080.csv"]
    assert (empty["says_no_records"], empty["query_value"], empty["query_port"], empty["stated_scope"]) == (True, "198.51.100.20", 8080, "REVERSE_PUBLIC_IP_PORT")
    r = case.requests.first()
    assert (r["search_value"], r["from_datetime"], r["port"]) == ("203.0.113.77", dt.datetime(2025, 2, 1), 443)
