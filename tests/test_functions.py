import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellspan import schema
from cellspan.functions import identifiers as I

CASES = [
    (I.digits, {"98765.0": "98765", " +91-98 76": "919876", None: "", "abc": ""}),
    (I.msisdn, {"919876543210": "9876543210", "09876543210": "9876543210", "9876543210.0": "9876543210", "5876543210": None, "98765": None, None: None}),
    (I.party_key, {"919876543210": "9876543210", "52263": "52263", "AB-BANK-S": ""}),
    (I.loose_number, {"00919876543210": "9876543210", "98765": None}),
    (I.imei, {"350000000000008": "350000000000008", "35": "", "3500000000000081": "3500000000000081", None: ""}),
    (I.loose_imei, {"3500000000000081": "350000000000008", "35000000000000": "35000000000000", "1": None}),
    (I.device_key, {"350000000000008": "35000000000000", "12": "12", "x": "x"}),
    (I.device_family, {"35000000000000": "35000000000000", "12": ""}),
    (I.imei_status, {"490154203237518": "VALID_IMEI", "490154203237519": "INVALID_IMEI", "4901542032375181": "IMEISV", "1": "NON_STANDARD"}),
    (I.contact_category, {"AB-BANKXX-S": "service_sender_id", "52263": "short_code", "9876543210": "human_mobile", "MyBank": "service_sender_id", "": "unknown_contact", None: "unknown_contact", "'98-765 43210'": "human_mobile", "1234567890123456": "unknown_contact"}),
    (I.call_meaning, {"SMSIN": "Incoming SMS", "": "Missing / Blank Call Type", "dsm": "Other / Unclassified Operator Event"}),
    (I.valid_cell, {"405-51-834-15492631": True, "405-51--": False, "405-51-": False, "12345": False, None: False, "4058560CCE04012": True}),
    (I.plmn_only, {"405-51": True, "40551834": False}),
    (I.cell_key, {" 405-51-a ": "40551A"}),
    (I.cgi_key, {"405 -51--8": "405-51-8"}),
    (I.duration_seconds, {"01:02:03": 3723.0, "2:05": 125.0, "17": 17.0, "x": 0.0, None: 0.0}),
    (I.session_identifier, {"9876543210": "MSISDN", "40123456789012": "NON_STANDARD_SUBSCRIBER_ID", "x": "INVALID_OR_UNVERIFIED"}),
    (I.canonical_ip, {"2001:0DB8:0::1": "2001:db8::1", "10.0.0.1": "10.0.0.1", "x": "", None: "", "10.0.0.1/24": "10.0.0.1/24"}),
    (I.formula_safe, {"=1+1": "'=1+1", " -x": "' -x", "ok": "ok"}),
    (I.event_time, {"11/06/2026 10:00:00": dt.datetime(2026, 6, 11, 10), "2026/06/11 10:00:00": dt.datetime(2026, 6, 11, 10), "12-Jun-2026 01:02:03": dt.datetime(2026, 6, 12, 1, 2, 3), "x": None}),
    (lambda c: I.canonical_call_type(c), {"MOC": "outgoing", "Call-In": "incoming", "SMS-MT": "smsin", "P2P_SMS_MO": "smsout", "dsm": "dsm", "A_IN": "incoming"}),
]


@pytest.mark.parametrize("f,cases", CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_expression(spark, f, cases):
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["o"] for r in df.select("v", f("v").alias("o")).collect()}
    assert got == cases


def test_pairs(spark):
    df = spark.createDataFrame([("350000000000008", "350000000000008"), ("35000000000000", "350000000000007"), ("350000000000008", "3500000000000061"), ("350000000000008", ""), ("1", "2")], "q string, o string")
    assert [r[0] for r in df.select(I.match_relation("q", "o")).collect()] == ["EXACT", "BASE14_MATCH", "SAME_BASE14", "REPORT_SCOPE", "UNAVAILABLE"]
    cells = spark.createDataFrame([("405-51-834-1", "405518341"), ("405-51-834-1", "405-51-00834-1"), ("405-51-1-2", "405-51-1-3")], "a string, b string")
    assert [r[0] for r in cells.select(I.cells_match("a", "b")).collect()] == [True, True, False]
    ends = spark.createDataFrame([("2001:db8::1", 443), ("1.2.3.4", 80), ("1.2.3.4", None), ("", 5)], "ip string, p long")
    assert [r[0] for r in ends.select(I.endpoint("ip", "p")).collect()] == ["[2001:db8::1]:443", "1.2.3.4:80", "1.2.3.4", ""]
    geo = spark.createDataFrame([("19.07, 72.87",), ("172.5 19.0",), ("x",)], "t string")
    assert [tuple(r[0]) if r[0] else None for r in geo.select(I.lat_lon("t")).collect()] == [(19.07, 72.87), (19.0, 172.5), None]


def test_schema_helpers(spark):
    df = spark.createDataFrame([("7", "x")], "source_row string, extra string")
    got = schema.conform(df, schema.CALLS)
    assert got.schema == schema.CALLS and got.first()["source_row"] == 7
    assert schema.dedupe_names(["a", "b", "a"]) == ["a", "b", "a.1"]
    two = spark.createDataFrame([("", "v"), ("u", "w")], ["A Party", "Calling No"])
    assert [r[0] for r in schema.rename_aliases(two, {"calling_no": "a_party"}).collect()] == ["v", "u"]
    assert schema.rename_aliases(two.select(F.col("A Party")), {}).columns == ["a_party"]


def test_a_text_is_tried_only_under_layouts_of_its_shape(spark):
    """The gates leave every result as it is without them, and a text of no layout's shape is not tried at all."""
    import re

    samples = {"yyyy": "2024", "MMM": "jan", "MM": "11", "dd": "25", "HH": "23", "mm": "59", "ss": "07", "'T'": "T"}
    texts = [re.sub("yyyy|MMM|MM|dd|HH|mm|ss|'T'", lambda m: samples[m[0]], f) for f in I.TIME_FORMATS]
    texts += [t.replace("25", "5") for t in texts] + [t.replace("11", "31") for t in texts] + ["", " ", "45000", "x", "'25/11/2024'", "2024-11-25 23:59:07.5", "+12024-11-25", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for formats in (I.TIME_FORMATS, I.MONTH_FIRST):
        plain = F.coalesce(*[F.try_to_timestamp(F.btrim(I.text("t"), F.lit("'\"")), F.lit(f)) for f in formats]).cast("timestamp_ntz")
        rows = df.select("t", I.event_time("t", formats).cast("string").alias("a"), plain.cast("string").alias("b")).collect()
        assert [tuple(r) for r in rows if r["a"] != r["b"] and r["t"] != "45000"] == []
        assert sum(r["a"] is not None for r in rows) >= 8
    assert not any(re.match(I.layout_shape(f), t) for f in (*I.TIME_FORMATS, *I.MONTH_FIRST) for t in ("", "9876543210", "405-51-834-0001"))
