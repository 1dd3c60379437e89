import datetime

from cellspan.operators import presence
from cellspan.plans import catalog, catalog_records


def test_other_identifiers_are_all_there(spark, monkeypatch):
    numbers = [(f"9{i:09d}", 2) for i in range(10_001)]
    rows = [r for r in [*numbers, ("sim-1", 1), ("sim-2", 2)] for _ in range(r[1])]
    cols = "subscriber_number string, n int, operator string, searched_cell_id string, imei string, imsi string, session_start timestamp, total_volume double"
    at = datetime.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([(*r, "o", "c", "m", "s", at, 0.0) for r in rows], cols)
    monkeypatch.setattr(catalog_records, "S", lambda spark, sf_dir: df)
    got = catalog.QUERIES["presence_other_identifiers"](spark, "")
    assert sorted(tuple(r) for r in got.select("subscriber_number", "lead_list").collect()) == [("sim-1", "priority_leads"), ("sim-2", "common_numbers")]
    kept, _ = presence.separate_identifiers(catalog_records.session_leads(spark, ""))
    assert {n: v.count() for n, v in kept.items()} == {"common_numbers": 200, "priority_leads": 200}
