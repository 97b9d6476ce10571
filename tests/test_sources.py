import json

import pytest

from wattlake.sources import readers, sinks


def test_json_stat_leaves_absent_positions_null(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"dimension": {"geo": {"category": {"index": {"A": 0, "B": 1}}}}, "value": {"0": 2.5}}))
    assert {r["code"]: r["value"] for r in readers.json_stat(spark, str(p), "geo").collect()} == {"A": 2.5, "B": None}


def test_bindings_and_power_units(spark, tmp_path):
    b = {"element": {"type": "uri", "value": "https://x/way/12"}, "output": {"type": "literal", "value": "1,250 MW"}, "geometry": {"type": "literal", "value": "LINESTRING(0 0, 2 4)"}}
    p = tmp_path / "b.json"
    p.write_text(json.dumps({"results": {"bindings": [b, b]}}))
    rows = readers.power_units(readers.sparql_bindings(spark, str(p), ["element", "name", "output", "geometry"])).collect()
    assert [(r["kind"], r["id"], r["capacity_mw"], r["lon"], r["lat"], r["name"]) for r in rows] == [("way", "12", 1250.0, 1.0, 2.0, None)]


def test_wide_generation_latest(spark):
    d = spark.createDataFrame([("a", 1.0, None), ("b", None, None), ("c", 1.0, 2.0)], "id string, generation_gwh_2019 double, generation_gwh_2020 double")
    assert {r["id"]: r["latest"] for r in readers.wide_generation(d, "id").collect()} == {"a": 1.0, "b": None, "c": 2.0}


def test_electricity_rows(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text("Area,ISO 3 code,Year,Category,Variable,Unit,Value\nX,XXX,2020,Electricity demand,Demand,TWh,1.5\nX,XXX,2020,Electricity generation,Solar,TWh,\nX,XXX,2020,Power sector emissions,Total,mt,9\nX,XXX,2020,Electricity generation,Coal,GWh,7\n")
    r = readers.electricity_rows(spark, str(p)).collect()
    assert [(x["iso3"], x["demand_gwh"], x["generation_gwh"], x["mix"]) for x in r] == [("XXX", 1500.0, None, {"coal": 7.0})]


def test_latest_valid_skips_tampered(spark):
    d = sinks.captures(spark.createDataFrame([("s", bytearray(b"a"), 1), ("s", bytearray(b"a"), 3), ("s", bytearray(b"b"), 2)], "source_id string, content binary, retrieved_at int"))
    assert d.count() == 2
    bad = d.withColumn("content", __import__("pyspark").sql.functions.when(d["retrieved_at"] == 3, __import__("pyspark").sql.functions.lit(bytearray(b"x"))).otherwise(d["content"]))
    assert [bytes(r["content"]) for r in sinks.latest_valid(bad).collect()] == [b"b"]


def test_publish_is_immutable_and_reads_back(spark, tmp_path):
    d = spark.createDataFrame([(1, "a")], "id int, v string")
    sinks.publish(spark, str(tmp_path), "one", {"t": d})
    with pytest.raises(FileExistsError):
        sinks.publish(spark, str(tmp_path), "one", {"t": d})
    with pytest.raises(ValueError):
        sinks.publish(spark, str(tmp_path), "../x", {"t": d})
    assert sinks.read_latest(spark, str(tmp_path), "t").collect() == d.collect()


def test_compact_expand_inverse(spark):
    d = spark.createDataFrame([("k", 1, "x"), ("k", 2, "x"), ("m", 1, "y")], "id string, n int, v string")
    defs, facts = sinks.compact(d, "id", ["v"])
    assert sorted(sinks.expand(defs, facts, "id").select("id", "n", "v").collect()) == sorted(d.collect())
    with pytest.raises(ValueError):
        sinks.compact(spark.createDataFrame([("k", 1, "x"), ("k", 2, "z")], "id string, n int, v string"), "id", ["v"])
