"""The plant database in its three forms, and what is refused."""

import json

import pytest
from pyspark.errors import PySparkException

from wattlake.sources import generation as G

ROW = {"gppd_idnr": "W1", "name": "North", "capacity_mw": "1,200.5", "primary_fuel": "Natural Gas (CCGT)", "other_fuel1": "Oil", "other_fuel2": "", "status": None, "latitude": 1.23456789, "longitude": "2", "generation_gwh_2018": 5, "generation_gwh_2020": "7.5", "generation_gwh_2019": "", "commissioning_year": 1999.0, "country": "AAA", "country_long": "Aland", "url": "https://x.example"}


def land(tmp_path, payload):
    p = tmp_path / "db.json"
    p.write_text(payload if isinstance(payload, str) else json.dumps(payload))
    return str(p)


def test_a_list_a_wrapped_list_and_features(spark, tmp_path):
    point = {"type": "Point", "coordinates": [3.1234567, 4]}
    feature = {"type": "Feature", "properties": {k: v for k, v in ROW.items() if k not in ("latitude", "longitude")}, "geometry": point}
    for payload, place in (([ROW], (2.0, 1.234568)), ({"data": [ROW]}, (2.0, 1.234568)), ({"features": [feature]}, (3.123457, 4.0)), ({"features": [feature | {"geometry": None}]}, (None, None))):
        r = G.database(spark, land(tmp_path, payload), 1).collect()
        assert len(r) == 1
        r = r[0]
        assert (r["id"], r["name"], r["capacity"]["central"], r["capacity_kind"], r["technology"], r["lifecycle"], r["commissioning_year"]) == ("wri-plant-W1", "North", 1200.5, "reported", "gas", "operational", 1999)
        assert (r["reported_generation_gwh"]["high"], r["generation_history_gwh"], r["other_fuels"], r["external_ids"], (r["lon"], r["lat"])) == (7.5, {2018: 5.0, 2020: 7.5}, ["Oil"], {"wri": "W1"}, place)
    bare = G.database(spark, land(tmp_path, [{"id": "x", "plant_name": "n"}]), 1).first()
    assert (bare["capacity"], bare["capacity_kind"], bare["technology"], bare["generation_history_gwh"], bare["reported_generation_gwh"], bare["lon"]) == (None, "unavailable", "other", {}, None, None)


@pytest.mark.parametrize("change", [{"gppd_idnr": " "}, {"name": None}, {"capacity_mw": -1}, {"capacity_mw": 100_001}, {"capacity_mw": "many"}, {"latitude": None}, {"latitude": 91}, {"status": "odd"}, {"generation_gwh_2018": -5}, {"generation_gwh_2018": "x"}, {"commissioning_year": "soon"}])
def test_broken_rows_raise(spark, tmp_path, change):
    with pytest.raises(PySparkException):
        G.database(spark, land(tmp_path, [ROW | change]), 0).collect()


@pytest.mark.parametrize("payload", ["{}", '{"data": 5}', '"text"', '{"features": [{"geometry": null}]}', '{"features": [{"properties": {"id": "a", "name": "b"}, "geometry": {"type": "LineString", "coordinates": [1, 2]}}]}', '{"features": [{"properties": {"id": "a", "name": "b"}, "geometry": {"type": "Point", "coordinates": [200, 2]}}]}'])
def test_other_payloads_raise(spark, tmp_path, payload):
    with pytest.raises(PySparkException):
        G.database(spark, land(tmp_path, payload), 0).collect()


def test_a_release_with_few_records_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="30000|30,000|wri"):
        G.database(spark, land(tmp_path, [ROW]))
