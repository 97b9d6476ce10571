"""Feeds, sinks and refresh control on small files."""

import io
import json
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wattlake import refresh
from wattlake.sources import feeds, sinks


def square(x, y, w=1):
    return [[[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]]


def collection(path, features):
    path.write_text(json.dumps({"features": [{"properties": p, "geometry": g} for p, g in features]}))
    return str(path)


def polygon(*a):
    return {"type": "Polygon", "coordinates": square(*a)}


def test_countries_merge_drop_disputed_and_need_codes(spark, tmp_path):
    many = {"type": "MultiPolygon", "coordinates": [square(2, 0), square(4, 0)]}
    rows = [({"iso2cd": "AA", "iso3cd": "AAA", "nam_en": "A"}, polygon(0, 0)), ({"iso2cd": "AA", "iso3cd": "AAA", "nam_en": "A"}, many), ({"iso2cd": "BB", "nam_en": "B", "stscod": "99"}, polygon(9, 9)), ({"iso2cd": None, "nam_en": None}, {"type": "LineString", "coordinates": [[0, 0], [1, 1]]})]
    p = collection(tmp_path / "c.json", rows)
    assert [(r["iso2"], len(r["polygons"])) for r in feeds.un_countries(spark, p, 1).collect()] == [("AA", 3)]
    with pytest.raises(ValueError, match="at least 190"):
        feeds.un_countries(spark, p)
    with pytest.raises(PySparkException, match="no country code"):
        feeds.un_countries(spark, collection(tmp_path / "d.json", [({"iso2cd": "-1", "nam_en": "Named"}, polygon(0, 0))]), 0).collect()


def test_regions_of_several_feeds(spark, tmp_path):
    n = collection(tmp_path / "n.json", [({"NUTS_ID": "AA1", "NUTS_NAME": "x", "CNTR_CODE": "AA", "LEVL_CODE": 1}, polygon(0, 0)), ({"NUTS_ID": "AA11", "NUTS_NAME": "y", "CNTR_CODE": "AA", "LEVL_CODE": 2}, polygon(0, 0))])
    assert [r["geography_id"] for r in feeds.nuts2(spark, n, 1).collect()] == ["AA11"]
    codes = spark.createDataFrame([("AAA", "AA")], "iso3 string, iso2 string")
    a = collection(tmp_path / "a.json", [({"shapeID": "s1", "shapeName": "Île-de-Été", "shapeGroup": "AAA"}, polygon(0, 0))])
    required = spark.createDataFrame([("AA", "Ile de Ete")], "country string, name string")
    assert [(r["geography_id"], r["country"]) for r in feeds.admin1(spark, a, codes, required).collect()] == [("AA-s1", "AA")]
    with pytest.raises(ValueError, match="required region"):
        feeds.admin1(spark, a, codes, spark.createDataFrame([("AA", "Other")], "country string, name string"))
    with pytest.raises(PySparkException, match="two-letter"):
        feeds.admin1(spark, a, codes.where("iso3 = 'x'")).collect()
    s = [collection(tmp_path / f"s{i}.json", [({"salbCode": f"c{i}", "name": "n", "iso2cd": "AA", "admLevel": i, "parentCode": "p"}, polygon(0, 0))]) for i in range(4)]
    assert sorted(r["geography_id"] for r in feeds.salb(spark, s).collect()) == ["c1", "c2"]


def test_pages_check_totals_progress_and_repeats():
    rows = [{"n": i} for i in range(7)]
    got = list(feeds.pages(lambda at: {"total": "7", "data": rows[at : at + 3]}, 3))
    assert got == rows
    for bad, text in ((lambda at: {"total": 7 + at, "data": rows[at : at + 3]}, "changed"), (lambda at: {"total": 9, "data": rows[:3]}, "repeats"), (lambda at: {"total": 7, "data": []}, "progress"), (lambda at: {"total": 2, "data": rows[:3]}, "rows of 2")):
        with pytest.raises(ValueError, match=text):
            list(feeds.pages(bad, 3))

    def failing(at):
        raise RuntimeError("GET /x?api_key=hush&y=1 with hush2")

    with pytest.raises(ValueError) as e:
        list(feeds.pages(failing, 3, secrets=("hush2",)))
    assert "hush" not in str(e.value)
    q = feeds.route_query("generation", offset=10)
    assert q["frequency"] == "annual" and q["facets[sectorid][]"] == "99" and q["offset"] == "10" and q["sort[0][direction]"] == "desc"
    assert feeds.route_query("capability", [" tx"])["facets[stateId][]"] == "TX" and feeds.route_query("sales", ["tx", "CA", "tx", " "])["facets[stateid][]"] == ["CA", "TX"]
    assert feeds.route_query("capability")["facets[fuelTypeId][]"] == feeds.route_query("capability")["facets[producerTypeId][]"] == "ALL"
    for route, text in (("hourly", "unknown"), ("interchange", "never")):
        with pytest.raises(ValueError, match=text):
            feeds.route_query(route)


def test_envelopes_are_annual_and_name_their_route():
    rows = [{"period": "2024", "_routeId": "sales"}]
    assert feeds.annual_rows({"response": {"frequency": "Annual", "data": rows}}) == rows
    assert feeds.annual_rows({"response": {"data": [{"preAggregatedAnnual": True}]}}, pre_aggregated=True)
    for bad in ({}, {"response": []}, {"response": {"data": {}}}, {"response": {"data": [1]}}, {"response": {"frequency": "hourly", "data": []}}, {"response": {"data": rows}}):
        with pytest.raises(ValueError):
            feeds.annual_rows(bad)
    assert feeds.route_of({"response": {"data": rows}}) == "sales" and feeds.route_of({}, "interchange") == "interchange"
    assert feeds.route_of({"request": {"command": "/v2/electricity/retail-sales/data/?x"}, "response": {"data": []}}) == "sales"
    for bad in ({"response": {"data": [{"_routeId": "sales"}, {"_routeId": "generation"}]}}, {}):
        with pytest.raises(ValueError):
            feeds.route_of(bad)


def test_landed_pages_and_indicator(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"response": {"total": 3, "data": [{"a": str(i)}, {"a": "x"}][: 2 - i]}}))
    assert feeds.paged_landing(spark, str(tmp_path / "p*.json")).count() == 3
    (tmp_path / "p1.json").write_text(json.dumps({"response": {"total": 4, "data": []}}))
    with pytest.raises(ValueError, match="pages give"):
        feeds.paged_landing(spark, str(tmp_path / "p*.json"))
    (tmp_path / "w.json").write_text(json.dumps([{"pages": 1}, [{"countryiso3code": "AAA", "date": "2020", "value": 1.5}, {"countryiso3code": "AAA", "date": "2021", "value": None}]]))
    assert [(r["year"], r["value"]) for r in feeds.indicator(spark, str(tmp_path / "w.json")).collect()] == [(2020, 1.5), (2021, None)]


def workbook(rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shared = sorted({c for r in rows for c in r if isinstance(c, str)})
    cell = lambda i, j, c: f'<c r="{chr(65 + j)}{i + 1}" t="s"><v>{shared.index(c)}</v></c>' if isinstance(c, str) else f'<c r="{chr(65 + j)}{i + 1}"><v>{c}</v></c>'
    sheet = "".join(f'<row r="{i + 1}">' + "".join(cell(i, j, c) for j, c in enumerate(r) if c is not None) + "</row>" for i, r in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="About" sheetId="1" r:id="r1"/><sheet name="Power units" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/a.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/b.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


HEADER = ["Plant ID", "Unit ID", "Project Name", "Unit Name", "Country", "Status", "Capacity (MW)", "Technology", "Latitude", "Longitude", "Start year"]


def test_workbooks_find_their_header_and_type_units(spark, tmp_path):
    rows = [["Notes"], [None, "x"], HEADER, ["P1", "U1", "One", None, "Aland", "operating", 1200, "Solar PV", 1.25, 2, "2019 (est.)"], ["P2", "U2", "Two", "B", "Aland", "Mothballed", "n/a", "unknown", None, None, None]]
    (tmp_path / "t.xlsx").write_bytes(workbook(rows))
    raw = feeds.workbooks(spark, str(tmp_path / "t.xlsx"), ("power",), ("Plant ID", "Unit ID"))
    got = {r["unit_id"]: r for r in feeds.tracker_records(raw).collect()}
    a, b = got["U1"], got["U2"]
    assert (a["capacity"]["central"], a["technology"], a["lifecycle"], a["commissioning_year"], a["lat"], a["name"]) == (1200.0, "solar", "operational", 2019, 1.25, "One")
    assert (b["capacity"], b["capacity_kind"], b["technology"], b["lifecycle"], b["raw_status"], b["lon"], b["name"]) == (None, "unavailable", "other", "paused", "Mothballed", None, "B")
    with pytest.raises(ValueError, match="no sheet"):
        list(feeds.sheet_rows(workbook([["a"]]), (), ("Plant ID",)))


def test_csv_and_workbook_share_their_headers(spark, tmp_path):
    (tmp_path / "t.csv").write_text('\ufeffGEM Location ID,Plant ID,GEM Unit/Phase ID,Project Name,Unit Name,Country/Area,Status,Capacity (MW),Technology,Latitude,Longitude,Start year\nL1,P1,U1,One,"A, ""B""",Aland,operating,"1,200",Solar PV,1.25,2,2019\n')
    got = feeds.tracker_records(feeds.csv_rows(spark, str(tmp_path / "t.csv"))).collect()
    assert [(r["plant_id"], r["unit_id"], r["capacity"]["central"], r["name"], r["lat"]) for r in got] == [("P1", "U1", 1200.0, 'A, "B"', 1.25)]
    (tmp_path / "bad.csv").write_text("Plant ID,Unit ID,Status,Latitude,Longitude\nP1,U1,operating,1,2\n,U2,operating,1,2\n")
    with pytest.raises(PySparkException):
        feeds.tracker_records(feeds.csv_rows(spark, str(tmp_path / "bad.csv"))).collect()


def test_a_long_sheet_is_never_held_whole(tmp_path):
    import tracemalloc

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    path, n = tmp_path / "long.xlsx", 200_000
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Power" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/a.xml"/></Relationships>')
        with z.open("xl/sharedStrings.xml", "w") as f:
            f.write(f"<sst {ns}><si><t>Plant ID</t></si><si><t>Unit ID</t></si>".encode())
            f.write(b"".join(b"<si><r><t>unit </t></r><r><t>%d</t></r><rPh><t>kana</t></rPh></si>" % i for i in range(n)))
            f.write(b"</sst>")
        with z.open("xl/worksheets/a.xml", "w") as f:
            f.write(f"<worksheet {ns}><sheetData><row><c t=\"s\"><v>0</v></c><c t=\"s\"><v>1</v></c></row>".encode())
            for i in range(n):
                f.write(b'<row r="%d"><c r="A%d" t="inlineStr"><is><t>p</t></is></c><c r="B%d" t="s"><v>%d</v></c></row>' % (i + 2, i + 2, i + 2, i + 2))
            f.write(b"</sheetData></worksheet>")
    with open(path, "rb") as f:
        tracemalloc.start()
        last, count = None, 0
        for last in feeds.sheet_rows(f, (), ("Plant ID", "Unit ID")):
            count += 1
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert count == n and last == {"Plant ID": "p", "Unit ID": f"unit {n - 1}"}
    assert peak < 30_000_000  # the sheet as a tree takes over 300 MB


@pytest.mark.parametrize("change", [{"Plant ID": ""}, {"Capacity (MW)": "-5"}, {"Capacity (MW)": "many"}, {"Latitude": None}, {"Latitude": "95"}, {"Status": "odd"}, {"Start year": "soon"}])
def test_tracker_rows_that_are_broken_raise(spark, change):
    row = dict(zip(HEADER, ["P1", "U1", "One", None, "Aland", "operating", "12", "wind", "1", "2", "2019"], strict=True)) | change
    with pytest.raises(PySparkException):
        feeds.tracker_records(spark.createDataFrame([(row,)], "row map<string,string>")).collect()


def test_lifecycle_branches_and_conflicting_bindings(spark):
    t = spark.createDataFrame([("a", "plant", None, None, None, None), ("b", "plant", None, None, "plant", None), ("c", "construction", "power", None, None, None), ("c", "plant", None, None, None, None), ("d", "proposed", None, "plant", None, None), ("e", "line", None, None, None, None)], "element string, power string, construction string, proposed string, construction_power string, proposed_power string")
    assert {(r["element"], r["lifecycle"]) for r in feeds.lifecycle_branches(t).collect()} == {("a", "operational"), ("b", "under_construction"), ("c", "under_construction"), ("d", "announced")}
    d = spark.createDataFrame([("x", "operational", 5.0), ("x", "announced", 6.0)], "id string, lifecycle string, capacity_mw double")
    with pytest.raises(ValueError, match="conflicting"):
        feeds.preferred_bindings(d)
    u = feeds.infrastructure_branches(spark.createDataFrame([("a", "dc", " "), ("a", "dc", " "), ("b", "w", "n")], "element string, k string, name string"), {"data_centre": F.col("k") == "dc", "water": F.col("k") == "w"}, ["name"])
    assert {(r["element"], r["category"], r["name"]) for r in u.collect()} == {("a", "data_centre", None), ("b", "water", "n")}


def test_state_series(spark):
    rows = lambda *r: spark.createDataFrame([("S", 2020, "99", f, d, v, "thousand megawatthours") for f, d, v in r], "state string, year int, sector string, fuel string, description string, value string, unit string")
    leaves = {"BIT": 25, "SUB": 15, "NG": 20, "DFO": 10, "SUN": 10, "WND": 10, "HYC": 5, "WDL": 3, "WDS": 2}
    sums = {"FOS": 70, "COW": 40, "GAS": 20, "PET": 10, "PEL": 10, "REN": 30, "BIO": 5}
    d = rows(("ALL", None, "100"), ("AOR", "All Renewables", "30"), *[(k, None, str(v)) for k, v in (leaves | sums).items()])
    r = feeds.state_generation(d).collect()
    assert r[0]["generation_gwh"] == 100 and r[0]["mix"] == {"biomass": 5, "coal": 40, "gas": 20, "hydro": 5, "oil": 10, "solar": 10, "wind": 10}
    assert feeds.state_generation(rows(("ALL", None, "5"), ("HPS", None, "-2"), ("XYZ", None, "6"))).collect()[0]["mix"] == {"hydro": -2, "other": 6}
    for bad in (rows(("NG", None, "1"), ("NG", None, "2")), rows(("NG", None, "-1")), rows(("ALL", None, "1"), ("NG", None, "2")), rows(("ALL", None, "x"))):
        with pytest.raises(PySparkException):
            feeds.state_generation(bad).collect()
    cap = spark.createDataFrame([("S", 2020, "1", "NG", "5", "MW"), ("S", 2020, "2", "NG", "7", "MW"), ("S", 2020, "00", "NG", "12", "MW"), ("S", 2021, "1", "NG", "5", "MW"), ("S", 2021, "00", "ALL", "9", "MW")], "state string, year int, producer string, fuel string, value string, unit string")
    assert {r["year"]: r["dependable_mw"] for r in feeds.state_capability(cap).collect()} == {2020: 12.0, 2021: 9.0}
    sales = spark.createDataFrame([("S", 2020, "ALL", "8", "million kilowatt hours"), ("S", 2020, "RES", "3", "million kilowatt hours")], "state string, year int, sector string, value string, unit string")
    net = spark.createDataFrame([("BA", "TI", 2020, "2000", "megawatthours"), ("BA", "D", 2020, "1", "megawatthours"), ("ZZ", "TI", 2020, "1", "megawatthours")], "respondent string, kind string, year int, value string, unit string")
    states, authorities = spark.createDataFrame([("S", "US-S")], "state string, geography_id string"), spark.createDataFrame([("BA", "US-S")], "respondent string, geography_id string")
    got = {r["year"]: r for r in feeds.state_years(sales, d, cap, net, states, authorities).collect()}
    assert (got[2020]["demand_gwh"], got[2020]["generation_gwh"], got[2020]["dependable_mw"], got[2020]["net_interchange_gwh"]) == (8.0, 100.0, 12.0, 2.0) and got[2021]["dependable_mw"] == 9.0
    with pytest.raises(PySparkException, match="unmapped state"):
        feeds.state_years(sales, d, cap, net, states.limit(0), authorities).collect()


def test_mappings_registry_controls_and_pins(spark, tmp_path):
    active = spark.createDataFrame([("g1",), ("g2",)], "geography_id string")
    m = lambda *r: spark.createDataFrame(list(r), "code string, geography_id string")
    assert feeds.region_mapping(m((" a ", "g1"), ("a", "g1")), active).count() == 1
    for bad, text in ((m(("a", "g1"), ("a", "g2")), "conflicting"), (m(("", "g1")), "blank"), (m(("a", "gone")), "inactive")):
        with pytest.raises(ValueError, match=text):
            feeds.region_mapping(bad, active)
    with pytest.raises(ValueError, match="unmapped"):
        feeds.region_mapping(m(("a", "g1")), active, spark.createDataFrame([("b",)], "code string"))
    sources = spark.createDataFrame([("s", "official_verified", "CC0-1.0")], "source_id string, source_type string, licence string")
    a = lambda *r: spark.createDataFrame(list(r), "id string, source_ids array<string>, lon double, lat double")
    r = feeds.asset_registry(a(("x", ["s"], 1.0, 2.0)), sources).collect()[0]
    assert (r["source_type"], r["licence"]) == ("official_verified", "CC0-1.0")
    for bad in (a(("x", ["s"], 1.0, 2.0), ("x", ["s"], 1.0, 2.0)), a(("x", ["t"], 1.0, 2.0))):
        with pytest.raises(ValueError):
            feeds.asset_registry(bad, sources)
    with pytest.raises(ValueError, match="duplicate control"):
        feeds.country_controls(spark.createDataFrame([("A", 2020, 1.0), ("A", 2020, 2.0)], "country string, year int, v double"))
    assert feeds.local_release(spark, str(tmp_path / "none.json"), "id string") is None
    (tmp_path / "r.json").write_text('{"records": [{"id": "a"}]}')
    (tmp_path / "bad.json").write_text('{"rows": []}')
    assert feeds.local_release(spark, str(tmp_path / "r.json"), "id string").collect()[0]["id"] == "a"
    with pytest.raises(ValueError):
        feeds.local_release(spark, str(tmp_path / "bad.json"), "id string")
    files = spark.createDataFrame([("x/f.tif", bytearray(b"a"))], "path string, content binary")
    pin = "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"
    assert feeds.pinned(files, spark.createDataFrame([("f.tif", pin)], "name string, sha256 string")).count() == 1
    with pytest.raises(PySparkException, match="checksum differs"):
        feeds.pinned(files, spark.createDataFrame([("f.tif", "0")], "name string, sha256 string")).collect()


def test_official_observations_of_one_rank_must_agree(spark):
    d = spark.createDataFrame([("g", 2020, "s", "1", "official_verified", 1.0), ("g", 2020, "t", "2", "official_verified", 2.0)], "geography_id string, year int, source_id string, source_record_id string, source_type string, demand double")
    with pytest.raises(PySparkException, match="conflict"):
        feeds.best_observations(d, ["demand"]).collect()


def test_shards_snapshots_and_rebuild(spark, tmp_path):
    plants = spark.createDataFrame([(str(i), "AA" if i % 3 else "BB", 179.0 if i % 2 else -179.0, float(i), None if i == 1 else 2.0) for i in range(9)], "id string, country string, lon double, lat double, capacity_mw double")
    index = sinks.country_shards(plants, str(tmp_path / "shards"), rows_per_file=2)
    got = {r["country"]: r for r in index.collect()}
    assert got["AA"]["features"] == 6 and (got["AA"]["west"], got["AA"]["east"], abs(got["AA"]["centre_lon"])) == (179.0, -179.0, 180.0)
    assert sinks.lazy_layer(spark, str(tmp_path / "shards"), index, "AA").count() == 6
    for broken in (F.col("features") + 1, F.col("bytes") + 1, F.concat("checksum", F.lit("0"))):
        name = next(c for c in ("features", "bytes", "checksum") if c in str(broken))
        with pytest.raises(ValueError, match="does not match"):
            sinks.lazy_layer(spark, str(tmp_path / "shards"), index.withColumn(name, broken), "AA")
    with pytest.raises(ValueError, match="bytes of 10"):
        sinks.lazy_layer(spark, str(tmp_path / "shards"), index, "AA", most_bytes=10)
    with pytest.raises(ValueError, match="no shard"):
        sinks.lazy_layer(spark, str(tmp_path / "shards"), index, "ZZ")
    root = str(tmp_path / "snap")
    sinks.publish(spark, root, "one", {"plants": plants})
    refresh.rebuild(spark, root, "two", ["plants"], lambda t: {"count": t["plants"].groupBy("country").count()})
    assert sinks.latest(spark, root) == "two" and sinks.read_latest(spark, root, "count", verify=True).count() == 2
    plants.limit(3).write.mode("overwrite").parquet(f"{root}/snapshots/two/plants")
    with pytest.raises(ValueError, match="tampered"):
        sinks.read_latest(spark, root, "plants", verify=True)
    with pytest.raises(ValueError):
        sinks.read_latest(spark, root, "../one")


def test_stores_and_artifacts(spark, tmp_path):
    empty = spark.createDataFrame([], "key string, payload string")
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, n int")
    store = sinks.upsert_rows(sinks.upsert_rows(empty, a, "id"), spark.createDataFrame([("y", 3), ("w", 4)], "id string, n int"), "id")
    assert [(r["id"], r["n"]) for r in sinks.load_rows(store, "id string, n int").collect()] == [("w", 4), ("x", 1), ("y", 3)]
    c = lambda *r: spark.createDataFrame(list(r), "source_id string, content binary, retrieved_at int")
    up = sinks.upsert(c(("s", bytearray(b"a"), 1)), c(("s", bytearray(b"a"), 5), ("s", bytearray(b"b"), 2))).collect()
    assert {(bytes(r["content"]), r["retrieved_at"]) for r in up} == {(b"a", 5), (b"b", 2)}
    none = spark.createDataFrame([], "id string, rule string")
    sinks.write_artifact(a, str(tmp_path / "art"), none, {"k": "v"})
    assert spark.read.parquet(str(tmp_path / "art/records")).count() == 2
    with pytest.raises(ValueError, match="broken"):
        sinks.write_artifact(a, str(tmp_path / "art2"), spark.createDataFrame([("x", "r")], "id string, rule string"), {})
    p = spark.createDataFrame([("g",)], "geography_id string")
    sinks.model_artifacts(p, p, {"population": "a" * 64, "weights_population": "a" * 64})
    for weights, prints in ((p, {"population": "x"}), (p, {"population": "a" * 64, "weights_population": "b" * 64}), (p.select(F.lit("h").alias("geography_id")), {})):
        with pytest.raises(ValueError):
            sinks.model_artifacts(p, weights, prints)


def test_refresh_control(spark):
    done = []
    stages = {s: (lambda s=s: done.append(s)) for s in refresh.STEPS}
    refresh.run_stages(stages)
    assert tuple(done) == refresh.STEPS
    for bad in ({k: v for k, v in stages.items() if k != "scores"}, stages | {"more": print}):
        with pytest.raises(ValueError):
            refresh.run_stages(bad)
    assert len(done) == len(refresh.STEPS)
    catalog = sinks.captures(spark.createDataFrame([("s", bytearray(b"old"), 1)], "source_id string, content binary, retrieved_at int"))

    def fails():
        raise RuntimeError("key=1 token=abc")

    assert refresh.serve("s", lambda: b"new", catalog) == (b"new", refresh.Status("s", "current"))
    body, status = refresh.serve("s", fails, catalog)
    assert body == b"old" and status.state == "cached" and "abc" not in status.message
    assert refresh.serve("other", fails, catalog, required=False)[1].state == "not_configured"
    with pytest.raises(RuntimeError):
        refresh.serve("other", fails, catalog)
    assert refresh.statuses(spark, [status]).count() == 1
    assert refresh.gate({"a": 5, "b": 0}, {"a": 5}, {"x": True}, ("b",)) == []
    assert len(refresh.gate({"a": 4, "b": 0}, {"a": 5}, {"x": False})) == 3
    r = "struct<low:double,central:double,high:double>"
    one = spark.createDataFrame([("solar", (0.1, 0.2, 0.3), (0.0, 0.1, 0.2))], f"technology string, capacity_factor {r}, capacity_credit {r}")
    assert refresh.known_assumptions(one, ("solar",)) is one
    for tech, d in ((("solar", "gas"), one), (("gas",), one)):
        with pytest.raises(ValueError):
            refresh.known_assumptions(d, tech)
