"""Rules of a publication, aliases of assets, the entry for spark-submit."""

import pytest
from pyspark.sql import functions as F

from wattlake.operators import assets as A
from wattlake.operators import snapshot as W

PLANT = "plant_id string, country string, geography_id string, lon double, lat double, capacity_mw double, operating_mw double, planned_mw double, mix map<string,double>, source_ids array<string>"
OVER = "geography_id string, country string, lon double, lat double, capacity_mw double, operating_mw double, planned_mw double, mix map<string,double>, dominant string"


@pytest.fixture(scope="module")
def valid(spark):
    plants = [("p1", "AA", "A1", 179.5, 1.0, 10.0, 6.0, 4.0, {"wind": 10.0}, ["s1"]), ("p2", "AA", "A1", -179.5, 3.0, 5.0, 5.0, 0.0, {"gas": 2.0, "wind": 3.0}, ["s1", "s2"]), ("p3", "BB", "B1", 5.0, 5.0, 1.0, 0.0, 1.0, {"solar": 1.0}, ["s2"])]
    over = [("A1", "AA", 180.0, 2.0, 15.0, 11.0, 4.0, {"gas": 2.0, "wind": 13.0}, "wind"), ("B1", "BB", 5.0, 5.0, 1.0, 0.0, 1.0, {"solar": 1.0}, "solar")]
    make = spark.createDataFrame
    shards = make([("AA", 10, "x"), ("BB", 20, "y")], "country string, bytes long, checksum string")
    return {"plants": make(plants, PLANT), "index": shards, "sums": shards, "overview": make(over, OVER), "regions": make([("A1", "AA", ["s1"]), ("B1", "BB", ["s1"]), ("C1", "CC", ["s2"])], "geography_id string, country string, source_ids array<string>"), "sources": make([("s1",), ("s2",)], "source_id string"), "evidence": make([("e1", "s1", "p1"), ("e2", "s2", "C1")], "evidence_id string, source_id string, subject_id string")}


def rules(found):
    return {tuple(r) for r in W.publication_violations(**found).collect()}


def test_a_valid_publication_has_no_violation(valid):
    assert rules(valid) == set()


def changed(df, key, ident, **columns):
    return df.withColumns({c: F.when(F.col(key) == ident, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in columns.items()})


@pytest.mark.parametrize(
    ("table", "key", "ident", "columns", "want"),
    [
        ("plants", "plant_id", "p3", {"geography_id": F.lit}, {("plants", "p3", "region_known"), ("overview", "ZZ", "regions_of_shards"), ("overview", "B1", "regions_of_shards")}),
        ("index", "country", "AA", {"checksum": F.lit}, {("shards", "AA", "checksum")}),
        ("overview", "geography_id", "A1", {"dominant": F.lit}, {("overview", "A1", "dominant")}),
    ],
)
def test_texts_that_differ(valid, table, key, ident, columns, want):
    assert rules(valid | {table: changed(valid[table], key, ident, **{c: f("ZZ") for c, f in columns.items()})}) == want


@pytest.mark.parametrize(
    ("table", "ident", "column", "value", "want"),
    [
        ("plants", "p1", "operating_mw", 7.0, {("plants", "p1", "capacity_by_lifecycle"), ("overview", "A1", "rolled_operating_mw")}),
        ("plants", "p1", "lat", 91.0, {("plants", "p1", "point"), ("overview", "A1", "centroid")}),
        ("overview", "A1", "capacity_mw", 15.5, {("overview", "A1", "rolled_capacity_mw")}),
        ("overview", "A1", "lon", 0.0, {("overview", "A1", "centroid")}),
        ("overview", "A1", "lat", 4.0, {("overview", "A1", "centroid")}),
    ],
)
def test_numbers_that_differ(valid, table, ident, column, value, want):
    key = "plant_id" if table == "plants" else "geography_id"
    assert rules(valid | {table: changed(valid[table], key, ident, **{column: F.lit(value)})}) == want


def test_mixes_sources_and_evidence(valid):
    spark = valid["plants"].sparkSession
    less = F.create_map(F.lit("gas"), F.lit(2.0), F.lit("wind"), F.lit(12.0))
    assert rules(valid | {"overview": changed(valid["overview"], "geography_id", "A1", mix=less)}) == {("overview", "A1", "rolled_mix")}
    assert rules(valid | {"plants": changed(valid["plants"], "plant_id", "p3", mix=F.create_map(F.lit("solar"), F.lit(2.0)))}) == {("plants", "p3", "capacity_by_technology"), ("overview", "B1", "rolled_mix")}
    assert rules(valid | {"sources": valid["sources"].where("source_id = 's1'")}) == {("plants", "p2", "source_known"), ("plants", "p3", "source_known"), ("regions", "C1", "source_known"), ("evidence", "e2", "source_known")}
    lost = spark.createDataFrame([("e3", "s1", "nowhere")], valid["evidence"].schema)
    assert rules(valid | {"evidence": valid["evidence"].union(lost)}) == {("evidence", "e3", "subject_known")}
    assert rules(valid | {"sums": valid["sums"].where("country = 'AA'")}) == {("shards", "BB", "bytes"), ("shards", "BB", "checksum")}
    home = valid["regions"].withColumn("country", F.when(F.col("geography_id") == "B1", "AA").otherwise(F.col("country")))
    assert rules(valid | {"regions": home}) == {("plants", "p3", "region_in_country")}
    assert rules(valid | {"regions": valid["regions"].withColumn("source_ids", F.when(F.col("geography_id") == "C1", F.expr("array()")).otherwise(F.col("source_ids")))}) == {("regions", "C1", "has_source")}


def test_aliases_of_operators_and_names_link_assets(spark):
    schema = "id string, name string, operator string, country string, category string, target_year int, mw double, lon double, lat double, external_ids map<string,string>"
    row = lambda i, name, operator: (i, name, operator, "X", "data_centre", 2027, 100.0, 1.0, 1.0, {})
    d = spark.createDataFrame([row("a", "North DC", "Acme Intl"), row("b", "north data centre", "ACME International"), row("c", "North DC", "Other")], schema)
    edges = lambda **k: {tuple(r) for r in A.asset_edges(d, **k).collect()}
    assert edges() == set() and edges(aliases={"DC": "data centre", "Intl": "international"}) == {("b", "a")}


def test_entry_for_spark_submit(spark, tmp_path, capsys):
    from wattlake.main import main

    assert main(["--tables", "/root/testdata/sf0.001", "--out", str(tmp_path), "no_such_query"]) == 2
    assert main(["--tables", "/root/testdata/sf0.001", "--out", str(tmp_path), "country_keys"]) == 0
    assert spark.read.parquet(str(tmp_path / "country_keys")).count() > 0
    assert main(["--tables", str(tmp_path / "nowhere"), "--out", str(tmp_path), "country_keys"]) == 1
    assert "no_such_query" in capsys.readouterr().err
