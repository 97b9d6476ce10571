"""Scans of the feeds' formats into DataFrames. Paths are any that Spark can read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlake.functions.scalars import NULL_WORDS, capacity_mw

def filled(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*NULL_WORDS), t)


def json_stat(spark: SparkSession, path: str, dimension: str) -> DataFrame:
    """code and value of a one-dimension JSON-stat file: positions without a value are null."""
    raw = spark.read.text(path, wholetext=True)
    index = F.from_json(F.get_json_object("value", f"$.dimension.{dimension}.category.index"), "map<string,int>")
    values = F.from_json(F.get_json_object("value", "$.value"), "map<string,double>")
    return raw.select(values.alias("v"), F.explode(index).alias("code", "at")).select("code", F.try_element_at("v", F.col("at").cast("string")).alias("value"))


def sparql_bindings(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """One row per binding of a saved SPARQL result, trimmed values or null, repeated rows once."""
    schema = "results struct<bindings:array<map<string,struct<type:string,value:string>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results.bindings").alias("b"))
    return rows.select(*[F.nullif(F.trim(F.try_element_at("b", F.lit(v))["value"]), F.lit("")).alias(v) for v in variables]).distinct()


def power_units(bindings: DataFrame) -> DataFrame:
    """Typed power features of bindings with element, name, output and geometry (WKT)."""
    numbers = lambda g: F.transform(F.regexp_extract_all(g, F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    n = numbers(F.col("geometry"))
    odd = F.filter(n, lambda x, i: i % 2 == 0)
    even = F.filter(n, lambda x, i: i % 2 == 1)
    middle = lambda a: F.bround((F.array_min(a) + F.array_max(a)) / 2, 6)
    return bindings.select(F.regexp_extract("element", r"/(node|way|relation)/(\d+)", 1).alias("kind"), F.regexp_extract("element", r"/(node|way|relation)/(\d+)", 2).alias("id"), "name", capacity_mw(F.col("output")).alias("capacity_mw"), middle(odd).alias("lon"), middle(even).alias("lat"))


def wide_generation(df: DataFrame, ident: str, prefix: str = "generation_gwh_") -> DataFrame:
    """Wide yearly columns to a map of years, and the latest year's value."""
    years = [c for c in df.columns if c.startswith(prefix)]
    if not years:
        return df.select(ident).withColumn("by_year", F.lit(None).cast("map<int,double>")).withColumn("latest", F.lit(None).cast("double"))
    long = df.unpivot([ident], years, "column", "value").where("value is not null").withColumn("year", F.regexp_extract("column", r"(\d{4})$", 1).cast("int"))
    agg = long.groupBy(ident).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", F.col("value").cast("double"))))).alias("by_year"), F.max_by("value", "year").cast("double").alias("latest"))
    return df.select(ident).distinct().join(agg, ident, "left")


def electricity_rows(spark: SparkSession, path: str) -> DataFrame:
    """Country-year rows of a long CSV (Area, ISO 3 code, Year, Category, Variable, Unit, Value): demand, generation, mix in GWh."""
    raw = spark.read.option("header", True).csv(path)
    gwh = F.when(F.lower("Unit") == "twh", F.col("Value").try_cast("double") * 1000).when(F.lower("Unit") == "gwh", F.col("Value").try_cast("double"))
    v = F.lower(F.trim("Variable"))
    kind = F.when((F.lower("Category") == "electricity demand") & (v == "demand"), "demand").when((F.lower("Category") == "electricity generation") & (v == "total generation"), "generation").when(F.lower("Category") == "electricity generation", "fuel")
    d = raw.select(F.col("`ISO 3 code`").alias("iso3"), F.col("Year").try_cast("int").alias("year"), kind.alias("kind"), v.alias("fuel"), gwh.alias("gwh")).where("kind is not null and iso3 is not null and length(iso3) = 3 and year is not null")
    agg = d.groupBy("iso3", "year").agg(
        F.max(F.when(F.col("kind") == "demand", F.col("gwh"))).alias("demand_gwh"), F.max(F.when(F.col("kind") == "generation", F.col("gwh"))).alias("generation_gwh"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("kind") == "fuel") & F.col("gwh").isNotNull(), F.struct("fuel", "gwh"))))).alias("mix"),
    )
    return agg
