"""Feeds beyond plain files: paged responses, registries, spreadsheets, boundaries, observations, state series."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattlake.functions import scalars as S
from wattlake.functions import vocabulary as V
from wattlake.operators.relational import de_overlap, money

RINGS = "array<array<array<double>>>"


def floor(df: DataFrame, least: int, label: str) -> DataFrame:
    """``df`` if it has ``least`` rows; else an error. A feed that has shrunk is broken."""
    n = df.count()
    if n < least:
        raise ValueError(f"{label}: {n} rows, at least {least} expected")
    return df


# --- boundaries -------------------------------------------------------------------


def features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Properties, kind and polygons of a FeatureCollection; other geometries have null polygons."""
    schema = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    polygons = F.when(F.col("kind") == "Polygon", F.array(F.from_json("c", RINGS))).when(F.col("kind") == "MultiPolygon", F.from_json("c", f"array<{RINGS}>"))
    return f.withColumn("polygons", polygons).drop("c")


def un_countries(spark: SparkSession, path: str, least: int = 190) -> DataFrame:
    """iso2, iso3, name, polygons: features of one code merge; status 99 goes; a named polygon without a code raises."""
    f = features(spark, path, "iso2cd:string,iso3cd:string,nam_en:string,stscod:string").where("polygons is not null and coalesce(stscod, '') <> '99'")
    code = F.when(F.col("iso2cd").rlike("^[A-Z]{2}$"), F.col("iso2cd")).when(F.trim(F.coalesce("nam_en", F.lit(""))) != "", F.raise_error(F.concat(F.lit("no country code: "), F.col("nam_en"))).cast("string"))
    d = f.withColumn("iso2", code).where("iso2 is not null")
    return floor(d.groupBy("iso2").agg(F.min("iso3cd").alias("iso3"), F.min("nam_en").alias("name"), F.flatten(F.collect_list("polygons")).alias("polygons")), least, "countries")


def nuts2(spark: SparkSession, path: str, least: int = 250) -> DataFrame:
    f = features(spark, path, "NUTS_ID:string,NUTS_NAME:string,CNTR_CODE:string,LEVL_CODE:int").where("LEVL_CODE = 2 and polygons is not null")
    return floor(f.select(F.col("NUTS_ID").alias("geography_id"), F.col("NUTS_NAME").alias("name"), F.col("CNTR_CODE").alias("country"), "polygons"), least, "regions of level 2")


def accents_folded(c: Column) -> Column:
    """Lower-case key without accents, for the Latin letters."""
    # Accented letters and what they fold to.
    accented, plain = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćčďđēĕėęěğģīįıķĺļľłńņňōŏőŕřśşšťţūŭůűųźżžșț", "aaaaaaceeeeiiiinoooooouuuuyyaaaccddeeeeeggiiikllllnnnooorrsssttuuuuuzzzst"
    return S.key_normalize(F.translate(F.lower(c), accented, plain))


def admin1(spark: SparkSession, path: str, codes: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """First-level regions: geography_id (``CC-shapeID``), country, name, polygons; an unknown country or a missing required region raises.

    ``codes`` has iso3 and iso2; ``required`` country and name.
    """
    f = features(spark, path, "shapeID:string,shapeName:string,shapeGroup:string").where("polygons is not null")
    d = f.join(codes.select(F.col("iso3").alias("shapeGroup"), "iso2"), "shapeGroup", "left")
    country = F.coalesce("iso2", F.raise_error(F.concat(F.lit("no two-letter code for "), F.col("shapeGroup"))).cast("string"))
    out = d.select(F.concat_ws("-", country, "shapeID").alias("geography_id"), F.col("iso2").alias("country"), F.col("shapeName").alias("name"), accents_folded(F.col("shapeName")).alias("name_key"), F.lit(1).alias("level"), "polygons")
    if required is not None:
        gone = required.select("country", accents_folded(F.col("name")).alias("name_key")).join(out, ["country", "name_key"], "left_anti").first()
        if gone is not None:
            raise ValueError(f"required region missing: {gone['country']} {gone['name_key']}")
    return out


def salb(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Administrative units of levels 1 and 2 of several files."""
    f = features(spark, paths, "salbCode:string,name:string,iso2cd:string,admLevel:int,parentCode:string")
    return f.where("admLevel in (1, 2) and polygons is not null").select(F.col("salbCode").alias("geography_id"), "name", F.col("iso2cd").alias("country"), F.col("admLevel").alias("level"), F.col("parentCode").alias("parent_id"), "polygons")


# --- paged responses -----------------------------------------------------------------


def redact(text: str, secrets: tuple[str, ...] = ()) -> str:
    """A text without the secrets and without the values of key parameters."""
    for s in secrets:
        if s:
            text = text.replace(s, "***")
    return re.sub(r"(?i)(api[_-]?key|token|secret)=[^&\s\"']+", r"\1=***", text)


# The state series' routes, and what each is asked for.
ROUTES = {
    "sales": "electricity/retail-sales/data/",
    "generation": "electricity/electric-power-operational-data/data/",
    "capability": "electricity/state-electricity-profiles/capability/data/",
    "interchange": "electricity/rto/region-data/data/",
}
ROUTE_FACETS = {
    "sales": {"facets[sectorid][]": "ALL"},
    "generation": {"facets[sectorid][]": "99"},
    "capability": {"facets[producerTypeId][]": "ALL", "facets[fuelTypeId][]": "ALL"},
}
STATE_FACETS = {"sales": "facets[stateid][]", "generation": "facets[location][]", "capability": "facets[stateId][]"}


def route_query(route: str, states: Sequence[str] = (), length: int = 5000, offset: int = 0) -> dict[str, str | list[str]]:
    """Parameters of one page of an annual state series, the newest year first, of all or of some states.

    An unknown route raises, and so does interchange, which is never fetched by region: only its annual sums are read.
    """
    if route not in ROUTE_FACETS:
        raise ValueError(f"route {route} is never fetched" if route in ROUTES else f"unknown route {route}")
    wanted = sorted({s.strip().upper() for s in states if s.strip()})
    of = {STATE_FACETS[route]: wanted[0] if len(wanted) == 1 else wanted} if wanted else {}
    return {"frequency": "annual", "data[0]": route, "sort[0][column]": "period", "sort[0][direction]": "desc", "offset": str(offset), "length": str(length), **ROUTE_FACETS[route], **of}


def annual_rows(envelope: dict, pre_aggregated: bool = False) -> list[dict]:
    """Records of a saved response: ``response.data`` is a list of records and its frequency is annual, or an error.

    With ``pre_aggregated`` records that all say so need no frequency.
    """
    response = envelope.get("response")
    rows = response.get("data") if isinstance(response, dict) else None
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise ValueError("unexpected response: response.data must be a list of records")
    told = str(response.get("frequency") or "").lower()
    if told not in ("annual", "yearly") and not (pre_aggregated and rows and all(r.get("preAggregatedAnnual") is True for r in rows)):
        raise ValueError(f"annual rows are needed, not {told or 'ones without a frequency'}")
    return rows


def route_of(envelope: dict, given: str | None = None) -> str:
    """The route of a saved response: as given, as its records say, or as its request was; else an error."""
    if given is not None:
        if given not in ROUTES:
            raise ValueError(f"unknown route {given}")
        return given
    told = {r.get("_routeId") for r in envelope.get("response", {}).get("data", [])} - {None, ""}
    if len(told) == 1 and told <= set(ROUTES):
        return told.pop()
    command = str((envelope.get("request") or {}).get("command") or "")
    found = [r for r, path in ROUTES.items() if path.rstrip("/") in command]
    if not found:
        raise ValueError("the response names no route")
    return found[0]


def pages(fetch: Callable[[int], dict], length: int, most_pages: int = 1000, most_rows: int = 250_000, secrets: tuple[str, ...] = ()) -> Iterator[dict]:
    """Rows of an offset-paged response; ``fetch`` takes an offset and gives total and data.

    A total that changes, a page that repeats, one without progress, and more
    pages or rows than allowed raise; secrets never reach the message.
    """
    seen, total, got = set(), None, 0
    try:
        for _ in range(most_pages):
            page = fetch(got)
            rows, now = page["data"], int(page["total"])
            if total is not None and now != total:
                raise ValueError(f"total changed from {total} to {now}")
            total = now
            mark = hash(repr(rows))
            if rows and mark in seen:
                raise ValueError(f"page at {got} repeats")
            seen.add(mark)
            got += len(rows)
            if got > min(total, most_rows):
                raise ValueError(f"{got} rows of {total}")
            yield from rows
            if got == total:
                return
            if not rows or len(rows) > length:
                raise ValueError(f"no progress at {got} of {total}")
        raise ValueError(f"over {most_pages} pages")
    except Exception as e:
        raise ValueError(redact(str(e), secrets)) from None


def paged_landing(spark: SparkSession, path: str) -> DataFrame:
    """Rows of saved paged responses (``response.total``, ``response.data``): totals agree and are reached, or an error."""
    raw = spark.read.schema("response struct<total:long,data:array<map<string,string>>>").json(path, multiLine=True)
    check = raw.agg(F.min("response.total").alias("a"), F.max("response.total").alias("z"), F.sum(F.size("response.data")).alias("n")).first()
    if check["a"] != check["z"] or check["n"] != check["a"]:
        raise ValueError(f"pages give {check['n']} rows of {check['a']} to {check['z']}")
    return raw.select(F.explode("response.data").alias("row"))


def indicator(spark: SparkSession, path: str) -> DataFrame:
    """Country, year and value of saved pages of an indicator, each a pair of page data and rows; nulls stay."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$[1]"), "array<struct<countryiso3code:string,date:string,value:double>>").alias("rows"))
    return raw.select(F.explode("rows").alias("r")).select(F.col("r.countryiso3code").alias("country"), F.col("r.date").try_cast("int").alias("year"), F.col("r.value").alias("value"))


# --- spreadsheets ----------------------------------------------------------------------


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
STRINGS_AT_ONCE = 1 << 16


def _elements(stream, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a name as they end; each is dropped from the tree once it has been used."""
    path: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            path.append(element)
            continue
        path.pop()
        if element.tag == tag:
            yield element
            if path:
                path[-1].clear()


def _text(element: ElementTree.Element) -> str:
    """An element's text runs, without the phonetic ones."""
    heard = {id(t) for r in element.iter(f"{MAIN}rPh") for t in r.iter(f"{MAIN}t")}
    return "".join(t.text or "" for t in element.iter(f"{MAIN}t") if id(t) not in heard)


class SharedStrings:
    """A workbook's shared strings as Arrow arrays of a fixed number each."""

    def __init__(self, stream):
        self.parts: list[pa.Array] = []
        held: list[str] = []
        for si in _elements(stream, f"{MAIN}si"):
            held.append(_text(si))
            if len(held) == STRINGS_AT_ONCE:
                self.parts.append(pa.array(held, pa.string()))
                held = []
        self.parts.append(pa.array(held, pa.string()))

    def __getitem__(self, i: int) -> str:
        return self.parts[i // STRINGS_AT_ONCE][i % STRINGS_AT_ONCE].as_py()


def sheet_rows(body: bytes | BinaryIO, hints: tuple[str, ...], headers: tuple[str, ...], search: int = 100) -> Iterator[dict[str, str]]:
    """Rows of a workbook's sheet as header to text, as they are read: no sheet is held whole.

    Sheets whose names have a hint come first; the header row is the first of
    the leading ``search`` that has all ``headers``. A workbook without one raises.
    """
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(body) if isinstance(body, bytes) else body) as z:
        names = set(z.namelist())
        shared = SharedStrings(z.open("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets[s.get(rel)]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
        rank = lambda s: next((i for i, h in enumerate(hints) if h.lower() in s[0].lower()), len(hints))
        for _, target in sorted(sheets, key=rank):
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            header = None
            for number, row in enumerate(_elements(z.open(path), f"{MAIN}row")):
                cells = {}
                for at, c in enumerate(row.findall(f"{MAIN}c")):
                    v, kind = c.find(f"{MAIN}v"), c.get("t")
                    text = _text(c) if kind == "inlineStr" else v.text if v is not None else None
                    cells[_column(c.get("r")) if c.get("r") else at] = shared[int(text)] if kind == "s" and text is not None else text
                if header is None:
                    have = {(t or "").strip().lower() for t in cells.values()}
                    if all(h.lower() in have for h in headers):
                        header = {i: t.strip() for i, t in cells.items() if t and t.strip()}
                    elif number >= search:
                        break
                elif any((t or "").strip() for t in cells.values()):
                    yield {h: cells.get(i) for i, h in header.items()}
            if header is not None:
                return
    raise ValueError(f"no sheet has the headers {headers}")


def workbooks(spark: SparkSession, path: str, hints: tuple[str, ...], headers: tuple[str, ...]) -> DataFrame:
    """Rows of workbooks as maps beside the file's name, a task per file, out in parts as they are read.

    A task holds a file as it is packed, its strings and one part of its rows.
    """

    def fn(batches):
        for batch in batches:
            for name, body in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                held = []
                for r in sheet_rows(body, hints, headers):
                    held.append([(k, v) for k, v in r.items()])
                    if len(held) == 5000:
                        yield _maps(name, held)
                        held = []
                yield _maps(name, held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(fn, "path string, row map<string,string>")


def _maps(name: str, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(rows, pa.map_(pa.string(), pa.string()))], ["path", "row"])


# --- plants ----------------------------------------------------------------------------


# Header names of the unit tracker in order; the first filled one counts.
TRACKER_HEADERS = {
    "plant_id": ("Plant ID", "GEM Plant ID", "GEM Location ID", "Location ID"),
    "unit_id": ("Unit ID", "GEM Unit ID", "GEM Unit/Phase ID"),
    "plant_name": ("Project Name", "Plant Name", "Project/Plant Name"),
    "unit_name": ("Unit Name", "Unit/Phase Name"),
    "country": ("Country", "Country/Area"),
    "subnational": ("Subnational unit",),
    "status": ("Status",),
    "capacity": ("Capacity (MW)",),
    "technology": ("Technology",),
    "fuel": ("Fuel 1", "Fuel"),
    "second_fuel": ("Fuel 2",),
    "owner": ("Owner",),
    "operator": ("Operator",),
    "start_year": ("Start year",),
    "retired_year": ("Retired year",),
    "expected": ("Expected COD",),
    "latitude": ("Latitude",),
    "longitude": ("Longitude",),
    "url": ("GEM Wiki URL", "Wiki URL"),
    "updated": ("Last Updated",),
}


def csv_rows(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``row`` of CSV files with a header, as ``workbooks`` gives it: header to text, empty ones null."""
    raw = spark.read.option("header", True).option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(F.map_from_arrays(F.array(*[F.lit(c.lstrip("\ufeff").strip()) for c in raw.columns]), F.array(*[F.col(f"`{c}`") for c in raw.columns])).alias("row"))


def tracker_records(rows: DataFrame) -> DataFrame:
    """Typed units of tracker rows (``row``: header to text). Missing ids, bad numbers, capacities and lone coordinates raise."""
    keyed = rows.withColumn("row", F.map_from_entries(F.array_distinct(F.transform(F.map_entries("row"), lambda e: F.struct(S.key_normalize(e["key"]).alias("key"), e["value"].alias("value"))))))
    import re as _re

    pick = lambda names: F.coalesce(*[F.nullif(F.trim(F.try_element_at("row", F.lit(_re.sub("[^a-z0-9]+", " ", n.lower()).strip()))), F.lit("")) for n in names])
    d = keyed.select(*[pick(names).alias(c) for c, names in TRACKER_HEADERS.items()])
    need = lambda c: F.coalesce(c, F.raise_error(F.lit(f"{c} missing")).cast("string"))
    number = S.parse_number(F.col("capacity"))
    mw = F.when(number.isNull() | number.between(0, 100_000), number).otherwise(F.raise_error(F.lit("impossible capacity")).cast("double"))
    place = S.coordinates(S.parse_number(F.col("longitude")), S.parse_number(F.col("latitude")))
    life = V.lifecycle(F.col("status"), V.TRACKER_LIFECYCLES, "raise")
    year = lambda c: F.when(F.col(c).isNull(), F.lit(None)).otherwise(F.coalesce(S.year_of(F.col(c)), F.raise_error(F.concat(F.lit(f"invalid {c}: "), F.col(c))).cast("int")))
    return d.select(
        need("plant_id").alias("plant_id"), need("unit_id").alias("unit_id"), F.concat(F.lit("gem-unit-"), need("unit_id")).alias("id"), F.lit("unit").alias("entity"), F.coalesce("unit_name", "plant_name").alias("name"), "plant_name", "country", "operator", "owner",
        place["lon"].alias("lon"), place["lat"].alias("lat"), F.when(mw.isNotNull(), F.struct(mw.alias("low"), mw.alias("central"), mw.alias("high"))).alias("capacity"), F.when(mw.isNull(), "unavailable").otherwise("reported").alias("capacity_kind"),
        V.technology(F.col("technology"), F.col("fuel")).alias("technology"), life.alias("lifecycle"), V.raw_status(F.col("status"), F.col("status")).alias("raw_status"), year("start_year").alias("commissioning_year"), year("retired_year").alias("retirement_year"), year("expected").alias("target_year"), S.public_url(F.col("url")).alias("url"),
    )


def utility_scale(d: DataFrame) -> DataFrame:
    """Mapped power features that are plants, with the reason.

    ``d`` has kind (node, way, relation), name, source, owner, operator,
    wikidata, location, scale, capacity_mw, lifecycle. Roofs and homes never are;
    a known capacity decides; else planned ones, named geometries with a source,
    and those with an owner, operator or outside identity.
    """
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    home = F.coalesce(S.key_normalize(F.col("location")).isin("roof", "rooftop"), F.lit(False)) | F.coalesce(S.key_normalize(F.col("scale")).isin("household", "residential", "domestic"), F.lit(False))
    reason = (
        F.when(home, F.lit(None)).when(F.col("capacity_mw").isNotNull(), F.when(F.col("capacity_mw") >= 1, "reported_capacity_at_least_1mw"))
        .when(F.col("lifecycle").isin("under_construction", "announced"), "planned_or_construction_lifecycle")
        .when(F.col("kind").isin("way", "relation") & has("name") & has("source"), "named_plant_geometry_with_source")
        .when(has("owner") | has("operator") | has("wikidata"), "ownership_or_external_identity")
    )
    return d.withColumn("basis", reason).where("basis is not null")


# Which lifecycle of a feature mapped twice is kept first.
LIFECYCLE_PREFERENCE = {"under_construction": 6, "announced": 5, "operational": 4, "paused": 3, "shelved": 2, "retired": 1, "cancelled": 0}


def preferred_bindings(d: DataFrame, ident: str = "id") -> DataFrame:
    """One row per id: by lifecycle, then with a capacity, then the largest as JSON; different capacities of one id raise."""
    clash = d.where("capacity_mw is not null").groupBy(ident).agg(F.count_distinct("capacity_mw").alias("n"), F.min("capacity_mw").alias("a"), F.max("capacity_mw").alias("z")).where("n > 1")
    bad = clash.orderBy(ident).first()
    if bad is not None:
        raise ValueError(f"conflicting capacities of {bad[ident]}: {bad['a']} and {bad['z']} MW")
    order = F.struct(V.rank(F.col("lifecycle"), LIFECYCLE_PREFERENCE, -1).alias("l"), F.col("capacity_mw").isNotNull().alias("c"), F.to_json(F.struct(*sorted(d.columns))).alias("j"))
    return d.groupBy(ident).agg(F.max_by(F.struct(*d.columns), order).alias("b")).select("b.*")


def lifecycle_branches(tags: DataFrame) -> DataFrame:
    """Elements with lifecycle from power tags (element, power, construction, proposed, construction_power, proposed_power), a row per branch.

    A plant that is also tagged as being built or proposed is not operational.
    """
    plant = F.col("power") == "plant"
    other = (F.coalesce("construction_power", F.lit("")) == "plant") | (F.coalesce("proposed_power", F.lit("")) == "plant")
    kept = tags.join(tags.where(F.col("power").isin("construction", "proposed")).select("element").distinct(), "element", "left_anti").where(plant & ~other).withColumn("lifecycle", F.lit("operational"))
    built = tags.where((F.col("construction_power") == "plant") | ((F.col("power") == "construction") & F.col("construction").isin("plant", "power"))).withColumn("lifecycle", F.lit("under_construction"))
    planned = tags.where((F.col("proposed_power") == "plant") | ((F.col("power") == "proposed") & F.col("proposed").isin("plant", "power"))).withColumn("lifecycle", F.lit("announced"))
    return kept.union(built).union(planned).select("element", "lifecycle").distinct()


def infrastructure_branches(tags: DataFrame, branches: dict[str, Column], optional: list[str], least: int = 0) -> DataFrame:
    """Union of branches, each with its category, with optional attributes, repeated rows once; below ``least`` data centres raises."""
    out = None
    for category, rule in branches.items():
        d = tags.where(rule).select("element", F.lit(category).alias("category"), *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in optional])
        out = d if out is None else out.union(d)
    out = out.distinct()
    if least:
        floor(out.where("category = 'data_centre'"), least, "data centres")
    return out


# --- observations -------------------------------------------------------------------------


def region_mapping(mapping: DataFrame, active: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """code and geography_id: blanks, a code with two regions, inactive regions and observed codes without a region raise."""
    m = mapping.select(F.trim("code").alias("code"), F.trim("geography_id").alias("geography_id")).distinct()

    def none(d: DataFrame, label: str) -> None:
        r = d.orderBy(*d.columns).first()
        if r is not None:
            raise ValueError(f"{label}: {r[0]}")

    none(m.where("coalesce(code, '') = '' or coalesce(geography_id, '') = ''"), "blank mapping")
    none(m.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code"), "conflicting mappings")
    none(m.join(active, "geography_id", "left_anti").select("geography_id"), "inactive geography")
    if observed is not None:
        none(observed.select(F.trim("code").alias("code")).distinct().join(m, "code", "left_anti"), "unmapped code")
    return m


def observations(raw: DataFrame, mapping: DataFrame, regions: DataFrame) -> DataFrame:
    """Typed regional observations of curated rows; broken ones raise.

    Metrics are converted to GWh and MW, the mix column is JSON of value and
    unit by technology, the licence must be open, the country that of the region,
    the update not before the observation, and a key (region, year, source,
    record) must not repeat.
    """
    d = raw.join(mapping.withColumnRenamed("code", "source_region_code"), "source_region_code").join(regions.select("geography_id", F.col("iso3").alias("_iso3")), "geography_id")
    fail = lambda text, kind: F.raise_error(F.lit(text)).cast(kind)
    of = lambda name, dimension: V.metric(F.col(f"{name}_value"), F.col(f"{name}_unit"), dimension)
    least = lambda c, text: F.when(c.isNull() | (c >= 0), c).otherwise(fail(f"{text} is negative", "double"))
    mix = F.from_json("generation_mix_json", "map<string,struct<value:string,unit:string>>")
    mix = F.map_from_entries(F.array_sort(F.transform(F.map_entries(mix), lambda e: F.struct(e["key"], V.metric(e["value"]["value"], e["value"]["unit"], "energy").alias("value")))))
    total = F.aggregate(F.map_values("mix"), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    out = d.select(
        "geography_id", F.when(F.col("country_iso3") == F.col("_iso3"), F.col("country_iso3")).otherwise(fail("country disagrees with its region", "string")).alias("country_iso3"), F.col("year").cast("int").alias("year"),
        least(of("demand", "energy"), "demand").alias("demand_gwh"), least(of("generation", "energy"), "generation").alias("generation_gwh"), least(of("peak", "power"), "peak").alias("peak_mw"), of("net_interchange", "energy").alias("net_interchange_gwh"),
        least(of("observed_unmet_demand", "energy"), "unmet demand").alias("unmet_gwh"), mix.alias("mix"), "source_id", "source_record_id", F.coalesce(S.public_url(F.col("source_url")), fail("source address is not public", "string")).alias("source_url"),
        V.require_open_licence(F.col("licence"), "observation").alias("licence"), S.freshness_days(F.col("updated_at"), F.col("observation_date")).alias("freshness_days"), "value_kind", "method_id",
    )
    out = out.withColumn("mix", F.when(F.col("generation_gwh").isNull() | F.col("mix").isNull() | (total <= F.col("generation_gwh") + F.greatest(F.lit(1e-6), 1e-6 * F.abs("generation_gwh"))), F.col("mix")).otherwise(fail("mix exceeds generation", "map<string,double>")))
    again = out.groupBy("geography_id", "year", "source_id", "source_record_id").agg(F.count("*").alias("n")).where("n > 1").first()
    if again is not None:
        raise ValueError(f"repeated observation {again['source_record_id']}")
    return out


def best_observations(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Field by field the value of the highest source rank, then the smallest key; officials of one rank that differ raise."""
    long = rows.withColumn("_rank", V.rank(F.col("source_type"), V.SOURCE_RANK)).select("geography_id", "year", "_rank", "source_type", F.struct("source_id", "source_record_id").alias("_key"), F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*fields))).alias("field", "value")).where("value is not null")
    top = long.groupBy("geography_id", "year", "field").agg(F.max("_rank").alias("_rank"))
    best = long.join(top, ["geography_id", "year", "field", "_rank"])
    clash = F.when((F.max("_rank") == 4) & (F.count_distinct("value") > 1), F.raise_error(F.lit("official sources conflict")).cast("double"))
    one = best.groupBy("geography_id", "year", "field").agg(F.coalesce(clash, F.min_by("value", "_key")).alias("value"), F.min("_key").alias("source"))
    return one.groupBy("geography_id", "year").pivot("field", fields).agg(F.first("value"))


# A fuel aggregate's parts.
FUEL_CHILDREN = {
    "FOS": ("COW", "GAS", "PET"),
    "COW": ("ANT", "BIT", "COL", "LIG", "SUB", "WC"),
    "GAS": ("NG", "BFG", "OG", "OOG"),
    "PET": ("PEL", "PC", "PG"),
    "PEL": ("DFO", "JF", "KER", "RFO", "WO"),
    "REN": ("AOR", "SUN", "WND", "HYC", "HPS", "GEO", "BIO"),
    "BIO": ("AB", "BLQ", "MSW", "OBG", "SLW", "WDL", "WDS"),
}
# Parts of AOR where its description says that it means all renewables.
ALL_RENEWABLES = ("SUN", "WND", "HYC", "HPS", "GEO", "BIO", "AB", "BLQ", "MSW", "OBG", "SLW", "WDL", "WDS")
# Technologies of fuel codes; all others are other.
FUEL_TECHNOLOGY = {
    "coal": ("COW", "ANT", "BIT", "COL", "LIG", "SUB", "WC"),
    "gas": ("GAS", "NG", "BFG", "OG", "OOG"),
    "oil": ("DFO", "OIL", "JF", "KER", "PC", "PEL", "PET", "PG", "RFO", "WO"),
    "solar": ("SUN", "DPV"),
    "wind": ("WND",),
    "hydro": ("HYC", "HPS"),
    "geothermal": ("GEO",),
    "nuclear": ("NUC",),
    "biomass": ("BIO", "AB", "BLQ", "MSW", "OBG", "SLW", "WDL", "WDS", "WWW"),
}


def fuel_technology(code: Column) -> Column:
    out = F.lit("other")
    for technology, codes in FUEL_TECHNOLOGY.items():
        out = F.when(code.isin(*codes), technology).otherwise(out)
    return out


def fuel_closure(spark: SparkSession) -> DataFrame:
    """ancestor and descendant of every fuel aggregate, at any depth."""
    below = {k: set(v) for k, v in FUEL_CHILDREN.items()}
    for _ in below:
        for k, v in below.items():
            v |= {x for c in v for x in FUEL_CHILDREN.get(c, ())}
    return spark.createDataFrame([(k, x) for k, v in below.items() for x in sorted(v)] + [("AOR*", x) for x in ALL_RENEWABLES], "ancestor string, descendant string")


def is_total(code: Column, what: str) -> Column:
    """Whether a sector, producer or fuel code means all of them, by series."""
    totals = {"generation_sector": ("99", "ALL"), "generation_fuel": ("ALL", "TOTAL"), "sales_sector": ("ALL", "TOTAL"), "capability_producer": ("ALL", "TOTAL", "00"), "capability_fuel": ("ALL", "TOTAL", "TSN")}
    return F.coalesce(F.upper(F.trim(code)).isin(*totals[what]), F.lit(False))


def state_generation(rows: DataFrame) -> DataFrame:
    """Per state and year total generation (GWh) and the mix by technology, aggregates gone where their parts are there.

    ``rows``: state, year, sector, fuel, description, value, unit. Repeated fuels
    raise, and so do negative values but those of pumped storage, and a mix
    above the total.
    """
    spark = rows.sparkSession
    d = rows.where(is_total(F.col("sector"), "generation_sector")).withColumn("fuel", F.upper(F.trim("fuel"))).withColumn("sector", F.upper(F.trim("sector"))).withColumn("gwh", V.metric(F.col("value"), F.col("unit"), "energy"))
    renewables = S.key_normalize(F.coalesce("description", F.lit(""))).isin("all renewable", "all renewables", "all renewable energy sources")
    total = is_total(F.col("fuel"), "generation_fuel")
    whole = d.where(total).groupBy("state", "year").agg(F.when(F.count("*") > 1, F.raise_error(F.lit("duplicate total")).cast("double")).otherwise(F.max("gwh")).alias("generation_gwh"))
    leaf = d.where(~total).withColumn("fuel", F.when((F.col("fuel") == "AOR") & renewables, "AOR*").otherwise(F.col("fuel")))
    kept = de_overlap(leaf, fuel_closure(spark), ["state", "year", "sector"], "fuel")
    twice = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("duplicate fuel "), F.max("fuel"))).cast("double")).when((F.max("fuel") != "HPS") & (F.min("gwh") < 0), F.raise_error(F.lit("negative generation")).cast("double")).otherwise(F.max("gwh"))
    fuels = kept.groupBy("state", "year", "fuel").agg(twice.alias("gwh")).withColumn("technology", fuel_technology(F.regexp_replace("fuel", r"\*", "")))
    mix = fuels.where("gwh is not null").groupBy("state", "year", "technology").agg(F.sum(money(F.col("gwh"))).cast("double").alias("gwh"))
    mix = mix.groupBy("state", "year").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("technology", "gwh")))).alias("mix"), F.sum(money(F.col("gwh"))).cast("double").alias("_sum"))
    over = F.col("_sum") > F.col("generation_gwh") + F.greatest(F.lit(1e-6), 1e-6 * F.abs("generation_gwh"))
    return whole.join(mix, ["state", "year"], "full_outer").select("state", "year", "generation_gwh", F.when(over, F.raise_error(F.lit("mix exceeds total")).cast("map<string,double>")).otherwise(F.col("mix")).alias("mix"))


def state_capability(rows: DataFrame) -> DataFrame:
    """Per state and year dependable capacity (MW): the explicit total, else the sum of distinct producer and fuel cells; partial totals never count."""
    p, f = is_total(F.col("producer"), "capability_producer"), is_total(F.col("fuel"), "capability_fuel")
    d = rows.withColumn("mw", V.metric(F.col("value"), F.col("unit"), "power")).withColumn("_total", p & f).withColumn("_leaf", ~p & ~f & (F.trim(F.coalesce("producer", F.lit(""))) != "") & (F.trim(F.coalesce("fuel", F.lit(""))) != ""))
    cells = d.where("_leaf").groupBy("state", "year", "producer", "fuel").agg(F.when(F.count("*") > 1, F.raise_error(F.lit("duplicate capability cell")).cast("double")).when(F.min("mw") < 0, F.raise_error(F.lit("negative capability")).cast("double")).otherwise(F.max("mw")).alias("mw"))
    parts = cells.groupBy("state", "year").agg(F.sum(money(F.col("mw"))).cast("double").alias("_parts"))
    whole = d.where("_total").groupBy("state", "year").agg(F.when(F.count("*") > 1, F.raise_error(F.lit("duplicate capability total")).cast("double")).otherwise(F.max("mw")).alias("_whole"))
    return whole.join(parts, ["state", "year"], "full_outer").select("state", "year", F.coalesce("_whole", "_parts").alias("dependable_mw"))


def state_years(sales: DataFrame, generation: DataFrame, capability: DataFrame, interchange: DataFrame, states: DataFrame, authorities: DataFrame) -> DataFrame:
    """One row per region and year of all state series; states must be mapped, authorities without a region are left out.

    ``sales``: state, year, sector, value, unit. ``interchange``: respondent,
    kind, year, value, unit, of which only total interchange (TI) counts.
    """
    demand = sales.where(is_total(F.col("sector"), "sales_sector")).groupBy("state", "year").agg(F.when(F.count("*") > 1, F.raise_error(F.lit("duplicate sales")).cast("double")).otherwise(F.max(V.metric(F.col("value"), F.col("unit"), "energy"))).alias("demand_gwh"))
    rows = demand.join(state_generation(generation), ["state", "year"], "full_outer").join(state_capability(capability), ["state", "year"], "full_outer")
    rows = rows.join(states, "state", "left").withColumn("geography_id", F.coalesce("geography_id", F.raise_error(F.concat(F.lit("unmapped state "), F.col("state"))).cast("string")))
    net = interchange.where("upper(trim(kind)) = 'TI'").join(authorities, "respondent").groupBy("geography_id", "year").agg(F.when(F.count("*") > 1, F.raise_error(F.lit("duplicate interchange")).cast("double")).otherwise(F.max(V.metric(F.col("value"), F.col("unit"), "energy"))).alias("net_interchange_gwh"))
    return rows.drop("state").join(net, ["geography_id", "year"], "full_outer")


def electricity_mix(raw: DataFrame, areas: DataFrame) -> DataFrame:
    """Country-year demand, generation and mix of long rows (iso3, year, kind, fuel, gwh): countries only, fuels of one bucket summed, mix at most the total."""
    # Buckets of fuel names.
    buckets = {"bioenergy": "biomass", "hydro": "hydro", "nuclear": "nuclear", "solar": "solar", "wind": "wind", "coal": "coal", "gas": "gas", "other fossil": "oil", "other renewables": "other"}
    d = raw.join(areas.select("iso3").distinct(), "iso3", "left_semi").withColumn("bucket", F.coalesce(V.lookup(F.lower("fuel"), buckets), F.lit("other")))
    base = d.groupBy("iso3", "year").agg(F.max(F.when(F.col("kind") == "demand", F.col("gwh"))).alias("demand_gwh"), F.max(F.when(F.col("kind") == "generation", F.col("gwh"))).alias("generation_gwh"))
    b = d.where("kind = 'fuel' and gwh is not null").groupBy("iso3", "year", "bucket").agg(F.sum(money(F.col("gwh"))).cast("double").alias("gwh"))
    m = b.groupBy("iso3", "year").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "gwh")))).alias("mix"), F.sum(money(F.col("gwh"))).cast("double").alias("_sum"))
    over = F.col("_sum") > F.col("generation_gwh") + F.greatest(F.lit(1e-6), 1e-6 * F.abs("generation_gwh"))
    return base.join(m, ["iso3", "year"], "left").select("iso3", "year", "demand_gwh", "generation_gwh", F.when(over, F.raise_error(F.lit("mix exceeds generation")).cast("map<string,double>")).otherwise(F.col("mix")).alias("mix"))


def asset_registry(assets: DataFrame, sources: DataFrame) -> DataFrame:
    """Curated assets whose sources are all known, with defaults from the first one; repeated ids, unknown sources and bad coordinates raise."""
    twice = assets.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or trim(coalesce(id, '')) = ''").first()
    if twice is not None:
        raise ValueError(f"repeated or blank asset id {twice['id']}")
    unknown = assets.select("id", F.explode("source_ids").alias("source_id")).join(sources, "source_id", "left_anti").first()
    if unknown is not None:
        raise ValueError(f"unknown source {unknown['source_id']} of {unknown['id']}")
    first = sources.select(F.col("source_id").alias("_first"), F.col("source_type").alias("_type"), F.col("licence").alias("_licence"))
    d = assets.withColumn("_first", F.try_element_at("source_ids", F.lit(1))).join(first, "_first", "left")
    at = S.coordinates(F.col("lon"), F.col("lat"))
    out = d.withColumn("source_type", F.coalesce("source_type", "_type") if "source_type" in assets.columns else F.col("_type")).withColumn("licence", F.col("_licence")).withColumn("_at", at)
    return out.withColumn("lon", F.col("_at.lon")).withColumn("lat", F.col("_at.lat")).drop("_first", "_type", "_licence", "_at")


def country_controls(rows: DataFrame) -> DataFrame:
    """Controls of country and year; repeated ones raise."""
    bad = rows.groupBy("country", "year").agg(F.count("*").alias("n")).where("n > 1").orderBy("country", "year").first()
    if bad is not None:
        raise ValueError(f"duplicate control {bad['country']} {bad['year']}")
    return rows


def local_release(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """Records of a JSON release; none where there is no file; a file without records raises."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    raw = spark.read.schema(f"records array<struct<{schema}>>").json(path, multiLine=True)
    if not raw.where("records is null").isEmpty():
        raise ValueError("release without records")
    return raw.select(F.explode("records").alias("r")).select("r.*")


def pinned(files: DataFrame, checksums: DataFrame) -> DataFrame:
    """Files (path, content) whose SHA-256 is the pinned one; any that differs or has no pin raises."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    d = files.withColumn("name", name).withColumn("sha256", F.sha2("content", 256)).join(checksums.select("name", F.col("sha256").alias("_pin")), "name", "left")
    ok = F.when(F.col("sha256") == F.col("_pin"), F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("checksum differs: "), F.col("name"))).cast("string"))
    return d.select("name", "path", ok.alias("sha256"))


def union_with_counts(sources: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Feeds in order of precedence as one table with their rank, and the rows of each."""
    out = None
    for rank, (name, df) in enumerate(sources):
        d = df.withColumn("source", F.lit(name)).withColumn("source_rank", F.lit(rank))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out, out.groupBy("source").agg(F.count("*").alias("rows"))


def latest_by_year(rows: DataFrame, key: str) -> DataFrame:
    """The row of each key's last year."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("year")))).where("_r = 1").drop("_r")
