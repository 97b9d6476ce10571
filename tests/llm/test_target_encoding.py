"""Encodings against a count of all earlier rows, and the query against its SQL."""

import datetime as dt
import random
import zlib

import duckdb
import pytest

TABLES = ("sale_lines", "sales", "items", "vendors", "clients")
KEYS = ["sale_id", "item_id", "vendor_id"]
COLUMNS = ["sale_id", "item_id", "vendor_id", "n_lines", "n_returned", "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate"]


def brute(lines, sales, items, vendors, clients, gap):
    kind, nation, segment = (dict(sorted(t, key=lambda r: str(r[1]), reverse=True)) for t in (items, vendors, clients))
    rows = []
    for sale, item, vendor, flag in lines:
        for other, client, at in sales:
            if sale is not None and other == sale and at is not None:
                item, client = -1 if item is None else item, -1 if client is None else client
                rows.append({"sale": sale, "item": item, "vendor": vendor, "client": client, "at": at, "fold": zlib.crc32(str(sale).encode()) % 5, "s": flag == "returned", "kind": kind.get(item), "nation": nation.get(vendor), "segment": segment.get(client)})
    rate = lambda found, p: p if not found else (1_000_000 * sum(f["s"] for f in found) + 50 * p) // (len(found) + 50)
    out = {}
    for r in rows:
        past = [x for x in rows if x["fold"] != r["fold"] and x["at"] + gap < r["at"]]
        of = lambda k: [x for x in past if x[k] == r[k]]  # noqa: B023, E731
        p, own = rate(past, 500_000), [x for x in rows if all(x[k] == r[k] for k in ("sale", "item", "vendor"))]
        res = [len(own), sum(x["s"] for x in own)]
        for k, g in (("item", "kind"), ("vendor", "nation"), ("client", "segment")):
            res += [len(of(k)), rate(of(k), rate(of(g), p))]
        out[r["sale"], r["item"], r["vendor"]] = tuple(res)
    return out


@pytest.mark.parametrize(("slice_rows", "turn", "gap"), [(1 << 18, 1 << 17, 0), (40, 7, 0), (40, 7, 3600)])
def test_matches_a_count_of_all_earlier_rows(spark, monkeypatch, slice_rows, turn, gap):
    from wattlake.llm import target_encoding as te

    monkeypatch.setattr(te, "TURN_ROWS", turn)
    rng, start = random.Random(4), dt.datetime(2024, 3, 30)
    sales = [(i, rng.choice([None, 1, 1, 1, rng.randrange(20)]), rng.choice([None, *range(0, 200_000, 1800)])) for i in range(150)]
    lines = [(rng.choice([None, 999, *range(150)]), rng.choice([None, 5, 5, rng.randrange(30)]), rng.choice([None, 2, rng.randrange(9)]), rng.choice(["returned", "kept", None])) for _ in range(500)]
    lines += lines[:60]
    items = [(i, rng.choice(["a", "b", None, ""])) for i in range(25)]
    vendors, clients = [(i, rng.choice([1, 2, None])) for i in range(7)], [(i, rng.choice(["x", "y"])) for i in range(15)]
    make = spark.createDataFrame
    got = te.encode_sales(
        make(lines, "sale_id long, item_id long, vendor_id long, flag string").selectExpr("*", "1 AS n_lines", "'z' AS kind"),
        make([(a, b, None if c is None else start + dt.timedelta(seconds=c)) for a, b, c in sales], "sale_id long, client_id long, sold_at timestamp_ntz").selectExpr("*", "2 AS time", "3 AS fold"),
        make(items, "item_id long, kind string"), make(vendors, "vendor_id long, nation_id int"), make(clients, "client_id long, segment string"),
        gap=gap * 1_000_000, slice_rows=slice_rows,
    )
    assert got.columns == COLUMNS
    rows = got.collect()
    assert {tuple(r[k] for k in KEYS): tuple(r[c] for c in COLUMNS[3:]) for r in rows} == brute(lines, sales, items, vendors, clients, gap)
    assert len(rows) == len({tuple(r[k] for k in KEYS) for r in rows})


def test_query_matches_its_sql(spark):
    from wattlake.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got = sorted(map(tuple, QUERIES["op12_target_encoding"](spark, "/root/testdata/sf0.001").select(*COLUMNS).collect()), key=str)
    want = con.sql(f"select {', '.join(COLUMNS)} from ({ORACLES['op12_target_encoding']})").fetchall()
    assert got == sorted(want, key=str)


def test_empty_and_one_time(spark):
    from wattlake.llm.target_encoding import encode_sales

    make = spark.createDataFrame
    lines = make([(i, 1, 1, "kept") for i in range(20)], "sale_id long, item_id long, vendor_id long, flag string")
    sales = make([(i, 1, dt.datetime(2024, 1, 1)) for i in range(20)], "sale_id long, client_id long, sold_at timestamp_ntz")
    rest = make([], "item_id long, kind string"), make([], "vendor_id long, nation_id int"), make([], "client_id long, segment string")
    rows = encode_sales(lines, sales, *rest, slice_rows=4).collect()
    assert len(rows) == 20 and {(r["item_n"], r["item_rate"], r["client_rate"]) for r in rows} == {(0, 500_000, 500_000)}
    assert encode_sales(lines.where("false"), sales, *rest).collect() == []
    assert encode_sales(lines, sales.where("false"), *rest).collect() == []
