"""Paged feeds read by partitions, and all that may go wrong between them."""

import pytest

from wattlake.sources import paged


def feed(total, length=10, change=None):
    """A fetcher over numbered records; ``change`` takes offset and page and gives the page."""

    def fetch(offset, length):
        page = {"total": str(total), "data": [{"n": i, "name": f"r{i}", "none": None, "deep": {"a": [i]}} for i in range(offset, min(total, offset + length))]}
        return change(offset, page) if change else page

    return fetch


def test_all_rows_come_once_from_many_partitions(spark):
    df = paged.read_paged(spark, feed(95), length=10, span=2)
    rows = df.collect()
    assert sorted((r["offset"], r["row"]["n"], r["row"]["name"], r["row"]["none"], r["row"]["deep"]) for r in rows) == [(i, str(i), f"r{i}", None, f'{{"a": [{i}]}}') for i in range(95)]
    assert paged.read_paged(spark, feed(0)).collect() == []


def test_a_page_that_is_shorter_than_asked_moves_on_within_its_span(spark):
    df = paged.read_paged(spark, feed(50, change=lambda at, p: p | {"data": p["data"][:7]}), length=10, span=2)
    assert sorted(r["offset"] for r in df.collect()) == list(range(50))


@pytest.mark.parametrize(
    ("change", "text"),
    [
        (lambda at, p: p | {"total": "96"} if at >= 60 else p, "total changed from 95 to 96"),  # in another partition than the first page's
        (lambda at, p: p | {"data": [{"n": 1}] * 10} if at in (20, 70) else p, "page at 20 repeats"),  # in two partitions
        (lambda at, p: p | {"data": []} if at == 40 else p, "no progress at 40"),
        (lambda at, p: p | {"data": p["data"] * 2} if at == 30 else p, "20 rows of 10 asked for"),
        (lambda at, p: p | {"data": {"a": 1}} if at == 50 else p, "unexpected response"),
        (lambda at, p: p | {"total": None}, "whole number"),
        (lambda at, p: p | {"total": True}, "whole number"),
        (lambda at, p: p | {"total": -1}, "whole number"),
    ],
)
def test_broken_pages_raise(spark, change, text):
    with pytest.raises(Exception, match=text):
        paged.read_paged(spark, feed(95, change=change), length=10, span=2).collect()


def test_limits_and_secrets(spark):
    with pytest.raises(Exception, match="250001 rows are more than 250000"):
        paged.read_paged(spark, feed(250_001))
    with pytest.raises(Exception, match="over 3 pages"):
        paged.read_paged(spark, feed(95), length=10, most_pages=3)
    with pytest.raises(Exception, match="total is zero"):
        paged.read_paged(spark, feed(0, change=lambda at, p: p | {"data": [{"n": 1}]}))

    def failing(at, page):
        if at >= 20:
            raise OSError("GET /x?api_key=hush&y=1 with hush2")
        return page

    with pytest.raises(Exception, match=r"OSError at \d0") as e:
        paged.read_paged(spark, feed(95, change=failing), length=10, span=2, secrets=("hush2",)).collect()
    assert "hush" not in str(e.value).replace("test_limits", "")


def test_feeds_that_number_their_pages(spark):
    rows = [{"countryiso3code": "AAA", "date": str(1900 + i), "value": i} for i in range(25)]
    fetch = paged.numbered(lambda page, size: [{"total": 25, "pages": 3}, rows[(page - 1) * size : page * size]], 10)
    got = paged.read_paged(spark, fetch, length=10, span=1).collect()
    assert sorted(r["row"]["date"] for r in got) == [str(1900 + i) for i in range(25)]
