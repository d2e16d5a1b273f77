"""Pages of a list against its sorted rows."""

import random
from datetime import datetime, timedelta

import pytest

from tallyforge.sources.listing import Listing

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(START + timedelta(days=rng.randrange(40)), i, f"v{i}") for i in range(500)]
    rng.shuffle(rows)
    listing = Listing(spark, str(tmp_path_factory.mktemp("list")), ["-at", "id"])
    listing.build(spark.createDataFrame(rows, "at timestamp_ntz, id long, v string"), each=60)
    return listing, sorted(rows, key=lambda r: (-r[0].timestamp(), r[1]))


@pytest.mark.parametrize(("number", "size"), [(1, 20), (2, 7), (13, 20), (25, 20), (26, 20), (1, 600), (3, 130)])
def test_any_page(made, number, size):
    listing, rows = made
    got = sorted(listing.page(number, size).collect(), key=lambda r: r["rank"])
    start = (number - 1) * size
    assert [(r["rank"], r.id, r.v) for r in got] == [(k, r[1], r[2]) for k, r in enumerate(rows)][start : start + size]
    assert listing.total() == 500


@pytest.mark.parametrize("at", [0, 59, 60, 333, 498, 499])
def test_rows_after_a_cursor(made, at):
    listing, rows = made
    got = sorted(listing.after({"at": rows[at][0], "id": rows[at][1]}, 15).collect(), key=lambda r: r["rank"])
    assert [r.id for r in got] == [r[1] for r in rows[at + 1 : at + 16]]


def test_a_cursor_that_is_gone(made):
    listing, rows = made
    got = sorted(listing.after({"at": START + timedelta(days=20, hours=1), "id": 0}, 5).collect(), key=lambda r: r["rank"])
    assert [r.id for r in got] == [r[1] for r in rows if r[0] < START + timedelta(days=20, hours=1)][:5]


def test_a_page_reads_its_ranges_alone(made):
    listing, _ = made
    plan = listing.page(13, 20)._jdf.queryExecution().toString()
    filters = plan.split("PartitionFilters: ")[-1].split("]")[0]
    assert "_range" in filters and "SinglePartition" not in plan


def test_no_rows(spark, tmp_path):
    listing = Listing(spark, str(tmp_path), ["id"])
    listing.build(spark.createDataFrame([], "id long"))
    assert listing.total() == 0 and listing.page(1, 5).count() == 0
