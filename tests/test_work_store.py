"""Stored work orders: pages by directory, search by trigrams, pushed filters."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlake.operators import query, work_store

SCHEMA = "work_order string, row_ix long, description string, note string, severity string"
WORDS = ["Brake", "pad", "replaced", "ENGINE", "öl", "漢字", "𝄞x", "a", "oil-leak", "brakes", "", "tyre  worn"]


@pytest.fixture()
def rows(spark):
    rng = random.Random(1)
    text = lambda: None if rng.random() < 0.1 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12)))
    data = [(None if i % 50 == 0 else f"W{i % 400:04d}", i, text(), text(), rng.choice(["high", "low", None])) for i in range(2000)]
    return spark.createDataFrame([*data, ("W9999", 2000, "brake " * 5000 + "needle", None, "high")], SCHEMA).repartition(5)


def test_pages_equal_sorted_rows(spark, rows, scratch):
    work_store.store(rows, scratch, "work_order", ranges=7)
    for number in (0, 3, 28, 199, 200, 201):
        assert work_store.page(spark, scratch, number).collect() == query.table_page(rows, number).collect()
    # pages that span many ranges
    assert work_store.page(spark, scratch, 1, 900).collect() == query.table_page(rows, 1, 900).collect()
    assert sorted(map(str, work_store.read(spark, scratch).collect())) == sorted(map(str, rows.collect()))


def test_a_page_reads_one_range_without_an_offset(spark, rows, scratch, capsys):
    work_store.store(rows, scratch, "work_order", ranges=20)
    deep = work_store.page(spark, scratch, 150)
    assert len({p.rsplit("/", 2)[1] for p in deep.inputFiles()}) == 20  # all that the table has
    deep.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [" in plan and "_place" in plan.split("PushedFilters:")[1].split("\n")[0] and "Limit" not in plan
    read = deep.select(F.input_file_name().alias("f")).distinct().collect()
    assert len(read) == 1


@pytest.mark.parametrize("q", ["brake", "BRAKE PAD", "Öl", "漢字", "𝄞x", "x a", "needle", "a", "", "no such text", "oil-leak brakes tyre  worn", "e  w"])
def test_search_equals_the_scan(spark, rows, tmp_path_factory, q):
    if not hasattr(test_search_equals_the_scan, "folder"):
        test_search_equals_the_scan.folder = f"{tmp_path_factory.mktemp('search')}/s"
        work_store.store(rows, test_search_equals_the_scan.folder, "work_order", ranges=7)
        work_store.index_text(spark, test_search_equals_the_scan.folder, ["work_order", "description", "note"])
    got = work_store.search(spark, test_search_equals_the_scan.folder, q)
    want = query.table_search(rows, q, ["work_order", "description", "note"])
    assert sorted(r.row_ix for r in got.collect()) == sorted(r.row_ix for r in want.collect())


def test_filters_on_labels_reach_the_reader(spark, rows, scratch, capsys):
    work_store.store(rows, scratch, "work_order")
    high = query.faults_by_severity(work_store.read(spark, scratch), "high")
    high.explain("formatted")
    assert "EqualTo(severity,high)" in capsys.readouterr().out
    assert high.count() == rows.where("severity = 'high'").count()


def test_empty_stores_and_missing_ones(spark, rows, scratch):
    with pytest.raises(FileNotFoundError):
        work_store.page(spark, scratch, 0)
    work_store.store(rows.limit(0), scratch, "work_order")
    assert work_store.page(spark, scratch, 0).count() == 0
    with pytest.raises(ValueError):
        work_store.search(spark, scratch, "brake")
    work_store.index_text(spark, scratch, ["description"])
    assert work_store.search(spark, scratch, "brake").count() == 0 and work_store.search(spark, scratch, "").count() == 0
    # storing again replaces what is read
    work_store.store(rows, scratch, "work_order")
    assert work_store.read(spark, scratch).count() == 2001


def test_blocks_share_their_postings(spark, scratch):
    """One posting for each trigram of a block, not one for each trigram of a row."""
    rows = spark.range(4000).selectExpr("format_string('%06d', id) AS work_order", "id AS row_ix", "if(id = 3000, 'the one needle', 'brake pads worn') AS description")
    work_store.store(rows, scratch, "work_order", ranges=2)
    at = work_store.index_text(spark, scratch, ["description"])
    postings = spark.read.parquet(work_store.batch_path(scratch, "postings", at))
    assert postings.count() < 1000 and postings.count() >= postings.distinct().count() > 13 * 15
    assert [r.row_ix for r in work_store.search(spark, scratch, "NEEDLE").collect()] == [3000]
    assert work_store.search(spark, scratch, "Pads").count() == 3999
