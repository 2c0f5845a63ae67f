"""Every registered query against its SQL, and known results of the virtual corpus."""

import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from granary.operators import duplicates, scan
from granary.plans import catalogue
from granary.sources import inventory

DATA = "/root/testdata"
SF = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = tables.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


@pytest.mark.parametrize(
    ("sf", "files", "size", "dirs", "groups", "members", "wasted", "plain"),
    [("sf0.001", 240, 1_171_456, 81, 7, 15, 20_565, (10, 29_443)), ("sf0.01", 1040, 5_230_592, 100, 46, 99, 96_621, (62, 163_961))],
)
def test_known_results(spark, sf, files, size, dirs, groups, members, wasted, plain):
    i = inventory.corpus(spark, f"{DATA}/{sf}", identity=True).persist()
    t = scan.totals(i).first()
    assert (t.total_files, t.total_size, scan.folder_count(i, "/corpus").first()[0]) == (files, size, dirs)
    g = duplicates.summaries(duplicates.members(i)).agg(F.count("*"), F.sum("n"), F.sum("wasted")).first()
    assert tuple(g) == (groups, members, wasted)
    g = duplicates.summaries(duplicates.members(i, collapse_links=False)).agg(F.count("*"), F.sum("wasted")).first()
    assert tuple(g) == plain
    i.unpersist()


def test_snapshots_keep_what_they_hold(spark, tmp_path):
    i = inventory.corpus(spark, SF)
    inventory.save(i, str(tmp_path / "s"))
    again = spark.read.parquet(str(tmp_path / "s"))
    assert scan.totals(again).first() == scan.totals(i).first()
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = duplicates.at_least(again, 4096)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(logical_size,4096)" in plan


def exchanged(df):
    """Column names in the exchanges of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    rows = plan.split("\n")
    return [rows[k + 1] for k, x in enumerate(rows[:-1]) if re.search(r"\bExchange (hash|range|Round)", x)]


@pytest.mark.parametrize("few", [True, False])
def test_no_content_is_shuffled(spark, monkeypatch, few):
    """Neither where lengths are broadcast nor where there are too many of them."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    if not few:
        monkeypatch.setattr(duplicates, "BROADCAST_ROWS", 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, linked = inventory.corpus(spark, SF), inventory.corpus(spark, SF, identity=True)
        for df in (duplicates.members(plain), duplicates.members(linked), duplicates.prefix_buckets(plain), duplicates.candidates(plain, "path"), linked):
            below = exchanged(df)
            assert below and not [x for x in below if re.search(r"\b(content|text)#\d+(,|\])", x.partition("AS hash")[0].partition("sha2")[0])], below
        want = duplicates.summaries(duplicates.members(linked)).count()
        assert want == 7
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
