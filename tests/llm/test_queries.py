"""The registered queries against their SQL."""

import glob
import os
import random
import time

import duckdb
import pytest

from granary.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    began = time.time()
    found = con.execute(ORACLE_SQL[name])
    columns, rows = [d[0] for d in found.description], found.fetchall()
    assert time.time() - began < 60
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(str, r)) for r in rows)


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")) == list(range(1, 14))


HOSTS = ("a.xyz", "b.xyz", "C.xyz", "spam.net", "w.example.net", "ok.org", "www.example.com", "d.xyz")


def linked_pages(r, n):
    """Pages with relative, absolute, scheme-less, cross-scheme, query-only and fragment links, chains, conflicts and several links a page."""
    rows = []
    for k in range(n):
        host, folder = r.choice(HOSTS), r.choice(("", "/", "/en/", "/de/", "/fr/", "/k/"))
        url = f"{r.choice(('http', 'https', 'HTTP'))}://{host}{folder}{r.choice(('', str(r.randrange(12)))) if folder else ''}{r.choice(('', '', '?q=1', '#top'))}"
        links = []
        for _ in range(r.choice((0, 0, 0, 1, 1, 2, 3))):
            other, place = r.choice(HOSTS), f"{r.choice(('en', 'de', 'fr', 'k'))}/{r.randrange(12)}"
            link = r.choice((f"http://{other}/{place}", f"https://{other}/{place}?q=1&amp;r=2", f"//{other}/{place}", f"/{place}", str(r.randrange(12)), f"?q={r.randrange(3)}", "#part", f"ftp://{other}", "k/3#x"))
            links.append(r.choice((f'<link rel="canonical" href="{link}">', f"<LINK HREF='{link}' rel=canonical>", f'<meta http-equiv="refresh" content="3; URL={link}">', f'<link rel="next" href="{link}">', f'<link data-rel=canonical href="{link}">')))
        rows.append((k, r.choice((url, url, url, url, None if k % 9 == 0 else url)), None if k % 17 == 0 else f"<html>{' '.join(links)}</html>"))
    return [*rows, (n, "no scheme", '<link rel=canonical href="http://spam.net/">'), (n + 1, "http://z.xyz/", '<link rel=canonical href="http://z.xyz/">')]


@pytest.mark.parametrize(("seed", "n"), [(1, 30), (2, 60), (3, 150), (4, 400)])
def test_url_classes_equal_their_sql_where_pages_link(spark, tmp_path, seed, n):
    rows = linked_pages(random.Random(seed), n)
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = QUERIES["op6_redirect_classes"](spark, str(tmp_path))
    want = con.execute(ORACLE_SQL["op6_redirect_classes"])
    columns = [d[0] for d in want.description]
    want = sorted(tuple(map(str, x)) for x in want.fetchall())
    assert sorted(tuple(map(str, x)) for x in df.select(*columns).collect()) == want and len(want) == n + 2
    if seed == 1:  # some verdicts are those of aliases
        assert any(x[columns.index("rule")] == "None" and x[columns.index("verdict")] == "block" for x in want)


def test_pages_without_an_id_equal_their_sql(spark, tmp_path):
    rows = [(4, "u", "same"), (2, "u", "same"), (None, "u", "same"), (None, "v", "other"), (None, "w", "other"), (None, "x", None), (7, "y", ""), (8, None, "own"), (8, None, "own")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["op7_warc_salvage"])
    columns = [d[0] for d in want.description]
    got = [tuple(map(str, x)) for x in QUERIES["op7_warc_salvage"](spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(got) == sorted(tuple(map(str, x)) for x in want.fetchall())
    kinds = sorted((g[columns.index("page_id")], g[columns.index("record_type")], g[columns.index("refers_to")]) for g in got)
    assert ("None", "revisit", "4") in kinds and ("None", "revisit", "7") in kinds and kinds.count(("None", "response", "None")) == 2
