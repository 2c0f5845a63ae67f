import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions import formats, globs, paths


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("*.tmp", ["a.tmp", "x/a.tmp", ".tmp"], ["a.tmpx", "a.TMP"]),
        ("a?c", ["abc", "a/c"], ["ac", "abbc"]),
        ("[ab]x", ["ax", "bx"], ["cx"]),
        ("[!ab]x", ["cx"], ["ax"]),
        ("[a-c0-2]", ["b", "1"], ["d", "3"]),
        ("[]x]", ["]", "x"], ["y"]),
        ("{foo,ba*}", ["foo", "bar"], ["fo"]),
        ("{a,{b,c}}d", ["ad", "bd", "cd"], ["d", "a"]),
        ("**", ["", "a/b"], []),
        ("**/x", ["x", "/x", "a/b/x"], ["ax"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["ab", "a/xb"]),
        ("a/**", ["a/b", "a/b/c"], ["a", "b/a"]),
        ("a**b", ["ab", "a/x/b"], ["a"]),
        (r"\*", ["*"], ["a"]),
        ("a.b+c", ["a.b+c"], ["axb+c", "a.bbc"]),
    ],
)
def test_globs_match_whole_strings(glob, yes, no):
    r = globs.compile_python([glob])
    assert [x for x in yes if not r.match(x)] == []
    assert [x for x in no if r.match(x)] == []


def test_invalid_globs_are_reported_and_ignored(spark):
    assert globs.validate_globs(["[bad", "ok*", "{a", "a}", "[z-a]", "x\\"]) == ["[bad", "{a", "a}", "[z-a]", "x\\"]
    assert globs.matcher(["[bad"]) is None
    assert one(spark, "/x/a", lambda c: globs.excluded(c, ["[bad"])) is False


def test_exclusion_is_of_whole_paths_and_of_components(spark):
    rows = spark.createDataFrame([("/x/node_modules/a",), ("/x/a.tmp",), ("/x/a.txt",), ("/x/a.tmp\n",)], "p string")
    kept = rows.filter(~globs.excluded(F.col("p"), ["node_modules", "*.tmp"])).collect()
    assert sorted(r.p for r in kept) == ["/x/a.tmp\n", "/x/a.txt"]


@settings(max_examples=60, deadline=None)
@given(st.text("ab*?[]{},/!\\-.^$|+()", max_size=8))
def test_valid_globs_give_valid_expressions(glob):
    if not globs.validate_globs([glob]):
        re.compile(globs.to_regex(glob))


def test_paths(spark):
    assert one(spark, "//a/./b/../c/", paths.components) == ["a", "b", "..", "c"]
    assert one(spark, "C:\\a\\b/c/", paths.base_name) == "c"
    assert one(spark, "///", paths.base_name) == "///"
    assert one(spark, "/r/a/b", paths.breadcrumbs) == ["/r", "/r/a", "/r/a/b"]
    assert one(spark, "/", paths.breadcrumbs) == []
    assert one(spark, "/ab/c", lambda c: paths.under(c, "/a")) is False
    assert one(spark, "/a", lambda c: paths.under(c, "/a")) is False
    assert one(spark, "/a/b/c", lambda c: paths.child(c, "/a/")) == "/a/b"
    assert one(spark, "/a/b", lambda c: paths.child(c, "/a")) is None
    rows = spark.createDataFrame([(x,) for x in ("a-b", "a/b", "a", "a/b/c")], "p string").orderBy(paths.sort_key(F.col("p"))).collect()
    assert [r.p for r in rows] == ["a", "a/b", "a/b/c", "a-b"]


@pytest.mark.parametrize(("size", "even", "up"), [(0, "0 B", "0 B"), (1023, "1023 B", "1023 B"), (1024, "1.0 KB", "1.0 KB"), (1280, "1.2 KB", "1.3 KB"), (1536, "1.5 KB", "1.5 KB"), (1048535, "1024.0 KB", "1024.0 KB"), (5 << 50, "5.0 PB", "5.0 PB"), (5000 << 50, "5000.0 PB", "5000.0 PB")])
def test_sizes(spark, size, even, up):
    assert (formats.human(size), formats.human(size, up=True)) == (even, up)
    row = spark.createDataFrame([(size,)], "v long").select(formats.human_size(F.col("v")), formats.human_size_up(F.col("v"))).first()
    assert tuple(row) == (even, up)


def test_durations_and_shares(spark):
    assert [formats.duration(x) for x in (0.0129, 0.9999, 1.0, 59.94, 61.2, 119.7)] == ["12 ms", "999 ms", "1.0 s", "59.9 s", "1m 1s", "1m 60s"]
    assert [formats.duration_ms(x) for x in (12.5, 999.4, 1050, 61_500)] == ["13 ms", "999 ms", "1.1 s", "1m 2s"]
    rows = spark.createDataFrame([(100, 25), (0, 0), (10, 20)], "t long, f long").select(formats.percent_used(F.col("t"), F.col("f"))).collect()
    assert [r[0] for r in rows] == [75, None, 0]
