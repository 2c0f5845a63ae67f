"""Url filter, WARC archives and sharding."""

import base64
import collections
import hashlib
import io
import os
import random

import pytest

from granary.llm import sharding, url_filter, warc
from granary.llm.common import shared_dir

SF = "/root/testdata/sf0.01"

ORACLE = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[: min([k for k in (tail.find(c) for c in "?#") if k >= 0], default=len(tail))]


def rule_of(host, path):
    fits = [(len(h + p), v == "allow", h + p, v) for h, p, v in ORACLE if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def judged(spark, rows, redirects=None):
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, rule string")
    return {x.page_id: x for x in url_filter.judge(pages, redirects).collect()}


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "x", "http://", "http://a.NET", "http://a.NET/", "HTTP://Ünet.Example.NET/en/x?y#z", "http://example.net/en", "http://example.net/en/", "http://notexample.net/en/a", "http://example.com/de/1",
            "http://example.com#/de/", "http://example.com?/de/", "ftp://w.org/fr/?q://r", "a://b://c/d", "http://net/x", "http://x.network/", "http://a.org/fr\n/x", "://org/fr/ü"]
    got = judged(spark, [(k, u, None) for k, u in enumerate(urls)])
    for k, u in enumerate(urls):
        host, path = split_url(u)
        rule, verdict = rule_of(host, path)
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, rule, verdict or "allow"), u


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {x.page_id: x for x in url_filter.op6_redirect_classes(spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        host, path = split_url(p.url)
        rule, verdict = rule_of(host, path)
        assert (got[p.page_id].host, got[p.page_id].path, got[p.page_id].rule) == (host, path, rule)
        assert got[p.page_id].verdict == verdict or verdict is None


def test_aliases_share_a_verdict_and_allowing_wins(spark):
    rows = [
        (1, "http://a.xyz/p", '<link rel="canonical" href="http://spam.net/q">'),
        (2, "http://b.xyz/", "<LINK href='/z?a=1&amp;b=2' rel=canonical>"),
        (3, "https://b.xyz/z?a=1&b=2#f", '<meta http-equiv="refresh" content="0; url=http://a.xyz/p">'),
        (4, "http://c.xyz/k", "<link rel=canonical href=http://spam.net/other>"),
        (5, "http://ok.org/fr/a", "<link rel=canonical href=//c.xyz/k>"),
        (6, "http://d.xyz/a/b", "<link rel=canonical href=c>"),
        (7, "http://d.xyz/a/c", ""),
        (8, "http://d.xyz/a/e", None),
        (9, "http://d.xyz/a/e", None),
        (10, None, "<link rel=canonical href=http://spam.net/>"),
    ]
    redirects = spark.createDataFrame([("http://d.xyz/a/b", "http://e.xyz"), ("http://e.xyz/", "http://spam.net/x"), (None, "http://spam.net/"), ("http://d.xyz/a/e", "nowhere")], "source string, target string")
    assert {k: x.verdict for k, x in judged(spark, rows).items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow"}
    got = {k: x.verdict for k, x in judged(spark, rows, redirects).items()}
    assert (got[6], got[7], got[8]) == ("block", "block", "allow")
    assert judged(spark, []) == {}


def payload_rows():
    return [(1, "http://x/1", "same"), (2, None, "same"), (5, "http://x/\r\n5", "same"), (3, "http://x/3", ""), (4, "http://x/4", None), (6, "http://x/é", "é☃" * 50_000), (7, "http://x/7", "WARC/1.1\r\n\r\n" * 30), (None, "http://x/n", "alone")]


@pytest.mark.parametrize("least", [0, 1])
def test_archives_give_back_what_was_written(spark, tmp_path, least):
    pages = spark.createDataFrame([(*r, 5) for r in payload_rows()], "page_id long, url string, html string, path int")
    archives = warc.write_archives(pages, str(tmp_path / "w"), least)
    assert sum(x.records for x in archives.collect()) == 8 and not [f for f in os.listdir(tmp_path / "w") if not f.endswith(".warc.gz")]
    got = {x.page_id: x for x in warc.read_archives(archives).collect()}
    for i, _, html in payload_rows():
        data = (html or "").encode()
        x = got[i]
        assert x.gap is None and x.payload_bytes == len(data) and x.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = {1: 5, 2: 5}.get(i) or (4 if i == 3 and least == 0 else None)
        assert (x.record_type, x.refers_to) == (("revisit", first) if first else ("response", None))
        assert x.payload == (b"" if first else data)


def test_whole_table_of_pages_and_an_empty_one(spark):
    got = warc.op7_warc_salvage(spark, SF)
    pages = {x.page_id: (x.html or "").encode() for x in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = got.collect()
    assert sorted(x.page_id for x in rows) == sorted(pages) and all(x.payload_bytes == len(pages[x.page_id]) for x in rows)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none, f"{shared_dir(spark)}/none")).count() == 0


@pytest.mark.parametrize("plain", [True, False])
def test_salvage_recovers_all_but_the_broken_records(plain):
    r = random.Random(6)
    for _ in range(25):
        parts = [warc.record("response", k, f"http://x/{k}", bytes(r.choices(b"abcdef \r\n\x1f\x8b\x08", k=r.randint(0, 900)))) for k in range(20)]
        parts = parts if plain else [warc.member(p) for p in parts]
        broken, data = set(), bytearray()
        for k, p in enumerate(parts):
            p = bytearray(p)
            harm = r.random()
            if harm < 0.15:
                broken.add(k)
                at = r.randrange(len(p) - 30)
                if r.random() < 0.5:
                    for m in range(at, at + 20):
                        p[m] ^= 0x55
                else:
                    del p[at : at + 25]
            data += p
            if r.random() < 0.1:
                data += bytes(r.choices(range(256), k=40))
        data = bytes(data)
        found = list(warc.salvage(io.BytesIO(data), len(data)))
        assert [x[1] for x in found[1:]] == [x[2] for x in found[:-1]] and found[0][1] == 0 and found[-1][2] == len(data)
        good = {int(x[3].get("page-id", -1)) for x in found if x[0] == "record"}
        assert good >= set(range(20)) - broken
        assert all(x[3] for x in found if x[0] == "gap")
    assert list(warc.salvage(io.BytesIO(b""), 0)) == []
    assert [x[:3] for x in warc.salvage(io.BytesIO(b"rubbish"), 7)] == [("gap", 0, 7)]


def test_very_long_urls(spark, tmp_path):
    url = "http://x/" + "Straße/" * 28_000
    rows = [(1, "http://x/1", "one"), (2, url + "2", "two"), (3, url + "3", "one"), (4, "http://x/4", "four")]
    data = b"".join(warc.record("response", *r[:2], r[2].encode()) for r in rows)
    found = list(warc.salvage(io.BytesIO(data), len(data)))
    assert [(x[0], x[3]["warc-target-uri"]) for x in found] == [("record", r[1]) for r in rows]
    cut = data.replace(b"Content-Length", b"Content-Lost", 4)  # the first two records lose their lengths
    assert [x[0] for x in warc.salvage(io.BytesIO(cut), len(cut))] == ["gap", "record", "record"]
    # A member's header and a revisit's, by way of archives.
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x for x in warc.read_archives(warc.write_archives(pages, str(tmp_path / "w"))).collect()}
    assert {i: (x.gap, x.url) for i, x in got.items()} == {i: (None, u) for i, u, _ in rows} and got[1].refers_to == 3
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(x.page_id for x in warc.op7_warc_salvage(spark, str(tmp_path)).collect()) == [1, 2, 3, 4]


def test_gaps_are_rows_of_the_table(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"page {k} " * 50) for k in range(12)], "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(pages, str(tmp_path / "w"))
    path = archives.first().path
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2 : len(data) // 2 + 30] = b"\0" * 30
    open(path, "wb").write(data)
    rows = warc.read_archives(archives).collect()
    gaps = [x for x in rows if x.gap]
    assert gaps and len(rows) - len(gaps) >= 10 and sum(x.end - x.start for x in rows) == len(data)


def test_a_gap_in_a_fresh_archive_fails_the_query(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, f"http://x/{k}", f"page {k}") for k in range(6)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(warc, "member", lambda data, level=3: b"\x1f\x8b\x08 broken")
    with pytest.raises(Exception, match="a gap in"):
        warc.op7_warc_salvage(spark, str(tmp_path)).collect()


def test_folders_are_discarded(spark, tmp_path):
    from granary.llm import common, near_dedup

    since = common.mark()
    docs = spark.createDataFrame([(k, f"some words of a text that is number {k // 2} of them") for k in range(20)], "doc_id long, text string")
    found = near_dedup.near_duplicates(docs)
    left = common._folders[since:]
    assert len(left) == 1 and all(os.path.isdir(f.removeprefix("file:")) for f in left)
    assert len({x.class_id for x in found.collect()}) == 10
    common.discard(spark, since)
    assert not any(os.path.exists(f.removeprefix("file:")) for f in left) and common.mark() == since
    assert [common._number(x) for x in ("10000", "64m", "256MB", "-1", None)] == [10000, 64 << 20, 256 << 20, 0, 0]


def best_fit(sizes, capacity):
    rooms, out = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= sizes[k]]
        b = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(capacity)
        rooms[b] -= sizes[k]
        out[k] = b
    return out


def test_packing_equals_a_plain_best_fit():
    r = random.Random(8)
    for _ in range(200):
        capacity = r.randint(40, 100)
        sizes = [r.randint(1, 40) for _ in range(r.randint(0, 60))]
        assert sharding.pack(sizes, capacity) == best_fit(sizes, capacity)
    assert max(sharding.pack([60, 50, 50, 40], 100)) == 1
    assert sharding.pack([150, 20], 100) == [0, 1]


def test_packing_into_a_count_of_bins_is_even():
    r = random.Random(9)
    for bins in (1, 3, 8):
        sizes = [r.randint(1, 1000) for _ in range(3000)]
        load = collections.Counter()
        for s, b in zip(sizes, sharding.pack_into(sizes, bins)):
            load[b] += s
        assert len(load) == bins and max(load.values()) - min(load.values()) < 0.002 * sum(sizes) / bins
    assert sorted(sharding.pack_into([5, 4], 8)) == [0, 1] and sharding.pack_into([], 8) == []


def shards(spark, rows, count=8):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, shard int, whole string")
    got = sharding.shard(docs, count).collect()
    slots = collections.defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= b < count for b in slots)
    return got


def test_shards_are_even_and_keep_equal_texts_together(spark):
    r = random.Random(10)
    rows = [(k, r.choice(["a", "b"]) * r.randint(0, 400)) for k in range(600)] + [(600, None), (601, None), (602, ""), (None, "n"), (None, "n"), (7, "again"), (7, "again")]
    got = shards(spark, rows)
    load, where = collections.Counter(), collections.defaultdict(set)
    for x in got:
        load[x.shard] += x.size
        where[x.text_crc32, x.size].add(x.shard)
    assert max(load.values()) < 1.02 * sum(load.values()) / 8
    assert all(len(s) == 1 for (crc, size), s in where.items() if size > 1)
    assert sorted(x.size for x in got) == sorted(len((t or "").encode()) + 1 for _, t in rows)


def test_a_group_larger_than_a_shard_is_cut(spark):
    got = shards(spark, [(k, "hot copy of one text") for k in range(3000)] + [(k, f"other {k}") for k in range(3000, 6000)])
    load = collections.Counter()
    for x in got:
        load[x.shard] += x.size
    assert len(load) == 8 and max(load.values()) < 1.05 * min(load.values())


@pytest.mark.parametrize("same_id", [False, True])
def test_groups_of_many_rows_and_few_bytes(spark, monkeypatch, same_id):
    """Null texts, most rows of the table and few of its bytes, are numbered in pieces of bounded rows; also where one id (or none) has them all."""
    rows = [(None if same_id else k, None) for k in range(3000)] + [(k, f"text {k} " * 500) for k in range(3000, 3100)]
    seen = []
    original = sharding.settle

    def settle(df):
        done = original(df)
        if "part" in done.columns:
            seen.append(max(x["count"] for x in done.groupBy("whole", "part").count().collect()))
        return done

    monkeypatch.setattr(sharding, "settle", settle)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, place int")
    got = sharding.shard(docs, 8, rows_per_bundle=100).collect()
    assert seen[-1] <= 400
    slots = collections.defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({x.shard for x in got if x.size == 1}) == 1  # they are still one group


def test_few_rows_and_none(spark):
    shards(spark, [(1, "only")])
    shards(spark, [])
    got = sharding.op9_best_fit_shards(spark, SF)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and got.count() == 1000
