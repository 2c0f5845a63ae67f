"""Registered queries over the virtual corpus and the pages, and the same in DuckDB's SQL.

The SQL groups by whole texts where the queries go through digests, so that it is an independent check.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import formats, paths
from granary.operators import duplicates, reclaim, removal, scan, treemap
from granary.sources import file_tree
from granary.sources import inventory as inv

ROOT = "/corpus"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_FILES = """
files AS (
  SELECT '/corpus/' || source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS path, text AS content, 1::BIGINT AS dev,
    (CASE WHEN doc_id % 3 = 0 THEN min(doc_id) OVER (PARTITION BY text) ELSE doc_id END)::BIGINT AS inode,
    octet_length(encode(text))::BIGINT AS logical_size FROM documents
  UNION ALL
  SELECT '/corpus/item_' || lpad(item_id::VARCHAR, 8, '0') || '.txt', text, 1, (1000000000 + item_id)::BIGINT, octet_length(encode(text))::BIGINT FROM benchmark
), inv AS (
  SELECT *, (ceil(logical_size / 4096.0) * 4096)::BIGINT AS size, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM files
)"""
_PAGES = """
inv AS (
  SELECT '/' || regexp_replace(regexp_replace(url, '^[^:/]*://', ''), '[?#].*$', '') AS path, html AS content, octet_length(encode(html))::BIGINT AS logical_size,
    (ceil(octet_length(encode(html)) / 4096.0) * 4096)::BIGINT AS size FROM pages
)"""


def _single(least: int = 1) -> str:
    """Files of at least `least` bytes with hard links collapsed, and their groups by text."""
    return f"""
single AS (
  SELECT * FROM inv WHERE logical_size >= {least} AND logical_size > 0
  QUALIFY row_number() OVER (PARTITION BY dev, inode, logical_size ORDER BY string_split(path, '/')) = 1
), grouped AS (
  SELECT content, logical_size AS size, count(*) AS n, arg_min(path, string_split(path, '/')) AS keep, (logical_size * (count(*) - 1))::BIGINT AS wasted,
    list(path ORDER BY string_split(path, '/')) AS files, sha256(content) AS hash
  FROM single GROUP BY content, logical_size HAVING count(*) > 1
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _totals_sql(where: str, source: str = _FILES) -> str:
    return f"""WITH {source} SELECT coalesce(sum(size), 0)::BIGINT AS total_size, count(*) AS total_files FROM inv WHERE {where}"""


def _short(df: DataFrame) -> DataFrame:
    return scan.totals(df).select("total_size", "total_files")


@query(f"WITH {_FILES} SELECT sum(size)::BIGINT AS total_size, count(*) AS total_files, coalesce(sum(size) FILTER (len(parts) = 2), 0)::BIGINT AS root_files_size, count(*) FILTER (len(parts) = 2) AS root_files_count FROM inv")
def scan_totals(spark, sf_dir):
    return scan.totals(inv.corpus(spark, sf_dir)).select("total_size", "total_files", "root_files_size", "root_files_count")


@query(f"""WITH {_FILES} SELECT count(*) AS total_dirs FROM (
  SELECT DISTINCT array_to_string(list_slice(parts, 2, k), '/') AS folder FROM (SELECT parts, unnest(range(2, len(parts))) AS k FROM inv))""")
def scan_total_dirs(spark, sf_dir):
    return scan.folder_count(inv.corpus(spark, sf_dir), ROOT)


_CHILDREN = "SELECT '/corpus/' || parts[2] AS path, sum(size)::BIGINT AS size, count(*) AS file_count FROM inv WHERE len(parts) > 2 GROUP BY 1"


@query(f"WITH {_FILES} {_CHILDREN} ORDER BY size DESC, path LIMIT 20")
def scan_children_topk(spark, sf_dir):
    return scan.children(inv.corpus(spark, sf_dir), ROOT, 20)


@query(f"WITH {_FILES} SELECT path, size, logical_size FROM inv ORDER BY size DESC, path LIMIT 20")
def scan_top_files(spark, sf_dir):
    return scan.top_files(inv.corpus(spark, sf_dir), 20)


@query(f"""WITH {_FILES} SELECT child, rank, path, size FROM (
  SELECT '/corpus/' || parts[2] AS child, path, size, row_number() OVER (PARTITION BY parts[2] ORDER BY size DESC, path)::INT AS rank FROM inv WHERE len(parts) > 2) WHERE rank <= 3""")
def scan_top_files_per_child(spark, sf_dir):
    return scan.top_files_per_child(inv.corpus(spark, sf_dir), ROOT, 3)


@query(_totals_sql("NOT list_contains(parts, 'de')"))
def scan_exclude_component(spark, sf_dir):
    return _short(scan.select(inv.corpus(spark, sf_dir), ["de"]))


@query(_totals_sql("NOT (path LIKE '%7.txt' OR len(list_filter(parts, lambda x: x LIKE '%7.txt')) > 0)"))
def scan_exclude_star(spark, sf_dir):
    return _short(scan.select(inv.corpus(spark, sf_dir), ["*7.txt"]))


@query(_totals_sql("len(list_filter(parts, lambda x: x LIKE 'src_')) = 0"))
def scan_exclude_question(spark, sf_dir):
    return _short(scan.select(inv.corpus(spark, sf_dir), ["src?"]))


@query(_totals_sql("len(list_filter(parts, lambda x: regexp_full_match(x, 'src1[0-4]'))) = 0"))
def scan_exclude_class(spark, sf_dir):
    return _short(scan.select(inv.corpus(spark, sf_dir), ["src1[0-4]"]))


@query(_totals_sql("len(list_filter(parts, lambda x: x = 'fr' OR x = 'es')) = 0"))
def scan_exclude_brace(spark, sf_dir):
    return _short(scan.select(inv.corpus(spark, sf_dir), ["{fr,es}"]))


@query(_totals_sql("len(list_filter(parts, lambda x: x = 'en' OR x = 'src3' OR x LIKE 'item%')) = 0 AND NOT regexp_full_match(path, '(.*/)?src4/.*')"))
def scan_exclude_multi(spark, sf_dir):
    return _short(scan.select(inv.corpus(spark, sf_dir), ["en", "[bad", "src3", "item*", "**/src4/**"]))


@query(_totals_sql("NOT list_contains(parts, 'corpus')"))
def scan_exclude_root_component(spark, sf_dir):
    return _short(scan.select(inv.corpus(spark, sf_dir), ["corpus"]))


@query(_totals_sql("len(parts) - 1 <= 1"))
def scan_max_depth(spark, sf_dir):
    return _short(scan.select(inv.corpus(spark, sf_dir), max_depth=1))


@query(f"WITH {_FILES} SELECT '/corpus/src1/' || parts[3] AS path, sum(size)::BIGINT AS size, count(*) AS file_count FROM inv WHERE parts[2] = 'src1' AND len(parts) > 3 GROUP BY 1")
def scan_drilldown(spark, sf_dir):
    return scan.children(inv.below(inv.corpus(spark, sf_dir), "/corpus/src1"), "/corpus/src1")


@query(f"WITH {_PAGES} SELECT '/' || string_split(path, '/')[2] AS path, sum(size)::BIGINT AS size, count(*) AS file_count FROM inv WHERE len(list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.')) > 1 GROUP BY 1 ORDER BY size DESC, path LIMIT 50")
def scan_children_per_host(spark, sf_dir):
    return scan.children(inv.web_pages(spark, sf_dir), "/", 50)


@query(f"""WITH {_FILES}, c AS ({_CHILDREN} ORDER BY size DESC, path LIMIT 20), t AS (SELECT path, size FROM inv ORDER BY size DESC, path LIMIT 20)
SELECT '/corpus' AS root, (SELECT sum(size) FROM inv)::BIGINT AS total_size, (SELECT count(*) FROM inv) AS total_files,
  (SELECT string_agg(path || '=' || size || '/' || file_count, ';' ORDER BY size DESC, path) FROM c) AS children, (SELECT string_agg(path || '=' || size, ';' ORDER BY size DESC, path) FROM t) AS top_files""")
def scan_report(spark, sf_dir):
    r = scan.report(inv.corpus(spark, sf_dir), ROOT, 20)
    text = lambda c, *more: F.array_join(F.transform(c, lambda x: F.concat(x["path"], F.lit("="), x["size"].cast("string"), *(F.concat(F.lit("/"), x[m].cast("string")) for m in more))), ";").alias(c)
    return r.select("root", "total_size", "total_files", text("children", "file_count"), text("top_files"))


@query(f"WITH {_FILES} SELECT logical_size, count(*) AS n FROM inv WHERE logical_size > 0 GROUP BY 1 HAVING count(*) > 1")
def dup_size_buckets(spark, sf_dir):
    return duplicates.size_buckets(inv.corpus(spark, sf_dir))


@query(f"WITH {_FILES} SELECT path, logical_size FROM inv WHERE logical_size > 0 AND logical_size IN (SELECT logical_size FROM inv GROUP BY 1 HAVING count(*) > 1)")
def dup_size_candidates(spark, sf_dir):
    return duplicates.candidates(inv.corpus(spark, sf_dir), "path").select("path", "logical_size")


@query(f"WITH {_FILES} SELECT logical_size, sha256(encode(content)[1:4096]) AS prefix, count(*) AS n FROM inv WHERE logical_size > 0 GROUP BY logical_size, encode(content)[1:4096] HAVING count(*) > 1")
def dup_prefix_buckets(spark, sf_dir):
    return duplicates.prefix_buckets(inv.corpus(spark, sf_dir))


@query(f"WITH {_FILES}, {_single()} SELECT logical_size, path FROM single")
def hardlink_collapse(spark, sf_dir):
    return duplicates.without_hard_links(duplicates.at_least(inv.corpus(spark, sf_dir, identity=True)))


def _members(spark, sf_dir, least: int = 1):
    return duplicates.members(inv.corpus(spark, sf_dir, identity=True), least)


_GROUP = "hash, size, n, array_to_string(files, ' ; ') AS files, wasted"


def _grouped(found: DataFrame) -> DataFrame:
    return duplicates.groups(found).select("hash", "size", F.size("files").cast("long").alias("n"), F.array_join("files", " ; ").alias("files"), "wasted")


@query(f"WITH {_FILES}, {_single()} SELECT {_GROUP} FROM grouped")
def dup_groups(spark, sf_dir):
    return _grouped(_members(spark, sf_dir))


@query(f"WITH {_FILES}, {_single(4096)} SELECT {_GROUP} FROM grouped")
def dup_groups_min_size(spark, sf_dir):
    return _grouped(_members(spark, sf_dir, 4096))


@query(f"WITH {_FILES}, {_single()} SELECT hash, size, unnest(files) AS path, keep, n, wasted FROM grouped")
def dup_members(spark, sf_dir):
    return _members(spark, sf_dir)


@query(f"WITH {_PAGES} SELECT count(*) AS n FROM (SELECT content FROM inv WHERE logical_size > 0 GROUP BY content HAVING count(*) > 1)")
def dup_none_in_pages(spark, sf_dir):
    return duplicates.summaries(duplicates.members(inv.web_pages(spark, sf_dir))).agg(F.count("*").alias("n"))


@query(f"WITH {_FILES}, {_single()} SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS files, coalesce(sum(wasted), 0)::BIGINT AS wasted FROM grouped")
def dup_total_wasted(spark, sf_dir):
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return duplicates.summaries(_members(spark, sf_dir)).agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"), zero("wasted"))


def _ranked(column: str, limit: int, where: str = "true") -> str:
    return f"WITH {_FILES}, {_single()} SELECT row_number() OVER (ORDER BY {column} DESC, keep)::INT AS rank, hash, size, n, keep, wasted FROM (SELECT * FROM grouped WHERE {where}) QUALIFY rank <= {limit}"


@query(_ranked("wasted", 1000))
def dup_sorted_by_wasted(spark, sf_dir):
    return duplicates.shown(_members(spark, sf_dir))


@query(_ranked("size", 25))
def dup_sorted_by_size(spark, sf_dir):
    return duplicates.shown(_members(spark, sf_dir), by="size", limit=25)


@query(_ranked("n", 25))
def dup_sorted_by_count(spark, sf_dir):
    return duplicates.shown(_members(spark, sf_dir), by="count", limit=25)


@query(_ranked("wasted", 1000, "len(list_filter(files, lambda f: contains(lower(f), 'src1/'))) > 0"))
def dup_filter_substring(spark, sf_dir):
    return duplicates.shown(_members(spark, sf_dir), text="SRC1/")


@query(f"WITH {_FILES}, {_single()} SELECT left(hash, 12) AS shown, n, size, wasted FROM grouped")
def dup_hash_display(spark, sf_dir):
    return duplicates.summaries(_members(spark, sf_dir)).select(F.substring("hash", 1, 12).alias("shown"), "n", "size", "wasted")


# Of groups of an even size, the last path is kept instead of the first.
_OVERRIDE = "chosen AS (SELECT hash, files[-1] AS other FROM grouped WHERE size % 2 = 0)"


@query(f"WITH {_FILES}, {_single()}, {_OVERRIDE} SELECT g.hash, coalesce(c.other, g.keep) AS keep, g.n FROM grouped g LEFT JOIN chosen c ON g.hash = c.hash")
def dup_keep_override(spark, sf_dir):
    found = _members(spark, sf_dir)
    chosen = found.filter("size % 2 = 0").groupBy("hash").agg(F.max_by("path", paths.sort_key(F.col("path"))).alias("keep"))
    return duplicates.summaries(duplicates.keep_instead(found, chosen)).select("hash", "keep", "n")


@query(f"WITH {_FILES}, {_single()} SELECT hash, keep, unnest(list_slice(files, 2, n)) AS remove, size FROM grouped")
def reclaim_plan(spark, sf_dir):
    return reclaim.plan(_members(spark, sf_dir))


@query(f"WITH {_FILES}, {_single()} SELECT keep, size, array_to_string(list_sort(list_slice(files, 2, n)), ' ; ') AS remove FROM grouped")
def reclaim_jobs(spark, sf_dir):
    return reclaim.jobs(_members(spark, sf_dir)).select("keep", "size", F.array_join("remove", " ; ").alias("remove"))


@query(f"WITH {_FILES}, {_single()} SELECT coalesce(sum(n - 1), 0)::BIGINT AS removed, coalesce(sum(wasted), 0)::BIGINT AS reclaimed FROM grouped")
def reclaim_dry_run(spark, sf_dir):
    return reclaim.dry_run(reclaim.plan(_members(spark, sf_dir)))


@query(f"""WITH {_FILES}, own AS (SELECT * FROM inv WHERE parts[2] = 'src2')
SELECT '/corpus/src2' AS root, count(*) AS files, (1 + count(DISTINCT parts[3]))::BIGINT AS dirs, coalesce(sum(size), 0)::BIGINT AS bytes FROM own""")
def remove_dry_run(spark, sf_dir):
    return removal.dry_run(inv.corpus(spark, sf_dir), "/corpus/src2")


@query(f"""WITH {_FILES}, f AS (SELECT DISTINCT k AS depth, array_to_string(list_slice(parts, 2, k + 1), '/') AS folder FROM (SELECT parts, unnest(range(1, len(parts) - 1)) AS k FROM inv))
SELECT depth::INT AS depth, count(*) AS dirs FROM f GROUP BY 1""")
def rmdir_levels(spark, sf_dir):
    return removal.levels(inv.corpus(spark, sf_dir), ROOT)


def _sizes_of(spark, sf_dir):
    """Sizes over all units: lengths of the files times powers of 1000."""
    n = inv.corpus(spark, sf_dir).select("logical_size").distinct()
    return n.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: (F.col("logical_size") * F.pow(F.lit(1000), k)).cast("long"))).alias("bytes")).distinct()


_SIZES = f"WITH {_FILES}, b AS (SELECT DISTINCT (logical_size * (1000 ** k))::BIGINT AS bytes FROM inv, range(0, 5) r(k))"
_UNIT = "CASE WHEN bytes < 1024 THEN 0 WHEN bytes < 1024**2 THEN 1 WHEN bytes < 1024**3 THEN 2 WHEN bytes < 1024**4 THEN 3 WHEN bytes < 1024**5 THEN 4 ELSE 5 END"


@query(f"{_SIZES} SELECT bytes, CASE WHEN bytes < 1024 THEN bytes || ' B' ELSE printf('%.1f', bytes / (1024.0 ** ({_UNIT}))) || ' ' || (['B','KB','MB','GB','TB','PB'])[({_UNIT}) + 1] END AS shown FROM b")
def human_size(spark, sf_dir):
    return _sizes_of(spark, sf_dir).select("bytes", formats.human_size(F.col("bytes")).alias("shown"))


@query(f"{_SIZES} SELECT bytes, CASE WHEN bytes < 1024 THEN bytes || ' B' ELSE printf('%.1f', floor(bytes / (1024.0 ** ({_UNIT})) * 10 + 0.5) / 10) || ' ' || (['B','KB','MB','GB','TB','PB'])[({_UNIT}) + 1] END AS shown FROM b")
def human_size_up(spark, sf_dir):
    return _sizes_of(spark, sf_dir).select("bytes", formats.human_size_up(F.col("bytes")).alias("shown"))


_URLS = "SELECT DISTINCT url FROM pages WHERE url IS NOT NULL"


@query(f"SELECT url, array_to_string(list_filter(string_split(url, '/'), lambda x: x <> '' AND x <> '.'), ' ; ') AS parts FROM ({_URLS})")
def path_components(spark, sf_dir):
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").filter("url is not null").distinct()
    return urls.select("url", F.array_join(paths.components(F.col("url")), " ; ").alias("parts"))


@query(f"SELECT url, coalesce(list_filter(string_split(url, '/'), lambda x: x <> '')[-1], url) AS name FROM ({_URLS})")
def path_base_name(spark, sf_dir):
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").filter("url is not null").distinct()
    return urls.select("url", paths.base_name(F.col("url")).alias("name"))


@query(f"WITH {_FILES} SELECT path, array_to_string(list_transform(range(1, len(parts) + 1), lambda k: '/' || array_to_string(list_slice(parts, 1, k), '/')), ' ; ') AS crumbs FROM inv")
def path_breadcrumbs(spark, sf_dir):
    return inv.corpus(spark, sf_dir).select("path", F.array_join(paths.breadcrumbs(F.col("path")), " ; ").alias("crumbs"))


# Paths whose order by components is not that of their bytes.
@query("""WITH p AS (SELECT DISTINCT source || s || lang AS path FROM documents, (VALUES ('/'), ('-'), ('/x/'), ('.')) v(s))
SELECT path, row_number() OVER (ORDER BY string_split(path, '/'))::INT AS rank FROM p""")
def path_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang").distinct()
    p = docs.select(F.explode(F.array(*(F.concat("source", F.lit(s), "lang") for s in ("/", "-", "/x/", ".")))).alias("path")).distinct()
    return p.select("path", F.row_number().over(Window.orderBy(paths.sort_key(F.col("path")))).alias("rank"))


@query(f"WITH {_FILES}, c AS ({_CHILDREN} ORDER BY size DESC, path LIMIT 20) SELECT path, greatest(2.0, 100.0::DOUBLE * size / max(size) OVER ())::DOUBLE AS width FROM c")
def bar_width(spark, sf_dir):
    top = scan.children(inv.corpus(spark, sf_dir), ROOT, 20)
    return top.select("path", formats.bar_width(F.col("size"), F.max("size").over(Window.partitionBy())).alias("width"))  # of 20 rows


@query(f"WITH {_FILES} SELECT path, size AS total, logical_size AS used, round_even((size - (size - logical_size))::DOUBLE / size * 100, 0)::INT AS percent FROM inv WHERE size > 0")
def percent_used(spark, sf_dir):
    i = inv.corpus(spark, sf_dir).filter("size > 0")
    return i.select("path", F.col("size").alias("total"), F.col("logical_size").alias("used"), formats.percent_used(F.col("size"), F.col("size") - F.col("logical_size")).alias("percent"))


@query(f"WITH {_FILES} SELECT path, size FROM inv ORDER BY size DESC, path LIMIT 40 OFFSET 94")
def page_of_files(spark, sf_dir):
    return scan.page(inv.corpus(spark, sf_dir).select("path", "size"), 94, 40, F.desc("size"), "path")


@query()
def treemap_tiles(spark, sf_dir):
    top = scan.children(inv.corpus(spark, sf_dir), ROOT, 20).withColumn("root", F.lit(ROOT))
    return treemap.treemap(top)


# A real directory tree that the table nation describes: r<region>/.n<nation> with a text of its own, a file that is the same for all of
# a region, a link to the folder above it, for some nations a link beside it to that file, and for some a link to nothing.
SAME_BYTES = 5000


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """The folder of that tree, made anew in a folder that executors see; it goes when the application ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or ""
    shared = shared.removeprefix("file:") if shared.startswith(("/", "file:")) else None
    root = tempfile.mkdtemp(prefix="granary-tree-", dir=shared if shared and os.path.isdir(shared) else None)
    atexit.register(shutil.rmtree, root, True)
    for k, name, region in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").toLocalIterator():
        folder = f"{root}/r{region}/.n{k}"
        os.makedirs(folder)
        with open(f"{folder}/{name}.txt", "w") as f:
            f.write(name * (k % 5 + 1))
        with open(f"{folder}/same.bin", "w") as f:
            f.write(str(region) * SAME_BYTES)
        os.symlink("..", f"{folder}/up")
        if k % 4 == 0:
            os.symlink(f".n{k}/same.bin", f"{root}/r{region}/to{k}")
        if k % 5 == 0:
            os.symlink("nowhere", f"{root}/r{region}/gone{k}")
    return root


def _below(root: str) -> Column:
    return F.substring("path", len(root) + 2, 1 << 30).alias("path")


_LIVE = f"""live AS (
  SELECT 'r' || n_regionkey || '/.n' || n_nationkey || '/' || n_name || '.txt' AS path, n_name AS content, (octet_length(encode(n_name)) * (n_nationkey % 5 + 1))::BIGINT AS logical_size FROM nation
  UNION ALL SELECT 'r' || n_regionkey || '/.n' || n_nationkey || '/same.bin', repeat(n_regionkey::VARCHAR, {SAME_BYTES}), {SAME_BYTES} * length(n_regionkey::VARCHAR) FROM nation
)"""


@query(f"""WITH {_LIVE} SELECT path, 'file' AS entry_type, 3 AS depth, logical_size FROM live
UNION ALL SELECT DISTINCT 'r' || n_regionkey, 'dir', 1, NULL::BIGINT FROM nation UNION ALL SELECT 'r' || n_regionkey || '/.n' || n_nationkey, 'dir', 2, NULL FROM nation""")
def tree_walk(spark, sf_dir):
    root = _tree(spark, sf_dir)
    return file_tree.read(spark, root).select(_below(root), "entry_type", "depth", "logical_size")


@query("""SELECT 2 * count(*) + count(*) FILTER (n_nationkey % 4 = 0) AS total_files, count(*) + count(DISTINCT n_regionkey) AS total_dirs, count(*) + count(*) FILTER (n_nationkey % 5 = 0) AS skipped FROM nation""")
def tree_walk_followed(spark, sf_dir):
    return scan.totals(file_tree.read(spark, _tree(spark, sf_dir), file_tree.Options(follow_symlinks=True))).select("total_files", "total_dirs", "skipped")


@query("""SELECT count(*) FILTER (n_regionkey <> 3) AS total_files, count(*) FILTER (n_regionkey <> 3) + count(DISTINCT n_regionkey) FILTER (n_regionkey <> 3) AS total_dirs FROM nation""")
def tree_walk_pruned(spark, sf_dir):
    return scan.totals(file_tree.read(spark, _tree(spark, sf_dir), file_tree.parse_options(" *.txt, ,r3", "3"))).select("total_files", "total_dirs")


@query("""SELECT count(*) AS specials, count(*) FILTER (starts_with(path, 'to')) AS to_files, count(*) FILTER (starts_with(path, 'gone')) AS to_nothing FROM (
  SELECT 'up' AS path FROM nation UNION ALL SELECT 'to' FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'gone' FROM nation WHERE n_nationkey % 5 = 0)""")
def tree_walk_links(spark, sf_dir):
    links = file_tree.read(spark, _tree(spark, sf_dir), file_tree.Options(include_special=True)).filter("entry_type = 'special'").select(paths.base_name(F.col("path")).alias("name"))
    return links.agg(F.count("*").alias("specials"), F.count_if(F.startswith("name", F.lit("to"))).alias("to_files"), F.count_if(F.startswith("name", F.lit("gone"))).alias("to_nothing"))


@query(f"""WITH {_LIVE} SELECT sha256(content) AS hash, logical_size AS size, count(*) AS n, (logical_size * (count(*) - 1))::BIGINT AS wasted, arg_min(path, string_split(path, '/')) AS keep
FROM live GROUP BY content, logical_size HAVING count(*) > 1""")
def tree_dup_groups(spark, sf_dir):
    root = _tree(spark, sf_dir)
    found = duplicates.summaries(duplicates.members(file_tree.read(spark, root)))
    return found.select("hash", "size", "n", "wasted", F.substring("keep", len(root) + 2, 1 << 30).alias("keep"))
