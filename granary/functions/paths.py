"""Paths as arrays of components, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    """The components of a path: empty ones and `.` vanish, `..` stays."""
    return F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))


def sort_key(path: Column) -> Column:
    """What paths are ordered by: component by component, so a/b comes before a-b."""
    return F.split(path, "/")


def root_parts(root: str) -> list[str]:
    return [x for x in root.split("/") if x not in ("", ".")]


def under(path: Column, root: str) -> Column:
    """Whether a path lies strictly below root, by components: /ab is not below /a."""
    own = root_parts(root)
    parts = components(path)
    if not own:
        return F.size(parts) > 0
    return (F.size(parts) > len(own)) & (F.slice(parts, 1, len(own)) == F.array(*map(F.lit, own)))


def relative(path: Column, root: str) -> Column:
    """The components of a path that lies below root, after those of root."""
    n = len(root_parts(root))
    parts = components(path)
    return F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0)))


def child(path: Column, root: str) -> Column:
    """The direct sub-folder of root that a file lies in, null for a file directly in root."""
    below = relative(path, root)
    return F.when(F.size(below) > 1, F.concat(F.lit(root.rstrip("/") + "/"), F.get(below, F.lit(0))))


def base_name(path: Column) -> Column:
    """The last non-empty part between slashes of either kind; the whole path if there is none."""
    return F.coalesce(F.try_element_at(F.filter(F.split(path, r"[\\/]"), lambda x: x != ""), F.lit(-1)), path)


def breadcrumbs(path: Column) -> Column:
    """Every prefix of a path, shortest first."""
    parts = components(path)
    lead = F.when(F.startswith(path, F.lit("/")), "/").otherwise("")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(lead, F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))


def depth(path: Column, root: str) -> Column:
    return F.size(components(path)) - len(root_parts(root))
