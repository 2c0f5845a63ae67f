"""Exclude globs: case-sensitive, `*` and `?` also match `/`, anchored at both ends.

A path is excluded if a glob matches all of it or one of its components, those of the scanned root included. Invalid globs are
ignored by exclusion, and reported by validate_globs().
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set("\\.^$|()[]{}*+?&~#-")


class BadGlob(ValueError):
    pass


def _literal(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def _class(glob: str, i: int) -> tuple[str, int]:
    """The regular expression of a class that opens at i, and the index behind it."""
    j = i + 1
    negated = j < len(glob) and glob[j] in "!^"
    j += negated
    items, first = [], True
    while True:
        if j >= len(glob):
            raise BadGlob("a class is not closed")
        c = glob[j]
        if c == "]" and not first:
            break
        first = False
        if j + 2 < len(glob) and glob[j + 1] == "-" and glob[j + 2] != "]":
            if glob[j + 2] < c:
                raise BadGlob("a range is upside down")
            items.append(f"{_literal(c)}-{_literal(glob[j + 2])}")
            j += 3
        else:
            items.append(_literal(c))
            j += 1
    return f"[{'^' if negated else ''}{''.join(items)}]", j + 1


def to_regex(glob: str) -> str:
    """The regular expression (for Java and Python) of one glob, without anchors; BadGlob if it is invalid."""
    if glob == "**":
        return ".*"
    out, i, braces = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            j = i
            while j < len(glob) and glob[j] == "*":
                j += 1
            alone = j - i == 2 and (i == 0 or glob[i - 1] == "/") and (j == len(glob) or glob[j] == "/")
            if not alone:
                out.append(".*")
            elif i == 0:  # **/ before anything
                out.append("(?:/?|.*/)")
                j += 1
            elif j == len(glob):  # /** at the end
                out.append(".*")
            else:  # /**/ between: the slash before is written already
                out.append("(?:|.*/)")
                j += 1
            i = j
        elif c == "?":
            out.append(".")
            i += 1
        elif c == "[":
            text, i = _class(glob, i)
            out.append(text)
        elif c == "{":
            braces += 1
            out.append("(?:")
            i += 1
        elif c == "}":
            if not braces:
                raise BadGlob("a brace closes that was not opened")
            braces -= 1
            out.append(")")
            i += 1
        elif c == "," and braces:
            out.append("|")
            i += 1
        elif c == "\\":
            if i + 1 >= len(glob):
                raise BadGlob("nothing follows a backslash")
            out.append(_literal(glob[i + 1]))
            i += 2
        else:
            out.append(_literal(c))
            i += 1
    if braces:
        raise BadGlob("a brace is not closed")
    text = "".join(out)
    while (fixed := re.sub(r"\(\?:\|(?!\.\*/\))|\|\|", lambda m: "(?:" if m[0].startswith("(") else "|", text)) != text:  # an empty branch counts as none
        text = fixed
    return re.sub(r"\|\)(?!/)", ")", text)


def validate_globs(patterns: list[str]) -> list[str]:
    """The invalid ones of patterns, in their order."""
    bad = []
    for p in patterns:
        try:
            to_regex(p)
        except BadGlob:
            bad.append(p)
    return bad


def matcher(patterns: list[str]) -> str | None:
    """One anchored regular expression for all valid globs; None if there is none."""
    bad = set(validate_globs(patterns))
    good = [to_regex(p) for p in patterns if p not in bad]
    return rf"(?s)\A(?:{'|'.join(good)})\z" if good else None


def is_excluded(path: str, compiled: re.Pattern | None) -> bool:
    """For one path in Python, as the file walk needs it; compiled: compile_python(patterns)."""
    return compiled is not None and (bool(compiled.match(path)) or any(compiled.match(x) for x in path.split("/") if x not in ("", ".")))


def compile_python(patterns: list[str]) -> re.Pattern | None:
    text = matcher(patterns)
    return re.compile(text.replace(r"\z", r"\Z")) if text else None


def excluded(path: Column, patterns: list[str]) -> Column:
    """For a column of paths."""
    text = matcher(patterns)
    if text is None:
        return F.lit(False)
    return path.rlike(text) | F.exists(F.split(path, "/"), lambda x: ~x.isin("", ".") & x.rlike(text))
