"""A squarified treemap of the children of a scan: rectangles of areas in proportion to sizes, as near to squares as it goes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.shipping import ship

WIDTH, HEIGHT = 800.0, 300.0
#: A side that is left of at most this many pixels ends the layout.
LEAST_SIDE = 0.5


def _ratio(side: float, total: float, least: float, most: float) -> float:
    """The worst ratio of sides in a strip along side, of areas total together, least and most."""
    return max(side * side * most / (total * total), total * total / (side * side * least))


def layout(sizes: list[float], width: float = WIDTH, height: float = HEIGHT) -> list[tuple[float, float, float, float]]:
    """(x, y, w, h) of each size, in the given order (largest first gives the best shapes). Sizes past the end of the room get none."""
    whole = sum(sizes)
    areas = [s * width * height / whole for s in sizes] if whole else []
    left, top, out, k = 0.0, 0.0, [], 0
    while k < len(areas) and min(width, height) > LEAST_SIDE:
        across = width >= height
        side = width if across else height
        end, total, least, most = k + 1, areas[k], areas[k], areas[k]
        while end < len(areas):
            grown = (total + areas[end], min(least, areas[end]), max(most, areas[end]))
            if _ratio(side, *grown) > _ratio(side, total, least, most):
                break
            total, least, most = grown
            end += 1
        thick, along = total / side, 0.0
        for a in areas[k:end]:
            out.append((left + along, top, a / thick, thick) if across else (left, top + along, thick, a / thick))
            along += a / thick
        if across:
            top, height = top + thick, height - thick
        else:
            left, width = left + thick, width - thick
        k = end
    return out


def treemap(children: DataFrame, width: float = WIDTH, height: float = HEIGHT, root_col: str = "root") -> DataFrame:
    """(root, path, size, x, y, w, h): the tiles of each root's children (root, path, size): at most top n rows a root, as scan gives them."""

    def tiles(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "path"], ascending=[False, True])
        placed = layout(frame["size"].astype(float).tolist(), width, height)
        out = frame.head(len(placed)).copy()
        out[["x", "y", "w", "h"]] = placed if placed else [[0.0] * 4] * 0
        return out[["root", "path", "size", "x", "y", "w", "h"]]

    ship(children.sparkSession)
    rows = children.select(F.col(root_col).alias("root"), "path", F.col("size").cast("long").alias("size")).filter("size > 0")
    return rows.groupBy("root").applyInPandas(tiles, "root string, path string, size long, x double, y double, w double, h double")
