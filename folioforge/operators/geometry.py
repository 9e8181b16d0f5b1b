"""Page geometry: rows, columns and line grids out of positioned text; one page at a time, pages in parallel.

A page holds a few hundred items, so a page is a group; everything else is partitioned by document and page.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame

PAGE = ["doc_id", "page"]


def clusters(values: Iterable[float], tolerance: float) -> list[list[int]]:
    """Positions of sorted values, joined while within tolerance of the running mean."""
    out: list[list[int]] = []
    mean = 0.0
    for position, value in enumerate(values):
        if out and abs(value - mean) <= tolerance:
            out[-1].append(position)
            mean += (value - mean) / len(out[-1])
        else:
            out.append([position])
            mean = value
    return out


def visual_rows(items: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """doc_id, page, row, segment and text. items: doc_id, page, text, x, y, width, height.

    Items at about one height are a row; a gap above 1.2 heights (8 at least) begins a new segment.
    """

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y", "x"], kind="stable").reset_index(drop=True)
        out = []
        for number, places in enumerate(clusters(page["y"], tolerance)):
            row = page.loc[places].sort_values("x", kind="stable")
            end, segment = None, -1
            for item in row.itertuples():
                if end is None or item.x - end > max(1.2 * item.height, 8.0):
                    segment += 1
                    out.append([item.doc_id, item.page, number, segment, item.text])
                else:
                    out[-1][4] += item.text
                end = item.x + item.width
        return pd.DataFrame(out, columns=["doc_id", "page", "row", "segment", "text"])

    schema = f"doc_id {items.schema['doc_id'].dataType.simpleString()}, page int, row int, segment int, text string"
    return items.groupBy(*PAGE).applyInPandas(run, schema)


def column_centres(items: DataFrame, tolerance: float = 12.0, least: int = 2) -> DataFrame:
    """doc_id, page, centre and n: x positions that several items share."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        xs = page["x"].sort_values().tolist()
        found = [[xs[i] for i in c] for c in clusters(xs, tolerance) if len(c) >= least]
        return pd.DataFrame([(page["doc_id"].iloc[0], page["page"].iloc[0], round(sum(c) / len(c), 2), len(c)) for c in found], columns=["doc_id", "page", "centre", "n"])

    schema = f"doc_id {items.schema['doc_id'].dataType.simpleString()}, page int, centre double, n int"
    return items.groupBy(*PAGE).applyInPandas(run, schema)


def centres(values: Iterable[float], tolerance: float = 2.0) -> list[int]:
    """Whole centres of the clusters of values."""
    ordered = sorted(values)
    return [math.floor(sum(ordered[i] for i in c) / len(c) + 0.5) for c in clusters(ordered, tolerance)]


def line_grids(lines: DataFrame, gap: float = 2.0) -> DataFrame:
    """doc_id, page, x0, y0, x1, y1, horizontal, vertical: boxes of touching lines that can be a table.

    lines: doc_id, page, x0, y0, x1, y1 (axis-aligned). A table has two lines of each direction, three places across and
    three down at least, and is 80 wide and 40 high.
    """

    def box_of(part: pd.DataFrame) -> tuple | None:
        flat = (part["x1"] - part["x0"]) >= (part["y1"] - part["y0"])
        across, down = part[flat], part[~flat]
        if len(across) < 2 or len(down) < 2:
            return None
        xs, ys = centres([*down["x0"], *down["x1"]]), centres([*across["y0"], *across["y1"]])
        if len(xs) < 3 or len(ys) < 3 or xs[-1] - xs[0] < 80 or ys[-1] - ys[0] < 40:
            return None
        return float(xs[0]), float(ys[0]), float(xs[-1]), float(ys[-1]), len(across), len(down)

    def run(page: pd.DataFrame) -> pd.DataFrame:
        boxes = page[["x0", "y0", "x1", "y1"]].to_numpy()
        root = list(range(len(boxes)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, a in enumerate(boxes):
            for j, b in enumerate(boxes[:i]):
                if a[0] <= b[2] + gap and b[0] <= a[2] + gap and a[1] <= b[3] + gap and b[1] <= a[3] + gap:
                    root[find(i)] = find(j)
        parts = page.assign(part=[find(i) for i in range(len(boxes))]).groupby("part")
        found = [box_of(part) for _, part in parts]
        return pd.DataFrame([(page["doc_id"].iloc[0], page["page"].iloc[0], *b) for b in found if b], columns=["doc_id", "page", "x0", "y0", "x1", "y1", "horizontal", "vertical"])

    schema = f"doc_id {lines.schema['doc_id'].dataType.simpleString()}, page int, x0 double, y0 double, x1 double, y1 double, horizontal int, vertical int"
    return lines.groupBy(*PAGE).applyInPandas(run, schema)
