"""Whole reading-order strategies of a page: table islands, columns, recursive cuts, and a choice between them."""

from __future__ import annotations

from collections import Counter
from statistics import median

from pyspark.sql import DataFrame

from leafline.operators.covers import BOXES, xy_cut
from leafline.operators.pages import by_page

Boxes = list[tuple[int, float, float, float, float]]


def clusters(values: list[float], tolerance: float) -> list[int]:
    """Cluster number of each value: sorted values join a cluster while they are near its running mean."""
    order = sorted(range(len(values)), key=lambda i: values[i])
    out, mean, size, number = [0] * len(values), 0.0, 0, -1
    for i in order:
        if number < 0 or abs(values[i] - mean) > tolerance:
            number, mean, size = number + 1, values[i], 1
        else:
            size += 1
            mean += (values[i] - mean) / size
        out[i] = number
    return out


def table_island(boxes: Boxes) -> list[int] | None:
    """Row-major order if the page is a grid: three rows or more, of which most have three cells or more in repeated slots."""
    if len(boxes) < 9:
        return None
    height = median(b[4] - b[2] for b in boxes)
    rows = clusters([(b[2] + b[4]) / 2 for b in boxes], max(2.0, 0.5 * height))
    sizes = Counter(rows)
    slots = Counter(clusters([b[1] for b in boxes], 12.0))
    full = [r for r, n in sizes.items() if n >= 3]
    if len(full) < 3 or 2 * len(full) < len(sizes) or sum(n >= 3 for n in slots.values()) < 3:
        return None
    return [b[0] for _, b in sorted(zip(rows, boxes, strict=True), key=lambda x: (x[0], x[1][1], x[1][0]))]


def columns_of(boxes: Boxes, page_width: float) -> list[tuple[float, float]]:
    """Left and right ends of columns: left edges that repeat, at most three, each with a fifth of the narrow boxes."""
    narrow = [b for b in boxes if b[3] - b[1] < 0.55 * page_width]
    if len(narrow) < 4:
        return []
    number = clusters([b[1] for b in narrow], 0.03 * page_width)
    counts = Counter(number)
    keep = [c for c, n in counts.most_common(3) if n >= max(2, 0.2 * len(narrow))]
    spans = sorted((min(b[1] for b, k in zip(narrow, number, strict=True) if k == c), max(b[3] for b, k in zip(narrow, number, strict=True) if k == c)) for c in keep)
    out: list[tuple[float, float]] = []
    for a, b in spans:
        if out and a < out[-1][1] - 0.1 * (out[-1][1] - out[-1][0]):
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def column_flow(boxes: Boxes, page_width: float) -> tuple[list[int], dict[int, int], dict[int, int]] | None:
    """Order by segment, column and top; boxes over several columns end a segment. Also the column and segment of each box."""
    spans = columns_of(boxes, page_width)
    if len(spans) < 2:
        return None

    def column(b: tuple) -> int:
        over = [min(b[3], r) - max(b[1], a) for a, r in spans]
        wide = sum(o > 0.25 * (r - a) for o, (a, r) in zip(over, spans, strict=True)) > 1
        return -1 if wide else max(range(len(spans)), key=lambda k: over[k])

    col, segment, number, out = {}, {}, 0, []
    last_wide = True
    for b in sorted(boxes, key=lambda b: (round(b[2] / 6), b[1], b[0])):
        col[b[0]] = column(b)
        wide = col[b[0]] < 0
        if wide != last_wide or wide:
            number += 1
        last_wide, segment[b[0]] = wide, number
        out.append(b)
    out.sort(key=lambda b: (segment[b[0]], col[b[0]], b[2], b[1], b[0]))
    return [b[0] for b in out], col, segment


def strategy_of(boxes: Boxes, page_width: float, wanted: str = "auto") -> tuple[str, list[int], dict[int, int], dict[int, int], float]:
    """(name, order, columns, segments, confidence). ``auto``: a table island, else columns, else recursive cuts."""
    if wanted in ("auto", "table-island") and (island := table_island(boxes)) and not (wanted == "auto" and len(columns_of(boxes, page_width)) > 1):
        return "table-island", island, {}, {}, 0.85
    if wanted in ("auto", "column-flow-v1") and (flow := column_flow(boxes, page_width)):
        return "column-flow-v1", *flow, 0.8
    if wanted in ("auto", "recursive-xy-cut-v1"):
        return "recursive-xy-cut-v1", xy_cut(boxes), {}, {}, 0.7
    return "visual-yx", [b[0] for b in sorted(boxes, key=lambda b: (round(b[2] / 6), b[1], b[0]))], {}, {}, 0.5


def semantic_order(elements: DataFrame, page_width: float, strategy: str = "auto") -> DataFrame:
    """Place, column, segment, strategy and confidence of every element."""

    def run(page: dict[str, list]) -> list[list]:
        boxes = list(zip(*(page[c] for c in BOXES), strict=True))
        name, order, col, segment, confidence = strategy_of(boxes, page_width, strategy)
        n = len(order)
        return [order, list(range(1, n + 1)), [col.get(i, 0) for i in order], [segment.get(i, 0) for i in order], [name] * n, [confidence] * n]

    schema = "page bigint, idx bigint, place bigint, col bigint, segment bigint, strategy string, confidence double"
    return by_page(elements.select("page", *BOXES), ["idx"], run, schema)
