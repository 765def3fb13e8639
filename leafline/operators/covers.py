"""Sequential algorithms on the edges of one page.

A page has a bounded number of elements, so a group fits in memory; pages are
independent and spread over the cluster.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.text import caption_kind
from leafline.operators.pages import by_page

BOXES = ["idx", "x0", "y0", "x1", "y1"]


class _Chains:
    """Edges of degree one without cycles; ends of chains by union-find."""

    def __init__(self) -> None:
        self.after: dict[int, int] = {}
        self.before: dict[int, int] = {}
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def obstacle(self, source: int, target: int) -> str:
        if source == target:
            return "self"
        if source in self.after:
            return "outgoing"
        if target in self.before:
            return "incoming"
        return "cycle" if self.root(source) == self.root(target) else ""

    def add(self, source: int, target: int) -> None:
        self.after[source], self.before[target] = target, source
        self.parent[self.root(source)] = self.root(target)


def greedy_cover(edges: Iterable[tuple[int, int]]) -> list[str]:
    """For edges in order: "selected", or what stood against them."""
    chains, out = _Chains(), []
    for source, target in edges:
        obstacle = chains.obstacle(source, target)
        if not obstacle:
            chains.add(source, target)
        out.append(obstacle or "selected")
    return out


def path_cover(edges: DataFrame) -> DataFrame:
    """Every edge (page, source, target, score, protected) with its status; protected ones come first, then by score."""

    def run(page: dict[str, list]) -> list[list]:
        return [page["source"], page["target"], page["score"], page["protected"], greedy_cover(zip(page["source"], page["target"], strict=True))]

    order = [F.desc("protected"), F.desc("score"), "source", "target"]
    edges = edges.select("page", "source", "target", "score", "protected")
    return by_page(edges, order, run, "page bigint, source bigint, target bigint, score double, protected boolean, status string")


def max_regret_edges(edges: list[tuple[int, int, float]], least: float) -> list[tuple[int, int, float, float]]:
    """Edges chosen one by one by what is lost if they are not: score minus the best feasible alternatives, at both ends.

    An edge that is chosen takes away those of its source and target, and the one that would close its chain;
    only edges at ends whose two best scores change by that are valued again.
    """
    left = [e for e in edges if e[2] >= least and e[0] != e[1]]
    ends = [(("s", s), ("t", t)) for s, t, _ in left]
    alive: dict[tuple[str, int], set[int]] = {}
    same: dict[tuple[int, int], list[int]] = {}
    for i, (s, t, _) in enumerate(left):
        same.setdefault((s, t), []).append(i)
        for key in ends[i]:
            alive.setdefault(key, set()).add(i)
    best = lambda key: heapq.nlargest(2, (left[i][2] for i in alive[key]))
    tops = {key: best(key) for key in alive}

    def other(key: tuple[str, int], score: float) -> float:
        top = tops[key]
        return score - (top[1] if top[0] == score and len(top) > 1 else 0.0 if top[0] == score else top[0])

    def valued(i: int) -> tuple[float, float, int, int, int]:
        (s, t, score), (a, b) = left[i], ends[i]
        value[i] = other(a, score) + other(b, score)
        return (-value[i], -score, s, t, i)

    value: dict[int, float] = {}
    queue = [valued(i) for i in range(len(left))]
    heapq.heapify(queue)
    head: dict[int, int] = {}
    tail: dict[int, int] = {}
    out = []
    while queue:
        lost, _, s, t, i = heapq.heappop(queue)
        if value.get(i) != -lost:
            continue
        out.append((s, t, left[i][2], round(-lost, 8)))
        first, last = head.get(s, s), tail.get(t, t)
        head[last], tail[first] = first, last
        changed = set()
        for k in (alive[ends[i][0]] | alive[ends[i][1]]).union(same.get((last, first), ())):
            if value.pop(k, None) is not None:
                for key in ends[k]:
                    alive[key].discard(k)
                    changed.add(key)
        again = set()
        for key in changed:
            top = best(key)
            if top != tops[key]:
                tops[key] = top
                again |= alive[key]
        for k in again:
            heapq.heappush(queue, valued(k))
    return out


def max_regret_cover(edges: DataFrame, least: float = 0.3) -> DataFrame:
    def run(page: dict[str, list]) -> list[list]:
        found = max_regret_edges(list(zip(page["source"], page["target"], page["score"], strict=True)), least)
        return [list(c) for c in zip(*found, strict=True)]

    edges = edges.select("page", "source", "target", "score")
    return by_page(edges, ["source", "target"], run, "page bigint, source bigint, target bigint, score double, regret double")


def topological_order(items: DataFrame, edges: DataFrame, rank: str) -> DataFrame:
    """Place of each item such that edges point forward, and else the base rank decides; no rows for a page with a cycle."""
    targets = edges.select("page", F.col("source").alias("idx"), "target").groupBy("page", "idx").agg(F.collect_set("target").alias("targets"))
    linked = items.select("page", "idx", F.col(rank).alias("rank")).join(targets, ["page", "idx"], "left")

    def run(page: dict[str, list]) -> list[list]:
        base = dict(zip(page["idx"], page["rank"], strict=True))
        after = {i: [t for t in found or () if t in base] for i, found in zip(page["idx"], page["targets"], strict=True)}
        waiting = dict.fromkeys(base, 0)
        for t in itertools.chain.from_iterable(after.values()):
            waiting[t] += 1
        ready = [(base[i], i) for i, n in waiting.items() if not n]
        heapq.heapify(ready)
        out: list[int] = []
        while ready:
            _, i = heapq.heappop(ready)
            out.append(i)
            for t in after[i]:
                waiting[t] -= 1
                if not waiting[t]:
                    heapq.heappush(ready, (base[t], t))
        return [out, list(range(1, len(out) + 1))] if len(out) == len(base) else []

    return by_page(linked, ["rank", "idx"], run, "page bigint, idx bigint, place bigint")


def assign(scores: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs of greatest number, then greatest total score; NaN is no pair. Shortest augmenting paths with potentials."""
    rows, cols = scores.shape
    if not rows or not cols:
        return []
    bonus = 1.0 + 2.0 * min(rows, cols) * (np.nanmax(np.abs(scores)) if np.isfinite(scores).any() else 0.0)
    size = cols + rows
    cost = np.zeros((rows, size))
    cost[:, :cols] = np.where(np.isnan(scores), 4 * bonus * (rows + 1), -scores - bonus)
    u, v, match = np.zeros(rows + 1), np.zeros(size + 1), np.zeros(size + 1, int)
    for i in range(1, rows + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(size + 1, np.inf), np.zeros(size + 1, bool), np.zeros(size + 1, int)
        while True:
            used[j0] = True
            i0 = match[j0]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, cols + 1) if match[j] and not np.isnan(scores[match[j] - 1, j - 1]))


def one_to_one(scored: DataFrame, least: float = 0.0) -> DataFrame:
    """Assignment of (page, left, right, score): most pairs, then the highest sum."""

    def run(page: dict[str, list]) -> list[list]:
        best: dict[tuple[int, int], float] = {}
        for left, right, score in zip(page["left"], page["right"], page["score"], strict=True):
            best[left, right] = max(score, best.get((left, right), score))
        rows, cols = sorted({k[0] for k in best}), sorted({k[1] for k in best})
        grid = np.full((len(rows), len(cols)), np.nan)
        for (left, right), score in best.items():
            grid[rows.index(left), cols.index(right)] = score
        found = assign(grid)
        return [[rows[i] for i, _ in found], [cols[j] for _, j in found], [float(grid[i, j]) for i, j in found]]

    wanted = scored.where(F.col("score") >= least).select("page", "left", "right", "score")
    return by_page(wanted, ["left", "right"], run, "page bigint, left bigint, right bigint, score double")


def xy_cut(boxes: list[tuple[int, float, float, float, float]], depth: int = 8, least: float = 2.0) -> list[int]:
    """Order by recursive cuts at the largest gap: horizontal ones first, then vertical ones between groups of two or more that share height."""
    if len(boxes) < 2 or not depth:
        return [b[0] for b in sorted(boxes, key=lambda b: (round(b[2] / 6), b[1], b[0]))]

    def cut(axis: int) -> tuple[float, int, list]:
        some = sorted(boxes, key=lambda b: (b[1 + axis], b[3 + axis], b[0]))
        far, best = some[0][3 + axis], (0.0, 0)
        for k in range(1, len(some)):
            if some[k][1 + axis] - far > best[0]:
                best = (some[k][1 + axis] - far, k)
            far = max(far, some[k][3 + axis])
        return *best, some

    gap, k, some = cut(1)
    if gap < least:
        gap, k, some = cut(0)
        a, b = some[:k], some[k:]
        if gap < least or min(len(a), len(b)) < 2:
            return xy_cut(boxes, 0)
        span = lambda x: (min(e[2] for e in x), max(e[4] for e in x))
        (a0, a1), (b0, b1) = span(a), span(b)
        if min(a1, b1) - max(a0, b0) < 0.2 * min(a1 - a0, b1 - b0):
            return xy_cut(boxes, 0)
    return xy_cut(some[:k], depth - 1, least) + xy_cut(some[k:], depth - 1, least)


def recursive_xy_cut(elements: DataFrame, depth: int = 8) -> DataFrame:
    def run(page: dict[str, list]) -> list[list]:
        order = xy_cut(list(zip(*(page[c] for c in BOXES), strict=True)), depth)
        return [order, list(range(1, len(order) + 1))]

    return by_page(elements.select("page", *BOXES), ["idx"], run, "page bigint, idx bigint, xy_rank bigint")


def running_mean_rows(elements: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """Rows by first match: an element joins the first row whose mean centre is within ``tolerance``; the mean moves with it."""

    def run(page: dict[str, list]) -> list[list]:
        means: list[float] = []
        sizes: list[int] = []
        out = []
        for c in page["c"]:
            row = next((i for i, m in enumerate(means) if abs(c - m) <= tolerance), len(means))
            if row == len(means):
                means.append(c)
                sizes.append(1)
            else:
                sizes[row] += 1
                means[row] += (c - means[row]) / sizes[row]
            out.append(row)
        return [page["idx"], out]

    centers = elements.select("page", "idx", "x0", ((F.col("y0") + F.col("y1")) / 2).alias("c"))
    return by_page(centers, ["c", "x0", "idx"], run, "page bigint, idx bigint, row bigint")


def consensus_votes(orders: DataFrame) -> DataFrame:
    """Votes of candidate orders (page, candidate, idx, place) for each pair of neighbours; regret: votes over the best other target of the source."""
    w = Window.partitionBy("page", "candidate").orderBy("place")
    edges = orders.withColumn("target", F.lead("idx").over(w)).where("target IS NOT NULL")
    votes = edges.groupBy("page", F.col("idx").alias("source"), "target").agg(F.count("*").alias("votes"))
    ranked = Window.partitionBy("page", "source").orderBy(F.desc("votes"), "target")
    every = Window.partitionBy("page", "source")
    second = F.max(F.when(F.col("n") == 2, F.col("votes"))).over(every)
    first = F.max(F.when(F.col("n") == 1, F.col("votes"))).over(every)
    best = votes.withColumn("n", F.row_number().over(ranked))
    other = F.when(F.col("n") == 1, F.coalesce(second, F.lit(0))).otherwise(first)
    return best.select("page", "source", "target", "votes", (F.col("votes") - other).alias("regret"))


def consensus_cover(votes: DataFrame) -> DataFrame:
    """The greedy path cover by votes, then regret."""
    scored = votes.select("page", "source", "target", (F.col("votes") + F.col("regret") / 1000).alias("score"), F.lit(False).alias("protected"))
    return path_cover(scored)


def components(edges: DataFrame) -> DataFrame:
    """(page, node, root) of the components of each page's edges; a root is the least node."""

    def run(page: dict[str, list]) -> list[list]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for s, t in zip(page["source"], page["target"], strict=True):
            a, b = root(s), root(t)
            parent[max(a, b)] = min(a, b)
        nodes = sorted(parent)
        return [nodes, [root(n) for n in nodes]]

    return by_page(edges.select("page", "source", "target"), ["source", "target"], run, "page bigint, node bigint, root bigint")


def serialized_chains(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """Order of all items (page, idx, rank): chains of edges (page, source, target) one after the other, by the rank of their heads.

    Gives place, chain and the place in the chain. Edges are a path cover; items that only a cycle reaches follow by rank.
    """
    linked = ranked.join(edges.select("page", F.col("source").alias("idx"), "target"), ["page", "idx"], "left")

    def run(page: dict[str, list]) -> list[list]:
        after = {i: t for i, t in zip(page["idx"], page["target"], strict=True) if t is not None}
        heads = [i for i in page["idx"] if i not in set(after.values())]
        out, seen = [], set()
        for chain, head in enumerate([*heads, *page["idx"]]):
            node, pos = head, 0
            while node is not None and node not in seen:
                seen.add(node)
                out.append((node, len(out) + 1, chain, pos))
                node, pos = after.get(node), pos + 1
        return [list(c) for c in zip(*out, strict=True)]

    return by_page(linked.select("page", "idx", "rank", "target"), ["rank", "idx"], run, "page bigint, idx bigint, place bigint, chain bigint, pos bigint")


def _median(values: list[float]) -> float:
    v, n = sorted(values), len(values)
    return (v[(n - 1) // 2] + v[n // 2]) / 2 if n else 0.0


def _row(y: float) -> float:
    return round(y / 6.0) * 6.0


def spatial_graph_order(elements: DataFrame, page_width: float, page_height: float = 792.0) -> DataFrame:
    """Order by the forest in which each element follows the nearest one above it that is in line with it; only of pages with clear columns.

    A page counts if it has two or more chains of three elements, which hold 0.65 of all that are not
    as wide as the page, lie 0.14 page widths apart and run side by side. Otherwise it gives no rows.
    """

    def in_line(a: tuple, b: tuple) -> tuple[bool, float, float]:
        shared = max(0.0, min(a[3], b[3]) - max(a[1], b[1])) / max(1.0, min(a[3] - a[1], b[3] - b[1]))
        apart = abs(a[1] + a[3] - b[1] - b[3]) / 2
        reach = max(24.0, min(0.42 * max(a[3] - a[1], b[3] - b[1]), 0.12 * page_width))
        return apart <= reach or (shared >= 0.65 and apart <= 0.16 * page_width), apart, shared

    def run(page: dict[str, list]) -> list[list]:
        everything = [(i, *box) for i, *box in zip(*(page[c] for c in ("idx", "x0", "y0", "x1", "y1")), strict=True)]
        items = [e for e in everything if e[3] - e[1] >= 8 and e[4] - e[2] >= 4]
        if len(items) < 8:
            return []
        line = _median([e[4] - e[2] for e in items])
        far, box = max(0.08 * page_height, 6 * line), {e[0]: e for e in items}
        visual = lambda i: (_row(box[i][2]), box[i][1], i)
        above: dict[int, int] = {}
        for e in items:
            options = []
            for f in items:
                if f is not e and -0.25 * line <= e[2] - f[4] <= far:
                    fits, apart, shared = in_line(f, e)
                    if fits:
                        options.append((max(0.0, e[2] - f[4]), apart, -shared, f[0]))
            if options:
                above[e[0]] = min(options)[3]
        wide = {e[0] for e in items if e[3] - e[1] >= 0.62 * page_width}
        narrow = [e[0] for e in items if e[0] not in wide]

        def head(i: int) -> int:
            path: list[int] = []
            while i in above and above[i] not in wide:
                if i in path:
                    return min(path[path.index(i) :], key=visual)
                path.append(i)
                i = above[i]
            return i

        chains: dict[int, list[int]] = {}
        for i in narrow:
            chains.setdefault(head(i), []).append(i)
        columns = sorted((c for c in chains.values() if len(c) >= 3), key=lambda c: sum(box[i][1] + box[i][3] for i in c) / len(c))
        if len(narrow) < 6 or len(columns) < 2 or sum(map(len, columns)) < 0.65 * len(narrow):
            return []
        for a, b in zip(columns, columns[1:], strict=False):
            center = lambda c: sum(box[i][1] + box[i][3] for i in c) / (2 * len(c))
            (a0, a1), (b0, b1) = ((min(box[i][2] for i in c), max(box[i][4] for i in c)) for c in (a, b))
            if center(b) - center(a) < 0.14 * page_width or min(a1, b1) - max(a0, b0) < 0.2 * max(1.0, min(a1 - a0, b1 - b0)):
                return []
        below: dict[int, list[int]] = {}
        for child, parent in above.items():
            below.setdefault(parent, []).append(child)
        rows = max(4.0, 0.8 * line)
        spatial = lambda i: (round(box[i][2] / rows), box[i][1], box[i][2], i)
        out: list[int] = []
        seen: set[int] = set()
        for start in [*sorted((i for i in box if i not in above), key=spatial), *sorted(box, key=visual)]:
            stack = [start]
            while stack:
                i = stack.pop()
                if i not in seen:
                    seen.add(i)
                    out.append(i)
                    stack += sorted(below.get(i, []), key=spatial, reverse=True)
        out += [e[0] for e in sorted(everything, key=lambda e: (_row(e[2]), e[1], e[0])) if e[0] not in seen]
        return [out, list(range(1, len(out) + 1))]

    return by_page(elements.select("page", "idx", "x0", "y0", "x1", "y1"), ["y0", "x0", "idx"], run, "page bigint, idx bigint, place bigint")


def footnotes(elements: DataFrame, page_height: float, page_width: float = 612.0) -> DataFrame:
    """Elements of the small rows at the foot of a page, from the first row on that a gap parts from what is above.

    Pages of fewer than eight elements, or four lines of body, have none. Rows as high as the body above them in its columns are body.
    """
    foot, end = max(0.72 * page_height, page_height - 220.0), max(0.92 * page_height, page_height - 42.0)

    def run(page: dict[str, list]) -> list[list]:
        items = [(i, *box) for i, *box in zip(*(page[c] for c in ("idx", "x0", "y0", "x1", "y1")), strict=True)]
        height, width = lambda e: e[4] - e[2], lambda e: e[3] - e[1]
        body = [height(e) for e in items if height(e) > 0 and width(e) >= 0.18 * page_width and (e[2] + e[4]) / 2 < 0.82 * page_height]
        if len(items) < 8 or len(body) < 4:
            return []
        line = _median(body)
        small = [e for e in items if foot <= e[2] < end and 2.5 <= height(e) <= max(5.0, 0.9 * line) and 4 <= width(e) <= 0.62 * page_width]
        rows: list[list[tuple]] = []
        for e in sorted(small, key=lambda e: (e[2], e[1], e[0])):
            if rows and e[2] - rows[-1][0][2] <= max(3.0, 0.55 * line):
                rows[-1].append(e)
            else:
                rows.append([e])
        others = [e for e in items if e not in small]
        for k, row in enumerate(rows):
            top = min(e[2] for e in row)
            gap = top - max((e[4] for e in others if e[4] <= top), default=0.0)
            notes = [e for r in rows[k:] for e in r]
            if gap < max(6.0, 0.65 * line) and top < 0.82 * page_height:
                continue
            if max(e[4] for e in notes) - min(e[2] for e in notes) > 0.18 * page_height or _median([width(e) for e in notes]) > 0.5 * page_width:
                continue
            rest = [e for e in items if e not in notes and height(e) > 0]
            window = max(60.0, 8 * line)
            like = sum(any(min(e[3], n[3]) > max(e[1], n[1]) and -1 <= n[2] - e[4] <= window and 0.87 <= height(n) / height(e) <= 1.15 for e in rest) for n in notes)
            if len(rest) >= 8 and 5 * like >= 3 * len(notes):
                continue
            return [sorted(e[0] for e in notes)]
        return []

    return by_page(elements.select("page", "idx", "x0", "y0", "x1", "y1"), ["y0", "x0", "idx"], run, "page bigint, idx bigint")


def caption_lines(elements: DataFrame, page_width: float = 612.0, page_height: float = 792.0, most: int = 2) -> DataFrame:
    """Lines that begin a caption, with its kind, and up to ``most`` lines right below that go on with it."""
    typed = elements.withColumn("kind", caption_kind(F.col("text"))).select("page", "idx", "x0", "y0", "x1", "y1", "kind")

    def run(page: dict[str, list]) -> list[list]:
        items = [(i, *box) for i, *box in zip(*(page[c] for c in ("idx", "x0", "y0", "x1", "y1")), strict=True)]
        line = _median([e[4] - e[2] for e in items if e[4] > e[2]]) or 10.0

        def plausible(e: tuple) -> bool:
            fits = e[3] - e[1] >= max(28.0, 0.08 * page_width) and 0 < e[4] - e[2] <= max(28.0, 0.055 * page_height)
            return fits and e[4] > min(0.06 * page_height, 42.0) and e[2] < max(0.92 * page_height, page_height - 42.0)

        kinds = {e[0]: k for e, k in zip(items, page["kind"], strict=True) if k and plausible(e)}
        order = sorted(items, key=lambda e: (_row(e[2]), e[1], e[0]))
        out = {i: (k, i) for i, k in kinds.items()}
        for anchor in [e for e in order if e[0] in kinds]:
            bottom, found = anchor[4], 0
            for e in order:
                gap = e[2] - bottom
                if found == most or gap > max(4.0, 0.85 * line):
                    break
                shared = max(0.0, min(anchor[3], e[3]) - max(anchor[1], e[1])) / max(1.0, min(anchor[3] - anchor[1], e[3] - e[1]))
                aligned = shared >= 0.5 or abs(e[1] - anchor[1]) <= max(14.0, 0.025 * page_width)
                sized = 0 < e[4] - e[2] <= max(28.0, 1.55 * line) and e[3] - e[1] >= max(24.0, 0.08 * page_width)
                if e[0] not in out and gap >= -0.25 * line and aligned and sized:
                    out[e[0]], found, bottom = (kinds[anchor[0]], anchor[0]), found + 1, max(bottom, e[4])
        rows = sorted((i, k, a) for i, (k, a) in out.items())
        return [list(c) for c in zip(*rows, strict=True)]

    return by_page(typed, ["y0", "x0", "idx"], run, "page bigint, idx bigint, kind string, anchor bigint")
