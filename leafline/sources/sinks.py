"""Writers: XML, HTML, CSV and JSON of elements and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def positioned_html(elements: DataFrame) -> DataFrame:
    """One HTML string per page: elements in order, each at its place."""
    div = F.format_string(
        '<div data-idx="%d" style="left:%.1fpt;top:%.1fpt;width:%.1fpt;height:%.1fpt">%s</div>',
        "idx", "x0", "y0", F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), escaped(F.coalesce("text", F.lit(""))),
    )
    grouped = elements.withColumn("html", div).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("idx", "html"))).alias("e"))
    return grouped.select("page", F.array_join(F.transform("e", lambda x: x["html"]), "\n").alias("html"))


def text_for_mode(mode: str, source: Column, edited: Column, translated: Column) -> Column:
    """The text of a display mode; empty texts fall back."""
    first = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    if mode == "translated":
        return first(translated, edited, source)
    if mode == "edited":
        return first(edited, source)
    if mode == "bilingual":
        return F.concat_ws("\n", first(edited, source), F.nullif(translated, F.lit("")))
    return F.coalesce(source, F.lit(""))


def write_xml(elements: DataFrame, path: str) -> None:
    elements.write.mode("overwrite").format("xml").option("rootTag", "elements").option("rowTag", "element").save(path)


def write_csv(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").option("header", True).csv(path)


def write_proposals(edges: DataFrame, path: str) -> None:
    """One JSON object per page, in folders by page."""
    pages = edges.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("source", "target"))).alias("edges"))
    pages.withColumn("digest", F.sha2(F.to_json("edges"), 256)).write.mode("overwrite").json(path)


def svg_shapes(shapes: DataFrame, geometry: Column) -> DataFrame:
    """One SVG string per page: lines as lines, all other shapes as rectangles, in order of their numbers."""
    line = F.format_string('<line x1="%.1f" y1="%.1f" x2="%.1f" y2="%.1f"/>', "x0", "y0", "x1", "y1")
    rect = F.format_string('<rect x="%.1f" y="%.1f" width="%.1f" height="%.1f"/>', "x0", "y0", F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    part = F.when(geometry == "rectangle", rect).otherwise(line)
    grouped = shapes.withColumn("svg", part).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("idx", "svg"))).alias("s"))
    return grouped.select("page", F.concat(F.lit("<g>"), F.array_join(F.transform("s", lambda x: x["svg"]), ""), F.lit("</g>")).alias("svg"))


def svg_path(commands: Column) -> Column:
    """The path of a drawing: an array of (op, points); ``m``, ``l`` and ``c`` take points, ``h`` closes."""
    number = lambda v: F.format_string("%.2f", v)
    points = lambda c: F.array_join(F.transform(c["points"], number), " ")
    return F.array_join(F.transform(commands, lambda c: F.when(c["op"] == "h", "Z").otherwise(F.concat(F.upper(c["op"]), F.lit(" "), points(c)))), " ")


def page_xml(elements: DataFrame, text: Column) -> DataFrame:
    """One XML string per page: an element node with number, role and text for each row."""
    node = F.format_string('<element idx="%d" role="%s">%s</element>', "idx", F.coalesce("role", F.lit("text")), escaped(F.coalesce(text, F.lit(""))))
    grouped = elements.withColumn("node", node).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("idx", "node"))).alias("n"))
    return grouped.select("page", F.concat(F.format_string('<page id="%d">', "page"), F.array_join(F.transform("n", lambda x: x["node"]), ""), F.lit("</page>")).alias("xml"))


def review_records(scored: DataFrame, selected: DataFrame, most: int = 3) -> DataFrame:
    """Edges (page, source, target, score, rank) of the first ``most`` ranks or selected, with the margin to the next of their source."""
    chosen = selected.select("page", "source", "target", F.lit(True).alias("chosen"))
    w = "OVER (PARTITION BY page, source ORDER BY rank)"
    margin = F.expr(f"score - lead(score) {w}")
    out = scored.withColumn("margin", F.round(margin, 8)).join(chosen, ["page", "source", "target"], "left").withColumn("selected", F.col("chosen").isNotNull())
    return out.where((F.col("rank") <= most) | F.col("selected")).select("page", "source", "target", "rank", "score", "margin", "selected")


def proposal_digests(edges: DataFrame) -> DataFrame:
    """(page, edges, digest): the edges of a page as canonical JSON, and SHA-256 of that."""
    pages = edges.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("source", "target"))).alias("e"), F.count("*").alias("edges"))
    return pages.select("page", "edges", F.sha2(F.to_json("e"), 256).alias("digest"))
