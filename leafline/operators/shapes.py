"""Vector shapes and images: geometry classes, clusters of near boxes, and regions that are better drawn as one picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.geometry import Box, center_inside
from leafline.operators.matching import BOX, side

#: Confidences of the classes of clusters.
CONFIDENCE = {"separator": 0.9, "table": 0.86, "figure": 0.82, "single figure": 0.76}


def shape_geometry(box: Box) -> Column:
    """A line if one side is at least twelve times the other, else a rectangle."""
    short, long = F.greatest(F.lit(0.1), F.least(box.width, box.height)), F.greatest(box.width, box.height)
    return F.when(long / short < 12, "rectangle").when(box.width >= box.height, "horizontal-line").otherwise("vertical-line")


def distinct_positions(value: str, least: Column, most: Column, second: Column, tolerance: float = 2.0) -> Column:
    """1, 2 or 3 (for three or more) positions that are over ``tolerance`` apart, taken from the least one on."""
    return F.when(most - least <= tolerance, 1).when(F.coalesce(most - second <= tolerance, F.lit(True)), 2).otherwise(3)


def _cluster_features(shapes: DataFrame) -> DataFrame:
    """One row per (page, cluster): envelope, counts of geometries, and how many positions rectangles have on each axis."""
    own = Window.partitionBy("page", "cluster")
    is_box = F.col("geometry") == "rectangle"
    first = lambda c: F.min(F.when(is_box, F.col(c))).over(own)
    s = shapes.withColumn("geometry", shape_geometry(Box.of())).withColumn("fx", first("x0")).withColumn("fy", first("y0"))
    second = lambda c, f: F.min(F.when(is_box & (F.col(c) > F.col(f) + 2.0), F.col(c)))
    count = lambda g: F.count_if(F.col("geometry") == g)
    f = s.groupBy("page", "cluster").agg(
        *[F.min(c).alias(c) for c in BOX[:2]], *[F.max(c).alias(c) for c in BOX[2:]], F.count("*").alias("members"),
        count("horizontal-line").alias("horizontal"), count("vertical-line").alias("vertical"), count("rectangle").alias("boxes"),
        F.min("fx").alias("fx"), F.min("fy").alias("fy"), second("x0", "fx").alias("sx"), second("y0", "fy").alias("sy"),
        F.max(F.when(is_box, F.col("x0"))).alias("lx"), F.max(F.when(is_box, F.col("y0"))).alias("ly"),
    )
    positions = lambda a: distinct_positions(a, F.col(f"f{a}"), F.col(f"l{a}"), F.col(f"s{a}"))
    return f.withColumn("columns", positions("x")).withColumn("rows", positions("y")).drop("fx", "fy", "sx", "sy", "lx", "ly")


def cluster_classes(shapes: DataFrame) -> DataFrame:
    """Class and confidence of each cluster of shapes (page, cluster, box): separator, table or figure; none for small ones."""
    b = Box.of()
    short, long = F.greatest(F.lit(0.1), F.least(b.width, b.height)), F.greatest(b.width, b.height)
    line = F.col("horizontal") + F.col("vertical") == 1
    alone = F.col("members") == 1
    table = (F.col("members") >= 4) & (((F.col("horizontal") >= 2) & (F.col("vertical") >= 2)) | ((F.col("boxes") >= 4) & (F.col("columns") >= 2) & (F.col("rows") >= 2)))
    kind = (
        F.when(alone & line & (long >= 24) & (long / short >= 8), "separator").when(table, "table")
        .when((b.width >= 24) & (b.height >= 24) & ~(alone & line), "figure")
    )
    confidence = F.when(kind == "figure", F.when(alone, CONFIDENCE["single figure"]).otherwise(CONFIDENCE["figure"]))
    for name in ("separator", "table"):
        confidence = F.when(kind == name, CONFIDENCE[name]).otherwise(confidence)
    return _cluster_features(shapes).select("page", "cluster", "members", kind.alias("kind"), confidence.alias("confidence"))


def raster_pages(shapes: DataFrame, width: float, height: float, least: int = 120, lines: int = 20) -> DataFrame:
    """Pages with so many shapes, and lines among them, that their envelope is drawn as a picture, padded by 2 and cut to the page."""
    whole = _cluster_features(shapes.withColumn("cluster", F.lit(0)))
    b = Box.of()
    dense = (F.col("members") >= least) & (F.col("horizontal") + F.col("vertical") >= lines)
    sized = (b.width >= 80) & (b.height >= 80) & (b.area <= 0.7 * width * height)
    return whole.where(dense & sized).select("page", "members", *_padded(b, 2.0, width, height))


def raster_tables(shapes: DataFrame, width: float, height: float, least: int = 24) -> DataFrame:
    """Clusters that are dense tables: grids of lines, or many boxes in rows and columns; padded by 1.5."""
    b = Box.of()
    grid = ((F.col("horizontal") >= 4) & (F.col("vertical") >= 4)) | ((F.col("boxes") >= 24) & (F.col("columns") >= 3) & (F.col("rows") >= 3))
    sized = (b.width >= 80) & (b.height >= 40) & (b.area <= 0.65 * width * height)
    return _cluster_features(shapes).where((F.col("members") >= least) & grid & sized).select("page", "cluster", "members", *_padded(b, 1.5, width, height))


def _padded(b: Box, pad: float, width: float, height: float) -> list[Column]:
    cut = Box(b.x0 - pad, b.y0 - pad, b.x1 + pad, b.y1 + pad).clamped(width, height)
    return [c.alias(n) for c, n in zip((cut.x0, cut.y0, cut.x1, cut.y1), BOX, strict=True)]


def image_coverage(images: DataFrame, width: float, height: float) -> DataFrame:
    """Share of a page that distinct images cover, each cut to the page; at most 1."""
    cut = Box.of().clamped(width, height)
    return images.select("page", *BOX).distinct().groupBy("page").agg(
        F.round(F.least(F.lit(1.0), F.sum(cut.area) / max(1.0, width * height)), 8).alias("coverage")
    )


def near_pairs(shapes: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Shapes of a page (page, idx, box) whose gaps on both axes are within ``tolerance``.

    Boxes meet in the cells of a grid that they touch when grown by half the tolerance, so distant ones are never paired.
    """
    cell = 64.0
    at = lambda c, d: F.floor((F.col(c) + d) / cell).cast("int")
    h = tolerance / 2
    cells = shapes.select("page", "idx", *BOX, F.explode(F.sequence(at("x0", -h), F.greatest(at("x0", -h), at("x1", h)))).alias("cx")).withColumn("cy", F.explode(F.sequence(at("y0", -h), F.greatest(at("y0", -h), at("y1", h)))))
    a, b = (cells.select("page", "cx", "cy", *[F.col(c).alias(f"{p}_{c}") for c in ("idx", *BOX)]) for p in "ab")
    gap = lambda i, j: F.greatest(F.lit(0.0), F.greatest(f"a_{i}", f"b_{i}") - F.least(f"a_{j}", f"b_{j}"))
    near = a.join(b, ["page", "cx", "cy"]).where((F.col("a_idx") < F.col("b_idx")) & (gap("x0", "x1") <= tolerance) & (gap("y0", "y1") <= tolerance))
    return near.select("page", F.col("a_idx").alias("source"), F.col("b_idx").alias("target")).distinct()


def table_region_of(elements: DataFrame, regions: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Each element with the first region, by number, whose box holds its centre."""
    held = side(elements, "e_", "idx").join(side(regions, "r_", "region"), "page").where(center_inside(Box.of("e_"), Box.of("r_"), tolerance))
    return held.groupBy("page", F.col("e_idx").alias("idx")).agg(F.min("r_region").alias("region"))
