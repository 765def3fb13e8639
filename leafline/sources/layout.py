"""Layout tables: readers of typed rows, and views over plain tables that have no boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ELEMENTS = T.StructType([
    T.StructField("page", T.LongType()), T.StructField("idx", T.LongType()), T.StructField("text", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")],
])
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Element rows as JSON lines with a fixed schema; nothing is inferred."""
    return spark.read.schema(ELEMENTS).json(path)


def read_ocr_json(spark: SparkSession, path: str) -> DataFrame:
    """Whole OCR documents: pages of elements with pixel boxes, one row per element."""
    box = T.ArrayType(T.DoubleType())
    element = T.StructType([T.StructField("type", T.StringType()), T.StructField("bbox_px", box), T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())])
    page = T.StructType([T.StructField("page_index", T.IntegerType()), T.StructField("elements", T.ArrayType(element))])
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("pages", T.ArrayType(page))])
    pages = spark.read.schema(schema).option("multiLine", True).json(path).select("source", F.explode("pages").alias("p"))
    flat = pages.select("source", F.col("p.page_index").alias("page"), F.posexplode("p.elements").alias("idx", "e"))
    corners = [F.get("e.bbox_px", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return flat.select("source", "page", "idx", "e.type", "e.text", "e.confidence", *corners)


#: Lines that fit a page of the layout view, and pages that a document may have.
PAGE_LINES, MOST_PAGES = 104, 1_000_000


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as elements of pages in two columns, with headings over both and small notes.

    A document has as many pages as its lines need, numbered from ``doc_id * MOST_PAGES`` on.
    """
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text"))
    page = F.col("doc_id") * MOST_PAGES + F.floor(F.col("pos") / PAGE_LINES)
    lines = lines.select(page.cast("bigint").alias("page"), (F.col("pos") % PAGE_LINES).alias("idx"), "text")
    idx = F.col("idx")
    heading, note = idx % 9 == 0, idx % 9 == 8
    x0 = F.when(heading, 36).otherwise(36 + (idx % 2) * 280)
    y0 = 40 + 14 * F.floor(idx / 2) + idx % 3
    width = F.when(heading, 540).otherwise(F.least(F.lit(260), 6 * F.length("text")))
    height = F.when(heading, 24).when(note, 8).otherwise(10)
    d = lambda c: c.cast("double")
    return lines.select(
        "page", idx.cast("bigint").alias("idx"), "text",
        d(x0).alias("x0"), d(y0).alias("y0"), d(x0 + width).alias("x1"), d(y0 + height).alias("y1"),
    )


def regions(elements: DataFrame, size: int = 4) -> DataFrame:
    """Blocks of ``size`` consecutive elements with their envelope."""
    return elements.groupBy("page", F.floor(F.col("idx") / size).cast("bigint").alias("region")).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("members")
    )


def provider(elements: DataFrame, number: int) -> DataFrame:
    """A provider's copy of the elements: some are missing, boxes are shifted; all by a hash of page and index."""
    seed = F.pmod(F.col("page") * 31 + F.col("idx") * 17 + number * 7, F.lit(10))
    shift = (F.pmod(F.col("page") + F.col("idx") * 3 + number, F.lit(5)) - 2).cast("double")
    moved: list[Column] = [(F.col(c) + shift).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return elements.where(seed != 0).select("page", "idx", "text", *moved, F.lit(number).alias("provider"), (1 - seed / 20).alias("confidence"))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered opening tags of raw pages with a role by tag."""
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("<(h[1-6]|p|li|nav|article|table|img|script)[ >]"), F.lit(1))
    blocks = table(spark, sf_dir, "pages").select("page_id", F.posexplode(tags).alias("pos", "tag"))
    role = (
        F.when(F.col("tag").rlike("^h[1-6]$"), "title").when(F.col("tag").isin("p", "li", "article"), "text")
        .when(F.col("tag") == "table", "table").when(F.col("tag") == "img", "figure").otherwise("artifact")
    )
    return blocks.select("page_id", F.col("pos").cast("bigint").alias("pos"), "tag", role.alias("role"))
