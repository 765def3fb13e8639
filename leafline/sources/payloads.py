"""Payloads of providers and annotation sets as rows: wrappers, aliases, references, table cells, display strings and image annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of sources by the ending of their file.
SOURCE_KINDS = {"pdf": ["pdf"], "image": ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"]}
BLOCK = "struct<type:string,label:string,block_label:string,bbox:array<double>,box:array<double>,block_bbox:array<double>,text:string,content:string,block_content:string,order:int,block_order:int,score:double,confidence:double>"
RES = f"struct<blocks:array<{BLOCK}>,parsing_res_list:array<{BLOCK}>>"
WRAPPED = f"struct<page_index:int,blocks:array<{BLOCK}>,parsing_res_list:array<{BLOCK}>,res:{RES}>"
PAYLOAD = f"struct<page_index:int,blocks:array<{BLOCK}>,parsing_res_list:array<{BLOCK}>,res:{RES},pages:array<{WRAPPED}>,results:array<{WRAPPED}>>"
NODE = "struct<self_ref:string,label:string,text:string,children:array<struct<`$ref`:string>>>"
TREE = f"struct<body:{NODE},groups:array<{NODE}>,texts:array<{NODE}>>"
COCO = (
    "struct<images:array<struct<id:bigint,file_name:string,width:double,height:double>>,"
    "annotations:array<struct<id:bigint,image_id:bigint,bbox:array<double>,category_id:bigint>>,categories:array<struct<id:bigint,name:string>>>"
)
SPAN = T.StructType([
    T.StructField("page", T.LongType()), T.StructField("line", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("text", T.StringType()), T.StructField("font_size", T.DoubleType()),
    *[T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")],
])


def source_kind(path: Column, given: str = "auto") -> Column:
    """``pdf`` or ``image`` by the ending of a path, or as given; null of any other."""
    if given != "auto":
        return F.lit(given)
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, endings in SOURCE_KINDS.items():
        out = F.when(ending.isin(endings), kind).otherwise(out)
    return out


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with their kind; contents are only read where they are asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.withColumn("kind", source_kind(F.col("path"))).where("kind IS NOT NULL")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(page, payload): one JSON document per file, with the page from the file's stem."""
    whole = spark.read.option("wholetext", True).text(path).withColumn("path", F.col("_metadata.file_path"))
    return whole.select((F.regexp_extract("path", r"page_0*([0-9]+)", 1).try_cast("bigint") - 1).alias("page"), F.col("value").alias("payload"))


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Text spans as JSON lines with a fixed schema."""
    return spark.read.schema(SPAN).json(path)


def lines_of_spans(spans: DataFrame, title_size: float = 22.0) -> DataFrame:
    """One element per line: its spans' texts from left to right, their envelope, and title or text by the largest font."""
    parts = F.sort_array(F.collect_list(F.struct("pos", "text")))
    lines = spans.groupBy("page", F.col("line").alias("idx")).agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max("font_size").alias("font_size"),
    )
    return lines.where("trim(text) <> ''").withColumn("type", F.when(F.col("font_size") >= title_size, "title").otherwise("text"))


def needs_ocr(pages: DataFrame, lines: DataFrame, coverage: DataFrame, least: float = 0.6) -> DataFrame:
    """Pages without text of which images (page, coverage) cover ``least``; their text would have a confidence of 0.72."""
    bare = pages.select("page").join(lines.select("page").distinct(), "page", "left_anti")
    return bare.join(coverage.where(F.col("coverage") >= least), "page").select("page", "coverage", F.lit(0.72).alias("confidence"))


def wrapped_blocks(payloads: DataFrame) -> DataFrame:
    """Blocks (page, block numbers and raw fields) of payloads with or without wrappers; a page's number is its field, or its place in the list."""
    p = payloads.select("page", F.from_json("payload", PAYLOAD).alias("p"))
    none = F.array().cast(f"array<{BLOCK}>")
    own = lambda x: F.concat(*[F.coalesce(c, none) for c in (x["blocks"], x["parsing_res_list"], x["res"]["blocks"], x["res"]["parsing_res_list"])])
    sub = lambda x, i: F.struct(F.coalesce(x["page_index"], i).cast("bigint").alias("sub"), own(x).alias("blocks"))
    empty = F.array().cast(f"array<struct<sub:bigint,blocks:array<{BLOCK}>>>")
    root = F.array(F.struct(F.coalesce("p.page_index", F.lit(0)).cast("bigint").alias("sub"), own(F.col("p")).alias("blocks")))
    flat = p.select("page", F.explode(F.concat(root, F.coalesce(F.transform("p.pages", sub), empty), F.coalesce(F.transform("p.results", sub), empty))).alias("s"))
    return flat.select("page", "s.sub", F.posexplode("s.blocks").alias("slot", "b")).withColumn("slot", F.col("slot").cast("bigint"))


def evidence_rows(blocks: DataFrame, scale: float = 1.0) -> DataFrame:
    """Flat rows of blocks: label, text, order, confidence and box under any of their names; rows without an area are left out."""
    box = F.coalesce("b.bbox", "b.box", "b.block_bbox")
    at = lambda i: F.get(box, F.lit(i)) * scale
    order = F.coalesce("b.order", "b.block_order")
    out = blocks.select(
        "page", "sub", "slot", F.lower(F.trim(F.coalesce("b.type", "b.label", "b.block_label", F.lit("unknown")))).alias("label"), F.coalesce("b.text", "b.content", "b.block_content", F.lit("")).alias("text"),
        order.cast("bigint").alias("ord"), F.when(order.isNotNull(), "explicit").otherwise("position").alias("order_source"), F.coalesce("b.confidence", "b.score").alias("confidence"),
        *[at(i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))],
    )
    return out.where("x1 > x0 AND y1 > y0")


def tree_nodes(payloads: DataFrame) -> DataFrame:
    """Nodes (page, ref, parent, pos, label, text) of a tree whose children are references: the body is the root, unresolved references are left out."""
    p = payloads.select("page", F.from_json("payload", TREE).alias("p"))
    none = F.array().cast(f"array<{NODE}>")
    nodes = p.select("page", F.explode(F.concat(F.array("p.body"), F.coalesce("p.groups", none), F.coalesce("p.texts", none))).alias("n")).select("page", F.coalesce("n.self_ref", F.lit("#/body")).alias("ref"), "n.label", "n.text", "n.children")
    links = nodes.select("page", F.col("ref").alias("parent"), F.posexplode("children").alias("pos", "c")).select("page", "parent", F.col("pos").cast("bigint").alias("pos"), F.col("c.$ref").alias("ref"))
    return nodes.select("page", "ref", "label", "text").join(links, ["page", "ref"], "left")


def table_cells(cells: DataFrame) -> DataFrame:
    """Cells (page, tab, row, col, text) with their row-major number in the table, counted over its widest row."""
    width = cells.groupBy("page", "tab").agg((F.max("col") + 1).alias("columns"))
    return cells.join(width, ["page", "tab"]).select("page", "tab", "row", "col", (F.col("row") * F.col("columns") + F.col("col") + 1).cast("bigint").alias("sub"), "text")


def display_blocks(strings: DataFrame) -> DataFrame:
    """Blocks printed as ``label: ..., bbox: [a, b, c, d], content: ...`` (page, pos, value) as rows; what has another form is left out."""
    form = r"(?s)label:\s*(\S+?),?\s+bbox:\s*\[([^\]]*)\],?\s*content:\s*(.*)"
    numbers = F.transform(F.split(F.regexp_extract("value", form, 2), r"\s*,\s*"), lambda x: x.try_cast("double"))
    out = strings.where(F.rlike("value", F.lit(form))).select("page", "pos", F.regexp_extract("value", form, 1).alias("label"), numbers.alias("n"), F.trim(F.regexp_extract("value", form, 3)).alias("text"))
    return out.where(F.size("n") == 4).select("page", "pos", "label", "text", *[F.get("n", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def with_companions(blocks: DataFrame, boxes: DataFrame, most: float = 1.0) -> DataFrame:
    """Blocks with number and score of the first layout box (page, ord, label, score, box) of the same label none of whose edges is over ``most`` away."""
    b = boxes.select("page", "label", "ord", "score", *[F.col(c).alias(f"l_{c}") for c in ("x0", "y0", "x1", "y1")])
    near = F.lit(True)
    for c in ("x0", "y0", "x1", "y1"):
        near = near & (F.abs(F.col(c) - F.col(f"l_{c}")) <= most)
    first = blocks.join(b, ["page", "label"]).where(near).groupBy("page", "pos").agg(F.min(F.struct("ord", "score")).alias("m"))
    return blocks.join(first, ["page", "pos"], "left").select("page", "pos", "label", "text", F.col("m.ord").alias("ord"), F.col("m.score").alias("score"))


def stamped(payloads: DataFrame, provider: str, version: str) -> DataFrame:
    """Payloads with their provenance: provider, version, review only, and a digest of the content."""
    return payloads.select("*", F.lit(provider).alias("provider"), F.lit(version).alias("version"), F.lit(True).alias("review_only"), F.sha2("payload", 256).alias("digest"))


def annotated_images(payloads: DataFrame) -> DataFrame:
    """Annotation sets with images, annotations and categories as rows (doc, image, label id, category, corners), in order of their ids.

    Annotations of unknown images or categories, or without an area, are left out.
    """
    p = payloads.select("doc", F.from_json("payload", COCO).alias("p"))
    images = p.select("doc", F.explode("p.images").alias("i")).select("doc", F.col("i.id").alias("image"), "i.file_name", "i.width", "i.height")
    names = p.select("doc", F.explode("p.categories").alias("c")).select("doc", F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    notes = p.select("doc", F.explode("p.annotations").alias("a")).select("doc", F.col("a.image_id").alias("image"), F.col("a.id").alias("annotation"), "a.category_id", *[F.get("a.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x", "y", "w", "h"))])
    return notes.where("w > 0 AND h > 0").join(images, ["doc", "image"]).join(names, ["doc", "category_id"]).select(
        "doc", "image", "annotation", "category", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1")
    )


def split_answers(rows: DataFrame, key: list[str], answers: list[str]) -> tuple[DataFrame, DataFrame]:
    """Inputs without the answer columns, numbered by a hash so that their order tells nothing, and the answers by key."""
    inputs = rows.drop(*answers).withColumn("shuffled", F.sha2(F.concat_ws(":", *key), 256))
    return inputs, rows.select(*key, *answers)


def leaked(inputs: DataFrame, answers: list[str]) -> list[str]:
    """Names of answer columns that inputs still have, in any case of letters."""
    names = {c.lower() for c in inputs.columns}
    return [a for a in answers if a.lower() in names]


def pixel_boxes(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Elements with pixel boxes (page, idx, box) in points of their page (page, scale_x, scale_y, width, height), cut to it; pages that are unknown are left out."""
    cut = lambda v, most: F.least(F.greatest(F.lit(0.0), v), F.col(most))
    p = elements.join(pages, "page")
    x = lambda c: cut(F.col(c) / F.col("scale_x"), "width")
    y = lambda c: cut(F.col(c) / F.col("scale_y"), "height")
    return p.select("page", "idx", F.least(x("x0"), x("x1")).alias("x0"), F.least(y("y0"), y("y1")).alias("y0"), F.greatest(x("x0"), x("x1")).alias("x1"), F.greatest(y("y0"), y("y1")).alias("y1"))


def fixture_pages(spark: SparkSession, pages: int, columns: int = 2, rows: int = 20) -> DataFrame:
    """Pages in columns with the order in which they are read (page, idx, place, text, box); the numbers of elements say nothing of it."""
    cells = spark.range(pages * columns * rows).select(F.floor(F.col("id") / (columns * rows)).alias("page"), (F.col("id") % (columns * rows)).alias("place"))
    column, row = F.floor(F.col("place") / rows), F.col("place") % rows
    x0, y0 = 36.0 + 280 * column, 60.0 + 30 * row
    shuffled = F.pmod(F.col("place") * 7 + F.col("page"), F.lit(columns * rows))
    return cells.select("page", shuffled.alias("idx"), "place", F.format_string("page %d line %d", "page", "place").alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 240).alias("x1"), (y0 + 12).alias("y1"))


def to_documents(elements: DataFrame) -> DataFrame:
    """(page, document): all elements of a page as one JSON document."""
    e = F.struct("idx", "text", "x0", "y0", "x1", "y1")
    return elements.groupBy("page").agg(F.sort_array(F.collect_list(e)).alias("elements")).select("page", F.to_json(F.struct(F.lit(1).alias("version"), "elements")).alias("document"))


def from_documents(documents: DataFrame) -> DataFrame:
    """The elements of :func:`to_documents`."""
    schema = "struct<version:int,elements:array<struct<idx:bigint,text:string,x0:double,y0:double,x1:double,y1:double>>>"
    return documents.select("page", F.explode(F.from_json("document", schema)["elements"]).alias("e")).select("page", "e.*")
