"""Evidence from the structure JSON of layout models: relations, streams, their endpoints, and orders of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.geometry import Box, coverage
from leafline.operators.matching import side
from leafline.operators.pages import by_lists

#: Names under which payloads keep edges, by kind.
EDGE_FIELDS = {
    "successor": ["successor_edges", "successor_relations", "ro_linkings", "reading_order_edges", "reading_order_relations", "reading_order_linkings"],
    "precedence": ["precedence_edges", "order_edges"],
}
_EDGES = "array<array<string>>"
_STREAM = "struct<stream_id:string,stream_type:string,sequence:array<string>>"
PAYLOAD = (
    "struct<elements:array<struct<id:string,text:string>>,relations:array<struct<type:string,source:string,target:string>>,"
    f"streams:array<{_STREAM}>,reading_streams:array<{_STREAM}>," + ",".join(f"{f}:{_EDGES}" for fields in EDGE_FIELDS.values() for f in fields) + ">"
)
BODY_LABELS = ["text", "text_block", "paragraph_text"]


def ref_key(ref: Column) -> Column:
    """References are compared without case and outer white space."""
    return F.lower(F.trim(ref))


def parsed(payloads: DataFrame) -> DataFrame:
    """(page, payload as JSON) with the payload as one struct of all known fields; what is not there is null."""
    return payloads.select("page", F.from_json("payload", PAYLOAD).alias("p"))


def structure_relations(payloads: DataFrame) -> DataFrame:
    """Distinct edges (page, kind, source, target) of every spelling, with the alias text of each end.

    Streams add the successors of their sequences. Edges without both ends are left out.
    """
    p = parsed(payloads)
    none = F.array().cast("array<struct<kind:string,source:string,target:string>>")
    edge = lambda kind, s, t: F.struct(kind.alias("kind"), s.alias("source"), t.alias("target"))
    listed = lambda kind: lambda e: edge(F.lit(kind), F.get(e, F.lit(0)), F.get(e, F.lit(1)))
    found = [F.coalesce(F.transform(f"p.{field}", listed(kind)), none) for kind, fields in EDGE_FIELDS.items() for field in fields]
    typed = F.transform("p.relations", lambda r: edge(F.when(F.lower(r["type"]).isin("precedence", "order", "before"), "precedence").otherwise("successor"), r["source"], r["target"]))

    def follow(stream: Column) -> Column:
        s = F.coalesce(stream["sequence"], F.array().cast("array<string>"))
        pairs = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.transform(pairs, lambda x: edge(F.lit("successor"), x["a"], x["b"]))

    streams = F.flatten(F.transform(_streams(), follow))
    whole = F.filter(F.concat(*found, F.coalesce(typed, none), streams), lambda e: e["source"].isNotNull() & e["target"].isNotNull())
    edges = F.transform(whole, lambda e: edge(e["kind"], ref_key(e["source"]), ref_key(e["target"])))
    named = F.filter("p.elements", lambda e: e["id"].isNotNull() & (F.trim(e["text"]) != ""))
    texts = F.coalesce(F.transform(named, lambda e: F.struct(ref_key(e["id"]).alias("ref"), e["text"].alias("alias"))), F.array().cast("array<struct<ref:string,alias:string>>"))
    rows = p.select("page", edges.alias("edges"), texts.alias("texts")).groupBy("page").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("edges", "texts")])
    rows = rows.select("page", F.array_distinct("edges").alias("edges"), F.sort_array("texts").alias("texts"))
    first = F.filter("texts", lambda x, i: (i == 0) | (F.get("texts", i.cast("int") - 1)["ref"] != x["ref"]))  # the least text of each
    flat = rows.select("page", F.map_from_entries(first).alias("alias"), F.explode("edges").alias("e"))
    of = lambda end: F.try_element_at("alias", F.col(f"e.{end}")).alias(f"{end}_alias")
    return flat.select("page", "e.*", of("source"), of("target"))


def _streams() -> Column:
    none = F.array().cast(f"array<{_STREAM}>")
    return F.concat(F.coalesce("p.reading_streams", none), F.coalesce("p.streams", none))


def aliases(payloads: DataFrame) -> DataFrame:
    """(page, ref, alias): text of the element that a reference names; of several the least."""
    flat = parsed(payloads).select("page", F.explode("p.elements").alias("e"))
    return flat.where("e.id IS NOT NULL AND trim(e.text) <> ''").groupBy("page", ref_key(F.col("e.id")).alias("ref")).agg(F.min("e.text").alias("alias"))


def structure_streams(payloads: DataFrame) -> DataFrame:
    """Members of streams: (page, stream, type, pos, ref); a stream without a name gets its number, one without members none."""
    flat = parsed(payloads).select("page", F.posexplode(_streams()).alias("n", "s"))
    name = F.coalesce(F.when(F.trim("s.stream_id") != "", F.col("s.stream_id")), F.concat(F.lit("stream-"), F.lpad((F.col("n") + 1).cast("string"), 3, "0")))
    return flat.select("page", name.alias("stream"), F.coalesce("s.stream_type", F.lit("body")).alias("type"), F.posexplode("s.sequence").alias("pos", "ref")).select(
        "page", "stream", "type", F.col("pos").cast("bigint").alias("pos"), ref_key(F.col("ref")).alias("ref")
    )


def endpoints(keys: DataFrame) -> DataFrame:
    """(page, ref, first, last, members) of keys (page, ref, idx): a key of several elements names the group of them."""
    return keys.groupBy("page", "ref").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("members"))


def resolved_relations(relations: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges of elements: from the last of the source's group to the first of the target's, with a status.

    An end without a key is tried by its alias. Groups that share an element are skipped. The relations and
    the keys of a page are lists of one row, so neither is joined by texts.
    """
    alias = lambda end: ref_key(F.col(f"{end}_alias")).alias(f"{end}_text")
    listed = relations.groupBy("page").agg(F.collect_list(F.struct("kind", "source", "target", alias("source"), alias("target"))).alias("relations"))
    known = keys.where("ref IS NOT NULL AND idx IS NOT NULL").groupBy("page").agg(F.collect_list(F.struct("ref", "idx")).alias("keys"))
    rows = listed.join(known, "page", "left").select("page", "relations", "keys")
    return by_lists(rows, _resolved, "page bigint, kind string, source_ref string, target_ref string, status string, source bigint, target bigint, by_alias boolean")


def _resolved(relations: list[list], keys: list[list]) -> list[list]:
    members: dict[str, set[int]] = {}
    for ref, idx in zip(*keys, strict=True):
        members.setdefault(ref, set()).add(idx)
    out = []
    for kind, source, target, source_text, target_text in zip(*relations, strict=True):
        a, b = members.get(source), members.get(target)
        by_alias = (a is None and source_text in members) or (b is None and target_text in members)
        a, b = members.get(source_text) if a is None else a, members.get(target_text) if b is None else b
        status = "unresolved" if a is None or b is None else "resolved" if a.isdisjoint(b) else "overlap"
        ends = (max(a), min(b)) if status == "resolved" else (None, None)
        out.append((kind, source, target, status, *ends, by_alias))
    return [list(c) for c in zip(*out, strict=True)]


def relation_statistics(resolved: DataFrame) -> DataFrame:
    """Edges of each kind and status."""
    return resolved.groupBy("kind", "status").agg(F.count("*").alias("edges"), F.count_if("by_alias").alias("by_alias"))


def resolved_streams(streams: DataFrame, keys: DataFrame) -> DataFrame:
    """Members (page, stream, pos, ref) as elements with their place in the stream; the first stream, by name, keeps an element, repeats fall away."""
    members = streams.join(keys, ["page", "ref"])
    first = Window.partitionBy("page", "stream", "idx").orderBy("pos")
    once = members.withColumn("n", F.row_number().over(first)).where("n = 1")
    owner = Window.partitionBy("page", "idx").orderBy("stream")
    owned = once.withColumn("m", F.row_number().over(owner))
    place = F.row_number().over(Window.partitionBy("page", "stream").orderBy("pos", "idx"))
    return owned.withColumn("place", place.cast("bigint")).select("page", "stream", "idx", "place", (F.col("m") > 1).alias("conflict"))


def order_companions(elements: DataFrame, anchors: DataFrame, blocks: DataFrame, least: float = 0.5) -> DataFrame:
    """The ordered block, of the same source and a compatible label, that holds an element whose own anchor has no order.

    ``anchors``: (page, idx, label, source); ``blocks``: (page, block, label, source, ord, box). Blocks of different orders leave the element alone.
    """
    e, b = Box.of("e_"), Box.of("b_")
    own = side(elements, "e_", "idx").join(anchors.select("page", F.col("idx").alias("e_idx"), "label", "source"), ["page", "e_idx"])
    joined = own.join(side(blocks.where("ord IS NOT NULL"), "b_", "block", "label", "source", "ord"), "page")
    compatible = (F.col("label") == F.col("b_label")) | (F.col("label").isin(BODY_LABELS) & F.col("b_label").isin("paragraph", "text", "list"))
    held = joined.where(compatible & (F.col("source") == F.col("b_source"))).withColumn("coverage", F.round(coverage(e, b), 8)).where(F.col("coverage") >= least)
    orders = held.groupBy("page", F.col("e_idx").alias("idx")).agg(
        F.count_distinct("b_ord").alias("orders"), F.max_by(F.struct("b_block", "b_ord", "coverage"), F.struct("coverage", -F.greatest(b.area, F.lit(1.0)), -F.col("b_block"))).alias("x")
    )
    return orders.where("orders = 1").select("page", "idx", F.col("x.b_block").alias("block"), F.col("x.b_ord").alias("ord"), F.col("x.coverage").alias("coverage"))


def tier_edges(ordered: DataFrame) -> DataFrame:
    """Precedence from one tier of explicit orders to the next (page, idx, ord, rank): last of the former by rank to first of the latter.

    Inside tiers the base order holds, so these edges and those between neighbours of a tier imply all others.
    """
    known = ordered.where("ord IS NOT NULL")
    tier = F.dense_rank().over(Window.partitionBy("page").orderBy("ord"))
    by_rank = known.withColumn("tier", tier)
    ends = by_rank.groupBy("page", "tier").agg(F.min_by("idx", "rank").alias("first"), F.max_by("idx", "rank").alias("last"))
    after = ends.withColumn("target", F.lead("first").over(Window.partitionBy("page").orderBy("tier")))
    inside = by_rank.withColumn("target", F.lead("idx").over(Window.partitionBy("page", "tier").orderBy("rank"))).where("target IS NOT NULL")
    return after.where("target IS NOT NULL").select("page", F.col("last").alias("source"), "target", F.lit("tier").alias("kind")).unionByName(
        inside.select("page", F.col("idx").alias("source"), "target", F.lit("inside").alias("kind"))
    )


def block_streams(elements: DataFrame) -> DataFrame:
    """Elements (page, idx, block, segment, col) of a block as a stream, if there are two and all share a segment and a column."""
    coherent = elements.groupBy("page", "block").agg(F.count("*").alias("members"), F.count_distinct("segment").alias("segments"), F.count_distinct("col").alias("cols"))
    kept = coherent.where("members >= 2 AND segments = 1 AND cols = 1").select("page", "block", "members")
    number = F.row_number().over(Window.partitionBy("page").orderBy("block"))
    return kept.withColumn("stream", F.concat(F.lit("block-"), F.lpad(number.cast("string"), 3, "0")))


def split_at_changes(members: DataFrame, change: str) -> DataFrame:
    """Parts of streams (page, stream, place, idx) that begin where ``change`` differs from the member before."""
    w = Window.partitionBy("page", "stream").orderBy("place")
    new = F.when(~F.lag(change).over(w).eqNullSafe(F.col(change)) & F.lag("place").over(w).isNotNull(), 1).otherwise(0)
    return members.withColumn("new", new).select("page", "stream", "idx", F.sum("new").over(w).alias("part"))


def split_chains(chains: DataFrame) -> DataFrame:
    """Parts of chains (page, chain, place, idx, box) that begin at a column wrap or at a gap over max(6, 2.5 x the median of positive gaps)."""
    w = Window.partitionBy("page", "chain").orderBy("place")
    before = lambda c: F.lag(c).over(w)
    with_gap = chains.withColumn("gap", F.col("y0") - before("y1")).withColumn("dx", (F.col("x0") + F.col("x1") - before("x0") - before("x1")) / 2)
    common = F.greatest(F.lit(0.0), F.least("x1", before("x1")) - F.greatest("x0", before("x0")))
    width = F.least(F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)), F.greatest(before("x1") - before("x0"), F.lit(1.0)))
    positive = F.sort_array(F.collect_list(F.when(F.col("gap") > 0, F.col("gap"))).over(Window.partitionBy("page", "chain")))
    typical = F.coalesce(F.get(positive, F.floor(F.size(positive) / 2).cast("int")), F.lit(1.0))
    s = with_gap.withColumn("shared", common / width).withColumn("limit", F.greatest(F.lit(6.0), 2.5 * typical))
    wrap = ((F.abs("dx") > 40) & (F.col("shared") < 0.25)) | (F.col("gap") < -50)
    new = F.when(wrap | ((F.col("gap") > F.col("limit")) & (F.col("shared") >= 0.5)), 1).otherwise(0)
    return s.withColumn("new", new).select("page", "chain", "idx", F.sum("new").over(w).alias("part"))


def unique_labels(labels: DataFrame, keys: DataFrame) -> DataFrame:
    """Labels (page, ref) with the element that alone has their key; others are null."""
    one = keys.groupBy("page", "ref").agg(F.count_distinct("idx").alias("n"), F.min("idx").alias("idx")).where("n = 1").drop("n")
    return labels.join(one, ["page", "ref"], "left")


def evidence_by_stem(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Sources (path) with the first evidence file (path) of the same stem; suffixes after the first dot don't count."""
    stem = lambda c: F.lower(F.regexp_extract(c, r"([^/]+?)(?:\.[^/]*)?$", 1))
    found = files.groupBy(stem("path").alias("stem")).agg(F.min("path").alias("evidence"))
    return sources.select("path", stem("path").alias("stem")).join(found, "stem", "left").select("path", "evidence")


def first_present(*columns: str) -> Column:
    """The first of several text columns that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in columns])


def stream_type(scope: Column, artifact: Column, sidebar: Column, caption: Column, region_path: Column, span: Column, strategy: Column) -> Column:
    """The stream that an element's tokens imply: artifact, sidebar, footnote, caption, island or body, in that order."""
    token = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", "-")
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    or_unknown = lambda c: F.when(token(c) == "", "unknown").otherwise(token(c))
    own = F.when(token(scope) == "", "body").otherwise(token(scope))
    actual = F.when((own == "body") & (token(artifact) != ""), "page-artifact").when((own == "body") & (token(sidebar) != ""), "sidebar").otherwise(own)
    return (
        F.when(actual == "page-artifact", F.concat(F.lit("page-artifact-"), or_unknown(artifact)))
        .when(actual == "sidebar", F.concat(F.lit("sidebar-"), or_unknown(sidebar))).when(actual == "footnote", "footnote")
        .when(token(caption) != "", F.concat(F.lit("caption-"), token(caption)))
        .when(F.contains(text(region_path), F.lit("table-island")) | F.startswith(text(span), F.lit("table")), "table-island")
        .when(F.contains(text(region_path), F.lit("grid-island")) | F.startswith(text(span), F.lit("grid")), "grid-island")
        .when(F.endswith(text(strategy), F.lit("table-row-major-v1")), "table-grid").otherwise("body")
    )


def stream_name(kind: Column, segment: Column, target: Column) -> Column:
    """The name of an element's stream on its page: islands and captions carry their segment or target."""
    part = F.concat(F.lit("segment-"), F.lpad(F.coalesce(segment, F.lit(0)).cast("string"), 3, "0"))
    slug = F.regexp_replace(F.coalesce(F.trim(target), F.lit("")), r"\s+", "-")
    return (
        F.when(kind == "body", "body-main").when(kind.isin("table-island", "grid-island"), F.concat(kind, F.lit("-"), part))
        .when(F.startswith(kind, F.lit("caption-")), F.concat(kind, F.when(slug != "", F.concat(F.lit("-target-"), slug)).otherwise(F.concat(F.lit("-"), part)))).otherwise(kind)
    )


def point_lookup(elements: DataFrame, page: int, idx: int) -> DataFrame:
    """The one element of a page and number; an error, when the row is read, if there is none."""
    row = F.struct(*[F.col(c) for c in elements.columns])
    found = elements.where((F.col("page") == page) & (F.col("idx") == idx)).agg(F.min(row).alias("x"))
    return found.select(F.when(F.col("x").isNull(), F.raise_error(F.lit(f"no element {page}/{idx}"))).otherwise(F.col("x")).alias("x")).select("x.*")
