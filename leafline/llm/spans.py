"""Positions of regular-expression matches in built-in SQL.

Spark has functions for the texts of all matches but none for their places. Here
one pass of ``regexp_replace`` sets a mark on both sides of each match, and a
split at the marks gives gap, match, gap, ... whose lengths add up to places.
Places are code points; ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafline.llm.common import let

MARK = "\x01"
BLOCK = 256
SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"
BEFORE, AFTER = 40, 8


def empty(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def marked_spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches of ``pattern``, with some context on both sides.

    The pattern must neither match nor look for the control characters 1 and 2.
    """
    safe = F.translate(text, MARK, "\x02")
    parts = F.split(F.regexp_replace(safe, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK)
    return F.when(F.rlike(text, F.lit(pattern)), let(parts, _locate)).otherwise(empty())


def _locate(parts: Column) -> Column:
    """``parts``: gap, match, gap, ...; worked off in blocks, so that arrays are not copied once per match."""

    def block(b: Column) -> Column:
        def inside(p: Column) -> Column:
            def step(acc: Column, k: Column) -> Column:
                end = acc["pos"] + F.length(F.get(p, k))
                span = F.struct(
                    acc["pos"].alias("start"), end.alias("end"), F.get(p, k).alias("value"),
                    F.substring(F.get(parts, b * BLOCK + k - 1), -BEFORE, BEFORE).alias("before"),
                    F.substring(F.get(parts, b * BLOCK + k + 1), 1, AFTER).alias("after"),
                )
                grown = F.when(k % 2 == 1, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
                return F.struct(end.alias("pos"), grown.alias("spans"))

            start = F.struct(F.lit(0).alias("pos"), empty().alias("spans"))
            return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), start, step)

        return let(F.slice(parts, b * BLOCK + 1, BLOCK), inside)

    def join(acc: Column, b: Column) -> Column:
        moved = F.transform(
            b["spans"],
            lambda s: F.struct(
                (s["start"] + acc["pos"]).alias("start"), (s["end"] + acc["pos"]).alias("end"),
                s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after"),
            ),
        )
        return F.struct((acc["pos"] + b["pos"]).alias("pos"), F.concat(acc["out"], F.array(moved)).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), block)
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    return F.aggregate(blocks, start, join, lambda acc: F.flatten(acc["out"]))


def tagged(spans: Column, kind: str, rank: int) -> Column:
    """Spans as (start, rank, kind, end), which sorts by start and then by the order of the kinds."""
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))
    )


TAGGED = "struct<start:int,rank:int,kind:string,end:int>"


def joined(tags: Column) -> Column:
    """``kind:start:end`` of tagged spans, sorted and joined by commas."""
    return F.array_join(
        F.transform(F.sort_array(tags), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
