"""Removal of repeated byte strings by a distributed merge sort of suffixes.

Suffixes start at anchors: places chosen by content, so that equal strings of
``length`` bytes have the same one. Anchors whose next bytes occur nowhere else
are left out. The rest are sorted in runs, exchanged by range as front-coded
blocks, and merged by loser trees, which give the common prefix of neighbours.
Together with the common suffixes of the bytes before, that tells how far a
repeat reaches on both sides of an anchor.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.llm.common import bounded_batches, materialize, settle, spread, tidy
from leafline.llm.shingles import word_hashes
from leafline.llm.suffixes import LoserTree, anchors, fingerprints, front_code, front_decode

_NOTHING = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class SuffixParams:
    """``window``: an anchor lies in the first so many bytes of a string of ``length`` bytes.

    ``run_entries``: suffixes that a task sorts at a time; ``range_entries``: those of a range, on average.
    ``splitter_sample``: suffixes for each range from which its ends are taken; they only balance the ranges.
    """

    length: int = 400
    window: int = 200
    run_entries: int = 40_000
    range_entries: int = 40_000
    splitter_bytes: int = 32
    splitter_sample: int = 16


def _anchoring(params: SuffixParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, prints = [], []
            for value in batch["text"].cast(pa.binary()):
                text = value.as_py()
                at = anchors(text, params.length, params.window)
                places.append(at.astype(np.int32))
                prints.append(fingerprints(text, at, params.length - params.window + 1))
            names = ["doc_id", "same", "n_bytes", "sha256"]
            yield pa.RecordBatch.from_arrays(
                [*(batch[n] for n in names), pa.array(places, pa.list_(pa.int32())), pa.array(prints, pa.list_(pa.int64()))],
                names=[*names, "places", "prints"],
            )

    return run


def _context(text: bytes, at: int, params: SuffixParams) -> tuple[bytes, bytes]:
    """The bytes from an anchor on, and those before it, last first."""
    return text[at : at + params.length], text[max(0, at - params.window + 1) : at][::-1]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that are in any span."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_RUN_SCHEMA = "part int, same binary, start int, end int, shared binary, sizes binary, rests binary, left_sizes binary, lefts binary, owners binary, places binary"
_RUN_ARROW = pa.schema([
    ("part", pa.int32()), ("same", pa.binary()), ("start", pa.int32()), ("end", pa.int32()), ("shared", pa.binary()), ("sizes", pa.binary()),
    ("rests", pa.binary()), ("left_sizes", pa.binary()), ("lefts", pa.binary()), ("owners", pa.binary()), ("places", pa.binary()),
])


def _run_rows(entries: list[tuple[bytes, bytes, bytes, int, bool]], splitters: list[bytes], params: SuffixParams) -> list[dict]:
    """Rows of one sorted run: a front-coded block for each range, and spans that are known already.

    Equal contexts become one entry. If there are several, or if all copies of their
    text go anyway, nothing is left to find out: the entry only serves others.
    """
    entries.sort(key=lambda e: (e[0], e[1]))
    rows, spans, kept, i = [], {}, [], 0
    while i < len(entries):
        forward, left, same, at, known = entries[i]
        j = i + 1
        while j < len(entries) and entries[j][0] == forward and entries[j][1] == left:
            j += 1
        if j - i > 1:
            for _, _, s, a, done in entries[i:j]:
                if not done:
                    spans.setdefault(s, []).append((a - len(left), a + len(forward)))
        kept.append((forward, left, same, -1 if known or j - i > 1 else at))
        i = j
    for s, own in spans.items():
        rows += [{"part": -1, "same": s, "start": a, "end": b} for a, b in merged(own)]
    cuts = [0, *(bisect.bisect_left(kept, x, key=lambda e: e[0]) for x in splitters), len(kept)]
    for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a < b:
            some = kept[a:b]
            shared, rests = front_code([e[0] for e in some])
            rows.append({
                "part": part,
                "shared": np.array(shared, np.uint16).tobytes(), "sizes": np.array([len(r) for r in rests], np.uint16).tobytes(), "rests": b"".join(rests),
                "left_sizes": np.array([len(e[1]) for e in some], np.uint16).tobytes(), "lefts": b"".join(e[1] for e in some),
                "owners": b"".join(e[2] for e in some), "places": np.array([e[3] for e in some], np.int32).tobytes(),
            })
    return rows


def _sorting(splitters: list[bytes], params: SuffixParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[tuple[bytes, bytes, bytes, int, bool]] = []
        for batch in batches:
            for same, text, places, gone in zip(batch["same"].to_pylist(), batch["text"].cast(pa.binary()), batch["places"].to_pylist(), batch["gone"].to_pylist(), strict=True):
                raw = text.as_py()
                for at in places:
                    forward, left = _context(raw, at, params)
                    if len(forward) + len(left) >= params.length:
                        entries.append((forward, left, same, at, gone))
                if len(entries) >= params.run_entries:
                    yield pa.RecordBatch.from_pylist(_run_rows(entries, splitters, params), _RUN_ARROW)
                    entries = []
        if entries:
            yield pa.RecordBatch.from_pylist(_run_rows(entries, splitters, params), _RUN_ARROW)

    return run


def _pieces(sizes: np.ndarray, data: bytes) -> list[bytes]:
    ends = np.cumsum(sizes.astype(np.int64)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def reach(forward_shared: np.ndarray, lefts: list[bytes], params: SuffixParams) -> tuple[np.ndarray, np.ndarray]:
    """For entries in the order of their suffixes: how far before the anchor the earliest and the latest repeat of ``length`` bytes start, or -1.

    A string that starts ``k`` bytes before an anchor is repeated if another entry
    shares ``length - k`` bytes from the anchor on and ``k`` bytes before it: if it
    has the same class in both orders, cut where neighbours share less.
    """
    n = len(lefts)
    first, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    least = params.length - params.window + 1
    near = forward_shared >= least
    live = np.flatnonzero(near | np.concatenate([near[1:], [False]]))
    if not len(live):
        return first, last
    group = np.cumsum(~near)
    forward = forward_shared[live].copy()
    forward[np.concatenate([[True], group[live][1:] != group[live][:-1]])] = 0
    order = sorted(range(len(live)), key=lambda i: lefts[live[i]])
    width = params.window
    table = np.zeros((len(live), width), np.uint8)
    size = np.array([len(lefts[live[i]]) for i in order])
    for row, i in enumerate(order):
        own = lefts[live[i]]
        table[row, : len(own)] = np.frombuffer(own, np.uint8)
    differ = table[1:] != table[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), width)
    shared = np.minimum(shared, np.minimum(size[1:], size[:-1]))
    shared = np.concatenate([[0], shared])
    by_left = np.empty(len(live), np.int64)
    for k in range(params.window):
        right = np.cumsum(forward < params.length - k)
        by_left[order] = np.cumsum(shared < k)
        keys = right * (len(live) + 1) + by_left
        at = np.argsort(keys, kind="stable")
        equal = keys[at][1:] == keys[at][:-1]
        twice = np.zeros(len(live), bool)
        twice[at[1:][equal]] = True
        twice[at[:-1][equal]] = True
        hit = live[twice]
        last[hit] = k
        first[hit[first[hit] < 0]] = k
    return last, first


def _merging(params: SuffixParams) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        runs, lefts, owners, places = [], [], [], []
        for row in table.select(["shared", "sizes", "rests", "left_sizes", "lefts", "owners", "places"]).to_pylist():
            shared = np.frombuffer(row["shared"], np.uint16).tolist()
            runs.append(front_decode(shared, _pieces(np.frombuffer(row["sizes"], np.uint16), row["rests"])))
            lefts.append(_pieces(np.frombuffer(row["left_sizes"], np.uint16), row["lefts"]))
            owners.append(row["owners"])
            places.append(np.frombuffer(row["places"], np.int32))
        at, order, forward = [0] * len(runs), [], []
        for i, _, n in LoserTree(runs):
            order.append((i, at[i]))
            forward.append(n)
            at[i] += 1
        last, first = reach(np.array(forward, np.int64), [lefts[i][k] for i, k in order], params)
        found: dict[bytes, list[tuple[int, int]]] = {}
        for x in np.flatnonzero(last >= 0):
            i, k = order[x]
            place = int(places[i][k])
            if place >= 0:
                found.setdefault(owners[i][16 * k : 16 * k + 16], []).append((place - int(last[x]), place + params.length - int(first[x])))
        rows = [(s, a, b) for s, own in found.items() for a, b in merged(own)]
        names, kinds = ["same", "start", "end"], [pa.binary(), pa.int32(), pa.int32()]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def _cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for same, text, spans in zip(batch["same"].to_pylist(), batch["text"].cast(pa.binary()), batch["spans"].to_pylist(), strict=True):
            raw, digest, at, gone = text.as_py(), hashlib.sha256(), 0, 0
            runs = merged([(s["start"], s["end"]) for s in spans])
            for a, b in runs:
                digest.update(raw[at:a])
                at, gone = b, gone + b - a
            digest.update(raw[at:])
            out.append((same, gone, [{"start": a, "end": b} for a, b in runs], digest.hexdigest()))
        kinds = [pa.binary(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=["same", "gone", "runs", "kept"])


def _splitters(texts: DataFrame, total: int, params: SuffixParams) -> list[bytes]:
    """Ends of ranges from a sample of suffixes, taken by a hash of the text: ``splitter_sample`` of 32 bytes for each range."""
    ranges = -(-total // params.range_entries)
    if ranges < 2:
        return []
    step = max(1, params.range_entries // params.splitter_sample)
    sample = (
        texts.select("same", "text", F.explode("places").alias("at"))
        .where(F.pmod(F.xxhash64("same", "at"), F.lit(step)) == 0)
        .select(F.expr(f"substring(cast(text AS binary), at + 1, {params.splitter_bytes})").alias("s"))
    )
    strings = sorted(bytes(r[0]) for r in sample.collect())
    return sorted({strings[len(strings) * i // ranges] for i in range(1, ranges)}) if strings else []


def repeated_bytes(docs: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with n_bytes, n_removed, spans (maximal removed runs) and kept_sha256.

    Null and empty texts have no bytes. Repeated rows, also with equal doc_id, are
    copies of one text: at ``length`` bytes or more all of them go. Null doc_ids stay
    null. Other columns play no role.

    Copies are one text from the start; equal contexts are one entry of a run. So
    what a text with many copies adds to a range is bounded by the number of runs.
    """
    bounded_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    same = F.unhex(F.md5(F.col("text").cast("binary")))
    read = spread(given).select("doc_id", same.alias("same"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "text")
    rows = materialize(read.mapInArrow(tidy(_anchoring(params)), "doc_id bigint, same binary, n_bytes bigint, sha256 string, places array<int>, prints array<bigint>"), "anchors")

    texts_of = rows.groupBy("same").agg(F.count("*").alias("copies"), F.min(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("owner"), "n_bytes", "places", "prints")).alias("x"))
    nodes = materialize(texts_of.where("x.n_bytes >= %d" % params.length).select("same", "x.owner", (F.col("copies") > 1).alias("gone"), "x.places", "x.prints"), "nodes")
    seen = nodes.select("same", "owner", "gone", F.explode(F.arrays_zip("places", "prints")).alias("p")).select("same", "owner", "gone", F.col("p.places").alias("at"), F.col("p.prints").alias("print"))
    # written first: a join right on the grouped side would keep a hot print in one task
    often = materialize(seen.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "prints")
    flagged = seen.join(often.hint("merge"), "print").groupBy("same", "owner", "gone").agg(F.collect_list("at").alias("places"))
    owned = given.select(same.alias("same"), F.coalesce("doc_id", F.lit(-1)).alias("owner"), "text")
    texts = materialize(owned.join(flagged.hint("merge"), ["same", "owner"]).dropDuplicates(["same", "owner"]).select("same", "gone", "places", "text"), "texts")

    total = texts.agg(F.sum(F.size("places"))).first()[0] or 0
    splitters = _splitters(texts, total, params)
    runs = materialize(texts.mapInArrow(tidy(_sorting(splitters, params)), _RUN_SCHEMA), "runs")
    blocks = runs.where("part >= 0")
    found = blocks.groupBy("part").applyInArrow(_merging(params), "same binary, start int, end int")
    spans = runs.where("part < 0").select("same", "start", "end").union(found)
    by_text = spans.groupBy("same").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = texts.where("NOT gone").select("same", "text").join(by_text, "same").mapInArrow(
        _cutting, "same binary, gone bigint, runs array<struct<start:int,end:int>>, kept string"
    )
    copied = nodes.where("gone").select("same", F.lit(None).cast("bigint").alias("gone"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("runs"), F.lit(_NOTHING).alias("kept"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    is_copy = F.col("kept").isNotNull() & F.col("gone").isNull()
    return rows.select("doc_id", "same", "n_bytes", "sha256").join(cut.union(copied), "same", "left").select(
        "doc_id", "n_bytes",
        F.when(is_copy, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(is_copy, whole).otherwise(F.coalesce("runs", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"),
        F.coalesce("kept", "sha256").alias("kept_sha256"),
    )


#: A word as three characters of seven bits; passages of many words are told apart by all of them.
_CODE = 3
PASSAGE_WORDS = 51


def _coding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch["text"].cast(pa.binary()):
            hashes = word_hashes(text.as_py()) if text.is_valid else np.empty(0, np.uint64)
            out.append(((hashes[:, None] >> np.array([40, 47, 54], np.uint64)) & np.uint64(127)).astype(np.uint8).tobytes().decode("ascii"))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.string())], names=["doc_id", "text"])


def repeated_passages(docs: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with ``n_passage_words``: words in passages of ``words`` words or more that start anywhere else too.

    The same sort as of bytes, over texts in which every word is three characters; white space plays no role.
    """
    bounded_batches(docs.sparkSession)
    coded = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_coding, "doc_id bigint, text string")
    length = _CODE * words
    found = repeated_bytes(coded, SuffixParams(length=length, window=length // 2))
    return found.select("doc_id", F.floor(F.col("n_removed") / _CODE).cast("bigint").alias("n_passage_words"))


def repeated(docs: DataFrame) -> DataFrame:
    """:func:`repeated_bytes` with the words in repeated passages, row by row, whatever ids rows share.

    Rows are numbered by their place in the files of ``docs``, which every scan gives alike.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("id"), "text")
    as_rows = numbered.select(F.col("row").alias("doc_id"), "text")
    passages = settle(lambda: repeated_passages(as_rows), "passages")
    both = repeated_bytes(as_rows).join(passages, "doc_id")
    return both.withColumnRenamed("doc_id", "row").join(numbered.select("row", "id"), "row").withColumnRenamed("id", "doc_id").drop("row")


def repeated_bytes_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256", "n_passage_words")
