"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ``window`` consecutive words of the benchmark
items. A block of up to three words is looked up by its hash in a shift table,
which says how many words can be skipped; only where it says none, the bucket of
the block gives the windows that end in it, and those are compared word by word.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafline.llm.common import bounded_batches, materialize, without

#: Lower-cases A-Z and turns every ASCII character but letters and digits into a space.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256)
)
RESULT = ["n_words", "n_hit", "hits", "items", "contaminated"]


@dataclass(frozen=True)
class DecontaminationParams:
    """``block_bytes``: benchmark text that is searched for at a time; a larger benchmark takes several passes.

    ``chunk``: windows of an item that stay together; a longer item is searched for in parts.
    """

    window: int = 10
    block_words: int = 3
    block_bytes: int = 1 << 20
    chunk: int = 20_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


class WuManber:
    """Windows of one length. Shift and bucket tables have a hash of the last words of a window as key.

    Blocks of equal hash share an entry: that makes a shift shorter, and never longer than it may be.
    """

    def __init__(self, length: int, block_words: int):
        self.length, self.block = length, min(block_words, length)
        self.most = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[list[bytes], int, list[int]]]] = {}
        self.known: dict[int, list[tuple[list[bytes], int, list[int]]]] = {}

    def add(self, words: list[bytes], owner: int) -> None:
        length, block = self.length, self.block
        keys = [hash(tuple(words[i : i + block])) for i in range(len(words) - block + 1)]
        for start in range(len(words) - length + 1):
            window = words[start : start + length]
            same = self.known.setdefault(hash(tuple(window)), [])
            entry = next((e for e in same if e[0][e[1] : e[1] + length] == window), None)
            if entry is None:
                entry = (words, start, [])
                same.append(entry)
                self.buckets.setdefault(keys[start + length - block], []).append(entry)
                for k in range(length - block + 1):
                    key, skip = keys[start + k], length - block - k
                    if self.shift.get(key, self.most) > skip:
                        self.shift[key] = skip
            if not entry[2] or entry[2][-1] != owner:
                entry[2].append(owner)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Start and owners of every occurrence, also of those that overlap."""
        length, block, most = self.length, self.block, self.most
        shift, end, n = self.shift.get, length, len(words)
        while end <= n:
            key = hash(tuple(words[end - block : end]))
            skip = shift(key, most)
            if skip:
                end += skip
                continue
            start = end - length
            window = words[start:end]
            for other, at, owners in self.buckets[key]:
                if other[at] == window[0] and other[at : at + length] == window:
                    yield start, owners
            end += 1


def build_searchers(items: Iterable[tuple[str | None, bytes]], params: DecontaminationParams) -> tuple[list[WuManber], list[str | None]]:
    """One searcher for each length of window, and the names of the items by number."""
    names: list[str | None] = []
    number: dict[str | None, int] = {}
    by_length: dict[int, WuManber] = {}
    one: dict[bytes, bytes] = {}
    for name, text in sorted(items, key=lambda x: (x[0] is None, x[0] or "", x[1])):
        words = [one.setdefault(w, w) for w in words_of(text)]
        if words:
            if name not in number:
                number[name] = len(names)
                names.append(name)
            length = min(params.window, len(words))
            if length not in by_length:
                by_length[length] = WuManber(length, params.block_words)
            by_length[length].add(words, number[name])
    for searcher in by_length.values():
        searcher.known = {}
    return [by_length[n] for n in sorted(by_length)], names


#: The tables of the block that this Python worker searched for last.
_SEARCHERS: dict[str, tuple[list[WuManber], list[str | None]]] = {}


def searchers_for(key: str, block, params: DecontaminationParams) -> tuple[list[WuManber], list[str | None]]:
    if key not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[key] = build_searchers(block.value, params)
    return _SEARCHERS[key]


def _chunks(params: DecontaminationParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items as words joined by spaces, in parts that hold every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = words_of(text)
                for a in range(0, max(1, len(words) - params.window + 1), params.chunk):
                    rows.append((item, b" ".join(words[a : a + params.chunk + params.window - 1])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["item", "text"])

    return run


def search(words: list[bytes], searchers: list[WuManber], marks: bytearray) -> set[int]:
    """Marks the words inside occurrences; returns the owners."""
    owners: set[int] = set()
    for searcher in searchers:
        length = searcher.length
        for start, own in searcher.find(words):
            marks[start : start + length] = b"\x01" * length
            owners.update(own)
    return owners


def runs_of(marks: bytearray) -> list[dict[str, int]]:
    out, at = [], marks.find(1)
    while at >= 0:
        end = marks.find(0, at)
        end = len(marks) if end < 0 else end
        out.append({"start": at, "end": end})
        at = marks.find(1, end)
    return out


_RESULT_TYPE = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("contaminated", T.BooleanType()),
])
_HITS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _searching(block, params: DecontaminationParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``block``: a broadcast list of (item, text). Columns of an earlier block are carried on."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers, names = searchers_for(key, block, params)
        for batch in batches:
            kept = [n for n in batch.schema.names if n not in RESULT]
            before = batch.schema.names[-1] == RESULT[-1]
            earlier = zip(batch["hits"].to_pylist(), batch["items"].to_pylist(), strict=True) if before else None
            out: dict[str, list] = {n: [] for n in RESULT}
            for text in batch["text"].cast(pa.binary()).to_pylist():
                words = words_of(text)
                marks, found = bytearray(len(words)), set()
                if earlier is not None:
                    hits, found_before = next(earlier)
                    found.update(found_before)
                    for h in hits:
                        marks[h["start"] : h["end"]] = b"\x01" * (h["end"] - h["start"])
                found.update(names[i] for i in search(words, searchers, marks) if names[i] is not None)
                n_hit = marks.count(1)
                for name, value in zip(RESULT, (len(words), n_hit, runs_of(marks) if n_hit else [], sorted(found), n_hit > 0), strict=True):
                    out[name].append(value)
            kinds = (pa.int64(), pa.int64(), _HITS_ARROW, pa.list_(pa.string()), pa.bool_())
            columns = [batch[n] for n in kept] + [pa.array(out[n], t) for n, t in zip(RESULT, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *RESULT])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """``docs`` with n_words, n_hit, hits (runs of word numbers), items (sorted names) and contaminated.

    Columns of ``docs`` with those names are replaced. Null texts have no words;
    items without words have no windows; those with a null id mark words, and are
    not named in ``items``. Rows of one item_id are one item. An empty benchmark
    finds nothing. Nothing is shuffled: documents stay in their partitions.

    The benchmark is searched for in blocks of ``block_bytes``, each broadcast in
    turn, so a broadcast is bounded whatever the size of the benchmark or of an item.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    items = items.mapInArrow(_chunks(params), "item string, text binary")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > params.block_bytes:
        items = materialize(items, "benchmark")
        size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // params.block_bytes))
    out = without(docs, RESULT)
    schema = T.StructType([*out.schema.fields, *_RESULT_TYPE.fields])
    for i in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i) if blocks > 1 else items
        block = spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in own.collect()])
        out = out.mapInArrow(_searching(block, params), schema)
        if i < blocks - 1:
            out = materialize(out, "decontaminated")
    return out


def contamination_digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )
