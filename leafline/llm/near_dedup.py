"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. Count in how many documents each hashed shingle feature occurs.
2. Draw weighted samples of every document, and join them into bands.
3. Equal texts are one node. Nodes that share a band key with others become
   candidates together with the first and the last node of that key.
4. Candidates are verified on whole texts, and links make components.
5. Keys whose members are still in different components are searched by an exact
   prefix join: similar texts share one of their rarest shingles. So no link
   between two members of a key is lost, and no key is expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.llm.common import bounded_batches, materialize, spread, tidy
from leafline.llm.graph import connected_components
from leafline.llm.shingles import mix, shingle_hashes


@dataclass(frozen=True)
class NearDedupParams:
    """``similarity``: from this weighted Jaccard similarity on two texts are linked.

    With ``bands`` x ``rows`` samples a pair at similarity s is a candidate with
    probability 1 - (1 - s^rows)^bands: 0.9983 at 0.8, 0.99995 at 0.85.
    ``idf_features``: shingles are hashed into so many features to count documents;
    the counts, not the documents, are what is broadcast.
    ``idf_span``: the rarest feature weighs 1 + idf_span, one in all documents 1.
    """

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 12
    rows: int = 4
    idf_features: int = 1 << 16
    idf_span: float = 0.25
    rarest: float = 1 / 256
    table: int = 1 << 15
    seed: int = 11


#: Shingles of a prefix that are kept with the next one.
_BEFORE = 32


class Weights:
    """Weights of the shingles of a text: (1 + ln tf) times a bounded idf."""

    def __init__(self, counts: np.ndarray, total: int, params: NearDedupParams):
        share = np.maximum(counts / max(total, 1), params.rarest)
        self.idf = (1 + params.idf_span * np.log(np.minimum(share, 1)) / np.log(params.rarest)).astype(np.float64)
        self.params = params

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        hashes, tf = np.unique(shingle_hashes(text, self.params.shingle), return_counts=True)
        return hashes, (1 + np.log(tf)) * self.idf[feature(hashes, self.params)]


def feature(hashes: np.ndarray, params: NearDedupParams) -> np.ndarray:
    return (hashes >> np.uint64(8)) & np.uint64(params.idf_features - 1)


class Sampler:
    """Improved consistent weighted sampling.

    The random numbers of a shingle under each sample are taken from tables at
    random by its hash. They depend on nothing else, so equal shingles have equal ones.
    """

    def __init__(self, params: NearDedupParams):
        self.params, n = params, params.bands * params.rows
        rng = np.random.default_rng(params.seed)
        self.r = rng.gamma(2.0, 1.0, (n, params.table)).astype(np.float32).ravel()
        self.log_c = np.log(rng.gamma(2.0, 1.0, (n, params.table))).astype(np.float32).ravel()
        self.beta = rng.random((n, params.table)).astype(np.float32).ravel()
        self.odd = (rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.base = (np.arange(n) * params.table)[:, None]
        self.shift = np.uint64(64 - (params.table - 1).bit_length())
        self.salt = mix(np.arange(1, n + 1, dtype=np.uint64))

    def band_keys(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        log_w = np.log(weights).astype(np.float32)
        best, winner = np.full(len(self.salt), np.inf, np.float32), np.zeros(len(self.salt), np.uint64)
        for a in range(0, len(hashes), 4_096):
            h, lw = hashes[a : a + 4_096], log_w[a : a + 4_096]
            at = ((h * self.odd) >> self.shift).astype(np.int64) + self.base
            r, beta = self.r[at], self.beta[at]
            t = np.floor(lw / r + beta)
            log_a = self.log_c[at] - r * (t - beta + 1)
            i = log_a.argmin(1)
            rows = np.arange(len(i))
            value = log_a[rows, i]
            better = value < best
            ids = mix(h[i] + t[rows, i].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            winner, best = np.where(better, ids, winner), np.where(better, value, best)
        keys = np.zeros(self.params.bands, np.uint64)
        for column in mix(winner ^ self.salt).reshape(self.params.bands, self.params.rows).T:
            keys = mix(keys * np.uint64(31) + column)
        return keys.view(np.int64)


_SAMPLERS: dict[NearDedupParams, Sampler] = {}


def sampler_for(params: NearDedupParams) -> Sampler:
    if params not in _SAMPLERS:
        _SAMPLERS[params] = Sampler(params)
    return _SAMPLERS[params]


def _counting(params: NearDedupParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(params.idf_features, np.int64)
        total = 0
        for batch in batches:
            for text in batch["text"].cast(pa.binary()):
                hashes = shingle_hashes(text.as_py(), params.shingle)
                total += bool(len(hashes))
                counts[np.unique(feature(hashes, params))] += 1
        at = np.flatnonzero(counts)
        at, n = np.append(at, -1), np.append(counts[at], total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["feature", "n"])

    return run


def _sampling(idf, params: NearDedupParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sampler = Weights(*idf.value, params), sampler_for(params)
        for batch in batches:
            keys = []
            for text in batch["text"].cast(pa.binary()):
                hashes, w = weights.of(text.as_py())
                keys.append(sampler.band_keys(hashes, w) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["same"], pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "same", "bands"])

    return run


def similarity(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted sets of weighted shingles."""
    _, i, j = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
    low = np.minimum(left[1][i], right[1][j]).sum()
    union = left[1].sum() + right[1].sum() - low
    return float(low / union) if union else 0.0


def _verifying(idf, params: NearDedupParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(*idf.value, params)
        last: tuple[int | None, tuple] = (None, ())
        for batch in batches:
            linked = []
            for a, x, y in zip(batch["a"].to_pylist(), batch["text_a"].cast(pa.binary()), batch["text_b"].cast(pa.binary()), strict=True):
                if last[0] != a:
                    last = (a, weights.of(x.as_py()))
                linked.append(similarity(last[1], weights.of(y.as_py())) >= params.similarity)
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, idf, params: NearDedupParams) -> DataFrame:
    """Of ``pairs`` (a, b), those that are linked. ``b`` gets its text first, so that the hot side, ``a``, is joined last and can be split."""
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return materialize(with_both.mapInArrow(tidy(_verifying(idf, params)), "a bigint, b bigint"), "links")


def prefix(hashes: np.ndarray, weights: np.ndarray, rarity: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles in order of ``rarity``, until the others weigh less than ``least`` of all, and what each weighs with all after it.

    Two texts whose similarity is at least ``least`` share more than ``least`` of the weight
    of either. So the first shingle that both have, in an order common to all texts, is in both prefixes.
    """
    order = np.lexsort((hashes, rarity))
    rest = np.cumsum(weights[order][::-1])[::-1]
    n = int(np.count_nonzero(rest >= least * rest[0] * (1 - 1e-9))) if len(rest) else 0
    return hashes[order[:n]], rest[:n]


def _prefixing(idf, params: NearDedupParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, counts = Weights(*idf.value, params), idf.value[0]
        for batch in batches:
            tokens, rests = [], []
            for text in batch["text"].cast(pa.binary()):
                hashes, w = weights.of(text.as_py())
                first, rest = prefix(hashes, w, counts[feature(hashes, params)], params.similarity)
                tokens.append(first.view(np.int64))
                rests.append(rest)
            made = [pa.array(tokens, pa.list_(pa.int64())), pa.array(rests, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["root"], *made], names=["node", "root", "tokens", "rests"])

    return run


def _across(crowds: DataFrame, rooted: DataFrame, texts: DataFrame, idf, params: NearDedupParams) -> DataFrame:
    """Pairs (a, b) of nodes from keys of ``crowds`` (key, node) with several roots of ``rooted``: all that can be linked and have different roots.

    They share a shingle of their prefixes, and no more can be common than what follows it in either of them.
    A pair is put out at the first shingle that both have: at a later one, another that both have is among the
    ``_BEFORE`` that come before it, or a pair is put out again.
    """
    member = crowds.join(rooted, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = member.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    left_over = member.join(mixed, "key").select("node", "root").distinct()
    own = texts.join(left_over.hint("merge"), "node").select("node", "root", "text")
    prefixes = own.mapInArrow(tidy(_prefixing(idf, params)), "node bigint, root bigint, tokens array<bigint>, rests array<double>")
    entry = prefixes.select("node", "root", "tokens", F.get("rests", F.lit(0)).alias("total"), F.posexplode("rests").alias("pos", "rest"))
    before = F.slice("tokens", F.greatest(F.col("pos") - (_BEFORE - 1), F.lit(1)), F.least(F.col("pos"), F.lit(_BEFORE)))
    entry = entry.select("node", "root", "total", F.get("tokens", F.col("pos")).alias("token"), "rest", before.alias("before"))
    entry = materialize(entry, "prefixes")
    shared = params.similarity / (1 + params.similarity) * (F.col("l.total") + F.col("r.total")) * (1 - 1e-9)
    met = (F.col("l.token") == F.col("r.token")) & (F.col("l.node") < F.col("r.node")) & (F.col("l.root") != F.col("r.root"))
    met &= (F.least("l.rest", "r.rest") >= shared) & ~F.arrays_overlap("l.before", "r.before")
    pairs = entry.alias("l").join(entry.alias("r").hint("merge"), met)
    return pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def _merged(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """``rooted`` (node, root) after further ``links`` (a, b): components of the roots that these connect."""
    root = lambda side: rooted.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    ends = links.join(root("a"), "a", "left").join(root("b"), "b", "left")
    between = ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    above = materialize(connected_components(between), "components").select(F.col("node").alias("at"), F.col("root").alias("top"))
    known = rooted.join(above, F.col("root") == F.col("at"), "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = above.join(rooted, F.col("at") == F.col("node"), "left_anti").select(F.col("at").alias("node"), F.col("top").alias("root"))
    return materialize(known.union(fresh), "components")


def document_frequencies(docs: DataFrame, params: NearDedupParams) -> tuple[np.ndarray, int]:
    """Documents with each of the ``idf_features`` features, and documents with any: a vector of fixed size."""
    rows = docs.select("text").mapInArrow(tidy(_counting(params)), "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    counts, total = np.zeros(params.idf_features, np.int64), 0
    for at, n in rows:
        if at < 0:
            total = n
        else:
            counts[at] = n
    return counts, total


def near_duplicates(docs: DataFrame, params: NearDedupParams = NearDedupParams()) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs`` (doc_id, text); a class has the least doc_id of its members.

    Null texts are empty. Documents without words are never linked. Texts of fewer
    than five words are one shingle. Rows that share a doc_id are one document. Rows
    with a null doc_id have a null class. Other columns play no role.

    The first candidates are (node, first node) and (node, last node) of each band
    key: as many pairs as it has nodes. The members of keys that are not in one
    component by then are joined on the rarest shingles of each, with bounds that
    no link escapes; what many of them share, as a passage or a line, is not among these.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    given = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    counts, total = document_frequencies(given, params)
    idf = spark.sparkContext.broadcast((counts, total))
    keyed = given.select("doc_id", F.md5(F.col("text").cast("binary")).alias("same"), "text")
    sampled = materialize(keyed.mapInArrow(tidy(_sampling(idf, params)), "doc_id bigint, same string, bands array<bigint>"), "bands")
    named = sampled.where("doc_id IS NOT NULL AND bands IS NOT NULL")
    nodes = materialize(named.groupBy("same").agg(F.min(F.struct("doc_id", "bands")).alias("first")).select("same", F.col("first.doc_id").alias("node"), "first.bands"), "nodes")

    members = nodes.select("node", F.explode("bands").alias("key"))
    ends = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("members")).where("low < high")
    found = materialize(members.join(ends, "key"), "found")
    pairs = (
        found.select(F.col("low").alias("a"), F.col("node").alias("b"))
        .union(found.select(F.col("node").alias("a"), F.col("high").alias("b")))
        .where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    )
    pairs = materialize(pairs, "pairs")
    involved = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # never a broadcast: the nodes that are in some pair grow with the corpus
    texts = keyed.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "node").join(involved.hint("merge"), "node")
    texts = materialize(texts.dropDuplicates(["node", "same"]).select("node", "text"), "texts")

    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    links = _verified(best, texts, idf, params)
    rooted = materialize(connected_components(links), "components")
    root = lambda side: rooted.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
    rest = rest.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")
    rooted = _merged(rooted, _verified(rest, texts, idf, params))
    # of up to three members, the first and the last have met all
    others = _across(found.where("members > 3").select("key", "node"), rooted, texts, idf, params).join(pairs, ["a", "b"], "left_anti")
    rooted = _merged(rooted, _verified(materialize(others, "pairs"), texts, idf, params))

    classes = nodes.select("same", "node").join(rooted, "node", "left").select("same", F.coalesce("root", "node").alias("class_id"))
    linked = named.select("doc_id", "same").join(classes, "same").select("doc_id", "class_id")
    others = sampled.where("doc_id IS NULL OR bands IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    return linked.union(others)
