"""Packing: token sequences of one length, filled with lexical neighbours of their first document.

1. Documents are turned into token ids once; document frequencies and the mean
   length are counted over all of them.
2. Documents are sorted by the clusters of their BM25 vectors, so that documents
   with much in common lie side by side. The order is cut into ranges, and a range
   into shards of bounded size.
3. Each shard has a BM25 inverted index with the statistics of the whole corpus.
   The document that opens a sequence is the query, and unused documents are
   appended in the order of their scores until the sequence is full. The document
   that crosses the end is cut, and its rest opens the next sequence.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafline.llm.common import bounded_batches, discard, materialize, spread, tidy
from leafline.llm.merges import PairMerges
from leafline.llm.shingles import run_hashes


@dataclass(frozen=True)
class PackingParams:
    """``tokenizer``: path of a file of the tokenizers library; None: the public word-level BPE file.

    ``shard_tokens``: tokens in a shard, which is held in memory; a longer document is a shard by itself.
    ``range_tokens``: tokens in a range, that is in a task; more, if there would be over ``most_ranges`` of them.
    ``clusters``: clusters of documents, and as many parts of each; fitted on at most about ``cluster_sample`` documents.
    ``dense_share``: terms in at least this share of a shard's documents are kept as rows over all of them.
    ``cached_words``: distinct words, of ``cached_bytes`` at most, whose ids a worker keeps, of those that the tokenizer encodes one by one.
    """

    length: int = 2048
    end_id: int = 1
    tokenizer: str | None = None
    shard_tokens: int = 1_500_000
    range_tokens: int = 3_000_000
    most_ranges: int = 100_000
    clusters: int = 32
    cluster_sample: int = 20_000
    dim: int = 32
    dense_share: float = 0.05
    k1: float = 1.2
    b: float = 0.75
    cached_words: int = 120_000
    cached_bytes: int = 48
    seed: int = 3


#: Texts of these characters alone are split into words here, as the tokenizer's own normalizer and splitter do it:
#: letters, single digits, and runs of other marks. Apostrophes are left out, as the splitter knows contractions.
_OTHER_THAN_PLAIN = re.compile("[^\t\n\r\x20-&(-~À-ÖØ-öø-įı-ſ]")
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


_PROBE = "Ab cD, e.f! 12 Éç_x--(Y)\n z the\t [Straße] #1"


class CachedTokenizer:
    """Ids of texts as little-endian uint32 bytes.

    The vocabulary's merges never cross a word, so each distinct word of a batch, told
    apart by a 64-bit hash, is encoded once: by merges of all words together, and very
    long words by the tokenizer, whose ids are kept. Texts with other than plain Latin
    characters, and such with the marks of special tokens, go to the tokenizer whole.
    """

    def __init__(self, path: str | None, cached_words: int, cached_bytes: int = 48):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer, self.most, self.longest, self.cache = Tokenizer.from_file(path), cached_words, cached_bytes, {}
        if type(self.tokenizer.model).__name__ != "BPE" or self.tokenizer.model.end_of_word_suffix != "</w>":
            self.most = 0  # words of other tokenizers are not known to be independent
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.merges = PairMerges.of(self.tokenizer) if self.most else None
        if self.merges and self._encode_plain([_PROBE]) != self._encode([_PROBE]):
            self.merges = None
        if self.most and self._encode_plain([_PROBE]) != self._encode([_PROBE]):
            self.most, self.cache = 0, {}  # it normalizes or splits in another way

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Joined by spaces, words are encoded as they are alone, and the last id of each is one that ends a word."""
        out: list[bytes] = []
        for i in range(0, len(words), 1_000):
            some = words[i : i + 1_000]
            ids = np.asarray(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
                out += [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
            else:
                out += self._encode(some)
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        plain = [bool(self.most) and "<|" not in t and not _OTHER_THAN_PLAIN.search(t) for t in texts]
        whole = iter(self._encode([t for t, p in zip(texts, plain, strict=True) if not p]))
        split = iter(self._encode_plain([t for t, p in zip(texts, plain, strict=True) if p]))
        return [next(split if p else whole) for p in plain]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Words of all texts are found in one array of bytes, and each distinct word is looked up once."""
        if not texts:
            return []
        parts = [t.lower().encode() for t in texts]
        data = b"\n".join(parts)
        raw = np.frombuffer(data, np.uint8)
        cls = _CLASS[raw]
        new = np.flatnonzero((cls[1:] != cls[:-1]) | (cls[1:] == 2)) + 1
        starts = np.concatenate([[0], new])
        ends = np.concatenate([new, [len(raw)]])
        words = cls[starts] > 0 if len(raw) else np.zeros(1, bool)
        starts, ends = starts[words], ends[words]
        _, first, which = np.unique(run_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        flat, begin, size = self._ids_of_words(data, raw, starts[first], ends[first])
        n = size[which]
        total = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(begin[which] - total[:-1], n) + np.arange(total[-1])].astype("<u4").tobytes()
        text_ends = np.cumsum([len(p) + 1 for p in parts])
        cuts = [0, *(4 * total[np.searchsorted(starts, text_ends)]).tolist()]
        return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _ids_of_words(self, data: bytes, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, where each word's begin, and how many it has."""
        if self.merges is None:
            return self._looked_up(data, starts, ends)
        short = ends - starts <= self.merges.longest
        begin, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        flat, begin[short], size[short] = self.merges.encode(raw, starts[short], (ends - starts)[short])
        if not short.all():
            others, at, size[~short] = self._looked_up(data, starts[~short], ends[~short])
            begin[~short] = at + len(flat)
            flat = np.concatenate([flat, others])
        return flat, begin, size

    def _looked_up(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        distinct = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids = list(map(self.cache.get, distinct))
        unknown = [i for i, x in enumerate(ids) if x is None]
        made = self._encode_words([distinct[i].decode() for i in unknown])
        for i, x in zip(unknown, made, strict=True):
            ids[i] = x
        room = self.most - len(self.cache)
        if room > 0:  # the first words of a text are mostly the frequent ones
            self.cache.update((distinct[i], ids[i]) for i in unknown[:room] if len(distinct[i]) <= self.longest)
        size = np.array([len(x) >> 2 for x in ids], np.int64)
        return np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size, size


@dataclass(frozen=True)
class Corpus:
    """Inverse document frequency of each term, and mean length, over all documents."""

    idf: np.ndarray
    mean: float

    @classmethod
    def of(cls, df: np.ndarray, documents: int, tokens: int) -> Corpus:
        return cls(np.log1p((documents - df + 0.5) / (df + 0.5)).astype(np.float32), max(tokens / max(documents, 1), 1e-9))


class Index:
    """BM25 postings of one shard, in arrays sorted by term; documents that are used up are dropped from time to time."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus, params: PackingParams):
        self.params = params
        unique = [np.unique(d, return_counts=True) for d in docs]
        sizes = np.array([len(u[0]) for u in unique])
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.terms = np.concatenate([u[0] for u in unique]).astype(np.int32)
        counts = np.concatenate([u[1] for u in unique]).astype(np.float32)
        owner = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        lengths = np.array([len(d) for d in docs], np.float32)
        norm = (params.k1 * (1 - params.b + params.b * lengths / corpus.mean)).astype(np.float32)
        impact = corpus.idf[self.terms] * counts * np.float32(params.k1 + 1) / (counts + norm[owner])
        self._build(np.arange(len(docs)), self.terms, owner, impact)

    def _build(self, active: np.ndarray, terms: np.ndarray, owner: np.ndarray, impact: np.ndarray) -> None:
        """``active``: documents that can still be found; ``owner`` counts in them."""
        self.active = active
        df = np.bincount(terms, minlength=int(self.terms.max(initial=0)) + 1)
        frequent = np.flatnonzero(df >= max(1, self.params.dense_share * len(active)))
        self.row = np.full(len(df), -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), len(active)), np.float32)
        is_frequent = self.row[terms] >= 0
        self.dense[self.row[terms[is_frequent]], owner[is_frequent]] = impact[is_frequent]
        terms, owner, impact = terms[~is_frequent], owner[~is_frequent], impact[~is_frequent]
        order = np.argsort(terms, kind="stable")
        self.by_term, self.docs, self.impact = terms[order], owner[order], impact[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(df)))])

    def shrink(self, unused: np.ndarray) -> None:
        """Leaves out documents that are used, if they are half of those left."""
        keep = unused[self.active]
        if 2 * np.count_nonzero(keep) > len(keep):
            return
        place = np.cumsum(keep, dtype=np.int32) - 1
        row, column = np.nonzero(self.dense[:, keep])
        terms = np.flatnonzero(self.row >= 0).astype(np.int32)[row]
        values = self.dense[:, keep][row, column]
        rare = keep[self.docs]
        self._build(
            self.active[keep], np.concatenate([terms, self.by_term[rare]]),
            np.concatenate([column.astype(np.int32), place[self.docs[rare]]]), np.concatenate([values, self.impact[rare]]),
        )

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with ``seed``, best first; every distinct term of the seed counts."""
        self.shrink(unused)
        own = self.terms[self.begins[seed] : self.ends[seed]]
        rows = self.row[own]
        query = np.zeros(len(self.dense), np.float32)
        query[rows[rows >= 0]] = 1
        score = query @ self.dense if len(query) else np.zeros(len(self.active), np.float32)
        rare = own[rows < 0]
        sizes = self.starts[rare + 1] - self.starts[rare]
        if sizes.sum():
            at = np.repeat(self.starts[rare] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            score = score + np.bincount(self.docs[at], self.impact[at], len(self.active))
        score = score * unused[self.active]
        found = np.flatnonzero(score > 0)
        if len(found) > 64:  # mostly a few are enough to fill a sequence
            least = np.partition(score[found], -32)[-32]
            first = found[score[found] >= least]
            yield from self.active[first[np.argsort(-score[first], kind="stable")]].tolist()
            found = found[score[found] < least]
        yield from self.active[found[np.argsort(-score[found], kind="stable")]].tolist()


def pack_shard(docs: list[np.ndarray], corpus: Corpus, params: PackingParams) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece.

    The last sequence of a shard is cut into powers of two, which need no padding.
    """
    if not docs:
        return
    index, unused = Index(docs, corpus, params), np.ones(len(docs), bool)
    sequence, pieces, room, cursor = 0, [], params.length, 0
    ranked: Iterator[int] | None = None
    rest: tuple[int, int] | None = None
    while True:
        if rest is not None:
            doc, start = rest
        else:
            if ranked is None and pieces:
                ranked = index.neighbours(pieces[0][0], unused)
            doc = next((d for d in ranked or () if unused[d]), -1)
            if doc < 0:  # no neighbour is left: the next document opens, or asks anew
                while cursor < len(docs) and not unused[cursor]:
                    cursor += 1
                if cursor == len(docs):
                    break
                doc, ranked = cursor, index.neighbours(cursor, unused) if pieces else None
            unused[doc], start = False, 0
        take = min(room, len(docs[doc]) - start)
        pieces.append((doc, start, take))
        room -= take
        rest = (doc, start + take) if start + take < len(docs[doc]) else None
        if not room:
            offset = 0
            for d, s, n in pieces:
                yield d, s, n, sequence, offset
                offset += n
            sequence, pieces, room, ranked = sequence + 1, [], params.length, None
    left = params.length - room
    queue = pieces[::-1]
    for bit in reversed(range(left.bit_length())):
        want, offset = left & (1 << bit), 0
        while want:
            d, s, n = queue.pop()
            take = min(n, want)
            yield d, s, take, sequence, offset
            want, offset = want - take, offset + take
            if take < n:
                queue.append((d, s + take, n - take))
        sequence += bool(left & (1 << bit))


_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
])
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


_TOKENIZERS: dict[tuple[str | None, int, int], CachedTokenizer] = {}


def tokenizer_for(params: PackingParams) -> CachedTokenizer:
    """One tokenizer per Python worker, which keeps its words from task to task."""
    key = (params.tokenizer, params.cached_words, params.cached_bytes)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = CachedTokenizer(*key)
    return _TOKENIZERS[key]


def _encoding(params: PackingParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, hash, row, width, ids): ids with the end id, of 2 bytes each if the vocabulary allows; ``row`` tells equal rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, row = tokenizer_for(params), TaskContext.get().partitionId() << 40
        width = 2 if max(len(tokenizer.ends), params.end_id + 1) <= 1 << 16 else 4
        end = np.array([params.end_id], f"<u{width}").tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                ids = [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() + end for x in tokenizer.encode_batch([t or "" for t in some["text"].to_pylist()])]
                n = len(ids)
                made = [some["doc_id"], some["hash"], pa.array(range(row, row + n), pa.int64()), pa.array([width] * n, pa.int32()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "hash", "row", "width", "ids"])
                row += n

    return run


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), f"<u{w}") for x, w in zip(batch["ids"], batch["width"].to_pylist(), strict=True)]


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each term, and under -1 and -2 all documents and tokens."""
    df, documents, tokens = np.zeros(1 << 16, np.int64), 0, 0
    for batch in batches:
        for ids in _arrays(batch):
            terms = np.unique(ids)
            if terms[-1] >= len(df):
                df = np.concatenate([df, np.zeros(2 * int(terms[-1]) - len(df), np.int64)])
            df[terms] += 1
            documents, tokens = documents + 1, tokens + len(ids)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, [-1, -2]), pa.int64()), pa.array(np.append(df[at], [documents, tokens]), pa.int64())], names=["term", "n"]
    )


def corpus_statistics(encoded: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents with each term, all documents, all tokens. What reaches the driver is as large as the vocabulary."""
    rows = encoded.select("ids", "width").mapInArrow(tidy(_counting), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = {r["term"]: r["n"] for r in rows}
    documents, tokens = total.pop(-1, 0), total.pop(-2, 0)
    df = np.zeros(max(total, default=0) + 1, np.int64)
    for term, n in total.items():
        df[term] = n
    return df, documents, tokens


class Vectors:
    """Unit vectors of documents: random projections of their BM25 weights."""

    def __init__(self, corpus: Corpus, params: PackingParams):
        rng = np.random.default_rng(params.seed)
        self.corpus, self.params = corpus, params
        self.of_term = rng.standard_normal((len(corpus.idf), params.dim), np.float32) * corpus.idf[:, None]

    def of(self, docs: list[np.ndarray]) -> np.ndarray:
        p, out = self.params, np.empty((len(docs), self.params.dim), np.float32)
        for i, ids in enumerate(docs):
            terms, counts = np.unique(ids, return_counts=True)
            norm = p.k1 * (1 - p.b + p.b * len(ids) / self.corpus.mean)
            out[i] = (counts / (counts + norm)).astype(np.float32) @ self.of_term[terms]
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)


def spherical_means(points: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` unit vectors to which the points are close; fewer points than that are repeated."""
    means = points[rng.permutation(len(points))[np.arange(n) % len(points)]]
    for _ in range(10):
        nearest = (points @ means.T).argmax(1)
        sums = np.zeros_like(means)
        np.add.at(sums, nearest, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        means = np.where(size > 0, sums / np.maximum(size, 1e-12), means)
    return means


def fitted_clusters(encoded: DataFrame, corpus, documents: int, params: PackingParams) -> np.ndarray:
    """Means of the clusters, then of the parts of each, from a sample of rows by a hash of their content."""
    step = max(1, documents // params.cluster_sample)
    some = encoded.where(F.pmod(F.xxhash64("hash"), F.lit(step)) == 0).select("hash", "ids", "width").dropDuplicates(["hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(corpus.value, params)
        for batch in batches:
            found = vectors.of(_arrays(batch))
            yield pa.RecordBatch.from_arrays([batch["hash"], pa.array([v.tobytes() for v in found], pa.binary())], names=["hash", "vector"])

    rows = sorted(some.mapInArrow(run, "hash bigint, vector binary").collect())
    if not rows:
        return np.zeros((1 + params.clusters, params.clusters, params.dim), np.float32)
    points, rng = np.stack([np.frombuffer(r["vector"], np.float32) for r in rows]), np.random.default_rng(params.seed)
    top = spherical_means(points, params.clusters, rng)
    nearest = (points @ top.T).argmax(1)
    parts = [spherical_means(own if len(own := points[nearest == k]) else top[k : k + 1], params.clusters, rng) for k in range(params.clusters)]
    return np.stack([top, *parts])


def _placing(corpus, means, params: PackingParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the cluster of each document and its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, clusters = Vectors(corpus.value, params), means.value
        for batch in batches:
            if batch.num_rows:
                found = vectors.of(_arrays(batch))
                cluster = (found @ clusters[0].T).argmax(1)
                part = np.einsum("nd,nkd->nk", found, clusters[1:][cluster]).argmax(1)
                keys = [pa.array(cluster.astype(np.int32)), pa.array(part.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *keys], names=[*batch.schema.names, "cluster", "part"])

    return run


def _packing(corpus, params: PackingParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs the sorted documents of a range, one shard after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        names: list[int | None] = []
        docs: list[np.ndarray] = []
        tokens = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows: list[tuple] = []
            last = -1
            for d, start, n, s, offset in pack_shard(docs, corpus.value, params):
                rows.append((names[d], start, n, docs[d][start : start + n].astype("<u4").tobytes(), len(docs[d]), sequence + s, offset))
                last = s
                if len(rows) == 2_000:
                    yield _piece_batch(rows)
                    rows = []
            if rows:
                yield _piece_batch(rows)
            sequence += last + 1

        for batch in batches:
            for name, ids in zip(batch["doc_id"].to_pylist(), _arrays(batch), strict=True):
                if docs and tokens + len(ids) > params.shard_tokens:
                    yield from packed()
                    names, docs, tokens = [], [], 0
                names.append(name)
                docs.append(ids)
                tokens += len(ids)
        yield from packed()

    return run


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=_SCHEMA.names)


def pack(docs: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """Pieces of all documents (doc_id, text): ids of each (little-endian uint32) and its place in a sequence.

    A null or empty text is its end id alone. Repeated rows are packed one by one.
    A null doc_id stays null. An empty table gives no pieces. The one shuffle deals
    ids by ranges of cluster, part, a hash and the number of the row,
    so copies of one text, however many, are split over ranges and shards.

    The number of ranges follows from the tokens alone, and not from the session.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("bigint"), "text").alias("hash")))
    encoded = materialize(texts.mapInArrow(tidy(_encoding(params)), "doc_id bigint, hash bigint, row bigint, width int, ids binary"), "ids")
    df, documents, tokens = corpus_statistics(encoded)
    corpus = spark.sparkContext.broadcast(Corpus.of(df, documents, tokens))
    means = spark.sparkContext.broadcast(fitted_clusters(encoded, corpus, documents, params))
    schema = "doc_id bigint, hash bigint, row bigint, width int, ids binary, cluster int, part int"
    placed = materialize(encoded.mapInArrow(tidy(_placing(corpus, means, params)), schema), "placed")
    discard(encoded.written_to)
    ranges = max(1, min(params.most_ranges, -(-tokens // params.range_tokens)))
    order = ["cluster", "part", "hash", "row"]
    dealt = placed.repartitionByRange(ranges, *order) if ranges > 1 else placed.coalesce(1)
    return dealt.sortWithinPartitions(*order).select("doc_id", "width", "ids").mapInArrow(tidy(_packing(corpus, params)), _SCHEMA)


def packing_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
