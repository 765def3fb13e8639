"""Log-bilinear language model, trained with noise-contrastive estimation, and scores of whole texts.

The outputs of the model are the end of a text, the most frequent words, and
classes of all other words by their last letters. A word of such a class is scored
by the class and by its smoothed share in it. So every word gets a probability
from the model, and probabilities are normalised over all words.

Training takes several rounds. In each, shards of documents, dealt by a hash of
their content, start from the same model, and the average of theirs starts the next.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.llm.common import bounded_batches, materialize, spread, tidy

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The end of a text; no word is empty.
END = b""
BLOCKS = 64


@dataclass(frozen=True)
class LmParams:
    """``classes``: words with an output of their own; ``tail_classes``: outputs of all others, by their last ``suffix`` bytes.

    ``head_words``: words whose counts are broadcast; counts of all others are joined.
    ``noise``: samples that a minibatch shares. ``shard_tokens``: training tokens of a shard in a round, on average.
    """

    folds: int = 5
    held_out_fold: int = 1
    classes: int = 1_022
    tail_classes: int = 512
    suffix: int = 3
    head_words: int = 100_000
    dim: int = 32
    batch: int = 4_096
    noise: int = 32
    rate: float = 0.08
    rounds: int = 4
    shard_tokens: int = 500_000
    seed: int = 5
    flush_words: int = 300_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


def _counting(params: LmParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"].cast(pa.binary()).to_pylist():
                counts.update(words_of(text))
                counts[END] += 1
                if len(counts) >= params.flush_words:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return run


def tail_class(word: bytes, params: LmParams) -> int:
    return zlib.crc32(word[-params.suffix :]) % params.tail_classes


def tail_class_column(word: Column, params: LmParams) -> Column:
    """:func:`tail_class` in Spark."""
    return F.pmod(F.crc32(F.substring(word, -params.suffix, params.suffix)), F.lit(params.tail_classes)).cast("int")


class Vocabulary:
    """Counts of the end and of the head words; classes 0: end, 1 to n: words, from n + 1 on: classes of all others.

    As context all classes from n + 1 on are one, and n + 2 stands before the start.
    ``sums``: tokens and distinct words of each tail class, named words included.
    """

    def __init__(self, end: int, head: list[tuple[bytes, int]], tokens: int, words: int, sums: dict[int, tuple[int, int]], params: LmParams):
        self.rank = {w: i + 1 for i, (w, _) in enumerate(head)}
        self.count = np.array([end, *(n for _, n in head)], np.float64)
        self.named = named = min(params.classes, len(head))
        self.other, self.start, self.params = named + 1, named + 2, params
        self.cls = np.array([*range(named + 1), *(self.other + tail_class(w, params) for w, _ in head[named:])], np.int64)
        self.total = tokens + 0.5 * (words + 1)
        inside = np.zeros((params.tail_classes, 2))
        for k, pair in sums.items():
            inside[k] += pair
        for w, n in head[:named]:
            inside[tail_class(w, params)] -= (n, 1)
        self.tail_total = inside[:, 0] + 0.5 * (inside[:, 1] + 1)
        share = np.concatenate([self.count[: self.other], inside[:, 0]]) + 0.5
        self.unigram = share / share.sum()
        self.base = np.log10((self.count + 0.5) / self.total)
        self.inside = np.zeros(len(self.count))
        self.inside[self.other :] = np.log10((self.count[self.other :] + 0.5) / self.tail_total[self.cls[self.other :] - self.other])

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 outside the head; 0, the end, comes last."""
        get = self.rank.get
        return np.array([*(get(w, -1) for w in words), 0], np.int64)

    def classes(self, ranks: np.ndarray, tail: list[bytes]) -> np.ndarray:
        """``tail``: the words outside the head, in order."""
        out = self.cls[ranks]
        out[ranks < 0] = [self.other + tail_class(w, self.params) for w in tail]
        return out

    def context(self, classes: np.ndarray) -> np.ndarray:
        return np.minimum(classes, self.other)


class LogBilinear:
    """The next word's vector is predicted from those of the last two, each scaled by weights of its place."""

    def __init__(self, vocabulary: Vocabulary, params: LmParams):
        rng = np.random.default_rng(params.seed)
        self.n, self.width = len(vocabulary.unigram), vocabulary.start + 1
        self.log_noise = np.log(params.noise * vocabulary.unigram).astype(np.float32)
        self.cumulative = np.cumsum(vocabulary.unigram)
        self.shapes = {"context": (self.width, params.dim), "place": (2, params.dim), "word": (self.n, params.dim), "bias": (self.n, 1)}
        self.p = {
            "context": rng.normal(0, 0.1, self.shapes["context"]).astype(np.float32),
            "place": np.full(self.shapes["place"], 0.5, np.float32),
            "word": rng.normal(0, 0.1, self.shapes["word"]).astype(np.float32),
            "bias": np.log(vocabulary.unigram).astype(np.float32)[:, None],
        }
        self.squares = {k: np.full(s, 1e-6, np.float32) for k, s in self.shapes.items()}
        self.params = params
        self.log_z: np.ndarray | None = None

    def flat(self) -> np.ndarray:
        """Weights, then the sums of squares that set the rate of each."""
        return np.concatenate([x[k].ravel() for x in (self.p, self.squares) for k in self.shapes])

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for x in (self.p, self.squares):
            for k, s in self.shapes.items():
                x[k] = flat[at : at + s[0] * s[1]].reshape(s).astype(np.float32)
                at += s[0] * s[1]
        return self

    def hidden(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.p["context"][first] * self.p["place"][0] + self.p["context"][second] * self.p["place"][1]

    def step(self, first: np.ndarray, second: np.ndarray, word: np.ndarray, rng: np.random.Generator) -> None:
        """One minibatch of noise-contrastive estimation: words of the text against words drawn by frequency."""
        p, grow = self.p, {k: np.zeros(s, np.float32) for k, s in self.shapes.items()}
        noise = np.minimum(np.searchsorted(self.cumulative, rng.random(self.params.noise)), self.n - 1)
        h, w, q = self.hidden(first, second), p["word"][word], p["word"][noise]
        real = (h * w).sum(1) + p["bias"][word, 0] - self.log_noise[word]
        false = h @ q.T + p["bias"][noise, 0] - self.log_noise[noise]
        g_real = 1 / (1 + np.exp(-np.clip(real, -30, 30))) - 1
        g_false = 1 / (1 + np.exp(-np.clip(false, -30, 30)))
        back = g_real[:, None] * w + g_false @ q
        _scatter(grow["word"], word, g_real[:, None] * h)
        _scatter(grow["bias"], word, g_real[:, None])
        np.add.at(grow["word"], noise, g_false.T @ h)
        np.add.at(grow["bias"][:, 0], noise, g_false.sum(0))
        _scatter(grow["context"], np.concatenate([first, second]), np.concatenate([back * p["place"][0], back * p["place"][1]]))
        grow["place"][0] = (back * p["context"][first]).sum(0)
        grow["place"][1] = (back * p["context"][second]).sum(0)
        for k, g in grow.items():
            g /= len(word)
            self.squares[k] += g * g
            p[k] -= self.params.rate * g / np.sqrt(self.squares[k])

    def log_probabilities(self, first: np.ndarray, second: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural logarithms. The normalising sum over all classes is one matrix product
        per block of contexts; contexts that came before keep theirs.
        """
        width = self.width
        if self.log_z is None:
            self.log_z = np.full(width * width, np.nan, np.float32)
        code = first * width + second
        new = np.unique(code[np.isnan(self.log_z[code])])
        for a in range(0, len(new), 2_048):
            some = new[a : a + 2_048]
            scores = self.hidden(some // width, some % width) @ self.p["word"].T + self.p["bias"][:, 0]
            most = scores.max(1)
            self.log_z[some] = most + np.log(np.exp(scores - most[:, None]).sum(1))
        out = np.empty(len(word), np.float64)
        for a in range(0, len(word), 65_536):
            s = slice(a, a + 65_536)
            out[s] = np.einsum("ij,ij->i", self.hidden(first[s], second[s]), self.p["word"][word[s]]) + self.p["bias"][word[s], 0]
        return out - self.log_z[code]


def _scatter(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    here = at[order]
    starts = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
    total[here[starts]] += np.add.reduceat(rows[order], starts, 0)


def contexts(classes: list[np.ndarray], known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word before that, word) of all texts, one after the other."""
    word = np.concatenate(classes)
    before, earlier = np.empty_like(word), np.empty_like(word)
    before[1:], earlier[2:] = word[:-1], word[:-2]
    starts = np.cumsum([0, *map(len, classes[:-1])])
    before, earlier = known.context(before), known.context(earlier)
    before[starts] = earlier[starts] = known.start
    second = starts + 1
    earlier[second[second < len(word)]] = known.start  # of a text of one token it is the next one's start
    return before, earlier, word


def _classes(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in batch["classes"]]


def _training(vocabulary, weights, seed: int, params: LmParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each partition trains on all of its texts from the same start; the models' weighted sums come out in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rng = vocabulary.value, np.random.default_rng(seed)
        model, tokens = LogBilinear(known, params).load(weights.value), 0
        waiting: list[np.ndarray] = []
        size = 0

        def learn() -> int:
            data = contexts(waiting, known)
            order = rng.permutation(len(data[0]))
            for a in range(0, len(order), params.batch):
                i = order[a : a + params.batch]
                model.step(data[0][i], data[1][i], data[2][i], rng)
            return len(order)

        for batch in batches:
            for one in _classes(batch):
                waiting.append(one)
                size += len(one)
                if size >= 2 * params.shard_tokens:  # a bounded number of tokens at a time
                    tokens += learn()
                    waiting, size = [], 0
        if waiting:
            tokens += learn()
        if tokens:
            parts = np.array_split(model.flat().astype(np.float64) * tokens, BLOCKS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array([tokens] * BLOCKS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["block", "tokens", "weights"],
            )

    return run


def _adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for block, tokens, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            value = np.frombuffer(raw, np.float64)
            if block in sums:
                sums[block][0] += tokens
                sums[block][1] = sums[block][1] + value
            else:
                sums[block] = [tokens, value]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1].tobytes() for s in sums.values()], pa.binary())],
        names=["block", "tokens", "weights"],
    )


def train(encoded: DataFrame, tokens: int, vocabulary, params: LmParams) -> np.ndarray:
    """Parameters after all rounds; only averages, weighted by tokens, come to the driver.

    Shards and their order follow from the documents alone, and not from files or partitions.
    """
    spark, schema = encoded.sparkSession, "block int, tokens bigint, weights binary"
    weights = LogBilinear(vocabulary.value, params).flat()
    shards = max(1, tokens // (params.rounds * params.shard_tokens))
    dealt = encoded.where("NOT held_out").select("classes", F.xxhash64("doc_id", "classes").alias("deal"))
    dealt = dealt.withColumn("shard", F.pmod(F.shiftright("deal", 8), F.lit(shards)))
    for i in range(params.rounds):
        start = spark.sparkContext.broadcast(weights)
        own = dealt.where(F.pmod("deal", F.lit(params.rounds)) == i).repartition(shards, "shard").sortWithinPartitions("shard", "deal", "classes")
        models = own.select("classes").mapInArrow(tidy(_training(vocabulary, start, params.seed + i, params)), schema)
        rows = models.repartition(BLOCKS, "block").mapInArrow(_adding, schema).collect()
        if rows:
            weights = np.concatenate([np.frombuffer(r["weights"], np.float64) for r in sorted(rows, key=lambda r: r["block"])]) / rows[0]["tokens"]
    return weights


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``most``, in order.

    A histogram over 16 ranges of counts for each doubling gives the least count
    that can come; so no task sends more than its share of the words.
    """
    named = counts.where(F.col("word") != F.lit(END)).withColumn("level", F.floor(16 * F.log2("c")))
    total, least = 0, None
    for level, n in sorted(named.groupBy("level").count().collect(), reverse=True):
        total += n
        if total > most:
            break
        least = level
    if least is None:
        return []
    found = [(bytes(r["word"]), r["c"]) for r in named.where(F.col("level") >= least).select("word", "c").collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


_ENCODED = "doc_id bigint, held_out boolean, row bigint, n_tokens bigint, n_known bigint, base double, inside double, classes binary, tail array<binary>"


def _encoding(vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Classes of all tokens, sums over the words of the head, and the words outside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = vocabulary.value, TaskContext.get().partitionId() << 40
        seen = known.count > 0
        for batch in batches:
            sums: list[tuple] = []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                words = words_of(text)
                ranks = known.ranks(words)
                tail = [w for w, r in zip(words, ranks.tolist(), strict=False) if r < 0]
                head = ranks[ranks >= 0]
                sums.append((row, len(ranks), int(seen[head].sum()), float(known.base[head].sum()), float(known.inside[head].sum()), known.classes(ranks, tail).astype("<u2").tobytes(), tail))
                row += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
            made = [pa.array(c, t) for c, t in zip(zip(*sums, strict=True), kinds, strict=True)] if sums else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], *made], names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "inside", "classes", "tail"])

    return run


def _scoring(vocabulary, weights, params: LmParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        model = LogBilinear(known, params).load(weights.value)
        for batch in batches:
            classes = _classes(batch)
            if classes:
                score = model.log_probabilities(*contexts(classes, known)) / math.log(10)
                starts = np.cumsum([0, *map(len, classes[:-1])])
                names = [n for n in batch.schema.names if n != "classes"]
                yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(np.add.reduceat(score, starts), pa.float64())], names=[*names, "model"])

    return run


def lm_scores(docs: DataFrame, params: LmParams = LmParams()) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its base score and the model's log10 probability.

    Null and empty texts are their end alone. A null doc_id counts as an empty text
    for the fold. Repeated rows are scored one by one. Without training rows all
    words are unknown. Other columns play no role.

    Counts of the most frequent words, a fixed number, are broadcast. All other
    counts stay distributed: words outside the head are joined with them.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(params.folds))
    given = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (fold == params.held_out_fold).alias("held_out")))
    training = given.where(~F.col("held_out"))
    counted = training.select("text").mapInArrow(tidy(_counting(params)), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))
    counts = materialize(counted, "counts")
    tokens, words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = counts.where(F.col("word") == F.lit(END)).first()
    classed = counts.where(F.col("word") != F.lit(END)).groupBy(tail_class_column(F.col("word"), params).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    sums = {r["k"]: (r["n"], r["v"]) for r in classed.collect()}
    known = Vocabulary(end["c"] if end else 0, frequent_words(counts, params.head_words), tokens, words, sums, params)
    vocabulary = spark.sparkContext.broadcast(known)
    encoded = materialize(given.mapInArrow(tidy(_encoding(vocabulary)), _ENCODED), "classes")
    weights = spark.sparkContext.broadcast(train(encoded, tokens, vocabulary, params))

    scored = encoded.drop("tail").mapInArrow(tidy(_scoring(vocabulary, weights, params)), "doc_id bigint, held_out boolean, row bigint, n_tokens bigint, n_known bigint, base double, inside double, model double")
    tail = encoded.select("row", F.explode("tail").alias("word"))
    inside = F.element_at(F.array(*[F.lit(float(x)) for x in known.tail_total]), tail_class_column(F.col("word"), params) + 1)
    log = lambda total: F.log10((F.coalesce("c", F.lit(0)) + 0.5) / total)
    joined = tail.join(counts.hint("merge"), "word", "left")
    summed = joined.groupBy("row").agg(F.count("c").alias("k"), F.sum(log(F.lit(float(known.total)))).alias("b"), F.sum(log(inside)).alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(summed, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(int(tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), (F.col("model") + F.col("inside") + zero("s")).alias("score"),
    )
