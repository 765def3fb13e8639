"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from leafline.llm import queries as registered
from leafline.llm.decontaminate import DecontaminationParams, contamination_digest, decontaminate
from leafline.llm.license_scan import license_digest, license_scan
from leafline.llm.lm_score import LmParams, lm_scores
from leafline.llm.near_dedup import near_duplicates
from leafline.llm.packing import pack, packing_digest
from leafline.llm.pii import pii_digest, pii_spans, redacted
from leafline.llm.preferences import format_preferences, preference_digest, variant_endings
from leafline.llm.quality_rules import quality_rules
from leafline.llm.secret_scan import secret_digest, secret_scan
from leafline.llm.suffix_dedup import repeated, repeated_bytes_digest, repeated_passages

from .cases import documents, nothing


def benchmark(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


ROW_WISE = {
    "quality": lambda d: quality_rules(d),
    "license": lambda d: license_digest(license_scan(d)),
    "suffix": lambda d: repeated_bytes_digest(repeated(d)),
    "secret": lambda d: secret_digest(secret_scan(d)),
    "near": near_duplicates,
    "pii": lambda d: pii_digest(pii_spans(d)),
    "lm": lambda d: lm_scores(d, LmParams(head_words=50, classes=20)),
    "leaks": lambda d: contamination_digest(decontaminate(d, benchmark(d.sparkSession, [(1, "boys of the town would wade across it in the evening"), (None, "x"), (2, None), (3, "one two")]))),
}


@pytest.mark.parametrize("name", ROW_WISE)
def test_one_row_for_each_document(spark, name):
    docs = documents(spark)
    got = Counter(r.doc_id for r in ROW_WISE[name](docs).collect())
    assert got == Counter(r.doc_id for r in docs.collect())


@pytest.mark.parametrize("name", ROW_WISE)
def test_nothing_in_nothing_out(spark, name):
    assert ROW_WISE[name](nothing(spark)).count() == 0


def test_quality_of_edge_cases(spark):
    rows = {r.doc_id: r for r in quality_rules(documents(spark)).collect() if r.doc_id is not None}
    for i in (3, 4, 7):
        assert (rows[i].n_words, rows[i].word_chars, rows[i].n_repeat_words, rows[i].kept) == (0, 0, 0, False)
    assert rows[10].n_words == 1 and rows[10].word_chars == 120_000
    assert rows[11].n_repeat_words == rows[11].n_words == 20_000
    assert rows[12].n_words == 3


def repeated_words(words):
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)})


def test_quality_against_brute_force(spark):
    docs = documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality_rules(docs).collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", texts[r.doc_id]) if w]
        lines = [x for x in texts[r.doc_id].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)))
        assert r.n_repeat_words == repeated_words(words)
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", texts[r.doc_id]))


def test_copies_and_near_copies_are_one_class(spark):
    got = {r.doc_id: r.class_id for r in near_duplicates(documents(spark)).collect() if r.doc_id is not None}
    assert got[1] == got[2] == got[13] == 1
    assert got[3] == 3 and got[4] == 4 and got[7] == 7 and got[8] == 8 and got[6] == 6


def brute_repeats(texts, n=400):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), gone.count(1), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_bytes_against_brute_force(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioubdgké") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, edge = text(120), text(70)[:402]
    texts = [text(200) + shared + text(100), shared, text(50) + shared[:420] + text(60), text(80) + edge + text(3) + edge, "", "a" * 1_000, "a" * 399, text(90), shared, edge[1:], text(30) + shared[25:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:5] for r in repeated_bytes_digest(repeated(docs)).collect()}
    want = brute_repeats([t.encode() for t in texts])
    assert [got[i] for i in range(len(texts))] == want


def test_passages_against_brute_force(spark):
    """Passages of 51 words and more are found whatever white space is between words, and however few bytes they have."""
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    passage = [word() for _ in range(80)]
    rows = []
    for i in range(40):
        n, at = rng.randint(40, 70), rng.randint(0, 10)
        part = passage[at : at + n] if i % 2 else [word() for _ in range(n)]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join([word() for _ in range(rng.randint(0, 30))] + part + [word() for _ in range(rng.randint(0, 30))])))
    rows += [(40, None), (40, ""), (41, rows[0][1]), (None, " ".join(passage))]
    windows = Counter(tuple(t.split()[k : k + 51]) for _, t in rows for k in range(len((t or "").split()) - 50))

    def covered(text):
        w = (text or "").split()
        return len({k + j for k in range(len(w) - 50) if windows[tuple(w[k : k + 51])] > 1 for j in range(51)})

    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_passage_words) for r in repeated_passages(docs).collect())
    assert got == sorted((i is None, i or 0, covered(t)) for i, t in rows)


def test_packing_is_a_partition_of_all_ids(spark):
    import numpy as np
    from tokenizers import Tokenizer

    public_tokenizers = pytest.importorskip("public_tokenizers")
    docs = documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    pieces = packing_digest(pack(docs)).collect()
    at, filled = dict.fromkeys(ids, 0), Counter()
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at[p.doc_id] and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        at[p.doc_id] += p.length
    assert at == {i: len(x) for i, x in ids.items()}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled[p.sequence_id]
        filled[p.sequence_id] += p.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in filled.values())
    assert packing_digest(pack(nothing(spark))).count() == 0
    assert packing_digest(pack(documents(spark))).where("start = 0").count() == documents(spark).count()


def test_benchmark_windows(spark):
    docs = spark.createDataFrame([(1, "zero A-b c d e f g h i j, k tail"), (2, "short item"), (3, None)], "doc_id bigint, text string")
    items = benchmark(spark, [(7, "a b c d e f g h i j k"), (8, "SHORT item"), (9, ""), (10, None), (7, "x y")])
    got = {r.doc_id: r for r in decontaminate(docs, items).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1]["items"]) == (13, 11, ["7"])
    assert (got[2].n_hit, got[2]["items"], got[2].contaminated) == (2, ["8"], True)
    assert (got[3].n_words, got[3].contaminated) == (0, False)
    assert not any(r.contaminated for r in decontaminate(docs, benchmark(spark)).collect())


def test_benchmark_in_parts_and_blocks(spark):
    """A benchmark of many blocks, an item longer than a block, and an item without an id."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words[100:112])), (2, " ".join(words[5:16])), (None, "n1 n2 n3"), (3, " ".join(words))]
    docs = spark.createDataFrame([(i, " ".join(words[10 * i : 10 * i + 15])) for i in range(30)] + [(99, "x n1 n2 n3 w1")], "doc_id bigint, text string")
    whole = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate(docs, benchmark(spark, rows)).collect()}
    small = DecontaminationParams(block_bytes=700, chunk=20)
    parts = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate(docs, benchmark(spark, rows), small).collect()}
    assert whole == parts
    assert whole[10] == (15, ["1", "2", "3"]) and whole[20] == (15, ["1", "3"]) and whole[99] == (3, [])


def test_personal_data_is_replaced(spark):
    docs = spark.createDataFrame([(1, "mail me@site.org or +1 (555) 123-4567, v1.2.3", 44), (2, None, None), (3, "plain", 5)], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: r for r in redacted(docs).collect()}
    assert got[1].text == "mail [EMAIL] or [PHONE], v1.2.3" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "plain"


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, pair_id string"


def test_preferences(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "other"), (1, 1, "assistant", "no"), (1, 2, None, None),
        (2, 0, "user", "alone"), (4, 0, "user", "same"), (5, 0, "user", "same"), (None, 0, "user", "lost"), (6, 0, "user", "b"), (6, 0, "user", "a"),
        (8, 0, "user", "q"), (8, 1, "assistant", "a"), (8, 2, "user", "r"), (8, 3, "assistant", "b"), (8, 4, "user", "s"), (9, 0, "user", "t"), (9, 1, "assistant", "a"),
        (-1, 0, "user", "odd"), (-2, 0, "assistant", "even"),
    ]
    table = spark.createDataFrame([(*r, "clash") for r in rows], CONVERSATIONS)
    got = {r.pair_id: r for r in preference_digest(format_preferences(variant_endings(table))).collect()}
    assert set(got) == {-1, 0, 1, 2, 3, 4}
    assert got[4].n_shared == 3 and got[4].chosen.count("im_start") == 2 and got[4].chosen_mask.count(":") == 1
    assert got[-1].paired and got[-1].n_shared == 0 and "odd" in got[-1].rejected
    assert got[0].n_shared == 1 and got[0].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    start, end = map(int, got[0].chosen_mask.split(":"))
    assert got[0].chosen[start:end] == "yes<|im_end|>\n" and got[0].rejected == "<|im_start|>assistant\nno<|im_end|>\n"
    assert not got[1].paired and got[1].n_shared == 0 and got[1].rejected == ""
    assert got[2].n_shared == 1 and got[2].chosen == got[2].rejected == ""
    assert got[3].chosen.index("a<") < got[3].chosen.index("b<")
    assert preference_digest(format_preferences(variant_endings(spark.createDataFrame([], CONVERSATIONS)))).count() == 0


def test_every_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in registered.queries()} == set(range(1, 11))


def test_pipeline_stages_stand_the_cases(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = documents(spark).select(columns)
    for table in (docs, docs.where("false"), docs.withColumn("text", docs.text.substr(1, 0)), docs.where("doc_id IS NULL OR text IS NULL")):
        now = table
        for _, stage in pipeline.STAGES[:4]:
            now = pipeline.materialize(stage(spark, now, "/root/testdata/sf0.001"), "test")
            assert now.columns == columns
        assert pipeline.STAGES[4][1](spark, now, "").count() >= 0
    kept = {r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()}
    assert {1, 3, 4, 6, 7, 8, 10, 11, 12, None} <= kept and not {2, 13} & kept
