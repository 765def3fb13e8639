"""The methods against plain versions: spans, loser trees, sampling, the language model, and the pipeline."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafline.llm.lm_score import LmParams, LogBilinear, Vocabulary, lm_scores, tail_class
from leafline.llm.near_dedup import NearDedupParams, Sampler, Weights, near_duplicates, prefix, similarity
from leafline.llm.pii import PiiParams, estimate_reliabilities, pii_digest, pii_spans
from leafline.llm.secret_scan import best_window_entropy, secret_digest, secret_scan
from leafline.llm.shingles import shingle_hashes
from leafline.llm.suffixes import LoserTree, common_prefix, front_code, front_decode

from . import brute

SF = "/root/testdata/sf0.001"


def soup(seed, alphabet, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_secret_spans(spark):
    parts = ["token", "Secret", "API_KEY", "apikey", "=", ": ", " ", '"', "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "x", "é", ".", "-", "abc", "deadbeef", "\n"]
    texts = soup(1, parts, 400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in secret_digest(secret_scan(docs)).collect():
        want = brute.secrets(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(brute.joined(want).encode()).hexdigest(), texts[r.doc_id]
        assert [s for s in r.spans.split(",") if s and not s.startswith("entropy")] == [x for x in brute.joined(want).split(",") if x]


def test_personal_spans(spark):
    parts = ["a", "b.c", "@", ".", "-", "_", "%", " ", "1", "23", "255", "256", "0", "+", "(", ")", "4111 1111 1111 1111", "é", "\n", "9", "\x03", "\x04"]
    texts = soup(2, parts, 600)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii_digest(pii_spans(docs)).collect():
        want = brute.joined(brute.personal(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]


def test_window_entropy(spark):
    from pyspark.sql import functions as F

    values = ["".join(random.Random(i).choice("abcdEF0123+/") for _ in range(20 + i)) for i in range(30)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for v, got in df.select("v", best_window_entropy(F.col("v"), 20)).collect():
        want = max(-sum((w.count(c) / 20) * math.log2(w.count(c) / 20) for c in set(w)) for w in (v[i : i + 20] for i in range(len(v) - 19)))
        assert got == pytest.approx(want)


def test_numbers_that_run_into_others_are_added(spark):
    texts = ["Card 4111111111111111 5500005555555559 end", "call +1 (826) 555-4081 190.137.223.204 now", "id 1234567890123 4111111111111112 x", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii_digest(pii_spans(docs)).collect()}
    assert got[0].n_card == 0 and got[0].spans == "card_group:5:21,card_group:22:38"
    assert got[1].n_phone == 0 and got[1].spans == "phone_group:5:22,ip:23:38"
    assert got[2].spans == "" and got[3].spans == ""


def test_reliabilities_follow_agreement():
    counts = [("email", (1, 1, 1, 0, 1), 80), ("email", (-1, -1, 0, -1, -1), 80), ("email", (1, -1, 0, 0, 1), 5)]
    post = estimate_reliabilities(counts, PiiParams())
    assert post["email", (1, 1, 1, 0, 1)] > 0.95 and post["email", (-1, -1, 0, -1, -1)] < 0.05


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=8), max_size=6))
def test_loser_tree(runs):
    coded = [front_code(sorted(r)) for r in runs]
    for r, (shared, rests) in zip(runs, coded, strict=True):
        assert [s for s, _ in front_decode(shared, rests)] == sorted(r)
    got = list(LoserTree([front_decode(*c) for c in coded]))
    want = sorted(s for r in runs for s in r)
    assert [s for _, s, _ in got] == want
    assert [n for _, _, n in got][1:] == [common_prefix(a, b) for a, b in zip(want, want[1:], strict=False)]


def test_sampling_estimates_weighted_similarity():
    params = NearDedupParams(bands=64, rows=8)
    rng = np.random.default_rng(0)
    hashes = np.unique(rng.integers(0, 1 << 63, 400, np.uint64))
    w = 1 + rng.random(len(hashes))
    a, b = slice(0, 300), slice(100, 400)
    sampler = Sampler(NearDedupParams(bands=512, rows=1))
    equal = np.mean(sampler.band_keys(hashes[a], w[a]) == sampler.band_keys(hashes[b], w[b]))
    want = w[100:300].sum() / w.sum()
    assert abs(equal - want) < 0.07 and params.rows == 8


def test_shingles_are_equal_where_words_are():
    a, b = shingle_hashes(b"p q r s t u v"), shingle_hashes(b"  q\tr  s t\nu ")
    assert len(a) == 3 and len(b) == 1 and a[1] == b[0] and len(shingle_hashes(b"one two")) == 1 and not len(shingle_hashes(b" "))
    weights = Weights(np.array([1.0] * 65536), 1, NearDedupParams())
    assert weights.of(b"x y z x y z x y z")[1].max() > 1


def test_model_is_normalised_and_learns(spark):
    words = [(w.encode(), 50 - i) for i, w in enumerate("abcdefgh")]
    p = LmParams(classes=6, tail_classes=4, dim=8)
    sums = {}
    for w, n in words:
        old = sums.get(tail_class(w, p), (0, 0))
        sums[tail_class(w, p)] = (old[0] + n, old[1] + 1)
    known = Vocabulary(20, words, 20 + sum(n for _, n in words), 9, sums, p)
    model = LogBilinear(known, p)
    n = model.n
    first, second = np.full(n, 2), np.full(n, 3)
    assert np.exp(model.log_probabilities(first, second, np.arange(n))).sum() == pytest.approx(1, abs=1e-4)
    for k in range(p.tail_classes):
        own = known.cls == known.other + k
        # what is missing is the share of one unknown word
        assert (10 ** known.inside[own]).sum() == pytest.approx(1 - 0.5 / known.tail_total[k])

    rng = random.Random(1)
    texts = [" ".join("ab cd"[3 * (k % 2) : 3 * (k % 2) + 2] if rng.random() < 0.9 else "ef" for k in range(200)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    rows = [r for r in lm_scores(docs, LmParams(batch=256)).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_base_scores_and_layout(spark):
    """Base columns against a plain count; the model's scores don't depend on files or partitions."""
    texts = soup(9, ["The", "the", "cat\n", "sat", "é", "on ", "", "mat.", "\t"], 60)
    rows = [*enumerate(texts), (70, None), (71, ""), (None, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    p = LmParams(classes=3, tail_classes=4, head_words=4, batch=64, shard_tokens=100)
    got = {r.doc_id: r for r in lm_scores(docs.repartition(3), p).collect()}
    other = {r.doc_id: r for r in lm_scores(docs.coalesce(1), p).collect()}
    words = lambda t: [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [""]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows}
    count = Counter(w for i, t in rows if not held[i] for w in words(t))
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        r, ws = got[i], words(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r.score == pytest.approx(other[i].score, rel=1e-6)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_links_against_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert all(got[a] == got[b] for a, b in brute.near_pairs(texts, 0.8))
    loose = brute.near_pairs(texts, 0.7)
    by_class = {}
    for i, c in got.items():
        by_class.setdefault(c, []).append(i)
    for members in by_class.values():
        assert all(any((min(i, j), max(i, j)) in loose for j in members if j != i) for i in members if len(members) > 1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline_against_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    source = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in source.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs, kept = source, []
    for _, stage in pipeline.STAGES[:4]:
        docs = pipeline.materialize(stage(spark, docs, SF), "test")
        assert docs.columns == source.columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    good = brute.quality_kept([(i, r.text or "", r.lang) for i, r in rows.items()])
    assert set(kept[0]) == good
    linked = brute.near_pairs(kept[0], 0.8)
    assert not any(a in kept[1] and b in kept[1] for a, b in linked)
    assert all(any(i in p for p in brute.near_pairs(kept[0], 0.7)) for i in set(kept[0]) - set(kept[1]))
    assert set(kept[2]) == {i for i in kept[1] if not brute.leaked(kept[1][i], items)}
    for i, text in kept[3].items():
        assert not brute.personal(text) or len(text) < len(kept[2][i]) + 40
        if not brute.personal(kept[2][i]):
            assert text == kept[2][i] or "[" in text
    pieces = pipeline.STAGES[4][1](spark, docs, SF).collect()
    total = {p.doc_id: p.doc_tokens for p in pieces}
    assert set(total) == set(kept[3])
    for i in total:
        assert sum(p.length for p in pieces if p.doc_id == i) == total[i]
    assert pipeline.run(spark, SF).count() == len(pieces)


def test_cached_words_encode_like_the_tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from leafline.llm.packing import CachedTokenizer

    ours = CachedTokenizer(None, 50)
    assert ours.most == 50
    texts = soup(4, ["the", "Été", "it's", "'ll", " ", "\n", "12", "_", "--", "日本", "x²", " ", "\x1c", "İ", "×", "<|endoftext|>", "straße", "."], 300)
    want = [np.asarray(e.ids, "<u4").tobytes() for e in ours.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ours.encode_batch(texts) == want
    assert CachedTokenizer(public_tokenizers.path("byte_bpe_50k.json"), 50).most == 0


def test_plain_words_are_merged_without_the_tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from leafline.llm.packing import CachedTokenizer

    class Unused:
        def encode_batch(self, texts, add_special_tokens):
            assert not texts
            return []

    rng, ours = random.Random(9), CachedTokenizer(None, 50)
    letters = "etaoinshrdlu" * 3 + "abcdefghijklmnopqrstuvwxyzÀéèßöÿŁžſ"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 14))) + rng.choice(["", "", ".", "...", "1", "--"]) for _ in range(400)) for _ in range(40)]
    texts += ["", " ", "a", "aaaaaaaaaaaaaaaa", "x" * 32, "é" * 16, "~!@#$%^&*()_+" * 2]
    want, tokenizer = ours._encode(texts), ours.tokenizer
    ours.tokenizer = Unused()
    assert ours.encode_batch(texts) == want
    ours.tokenizer = tokenizer
    for few in ([], [""], [" "], ["a"], ["1 2 3"], ["a . é"], ["", "\n", "ab"], ["x" * 40]):
        assert ours.encode_batch(few) == ours._encode(few)
    long = [f"{'ab' * k} {'é' * k} {'-' * k} {t}" for k in range(10, 60) for t in texts[:2]]
    assert ours.encode_batch(long) == ours._encode(long)
    assert 0 < len(ours.cache) <= 50
    ours.merges = None
    assert ours.encode_batch(texts) == want
    assert CachedTokenizer(public_tokenizers.path("byte_bpe_50k.json"), 50).merges is None


def test_near_copies_that_share_a_hot_passage(spark):
    """Pairs that meet only in keys whose first and last node resemble neither of them are compared all the same."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(1 << 40)}"
    passage = " ".join(word() for _ in range(600))
    rows = []
    for k in range(150):
        family = " ".join(word() for _ in range(55))
        rows += [(rng.randrange(1 << 40), f"{passage} {family} {' '.join(word() for _ in range(45))}", k) for _ in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, family int")
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    # at 0.87, 1 - (1 - 0.87^4)^12 = 0.9999 of the pairs share a key
    split = [k for k in range(150) if len({got[i] for i, _, f in rows if f == k}) > 1]
    assert not split
    assert len(set(got.values())) == 150


def test_prefixes_lose_no_link():
    """Any two sets of weighted shingles at 0.8 or more share one of their prefixes, with enough weight after it in both."""
    rng, least = np.random.default_rng(8), 0.8
    rarity = rng.integers(0, 50, 4_000)
    linked = 0
    for _ in range(300):
        common = rng.choice(4_000, int(rng.integers(5, 200)), replace=False)
        sides = []
        for _ in range(2):
            own = np.union1d(common, rng.integers(0, 4_000, int(rng.integers(0, 1 + len(common) // 5)))).astype(np.uint64)
            sides.append((own, 1 + rng.random(4_000)[own] * 0.2))
        if similarity(*sides) >= least:
            linked += 1
            (a, x), (b, y) = (prefix(h, w, rarity[h.astype(int)], least) for h, w in sides)
            both, i, j = np.intersect1d(a, b, return_indices=True)
            need = least / (1 + least) * (x[0] + y[0])
            assert len(both) and (np.minimum(x[i], y[j]) >= need * (1 - 1e-9)).any()
    assert linked > 50


def test_neighbours_are_ranked_by_all_terms_of_the_seed():
    from leafline.llm.packing import Corpus, Index, PackingParams

    rng, p = np.random.default_rng(6), PackingParams()
    docs = [np.minimum(rng.zipf(1.3, int(n)), 3_000).astype("<u4") for n in rng.integers(50, 900, 120)]
    terms = [dict(zip(*(x.tolist() for x in np.unique(d, return_counts=True)), strict=True)) for d in docs]
    df, mean = {}, np.mean([len(d) for d in docs])
    for t in terms:
        for x in t:
            df[x] = df.get(x, 0) + 1
    counts = np.array([df.get(x, 0) for x in range(3_001)])
    corpus = Corpus.of(counts, 120, sum(map(len, docs)))
    unused = np.arange(120) % 5 > 0
    index = Index(docs, corpus, p)
    for seed in range(0, 120, 7):
        want = np.zeros(120)
        for i, t in enumerate(terms):
            norm = p.k1 * (1 - p.b + p.b * len(docs[i]) / mean)
            want[i] = unused[i] * sum(math.log1p((120 - df[x] + 0.5) / (df[x] + 0.5)) * t[x] * (p.k1 + 1) / (t[x] + norm) for x in terms[seed] if x in t)
        got = list(index.neighbours(seed, unused))
        assert set(got) == set(np.flatnonzero(want))
        assert np.allclose(want[got], np.sort(want[want > 0])[::-1], rtol=1e-4)


def test_quality_rejects_texts_without_common_words(spark):
    """Long texts without common words, or with another language's, are rejected."""
    from leafline.llm.quality_rules import COMMON_WORDS, quality_rules

    rng = random.Random(7)
    rare = lambda: "".join(rng.choice("bcdfglmnprstaeiou") for _ in range(rng.randint(3, 9)))
    prose = lambda lang, n: " ".join(rng.choice(COMMON_WORDS[lang]) if rng.random() < 0.18 else rare() for _ in range(n))
    rows = [(i, prose("en", 400), "en") for i in range(150)] + [(i, prose("de", 400), "de") for i in range(200, 300)]
    rows += [(500, " ".join(rare() for _ in range(900)), "en"), (501, prose("de", 900), "en"), (502, " ".join(rare() for _ in range(600)), "de"), (503, prose("en", 600), "de")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in quality_rules(docs).collect() if not r.kept} == {500, 501, 502, 503}


def test_wrapped_licenses_are_found(spark):
    from textwrap import fill

    from leafline.llm.license_scan import RULES, SENTENCES, TRIGGER, license_scan

    mit = [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.',
    ]
    apache = [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ]
    gpl = [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ]
    bsd = [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ]
    texts, want = [], []
    for parts, name, n in ((mit, "MIT", 3), (apache, "Apache-2.0", 5), (gpl, "GPL-3.0-or-later", 5), (bsd, "BSD-3-Clause", 4)):
        for width in (30, 72, 80):
            for mark in ("", "# ", " * ", "// "):
                for end in ("\n", "\r\n"):
                    notice = "\n\n".join(fill(p, width) for p in parts)
                    texts.append(end.join(mark + x for x in f"Copyright (c) 2020 Someone\n\n{notice}\n\nint main".split("\n")))
                    want.append(([name], n))
    texts += ["Some words\nLicensed under CC BY 4.0\nother words", "Released under the\n\nMIT License.", "Released under the\nMIT License. All rights\nreserved."]
    want += [(["CC-BY-4.0"], 1), ([], 0), (["LicenseRef-Rights-Reserved", "MIT"], 2)]
    texts.append("All rights  reserved.")
    want.append((["LicenseRef-Rights-Reserved"], 1))
    assert all(re.search(TRIGGER, x) for x in SENTENCES.values())
    assert {x for _, rule in RULES for x in rule} <= set(SENTENCES)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.licenses, len(r.sentences)) for r in license_scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
