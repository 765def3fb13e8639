"""Plain Python versions of the operators, written from their contracts."""

import re
from collections import Counter, defaultdict
from math import log2, sqrt

from leafline.llm.quality_rules import COMMON_WORDS, OTHER, QualityParams, _pooled_words, prior


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def secrets(text):
    out = []
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text, re.A) if len(m[1]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def repeated_words(words):
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)})


def quality_kept(docs, p=QualityParams()):
    """doc_ids that the quality rules keep; ``docs``: (doc_id, text, lang)."""
    commons, hists = {**COMMON_WORDS, OTHER: _pooled_words()}, {}
    sums = {k: tuple(prior(k, p).values()) for k in commons}
    for i, text, lang in docs:
        ref, words = lang if lang in COMMON_WORDS else OTHER, words_of(text)
        n = lambda cls, text=text: len(re.findall(cls, text))
        upper, digit, punct, symbol = n("[A-Z]"), n("[0-9]"), n(r"[.,;:!?'\"()-]"), n(r"[#*$%&|<>]")
        space, wide = len(text) - sum(map(len, words)), len(text.encode()) - len(text)
        chars = [max(len(text) - upper - digit - space - punct - symbol - wide, 0), upper, digit, space, punct, symbol, wide]
        hits = [sum(w.lower() == c for w in words) for c in commons[ref]]
        hists[i] = (ref, words, len(text), chars, [*hits, len(words) - sum(hits)])
        sums[ref] = tuple([a + b for a, b in zip(x, y, strict=True)] for x, y in zip(sums[ref], hists[i][3:], strict=True))

    def distance(a, b):
        if not sum(a) or not sum(b):
            return 0
        terms = 0
        for x, y in zip(a, b, strict=True):
            x, y = x / sum(a), y / sum(b)
            terms += sum(v * log2(2 * v / (x + y)) for v in (x, y) if v)
        return sqrt(max(0, terms / 2))

    kept = set()
    for i, (ref, words, size, chars, hist) in hists.items():
        bad = len(words) < p.min_words or 100 * repeated_words(words) > p.max_repeat_percent * len(words)
        if not bad and size >= p.min_chars_compared and len(words) >= p.min_words_compared:
            bad = distance(chars, sums[ref][0]) > p.max_char_distance or distance(hist, sums[ref][1]) > p.max_word_distance
        if not bad:
            kept.add(i)
    return kept


def near_pairs(texts, least):
    """Pairs of ids with a plain Jaccard similarity of 5-word shingles of ``least`` or more."""
    shingles, by = {}, defaultdict(list)
    for i, t in texts.items():
        w = words_of(t)
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in shingles[i]:
            by[s].append(i)
    common = Counter((a, b) for v in by.values() for x, a in enumerate(sorted(v)) for b in sorted(v)[x + 1 :])
    return {p for p, n in common.items() if n / (len(shingles[p[0]]) + len(shingles[p[1]]) - n) >= least}


def leaked(text, items, window=10):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    words, found = norm(text), False
    for item in map(norm, items):
        n = min(window, len(item))
        wanted = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if item else set()
        found |= any(tuple(words[k : k + n]) in wanted for k in range(len(words) - n + 1))
    return found
