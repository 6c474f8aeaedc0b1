"""Spelling variants against a brute-force version."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from folio.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, every, length=6, least=5, times=5):
    n = Counter()
    for doc, text in docs:
        for w in RUN.findall((text or "").translate({c: c + 32 for c in range(65, 91)})):
            h = crc32(f"{'' if doc is None else doc}:{w}".encode())
            if every and h % every == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= least}
    near = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {w: min(x, key=lambda v: (-n[v], v)) if x else None for w, x in near.items()}
    form = {w: f if f and n[f] >= times * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted([(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n], key=repr)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def texts(n, seed):
    r = random.Random(seed)
    base = ["".join(r.choices("abcdeé", k=r.randrange(6, 10))) for _ in range(60)]
    out = []
    for i in range(n):
        words = r.choices(base, [1 / (1 + k) for k in range(60)], k=40)
        words = [w[:k] + r.choice("abéñß×") + w[k + 1 :] if r.random() < 0.3 and (k := r.randrange(len(w))) >= 0 else w for w in words]
        out.append((i, " ".join(w.upper() if r.random() < 0.05 else w for w in words)))
    return out


def test_equals_brute_force(spark):
    docs = texts(200, 1)
    want = brute(docs, 7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(variants.group(df, 7))
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] for r in want if r[1])
    assert rows(variants.group(df)) == brute(docs, None)


def test_the_bitmap_loses_nothing_when_it_is_full(spark, monkeypatch):
    monkeypatch.setattr(variants, "BITS", 6)
    docs = texts(60, 2)
    assert rows(variants.group(spark.createDataFrame(docs, "doc_id long, text string"), 5)) == brute(docs, 5)


def test_every_candidate_is_made_once():
    alphabet = np.array(sorted(map(ord, "abc")), np.uint32)
    every = np.full(16, np.uint64(2**64 - 1))
    for word in ("aab", "abcabc", "aaaa"):
        (_, points), *_ = variants.by_length([word])
        made = [s for _, found in variants.neighbourhood(points, alphabet, every, 10) for s in found.tolist()]
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abc"} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "abc"}
        assert len(made) == len(set(made)) and set(made) == want - {word}


def test_odd_rows(spark, odd, odd_texts, none):
    more = [(20, "tail " * 9), (21, "xxxxxx " * 9 + "XXXXXXX " * 60), (None, "Ünïcode " * 6), (22, "ünïcodes " * 40)]
    both = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).withColumns({"word": F.lit("clash"), "n": F.lit("clash")})
    assert rows(variants.group(both, 3)) == brute(odd_texts + more, 3)
    assert variants.group(none).count() == 0
    assert variants.group(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).count() == 0
