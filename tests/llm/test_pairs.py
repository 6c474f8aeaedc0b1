"""SimHash, pivots and suffix trees against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest_brute import components_of

from folio.llm import pivots, registry, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, words=3):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + words]) for i in range(len(ws) - words + 1)] or [" ".join(ws)]
    n = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        n.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b, c in n.items() if 2 * c > len(shingles))


def check_simhash(rows, got):
    fps = [brute_fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    arr = np.array(distinct, np.uint64)
    links = [(distinct[i], distinct[j]) for i in range(len(arr)) for j in (np.flatnonzero(np.bitwise_count(arr[i] ^ arr[i + 1 :]) <= 2) + i + 1).tolist()]
    root = components_of(distinct, links)
    low = {}
    for (d, _), f in zip(rows, fps, strict=True):
        if d is not None:
            low[root[f]] = min(low.get(root[f], d), d)
    want = Counter((d, f"{f:016x}", low.get(root[f])) for (d, _), f in zip(rows, fps, strict=True))
    assert Counter(map(tuple, got)) == want


def test_simhash_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check_simhash(rows, registry.op8_simhash(spark, sf_dir).collect())


def test_simhash_odd_rows(odd, odd_texts, none):
    check_simhash(odd_texts, simhash.cluster(odd).collect())
    assert simhash.cluster(none).collect() == []


@pytest.mark.parametrize("radius", [2, 3])
def test_gray_index_loses_no_pair(radius):
    r = np.random.default_rng(radius)
    f = r.integers(0, 2**63, 300, dtype=np.uint64)
    near = f[:200] ^ (np.uint64(1) << r.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 200, dtype=np.uint64))
    f = np.unique(np.concatenate([f, near]))
    rank = f.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    f = f[np.argsort(rank)]
    a, b = simhash.linked(f, radius)
    want = {(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if np.bitwise_count(f[i] ^ f[j]) <= radius}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_oversized_buckets_are_split_without_loss(spark):
    base = 0x0F0F_0000_1234_0000
    fps = sorted({base ^ (k << 3) for k in range(500)})
    got = simhash.edges(spark.createDataFrame([(x,) for x in fps], "fp long"), 2, large=64).collect()
    root = components_of(fps, [(r.a, r.b) for r in got])
    assert len(set(root.values())) == 1
    assert all((r.a ^ r.b).bit_count() <= 64 for r in got)


def jaccard_groups(rows, words=5, similarity=0.8):
    sets = {t: set(simhash.shingle_hashes(t, words).tolist()) for _, t in rows}
    texts, index, links = list(sets), defaultdict(list), set()
    for i, t in enumerate(texts):
        for h in sets[t]:
            index[h].append(i)
    shared = Counter()
    for members in index.values():
        if len(members) < 60:
            shared.update((a, b) for k, a in enumerate(members) for b in members[k + 1 :])
    for (a, b), n in shared.items():
        if n >= similarity * (len(sets[texts[a]]) + len(sets[texts[b]]) - n):
            links.add((texts[a], texts[b]))
    return links


def test_dedupe_keeps_one_of_each_group(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    links = jaccard_groups(rows)
    root = components_of(sorted({t for _, t in rows}), links)
    best = {}
    for d, t in rows:
        best[root[t]] = min(best.get(root[t], d), d)
    got = {r.doc_id for r in simhash.dedupe(docs).select("doc_id").collect()}
    want = set(best.values())
    assert want <= got  # no group loses its last document
    assert len(got - want) <= 0.02 * (len(rows) - len(want)) + 1  # recall of what must go


@pytest.mark.parametrize("n", [3, 90, 700])
def test_sketches_lose_no_similar_pair(n):
    r = np.random.default_rng(n)
    base = r.integers(0, 2**63, 40 * n, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k * n : (k + 1) * n][: int(n * f)], r.integers(0, 2**63, int(n * g), dtype=np.uint64)])) for k in range(40) for f, g in ((1, 0), (0.95, 0.02), (0.9, 0.1), (0.5, 0.5), (0.82, 0))]
    size = np.array([len(s) for s in sets])
    a, b = simhash.candidates(size, [simhash.sketch(s) for s in sets], 0.8)
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    both = simhash.overlaps(sets)
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if both[i, j] > 0 and both[i, j] >= 0.8 * (size[i] + size[j] - both[i, j]) - 1e-6}
    assert want and want <= got and len(got) == len({tuple(sorted(p)) for p in got})
    assert len(got) <= 4 * len(want) + 40 or n < 10


def random_words(r, n):
    return [f"w{x}" for x in r.integers(0, 10**6, n)]


def test_dedupe_finds_a_text_and_its_double(spark):
    r = np.random.default_rng(7)
    texts = [" ".join(random_words(r, 150)) for _ in range(40)]
    rows = [(2 * i, t) for i, t in enumerate(texts)] + [(2 * i + 1, f"{t} {t}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.dedupe(df).select("doc_id").collect()) == [2 * i for i in range(40)]


@pytest.mark.parametrize("n", [60, 1000, 3000])
def test_dedupe_finds_every_link_of_a_large_group(spark, n):
    r = np.random.default_rng(n)
    base, rows = random_words(r, 300), []
    for i in range(n):
        ws = list(base)
        for at in r.choice(300, 5, replace=False):
            ws[at] = f"x{r.integers(10**9)}"
        rows.append((i, " ".join(ws)))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    place = {h: k for k, h in enumerate(sorted(h for h, c in Counter(h for s in sets for h in s).items() if c > 1))}
    m = np.zeros((n, len(place)), np.float32)
    for i, s in enumerate(sets):
        m[i, [place[h] for h in s if h in place]] = 1
    both, size = m @ m.T, np.array([len(s) for s in sets])
    a, b = np.nonzero(np.triu(both >= 0.8 * (size[:, None] + size - both), 1))
    assert len(a)
    want = sorted(set(components_of(range(n), zip(a.tolist(), b.tolist(), strict=True)).values()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.dedupe(df).select("doc_id").collect()) == want


def test_dedupe_odd_rows(odd, none):
    out = simhash.dedupe(odd)
    assert out.columns == odd.columns
    ids = [r.doc_id for r in out.collect()]
    # null, empty text: equal, a blank one is a text of its own; 7, 8 and 9: one; the row without an id stays
    assert sorted(i for i in ids if i) == [1, 3, 4, 5, 6, 7, 10, 11]
    assert ids.count(None) == 1
    assert simhash.dedupe(none).collect() == []


def brute_pivots(rows, cosine=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([v / np.linalg.norm(v) for _, v in good])
    sim = m @ m.T >= cosine
    ids = [i for i, _ in good]
    links = [(a, b) for a, b in zip(*np.nonzero(sim), strict=True) if a < b]
    n = Counter(x for p in links for x in p)
    root = components_of(range(len(ids)), links)
    low = {}
    for k, i in enumerate(ids):
        low[root[k]] = min(low.get(root[k], i), i)
    out = {i: (0, i) for i, _ in rows}
    return out | {i: (n[k], low[root[k]]) for k, i in enumerate(ids)}, len(links)


def test_pivots_recall(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, links = brute_pivots(rows)
    got = registry.op2_pivots(spark, sf_dir).collect()
    assert {r.vec_id for r in got} == set(want) and len(got) == len(rows)
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    assert sum(r.n_links for r in got) / 2 >= 0.9 * links
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("pivot_count", [92, 300, 1000, 2048])
def test_pivots_planted_pairs_share_enough(pivot_count):
    """Recall at the bound, at the pivot counts of 20 thousand to 200 million rows."""
    r = np.random.default_rng(pivot_count)
    norm = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b, p = norm(r.standard_normal((1500, 64))), norm(r.standard_normal((1500, 64))), norm(r.standard_normal((pivot_count, 64)))
    b = norm(b - (a * b).sum(1, keepdims=True) * a)
    c = r.uniform(0.9, 0.905, (1500, 1))
    b = c * a + np.sqrt(1 - c * c) * b
    k = pivots.prefix_length(pivot_count)
    x, y = pivots.prefixes(a, p, k), pivots.prefixes(b, p, k)
    assert ((x[:, :, None] == y[:, None, :]).any(2).sum(1) >= pivots.SHARED).mean() >= 0.95
    d = np.random.default_rng(1).standard_normal((64, pivots.SIGNS))
    assert (((a @ d > 0) != (b @ d > 0)).sum(1) <= pivots.reach(0.9)).mean() >= 0.999


def test_pivots_find_planted_pairs(spark):
    r = np.random.default_rng(5)
    v = r.standard_normal((3000, 64))
    near = v[:300] / np.linalg.norm(v[:300], axis=1, keepdims=True)
    side = r.standard_normal((300, 64))
    side -= (side * near).sum(1, keepdims=True) * near
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = r.uniform(0.9, 0.95, (300, 1))
    rows = [(i, x.tolist()) for i, x in enumerate([*v, *(c * near + np.sqrt(1 - c * c) * side)])]
    want, links = brute_pivots(rows)
    got = pivots.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    found = sum(x.n_links for x in got) / 2
    assert links >= 300 and 0.9 * links <= found <= links


def test_pivots_large_lists_and_odd_vectors(spark):
    r = np.random.default_rng(1)
    centre = r.normal(size=8)
    rows = [(i, (centre + 0.05 * r.normal(size=8)).tolist()) for i in range(60)] + [(i, r.normal(size=8).tolist()) for i in range(60, 90)]
    rows += [(100, rows[0][1]), (101, None), (102, [0.0] * 8), (103, [float("nan")] * 8), (104, [None] + [1.0] * 7), (105, [float("inf")] + [1.0] * 7), (106, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label", "2 AS id", "3 AS m", "4 AS v")
    want, _ = brute_pivots(rows)
    got = {x.vec_id: (x.n_links, x.component_id) for x in pivots.cluster(df, large=20).collect()}
    assert got == want
    assert pivots.cluster(df.limit(0)).collect() == []


def test_pivots_of_every_length(spark):
    """Vectors link with those of their own length, however rare it is."""
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).tolist()) for i in range(20)]
    rows += [(30, [1.0, 0.0, 0.0, 0.0]), (31, [1.0, 0.014, 0.0, 0.0]), (32, [0.0, 0.0, 1.0, 0.0]), (33, [2.0, 1.0]), (34, [2.0, 1.0]), (35, [5.0]), (36, [2.5]), (37, [-1.0])]
    got = {x.vec_id: (x.n_links, x.component_id) for x in pivots.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {i: (0, i) for i, _ in rows} | {30: (1, 30), 31: (1, 30), 33: (1, 33), 34: (1, 33), 35: (1, 35), 36: (1, 35)}
    for size in (8,):
        want |= brute_pivots([x for x in rows if len(x[1]) == size])[0]
    assert got == want


def brute_substrings(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(ws[i : i + window]) for ws in words for i in range(len(ws) - window + 1))
    out = []
    for (d, _), ws in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_substrings_match_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in registry.op6_substrings(spark, sf_dir).collect()) == brute_substrings(rows)


def test_substrings_odd_rows_and_large_groups(spark, odd, odd_texts, none):
    digest = lambda df: Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect())
    assert digest(substrings.dedupe(odd)) == brute_substrings(odd_texts)
    assert substrings.dedupe(none).collect() == []
    lines = [(i, f"{i} " + "the same long line of words again " * (2 + i % 5) + f"end{i % 3}") for i in range(40)]
    df = spark.createDataFrame(lines, "doc_id long, text string")
    for large in (3, 500):  # split by longer prefixes, and as one subtree
        assert digest(substrings.dedupe(df, window=9, prefix=4, large=large)) == brute_substrings(lines, 9)
