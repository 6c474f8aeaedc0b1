"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are spread over buckets in which two fingerprints within the radius must meet
(they agree on whole blocks of bits), and each bucket is sorted by Gray rank and indexed:
runs of neighbours share masked bit patterns, which upper nodes hold; two nodes whose
shared patterns already differ in more bits than the radius are pruned with all below them,
and only surviving leaves are compared. A bucket gives at most one edge for each fingerprint,
so groups of near copies never become all their pairs. Buckets that are too large are split by
further blocks; after two splits 15 free bits at most remain, so that no bucket exceeds 2**15 fingerprints.

``dedupe`` keeps one document of each group of texts whose sets of shingles have a Jaccard similarity
of ``similarity`` or more. Likely links come from the index above, over fingerprints of the distinct
shingles. What it misses is found exactly by a prefix filter: with all shingles in one order, two similar
sets share one of their first n - ceil(similarity n) + 1, so each list of texts with one such shingle must end
up in one group or be compared. Before whole sets are compared, parity sketches (one bit for each hash value
modulo the width: how many shingles fall there, odd or even) bound how much two sets differ; the bound
is exact, so nothing is lost, and a sketch is some fiftieth of the set. A list is linked to its first text; lists that
are not one group after that are compared in full, by sketches, and what passes, by sets.

Defined results: a null text is empty; texts without words have fingerprint zero and are
linked like any other. Repeated rows are copies of each other. Empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import components, free, fresh, small, written

SEED, BITS, RADIUS = 42, 64, 2
LEAF, LARGE = 8, 2048


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of so many words (A-Z lower-cased, joined by one space); the whole text if it has fewer."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    if len(ws) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), SEED)], np.uint64)
    joined = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(ws) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, least significant first."""
    out = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 4096):
        out += np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return out


def fingerprint(counts: np.ndarray, n: int) -> int:
    """A bit is 1 if set in over half; as a signed long."""
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, fp (long)."""

    def run(batches):
        for b in batches:
            hashes = (shingle_hashes(t, words) for t in b["text"])
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array([fingerprint(bit_counts(h), len(h)) for h in hashes], np.int64)})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def gray_rank(fp: Column) -> Column:
    """Position of the bits in Gray order (signed: its upper half comes first, neighbours stay neighbours)."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _split(bits: list[int], parts: int) -> list[int]:
    """Masks of so many runs of the bits."""
    return [sum(1 << int(b) for b in run) for run in np.array_split(bits, parts)]


def masks(radius: int) -> list[int]:
    """Of radius + 2 blocks, two at least agree: a mask for each choice of two."""
    return [a | b for a, b in combinations(_split(list(range(BITS)), radius + 2), 2)]


def narrower(mask: int, radius: int) -> list[int]:
    """Of radius + 1 blocks of the other bits, one at least agrees: the mask with each of them."""
    return [mask | m for m in _split([b for b in range(BITS) if not mask >> b & 1], radius + 1)]


def _by_masks(fps: DataFrame, choices: dict[int | None, list[int]]) -> DataFrame:
    """(mask, bits, fp) for every mask that the row's own mask (None: no such column) leads to."""
    def rows(ms):
        return F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for m in ms))

    out = None
    for own, ms in choices.items():
        if own is None:
            return fps.select("fp", F.explode(rows(ms)).alias("k")).select("k.mask", "k.bits", "fp")
        hit = F.col("mask") == _signed(own)
        out = F.when(hit, rows(ms)) if out is None else out.when(hit, rows(ms))
    return fps.select("fp", F.explode(out).alias("k")).select("k.mask", "k.bits", "fp")


def buckets(fps: DataFrame, radius: int, large: int = LARGE) -> DataFrame:
    """(mask, bits, fp) such that fingerprints within the radius share a bucket; none beyond ``large`` unless it can't be split."""
    level, keyed = masks(radius), _by_masks(fps, {None: masks(radius)})
    done = None
    for last in (False, False, True):
        sizes = keyed.groupBy("mask", "bits").agg(F.count("*").alias("n")).filter("n > 1")
        sizes = written(sizes)
        over = sizes.filter(F.col("n") > large)
        final = last or over.limit(1).count() == 0
        fit = keyed.join(sizes if final else sizes.filter(F.col("n") <= large), ["mask", "bits"]).select("mask", "bits", "fp")
        done = fit if done is None else done.union(fit)
        if final:
            break
        nxt = {m: narrower(m, radius) for m in level}
        keyed = _by_masks(keyed.join(small(over.select("mask", "bits")), ["mask", "bits"], "left_semi"), nxt)
        level = [m for ms in nxt.values() for m in ms]
    return done


def _nodes(f: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of the index over Gray-ordered fingerprints, leaves first: shared bits (mask) and their pattern."""
    levels, ands, ors = [], f, f
    while True:
        starts = np.arange(0, len(ands), LEAF)
        ands, ors = np.bitwise_and.reduceat(ands, starts), np.bitwise_or.reduceat(ors, starts)
        levels.append((~(ands ^ ors), ands))
        if len(ands) == 1:
            return levels


def linked(f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes i < j of the pairs within the radius among Gray-ordered fingerprints."""
    levels = _nodes(f)
    a = b = np.zeros(1, np.int64)
    step = np.arange(LEAF)
    for depth in range(len(levels) - 1, -2, -1):
        if depth < len(levels) - 1:  # children of the surviving node pairs
            size = len(levels[depth][0]) if depth >= 0 else len(f)
            a, b = (np.repeat(a, LEAF * LEAF) * LEAF + np.tile(np.repeat(step, LEAF), len(a)), np.repeat(b, LEAF * LEAF) * LEAF + np.tile(step, len(b) * LEAF))
            keep = (a < size) & (b < size) & ((a <= b) if depth >= 0 else (a < b))
            a, b = a[keep], b[keep]
        if depth >= 0:
            mask, pattern = levels[depth]
            differ = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b])
        else:
            differ = np.bitwise_count(f[a] ^ f[b])
        keep = differ <= radius
        a, b = a[keep], b[keep]
    return a, b


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n over the pairs."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def groups(batches, columns: list[str]):
    """Whole groups of rows sorted by the columns, from batches that may cut them: (frame, starts)."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        new = np.zeros(len(batch), bool)
        new[0] = True
        for c in columns:
            v = batch[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        rest = batch.iloc[starts[-1] :]
        if len(starts) > 1:
            yield batch.iloc[: starts[-1]], starts[:-1]
    if rest is not None and len(rest):
        yield rest, np.zeros(1, np.int64)


def edges(fps: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """(a, b) edges between distinct fingerprints (column fp) that connect all within the radius: a forest for each bucket."""

    def run(batches):
        for rows, starts in groups(batches, ["mask", "bits"]):
            f = rows["fp"].to_numpy(np.int64).view(np.uint64)
            left, right = [], []
            for s, e in zip(starts, [*starts[1:], len(f)], strict=True):
                a, b = linked(f[s:e], radius)
                left.append(a + s)
                right.append(b + s)
            label = roots(len(f), np.concatenate(left), np.concatenate(right))
            own = np.flatnonzero(label != np.arange(len(f)))
            yield pd.DataFrame({"a": f[own].view(np.int64), "b": f[label[own]].view(np.int64)})

    placed = buckets(fps, radius, large).repartition("mask", "bits").sortWithinPartitions("mask", "bits", gray_rank(F.col("fp")))
    return placed.mapInPandas(run, "a long, b long").distinct()


def cluster(docs: DataFrame, words: int = 3, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id linked over any number of links)."""
    found = written(fingerprints(docs, words, doc_id, text))
    per_fp = written(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    root = components(edges(per_fp.select("fp"), radius))
    tagged = per_fp.join(root, per_fp.fp == root.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = tagged.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = tagged.join(lowest, "root").select("fp", "component_id")
    return found.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near-duplicates by similarity.

WORDS, SIMILARITY = 5, 0.8
#: Texts sampled for the order of shingles; from how many of them on one is common, or hot; how many such are kept.
SAMPLE, COMMON, HOT, MOST = 4_000, 3, 20, 200_000
#: Texts in a block of a list that is compared by sketches, and of a family that is compared by sets.
LIST, BLOCK = 2048, 256


def _key(text: str) -> Column:
    """128 bits that stand for a text; null is empty."""
    return F.unhex(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")))


def common(docs: DataFrame, words: int, text: str) -> tuple[np.ndarray, int]:
    """Shingles that many texts of a sample have, the commonest last, and from where on they are hot. It orders the shingles; any order finds the same pairs."""

    def run(batches):
        for b in batches:
            for t in b["text"]:
                yield pd.DataFrame({"h": np.unique(shingle_hashes(t, words)).view(np.int64)})

    one_in = max(1, docs.count() // SAMPLE)
    rows = docs.select(_key(text).alias("key"), F.col(text).alias("text")).filter(F.pmod(F.hash("key"), F.lit(one_in)) == 0).dropDuplicates(["key"])
    counts = rows.select("text").mapInPandas(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    top = counts.orderBy(F.desc("n"), "h").limit(MOST).collect()[::-1]
    return np.array([r.h for r in top], np.int64).view(np.uint64), sum(r.n < HOT for r in top)


def prefix(h: np.ndarray, by_value: np.ndarray, place: np.ndarray, hot: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The first of the distinct sorted hashes, common ones last: similar sets share one of their prefixes at least. In two parts, the hot ones after.

    Sets that share ``similarity`` of the larger can't differ in all of the first n - ceil(similarity n) + 1 of both.
    """
    if not len(h):
        return h, h
    late = np.full(len(h), -1)
    if len(by_value):
        at = np.minimum(np.searchsorted(by_value, h), len(by_value) - 1)
        late = np.where(by_value[at] == h, place[at], -1)
    order = np.argsort(late, kind="stable")[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]
    cold = int((late[order] < hot).sum())
    return h[order[:cold]], h[order[cold:]]


def sketch(h: np.ndarray) -> bytes:
    """Parities of how many of the hashes have each value modulo the width, the power of two from 3/4 of their number on (64 bits at least)."""
    width = 64
    while width < 0.75 * len(h):
        width *= 2
    return np.packbits(np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(m: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) at a smaller width."""
    while m.shape[1] > words:
        m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
    return m


def _matrix(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), "<u8").reshape(len(sketches), -1)


def possible(n1: np.ndarray, n2: np.ndarray, differ: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of so many elements that differ in so many at least can be similar; both have elements."""
    low, high = np.minimum(n1, n2), np.maximum(n1, n2)
    return (low > 0) & (low >= similarity * high - 1e-6) & (differ <= (1 - similarity) / (1 + similarity) * (n1 + n2) + 1e-6)


def candidates(n: np.ndarray, sketches: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) of the sets that their numbers and sketches allow to be similar."""
    width = np.array([len(s) for s in sketches])
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        own = own[np.argsort(n[own], kind="stable")]
        own_bits = _matrix([sketches[i] for i in own])
        for other_width in (w, 2 * w):
            other = own if other_width == w else np.flatnonzero(width == other_width)
            if not len(other):
                continue
            other = other[np.argsort(n[other], kind="stable")]
            bits = own_bits if other_width == w else folded(_matrix([sketches[i] for i in other]), own_bits.shape[1])
            step = max(1, 2_000_000 // (len(other) * bits.shape[1]))  # bounds the memory of a comparison
            for at in range(0, len(own), step):
                rows = own[at : at + step]
                end = int(np.searchsorted(n[other], n[rows[-1]] / similarity + 1e-6, "right"))
                start = at if other_width == w else 0
                if end <= start:
                    continue
                differ = np.bitwise_count(own_bits[at : at + step, None, :] ^ bits[None, start:end, :]).sum(2, dtype=np.int64)
                a, b = np.nonzero(possible(n[rows][:, None], n[other[start:end]][None, :], differ, similarity))
                a, b = rows[a], other[start:end][b]
                keep = np.ones(len(a), bool) if other_width > w else a != b
                left.append(np.minimum(a, b)[keep])
                right.append(np.maximum(a, b)[keep])
    return np.concatenate(left), np.concatenate(right)


def _described(docs: DataFrame, words: int, similarity: float, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, key (of the text), and of its distinct shingles fp, n (how many), sketch, cold and hot (the prefix)."""
    last, hot = common(docs, words, text)
    order = np.argsort(last)
    shared = docs.sparkSession.sparkContext.broadcast((last[order], order, hot))

    def run(batches):
        fresh()
        for b in _smaller(batches):
            out = []
            for t in b["text"]:
                h = np.unique(shingle_hashes(t, words))  # the set that is compared in the end
                cold, hot = prefix(h, *shared.value, similarity)
                out.append((fingerprint(bit_counts(h), len(h)), len(h), sketch(h), cold.view(np.int64), hot.view(np.int64)))
            of = dict(zip(("fp", "n", "sketch", "cold", "hot"), zip(*out, strict=True) if out else ((),) * 5, strict=True))
            yield pd.DataFrame({"doc_id": b["doc_id"], "key": b["key"]} | {c: pd.Series(of[c], b.index, np.int64 if c in ("fp", "n") else object) for c in of})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _key(text).alias("key"))
    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, key binary, fp long, n int, sketch binary, cold array<long>, hot array<long>")


def _smaller(batches, rows: int = 1000):
    """Batches of at most so many rows: what is made of a batch is some times its size."""
    for b in batches:
        for k in range(0, len(b), rows):
            yield b.iloc[k : k + rows]


def _spread(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: likely links of the nodes (node, fp), by the exact index of fingerprints; a forest for each bucket."""
    first = written(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    same = nodes.select("node", "fp").join(first, "fp").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    near = edges(first.select("fp"))
    of = lambda c: first.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}"))
    return _spread(same.unionByName(near.join(of("a"), "a").join(of("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))))


def by_prefix(rows: DataFrame) -> DataFrame:
    """(h, times, first, node) of the rows (h, node): shingles with several nodes, and the first of these; of shingles with the same nodes, one."""
    same = (F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1))))
    lists = rows.groupBy("h").agg(F.count("*").alias("times"), F.min("node").alias("first"), *(x.alias(f"x{k}") for k, x in enumerate(same))).filter("times > 1")
    lists = lists.groupBy("times", "first", "x0", "x1").agg(F.min("h").alias("h")).select("h", "times", "first")
    return rows.join(lists.hint("merge"), "h").select("h", "times", "first", "node")


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that sketches allow to be similar."""

    def run(batches):
        fresh()
        for p in batches:
            widths = pd.DataFrame({"a": p["sa"].str.len(), "b": p["sb"].str.len()})
            ok = np.zeros(len(p), bool)
            for _, at in widths.groupby(["a", "b"]).indices.items():
                x, y = _matrix(p["sa"].iloc[at].tolist()), _matrix(p["sb"].iloc[at].tolist())
                least = min(x.shape[1], y.shape[1])
                differ = np.bitwise_count(folded(x, least) ^ folded(y, least)).sum(1, dtype=np.int64)
                ok[at] = possible(p["na"].to_numpy(np.int64)[at], p["nb"].to_numpy(np.int64)[at], differ, similarity)
            yield p.loc[ok, ["a", "b"]]

    of = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    near = pairs.join(of("a"), "a").join(of("b"), "b").filter(F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-6)
    return near.mapInPandas(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, words: int, text: str) -> DataFrame:
    """(node, s): the shingle sets of the wanted nodes (node, key)."""

    def sets(batches):
        fresh()
        for b in _smaller(batches):
            yield pd.DataFrame({"node": b["node"], "s": [np.unique(shingle_hashes(t, words)).view(np.int64) for t in b["text"]]})

    texts = docs.select(_key(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(small(wanted), "key").dropDuplicates(["node"])
    return written(texts.select("node", "text").mapInPandas(sets, "node long, s array<long>"))


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many elements each two of the sets share."""
    sizes = [len(s) for s in sets]
    _, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[ids] > 1
    _, ids = np.unique(ids[shared], return_inverse=True)
    row = row[shared]
    order = np.argsort(ids, kind="stable")
    ids, row = ids[order], row[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
        a, b = np.searchsorted(ids, (low, low + width))
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], ids[a:b] - low] = 1
        out += part @ part.T
    return out


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter((shared >= similarity * (F.size("sa") + F.size("sb") - shared)) & (shared > 0)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Similar pairs that connect all that the pairs (a, b) connect: first each node with its first partner, then the pairs still apart."""
    first = written(similar(pairs.groupBy("b").agg(F.min("a").alias("a")), sets, similarity))
    rest = apart(pairs, components(first))
    if not rest.limit(1).count():
        return first
    return first.union(written(similar(rest, sets, similarity)))


def apart(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """The pairs (a, b) that root (node, root) does not put in one group."""
    of = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _dealt(rows: DataFrame, members: Column, size: int) -> DataFrame:
    """The rows of groups of so many members in blocks, once for each pair of blocks (i, j) that theirs is part of."""
    placed = rows.withColumn("blocks", F.ceil(members / F.lit(size)).cast("int")).withColumn("own", F.pmod(F.hash("node"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "own", "other")


def in_lists(lists: DataFrame, nodes: DataFrame, root: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b): of the lists that root does not hold together, pairs of different roots that sketches allow, a forest for each block."""
    placed = written(lists.filter("times > 2").join(root, "node", "left").select("h", "times", "node", F.coalesce("root", "node").alias("root")))
    mixed = written(placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("h"))
    open_ = _dealt(placed.join(mixed, "h").join(nodes.select("node", "n", "sketch"), "node"), F.col("times"), block)

    def run(batches):
        fresh()
        for rows, starts in groups(batches, ["h", "i", "j"]):
            node, own, n, bits = rows["node"].to_numpy(np.int64), rows["root"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["sketch"].tolist()
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
                a, b = candidates(n[s:e], bits[s:e], similarity)
                differ = own[s + a] != own[s + b]
                label = roots(e - s, a[differ], b[differ])
                tied = np.flatnonzero(label != np.arange(e - s))
                yield pd.DataFrame({"a": node[s + label[tied]], "b": node[s + tied]})

    key = ["h", "i", "j"]
    spread = open_.select(*key, "node", "root", "n", "sketch").repartition(*key).sortWithinPartitions(*key, "node")
    return written(spread.mapInPandas(run, "a long, b long").distinct())


def in_families(family: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b): a forest of the similar pairs in each pair of blocks of the families (node, root)."""

    def run(batches):
        fresh()
        for rows, starts in groups(batches, ["root", "i", "j"]):
            node = rows["node"].to_numpy(np.int64)
            for s, e in zip(starts, [*starts[1:], len(node)], strict=True):
                own = list(rows["s"].iloc[s:e])
                both, n = overlaps(own), np.array([len(x) for x in own])
                a, b = np.nonzero(np.triu((both > 0) & (both >= similarity * (n[:, None] + n - both) - 1e-6), 1))
                label = roots(len(own), a, b)
                tied = np.flatnonzero(label != np.arange(len(own)))
                yield pd.DataFrame({"a": node[s + label[tied]], "b": node[s + tied]})

    key = ["root", "i", "j"]
    members = family.groupBy("root").agg(F.count("*").alias("members"))
    spread = _dealt(family.join(members, "root"), F.col("members"), block).join(sets, "node").select(*key, "node", "s").repartition(*key).sortWithinPartitions(*key, "node")
    return written(spread.mapInPandas(run, "a long, b long").distinct())


def links(docs: DataFrame, nodes: DataFrame, words: int, similarity: float, text: str, size: int = LIST, block: int = BLOCK) -> DataFrame:
    """(a, b) of similar nodes that connect all similar ones: every pair whose prefixes meet is compared, or already connected."""
    known = nodes.select("node", "key", "n", "sketch", "fp")
    prefixes = lambda c: nodes.select(F.explode(c).alias("h"), "node")
    # Cold shingles are shuffled once; hot ones are counted before the shuffle and their join can be split.
    lists = written(by_prefix(prefixes("cold").repartition("h")).union(by_prefix(prefixes("hot"))))
    pairs = _spread(lists.select(F.col("first").alias("a"), F.col("node").alias("b")).union(by_fingerprint(known)))
    pairs = written(plausible(pairs, known, similarity))
    of = lambda some: _sets(docs, written(some.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known.select("node", "key"), "node")), words, text)
    found = verified(pairs, of(pairs), similarity)
    more = in_lists(lists, known, components(found), similarity, size)
    if not more.limit(1).count():
        return found
    return found.union(in_families(components(more), of(more), similarity, block))


def dedupe(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, without the near-duplicates: of each group the smallest doc_id stays, once.

    Groups are equal texts and texts that similar pairs join. A null text is an empty one.
    """
    texts = _described(docs, words, similarity, doc_id, text).groupBy("key").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("fp", "n", "sketch", "cold", "hot")))
    nodes = written(texts.withColumn("node", F.monotonically_increasing_id()))
    root = components(links(docs, nodes, words, similarity, text))
    tagged = nodes.select("key", "node", "first").join(root, "node", "left").select("key", "node", "first", F.coalesce("root", "node").alias("root"))
    best = tagged.groupBy("root").agg(F.min(F.struct("first", "node")).alias("best"))
    kept = tagged.join(best, "root").select("key", F.col("best.first").alias("first"), (F.col("node") == F.col("best.node")).alias("keep"))
    rows = docs.select(_key(text).alias("key"), F.col(doc_id).alias("doc_id")).groupBy("key", "doc_id").agg(F.count("*").alias("times")).join(kept, "key")
    key, own = free(docs, "_key"), free(docs, "_own")
    marked = written(rows.select(F.col("key").alias(key), F.col("doc_id").alias(own), (F.col("keep") & F.col("doc_id").eqNullSafe(F.col("first"))).alias("stays"), "times"))
    out = docs.withColumn(key, _key(text)).withColumn(own, F.col(doc_id))
    same = lambda d: (out[key] == d[key]) & out[own].eqNullSafe(d[own])
    gone = small(marked.filter("NOT stays").select(key, own))
    out = out.join(gone, same(gone), "left_anti")
    again = marked.filter("stays AND times > 1").select(key, own)
    if again.limit(1).count():
        again = small(again)
        once = out.join(again, same(again), "left_semi").dropDuplicates([key, own])
        out = out.join(again, same(again), "left_anti").unionByName(once)
    return out.drop(key, own)
