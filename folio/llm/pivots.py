"""Embedding near-duplicates over a pivot-permutation index.

A vector is described by its nearest pivots (reference vectors), the prefix of the
permutation that orders all pivots by similarity. Inverted lists are kept for combinations of
``shared`` pivots, so vectors meet in a list exactly if their prefixes share so many. A pair
belongs to one list only, the one of its smallest shared pivots. Lists hold ids, prefixes and sketches
(signs against 256 random directions) instead of vectors; entries whose sketch is near that of a partner in
the list get their vector in a second step, and are verified by cosine in double precision.

The pivots are fitted on a bounded sample (``SAMPLE`` vectors by hash of the id), chosen
so that no two are similar; every row is indexed. Their number grows with the cube root of
the rows, which keeps lists short, and the prefix with their number, which keeps recall: of pairs at
cosine 0.900 to 0.905 among random vectors of 64 dimensions, 0.99 share two of 6 of 92 pivots, 0.97 of 6 of 300, 0.98 of 7 of 732,
0.99 of 8 of 1,000 and 0.99 of 9 of 2,048; that is 15 to 36 lists for a vector. Sketches miss one pair in 100,000 at that cosine. Lists beyond ``large`` rows are
dealt in blocks, every pair of blocks to a task of its own. Equal vectors are one entry with a multiplicity.

Vectors of one length are indexed together, those of each length for themselves, however few they are.

Defined results: a vector that is null, zero, or holds null or non-finite components links with nothing: n_links 0, itself as
component, kept. Vectors of different lengths never link. A chain of links that forty rounds of joins can't follow stops the job.
Repeated rows link with each other. Empty tables give empty results.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import components, small, written
from folio.llm.simhash import groups, roots

COSINE, SHARED, LARGE, BLOCK = 0.9, 2, 1500, 750
#: Prefix up to so many pivots; one more pivot in it for every further factor.
PREFIX, UP_TO, FACTOR = 6, 300, 2.6
#: Signs in a sketch, and standard deviations beyond the mean distance of vectors at the cosine that still count as near.
SIGNS, SPREAD = 256, 4.4
SAMPLE, PER_CUBE_ROOT, PIVOTS, APART = 2000, 3.4, (24, 2048), 0.5


def usable(vector: str):
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def choose(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Rows of the (normalised) sample, in order, none closer than APART to one before; as many as wanted."""
    out = np.empty((0, sample.shape[1]))
    for x in sample:
        if len(out) == wanted:
            break
        if not len(out) or (out @ x).max() < APART:
            out = np.vstack([out, x])
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def prefixes(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each vector, ascending by number."""
    near = np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :length]
    return np.sort(near, axis=1).astype(np.int32)


def prefix_length(pivots: int) -> int:
    return min(pivots, PREFIX + max(0, math.ceil(math.log(max(pivots, 1) / UP_TO, FACTOR))))


def reach(cosine: float) -> int:
    """Differing signs up to which vectors may have the cosine."""
    p = math.acos(min(1.0, cosine)) / math.pi
    return math.ceil(SIGNS * p + SPREAD * math.sqrt(SIGNS * p * (1 - p)))


def close(signs: np.ndarray, pre: np.ndarray, keys: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Entries of two blocks of one list that have a partner in the other whose sketch is near, in the list that owns the pair."""
    out = []
    step = max(1, 1_000_000 // max(1, len(right)))
    for at in range(0, len(left), step):
        own = left[at : at + step]
        a, b = np.nonzero(np.bitwise_count(signs[own][:, None, :] ^ signs[right][None, :, :]).sum(2, dtype=np.int64) <= most)
        a, b = own[a], right[b]
        apart = a != b
        a, b = a[apart], b[apart]
        for k in range(0, len(a), 200_000):  # bounds the memory of a very dense list
            x, y = a[k : k + 200_000], b[k : k + 200_000]
            keep = owned(pre[x], pre[y], keys[x])
            out.append(np.unique(np.concatenate([x[keep], y[keep]])))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)


def similar(v: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) at the cosine or above; each once if both sides are the same."""
    a, b = np.nonzero(v[left] @ v[right].T >= cosine)
    a, b = left[a], right[b]
    return (a[a < b], b[a < b]) if left is right else (a, b)


def owned(a: np.ndarray, b: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Of pairs of prefixes, those whose smallest shared pivots are the key's."""
    hit = (a[:, :, None] == b[:, None, :]).any(2)
    first = hit & (np.cumsum(hit, axis=1) <= keys.shape[1])
    return (first == (a[:, :, None] == keys[:, None, :]).any(2)).all(1)


def links(entries: DataFrame, n: int, size: int, cosine: float, shared: int, large: int) -> DataFrame:
    """(id, root, links) of n entries (v, id, m) of one length: what each links with, by the pivot lists of that length."""
    sample = entries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    picked = unit(np.array([r.v for r in sample], np.float64))
    wanted = int(min(max(PIVOTS[0], PER_CUBE_ROOT * n ** (1 / 3)), PIVOTS[1]))
    pivots = choose(picked, wanted)
    k = prefix_length(len(pivots))
    s = min(shared, k)
    combos = list(combinations(range(k), s))
    kind = dict(entries.dtypes)["id"]
    directions = np.random.default_rng(1).standard_normal((size, SIGNS))

    def index(batches):
        for b in batches:
            v = np.array(b["v"].tolist(), np.float64)
            pre = prefixes(unit(v), pivots, k)
            code = np.zeros((len(v), len(combos)), np.int64)
            for c, places in enumerate(combos):
                for p in places:
                    code[:, c] = code[:, c] * PIVOTS[1] + pre[:, p]
            signs = np.packbits(unit(v) @ directions > 0, axis=1)
            marks = [x.tobytes() for x in np.concatenate([signs, pre.astype("<i2").view(np.uint8)], axis=1)]
            times = len(combos)
            yield pd.DataFrame({"key": code.reshape(-1), "id": np.repeat(b["id"].to_numpy(), times), "mark": [x for x in marks for _ in range(times)]})

    indexed = entries.mapInPandas(index, f"key long, id {kind}, mark binary")
    lists = written(indexed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    few = lists.filter(F.col("n") <= large)
    many = lists.filter(F.col("n") > large).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = indexed.join(few, "key").select("key", F.lit(0).alias("part"), F.lit(0).alias("side"), "id", "mark")
    if many.limit(1).count():
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        blocks = indexed.join(small(many), "key").select("key", "id", "mark", own.alias("own"), "blocks", other)
        part = 1 + (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).cast("int")
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        dealt = dealt.union(blocks.select("key", part.alias("part"), side.alias("side"), "id", "mark"))

    def near(batches):
        for rows_, starts in groups(batches, ["key", "part"]):
            ids, keys, sides = (rows_[c].to_numpy() for c in ("id", "key", "side"))
            marks = np.frombuffer(b"".join(rows_["mark"]), np.uint8).reshape(len(ids), -1)
            signs, pre = np.ascontiguousarray(marks[:, : SIGNS // 8]).view(np.uint64), np.ascontiguousarray(marks[:, SIGNS // 8 :]).view("<i2").astype(np.int32)
            key = np.stack([keys // PIVOTS[1] ** p % PIVOTS[1] for p in range(s)], axis=1)
            found = [np.empty(0, np.int64)]
            for a, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                at, side = np.arange(a, e), sides[a:e]
                found.append(close(signs, pre, key, at, at, reach(cosine)) if side[0] == 0 else close(signs, pre, key, at[side == 1], at[side == 2], reach(cosine)))
            own = np.concatenate(found)
            yield rows_.iloc[own][["key", "part", "side", "id"]]

    alive = written(dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInPandas(near, f"key long, part int, side int, id {kind}"))
    vectors = alive.join(entries.select("id", "m", "v"), "id").select("key", "part", "side", "id", "m", "v")

    def verify(batches):
        for rows_, starts in groups(batches, ["key", "part"]):
            ids, m, keys, sides = (rows_[c].to_numpy() for c in ("id", "m", "key", "side"))
            v = unit(np.array(rows_["v"].tolist(), np.float64))
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                at, side = np.arange(a, e), sides[a:e]
                x, y = similar(v, at, at, cosine) if side[0] == 0 else similar(v, at[side == 1], at[side == 2], cosine)
                left.append(x)
                right.append(y)
            x, y = np.concatenate(left), np.concatenate(right)
            if len(x):
                used, back = np.unique(np.concatenate([x, y]), return_inverse=True)
                pre = prefixes(v[used], pivots, k)
                key = np.stack([keys[x] // PIVOTS[1] ** p % PIVOTS[1] for p in range(s)], axis=1)
                keep = owned(pre[back[: len(x)]], pre[back[len(x) :]], key)
                x, y = x[keep], y[keep]
            count = np.bincount(x, m[y], len(ids)) + np.bincount(y, m[x], len(ids))
            label = roots(len(ids), x, y)
            own = np.flatnonzero(count)
            yield pd.DataFrame({"id": ids[own], "links": count[own].astype(np.int64), "root": ids[label[own]]})

    return written(vectors.repartition("key", "part").sortWithinPartitions("key", "part").mapInPandas(verify, f"id {kind}, links long, root {kind}").groupBy("id", "root").agg(F.sum("links").alias("links")))


def cluster(table: DataFrame, cosine: float = COSINE, shared: int = SHARED, large: int = LARGE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).withColumn("good", usable("v"))
    entries = written(rows.filter("good").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("m")))
    found = entries.select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("links")).limit(0)
    for r in entries.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).filter("n > 1").orderBy("size").collect():
        found = found.unionByName(links(entries.filter(F.size("v") == r.size), r.n, r.size, cosine, shared, large))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = entries.join(counts, "id", "left").join(comps, entries.id == comps.node, "left").select(
        "v", F.coalesce("root", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")
    )
    plain = rows.filter(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.filter("good").join(classes, "v", "left").select("vec_id", "n_links", "component_id").unionByName(plain)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
